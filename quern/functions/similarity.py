"""Vector and trigram similarity as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 1 for vectors that are empty, of different length, or zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norms == 0), 1.0).otherwise(1 - dot(a, b) / norms)


def trigrams(text: Column) -> Column:
    """Each word in lower case between two spaces and one, in three-character windows, each once."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3))))))


def set_similarity(x: Column, y: Column) -> Column:
    """Of two arrays of trigrams."""
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def hashed_slots(text: Column, size: int = 1024) -> Column:
    """The slot of each token of a bag-of-words embedding; text without tokens has slot 0."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[0-9a-z]+"), F.lit(0))
    some = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("")))
    return F.transform(some, lambda t: F.when(t == "", 0).otherwise(F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long") % size))


def slot_counts(slots: Column) -> Column:
    """map of slot to count."""
    return F.map_from_entries(F.transform(F.array_distinct(slots), lambda v: F.struct(v, F.size(F.filter(slots, lambda x: x == v)).cast("double"))))


def squared_norm(slots: Column) -> Column:
    """The sum of the squared counts of a list of slots, in one pass over the sorted list."""
    start = F.struct(F.lit(-1).cast("long").alias("slot"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda a, x: F.when(a["slot"] == x, F.struct(a["slot"].alias("slot"), (a["run"] + 1).alias("run"), (a["sum"] + 2 * a["run"] + 1).alias("sum"))).otherwise(F.struct(x.alias("slot"), F.lit(1.0).alias("run"), (a["sum"] + 1).alias("sum")))
    return F.aggregate(F.sort_array(slots), start, step, lambda a: a["sum"])


def bag_cosine(slots: Column, weights: Column, norm: Column) -> Column:
    """Cosine of the counts of a list of slots with those of a map of slots (norm: its squared norm): one pass over the list."""
    dot = F.aggregate(slots, F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(weights, x), F.lit(0.0)))
    return dot / (F.sqrt(squared_norm(slots)) * F.sqrt(norm))
