"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams, with its
ends marked, and of the word itself, all in hashed buckets; a misspelling keeps
most of its n-grams. The vectors of SEGMENT words in a row are averaged and go
through a two-class linear softmax. A text is as toxic as its worst segment, so
one insult in a long text isn't diluted. Vectors and softmax are trained jointly
in numpy: a text's label says whether any of its segments is toxic (the
likelihood of a noisy or).

The model is fitted on the driver on a bounded sample of the labelled rows: the
SAMPLE first ones of each label by a hash of doc_id, those texts that are longer
than SAMPLE_CHARS left out. Scoring reads every whole text, in one pass without
a shuffle; the model that is shipped has a fixed size.

Defined results: a null or empty text, and one without letters, scores 0. With
no labelled rows, or one label only, every score is 0. A doc_id with several
labels counts as toxic if any says so; null labels say nothing. Repeated rows
are scored one by one. Further columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from quern.llm.common import worker_state

BUCKETS, WIDTH, GRAMS, SEGMENT = 1 << 17, 8, (3, 4, 5), 8
SAMPLE, SAMPLE_CHARS, ROUNDS = 1_500, 8_000, 110
HELD_OUT = 5
#: Words whose n-grams are handled at once.
PART = 20_000
#: Entries of a worker's memo of words; beyond it the memo starts anew (results don't depend on it).
MEMO = 400_000
WORD = re.compile(r"[^\W\d_]+").findall


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and the numbers of the words that they belong to: each word as a whole, then its n-grams of UTF-8 bytes."""
    marked = [b"<%b>" % w.encode() for w in words]
    sizes = np.array([len(m) for m in marked])
    number = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(number))  # bytes from here to the word's end
    text = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    buckets, owners = [np.array([zlib.crc32(m) % BUCKETS for m in marked], np.int64)], [np.arange(len(words))]
    for n in GRAMS:
        code = np.full(max(len(text) - n + 1, 0), n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | text[k : k + len(code)]
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        ok = left[: len(code)] >= n
        buckets.append(code[ok].astype(np.int64) % BUCKETS)
        owners.append(number[: len(code)][ok])
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x WIDTH
    softmax: np.ndarray  # 2 x WIDTH
    bias: float

    def bucket_margins(self) -> np.ndarray:
        """What each bucket adds to the margin of label 1: the softmax is linear, so means of vectors and of margins agree."""
        return (self.vectors @ (self.softmax[1] - self.softmax[0])).astype(np.float32)


def train(texts: list[str], labels: list[int], rounds: int = ROUNDS, seed: int = 7) -> Model | None:
    if len(set(labels)) < 2:
        return None
    number: dict[str, int] = {}
    tokens, owner, kept = [], [], []
    for text, label in zip(texts, labels, strict=True):
        words = WORD(text.lower())
        if words:
            tokens.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
            owner.append(np.arange(len(words)) // SEGMENT)
            kept.append(label)
    y = np.array(kept, bool)
    if y.all() or not y.any():
        return None
    segments = np.array([o[-1] + 1 for o in owner])
    first = np.cumsum(segments) - segments
    segment = np.concatenate([o + f for o, f in zip(owner, first, strict=True)])
    token = np.concatenate(tokens)
    doc = np.repeat(np.arange(len(y)), segments)
    size = np.bincount(segment).astype(float)
    # words in parts, so that what lies beside the model stays small
    names = list(number)
    del number, texts
    parts = [(base, len(names[base : base + PART]), *(x.astype(np.int32) for x in grams(names[base : base + PART]))) for base in range(0, len(names), PART)]
    counts = np.concatenate([np.bincount(word, minlength=n) for _, n, _, word in parts])
    seg_starts = np.flatnonzero(np.diff(segment, prepend=-1))
    rng = np.random.default_rng(seed)
    vectors, softmax, bias = rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.1, (2, WIDTH)), -4.0
    weight = np.where(y, 0.5 / y.sum(), 1.0 / (~y).sum())
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (vectors, softmax, np.zeros(1))]
    for step in range(1, rounds + 1):
        slope = softmax[1] - softmax[0]
        by_slope = vectors @ slope
        margin = np.concatenate([np.bincount(word, by_slope[bucket], n) for _, n, bucket, word in parts]) / counts
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(margin[token], seg_starts) / size + bias, -30, 30)))
        none = np.add.reduceat(np.log1p(-np.minimum(p, 1 - 1e-9)), first)  # log of no segment being toxic
        some = -np.expm1(np.minimum(none, -1e-9))
        g = p * (weight * np.where(y, -np.exp(none) / some, 1.0))[doc]
        by_word = np.bincount(token, (g / size)[segment], len(names)) / counts
        by_bucket = sum(np.bincount(bucket, by_word[base : base + n][word], BUCKETS) for base, n, bucket, word in parts)
        d_slope = vectors.T @ by_bucket
        grads = (by_bucket[:, None] * slope + 1e-7 * vectors, np.stack([-d_slope, d_slope]) + 1e-6 * softmax, np.array([g.sum()]))
        moves = []
        for (m, v), grad in zip(moments, grads, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            moves.append(0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        vectors, softmax, bias = vectors - moves[0], softmax - moves[1], bias - float(moves[2][0])
    return Model(vectors, softmax, bias)


class Scorer:
    def __init__(self, model: Model | None):
        self.margins, self.bias, self.known = model and model.bucket_margins(), model and model.bias, {}

    def scores(self, texts: list[str]) -> list[float]:
        if self.margins is None:
            return [0.0] * len(texts)
        words = [WORD(t.lower()) for t in texts]
        if len(self.known) > MEMO:
            self.known.clear()
        new = set()
        for ws in words:
            new.update(ws)
        if new := list(new - self.known.keys()):
            buckets, owners = grams(new)
            self.known.update(zip(new, (np.bincount(owners, self.margins[buckets], len(new)) / np.bincount(owners, minlength=len(new))).tolist(), strict=True))
        return [self.worst(ws) for ws in words]

    def worst(self, words: list[str]) -> float:
        """The probability of the worst segment."""
        if not words:
            return 0.0
        m = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        starts = np.arange(0, len(words), SEGMENT)
        margin = float((np.add.reduceat(m, starts) / np.minimum(SEGMENT, len(words) - starts)).max()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -60, 60))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Trained on a bounded sample of the rows of labels(doc_id, toxic) that aren't held out."""
    marks = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic"))
    # 2 * sample ids at most, and so few texts
    some = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(sample) for k in (0, 1)]
    ids = some[0].unionByName(some[1])
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).orderBy("id").collect()
    return train([r.text for r in rows], [int(r.toxic) for r in rows])


def scored(docs: DataFrame, labels: DataFrame, column: str = "score") -> DataFrame:
    """docs' columns with one more: the probability of label 1."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        scorer = opened(model)
        for batch in batches:
            text, done = batch.column(names.index("text")), []
            for k in range(0, len(text), 2_500):
                done += scorer.scores([str(t or "") for t in text.slice(k, 2_500).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.float64())], [*names, column])

    return docs.mapInArrow(run, StructType([*docs.schema.fields]).add(column, DoubleType()))


def opened(model) -> Scorer:
    """One model, with its memo, for all tasks of a Python worker."""
    value = model.value
    scorer = worker_state(("toxicity", id(value)), lambda: Scorer(value))
    scorer.kept = value  # so that its id stays its own
    return scorer


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
