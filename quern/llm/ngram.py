"""N-gram language-model scores from an Elias-Fano trie.

Levels: the vocabulary (words by the order of their 64-bit hashes, so that a word's
number is its rank) and, for each word as a context, the words seen after it. The
second level is dealt over shards by a hash of the context; in a shard contexts are
numbered, and the child w of context k is the value k * V + w: one rising sequence
over all contexts, held in Elias-Fano code, as are the pointers to where each
context's children begin. A query (context, word) is a successor search relative to
its context's base. Probabilities and back-off weights are quantised to 8 bits on a
log scale, always downwards, so that a context's probabilities never add up to more
than 1. The levels are files in the shared folder, written by the executors and
mapped into memory by them; they grow with the corpus, the driver holds their names.

Model: interpolated absolute discounting, p(w | u) = (c(u, w) - D) / c(u) +
D * kinds(u) / c(u) * p(w), where p(w) = (c(w) - D1) / N, and all words outside the
vocabulary share D1 * V / N. A text begins after an end token. D = n1 / (n1 + 2 n2)
of a shard's pairs, D1 the same of the words.

Counts cover all training documents; pairs are counted task by task and shipped as
sorted, compressed arrays, which a shard adds up as they come: it holds its distinct
pairs, of which a context has at most V, twice at most. Defined results: a null text is empty and has the end token alone.
A null doc_id counts as '' (training). Without training documents every token has
probability 1. Rows are scored one by one. Further columns are ignored.
"""

from __future__ import annotations

import gc
import json
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import open_in, open_out, scratch, worker_state, written

FOLDS, HELD = 7, 2
#: Words in a vocabulary shard, and training tokens for a shard of pairs, at most on average.
SHARD_WORDS, SHARD_TOKENS = 1_000_000, 2_500_000
#: Entries of a worker's memo of words; pairs that a task holds before it counts them.
MEMO, HELD_PAIRS = 500_000, 4_000_000
END = b" "  # no word has a space
SCALE, STEPS = 9.0, 255  # codes 0..255 stand for log10 p of -9..0
MIX = np.uint64(0x9E3779B97F4A7C15)
SELECT = np.array([[([i for i in range(8) if b >> i & 1] + [8] * 8)[r] for r in range(8)] for b in range(256)], np.uint8)
BITS = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z, and the six white-space characters of ASCII


def code_of(p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((np.log10(np.maximum(p, 1e-30)) / SCALE + 1) * STEPS), 0, STEPS).astype(np.uint8)


def value_of(code: np.ndarray) -> np.ndarray:
    return 10.0 ** ((code / STEPS - 1) * SCALE)


class EliasFano:
    """A rising sequence of integers: low bits packed, high parts in unary with a count of ones for each word."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = np.arange(len(ones), dtype=np.int64) * 64 - ones

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        v = values.astype(np.uint64)
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = (n + (universe >> bits)) // 64 + 2
        unary = np.zeros(size * 64, bool)
        unary[place] = True
        high = np.packbits(unary, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]])
        if bits:
            planes = ((v[:, None] >> np.arange(bits, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(bool).reshape(-1)
            low = np.packbits(np.concatenate([planes, np.zeros(-len(planes) % 64 + 128, bool)]), bitorder="little").view("<u8")
        else:
            low = np.zeros(2, "<u8")
        return cls(n, bits, low, high, ones.astype(np.int64))

    def lows(self, j: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(j), np.uint64)
        at = j * self.low_bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> off
        out |= np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.low_bits) - 1)

    def select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The places of the k-th ones or zeros (from 0) of the high part."""
        before = self.ones if ones else self.zeros
        word = np.searchsorted(before, k, side="right") - 1
        bits = self.high[word] if ones else ~self.high[word]
        bytes_ = np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(BITS[bytes_], axis=1, dtype=np.uint8)
        rest = (k - before[word]).astype(np.uint8)
        byte = (upto <= rest[:, None]).sum(1, dtype=np.int64)
        at = np.arange(len(k)) * 8 + byte
        rest -= np.where(byte > 0, upto.reshape(-1)[np.maximum(at - 1, 0)], 0).astype(np.uint8)
        return word * 64 + byte * 8 + SELECT[bytes_.reshape(-1)[at], rest]

    def get(self, j: np.ndarray) -> np.ndarray:
        return ((self.select(j, True) - j).astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(j)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The places in the sequence of values, -1 where they aren't in it: the successor within the values of the same high part."""
        v = values.astype(np.uint64)
        part = (v >> np.uint64(self.low_bits)).astype(np.int64)
        want = v & np.uint64((1 << self.low_bits) - 1)
        first = np.where(part > 0, self.select(np.maximum(part - 1, 0), False) + 1, 0) - part
        last = self.select(part, False) - part
        # binary search: a frequent context has many children of one high part
        low, high = first.copy(), last.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self.lows(middle) < want[live]
            low[live[less]] = middle[less] + 1
            high[live[~less]] = middle[~less]
            live = live[low[live] < high[live]]
        out = np.full(len(v), -1, np.int64)
        inside = np.flatnonzero(low < last)
        hit = inside[self.lows(low[inside]) == want[inside]]
        out[hit] = low[hit]
        return out


def save(path: str, arrays: dict[str, np.ndarray], **facts) -> None:
    """Arrays one after another behind a header; each begins at a multiple of 64 bytes."""
    head, at = {"facts": facts, "arrays": {}}, 0
    for name, a in arrays.items():
        head["arrays"][name] = (a.dtype.str, at, len(a))
        at += -(-a.nbytes // 64) * 64
    raw = json.dumps(head).encode()
    with open_out(path) as out:
        out.write(len(raw).to_bytes(8, "little") + raw + bytes(-(8 + len(raw)) % 64))
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 64))


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    source = open_in(path)
    size = int.from_bytes(source.read_at(8, 0), "little")
    head = json.loads(source.read_at(size, 8))
    base = -(-(8 + size) // 64) * 64
    data = source.read_buffer if isinstance(source, pa.MemoryMappedFile) else None
    source.seek(base)
    body = memoryview(data() if data else source.read())
    return {k: np.frombuffer(body, dtype, n, at) for k, (dtype, at, n) in head["arrays"].items()}, head["facts"]


class Vocabulary:
    """The first level: numbers and counts of words by their hashes."""

    def __init__(self, files: list[str]):
        parts = [load(f)[0] for f in files]
        self.hashes, self.counts = [p["hash"] for p in parts], [p["count"] for p in parts]
        self.offsets = np.cumsum([0, *map(len, self.hashes)]).tolist()
        self.bounds = np.array([h[0] for h in self.hashes], np.int64)
        self.forget()

    def forget(self) -> None:
        """The memo: words' places in arrays of their numbers and counts."""
        self.known: dict[bytes, int] = {}
        self.number, self.count = np.empty(0, np.int64), np.empty(0, np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """number (-1: none) and count of each hash."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = np.searchsorted(self.bounds, hashes, side="right") - 1
        for s in np.unique(shard[shard >= 0]).tolist():
            mine = np.flatnonzero(shard == s)
            at = np.minimum(np.searchsorted(self.hashes[s], hashes[mine]), len(self.hashes[s]) - 1)
            ok = self.hashes[s][at] == hashes[mine]
            number[mine[ok]], count[mine[ok]] = at[ok] + self.offsets[s], self.counts[s][at[ok]]
        return number, count

    def numbers(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """number and count of every token of the texts, one after another, each text with its end token."""
        import xxhash

        if len(self.known) > MEMO:
            self.forget()
        new = {END}
        for t in texts:
            new.update(t)
        new = list(new - self.known.keys())
        number, count = self.find(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in new), np.uint64, len(new)).view(np.int64))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.number, self.count = np.concatenate([self.number, number]), np.concatenate([self.count, count])
        get, end = self.known.__getitem__, [END]
        at = np.fromiter((x for t in texts for x in map(get, t + end)), np.int64, sum(map(len, texts)) + len(texts))
        return self.number[at], self.count[at]


def blocks(batches: Iterator[pa.RecordBatch], most: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    """Batches cut into slices of bounded text: batch, first row, words of the slice's texts."""
    for batch in batches:
        at, size, held = 0, 0, []
        for t in batch.column("text"):
            held.append(words_of(t.as_py()))
            size += len(t.as_py() or "")
            if size > most:
                yield batch, at, held
                at, size, held = at + len(held), 0, []
        if held:
            yield batch, at, held


def opened(words: list[str], pairs: list[str]) -> tuple[Vocabulary, Model]:
    """The levels, mapped once for all tasks of a Python worker, with their memo."""
    return worker_state(("ngram", *words, *pairs), lambda: (Vocabulary(words), Model(pairs)))


def count_words(train: DataFrame) -> DataFrame:
    """hash, n of every token of train(text); counted task by task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        gc.disable()

        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in c), np.uint64, len(c)).view(np.int64)), pa.array(list(c.values()), pa.int64())], ["hash", "n"])

        c: Counter = Counter()
        for _, _, texts in blocks(batches):
            c[END] += len(texts)
            for t in texts:
                c.update(t)
            if len(c) > MEMO:
                yield out(c)
                c = Counter()
        if c:
            yield out(c)

    return written(train.select("text").mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")


def write_vocabulary(counts: DataFrame, kinds: int, folder: str) -> list[str]:
    bits = max(3, (kinds // SHARD_WORDS).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = list(batches)
        if t and sum(map(len, t)):
            hashes, n, shard = (np.concatenate([b.column(c).to_numpy() for b in t]) for c in ("hash", "n", "shard"))
            for s in np.unique(shard).tolist():
                path = f"{folder}/words-{uuid.uuid4().hex}"
                save(path, {"hash": hashes[shard == s], "count": n[shard == s]})
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([path])], ["shard", "file"])

    shard = (F.shiftright("hash", 64 - bits) + (1 << (bits - 1))).cast("int")
    rows = counts.withColumn("shard", shard).repartitionById(1 << bits, "shard").sortWithinPartitions("shard", "hash").select("hash", "n", "shard").mapInArrow(run, "shard int, file string")
    return [r.file for r in written(rows, "vocabulary").orderBy("shard").collect()]  # one for each shard


def squeeze(a: np.ndarray) -> bytes:
    """An array's bytes, lowest first of all values, then the next, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes())


def unsqueeze(raw: bytes, dtype: type) -> np.ndarray:
    import zstandard

    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(dtype).reshape(-1)


def shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    x = context.astype(np.uint64) * MIX
    return ((x ^ (x >> np.uint64(29))) * MIX >> np.uint64(33)).astype(np.int64) % shards


def count_pairs(train: DataFrame, words: list[str], shards: int) -> DataFrame:
    """shard, keys, counts: sorted pairs (context << 32 | word) of one task and shard, as compressed differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        np.seterr(over="ignore")
        vocabulary, _ = opened(words, [])
        end = vocabulary.find(np.array([_hash(END)], np.int64))[0][0]

        def out(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            shard = shard_of(keys >> 32, shards)
            order = np.argsort(shard, kind="stable")
            keys, n, shard = keys[order], n[order].astype(np.uint32), shard[order]
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
            for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([shard[i]], pa.int32()), pa.array([squeeze(np.diff(keys[i:j], prepend=0))], pa.binary()), pa.array([squeeze(n[i:j])], pa.binary())], ["shard", "keys", "counts"])

        held, size = [], 0
        for _, _, texts in blocks(batches):
            number, _ = vocabulary.numbers(texts)
            before = np.r_[end, number[:-1]]  # after a text's end token the next text begins
            held.append((before << 32) | number)
            if (size := size + len(number)) > HELD_PAIRS:
                yield from out(held)
                held, size = [], 0
        if held:
            yield from out(held)

    return train.select("text").mapInArrow(run, "shard int, keys binary, counts binary")


def _hash(word: bytes) -> int:
    import xxhash

    x = xxhash.xxh3_64_intdigest(word)
    return x - (1 << 64) if x >> 63 else x


def added_up(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its counts."""
    keys, n = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def write_pairs(counted: DataFrame, kinds: int, shards: int, folder: str) -> list[str]:
    """The second level, a file for each shard, in order of the shards; '' for a shard without pairs."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, size, most = [], [], 0, HELD_PAIRS
        for b in batches:
            for k, c in zip(b.column("keys"), b.column("counts"), strict=True):
                keys.append(np.cumsum(unsqueeze(k.as_py(), np.int64)))
                n.append(unsqueeze(c.as_py(), np.uint32))
                if (size := size + len(keys[-1])) > most:  # the pairs of a frequent context come from every task: what is held is the distinct ones, twice at most
                    keys, n = ([x] for x in added_up(keys, n))
                    size = len(keys[0])
                    most = max(HELD_PAIRS, 2 * size)
        keys, n = added_up(keys, n)
        context, word = keys >> 32, keys & 0xFFFFFFFF
        starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        total, size = np.add.reduceat(n, starts), np.diff(np.r_[starts, len(keys)])
        which = np.repeat(np.arange(len(starts)), size)
        discount = min(0.95, max(0.05, (n == 1).sum() / max(1, (n == 1).sum() + 2 * (n == 2).sum())))
        children = EliasFano.of(which * kinds + word, len(starts) * kinds)
        pointers = EliasFano.of(np.r_[starts, len(keys)], len(keys) + 1)
        arrays = {"context": context[starts], "p": code_of((n - discount) / total[which]), "rest": code_of(discount * size / total)}
        for name, ef in (("children", children), ("pointers", pointers)):
            arrays |= {f"{name}.low": ef.low, f"{name}.high": ef.high, f"{name}.ones": ef.ones}
        path = f"{folder}/pairs-{uuid.uuid4().hex}"
        save(path, arrays, kinds=kinds, children=(children.n, children.low_bits), pointers=(pointers.n, pointers.low_bits))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([path])], ["shard", "file"])

    rows = written(counted.groupBy("shard").applyInArrow(run, "shard int, file string"), "pairs").collect()  # one for each shard
    found = {r.shard: r.file for r in rows}
    return [found.get(s, "") for s in range(shards)]


class Pairs:
    """One shard of the second level."""

    def __init__(self, path: str):
        a, facts = load(path)
        self.context, self.p, self.rest, self.kinds = a["context"], a["p"], a["rest"], facts["kinds"]
        ef = lambda name: EliasFano(*facts[name], *(a[f"{name}.{k}"] for k in ("low", "high", "ones")))
        self.children, self.pointers = ef("children"), ef("pointers")

    def after(self, context: int) -> tuple[np.ndarray, np.ndarray]:
        """The words after a context, and their discounted probabilities."""
        k = int(np.searchsorted(self.context, context))
        if k == len(self.context) or self.context[k] != context:
            return np.empty(0, np.int64), np.empty(0)
        i, j = self.pointers.get(np.array([k, k + 1])).astype(np.int64)
        return self.children.get(np.arange(i, j)).astype(np.int64) - k * self.kinds, value_of(self.p[i:j])

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The discounted probability of each word after its context, and the weight of the level above."""
        k = np.minimum(np.searchsorted(self.context, context), len(self.context) - 1)
        seen = self.context[k] == context
        p, rest = np.zeros(len(k)), np.ones(len(k))
        rest[seen] = value_of(self.rest[k[seen]])
        ask = np.flatnonzero(seen & (word >= 0))
        j = self.children.find(k[ask] * self.kinds + word[ask])
        p[ask[j >= 0]] = value_of(self.p[j[j >= 0]])
        return p, rest


class Model:
    """The second level, all shards."""

    def __init__(self, files: list[str]):
        self.pairs = [Pairs(f) if f else None for f in files]

    def find(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, rest = np.zeros(len(context)), np.ones(len(context))
        shard = np.where(context >= 0, shard_of(context, len(self.pairs)), -1)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(len(self.pairs) + 1))
        for s, pairs in enumerate(self.pairs):
            mine = order[cuts[s] : cuts[s + 1]]
            if pairs and len(mine):
                p[mine], rest[mine] = pairs.find(context[mine], word[mine])
        return p, rest


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    folder = scratch(spark, "trie")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD).alias("held_out"), F.col("text").cast("string").alias("text"))
    train = rows.where(~F.col("held_out"))
    counts = count_words(train)
    total, kinds, n1, n2 = counts.agg(F.sum("n"), F.count("n"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
    if kinds >= 1 << 31:
        raise ValueError(f"{kinds} distinct words: a pair's key has 32 bits for each of its words")
    total, discount = total or 0, min(0.95, max(0.05, n1 / max(1, n1 + 2 * n2)))
    words = write_vocabulary(counts, kinds, folder) if kinds else []
    shards = max(1, -(-total // SHARD_TOKENS))
    pairs = write_pairs(count_pairs(train, words, shards), kinds, shards, folder) if kinds else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        np.seterr(over="ignore")
        vocabulary, model = opened(words, pairs) if words else (None, None)
        end = vocabulary.find(np.array([_hash(END)], np.int64))[0][0] if words else -1
        for batch, at, texts in blocks(batches):
            size = np.array([len(t) + 1 for t in texts])
            starts = np.cumsum(size) - size
            part = batch.slice(at, len(texts))
            if not words:
                known, base, score = (np.zeros(len(texts), t) for t in (np.int64, float, float))
            else:
                number, c = vocabulary.numbers(texts)
                before = np.r_[end, number[:-1]]
                before[starts] = end
                keys, back = np.unique(((before + 1) << 32) | (number + 1), return_inverse=True)
                p, rest = model.find((keys >> 32) - 1, (keys & 0xFFFFFFFF) - 1)
                one = np.where(c > 0, (c - discount) / total, discount * kinds / total)
                score = np.add.reduceat(np.log10(np.minimum(1.0, p[back] + rest[back] * one)), starts)
                base = np.add.reduceat(np.log10((c + 1) / (total + kinds + 1)), starts)
                known = np.add.reduceat((c > 0).astype(np.int64), starts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(size, pa.int64()), pa.array(known, pa.int64()), pa.array([total] * len(texts), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64())], [f.split()[0] for f in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)
