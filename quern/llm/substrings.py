"""Exact removal of long repeated substrings, by an interval tree over enhanced suffix arrays.

A byte goes if a LENGTH-byte string that also starts elsewhere covers it. The
corpus is cut into suffix arrays that fit a task, without losing a repeat:

1. Anchors. A window of LENGTH bytes has one anchor, the place of its least hash of
   GRAM bytes (the first, if several). Equal windows have it at the same offset, so
   only windows whose anchors have equal hashes can be equal. The windows of one
   anchor lie side by side; the text that they cover is the anchor's context.
2. Anchors with equal contexts make whole contexts repeats; this needs no text, and
   copies, however many, come down to one context each.
3. Where anchors of one hash have different contexts, the contexts (one of each, and of
   these only those that have nearly a whole window in common with another) go
   into an enhanced suffix array: suffixes sorted by doubling, longest common
   prefixes, and a stack scan over the interval tree, which reports the repeats that
   can't be extended to the right (interval ends) nor to the left (the bytes before
   the occurrences differ), each with all its occurrences.

Which hashes step 3 needs is told to the executors by a Bloom filter of fixed size;
a false positive costs one context. Offsets are bytes of UTF-8.

Defined results: a null or empty text, and one shorter than LENGTH, keeps all its
bytes. Rows with the same doc_id are judged one by one; equal rows repeat each
other. Matches never cross documents. Further columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import partitions, written

LENGTH, GRAM = 200, 64
#: Bits for a place in a block; the rest of a key is the hash that windows are compared by.
PLACE = np.uint64(28)
BLOOM_BITS, PIECES = 26, 64
STEP = 17
#: Bytes of documents, and of contexts, that a task holds at once (a single longer document or hot hash is held whole).
BLOCK, CHUNK = 2 << 20, 3 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def anchors(docs: list[bytes]) -> tuple[np.ndarray, ...]:
    """doc, lo, hi (the context's place in the document), hash, context hash and offset in the context of every anchor."""
    import xxhash

    sizes = np.array([len(d) for d in docs], np.int64)
    ends = np.cumsum(sizes)
    raw = b"".join(docs)
    n = len(raw)
    if n >> int(PLACE):
        raise ValueError(f"a text of {max(sizes)} bytes: places in a block have {PLACE} bits")
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 6
    h = mix(np.ndarray((n - 7,), "<u8", raw, strides=(1,)).astype(np.uint64))
    for half in (8, 16, 32):
        h = mix(h[:-half] * MIX + h[half:])
    key = ((h >> PLACE) << PLACE) | np.arange(len(h), dtype=np.uint64)
    span, reach = LENGTH - GRAM + 1, 1
    least = key
    while 2 * reach <= span:
        least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
    least = np.minimum(least[: len(key) - span + 1], least[span - reach : span - reach + len(key) - span + 1])
    at = (least & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)[: len(at)]
    inside = np.flatnonzero(np.arange(len(at)) + LENGTH <= ends[doc])  # windows don't cross documents
    at, doc = at[inside], doc[inside]
    if not len(at):
        return (np.empty(0, np.int64),) * 6
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    lo, hi = inside[new], inside[np.r_[new[1:] - 1, len(at) - 1]] + LENGTH
    view, digest = memoryview(raw), xxhash.xxh3_64_intdigest
    context = np.fromiter((digest(view[i:j]) for i, j in zip(lo.tolist(), hi.tolist(), strict=True)), np.uint64, len(lo))
    begin = (ends - sizes)[doc[new]]
    return doc[new], lo - begin, hi - begin, h[at[new]].view(np.int64), context.view(np.int64), at[new] - lo


def held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list[bytes]]]:
    """doc_id, text hash and text of documents in blocks of bounded size."""
    ids, marks, texts, size = [], [], [], 0
    for batch in batches:
        for i, m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = t.as_buffer()
            if raw is None or len(raw) < LENGTH:
                continue
            if size + len(raw) > BLOCK and texts:
                yield ids, marks, texts
                ids, marks, texts, size = [], [], [], 0
            ids.append(i)
            marks.append(m)
            texts.append(raw.to_pybytes())
            size += len(raw)
    if texts:
        yield ids, marks, texts


SPANS = "kind int, hash long, doc_id long, mark long, lo int, hi int"


def found_by_hash(rows: DataFrame) -> DataFrame:
    """kind 0: a context that repeats as a whole; kind 1: a hash whose contexts differ (once each)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        np.seterr(over="ignore")
        for ids, marks, texts in held(batches):
            doc, lo, hi, code, context, _ = anchors(texts)
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(context), pa.array(ids, pa.int64()).take(pick), pa.array(marks, pa.int64()).take(pick), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["hash", "context", "doc_id", "mark", "lo", "hi"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # sorted by hash, context: of the last run only its first row and what has been said of it are kept
        row, alone, told = None, True, True
        for batch in batches:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch] if row is None else [row, batch]).combine_chunks()
            code, context = t.column("hash").to_numpy(), t.column("context").to_numpy()
            new_code = np.r_[True, code[1:] != code[:-1]]
            new = new_code | np.r_[True, context[1:] != context[:-1]]
            run = np.cumsum(new) - 1
            size = np.bincount(run)
            whole = (size >= 2)[run]
            if row is not None and not alone:
                whole[run == 0] = True
                whole[0] = False  # went out before
            second = new & ~new_code  # another context of the same hash
            group = np.cumsum(new_code) - 1
            has = np.bincount(group[second], minlength=group[-1] + 1) > 0
            firsts = np.flatnonzero(new_code)
            if row is not None and told:
                has[0] = False
            mixed = firsts[has]
            out = [(0, t.filter(pa.array(whole))), (1, t.take(pa.array(mixed)))]
            told = bool(has[-1]) or (row is not None and told and len(has) == 1)
            same_run = row is not None and run[-1] == 0
            alone = size[-1] < 2 if not same_run else alone and size[-1] < 2
            last = int(np.flatnonzero(new)[-1])
            row = t.slice(last, 1).to_batches()[0]
            for kind, x in out:
                yield from pa.table([pa.array([kind] * len(x), pa.int32()), *(x.column(c) for c in ("hash", "doc_id", "mark", "lo", "hi"))], ["kind", "hash", "doc_id", "mark", "lo", "hi"]).to_batches()

    marked = rows.mapInArrow(scan, "hash long, context long, doc_id long, mark long, lo int, hi int")
    return written(marked.repartition(partitions(rows.sparkSession), "hash").sortWithinPartitions("hash", "context").mapInArrow(classify, SPANS), "anchors")


def bloom_places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = mix(codes.view(np.uint64) * MIX)
    return (a >> np.uint64(64 - BLOOM_BITS)).astype(np.int64), (mix(a * MIX) >> np.uint64(64 - BLOOM_BITS)).astype(np.int64)


def bloom(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of 2**BLOOM_BITS bits over hashes(hash): one array of fixed size, put together in pieces on the executors."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for batch in batches:
            for place in bloom_places(batch.column("hash").to_numpy()):
                bits[place] = True
        parts = np.packbits(bits).reshape(PIECES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["piece", "bits"])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros((1 << BLOOM_BITS) // 8 // PIECES, np.uint8)
        for batch in batches:
            for b in batch.column("bits"):
                bits |= np.frombuffer(zlib.decompress(b.as_py()), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], ["piece", "bits"])

    kind, out = "piece int, bits binary", np.zeros((PIECES, (1 << BLOOM_BITS) // 8 // PIECES), np.uint8)
    for r in hashes.mapInArrow(put, kind).groupBy("piece").applyInArrow(merge, kind).collect():  # PIECES rows
        out[r.piece] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of a byte text, sorted by their first `depth` bytes or more, and the longest common prefix of each with the one before."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray((n,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    order = np.argsort(words)
    slots, key = np.arange(n), words[order]
    rank, levels, reach = np.empty(n, np.int32), [], 8
    del words
    while True:
        # equal keys are one group, whose rank is its first slot; a suffix that is alone has its final place
        new = np.r_[True, key[1:] != key[:-1]]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(key)])
        rank[order[slots]] = np.repeat(slots[first], size)
        levels.append(rank.copy())
        slots = slots[np.repeat(size > 1, size)]
        if reach >= depth or not len(slots):
            break
        some = order[slots]
        after = some + reach
        key = rank[some].astype(np.int64) * (n + 1)
        key += np.where(after < n, rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
        sub = np.argsort(key)
        order[slots], key = some[sub], key[sub]
        reach *= 2
    i, j, lcp = order[1:].copy(), order[:-1].copy(), np.zeros(n, np.int64)
    size = np.zeros(n - 1, np.int64)
    for level in range(len(levels) - 1, -1, -1):
        step = 8 << level
        for _ in range(2 if level == len(levels) - 1 else 1):
            ok = (i < n) & (j < n)
            same = np.zeros(n - 1, bool)
            same[ok] = levels[level][i[ok]] == levels[level][j[ok]]
            size[same] += step
            i[same] += step
            j[same] += step
    live = np.ones(n - 1, bool)
    for _ in range(8):
        live &= (i < n) & (j < n)
        live[live] = padded[i[live]] == padded[j[live]]
        size[live] += 1
        i[live] += 1
        j[live] += 1
    lcp[1:] = size
    return order, lcp


def maximal_repeats(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, i, j) of every repeat of `least` bytes or more whose occurrences order[i:j] can't all be extended, by a stack scan over the intervals of lcp. before: the byte before each suffix, negative and unlike any other where there is none."""
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    cuts = np.flatnonzero(np.diff(deep) > 1) + 1
    for part in np.split(deep, cuts):
        i, j = int(part[0]) - 1, int(part[-1]) + 1
        left = before[order[i:j]]
        if (left == left[0]).all() and left[0] >= 0:
            continue  # all can be extended, and so can those of every interval within
        stack: list[list] = []  # length, first, byte before (None: they differ)
        joined = lambda a, b: a if a == b and a is not None and a >= 0 else None
        depths, bytes_ = [*lcp[i + 1 : j].tolist(), 0], left.tolist()
        for k, depth in enumerate(depths):
            first, byte = k, bytes_[k]
            if byte < 0:
                byte = None
            while stack and stack[-1][0] > depth:
                length, start, seen = stack.pop()
                seen = joined(seen, byte)
                if seen is None:
                    yield length, i + start, i + k + 1
                first, byte = start, seen
            if depth >= least:
                if stack and stack[-1][0] == depth:
                    stack[-1][2] = joined(stack[-1][2], byte)
                else:
                    stack.append([depth, first, byte])


def repeats(contexts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(context, place), ...]) of the maximal repeats of LENGTH bytes or more between contexts of valid UTF-8."""
    # bytes that UTF-8 never has end each context, as a number of its own
    ends = [bytes(0xF8 + (k >> (3 * d) & 7) for d in range(8)) for k in range(len(contexts))]
    text = np.frombuffer(b"".join(x for pair in zip(contexts, ends, strict=True) for x in pair), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    start = np.cumsum(sizes + 8) - sizes - 8
    owner = np.repeat(np.arange(len(contexts)), sizes + 8)
    room = (start + sizes)[owner] - np.arange(len(text))
    order, lcp = suffix_array(text, 2 * LENGTH)
    lcp[1:] = np.minimum(lcp[1:], np.maximum(0, np.minimum(room[order[1:]], room[order[:-1]])))
    before = np.concatenate([[-1], text[:-1].astype(np.int64)])
    before[start] = -1 - np.arange(len(start))
    for length, i, j in maximal_repeats(order, lcp, before, LENGTH):
        at = order[i:j]
        yield length, list(zip(owner[at].tolist(), (at - start[owner[at]]).tolist(), strict=True))


def found_in_text(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """The spans of repeats between contexts that differ: doc_id, mark, lo, hi."""
    wanted = rows.sparkSession.sparkContext.broadcast(bloom(hashes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        np.seterr(over="ignore")
        bits = wanted.value
        for ids, marks, texts in held(batches):
            doc, lo, hi, code, context, off = anchors(texts)
            a, b = bloom_places(code)
            keep = ((bits[a >> 3] >> (7 - (a & 7)).astype(np.uint8)) & (bits[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1).astype(bool) if len(code) else np.zeros(0, bool)
            doc, lo, hi, code, context, off = (x[keep] for x in (doc, lo, hi, code, context, off))
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(context), pa.array(ids, pa.int64()).take(pick), pa.array(marks, pa.int64()).take(pick), pa.array(lo, pa.int32()), pa.array([texts[d][i:j] for d, i, j in zip(doc.tolist(), lo.tolist(), hi.tolist(), strict=True)], pa.binary()), pa.array(off, pa.int32())], ["hash", "context", "doc_id", "mark", "lo", "text", "off"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            spans = {}
            for length, places in repeats([r[5] for r in rows]):
                for k, at in places:
                    spans.setdefault(k, []).append((at, at + length))
            out = [(rows[k][2], rows[k][3], rows[k][4] + a, rows[k][4] + b) for k, s in spans.items() for a, b in merged(s)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc_id", "mark", "lo", "hi"])

        held_, group, seen, size = [], [], None, 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen is None or r[0] != seen[0]:
                    if len(group := alike(group)) > 1:
                        held_ += group
                        size += sum(len(g[5]) for g in group)
                        if size > CHUNK:
                            yield from solve(held_)
                            held_, size = [], 0
                    group = [r]
                elif r[1] != seen[1]:
                    group.append(r)  # one of each context
                seen = r
        held_ += alike(group)
        if held_:
            yield from solve(held_)

    cut = rows.mapInArrow(scan, "hash long, context long, doc_id long, mark long, lo int, text binary, off int")
    return written(cut.repartition(partitions(rows.sparkSession), "hash").sortWithinPartitions("hash", "context").mapInArrow(join, "doc_id long, mark long, lo int, hi int"), "repeats")


def alike(group: list[tuple]) -> list[tuple]:
    """Those contexts of one hash that may share a window: all but STEP bytes of the window, at least, must stand in two of them at one offset.

    A window has its anchor at an offset from 0 to LENGTH - GRAM. For offsets from q to q + STEP - 1 it holds
    the q bytes before the anchor and what is left of LENGTH - GRAM - (q + STEP - 1) bytes after it.
    """
    if len(group) < 2:
        return []
    seen: dict[tuple[int, bytes], list[int]] = {}
    for k, r in enumerate(group):
        text, off = r[5], r[6]
        for q in range(0, LENGTH - GRAM + 1, STEP):
            a, b = off - q, off + GRAM + max(0, LENGTH - GRAM - (q + STEP - 1))
            if a >= 0 and b <= len(text):
                seen.setdefault((q, text[a:b]), []).append(k)
    kept = {k for ks in seen.values() if len(ks) > 1 for k in ks}
    return [r for k, r in enumerate(group) if k in kept]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Their union, as maximal runs."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans (array of lo, hi; null: none) of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("text").cast("string").alias("text"))
    first = found_by_hash(rows)
    more = found_in_text(rows, first.where("kind = 1").select("hash"))
    spans = first.where("kind = 0").select("doc_id", "mark", "lo", "hi").unionByName(more).distinct()
    lists = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")).toDF("id", "m", "spans")
    return rows.join(lists, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m")), "left").select("doc_id", "text", "spans")


def digests(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, s in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = (t.as_buffer() or b"") and t.as_buffer().to_pybytes()
                runs = merged([(x["lo"], x["hi"]) for x in s or ()])
                kept, at, sha = len(raw), 0, hashlib.sha256()
                for a, b in runs:
                    sha.update(raw[at:a])
                    kept, at = kept - (b - a), b
                sha.update(raw[at:])
                out.append((len(raw), len(raw) - kept, len(runs), sha.hexdigest()))
            n, removed, runs, sha = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
