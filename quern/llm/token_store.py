"""Token ids in Arrow files with fixed-size-list batches, and random access to them.

Documents are dealt by ranges of doc_id. Each task encodes its range in
ascending order and packs the ids, without gaps, into rows of `width` ids: one
Arrow file (the stream format with a footer of batch offsets), whose two columns
are fixed-size lists, the ids (16 bits wide where the vocabulary allows) and a
mask of single bits (1: an id, 0: the padding after a file's last id). Uncompressed batches of
equal-length rows are read by offset from a memory map, without a copy. A
file's name holds the attempt that wrote it; the index, which Spark commits,
names the files that count, so attempts that were lost leave no trace.

Defined results: a null text is empty and has the end id alone. Rows with a null
doc_id come first. Rows with one doc_id stand together, ordered by a checksum of
their text; equal rows each have a place. An empty table writes no file.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.bpe import SPACE, blocks
from quern.llm.common import open_in, open_out, partitions, scratch, worker_state

WIDTH, ROWS = 1024, 256
#: Entries of a worker's memo of chunks; beyond it the memo starts anew (results don't depend on it).
MEMO = 1_000_000
MARKS = frozenset(".,;:!?")
WORD = re.compile(f"[^{SPACE}]+")
INDEX = "doc_id long, part int, file string, at long, n_tokens long"


class ChunkEncoder:
    """A tokenizer of the tokenizers library over whole texts: white space ends every piece, so each distinct chunk goes through the library once."""

    def __init__(self, vocabulary: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end = self.kind(end).tobytes()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}

    def learn(self, chunks: list[str]) -> None:
        """The ids of new chunks: many chunks make one text, with a word between them that none of them has."""
        mark, encode = "\x01", self.tokenizer.encode_batch_fast
        odd = [c for c in chunks if mark in c]
        for c, e in zip(odd, encode(odd, add_special_tokens=False), strict=True):
            self.known[c] = np.array(e.ids, self.kind).tobytes()
        if odd:
            chunks = [c for c in chunks if mark not in c]
        (between,) = self.tokenizer.encode(mark, add_special_tokens=False).ids
        for k in range(0, len(chunks), 10_000):
            part = chunks[k : k + 10_000]
            ids = np.array(encode([f" {mark} ".join([*part, ""])], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(ids == between)
            raw, size = ids.tobytes(), ids.itemsize
            at = (ends * size).tolist()
            self.known.update(zip(part, [raw[i:j] for i, j in zip([0, *(x + size for x in at)], at, strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        low = [t.encode().lower().decode() for t in texts]  # A-Z only, which the tokenizer does as well
        parts = list(map(WORD.findall, low))
        for k, t in enumerate(low):
            if any(s in t for s in self.special):
                parts[k] = None
        if len(self.known) > MEMO:
            self.known.clear()
        chunks = set()
        for p in parts:
            chunks.update(p or ())
        # a mark after a letter always begins a piece of its own: words are learned once, with and without it
        new = chunks - self.known.keys()
        ended = [c for c in new if c[-1] in MARKS and "a" <= c[-2:-1] <= "z"]
        self.learn(list(new.difference(ended).union([c[:-1] for c in ended], MARKS) - self.known.keys()))
        for c in ended:
            self.known[c] = self.known[c[:-1]] + self.known[c[-1]]
        get = self.known.__getitem__
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind).tobytes()
        return [np.frombuffer((whole(texts[k]) if p is None else b"".join(map(get, p))) + self.end, self.kind) for k, p in enumerate(parts)]


def opened(vocabulary: str, end: int) -> ChunkEncoder:
    """One tokenizer, with its memo, for all tasks of a Python worker."""
    return worker_state(("tokens", vocabulary, end), lambda: ChunkEncoder(vocabulary, end))


class Packer:
    """Writes one file: ids go in as they come, rows of `width` go out in batches of ROWS."""

    def __init__(self, path: str, kind: np.dtype, width: int):
        if width % 8:
            raise ValueError("rows of a multiple of eight ids, so that their masks are whole bytes")
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), width)), ("mask", pa.list_(pa.bool_(), width))])
        self.sink = open_out(path)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.width, self.kind, self.waiting, self.held, self.n = width, kind, [], 0, 0

    def add(self, ids: np.ndarray) -> int:
        at, self.n = self.n, self.n + len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.width * ROWS:
            flat, full = np.concatenate(self.waiting), self.width * ROWS
            for k in range(0, self.held - full + 1, full):
                self.write(flat[k : k + full], full)
            self.waiting = [flat[self.held - self.held % full :]]
            self.held %= full
        return at

    def write(self, flat: np.ndarray, n: int) -> None:
        rows = -(-n // self.width)
        ids, mask = np.zeros(rows * self.width, self.kind), np.zeros(rows * self.width, bool)
        ids[:n], mask[:n] = flat, 1
        self.file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x), self.width) for x in (ids, mask)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self.write(np.concatenate(self.waiting), self.held)
        self.file.close()
        self.sink.close()


class Reader:
    """Random access to one file's ids."""

    def __init__(self, path: str):
        self.source = open_in(path)
        self.file = pa.ipc.open_file(self.source)
        self.width = self.file.schema.field("ids").type.list_size
        self.n = self.file.num_record_batches
        self.batches: dict[int, np.ndarray] = {}

    def rows(self, batch: int) -> np.ndarray:
        """The ids of a batch as a matrix over the mapped memory."""
        return self.file.get_batch(batch).column("ids").values.to_numpy().reshape(-1, self.width)

    def mask_bits(self, batch: int) -> np.ndarray:
        """The masks of a batch as a matrix of bytes over the mapped memory, eight places in each, the first in the lowest bit."""
        column = self.file.get_batch(batch).column("mask")
        return np.frombuffer(column.values.buffers()[1], np.uint8, len(column) * self.width // 8, column.values.offset // 8).reshape(-1, self.width // 8)

    def masks(self, batch: int) -> np.ndarray:
        """The masks of a batch, a boolean for each place (a copy)."""
        return np.unpackbits(self.mask_bits(batch), axis=1, bitorder="little").astype(bool)

    def flat(self, batch: int) -> np.ndarray:
        if batch not in self.batches:
            if len(self.batches) > 8:
                self.batches.clear()
            self.batches[batch] = self.rows(batch).reshape(-1)
        return self.batches[batch]

    def ids(self, at: int, n: int) -> np.ndarray:
        full, out = self.width * ROWS, []
        while n:
            part = self.flat(at // full)[at % full : at % full + n]
            out.append(part)
            at, n = at + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)


def write(docs: DataFrame, vocabulary: str, end: int = 1, width: int = WIDTH) -> DataFrame:
    """Writes docs(doc_id, text) and returns the committed index: doc_id, part (files in order of doc_id), file, at (of the first id in the file), n_tokens."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gc.disable()
        part, coder, packer = TaskContext.get().partitionId(), None, None
        path = f"{folder}/data/{part:06d}-{uuid.uuid4().hex[:8]}.arrow"
        for ids, texts in blocks(batches, 8_000_000):
            if not packer:
                coder = opened(vocabulary, end)
                packer = Packer(path, coder.kind, width)
            found = coder.encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array([path] * len(ids)), pa.array(map(packer.add, found), pa.int64()), pa.array(map(len, found), pa.int64())], ["doc_id", "part", "file", "at", "n_tokens"])
        if packer:
            packer.close()

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(text as string), '') text")
    ranged = rows.repartitionByRange(partitions(spark), "doc_id", F.crc32("text")).sortWithinPartitions("doc_id", F.crc32("text"))
    ranged.mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def starts(index: DataFrame) -> DataFrame:
    """The index with start, the number of ids of all documents before each. The window is over one row per file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = totals.select(F.col("part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.col("at")).drop("before")


def read_back(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, path = None, None
        for batch in batches:
            sums = []
            for file, at, n in zip(*(batch.column(c).to_pylist() for c in ("file", "at", "n_tokens")), strict=True):
                if file != path:
                    reader, path = Reader(file), file
                sums.append(zlib.crc32(reader.ids(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts(index).select("doc_id", "start", "n_tokens", "file", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def files(spark: SparkSession, index: DataFrame) -> list[str]:
    """The files that count, in order; as many as there were tasks."""
    return [r.file for r in index.select("part", "file").distinct().orderBy("part").collect()]


