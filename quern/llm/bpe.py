"""Byte-level BPE by a pair occurrence index, and its decoding.

The distinct pieces of a batch lie in one array of symbols. An index maps each
pair that has a merge rule to all its positions; the active ranks are taken in
ascending order, a rank is applied at all its positions from left to right, and
the lists of the pairs that arise are extended. Stale positions are recognised
by the symbols that stand there and are skipped.

Defined results: a null text is encoded as the empty one; an empty text has no
tokens, the checksums of empty strings, and decodes to ''. Repeated rows and
rows with a null doc_id give a row each. Further columns are ignored. A text's
length is bounded only by what one row may hold.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import worker_state

# White space of Unicode, the contractions and classes of the byte-level pre-tokenizer.
SPACE = "\t-\r \x85\xa0  -     　"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space and the word after it: the pre-tokenizer never looks beyond such a chunk.
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Entries of a task's memo of chunks; beyond it the memo starts anew (results don't depend on it).
MEMO = 350_000
#: From so many positions on, a rank is applied to all of them at once.
LONG = 24
KINDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


class Strings:
    """Byte strings by number, and their concatenation for an array of numbers."""

    def __init__(self, all_: list[bytes]):
        self.sizes = np.array([len(x) for x in all_], np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.text = np.frombuffer(b"".join(all_), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        at = np.cumsum(sizes, dtype=np.int64) - sizes
        places = np.repeat(self.starts[ids] - at, sizes)
        places += np.arange(len(places))
        return self.text[places].tobytes()


class PairIndexBPE:
    """A byte-level BPE vocabulary in the JSON of the tokenizers library."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are read")
        vocab, chars = model["vocab"], byte_chars()
        self.pieces = regex.compile(PIECES).findall
        self.first = np.array([vocab[c] for c in chars])
        self.wide = 1 << max(vocab.values()).bit_length()
        pairs = [rule if isinstance(rule, list) else rule.split(" ") for rule in model["merges"]]
        #: The two symbols and the merged one, by rank; and the rank of a pair.
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        ranks = {a * self.wide + b: r for r, (a, b, _) in reversed(list(enumerate(self.rules)))}
        self.rank_of = ranks.get
        self.pair_keys = np.array(sorted(ranks))
        self.pair_ranks = np.array([ranks[k] for k in self.pair_keys.tolist()])
        self.byte_ranks = np.array([[ranks.get(a * self.wide + b, -1) for b in self.first.tolist()] for a in self.first.tolist()])
        back = {c: b for b, c in enumerate(chars)}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()}
        self.added = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError("added tokens that take white space aren't read")
            self.added[t["content"]] = t["id"]
            self.bytes[t["id"]] = t["content"].encode()
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.kind = np.dtype(np.uint16 if self.wide <= 1 << 16 else np.uint32)
        self.texts = Strings([self.bytes.get(i, b"") for i in range(self.wide)])
        self.numerals = Strings([b"%d," % i for i in range(self.wide)])
        #: The memo of words' and chunks' ids, as arrays' bytes. It starts anew when full.
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as an array's bytes; merges never cross from one to the next."""
        if not pieces:
            return []
        wide, rank_of, rules = self.wide, self.rank_of, self.rules
        ends = np.cumsum([len(p) for p in pieces])
        text = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(text)
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[0] = before[ends[:-1]] = -1
        # the index: the rank of every pair that has a rule -> its positions, ascending
        ranks = self.byte_ranks[text[:-1], text[1:]]
        ranks[ends[:-1] - 1] = -1
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        active, starts = np.unique(ranks[order], return_index=True)
        where = dict(zip(active.tolist(), (x.tolist() for x in np.split(order, starts[1:])), strict=True)) if len(active) else {}
        active = active.tolist()
        # one memory, seen as arrays for long lists of positions and by single places for short ones
        s_all, l_all, r_all = self.first[text], before, after
        sym, left, right = memoryview(s_all), memoryview(l_all), memoryview(r_all)
        pop, push = heapq.heappop, heapq.heappush
        while active:
            rank = pop(active)
            a, b, new = rules[rank]
            places = where.pop(rank)
            if len(places) > LONG and a != b:
                at = np.sort(np.array(places))
                at = at[np.diff(at, prepend=-1) > 0]
                at = at[(s_all[at] == a) & (r_all[at] >= 0)]
                gone = r_all[at]
                at, gone = at[keep := s_all[gone] == b], gone[keep]
                s_all[at], s_all[gone] = new, -1
                r_all[at] = far = r_all[gone]
                inner = far >= 0
                l_all[far[inner]] = at[inner]
                near = l_all[at]
                inner2 = near >= 0
                pairs = np.concatenate([new * wide + s_all[far[inner]], s_all[near[inner2]] * wide + new])
                where_to = np.concatenate([at[inner], near[inner2]])
                found = np.minimum(np.searchsorted(self.pair_keys, pairs), len(self.pair_keys) - 1)
                ok = self.pair_keys[found] == pairs
                found, where_to = self.pair_ranks[found[ok]], where_to[ok]
                order = np.argsort(found, kind="stable")
                found, where_to = found[order], where_to[order].tolist()
                cuts = np.flatnonzero(np.diff(found, prepend=-1))
                for r, i, j in zip(found[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(found)], strict=False):
                    if r in where:
                        where[r] += where_to[i:j]
                    else:
                        where[r] = where_to[i:j]
                        push(active, r)
                continue
            for i in sorted(places):
                if sym[i] != a or (j := right[i]) < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                right[i] = k = right[j]
                if k >= 0:
                    left[k] = i
                    if (r := rank_of(new * wide + sym[k])) is not None:
                        if r in where:
                            where[r].append(i)
                        else:
                            where[r] = [i]
                            push(active, r)
                if (h := left[i]) >= 0 and (r := rank_of(sym[h] * wide + new)) is not None:
                    if r in where:
                        where[r].append(h)
                    else:
                        where[r] = [h]
                        push(active, r)
        upto = (np.cumsum(s_all >= 0)[ends - 1] * self.kind.itemsize).tolist()
        kept = s_all[s_all >= 0].astype(self.kind).tobytes()
        return [kept[i:j] for i, j in zip([0, *upto], upto, strict=False)]

    def learn(self, chunks: set[str]) -> None:
        """Puts the ids of new chunks into the memo, all their new pieces in one index."""
        if len(self.chunks) > MEMO:
            self.words, self.chunks = {}, {}
        words, known = self.words, self.chunks
        fresh = {c: self.pieces(c) for c in chunks - known.keys()}
        new = list({w for ws in fresh.values() for w in ws} - words.keys())
        words.update(zip(new, self.encode_pieces([w.encode() for w in new]), strict=True))
        for c, ws in fresh.items():
            known[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        special = [k for k, t in enumerate(texts) if any(a in t for a in self.added)]
        found, chunks = list(map(CHUNK.findall, texts)), set()
        for k in special:
            found[k] = [x for i, p in enumerate(self.split(texts[k])) for x in ([p] if i % 2 else CHUNK.findall(p))]
        for cs in found:
            chunks.update(cs)
        self.learn(chunks - self.added.keys())
        for a, i in self.added.items():  # they stand for themselves, as a chunk that is nothing else always does
            self.chunks[a] = self.kind.type(i).tobytes()
        get = self.chunks.__getitem__
        return [np.frombuffer(b"".join(map(get, cs)), self.kind) for cs in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones included; bytes that aren't UTF-8 become the replacement character."""
        return self.texts.of(ids).decode(errors="replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        return self.numerals.of(ids)[:-1]


def opened(path: str) -> PairIndexBPE:
    """One vocabulary, with its memo, for all tasks of a Python worker."""
    return worker_state(("bpe", path), lambda: PairIndexBPE(path))


def blocks(batches: Iterable[pa.RecordBatch], most: int = 5_000_000) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts (null: empty) in blocks of bounded size."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            ids.append(i)
            texts.append(t)
            if (size := size + len(t)) > most:
                yield ids, texts
                ids, texts, size = [], [], 0
        if ids:
            yield ids, texts


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of docs(doc_id, text); no shuffle."""

    def run(batches):
        gc.disable()  # millions of small lists and no cycles
        bpe = opened(vocabulary)
        sha = lambda s: hashlib.sha256(s).hexdigest()
        for ids, texts in blocks(batches):
            codes = bpe.encode_texts(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, codes), pa.int64()), pa.array([sha(bpe.decimal(c)) for c in codes], pa.string()), pa.array([sha(bpe.decode(c).encode()) for c in codes], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, KINDS)


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """docs' doc_id with the ids themselves (array<int>) and the text that they decode to."""

    def run(batches):
        gc.disable()  # millions of small lists and no cycles
        bpe = opened(vocabulary)
        for ids, texts in blocks(batches):
            codes = bpe.encode_texts(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(codes, pa.list_(pa.int32())), pa.array(map(bpe.decode, codes), pa.string())], ["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
