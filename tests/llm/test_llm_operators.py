"""The operators against brute force, with nulls, empty and repeated rows, ties and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import ann, bpe, decontaminate, jaccard, ngram, secrets, sharding, substrings, token_store, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
EXTRA = "rid string, s int, hash string, spans int, words string, score string, source string"
PARAGRAPH = "It is a long passage about nothing, éloigné de tout, whose Words and numbers 12 go on and on until it ends where the Next one begins. "


def texts():
    rng = random.Random(5)
    words = [f"w{k}é" if k % 7 == 0 else f"Word{k}" for k in range(300)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = line(60)
    near = base.replace(" ", "  ", 1).split(" ")
    out = [base, base, base + " tail", " ".join(near[:-3] + ["other", "end", "here"]), "", None, "   ", "one", "Two words", line(12), PARAGRAPH * 3 + line(10), line(5) + PARAGRAPH * 3, "aaaa " * 200, "x" * 1500, line(3000)]
    out += [base[:k] + line(4) + base[k:] for k in range(0, 120, 10)] + ["漢字 🙂 naïve\tTabs\n\nlines ", "<|endoftext|> 's don't <|ENDOFTEXT|>"]
    return out


def table(spark, some):
    rows = [(i, t, str(i % 3), 7, "h", 1, "w", "s", f"src{i % 4}") for i, t in enumerate(some)]
    rows += [rows[0], (None, some[0], None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts()).repartition(3).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def same(got, want):
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def empty(spark):
    return spark.createDataFrame([], f"doc_id long, text string, {EXTRA}")


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
low = lambda t: (t or "").encode().lower().decode()


@pytest.mark.parametrize("broadcast", [decontaminate.BROADCAST_ROWS, 0])
def test_decontamination(spark, docs, rows, broadcast, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    items = [(1, rows[0][1] or "x y"), (2, PARAGRAPH), (3, "One"), (4, "two WORDS"), (5, "no such words are anywhere in here at all today"), (6, ""), (7, None), (None, PARAGRAPH), (2, "one"), (8, PARAGRAPH[20:])]
    bench = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, words string")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = WORDS(low(t))
        if w and i is not None:
            for k in range(max(1, len(w) - 9)):
                windows[tuple(w[k : k + 10])].add(str(i))
    want = []
    for d, t in rows:
        w, hit, ids = WORDS(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= {*range(k, k + n)}
                    ids |= found
        want.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    same([tuple(r) for r in decontaminate.digests(docs, bench).select(cols).collect()], want)
    assert {r.n_hit for r in decontaminate.digests(docs, bench.limit(0)).collect()} == {0}
    assert decontaminate.digests(empty(spark), bench).count() == 0


def test_decontamination_by_items_of_one_id(spark):
    texts = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("a", 10), ("b", 10), ("c", 14), ("d", 12))]
    bench = spark.createDataFrame([(7, t) for t in texts] + [(8, texts[0])], "item_id long, text string")
    some = [*texts, "x " + texts[1] + " y", " ".join(texts[2].split()[4:]), " ".join(texts[0].split()[:9]), "none of it"]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {0: (10, ["7", "8"]), 1: (10, ["7"]), 2: (14, ["7"]), 3: (12, ["7"]), 4: (10, ["7"]), 5: (10, ["7"]), 6: (0, []), 7: (0, [])}


@pytest.mark.parametrize("shard,block", [(ann.SHARD, ann.BLOCK), (100, 7)])
def test_ann_recall_and_exact_scores(spark, shard, block, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 24)) * rng.uniform(0.5, 2, (1200, 1))
    x[100:300] = x[100]
    bad = [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5003, [None] * 24), (None, [1.0] * 24), (5020, [1.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    assert set(got) == set(range(0, 1200, 20))
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        top = np.lexsort((np.arange(1200), -s.round(9)))[:20]
        assert len(found) == 20 and all(abs(x[i] @ x[q] - v) < 1e-9 for i, v in found)
        hit += len({*top} & {i for i, _ in found})
    assert hit / (20 * len(got)) >= 0.9
    few = ann.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4


def test_ann_ties_repeats_and_empty_tables(spark):
    rows = [(i, [1.0, 0.0, 0.0], "q", i, "r", 0.5) for i in range(25)] + [(3, [1.0, 0.0, 0.0], "q", 3, "r", 0.5), (30, [0.0, 2.0, 0.0], "q", 1, "r", 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query_id string, rank int, v string, score double")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect())
    ids = {q: [i for i, *_ in sorted(rows[:26], key=lambda r: r[0]) if i != q][:20] for q in (0, 20)}
    assert got == [(q, k, i, 1.0) for q in (0, 20) for k, i in enumerate(ids[q], 1)]  # ties go to the smaller vec_id, repeated rows are each a candidate
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id > 20 and vec_id < 30"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("tokens,held_pairs", [(ngram.SHARD_TOKENS, ngram.HELD_PAIRS), (300, 20)])
def test_ngram_scores(spark, docs, rows, tokens, held_pairs, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", tokens)  # several shards of pairs, whose pieces are added up as they come
    monkeypatch.setattr(ngram, "HELD_PAIRS", held_pairs)
    held = [zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for d, _ in rows]
    toks = [low(t).encode().split() + [None] for _, t in rows]
    c, p = collections.Counter(), collections.Counter()
    for t, h in zip(toks, held, strict=True):
        if not h:
            c.update(t)
            p.update(zip([None] + t[:-1], t, strict=True))
    n, v = sum(c.values()), len(c)
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in ngram.scores(docs).collect()]
    want = [(d, h, len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for (d, _), t, h in zip(rows, toks, held, strict=True)]
    same(got, want)
    out = ngram.scores(docs).collect()
    assert all(r.score <= 0 for r in out) and sum(r.score for r in out) > sum(r.base_score for r in out)
    assert ngram.scores(empty(spark)).count() == 0


@pytest.mark.parametrize("tokens,off", [(ngram.SHARD_TOKENS, 0.0), (5000, 0.1)])
def test_ngram_scores_lie_near_a_plain_model(spark, tokens, off, monkeypatch):
    monkeypatch.setattr(ngram, "SHARD_TOKENS", tokens)  # each shard has a discount of its own
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.8))}" for _ in range(30_000)]
    docs = spark.createDataFrame([(i, " ".join(words[60 * i : 60 * i + 60])) for i in range(500)], "doc_id long, text string")
    texts = {r.doc_id: r.text.split() for r in docs.collect()}
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    c, p = collections.Counter(), collections.defaultdict(collections.Counter)
    for t in train.values():
        for a, b in zip([None, *t], [*t, None], strict=True):
            c[b] += 1
            p[a][b] += 1
    n, v, pairs = sum(c.values()), len(c), collections.Counter(k for x in p.values() for k in x.values())
    share = lambda k: min(0.95, max(0.05, k[1] / max(1, k[1] + 2 * k[2])))
    d1, d2 = share(collections.Counter(c.values())), share(pairs)

    def plain(t):
        out = 0.0
        for a, b in zip([None, *t], [*t, None], strict=True):
            one = (c[b] - d1) / n if c[b] else d1 * v / n
            seen = sum(p[a].values()) if a in p else 0
            out += math.log10((max(0, p[a][b] - d2) + d2 * len(p[a]) * one) / seen if seen else one)
        return out

    for r in ngram.scores(docs).collect():
        assert -off <= (plain(texts[r.doc_id]) - r.score) / r.n_tokens < 0.04 + off, r  # quantised downwards


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=300), st.lists(st.integers(0, 10**9), min_size=1, max_size=50))
def test_elias_fano(values, asked):
    v = np.unique(np.array(values))
    ef = ngram.EliasFano.of(v, int(v[-1]) + 1)
    assert (ef.get(np.arange(len(v))).astype(np.int64) == v).all()
    ask = np.array([*asked, *values])
    ask = ask[ask <= v[-1]]
    want = np.where(v[np.minimum(np.searchsorted(v, ask), len(v) - 1)] == ask, np.searchsorted(v, ask), -1)
    assert (ef.find(ask) == want).all()


def classes(sets, ids):
    n = len(sets)
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = collections.defaultdict(list)
    for i in range(n):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) if sets[i] else ids[i] for i in range(n)]


def shingle_set(t):
    w = low(t).encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_jaccard_join(spark, docs, rows):
    sets = [shingle_set(t) for _, t in rows]
    want = [(d, len(s), c) for (d, _), s, c in zip(rows, sets, classes(sets, [d for d, _ in rows]), strict=True)]
    same([tuple(r) for r in jaccard.linked(docs).select("doc_id", "n_shingles", "component_id").collect()], want)
    assert jaccard.linked(empty(spark)).count() == 0


def test_jaccard_join_of_many_near_copies(spark):
    """Groups whose copies are near the base but not each other, chains, and shared passages."""
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(4000)}"
    some, passage = [], [word() for _ in range(40)]
    for size, edits in ((40, 2), (40, 4), (30, 7)):
        base = [word() for _ in range(90)]
        some.append(base)
        for _ in range(size):
            copy = list(base)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = word()
            some.append(copy)
    some += [passage + [word() for _ in range(rng.randrange(5, 40))] for _ in range(60)]
    text = [" ".join(w) for w in some]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    sets = [shingle_set(t) for t in text]
    want = [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, classes(sets, list(range(len(sets)))), strict=True))]
    same([tuple(r) for r in jaccard.linked(df).select("doc_id", "n_shingles", "component_id").collect()], want)


def test_toxicity(spark):
    rng = random.Random(3)
    plain = [f"p{chr(97 + a)}{chr(97 + b)}lo" for a in range(20) for b in range(20)]
    make = lambda bad: " ".join(rng.choice(plain) for _ in range(rng.randrange(20, 200))) + (f" {rng.choice(['grobnuk', 'vilzek'])} " if bad else " ") + rng.choice(plain)
    data = [(i, make(i % 2), i % 2) for i in range(600)] + [(600, None, 1), (601, "", 0), (602, "12 34", 0)]
    df = spark.createDataFrame([(i, t, "x") for i, t, _ in data], "doc_id long, text string, score string").unionByName(spark.createDataFrame([(0, data[0][1], "x"), (None, "grobnukk", "x")], "doc_id long, text string, score string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = toxicity.digests(df, labels).collect()
    assert len(out) == len(data) + 2
    truth = {i: y for i, _, y in data[:600]}
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in test) >= 0.9 * len(test)
    assert next(r for r in out if r.doc_id is None).predicted == 1  # an unseen misspelling
    assert {r.score for r in out if r.doc_id in (600, 601, 602)} == {0.0}
    assert {r.score for r in toxicity.digests(df, labels.limit(0)).collect()} == {0.0}


def test_token_store(spark, docs, rows):
    t = Tokenizer.from_file(WORD)
    index = token_store.write(docs, WORD, end=1, width=64)
    out = token_store.read_back(index).collect()
    ids = {}
    for d, x in rows:
        full = t.encode(x or "", add_special_tokens=False).ids + [1]
        ids.setdefault((d, len(full), zlib.crc32(np.array(full, "<u4").tobytes())), []).append(full)
    same([(r.doc_id, r.n_tokens, r.ids_crc32) for r in out], [k for k, v in ids.items() for _ in v])
    at = 0
    for r in sorted(out, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    reader = token_store.Reader(token_store.files(spark, index)[0])
    assert reader.rows(0).shape[1] == 64 and reader.rows(0).base is not None
    per_file = collections.Counter()
    for r in index.collect():
        per_file[r.file] += r.n_tokens
    for file, n in per_file.items():
        reader = token_store.Reader(file)
        masks = [reader.masks(b) for b in range(reader.n)]
        assert all(m.shape == reader.rows(b).shape == (len(m), 64) and reader.mask_bits(b).base is not None for b, m in enumerate(masks))
        flat = np.concatenate([m.reshape(-1) for m in masks])
        assert flat[:n].all() and not flat[n:].any() and len(flat) - n < 64
        assert not np.concatenate([reader.flat(b) for b in range(reader.n)])[n:].any()
    assert token_store.read_back(token_store.write(empty(spark), WORD)).count() == 0
    with pytest.raises(ValueError):
        token_store.Packer("/tmp/none", np.uint16, 63)


def test_secrets(docs, spark):
    value = "Ab3" + "xY9z" * 6
    more = ["password = hunter22 token=abc", f"key {value} end", f"again {value}", "AKIA" + "Z9" * 10 + " and " + "0f" * 15, 'é API-KEY "secret": "s3cr3t+value" token=token: abcdefgh', "passwd:short", f"token={value}"]
    both = docs.select("doc_id", "text", "source", "rid").unionByName(spark.createDataFrame([(100 + i, t, f"own{i}", "z") for i, t in enumerate(more)], "doc_id long, text string, source string, rid string"))
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for r in both.collect():
        t = r.text or ""
        found = [[(m.start(), k, m.end()) for m in p.finditer(t) if len(m[g]) >= n] for k, (p, g, n) in enumerate(((a, 2, 6), (re.compile("AKIA[A-Z0-9]+"), 0, 20), (re.compile("[0-9a-f]+"), 0, 24)))]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{i}:{j}" for i, k, j in sorted(sum(found, [])))
        want.append((r.doc_id, *map(len, found), hashlib.sha256(base.encode()).hexdigest()))
    out = secrets.digests(both)
    same([tuple(r) for r in out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()], want)
    suspect = {r.doc_id for r in both.where(F.col("text").rlike(secrets.SUSPECT)).collect()}
    assert {r.doc_id for r in secrets.scan(both, shared=99, copied=10**9).collect() if r.spans} <= suspect
    spans = {r.doc_id: r.spans for r in out.collect()}
    assert spans[101] == "" and spans[106].startswith("assign:")  # three owners: an example
    two = secrets.digests(both.where("doc_id in (101, 102)")).collect()
    assert {r.spans for r in two} == {"token:4:31", "token:6:33"}  # two owners: live
    assert secrets.digests(both.limit(0)).count() == 0


def test_secrets_by_repositories_and_owners(spark):
    live, example, template = ("Ab3" + c * 8 + "Yz9q" * 4 for c in "MNO")
    rows = [(k, f"x {live} y", "own1") for k in range(3)] + [(10 + k, f"x {example} y", f"own{k}") for k in range(4)] + [(20 + k, f"x {template} y", "own1") for k in range(12)]
    rows += [(1, f"x {live} y", "own1"), (99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    held = {r.hash: (r.repositories, r.owners) for r in secrets.ownership(secrets.spans_of(secrets.found_in(docs))).collect()}
    assert held == {hashlib.sha256(v.encode()).hexdigest(): n for v, n in ((live, (3, 1)), (example, (4, 4)), (template, (12, 1)))}
    kept = lambda **o: sorted(r.doc_id for r in secrets.scan(docs, **o).collect() if r.spans)
    assert kept() == [0, 1, 1, 2, *range(20, 32)]  # one owner's values
    assert kept(copied=10) == [0, 1, 1, 2]  # what one owner has in many repositories is a template
    assert kept(shared=5, copied=10) == [0, 1, 1, 2, 10, 11, 12, 13]
    lost = spark.createDataFrame([(None, f"x {live} y", "own1")] * 5 + [(None, f"x {live} y", "own2"), (1, f"x {live} y", "own1"), (2, f"x {example} y", None)], "doc_id long, text string, source string")
    held = {r.hash: (r.repositories, r.owners) for r in secrets.ownership(secrets.spans_of(secrets.found_in(lost))).collect()}
    assert held == {hashlib.sha256(v.encode()).hexdigest(): n for v, n in ((live, (3, 2)), (example, (1, 0)))}  # rows without an id are one repository of their source


def test_repeats(docs, rows, spark):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[i : i + 200] for b in raw for i in range(len(b) - 199))
    want = []
    for (d, _), b in zip(rows, raw, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    same([tuple(r) for r in substrings.digests(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()], want)
    assert substrings.digests(empty(spark)).count() == 0


@settings(deadline=None, max_examples=60)
@given(st.text("ab", min_size=2, max_size=120))
def test_suffix_array_and_repeats(text):
    raw = text.encode()
    order, lcp = substrings.suffix_array(np.frombuffer(raw, np.uint8), 400)
    assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
    before = np.array([-1, *raw[:-1]], np.int64)
    got = {(n, frozenset(order[i:j].tolist())) for n, i, j in substrings.maximal_repeats(order, lcp, before, 2)}
    want = set()
    for n in range(2, len(raw)):
        places = collections.defaultdict(set)
        for i in range(len(raw) - n + 1):
            places[raw[i : i + n]].add(i)
        for at in places.values():
            right = {raw[i + n] if i + n < len(raw) else -i for i in at}
            left = {raw[i - 1] if i else -1 for i in at}
            if len(at) > 1 and len(right) > 1 and len(left) > 1:
                want.add((n, frozenset(at)))
    assert got == want


def test_shards(spark, docs, rows):
    out = sharding.digests(docs).collect()
    same([(r.doc_id, r.size, r.text_crc32) for r in out], [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows])
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    counts = [len(by.get(k, ())) for k in range(16)]
    assert max(counts) - min(counts) <= 1 and {r.law for r in out} == {"rows"}
    assert sharding.digests(empty(spark)).count() == 0
    assert sorted(sharding.fisher_yates(50, np.random.default_rng(1)).tolist()) == list(range(50))


def test_shards_of_one_seed(spark, docs, tmp_path):
    same_rows = spark.createDataFrame([(None, None)] * 300 + [(5, "again")] * 200, "doc_id long, text string")
    some = docs.select("doc_id", "text").unionByName(same_rows)
    place = lambda df, **o: sorted(((r.shard, r.slot, r.doc_id, r.text) for r in sharding.shuffle(df, bucket_bytes=200, **o).collect()), key=repr)
    once = place(some)
    assert once == place(some.repartition(7)) == place(some.orderBy("text")) != place(some, seed=5)  # however the input is cut
    per_bucket = collections.Counter(s for s, _, d, t in once if (d, t) == (None, None))
    assert len(per_bucket) == 16 and max(per_bucket.values()) < 60  # equal rows spread
    few = sorted((r.shard, r.slot) for r in sharding.shuffle(some.where("doc_id in (1, 2, 3)").limit(3)).collect())
    assert few == [(0, 0), (1, 0), (2, 0)]
    path = sharding.write_shards(some, f"{tmp_path}/shards")
    back = spark.read.parquet(path)
    assert back.count() == some.count() and {r.shard for r in back.select("shard").distinct().collect()} == set(range(16))


def test_bpe(spark, docs, rows):
    t = Tokenizer.from_file(BYTE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    same([tuple(r) for r in bpe.digests(docs, BYTE).collect()], want)
    assert bpe.digests(empty(spark), BYTE).count() == 0


CODER, LIBRARY = bpe.PairIndexBPE(BYTE), Tokenizer.from_file(BYTE)


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=60))
def test_bpe_equals_the_library(text):
    (ids,) = CODER.encode_texts([text])
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODER.decode(ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)
