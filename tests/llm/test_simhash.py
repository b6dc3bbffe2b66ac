"""SimHash components against brute force, and the covering tables against all pairs within the radius."""

import random
from itertools import combinations

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import simhash as S

LONG = "It is a long text, é漢 whose Words go on " * 3000


def plain(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, prints):
    """The smallest id reachable, over all pairs."""
    at = list(range(len(ids)))

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    for a, b in combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            at[root(a)] = root(b)
    best = {}
    for k, i in enumerate(ids):
        if i is not None:
            best[root(k)] = min(best.get(root(k), i), i)
    return [best.get(root(k)) for k in range(len(ids))]


def texts():
    rng = random.Random(3)
    words = [f"w{k}é" if k % 5 == 0 else f"Word{k}" for k in range(200)]
    base = [rng.choice(words) for _ in range(400)]
    out = [None, "", " \t\n ", "one", "ONE", "two words", "Two\x0bWords", "three little words", LONG, LONG + "tail", "nb sp one"]
    out += [" ".join(base)] * 3
    for k in range(60):
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [" ".join(rng.choice(words[:3]) for _ in range(rng.randrange(1, 6))) for _ in range(150)]
    return out


def result(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id is None, r.component_id or 0) for r in df.collect())


def want(rows):
    prints = [plain(t) for _, t in rows]
    comps = components([i for i, _ in rows], prints)
    return sorted((i is None, i or 0, f"{p:016x}", c is None, c or 0) for (i, _), p, c in zip(rows, prints, comps, strict=True))


def test_components_equal_brute_force(spark):
    rows = list(enumerate(texts(), 5)) + [(5, "one"), (None, "one"), (None, "nothing else is like this text here"), (7, None)]
    extra = "fp long, t int, u int, key long, component_id long, fingerprint string, x long, first long, hot boolean"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "f", 6, 7, True) for r in rows], f"doc_id long, text string, {extra}").repartition(3)
    assert result(S.linked(docs.drop("first")).select("doc_id", "fingerprint", "component_id")) == want(rows)
    assert result(S.linked(docs)) == want(rows)


def test_no_rows(spark):
    assert S.linked(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(deadline=None, max_examples=300)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=2))
def test_a_table_covers_every_pair_within_the_radius(x, bits):
    y = x ^ sum(1 << b for b in bits)
    tables = [k for k, m in enumerate(S.TABLES) if x & m == y & m]
    assert tables
    for t in tables:  # and so does one within, if the table's bucket is covered again
        assert any(x & m == y & m for m in S.WITHIN[t]) and all(m & S.TABLES[t] == S.TABLES[t] and 64 - m.bit_count() <= 12 for m in S.WITHIN[t])


def test_hot_buckets_lose_no_link(spark):
    """Many fingerprints that share most bits, with every bucket size and both joins of the hot keys."""
    rng = random.Random(9)
    spread = rng.sample(range(64), 20)
    prints = {0xABCDEF0123456789 ^ sum(1 << p for p in rng.sample(spread, rng.randrange(0, 9))) for _ in range(900)} | {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    of = dict(zip(prints, components(prints, prints), strict=True))
    nodes = spark.createDataFrame([(S.signed(p),) for p in prints], "fp long")
    for bucket, most in ((4, 10), (4, 100_000), (50, 100_000), (100_000, 0)):
        edges = [(r.x % 2**64, r.y % 2**64) for r in S.stars(S.covered(nodes, bucket, most)).collect()]
        assert all((of[x] == of[y]) for x, y in edges)
        label = {p: p for p in prints}
        for _ in range(40):
            for x, y in edges:
                label[x] = label[y] = min(label[x], label[y])
        assert label == of
    assert len(set(of.values())) > 50


def test_large_buckets_look_neighbours_up():
    rng = np.random.default_rng(2)
    mask = S.WITHIN[2][3]
    open_bits = [p for p in range(64) if not mask >> p & 1]
    values = np.unique(np.array([sum(1 << p for p in open_bits if rng.random() < 0.4) for _ in range(2500)], np.uint64))
    some = values[:: 2]
    assert len(values) > 700
    for v in (values, some, values[rng.random(len(values)) < 0.85]):
        ints = [int(x) for x in v]
        assert [int(v[k]) for k in S.least_reached(v, mask)] == components(ints, ints)
