"""The audit of sources against a plain version, with every route of the ranking."""

import random
import re
from collections import Counter, defaultdict

import pytest

from quern.llm import divergence as D

FIND = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+").findall
KIND = "doc_id long, text string, lang string, source string, term string, n long, value string, p long, item string, v int"


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", FIND((text or "").encode().lower().decode())) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for _, _, w in mine for t in set(w))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = defaultdict(Counter)
        for _, s, w in mine:
            counts[s].update(t for t in w if seen[t] >= least)
        every = Counter()
        for c in counts.values():
            every.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in counts.items()}, share(every)
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(ranked, 1) if part == "pair" or k <= top]
    return sorted(out)


def corpus(seed, n=240):
    rng = random.Random(seed)
    words = [f"{c}{'x' * (k % 9)}{'abcdefghij'[k % 10]}{'é' * (k % 3)}" for c in ("Aa", "zé", "漢", "longsharedbeginning" * 20) for k in range(40)]
    out = []
    for k in range(n):
        lang, source = rng.choice(["en", "de", "en", None]), f"src{min(rng.randrange(12), 5)}"
        own = words[(hash(source) % 3) * 10 :]
        text = " ".join(rng.choice(own if rng.random() < 0.5 else words) for _ in range(rng.randrange(0, 40)))
        out.append((re.sub(" ", rng.choice([" ", "1", "\n-", "\x00"]), text), lang, source))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k % 50, *r, "t", 1, "v", 2, "i", 3) for k, r in enumerate(rows)], KIND).repartition(3)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


ODD = [(None, "en", "src0"), ("", "en", "silent"), ("12 34 -- ", "fr", "a"), ("only here", "fr", "b"), (None, None, None), ("x" * 300_000 + " word", "en", "src1"), ("Same same SAME same", "es", ""), ("same", "es", None), ("same", "es", "s")]


@pytest.mark.parametrize("few,digit,size,broadcast", [(1000, 12, 2, 100_000), (1, 12, 1, 100_000), (3, 7, 3, 0)])
def test_audit_equals_plain(spark, monkeypatch, few, digit, size, broadcast):
    for name, value in (("FEW", few), ("DIGIT", digit), ("BYTES", size), ("BROADCAST_ROWS", broadcast), ("MEMO", 50), ("PIECE", 100)):
        monkeypatch.setattr(D, name, value)
    rows = corpus(few) + ODD
    assert got(D.audit(frame(spark, rows), top=7)) == plain(rows, top=7)


def test_defaults_and_no_kept_terms(spark):
    rows = corpus(1, 60) + ODD
    assert got(D.audit(frame(spark, rows))) == plain(rows)
    rows = [("a b", "en", "x"), ("c d", "en", "y"), (None, "en", "z"), ("a", "de", "x")]
    want = [("en", s, "pair", o, 0, k) for s in "xyz" for k, o in enumerate([o for o in "xyz" if o != s], 1)]
    assert got(D.audit(frame(spark, rows))) == sorted(want) == plain(rows)
    assert D.audit(frame(spark, rows).limit(0)).count() == 0


def test_many_ties_are_cut_by_bytes(spark, monkeypatch):
    """Every term of a source has one value: the cut lies among ties that share long beginnings."""
    monkeypatch.setattr(D, "FEW", 2)
    rng = random.Random(3)
    terms = sorted({"".join(rng.choice("ab漢é") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"q" * 500 + c for c in "abcde"})
    rows = [(" ".join(terms), "en", "all")] * 3 + [("other words here", "en", "rest")] * 3
    for top in (1, 50, len(terms) - 3, len(terms) + 5):
        assert got(D.audit(frame(spark, rows), top=top)) == plain(rows, top=top)
