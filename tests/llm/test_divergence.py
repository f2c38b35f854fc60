"""Source divergence: SQL on the test table, brute force on clashing and empty rows, merges in several levels."""

import random
import re
from collections import Counter

import pytest

from telemetra.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, rank string, count string, p string"
WORDS = "the of and house Haus maison ÉTÉ été straße 漢字 x y z".split()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, "t", "r", "c", "p") for i, (lang, s, t) in enumerate(rows)], SCHEMA)


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, min_docs=3, top=200):
    docs, counts = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        own = counts.setdefault(lang, {}).setdefault(source, Counter())
        own.update(terms(text))
        docs.setdefault(lang, Counter()).update(set(terms(text)))
    out = set()
    for lang, by in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        n = {s: sum(c[t] for t in kept) for s, c in by.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (n[s] + len(kept)) for t in kept} for s, c in by.items()}
        q = {t: 1 + 10**9 * (sum(c[t] for c in by.values()) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        for s in by:
            pairs = [(sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in by if o != s]
            ahead = [((p[s][t] - q[t]) ** 2 // q[t], t) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", ahead, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered)}
    return out


def rows(seed, n=240):
    rnd = random.Random(seed)
    made = []
    for _ in range(n):
        lang, source = rnd.choice(["en", "en", "en", "de", None, "fr"]), rnd.choice(["hot"] * 4 + ["s1", "s2", "ü", None])
        made.append((lang, source, " ".join(rnd.choice(WORDS[: rnd.randrange(1, len(WORDS))]) + rnd.choice(["", "1", ".", "-a"]) for _ in range(rnd.randrange(30)))))
    return made + [("en", "empty", None), ("en", "blank", ""), ("xx", "a", "rare words"), ("xx", "b", "1 2 3"), ("yy", "alone", "one")] + made[:9]


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, seed):
    own = rows(seed)
    got = divergence.audit(frame(spark, own).repartition(6), top=5).collect()
    assert {tuple(r) for r in got} == brute(own, top=5) and len(got) == len(brute(own, top=5))


def test_many_runs_and_levels(spark, monkeypatch):
    own = rows(5) + [("en", "long", "word " * 3000 + "Other " * 9)]
    monkeypatch.setattr(divergence, "SLICE", 100)
    got = divergence.frequencies(frame(spark, own).repartition(7), postings=20, fan=3).collect()
    want, docs = {}, {}
    for lang, source, text in own:
        for t, c in Counter(terms(text)).items():
            want.setdefault((lang or "", t), Counter())[source or ""] += c
            docs[lang or "", t] = docs.get((lang or "", t), 0) + 1
    assert len(got) == len({(r.lang, r.term) for r in got})
    assert {(r.lang, r.term): (r.docs, dict(zip(r.sources, r.counts))) for r in got} == {k: (docs[k], dict(c)) for k, c in want.items() if docs[k] >= 3}


def test_heap_opens_chunks_late():
    rnd = random.Random(1)
    seen = Counter()
    chunks = []
    for _ in range(40):
        names = sorted({rnd.randrange(300).to_bytes(2, "big") for _ in range(20)})
        for t in names:
            seen[t] += 2
        chunks.append((names[0], names, [1] * len(names), [2] * len(names), ["a", "b"] * len(names), [1] * 2 * len(names)))
    got = list(divergence.merged(iter(sorted(chunks, key=lambda c: c[0]))))
    assert [t for t, *_ in got] == sorted(seen) and all(sum(c) == seen[t] for t, _, _, c in got)


def test_slices_end_between_terms(monkeypatch):
    text = "alpha béta 12 gamma " * 50
    for size in (7, 100, 10_000):
        monkeypatch.setattr(divergence, "SLICE", size)
        parts = list(divergence.slices(text))
        assert [t.decode() for p in parts for t in divergence.tokens(p).to_pylist()] == terms(text) and (len(parts) > 1) == (size < 2000)
    assert divergence.tokens(b"").to_pylist() == [] and divergence.tokens(b"a").to_pylist() == [b"a"]


def test_empty(spark):
    assert divergence.audit(frame(spark, [])).collect() == []
    assert divergence.audit(frame(spark, [(None, None, None)])).collect() == []
    two = divergence.audit(frame(spark, [("a", "x", None), ("a", None, "")])).collect()
    assert {tuple(r) for r in two} == {("a", "x", "pair", "", 0, 1), ("a", "", "pair", "x", 0, 1)}
