"""Substring removal, hard negatives and the divergence audit against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import divergence, negatives, substrings


@pytest.mark.parametrize("period", sorted(substrings.COVERS))
def test_covers_align_any_two_places(period):
    cover = set(substrings.COVERS[period])
    for shift in range(period):
        assert any((d + shift) % period in cover for d in cover)


@pytest.mark.parametrize("window", [1, 2, 5, 20, 50])
def test_any_two_places_of_a_shared_window_have_an_anchor_in_common(window):
    period, _ = substrings.cover(window)
    size, n = window - period + 1, 4 * window + 2 * period
    at = set(substrings.anchor_places(n, window).tolist())
    for a in range(n - window + 1):
        for b in range(n - window + 1):
            assert any(a + s in at and b + s in at for s in range(window - size + 1))


def kept_by_brute_force(rows, window):
    words = [(i, [w for w in (t or "").encode().split()]) for i, t in rows]
    first = {}
    for i, w in words:
        for p in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[p : p + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[p : p + window])] < i:
                gone |= set(range(p, p + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


def passages(seed, window):
    rng = random.Random(seed)
    shared = [[rng.choice("abcdefgh") + str(rng.randint(0, 30)) for _ in range(rng.randint(window - 2, 4 * window))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            words += [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, window))]
            if rng.random() < 0.7:
                piece = rng.choice(shared)
                words += piece[rng.randint(0, 3) : len(piece) - rng.randint(0, 3)]
        rows.append((i * 7 % 61 - 5, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [rows[3], rows[4], (rows[5][0], rows[6][1]), (None, rows[7][1]), (900, None), (901, ""), (902, " ".join(["same"] * 300)), (903, " ".join(["same"] * 40)), (904, rows[8][1]), (-99, rows[9][1])]
    return rows


@pytest.mark.parametrize(("window", "seed"), [(50, 1), (12, 2), (5, 3), (1, 4)])
def test_repeated_passages_go_as_by_brute_force(spark, window, seed):
    rows = passages(seed, window)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, k string, doc int, digest int").repartition(5)
    found = [tuple(r) for r in substrings.without_repeats(docs, window).collect()]
    assert sorted(found, key=str) == kept_by_brute_force(rows, window)


def test_no_documents_no_rows(spark):
    assert substrings.without_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert negatives.hard_negatives(*[negatives.usable(spark.createDataFrame([], "vec_id long, label int, embedding array<float>"))] * 2).collect() == []
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []


def test_kept_words_come_along(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    docs = spark.createDataFrame([(1, "first " + passage), (2, "before " + passage + " after"), (3, passage)], "doc_id long, text string")
    kept = {r.doc_id: r.kept for r in substrings.without_repeats(docs, texts=True).collect()}
    assert kept[2] == "before after" and kept[3] == "" and kept[1] is None


def negatives_by_brute_force(rows):
    good = {(i, y, tuple(int(np.floor(256 * float(c))) for c in x)) for i, y, x in rows if i is not None and y is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    out = []
    for i, y, x in good:
        if i % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(x, z, strict=True)), j, t) for j, t, z in good if len(z) == len(x)]
        for p, j, _ in sorted(s for s in scored if s[2] == y and s[1] != i)[:5]:
            near = [(s, k) for s, k, t in sorted(scored) if t != y and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(near[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [(1 << 22, 1 << 14), (64, 8)])
def test_negatives_are_those_of_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(k, int(rng.integers(0, 4)), (centres[k % 6] + rng.normal(size=8) * rng.choice([0.05, 0.5])).astype(np.float32).tolist()) for k in range(260)]
    rows += [(1000 + k, 1, rows[50][2]) for k in range(12)] + [(2000 + k, 2, rows[50][2]) for k in range(5)]  # copies
    rows += [rows[7], (3000, None, rows[8][2]), (3050, 1, None), (None, 1, rows[9][2]), (3100, 1, [float("nan")] * 8), (3150, 1, [None] * 8), (3200, 1, [float("inf")] * 8)]
    rows += [(3250, 1, [1.0, 2.0]), (3251, 1, [1.5, 2.0]), (3252, 0, [1.0, 1.0]), (3300, 2, [0.0] * 8), (3350, 3, [-300.0] * 8), (3400, 3, [])]
    monkeypatch.setattr(negatives, "BLOCK", block)
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, label int, embedding array<float>, key int, block string")
    good = negatives.usable(table)
    found = [tuple(r) for r in negatives.hard_negatives(good, good.where("id % 50 = 0")).collect()]
    assert sorted(found) == negatives_by_brute_force(rows)


def test_planes_drop_only_what_cannot_qualify():
    rng = np.random.default_rng(2)
    q, x = rng.integers(-130, 130, (9, 16)), rng.integers(-130, 130, (300, 16)).astype(np.int32)
    exact = q @ x.T.astype(np.int64)
    planes = negatives.Planes(q, x)
    alive = negatives.nearest(planes, 4)
    for i in range(9):
        assert set(np.argsort(-exact[i])[:4]) <= set(np.flatnonzero(alive[i]))
        assert alive[i].sum() < 10
    assert (planes.known[alive] == exact[alive]).all()


def audit_by_brute_force(rows, least, terms):
    seen, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found, word = [], ""
        for c in (text or "") + " ":
            if c.isascii() and not c.isalpha():
                found, word = found + [word] * bool(word), ""
            else:
                word += c.lower() if c.isascii() else c
        n[lang or "", source or ""].update(found)
        seen[lang or ""].update(set(found))
    out = []
    for lang in seen:
        kept = [t for t, k in seen[lang].items() if k >= least]
        groups = {s: c for (x, s), c in n.items() if x == lang}
        total = Counter()
        for c in groups.values():
            total.update(c)
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[u] for u in kept) + 2 * len(kept)) for t in kept} for s, c in [*groups.items(), (None, total)]}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            near = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s)
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(near, 1)]
            top = sorted((-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if groups[s][t] and p[s][t] > p[None][t])
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(top[:terms], 1)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "groups"), [(2048, 32), (3, 2)])
def test_divergence_is_that_of_brute_force(spark, chunk, groups):
    rng = random.Random(3)
    words = ["Alpha", "beta", "é", "Éa", "don't", "x9y", "zeta", "日本", "low_er", "q", "eta", "theta"]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 20))), rng.choice(["en", "fr"]), f"s{int(rng.expovariate(0.4))}") for _ in range(150)]
    rows += [(None, "en", "s0"), ("alpha beta", None, None), ("", "en", "none"), ("lonely words", "xx", "a"), ("other words", "xx", "b"), ("", "yy", "only"), rows[0]]
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], "text string, lang string, source string, term int, k_lang string").repartition(4)
    found = [tuple(r) for r in divergence.audit(docs, 4, 5, chunk, groups).collect()]
    assert sorted(found) == audit_by_brute_force(rows, 4, 5)


def test_shares_are_exact_for_large_counts(spark):
    pairs = [(1, 3), (7, 7), (2, 9 * 10**15), (8_999_999_999_999_999, 9 * 10**15), (123_456_789_012_345, 987_654_321_098_765)]
    n, m = np.array(pairs, np.int64).T
    wanted = [1 + 10**9 * a // b for a, b in pairs]
    assert divergence.shares(n, m).tolist() == wanted
    df = spark.createDataFrame(pairs, "n long, m long")
    assert [r.p for r in df.select(divergence.share(df.n, df.m).alias("p")).collect()] == wanted
