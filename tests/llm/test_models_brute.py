"""Trees against an exhaustive search, and the pattern graph against plain dictionaries."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from tessera.llm import pii
from tessera.llm.boosting import fit_trees


def plain_boosting(x, y, rounds, depth, rate, ridge, bins, least):
    """Newton boosting with every cut of every feature tried row by row."""
    n, width = len(x), len(x[0])
    base = math.log(sum(y) / n / (1 - sum(y) / n))
    edges = []
    for j in range(width):
        column = sorted(r[j] for r in x)
        edges.append(sorted({column[math.floor((n - 1) * k / bins)] for k in range(1, bins)}))
    score = [base] * n
    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad, curve = [a - b for a, b in zip(y, p, strict=True)], [max(a * (1 - a), 1e-6) for a in p]

        def value(rows, grad=grad, curve=curve):
            return rate * sum(grad[i] for i in rows) / (sum(curve[i] for i in rows) + ridge)

        def gain(rows, grad=grad, curve=curve):
            return sum(grad[i] for i in rows) ** 2 / (sum(curve[i] for i in rows) + ridge)

        def grow(rows, left):
            if not left:
                return [(rows, value(rows) if rows else 0.0)]
            best = (1e-9, None)
            for j in range(width):
                top = (0.0, None)
                for c in edges[j]:
                    low, high = [i for i in rows if x[i][j] <= c], [i for i in rows if x[i][j] > c]
                    if len(low) >= least and len(high) >= least and (g := gain(low) + gain(high) - gain(rows)) > top[0] + 1e-12:
                        top = (g, (low, high))
                if top[0] > best[0] + 1e-9:
                    best = top
            low, high = best[1] or (rows, [])
            return grow(low, left - 1) + grow(high, left - 1)

        for rows, v in grow(list(range(n)), depth):
            for i in rows:
                score[i] += v
    return score


@pytest.mark.parametrize("seed", range(3))
def test_trees_are_those_of_an_exhaustive_search(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(120, 4)), 1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=120) * 0.5 > 0).astype(float)
    options = {"rounds": 4, "depth": 2, "rate": 0.3, "ridge": 2.0, "bins": 8, "least": 5}
    got = fit_trees(x, y, **options).raw(x)
    assert got == pytest.approx(plain_boosting(x.tolist(), y.tolist(), **options), abs=1e-9)


TOKEN = re.compile(rf"(?<![0-9@{pii.SIGN}])(?=[{pii.SIGN}]*+[0-9@])[0-9@{pii.SIGN}]{{6,}}+")


def plain_graph(texts, base):
    """Context spans of each text: rounds over dictionaries."""
    seen = []
    for k, text in enumerate(texts):
        kinds = [(int(a), int(b), True) for _, a, b in (s.split(":") for s in base[k].split(",") if s)]
        free = [(m.start(), m.end(), False) for m in TOKEN.finditer(text or "") if not any(a < m.end() and m.start() < b for a, b, _ in kinds)]
        for a, b, known in kinds + free:
            before = re.search(r"(?<!\S)(\S+\s+\S+?)[\s\"(\[<']*$", (text[:a]).lower(), re.ASCII)
            if before:
                value = text[a:b]
                seen.append((re.sub("[0-9]", "0", before[1]), value, known or bool(re.match("^[0-9a-f]{32,}$", value)), k, a, b, not known))
    edges = {}
    for p, v, trusted, *_ in seen:
        edges[p, v] = max(edges.get((p, v), 0.0), float(trusted))
    instances = {}
    for p, v in edges:
        instances.setdefault(p, set()).add(v)
    instances = {p: vs for p, vs in instances.items() if len(vs) >= pii.SUPPORT}
    edges = {(p, v): s for (p, v), s in edges.items() if p in instances}
    trust = {v: max(s for (_, w), s in edges.items() if w == v) for _, v in edges}
    sure = {}
    for k in range(pii.ROUNDS):
        for p, vs in instances.items():
            good = sum(trust[v] >= 0.5 for v in vs)
            sure[p] = sum(trust[v] for v in vs) / (len(vs) + 1) if good >= pii.SUPPORT else 0.0
        if k < pii.ROUNDS - 1:
            trust = {v: max(max(s for (_, w), s in edges.items() if w == v), 1 - math.prod(1 - min(sure[p], 0.999) for p, w in edges if w == v)) for v in trust}
    spans = {}
    for p, _, _, k, a, b, free in seen:
        if free and sure.get(p, 0) >= pii.SURE:
            spans.setdefault(k, set()).add((a, b))
    return spans


def test_pattern_graph_is_that_of_plain_rounds(spark):
    from test_llm_operators import base_spans

    rng = random.Random(3)
    key = lambda: hashlib.sha1(str(rng.random()).encode()).hexdigest()
    odd = lambda: "".join(rng.choices("ABCxyz0123456789-", k=rng.randint(6, 14)))
    texts = []
    for _ in range(160):
        parts = []
        for _ in range(rng.randint(1, 5)):
            lead = rng.choice(["api secret:", "the token =", 'my key "', "order no", "some plain", "x" * 70 + " wide", "mail me"])
            parts.append(f"{lead} {rng.choice([key, odd, odd, lambda: 'word', lambda: f'u{rng.randint(1, 99)}@site.org'])()}")
        texts.append(rng.choice(["", "é😀 "]) + " and then ".join(parts) + " end")
    texts += [None, "", "12345678"]
    base = [base_spans(t) for t in texts]
    want = plain_graph([t or "" for t in texts], base)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {(s.start, s.end) for s in r.context} for r in pii.with_spans(docs).collect()}
    assert sum(map(len, want.values())) > 20 and {k: v for k, v in got.items() if v} == want


def test_labels_that_may_be_learned_from(spark):
    """Null labels and ids, several labels of an id, ids without a document, and held-out rows, which teach nothing."""
    import zlib

    from tessera.llm import toxicity

    docs = spark.createDataFrame([(k, f"word{k} here", "s") for k in range(40)] + [(3, "word3 here", "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(k, k % 3 == 0 and 1 or 0) for k in range(40)] + [(1, 1), (2, None), (None, 1), (500, 1)], "doc_id long, toxic int")
    out = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {r.doc_id for r in docs.where(toxicity.held_out()).collect()} == set(out)
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, y: seen.append(dict(zip(texts, y.tolist(), strict=True)))
    try:
        toxicity.train(docs, labels)
        toxicity.train(docs, labels, sample=7)
        toxicity.train(docs, labels.where("doc_id < 0"))
    finally:
        toxicity.fit = fit
    assert seen[0] == {f"word{k} here": float(k % 3 == 0 or k == 1) for k in range(40) if k not in out}
    assert len(seen[1]) == 7 and seen[2] == {}
    long = spark.createDataFrame([(1, "x" * 5000, "s"), (4, "short", "s"), (6, "brief", "s")], docs.schema)
    toxicity.fit = lambda texts, y: seen.append(texts)
    try:
        toxicity.train(long, labels, characters=60)
    finally:
        toxicity.fit = fit
    assert {"short", "brief"} <= set(seen[-1])
    model = toxicity.fit([f"text {k}" for k in range(30)], np.arange(30) % 2)
    scored = toxicity.scored(spark.createDataFrame([(1, "same"), (1, "same"), (2, None), (3, "")], "doc_id long, text string"), model).collect()
    assert scored[0].score == scored[1].score and scored[2].score == scored[3].score
