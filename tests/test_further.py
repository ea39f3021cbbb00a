"""Losses, selectors, crawls, look-ups and retries against plain Python."""

import heapq
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import cleaning, retrieval, rewards, sampling, selectors, web
from tessera.plans import stages


def test_losses(spark):
    rng = random.Random(1)
    rows = [(k, rng.gauss(0, 5), rng.gauss(0, 5)) for k in range(40)] + [(98, 5000.0, -5000.0), (99, -5000.0, 5000.0)]
    df = spark.createDataFrame(rows, "id long, c double, r double")
    names = [*scores.MARGIN_LOSSES, *scores.PAIR_LOSSES]
    out = {x.id: x for x in df.select("id", *[scores.preference_loss(n, F.col("c"), F.col("r")).alias(n) for n in names]).collect()}
    sig = lambda x: 1 / (1 + math.exp(-x))
    for k, c, r in rows[:40]:
        m = 0.1 * (c - r)
        want = {
            "sigmoid": -math.log(sig(m)),
            "robust": (-0.9 * math.log(sig(m)) + 0.1 * math.log(sig(-m))) / 0.8,
            "exo_pair": sig(m) * (math.log(sig(m)) - math.log(0.999)) + sig(-m) * (math.log(sig(-m)) - math.log(0.001)),
            "hinge": max(0, 1 - m),
            "ipo": (c - r - 5) ** 2,
            "discopop": -math.log(sig(m)) * (1 - sig(m / 0.05)) + math.exp(-m) * sig(m / 0.05),
            "bco_pair": -math.log(sig(0.1 * c)) - math.log(sig(-0.1 * r)),
            "sppo_hard": (c - 5) ** 2 + (r + 5) ** 2,
            "nca_pair": -math.log(sig(0.1 * c)) - 0.5 * math.log(sig(-0.1 * c)) - 0.5 * math.log(sig(-0.1 * r)),
            "apo_zero": 1 - sig(0.1 * c) + sig(0.1 * r),
            "apo_down": sig(0.1 * c) + 1 - sig(m),
        }
        assert {n: out[k][n] for n in names} == pytest.approx(want)
    assert out[99].sigmoid == pytest.approx(1000) and out[98].sigmoid == pytest.approx(0)
    paired = sorted(x.loss for x in rewards.sorted_loss(df.where("id < 40").withColumn("g", F.lit(1)), "g", "id", "c", "r").collect())
    ranks = zip(sorted(c for _, c, _ in rows[:40]), sorted(r for *_, r in rows[:40]), strict=True)
    assert paired == pytest.approx(sorted(-math.log(sig(0.1 * (a - b))) for a, b in ranks))


HTML = """<body><section class="a main"><div id=x><h3 class="t big">One <b>two</b></h3><p>first<p>second <img src="i.png" class=icon></div>
<div><h3 class=t>Three</h3><ul><li>a<li class=last>b</ul></div></section><div class=a><h3 class=t>outside</h3></div></body>"""


def test_selectors(spark):
    find = lambda s: [n.text() for n in selectors.Selector(s).find(selectors.tree(HTML))]
    assert find("section.a.main > div h3.t") == ["One two", "Three"] and find("h3.big, li.last") == ["One two", "b"]
    assert find("div[id=x] p") == ["first", "second"] and find("li:first-child") == ["a"] and find("[src$=png]") == [""]
    assert find("body > h3") == [] and find("*[class~=main] li") == ["a", "b"] and len(find("section *")) == 11
    with pytest.raises(ValueError):
        selectors.Selector("div ~ p!")
    schema = {"baseSelector": "section.main > div", "fields": [{"name": "title", "selector": "h3", "type": "text"}, {"name": "icon", "selector": "img.icon", "type": "attribute", "attribute": "src"}, {"name": "me", "type": "attribute", "attribute": "id"}]}
    pages = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "id int, html string")
    assert [tuple(r) for r in selectors.by_schema(pages, "id", schema).orderBy("pos").collect()] == [(1, 0, "One two", "i.png", "x"), (1, 1, "Three", None, None)]
    chain = {r.id: (r.method, r.content) for r in selectors.with_fallbacks(pages, "id", "h1", ["p", "section.main", "li"], ["THREE", "b"]).collect()}
    assert chain == {1: ("fallback_2", chain[1][1]), 2: (None, None), 3: (None, None)} and "Three" in chain[1][1]
    x = spark.createDataFrame([("<a><b k='v'>t</b></a>",), (None,)], "x string")
    assert [tuple(r)[1:] for r in selectors.by_xpath(x, "x", t="/a/b", k="/a/b/@k", n="/a/c").collect()] == [("t", "v", None), (None, None, None)]


def best_first(edges, start, max_depth, max_pages, at_once):
    heap, seen, out = [(0.0, u, 0) for u in start], set(start), []
    while heap and len(out) < max_pages:
        batch = [heapq.heappop(heap) for _ in range(min(at_once, len(heap), max_pages - len(out)))]
        out += [(u, d, -s) for s, u, d in batch]
        found = {}
        for _, u, d in batch:
            for a, b, s in edges:
                if a == u and d < max_depth and b not in seen:
                    deep, score = found.get(b, (99, -1.0))
                    found[b] = min(deep, d + 1), max(score, s)
        for b, (d, s) in found.items():
            seen.add(b)
            heapq.heappush(heap, (-s, b, d))
        heapq.heapify(heap)
    return out


def test_best_first_crawl(spark):
    rng = random.Random(4)
    score = {v: rng.randrange(20) / 10 for v in range(40)}
    edges = sorted({(rng.randrange(40), rng.randrange(40)) for _ in range(120)})
    edges = [(a, b, score[b]) for a, b in edges]
    df = spark.createDataFrame(edges, "source long, target long, score double")
    start = spark.createDataFrame([(0,)], "url long")
    for at_once, most in ((1, 6), (4, 15)):
        got = web.best_first_crawl(df, start, max_depth=3, max_pages=most, at_once=at_once).orderBy("visit").collect()
        assert [(r.url, r.depth, r.score) for r in got] == best_first(edges, [0], 3, most, at_once)


def test_look_ups(spark):
    df = spark.range(30).withColumnRenamed("id", "k").withColumn("t", F.lit("abcdef"))
    assert sampling.row_at(df, "k", 3).first().k == 3 and [r.t for r in sampling.preview_rows(df, "k", 2, 3).collect()] == ["abc..."] * 2
    with pytest.raises(IndexError):
        sampling.row_at(df, "k", 30)
    with pytest.raises(KeyError):
        sampling.rows_of(df, "k", 1, 99)
    assert [r.k for r in sampling.slice_rows(df, "k", 20, 23, few=5).orderBy("k").collect()] == [20, 21, 22]


def test_values(spark):
    rows = spark.createDataFrame([("[1, 2]",), (None,), ("[1",), ("x",)], "c string").select(text.list_or_text("c").alias("v")).collect()
    assert [(r.v["values"], r.v["text"]) for r in rows] == [([1, 2], None), ([], None), (None, "[1"), (None, "x")]
    one = spark.range(1)
    assert one.select(text.paper_rewrites(F.lit("2 × a - 3 2 5 = 47 5; tỉ số là 4  5.")).alias("x")).first().x == "2 \\times a - 3\\frac{2}{5} = \\frac{47}{5}; tỉ số là $\\frac{4}{5}$."
    assert one.select(text.tool_names(F.lit("no json")).alias("x")).first().x == []


def test_retries(spark):
    calls = []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("no")
        return x

    assert stages.Retry(attempts=3).call(flaky, 7) == 7 and calls == [7, 7, 7]
    assert stages.Retry(attempts=1, seconds=0.05, fallback=lambda x: "late").call(lambda x: time.sleep(0.3), 1) == "late"

    def half(x):
        if x == "b":
            raise ValueError(x)
        return x.upper()

    out = stages.Retry(attempts=2).over(spark.createDataFrame([("a",), ("b",)], "x string"), "x", half).orderBy("x").collect()
    assert [(r.result, r.error) for r in out] == [("A", None), (None, "ValueError: b")]


def test_near_dedup_drops_by_earliest_neighbour(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rows = [(1, " ".join(base)), (2, " ".join(reversed(base))), (3, " ".join([*base, "alpha"])), (4, "other words here"), (5, None), (6, ""), (7, "other words here"), (0, " ".join([*base[1:], "mu", "nu", "xi"]))]
    df = spark.createDataFrame(rows, "id int, text string")
    kept = {r.id for r in cleaning.near_dedup(df, "id").collect()}
    assert kept == {0, 1, 4, 5, 6}


def test_top_by_jaccard(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choices("a b c d e f g h".split(), k=rng.randint(0, 9))) for _ in range(60)]
    corpus = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(90, None)], "id int, text string").repartition(3)
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:9])] + [(50, None), (51, "zz")], "q int, text string")
    want = []
    sets = {k: set(t.split()) for k, t in enumerate(texts)} | {90: set()}
    for q, t in [*enumerate(texts[:9]), (50, ""), (51, "zz")]:
        own = set((t or "").split())
        ranked = sorted((-(len(own & s) / max(1, len(own | s))), k) for k, s in sets.items())[:3]
        want += [(q, k, r) for r, (_, k) in enumerate(ranked, 1)]
    for block in (2048, 4):
        got = retrieval.jaccard_top(queries, corpus, "q", "id", 3, block=block).collect()
        assert sorted((r.query, r.key, r.rank) for r in got) == sorted(want)
