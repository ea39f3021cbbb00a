"""Near copies by blocks of texts: the same pairs as by definition, and nothing written that grows with pairs."""

import math
import os
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import cleaning, near_vectors
from tessera.plans import queries


def by_definition(texts, threshold):
    """Keys that stay, with dictionaries; texts: key -> text or None. A pair within rounding of the threshold is none of these tables'."""
    terms = {k: Counter(t for t in (x or "").lower().split() if len(t) > 1) for k, x in texts.items()}
    df = Counter(t for c in terms.values() for t in c)
    w = {k: {t: n * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()} for k, c in terms.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in w.items()}
    near = lambda a, b: norm[a] and norm[b] and sum(x * w[b].get(t, 0) for t, x in w[a].items()) / norm[a] / norm[b] > threshold
    return {k for k in texts if not any(j < k and near(j, k) for j in texts)}


def edited(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(3000)]
    texts = {}
    for k in range(n):
        own = rng.choice(list(texts.values())).split() if k > 5 and rng.random() < 0.5 else rng.sample(words, rng.randint(1, 40))
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts[k] = " ".join(own)
    return texts


def test_blocks_find_what_the_definition_finds(spark, monkeypatch):
    # one text in three or four is a block of its own
    monkeypatch.setattr(near_vectors, "BLOCK", (1, 60))
    texts = edited(1, 150) | {200: "", 201: None, 202: "w1 w2", 203: "w2 w1"}
    rows = list(texts.items())
    random.Random(2).shuffle(rows)
    for threshold in (0.9, 0.6):
        got = {r.id for r in cleaning.near_dedup(spark.createDataFrame(rows, "id long, text string").repartition(3), "id", threshold=threshold).collect()}
        assert got == by_definition(texts, threshold) and len(got) < 140


def test_texts_without_terms_count_as_texts(spark):
    """idf follows the number of all texts, those without terms too, as in the SQL."""
    texts = {1: "aa bb cc dd ee", 2: "aa bb cc dd ff", 3: "aa bb cc dd", 4: "aa bb cc dd gg gg"} | dict.fromkeys(range(10, 400), "")
    for threshold in (0.3, 0.5, 0.7):
        got = {r.id for r in cleaning.near_dedup(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", threshold=threshold).collect()}
        assert got == by_definition(texts, threshold)


def test_products_in_small_parts_are_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    lengths = rng.integers(0, 9, 40)
    terms = np.concatenate([np.sort(rng.choice(30, n, replace=False)) for n in lengths]).astype("<u8")
    df = (terms.astype("<i8") // 3 + 2) * 3
    times = rng.integers(1, 4, len(terms)).astype("<i4")
    w = times * (np.log(101 / (1 + df)) + 1)
    norms = np.sqrt(np.bincount(np.repeat(np.arange(40), lengths), w * w, 40))
    row = {f"{c}_a": near_vectors._press(x) for c, x in {"ids": np.arange(40), "lengths": lengths.astype("<i8"), "terms": terms, "times": times, "df": df, "norms": norms}.items()}
    block = near_vectors._Block(row, "_a", 100, 0.6)
    dense = np.zeros((40, 30))
    dense[np.repeat(np.arange(40), lengths), terms.astype(int)] = block.weights
    want = {(i, j) for i, j in zip(*np.nonzero(dense @ dense.T > 0.6), strict=True) if i < j}
    for products, cells in ((1 << 20, 1 << 20), (5, 90)):
        monkeypatch.setattr(near_vectors, "PRODUCTS", products)
        monkeypatch.setattr(near_vectors, "CELLS", cells)
        found = [(i, j) for x, y in near_vectors._near(block, block, 0.6, True) for i, j in zip(x, y, strict=True)]
        assert set(found) == want and len(found) == len(want) > 5


def test_nothing_written_grows_with_pairs(spark):
    """Some 200,000 pairs of 800 texts share a term of their prefixes: what is written stays within some times the texts."""
    rng = random.Random(4)
    rows = [(k, " ".join(f"term{x}" for x in rng.sample(range(60), 6))) for k in range(800)]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.lstat(os.path.join(d, f)).st_size for d, _, names in os.walk(folder) for f in names)
    before = size()
    cleaning.near_dedup(spark.createDataFrame(rows, "id long, text string"), "id")
    assert size() - before < 30 * sum(len(x) for _, x in rows)


def test_cleaning_writes_nothing_that_grows_with_pairs(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(f"term{x}" for x in rng.sample(range(60), 6))) for k in range(800)]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.lstat(os.path.join(d, f)).st_size for d, _, names in os.walk(folder) for f in names)
    before = size()
    cleaning.clean(spark.createDataFrame(rows, "id long, text string"), "id")
    assert size() - before < 30 * sum(len(x) for _, x in rows)


def test_cleaning_keeps_no_table_of_terms_of_blocks(spark):
    """Texts of rare words: frequencies by block, a row for each block, are not kept beside the vectors."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"t{rng.randrange(40000):05d}" for _ in range(100))) for k in range(3000)]
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.lstat(os.path.join(d, f)).st_size for d, _, names in os.walk(folder) for f in names)
    before = size()
    cleaning.clean(spark.createDataFrame(rows, "id long, text string"), "id")
    kept = size() - before
    assert kept < 7_500_000


def _block(rng, texts, words, per, threshold):
    """A block of texts of `per` terms each, as _Block reads it."""
    terms = np.concatenate([np.sort(rng.choice(words, per, replace=False)) for _ in range(texts)]).astype("<u8")
    df = np.bincount(terms.astype("<i8"), minlength=words)[terms.astype("<i8")].astype("<i8") + 1
    w = np.log((1 + 2 * texts) / (1 + df)) + 1
    norms = np.sqrt(np.bincount(np.repeat(np.arange(texts), per), w * w, texts))
    columns = {"ids": np.arange(texts), "lengths": np.full(texts, per, "<i8"), "terms": terms, "times": np.ones(len(terms), "<i4"), "df": df, "norms": norms}
    return near_vectors._Block({f"{c}_a": near_vectors._press(x) for c, x in columns.items()}, "_a", 2 * texts, threshold)


def test_sorted_products_are_those_of_the_table(monkeypatch):
    block = _block(np.random.default_rng(9), 300, 40, 6, 0.6)
    found = []
    for sparse in (10**9, 1e-9):
        monkeypatch.setattr(near_vectors, "SPARSE", sparse)
        found.append({(i, j) for x, y in near_vectors._near(block, block, 0.6, True) for i, j in zip(x, y, strict=True)})
    dense = np.zeros((300, 40))
    dense[block.of, block.terms.astype(int)] = block.weights
    assert found[0] == found[1] == {(i, j) for i, j in zip(*np.nonzero(dense @ dense.T > 0.6), strict=True) if i < j} != set()


def test_time_follows_the_shared_terms_not_the_pairs():
    """30,000 texts meet themselves, 900 million pairs, of which few share a term of their prefixes."""
    block = _block(np.random.default_rng(10), 30000, 10**6, 8, 0.9)
    begun = time.process_time()
    pairs = sum(len(i) for i, _ in near_vectors._near(block, block, 0.9, True))
    assert time.process_time() - begun < 1 and pairs < 100


def test_the_query_cleans_each_text_once(spark, monkeypatch):
    asked = spark.sparkContext.accumulator(0)

    def seen(x):
        asked.add(1)
        return x

    docs = spark.createDataFrame([(k, f"some words of text {k % 40 + 10} and others") for k in range(50)], "doc_id long, text string")
    counted = docs.withColumn("text", F.udf(seen, "string")("text"))
    monkeypatch.setattr(queries, "t", lambda *_: counted)
    assert queries.cleaned_corpus(spark, "").count() == 40
    assert asked.value == 50


def test_tasks_of_the_product_follow_the_blocks_not_the_shuffle(spark):
    texts = edited(11, 60)
    context = spark.sparkContext
    context.setJobGroup("product", "blocks meet")
    try:
        with near_vectors.settings(spark, spark__sql__shuffle__partitions="40", spark__sql__adaptive__coalescePartitions__enabled="false"):
            got = {r.id for r in cleaning.near_dedup(spark.createDataFrame(list(texts.items()), "id long, text string"), "id").collect()}
        status = context.statusTracker()
        stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("product") for s in status.getJobInfo(j).stageIds]
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == by_definition(texts, 0.9)
    assert max(s.numTasks for s in stages if s) <= 40
