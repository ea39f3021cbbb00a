"""Kneser-Ney models, language profiles, VARIANT columns and the address index."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import variants
from tessera.operators import language_models as M
from tessera.sources import address_index as A


def plain_probability(texts, order, discount):
    """p(word | words before it) by definition, with dictionaries."""
    tables = [Counter()]
    for text in texts:
        w = [""] * (order - 1) + (text or "").lower().split()
        tables[0].update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    for _ in range(order - 1):
        tables.append(Counter(g[1:] for g in tables[-1]))
    tables.reverse()

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / (len(tables[0]) + 1)
        rows = [c for g, c in tables[k - 1].items() if g[:-1] == gram[:-1]]
        if not rows:
            return p(gram[1:])
        return max(tables[k - 1][gram] - discount, 0) / sum(rows) + discount * len(rows) / sum(rows) * p(gram[1:])

    return p


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_perplexity_is_that_of_the_definition(spark, order):
    rng = random.Random(order)
    text = lambda: " ".join(rng.choice("a b c d E e".split()) for _ in range(rng.randint(0, 12)))
    train, held = [text() for _ in range(12)] + [None], [text() for _ in range(6)] + ["a zz b", "", None, "A  a\ta"]
    model = M.kneser_ney(spark.createDataFrame([(t,) for t in train], "text string"), order=order)
    found = {r.k: r for r in M.kneser_ney_perplexity(model, spark.createDataFrame(list(enumerate(held)), "k long, text string"), "k").collect()}
    p = plain_probability(train, order, 0.75)
    assert len(found) == len(held)
    for k, t in enumerate(held):
        w = [""] * (order - 1) + (t or "").lower().split()
        grams = [tuple(w[i : i + order]) for i in range(len(w) - order + 1)]
        assert found[k].n_words == len(grams)
        if grams:
            assert found[k].perplexity == pytest.approx(math.exp(-sum(map(math.log, map(p, grams))) / len(grams)), rel=1e-9)
        else:
            assert found[k].perplexity is None


def test_probabilities_of_a_context_add_up_to_one(spark):
    df = spark.createDataFrame([("a b a c a b",), ("b c a a",)], "text string")
    model = M.kneser_ney(df, order=2)
    # the words seen, and one that was not
    asked = spark.createDataFrame([(v, w) for v in ("", "a", "b", "never") for w in ("a", "b", "c", "new")], "g1 string, g2 string")
    sums = M.probabilities(model, asked, 2).groupBy("g1").agg(F.sum("p").alias("s")).collect()
    assert len(sums) == 4 and all(r.s == pytest.approx(1.0) for r in sums)


def test_models_by_fold_and_empty_models(spark):
    df = spark.createDataFrame([(0, 1, "a b a b"), (1, 2, "x y z")], "fold int, k long, text string")
    both = M.kneser_ney(df, by="fold", order=2)
    alone = M.kneser_ney(df.where("fold = 0"), order=2)
    asked = spark.createDataFrame([(0, 7, "a b x"), (5, 8, "a b")], "fold int, k long, text string")
    found = {r.k: r.perplexity for r in M.kneser_ney_perplexity(both, asked, "k").collect()}
    assert found[7] == pytest.approx({r.k: r.perplexity for r in M.kneser_ney_perplexity(alone, asked, "k").collect()}[7])
    # a fold without a model, and a model of no texts, know no word
    assert found[8] == 1.0
    none = M.kneser_ney(df.limit(0), order=3)
    assert [r.perplexity for r in M.kneser_ney_perplexity(none, asked.where("k = 8"), "k").collect()] == [1.0]


def test_languages_by_profile_script_and_neither(spark):
    rows = [("en", "the cat and the dog were there with this other thing"), ("de", "der hund und die katze waren nicht auf dem weg zu ihm"), (None, "x"), ("en", None)]
    profiles = M.language_profiles(spark.createDataFrame(rows, "lang string, text string"))
    assert profiles.languages == ["de", "en"]
    asked = ["the other dog", "die andere katze", "これは日本語のテキストです", "这是中文", "Это русский текст", "ελληνικά", "12 !?", "", None, "ⴰⵣⵓⵍ", "the dog и", "한국어"]
    found = {r.k: r.language for r in M.detected_languages(profiles, spark.createDataFrame(list(enumerate(asked)), "k long, text string"), "k").collect()}
    assert [found[k] for k in range(len(asked))] == ["en", "de", "ja", "zh", "ru", "el", "unknown", "unknown", "unknown", "unknown", "en", "ko"]
    untaught = M.language_profiles(spark.createDataFrame([], "lang string, text string"))
    assert {r.language for r in M.detected_languages(untaught, spark.createDataFrame([(1, "the dog")], "k long, text string"), "k").collect()} == {"unknown"}


def test_profile_weights_are_those_of_counted_grams(spark):
    rows = [("a", "ab ab"), ("b", "b")]
    profiles = M.language_profiles(spark.createDataFrame(rows, "lang string, text string"))
    grams = {"a": Counter(["a", "b", " a", "ab", "b ", " ab", "ab "] * 2), "b": Counter(["b", " b", "b ", " b "])}
    every = set(grams["a"]) | set(grams["b"])
    for r in profiles.weights.collect():
        every.remove(r.gram)
        for lang, w in (("a", r.w0), ("b", r.w1)):
            n, v = sum(grams[lang].values()), 9
            assert w == round(1000 * math.log((grams[lang][r.gram] + 1) / (n + v)))
    assert not every


def test_judges_answers_of_many_shapes(spark):
    rows = ['{"accuracy": {"score": 2}, "style": {"score": 3}}', '```json\n{"accuracy": "1", "style": 4}\n```', '{"accuracy": {"score": 2}}', '{"accuracy": {"score": "good"}, "style": 1}', "{", "", None, "[1]", '"x"', '{"accuracy": {"score": 2, "score": 3}, "style": 1}']
    df = spark.createDataFrame([(k, a, "own") for k, a in enumerate(rows)], "k long, answer string, schema string")
    found = sorted((r.k, r.accuracy, r.style) for r in variants.judge_scores(df).collect())
    assert found[:2] == [(0, 2, 3), (1, 1, 4)]
    assert all(r[1:] == (None, None) for r in found[2:9]) and len(found) == 10


def test_tools_of_many_shapes(spark):
    schema = {"type": "object", "properties": {"x": {"type": "integer"}, "y": {}}, "required": ["y"]}
    rows = [json.dumps([{"type": "function", "function": {"name": "f", "description": "d", "parameters": schema}}, {"name": "g", "input_schema": schema}, {"no": 1}, 5]), json.dumps({"name": "h"}), "[]", "{", None, "7", json.dumps({"name": "i", "parameters": {"properties": [1], "required": 3}})]
    df = spark.createDataFrame(list(enumerate(rows)), "pos long, tools string")
    found = sorted((r[0], r[1], r.name, r.description) for r in variants.tools(df.withColumnRenamed("pos", "row"), "row").collect())
    assert found == [(0, 0, "f", "d"), (0, 1, "g", None), (1, 0, "h", None), (6, 0, "i", None)]
    parameters = sorted((r.row, r.pos, r.name, r.parameter, r.type, r.required) for r in variants.tool_parameters(df.withColumnRenamed("pos", "row"), "row").collect())
    assert parameters == [(0, k, n, *p) for k, n in enumerate("fg") for p in (("x", "integer", False), ("y", "any", True))]


def test_merged_schemas(spark):
    df = spark.createDataFrame([("a", '{"x": 1}'), ("a", '{"x": 1.5, "y": [1]}'), ("a", "{"), ("b", None)], "g string, j string")
    found = {r.g: (r.schema, r.n, r.broken) for r in variants.merged_schema(df, "j", "g").collect()}
    assert found["a"][1:] == (2, 1) and "y: ARRAY<BIGINT>" in found["a"][0] and found["b"][1:] == (0, 0)
    typed = variants.shredded(df, "j", {"x": ("$.x", "double"), "y0": ("$.y[0]", "int")}).collect()
    assert [(r.x, r.y0) for r in typed] == [(1.0, None), (1.5, 1), (None, None), (None, None)]


ADDRESSES = {
    "http://www.Example.com:80/a?b#c": "com,example)/a?b",
    "https://user:pw@blog.example.com/": "com,example,blog)/",
    "https://example.com": "com,example)/",
    "https://example.com?q=1": "com,example)/?q=1",
    "http://example.com:8080/en/x": "com,example:8080)/en/x",
    "http://example.company/en/": "company,example)/en/",
    "http://my-example.com/en/": "com,my-example)/en/",
    "http://example-b.com/en/": "com,example-b)/en/",
    "http://a.example.com./en/y": "com,example,a)/en/y",
    "ftp://example.com/": None,
    "": None,
    None: None,
}


def test_keys_and_seeds(spark, tmp_path):
    df = spark.createDataFrame([(u,) for u in ADDRESSES] * 2, "url string")
    assert {r.url: r.key for r in df.select("url", A.address_key("url").alias("key")).collect()} == ADDRESSES
    A.write_index(df, str(tmp_path / "index"), 3)
    urls = lambda **kw: sorted(r.key for r in A.seeds(spark, str(tmp_path / "index"), "Example.com", **kw).collect())
    own = ["com,example)/", "com,example)/?q=1", "com,example)/a?b"]
    assert urls() == sorted([*own, "com,example,a)/en/y", "com,example,blog)/", "com,example:8080)/en/x"])
    assert urls(subdomains=False) == own
    assert urls(path="/en/") == ["com,example,a)/en/y", "com,example:8080)/en/x"]
    assert urls(pattern="*blog*") == ["com,example,blog)/"]
    index = spark.read.parquet(str(tmp_path / "index"))
    of = A.seeds_of(index, spark.createDataFrame([("example.com",), ("com",), ("a.example.com",), ("none.org",), (None,)], "domain string"))
    assert {r.domain: r["count"] for r in of.groupBy("domain").count().collect()} == {"example.com": 6, "com": 8, "a.example.com": 1}


def test_seeds_are_ranges_that_the_scan_gets(spark, tmp_path):
    df = spark.range(20000).select(F.concat(F.lit("http://h"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".org/x")).alias("url"))
    A.write_index(df, str(tmp_path / "index"), 8)
    found = A.seeds(spark, str(tmp_path / "index"), "h000123.org", subdomains=False)
    assert [r.url for r in found.collect()] == ["http://h000123.org/x"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,org,h000123))" in plan and "LessThan(key,org,h000123*)" in plan
    # every file is a range of its own
    spans = spark.read.parquet(str(tmp_path / "index")).groupBy(F.input_file_name()).agg(F.min("key").alias("a"), F.max("key").alias("z")).orderBy("a").collect()
    assert len(spans) > 4 and all(one.z < two.a for one, two in zip(spans, spans[1:]))
