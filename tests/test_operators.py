"""Operators on small tables: worked examples, edge rows and properties."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import chat, cleaning, evaluation, exams, formats, reports, retrieval, rewards, sampling, token_arrays, web

SENTENCES = [(0, "The cat sat on the mat."), (1, "Dogs run fast in the park."), (2, "The cat sat on the mat."), (3, "A bird flew away today.")]


def test_cleaning(spark):
    df = spark.createDataFrame(SENTENCES + [(4, None), (5, None), (6, " ")], "id int, text string")
    assert {r.id for r in cleaning.exact_dedup(df, "text", "id").collect()} == {0, 1, 3, 4, 6}
    docs = spark.createDataFrame(SENTENCES, "id int, text string")
    assert {r.id for r in cleaning.near_dedup(docs, "id").collect()} == {0, 1, 3}
    assert {r.id for r in cleaning.clean(docs, "id").collect()} == {0, 1, 3}
    assert [r.id for r in cleaning.non_blank(df, "text").collect()] == [0, 1, 2, 3]
    report = cleaning.validation_report(df).first()
    assert (report.n_rows, report.n_unique, report.n_short) == (7, 4, 1)


def test_near_pairs_find_what_brute_force_finds(spark):
    import random

    rng = random.Random(1)
    texts = [" ".join(rng.choices([f"word{k}" for k in range(25)], k=8)) for _ in range(60)]
    texts += [t + " extra" for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    weights = {}
    for r in cleaning.tfidf(df, "id").collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    want = {(a, b) for a in weights for b in weights if a < b and sum(w * weights[b].get(t, 0) for t, w in weights[a].items()) > 0.7}
    assert {(r.a, r.b) for r in cleaning.near_pairs(df, "id", threshold=0.7).collect()} == want and want


def test_not_transitive(spark):
    pairs = [(0, 1), (1, 2)]
    later = spark.createDataFrame(pairs, "a int, b int").select(F.col("b").alias("id")).distinct()
    df = spark.createDataFrame([(0,), (1,), (2,)], "id int")
    assert [r.id for r in df.join(later, "id", "left_anti").collect()] == [0]


def test_retrieval(spark):
    corpus = spark.createDataFrame([(0, "Sky is blue today"), (1, "grass is green"), (2, "the sky at night")], "id int, text string")
    ask = spark.createDataFrame([(0, "blue sky?"), (1, "zebra")], "q int, text string")
    top = retrieval.jaccard_top(ask, corpus, "q", "id")
    found = {(r.query, r["rank"]): r.key for r in top.collect()}
    assert found == {(0, 1): 0, (0, 2): 2, (1, 1): 0, (1, 2): 1}
    assert {r.query: r.context for r in retrieval.context(top, corpus, "id").collect()}[0] == "Sky is blue today\nthe sky at night"
    best = retrieval.normalised(retrieval.bm25(ask, corpus, "q", "id")).orderBy(F.col("relevance").desc()).first()
    assert (best.query, best.key, best.relevance) == (0, 0, 1.0)


def test_exam_parsers(spark):
    paper = "|   TT | Câu hỏi | Đáp án |\n|--|--|--|\n| 1 | 1/2 | A |\n| 2 | two | B |\n\n| 3 | three | C |\nCâu 2. x\n## Lời giải\nline one\nline two\nĐáp án: D\nCâu 2. again\nPhương pháp\nm\n"
    df = spark.createDataFrame([(1, paper), (2, None), (3, "")], "id int, content string")
    assert [r.number for r in exams.question_table(df, "id").orderBy("pos").collect()] == [1, 2]
    assert [r.number for r in exams.question_table(df, "id", continue_tables=True).orderBy("pos").collect()] == [1, 2, 3]
    got = exams.detailed_solutions(df, "id").collect()
    assert [(r.number, r.method, r.solution, r.answer) for r in got] == [(2, "m", "", "")]
    records = {r.number: r for r in exams.exam_records(df, "id", missing="-").collect()}
    assert records[1].question == "$\\frac{1}{2}$" and records[1].answer == "A" and records[2].method == "m" and records[2].answer == "B"
    lines = spark.createDataFrame([(1, "intro\nCâu 1. Q\nA. one\nB) two\ncách làm: m\nmore\nkết quả: C\nBài 2 Z")], "id int, content string")
    out = {r.ordinal: r for r in exams.line_parser(lines, "id").collect()}
    assert out[1].question == "Q\nA. one\nB. two" and out[1].method == "cách làm: m\nmore" and out[1].answer == "C" and out[2].question == "Z"


def test_dataset_types(spark):
    pref = spark.createDataFrame([("Hello ", "there", "you")], "prompt string, chosen string, rejected string")
    back = formats.implicit_to_preference(formats.preference_to_implicit(pref)).first()
    assert (back.prompt, back.chosen, back.rejected) == ("Hello ", "there", "you")
    assert formats.preference_to_unpaired(pref).count() == 2
    turn = "array<struct<role:string,content:string>>"
    lists = spark.createDataFrame([([("user", "q")], [("assistant", "a")], [("assistant", "b")])], f"prompt {turn}, chosen {turn}, rejected {turn}")
    again = formats.implicit_to_preference(formats.preference_to_implicit(lists)).first()
    assert len(again.prompt) == 1 and again.chosen[0].content == "a" and again.rejected[0].content == "b"
    steps = spark.createDataFrame([("p", ["a", "b"], [True, False]), ("q", [], [])], "prompt string, completions array<string>, labels array<boolean>")
    assert [r.text for r in formats.stepwise_to_lm(steps).collect()] == ["q"]
    assert [formats.detect_type(c) for c in (["prompt", "chosen", "rejected"], ["chosen", "rejected"], ["prompt"], ["x"])] == ["preference", "implicit_preference", "prompt_only", None]
    assert len(formats.CONVERSIONS) == 19 and set(formats.TRAINERS.values()) <= {n for n, _ in formats.TYPES}


def test_templates(spark):
    rows = spark.createDataFrame([(1, 0, "user", "What color is the sky?"), (1, 1, "assistant", "It is blue."), (1, 2, "tool", "x")], "conv_id int, turn int, role string, text string")
    c = chat.conversations(rows)
    m = F.col("messages")
    r = c.select(chat.apply_template(F.slice(m, 1, 1), "pipes", generate=True).alias("ask"), chat.apply_template(F.slice(m, 1, 1), "pipes").alias("whole"), chat.apply_template(m).alias("turns")).first()
    assert r.ask == "<|user|>\nWhat color is the sky?<|end|>\n<|assistant|>\n" and r.whole == "<|user|>\nWhat color is the sky?<|end|>\n<|endoftext|>"
    assert r.turns == "<start_of_turn>user\nWhat color is the sky?<end_of_turn>\n<start_of_turn>model\nIt is blue.<end_of_turn>"


def test_splits(spark):
    df = spark.range(103).withColumnRenamed("id", "doc_id")
    split = sampling.shuffle_split(df, "doc_id").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in split} == {"train": 93, "test": 10}
    assert sampling.shared_keys(sampling.shuffle_split(df, "doc_id"), "doc_id").count() == 0
    assert {r["count"] for r in sampling.shuffle_split(df, "doc_id", round_up=True).groupBy("split").count().collect()} == {92, 11}
    assert [r.position for r in sampling.numbered(df, "doc_id").orderBy("doc_id").collect()] == list(range(103))
    files = {r.file: r["count"] for r in sampling.roll_over(df, "doc_id", 50).groupBy("file").count().collect()}
    assert files == {"p1": 50, "p2": 50, "last": 3}
    assert sampling.draw_with_replacement(df, "doc_id", 40).count() == 40
    assert sampling.sample_n(df, "doc_id", 500).count() == 103 and sampling.shuffle_split(df.limit(3), "doc_id").where("split = 'test'").count() == 0


def test_tokens(spark):
    r = token_arrays.dpo(spark.createDataFrame([([464, 6766, 318], [4171], [4077])], "prompt array<int>, chosen array<int>, rejected array<int>"), 50256, 2, 3).first()
    assert (r.prompt_input_ids, r.chosen_input_ids) == ([6766, 318], [4171, 50256])
    s = token_arrays.stepwise(spark.createDataFrame([([1, 2], [[5], [6, 7]], [True, False])], "prompt array<int>, completions array<array<int>>, labels array<boolean>"), [0], start=9, last_only=True).first()
    assert s.input_ids == [9, 1, 2, 5, 0, 6, 7, 0] and s.labels == [-100] * 7 + [0]
    assert token_arrays.fits(spark.createDataFrame([([1], [1, 2, 3]), ([1], [2])], "a array<int>, b array<int>"), "a", "b", 2).count() == 1


def test_rewards(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, reward double")
    adv = sorted(r.advantage for r in rewards.group_advantage(df, "g").collect())
    assert adv[1] == 0 and adv[2] == pytest.approx(1 / (math.sqrt(2) + 1e-4))
    assert sorted((r.baseline is None, r.baseline or 0) for r in rewards.leave_one_out(df, "g").collect()) == [(False, 1.0), (False, 3.0), (True, 0)]
    gae = spark.range(1).select(rewards.generalised_advantage(F.array(F.lit(0.0), F.lit(1.0)), F.array(F.lit(0.5), F.lit(0.25)), 1.0, 0.5).alias("a")).first().a
    assert gae == pytest.approx([0.0 + 0.25 - 0.5 + 0.5 * 0.75, 0.75])
    total = spark.createDataFrame([(None, None), (1.0, float("nan")), (1.0, 2.0)], "x double, y double").select(rewards.total_reward(["x", "y"], [1.0, 0.5]).alias("t")).collect()
    assert [r.t for r in total] == [0.0, 1.0, 2.0]


def test_web(spark):
    html = '<nav><a href="/n">n</a></nav><p>Some words here for you</p><a href="https://other.org/x">o</a><a class="c" href="b.html">b</a><img alt="" src="i.png">'
    pages = spark.createDataFrame([(1, "https://Site.org/v/docs/guide/a?x", html), (2, None, None)], "page_id int, url string, html string")
    got = [(r.target, r.internal) for r in web.links(pages).orderBy("pos").collect()]
    assert got == [("https://Site.org/n", True), ("https://other.org/x", False), ("https://Site.org/v/docs/guide/b.html", True)]
    r = pages.select(web.parent_section(F.col("url")).alias("s"), web.image_sources(F.col("html")).alias("i"), web.matches_glob(F.col("url"), "*guide*").alias("g")).first()
    assert (r.s, r.i, r.g) == ("guide", ["i.png"], True)
    assert [r.fields["text"] for r in web.by_selector(pages, "page_id", "a.c").collect()] == ["b"]
    doc = spark.createDataFrame([(1, "\n".join(["x", "KEY one"] + [f"l{k}" for k in range(10)] + ["## next", "KEY two"])), (2, "none")], "id int, content string")
    sections = {r.id: r.section for r in web.keyword_section(doc, "id", "content", ["key"]).collect()}
    assert sections[2] is None and sections[1].split("\n")[0] == "KEY one" and sections[1].split("\n")[-1] == "l9"


def test_reports_and_evaluation(spark):
    q = spark.createDataFrame([(0, "Câu 1. tính"), (1, "Câu 10. x"), (2, None), (3, "z $x$")], "id int, q string")
    assert {r.bucket: r.n for r in reports.head_buckets(q, "q").collect()} == {"Câu 1": 2, "Khác": 2}
    assert {r.bucket: r.n for r in reports.head_buckets(q, "q", exact=True).collect()} == {"Câu 1": 1, "Khác": 3}
    assert [(r.keyword, r.n) for r in reports.keyword_counts(q, "q").collect()] == [("tính", 1)]
    cases = spark.createDataFrame([(0, "12", "12"), (1, "a", "b")], "id int, answer string, expected string")
    summary = evaluation.metric_summary(evaluation.long_metrics(evaluation.scored(cases), ["id"]))
    assert {r.metric: r["mean"] for r in summary.collect()}["exact_match"] == 0.5
    assert evaluation.weighted_score(summary).first().weighted_score == pytest.approx(0.4 * 0.5 + 0.2 * 1.0 + 0.1 * 0.5)


def test_crawls_and_links(spark):
    edges = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "d", 0.5), ("d", "a", 1.0)], "source string, target string, score double")
    start = spark.createDataFrame([("a",)], "url string")
    assert {(r.url, r.depth) for r in web.crawl_frontier(edges, start, 3, 1, "score").collect()} == {("a", 0), ("b", 1), ("d", 2)}
    terms = spark.createDataFrame([("a", "x"), ("b", "y"), ("d", "z")], "url string, term string")
    assert [r.url for r in web.adaptive_crawl(edges, start, terms, ["x", "y"], 1).collect()] == ["a", "b"]
    found = spark.createDataFrame([(1, "https://www.x.com/a", False), (1, "https://o.org", False), (1, "https://s/a", True)], "page_id int, target string, internal boolean")
    assert web.kept_links(found).count() == 1 and web.kept_links(found, external=True).count() == 2 and web.kept_links(found, True, True).count() == 3
    kinds = spark.createDataFrame([("text/HTML; charset=x",), ("image/png",), (None,)], "content_type string")
    assert web.of_content_type(kinds).count() == 1
    urls, results = spark.createDataFrame([("u",), ("v",)], "url string"), spark.createDataFrame([("u", True, None)], "url string, success boolean, error string")
    assert {(r.url, r.success, r.error) for r in web.with_failures(urls, results).collect()} == {("u", True, None), ("v", False, "no result")}


def test_losses_and_balance(spark):
    from tessera.functions import scores as S

    r = spark.range(1).select(S.sigmoid_loss(F.lit(0.0)).alias("s"), S.hinge_loss(F.lit(5.0)).alias("h"), S.ipo_loss(F.lit(5.0)).alias("i"), S.density_weight(F.lit(0.5), 0.2, 0.8).alias("w")).first()
    assert r.s == pytest.approx(math.log(2)) and r.h == 0.5 and r.i == 0 and r.w == 0.8
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "b int, o int, completion string")
    assert [r.kl_completion for r in rewards.mismatched(df, "b", "o").orderBy("o").collect()] == ["c", "a", "b"]
    empty = spark.createDataFrame([], "label boolean")
    assert rewards.label_balance(empty).first().n_desirable == 1
