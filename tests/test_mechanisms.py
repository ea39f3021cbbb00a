"""Table functions, split JSON arrays, histories, streams with state, sketches and span trees."""

import json
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessera.operators import exams, sketches, table_functions
from tessera.plans import history, traces
from tessera.sources import json_arrays, readers
from tessera.streaming import progress

PAPER = """Đề thi
Câu 1: What is
two plus two?
A. three
b) four
Phương pháp: add
slowly
Lời giải chi tiết
four
Đáp án: B
Bài 2. Empty of options

Solution: none
answer is unknown
Câu 3
Question 4 last [one]
C: x"""


def test_exam_function_gives_what_the_expressions_give(spark):
    papers = spark.createDataFrame([(1, PAPER), (2, ""), (3, None), (4, "no head\nA. b"), (5, "Câu 9: q\n" + "line\n" * 500 + "Đáp án C")], "paper long, content string")
    found = table_functions.parsed_exams(papers, "paper")
    plain = exams.line_parser(papers, "paper")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
    table_functions.register(spark)
    table_functions.exam_lines(papers, "paper").createOrReplaceTempView("paper_lines")
    again = spark.sql("SELECT * FROM exam_questions(TABLE(paper_lines) PARTITION BY paper ORDER BY pos)")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, plain.collect()))
    assert dict(again.dtypes)["paper"] == "bigint"


def test_page_records_have_the_columns_of_their_schema(spark):
    spark.createDataFrame([(1, "<ul><li><a href=x>one</a><li>two</ul>"), (2, None), (3, "")], "page long, html string").createOrReplaceTempView("some_pages")
    table_functions.register(spark)
    schema = json.dumps({"baseSelector": "li", "fields": [{"name": "label", "type": "text"}, {"name": "link", "selector": "a", "type": "attribute", "attribute": "href"}]})
    found = spark.sql(f"SELECT p.page, r.* FROM some_pages p, LATERAL page_records(p.html, '{schema}') r")
    assert found.columns == ["page", "pos", "label", "link"]
    assert sorted(map(tuple, found.collect())) == [(1, 0, "one", "x"), (1, 1, "two", None)]
    for bad in ("{}", '{"baseSelector": "li", "fields": [{"name": "pos"}]}', '{"baseSelector": "li[", "fields": []}'):
        with pytest.raises(PySparkException):
            spark.sql(f"SELECT * FROM page_records('<p>', '{bad}')").collect()


RECORD = "id long, text string, inner struct<a:array<long>,b:string>"


def texts(seed):
    rng = random.Random(seed)
    signs = ["}", "{", "[", "]", '"', "\\", ",", " ", "\n", "é", "日本", "a", "},{", '"}', "\\\\", "\\u0041"]
    return [{"id": k, "text": "".join(rng.choices(signs, k=rng.randint(0, 60))), "inner": {"a": list(range(rng.randint(0, 5))), "b": rng.choice(["}", '{"', None])}} for k in range(rng.randint(1, 80))]


@pytest.mark.parametrize("size", [16, 100, 1 << 20])
def test_arrays_are_read_by_byte_ranges(spark, tmp_path, size):
    whole = {}
    for k in range(4):
        whole[f"good {k}.json"] = texts(k)
        (tmp_path / f"good {k}.json").write_text(["", "﻿"][k % 2] + json.dumps(whole[f"good {k}.json"], indent=[None, 2][k % 2], ensure_ascii=k < 2) + "\n" * k)
    one = '{"id": 1, "text": "x"}'
    broken = [f"[{one}", f"{one}]", f"[{one}]}}", f"[{one} {one}]", f"[{one},]", f"[,{one}]", f"[{one}]]", f"[{one}] [{one}]", f'[{one}, {{"id": "x}}]', f'[{one}, {{"id": }}]', one, "", "no", "[1, 2]", f"[1, {one}]", f'[{one}, {{"id": 2]', f"[{one}]x"]
    for k, text in enumerate(broken):
        (tmp_path / f"broken{k}.json").write_text(text)
    (tmp_path / "empty.json").write_text(" [ ] ")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        rows = json_arrays.read_json_arrays(spark, f"{tmp_path}/*.json", RECORD).collect()
    finally:
        spark.conf.set(key, before)
    found = sorted((r.file, r.pos, r.id, r.text, list(r.inner.a), r.inner.b) for r in rows)
    assert found == sorted((f, k, r["id"], r["text"], r["inner"]["a"], r["inner"]["b"]) for f, records in whole.items() for k, r in enumerate(records))


def test_one_array_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"question": "q" * 50 + str(k)} for k in range(3000)]))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "20000")
    try:
        assert json_arrays._pieces(spark, f"{tmp_path}/a.json").rdd.getNumPartitions() > 8
        rows = readers.read_json_array(spark, f"{tmp_path}/a.json").select("question", "pos").collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.pos, r.question) for r in rows) == [(k, "q" * 50 + str(k)) for k in range(3000)]


def test_arrays_written_by_partition(spark, tmp_path):
    df = spark.range(10, numPartitions=3).select("id", F.lit("}").alias("text"), F.lit(None).cast("string").alias("none"))
    json_arrays.write_json_arrays(df, f"{tmp_path}/out")
    files = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*")]
    assert sorted(r["id"] for f in files for r in f) == list(range(10)) and len(files) == 3
    assert sum(r.n_rows for r in spark.read.json(f"{tmp_path}/out/_manifest").collect()) == 10


def test_a_batch_is_merged_without_moving_the_history(spark, tmp_path):
    seen = history.SeenHistory(spark, "seen_texts", f"{tmp_path}/seen", 4)
    first = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, None), (4, "c")], "id long, text string")
    second = spark.createDataFrame([(5, " a b "), (6, "d"), (7, "d"), (8, None), (9, "")], "id long, text string")
    assert sorted(r.id for r in seen.merge(first, "text", "id", 1).collect()) == [1, 3, 4]
    seen.detach()  # as in a new session
    plan = seen.unseen(second, "text", "id")._jdf.queryExecution().executedPlan().toString()
    past = plan[plan.index("seen_texts") - 2000 : plan.index("seen_texts")]
    assert plan.count("Exchange") == 1 and "hashpartitioning(__h" in plan and "Bucketed: true" in plan, past
    assert sorted(r.id for r in seen.merge(second, "text", "id", 2).collect()) == [6, 9]
    assert seen.merge(second, "text", "id", 3).count() == 0
    assert spark.table("seen_texts").count() == 5
    seen.detach()


@pytest.fixture
def state_store(spark):
    key, provider = progress.PROVIDER
    spark.conf.set(key, provider)
    yield
    spark.conf.unset(key)


def test_a_stream_with_state_ends_with_the_batch(spark, tmp_path, state_store):
    at = lambda day, user, value: (user, f"2024-01-{day:02d} 00:00:00", value)
    files = [[at(3, 1, 1.0), at(1, 1, 2.0), at(2, 2, None)], [at(1, 2, 5.0), at(2, 1, 4.0)], [at(20, 3, 1.0)], [at(21, 3, 1.0), at(20, 3, 2.0)]]
    schema = "user long, ts timestamp, value double"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "user long, t string, value double").select("user", F.to_timestamp("t").alias("ts"), "value").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    progress.run(spark, progress.progress(stream, "user", "ts", "value", "5 days", idle=86400.0), str(tmp_path)).awaitTermination(120)
    updates = spark.read.parquet(f"{tmp_path}/updates")
    batch = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, progress.latest(updates).collect())) == sorted(map(tuple, progress.totals(batch, "user", "ts", "value").collect()))
    quiet = {(r.key, r.n) for r in updates.where("quiet").collect()}
    assert quiet == {(1, 3), (2, 2)}


def test_sketches_merge_and_overlap(spark):
    df = spark.range(20000).select((F.col("id") % 7).alias("day"), (F.col("id") % 5000).alias("item"), F.col("id").alias("value"))
    merged = sketches.estimates(sketches.merged_sketches(sketches.partial_sketches(df, ["day"], "item", "value"), []), {"median": 0.5, "most": 1.0}).first()
    assert merged.n == 20000 and abs(merged.distinct - 5000) < 4 * sketches.HLL_ERROR * 5000 and abs(merged.distinct_theta - 5000) < 4 * sketches.THETA_ERROR * 5000
    assert abs(merged.median - 10000) < sketches.RANK_ERROR * 20000 and merged.most == 19999
    splits = spark.range(9000).select(F.explode(F.when(F.col("id") < 3000, F.array(F.lit("a"))).when(F.col("id") < 6000, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("b")))).alias("split"), "id")
    met = sketches.overlaps(sketches.partial_sketches(splits, ["split"], "id"), "split").first()
    assert (met.a, met.b) == ("a", "b") and abs(met.shared - 3000) < 4 * sketches.THETA_ERROR * 9000 and abs(met.jaccard - 1 / 3) < 0.1


def test_spans_of_any_depth_and_their_own_time(spark):
    chain = [("t", str(k), str(k - 1) if k else None) for k in range(130)]
    odd = [("u", "1", "2"), ("u", "2", "1"), ("u", "3", "9"), ("u", "4", None), ("u", "5", "4"), ("u", "5", "4")]
    spans = spark.createDataFrame(chain + odd, "trace_id string, span_id string, parent_id string")
    found = {(r.trace_id, r.span_id): r.depth for r in traces.span_depths(spans).collect()}
    assert found == {("t", str(k)): k for k in range(130)} | {("u", "4"): 0, ("u", "5"): 1}
    timed = spark.createDataFrame([("t", "1", None, 0, 100), ("t", "2", "1", 10, 30), ("t", "3", "1", 20, 50), ("t", "4", "1", 90, 120), ("t", "5", "2", 10, 30), ("t", "6", "1", 25, None)], "trace_id string, span_id string, parent_id string, a long, z long")
    timed = timed.select("trace_id", "span_id", "parent_id", F.timestamp_seconds("a").alias("started"), F.timestamp_seconds("z").alias("ended"))
    assert {r.span_id: r.self_seconds for r in traces.self_times(timed).collect()} == {"1": 50.0, "2": 0.0, "3": 30.0, "4": 30.0, "5": 20.0, "6": None}
