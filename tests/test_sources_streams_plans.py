"""Readers and writers, streams that end as batches do, plans, catalogue, traces, and the registered SQL."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans import catalog, queries, stages, traces
from tessera.sources import readers, writers
from tessera.streaming import jobs

SMALL = "/root/testdata/sf0.001"


def test_json_arrays(spark, tmp_path):
    (tmp_path / "crawled_p1.json").write_text(json.dumps([{"question": "a", "error": False}, {"question": None}]))
    (tmp_path / "crawled_p2.json").write_text("not json")
    (tmp_path / "other_crawled_p3.json").write_text(json.dumps([{"question": "no"}]))
    rows = readers.questions_by_file(spark, str(tmp_path)).collect()
    assert [(r.file, r.pos, r.question) for r in rows] == [("crawled_p1.json", 0, "a"), ("crawled_p1.json", 1, None)]


def test_csv_lines_yaml(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,n\n"two\nlines ""x""",1\nNA,2\n')
    assert [r.text for r in readers.read_csv(spark, f"{tmp_path}/a.csv").orderBy("n").collect()] == ['two\nlines "x"', None]
    (tmp_path / "u.txt").write_text(" a \n\n b\n")
    assert [r.value for r in readers.read_lines(spark, f"{tmp_path}/u.txt").collect()] == ["a", "b"]
    (tmp_path / "c.yaml").write_text("x: {y: [1]}")
    assert readers.read_yaml(spark, f"{tmp_path}/c.yaml") == {"x": {"y": [1]}} and readers.read_yaml(spark, f"{tmp_path}/none.yaml") is None


def test_splits_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "text string, split string")
    writers.write_processed(df, str(tmp_path))
    back = readers.read_splits(spark, str(tmp_path))
    assert {(r.text, r.split) for r in back.collect()} == {("a", "train"), ("b", "test")}
    assert json.loads(writers.json_array(df, "text").first().json) == [{"text": "a", "split": "train"}, {"text": "b", "split": "test"}]
    with pytest.raises(ValueError):
        readers.require(df, "none")


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "c"), (4, None)], "id int, text string")
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.dedup_stream(jobs.read_stream(spark, f"{tmp_path}/in", df.schema), "text")
    jobs.to_table(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == jobs.dedup_stream(df, "text").count() == 3
    jobs.roll_over_batches(jobs.read_stream(spark, f"{tmp_path}/in", df.schema), f"{tmp_path}/rolled", f"{tmp_path}/ck2").awaitTermination(60)
    assert spark.read.json(f"{tmp_path}/rolled/crawled_p1").count() == 4


def test_plan_and_catalogue(spark, tmp_path):
    plan = stages.Plan([stages.Step("keep", lambda df, least=1: df.where(F.col("id") >= least)), stages.Step("double", lambda df: df.withColumn("id", F.col("id") * 2))])
    assert [r.id for r in plan.apply(spark.range(3), {"keep": {"least": 2}}).collect()] == [4]
    assert [r.id for r in plan.apply(spark.range(3), store=f"{tmp_path}/s").orderBy("id").collect()] == [2, 4]
    assert [r.id for r in plan.apply(spark.range(9), store=f"{tmp_path}/s", cached=True).orderBy("id").collect()] == [2, 4]
    with pytest.raises(KeyError):
        plan.apply(spark.range(3), {"other": {}})
    c = catalog.Catalog(spark, f"{tmp_path}/c")
    assert c.save(spark.range(2), "x", ["t"]) == 1 and c.save(spark.range(5), "x") == 2
    assert c.load("x").count() == 5 and c.load("x", 1).count() == 2 and c.tagged("t").count() == 1


def test_traces(spark):
    rows = [("t", "1", None, "th", "root", "llm", "i", "o"), ("t", "2", "1", "th", "child", "tool", None, None), ("t", "3", "2", "th", "leaf", "tool", None, None)]
    spans = spark.createDataFrame(rows, "trace_id string, span_id string, parent_id string, thread_id string, name string, kind string, input string, output string").withColumns({"started": F.timestamp_seconds(F.col("span_id").cast("int")), "ended": F.timestamp_seconds(F.col("span_id").cast("int") + 1)})
    r = traces.trace_summary(spans).first()
    assert (r.name, r.n_spans, r.seconds) == ("root", 3, 3.0)
    assert {r.span_id: r.depth for r in traces.span_depths(spans).collect()} == {"1": 0, "2": 1, "3": 2}
    assert traces.threads(spans).first().turns[0].input == "i"


#: A few of the registered queries; the driver compares all of them.
CHECKED = ("clean_corpus_summary", "text_normalisation", "near_deduplication", "language_detection", "page_links", "chat_templates", "shuffled_split", "packed_tokens", "event_sessions", "exam_records")


@pytest.mark.parametrize("name", CHECKED)
def test_sql_gives_the_same_rows(spark, name):
    c = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "conversations", "events", "labels"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SMALL}/{table}.parquet')")
    df = queries.QUERIES[name](spark, SMALL)
    relation = c.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    place = [relation.columns.index(k) for k in columns]
    assert sorted(repr([r[k] for k in columns]) for r in df.collect()) == sorted(repr([r[p] for p in place]) for r in relation.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
