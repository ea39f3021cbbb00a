"""Registered queries of table functions, sketches, span trees, histories, streams with state, and split JSON files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import sketches, table_functions
from ..operators.cleaning import held
from ..sources import json_arrays
from ..streaming import progress
from . import traces
from .further import ITEM_LINKS, ITEMS
from .history import SeenHistory
from .queries import collapsed, query, t, word_list
from .shared import WorkFolder


@query(f"""WITH l AS (SELECT page_id, unnest(range(len({ITEMS})))::INTEGER AS pos, unnest({ITEMS}) AS label, unnest({ITEM_LINKS}) AS link FROM pages)
    SELECT page_id, pos, nullif(array_to_string({word_list("label")}, ' '), '') AS label, link FROM l""")
def lateral_page_records(spark, sf_dir):
    """Every page's records by a lateral join with a table function."""
    schema = {"baseSelector": "nav > ul li", "fields": [{"name": "label", "selector": "a[href]", "type": "text"}, {"name": "link", "selector": "a", "type": "attribute", "attribute": "href"}]}
    return table_functions.lateral_page_records(t(spark, sf_dir, "pages"), "page_id", schema).withColumn("label", F.nullif("label", F.lit("")))


def papers(spark, sf_dir):
    """A conversation as an exam paper: what the user says is a question, the rest its solution and answer."""
    said = F.when(F.col("role") == "user", F.concat(F.lit("Câu "), F.col("turn") + 1, F.lit(": "), "text")).otherwise(F.concat(F.lit("Solution: "), "text", F.lit("\nAnswer: "), F.char(F.col("turn") % 4 + 65)))
    turns = F.array_sort(F.collect_list(F.struct("turn", said.alias("lines"))))
    return t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["lines"]), "\n").alias("content"))


PAPERS_SQL = r"""WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM conversations),
    o AS (SELECT *, sum(CASE WHEN role = 'user' AND i = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, i) AS ordinal FROM l),
    p AS (SELECT conv_id, ordinal::BIGINT AS ordinal,
        trim(string_agg(CASE WHEN i > 0 AND regexp_matches(trim(line), '(?i)^[A-D][:.)]') THEN chr(10) || trim(line)[1] || '. ' || regexp_replace(trim(line)[3:], '^\s+', '') ELSE ' ' || trim(line) END, '' ORDER BY turn, i) FILTER (role = 'user' AND trim(line) <> ''), ' ' || chr(10)) AS question,
        trim(string_agg(trim(CASE WHEN i = 0 THEN 'Solution: ' || line ELSE line END), chr(10) ORDER BY turn, i) FILTER (role <> 'user' AND (i = 0 OR trim(line) <> ''))) AS solution,
        string_agg(chr((65 + turn % 4)::INTEGER), '' ORDER BY turn) FILTER (role <> 'user' AND i = 0) AS answer
      FROM o WHERE ordinal > 0 GROUP BY conv_id, ordinal)
    SELECT conv_id, ordinal, question, '' AS method, coalesce(solution, '') AS solution, coalesce(answer, '') AS answer FROM p WHERE question <> ''"""


@query(PAPERS_SQL)
def exam_questions(spark, sf_dir):
    """All papers through the table function, partitioned by paper."""
    return table_functions.parsed_exams(papers(spark, sf_dir), "conv_id")


@query("""SELECT event_type, count(user_id) AS n, count(DISTINCT user_id) AS n_users, count(DISTINCT event_id) AS n_events, true AS hll_within, true AS theta_within, true AS median_within FROM events GROUP BY event_type""")
def sketched_counts(spark, sf_dir):
    """Sketches of each day and type, merged over days, against exact counts: all lie within their error."""
    e = t(spark, sf_dir, "events")
    day = F.to_date("ts").alias("day")
    users = sketches.merged_sketches(held(sketches.partial_sketches(e, ["event_type", day], "user_id", "value")), ["event_type"])
    events = sketches.merged_sketches(held(sketches.partial_sketches(e, ["event_type", day], "event_id")), ["event_type"])
    users = sketches.estimates(users, {"median": 0.5}).select(F.col("event_type").alias("u"), "n", F.col("distinct").alias("users"), "distinct_theta", "median")
    events = sketches.estimates(events).select(F.col("event_type").alias("v"), F.col("distinct").alias("events"), F.col("distinct_theta").alias("events_theta"))
    exact = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct("event_id").alias("n_events"))
    joined = exact.join(users, F.col("event_type") == F.col("u")).join(events, F.col("event_type") == F.col("v"))
    ranks = e.join(users.select("u", "median"), F.col("event_type") == F.col("u")).groupBy(F.col("event_type").alias("w")).agg((F.count_if(F.col("value") <= F.col("median")) / F.count("value")).alias("below"), (F.count_if(F.col("value") < F.col("median")) / F.count("value")).alias("under"))
    joined = joined.join(ranks, F.col("event_type") == F.col("w"))
    hll = sketches.within(F.col("users"), F.col("n_users"), sketches.HLL_ERROR) & sketches.within(F.col("events"), F.col("n_events"), sketches.HLL_ERROR)
    theta = sketches.within(F.col("distinct_theta"), F.col("n_users"), sketches.THETA_ERROR) & sketches.within(F.col("events_theta"), F.col("n_events"), sketches.THETA_ERROR)
    median = (F.col("below") >= 0.5 - sketches.RANK_ERROR) & (F.col("under") <= 0.5 + sketches.RANK_ERROR)
    return joined.select("event_type", "n", "n_users", "n_events", hll.alias("hll_within"), theta.alias("theta_within"), median.alias("median_within"))


@query(f"""WITH w AS (SELECT DISTINCT source, unnest({word_list("lower(text)")}) AS word FROM documents)
    SELECT a.source AS a, b.source AS b, count(*) AS n_shared, true AS within FROM w a JOIN w b ON a.word = b.word AND a.source < b.source GROUP BY ALL""")
def split_overlaps(spark, sf_dir):
    """Words that two sources share, by theta sketches, against exact counts."""
    words = t(spark, sf_dir, "documents").select("source", F.explode(T.words(F.lower("text"))).alias("word"))
    found = sketches.overlaps(held(sketches.partial_sketches(words, ["source"], "word")), "source").withColumnsRenamed({"a": "x", "b": "y"})
    once = words.distinct()
    sizes = once.groupBy("source").agg(F.count(F.lit(1)).alias("size"))
    other = once.select(F.col("source").alias("b"), F.col("word").alias("other"))
    exact = once.join(other, (F.col("word") == F.col("other")) & (F.col("source") < F.col("b"))).groupBy(F.col("source").alias("a"), "b").agg(F.count(F.lit(1)).alias("n_shared"))
    exact = exact.join(sizes.select(F.col("source").alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col("source").alias("b"), F.col("size").alias("size_b")), "b")
    # the error of an intersection is that of the union
    near = F.abs(F.col("shared") - F.col("n_shared")) <= 4 * sketches.THETA_ERROR * (F.col("size_a") + F.col("size_b") - F.col("n_shared"))
    return exact.join(found, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("a", "b", "n_shared", near.alias("within"))


def spans(spark, sf_dir):
    """A user's events as a trace: the k-th span hangs on the one before, or, for each third, on the one before that."""
    w = "ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    e = t(spark, sf_dir, "events").selectExpr("cast(user_id AS string) trace_id", f"{w} - 1 AS span_id", "ts", "value")
    parent = F.when(F.col("span_id") > 0, F.greatest(F.lit(0), F.col("span_id") - F.when(F.col("span_id") % 3 == 2, 2).otherwise(1)))
    seconds = F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)") * 3600)
    return e.select("trace_id", F.col("span_id").cast("string").alias("span_id"), parent.cast("string").alias("parent_id"), F.col("ts").cast("timestamp").alias("started"), (F.col("ts").cast("timestamp") + seconds).alias("ended"))


SPANS_SQL = """n AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, epoch_us(ts) AS a, epoch_us(ts) + (CAST(value AS DECIMAL(38, 6)) * 3600000000)::BIGINT AS z FROM events),
    s AS (SELECT trace_id, k AS span_id, CASE WHEN k > 0 THEN greatest(0, k - CASE WHEN k % 3 = 2 THEN 2 ELSE 1 END) END AS parent_id, a, z FROM n)"""


@query(f"""WITH RECURSIVE {SPANS_SQL}, r AS (SELECT trace_id, span_id, 0 AS depth FROM s WHERE parent_id IS NULL UNION ALL SELECT s.trace_id, s.span_id, r.depth + 1 FROM r JOIN s ON s.trace_id = r.trace_id AND s.parent_id = r.span_id)
    SELECT trace_id, CAST(span_id AS VARCHAR) AS span_id, depth::INTEGER AS depth FROM r""")
def nested_spans(spark, sf_dir):
    return traces.span_depths(spans(spark, sf_dir))


@query(f"""WITH {SPANS_SQL},
    c AS (SELECT p.trace_id, p.span_id, greatest(p.a, c.a) AS a, least(p.z, c.z) AS z FROM s p JOIN s c ON c.trace_id = p.trace_id AND c.parent_id = p.span_id WHERE greatest(p.a, c.a) < least(p.z, c.z)),
    m AS (SELECT *, max(z) OVER (PARTITION BY trace_id, span_id ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
    b AS (SELECT trace_id, span_id, sum(greatest(0, z - greatest(a, coalesce(before, a)))) AS busy FROM m GROUP BY ALL)
    SELECT s.trace_id, CAST(s.span_id AS VARCHAR) AS span_id, round((z - a) / 1000000.0::DOUBLE, 6) AS seconds, round((z - a - coalesce(busy, 0))::BIGINT / 1000000.0::DOUBLE, 6) AS self_seconds FROM s LEFT JOIN b ON b.trace_id = s.trace_id AND b.span_id = s.span_id""")
def span_self_times(spark, sf_dir):
    return traces.self_times(spans(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("seconds", "self_seconds")})


@query(f"""SELECT doc_id, (doc_id % 3)::INTEGER AS run FROM documents QUALIFY row_number() OVER (PARTITION BY md5({collapsed("text")}) ORDER BY doc_id % 3, doc_id) = 1""")
def seen_across_runs(spark, sf_dir):
    """Three batches merged one after the other into a bucketed history of texts."""
    docs = t(spark, sf_dir, "documents")
    with WorkFolder(spark) as folder:
        history = SeenHistory(spark, f"seen_{uuid.uuid4().hex}", f"{folder}/seen", 16)
        try:
            new = [history.merge(docs.where(F.col("doc_id") % 3 == k), "text", "doc_id", k).select("doc_id", F.lit(k).alias("run")) for k in range(3)]
        finally:
            history.detach()
    return new[0].union(new[1]).union(new[2])


@query("""SELECT user_id AS key, count(*) AS n, round(sum(value), 4) AS total, epoch_us(max(ts)) AS last FROM events GROUP BY user_id""")
def stream_progress(spark, sf_dir):
    """All events as a stream of four files out of order, in state for each user; the last version of each is the answer."""
    events = t(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    key, provider = progress.PROVIDER
    before = spark.conf.get(key, None)
    with WorkFolder(spark) as folder:
        events.repartition(4, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
        spark.conf.set(key, provider)
        try:
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
            progress.run(spark, progress.progress(stream, "user_id", "ts", "value", "366 days"), folder).awaitTermination()
        finally:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        return held(progress.latest(spark.read.parquet(f"{folder}/updates")).withColumn("total", F.round("total", 4)))


@query("SELECT doc_id, md5(text) AS text_md5, length(text) AS n, lang, source FROM documents")
def json_array_files(spark, sf_dir):
    """All documents written as files of one JSON array each, and read again by byte ranges smaller than a file."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    with WorkFolder(spark) as folder:
        json_arrays.write_json_arrays(docs, f"{folder}/arrays")
        spark.conf.set(key, str(1 << 19))
        try:
            back = json_arrays.read_json_arrays(spark, f"{folder}/arrays/*.txt", "doc_id long, text string, lang string, source string")
            return held(back.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("n"), "lang", "source"))
        finally:
            spark.conf.set(key, before)
