"""Traces of runs: spans in trees, threads, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cleaning import held

SPANS = "trace_id string, span_id string, parent_id string, thread_id string, name string, kind string, input string, output string, started timestamp, ended timestamp"


def trace_summary(spans: DataFrame) -> DataFrame:
    """trace_id, thread_id, name of the root, spans, seconds."""
    root = F.min_by("name", F.struct(F.col("parent_id").isNotNull(), F.col("started")))
    seconds = F.unix_micros(F.max("ended")) - F.unix_micros(F.min("started"))
    return spans.groupBy("trace_id").agg(F.max("thread_id").alias("thread_id"), root.alias("name"), F.count(F.lit(1)).alias("n_spans"), (seconds / 1e6).alias("seconds"))


def threads(spans: DataFrame) -> DataFrame:
    """thread_id, its traces, and the turns of its root spans in order."""
    roots = spans.where("parent_id IS NULL")
    turns = F.array_sort(F.collect_list(F.struct("started", "trace_id", "input", "output")))
    return roots.groupBy("thread_id").agg(F.count_distinct("trace_id").alias("n_traces"), F.transform(turns, lambda t: F.struct(t["input"].alias("input"), t["output"].alias("output"))).alias("turns"))


def span_depths(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, depth: how far below the root each span stands, however deep.

    Each span points to its parent; a round replaces the pointer by the pointer of what it points to, so distances double
    and 2^k levels take k + 1 rounds. Spans that no root is above of (a parent that is not there, a ring) are left out;
    a span id that repeats in its trace counts once, with its least parent.
    """
    once = spans.groupBy("trace_id", "span_id").agg(F.min("parent_id").alias("up"))
    at = held(once.select("trace_id", "span_id", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("depth")))
    rounds = max(1, at.count()).bit_length() + 1
    for _ in range(rounds):
        moving = at.where("up IS NOT NULL")
        if moving.isEmpty():
            break
        above = at.select(F.col("trace_id").alias("t"), F.col("span_id").alias("s"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = moving.join(above, (moving.trace_id == above.t) & (moving.up == above.s))
        at = held(at.where("up IS NULL").union(moved.select("trace_id", "span_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))))
    return at.where("up IS NULL").select("trace_id", "span_id", "depth")


def self_times(spans: DataFrame) -> DataFrame:
    """trace_id, span_id, seconds, self_seconds: a span's time, and its time without that of its children.

    Children are cut to the parent's time; where they overlap, the time counts once. Spans without an end have null, and take no time from their parent.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    own = spans.select("trace_id", "span_id", "parent_id", micros("started").alias("a"), micros("ended").alias("z"))
    child = own.select(F.col("trace_id").alias("t"), F.col("parent_id").alias("p"), F.col("a").alias("ca"), F.col("z").alias("cz")).where("p IS NOT NULL AND ca IS NOT NULL AND cz IS NOT NULL")
    met = own.join(child, (own.trace_id == child.t) & (own.span_id == child.p)).select("trace_id", "span_id", F.greatest("a", "ca").alias("ca"), F.least("z", "cz").alias("cz")).where("ca < cz")
    before = Window.partitionBy("trace_id", "span_id").orderBy("ca", "cz").rowsBetween(Window.unboundedPreceding, -1)
    new = F.greatest(F.lit(0), F.col("cz") - F.greatest("ca", F.coalesce(F.max("cz").over(before), F.col("ca"))))
    busy = met.withColumn("new", new).groupBy(F.col("trace_id").alias("t"), F.col("span_id").alias("s")).agg(F.sum("new").alias("busy"))
    joined = own.join(busy, (own.trace_id == F.col("t")) & (own.span_id == F.col("s")), "left")
    return joined.select("trace_id", "span_id", ((F.col("z") - F.col("a")) / 1e6).alias("seconds"), ((F.col("z") - F.col("a") - F.coalesce("busy", F.lit(0))) / 1e6).alias("self_seconds"))


def experiment_scores(items: DataFrame) -> DataFrame:
    """experiment, metric, mean score, items."""
    return items.groupBy("experiment", "metric").agg(F.avg("score").alias("mean_score"), F.count("score").alias("n_items"))
