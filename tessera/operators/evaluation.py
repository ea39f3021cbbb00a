"""Answers against expectations: scores, summaries, comparison of runs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import METRICS, WEIGHTS, weighted
from .web import preview


def scored(df: DataFrame, answer: str = "answer", expected: str = "expected", metrics: dict = METRICS) -> DataFrame:
    """Adds a column for each metric."""
    return df.withColumns({name: build(F.col(answer), F.col(expected)) for name, build in metrics.items()})


def long_metrics(df: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """keys, metric, score: one row for each metric of each case."""
    return df.unpivot(keys, names or list(METRICS), "metric", "score")


def metric_summary(long: DataFrame, *keys: str) -> DataFrame:
    """Mean, least and largest score and their count by metric; 0 where there are no scores."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return long.groupBy(*keys, "metric").agg(zero(F.avg("score")).alias("mean"), zero(F.min("score")).alias("least"), zero(F.max("score")).alias("most"), F.count("score").alias("n"))


def weighted_score(summary: DataFrame, *keys: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """keys, weighted_score: means of the metrics by their weights; metrics that have none count nothing."""
    table = summary.sparkSession.createDataFrame(sorted(weights.items()), "metric string, weight double")
    return summary.join(F.broadcast(table), "metric").groupBy(*keys).agg(F.sum(F.col("mean") * F.col("weight")).alias("weighted_score"))


def compared(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """metric, base, tuned, improvement, percent (null unless the base is over 0)."""
    a, b = base.select("metric", F.col("mean").alias("base")), tuned.select("metric", F.col("mean").alias("tuned"))
    gain = F.col("tuned") - F.col("base")
    return a.join(b, "metric").select("metric", "base", "tuned", gain.alias("improvement"), F.when(F.col("base") > 0, gain / F.col("base") * 100).alias("percent"))


def judged(df: DataFrame, judgement: Column) -> DataFrame:
    """One row: mean scores over what parsed, and how many did not."""
    j = df.select(judgement.alias("j"))
    return j.agg(F.avg("j.accuracy").alias("mean_accuracy"), F.avg("j.style").alias("mean_style"), F.count_if(F.col("j.accuracy").isNull()).alias("n_invalid"))


def case_report(df: DataFrame, order: str, question: str, answer: str, longest: int = 200) -> DataFrame:
    """One row with a markdown report, a part for each case in order."""
    part = F.concat(F.lit("### "), F.col(question), F.lit("\n\n"), preview(F.col(answer), longest), F.lit("\n\nscore: "), F.format_number(F.col("weighted"), 3), F.lit("\n"))
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))), lambda s: s["p"]), "\n").alias("report"))


def zipped(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of both tables at the same position, as many as the shorter has."""
    from .sampling import numbered

    return numbered(a, order_a, name="position").join(numbered(b, order_b, name="position"), "position")


def with_weighted(df: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    return df.withColumn("weighted", weighted({m: F.col(m) for m in weights}, weights))
