"""Aggregations over a corpus of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Topics of mathematics, and the heads of questions that are counted.
TOPICS = ["phương trình", "giải", "tính", "biểu thức", "hình học", "diện tích", "chu vi", "phân số", "số nguyên", "đạo hàm", "tích phân", "ma trận", "vector", "logarit"]
HEADS = ["Câu 1", "Câu 2", "Câu 3", "Câu 4", "Câu 5"]
OTHER = "Khác"


def length_statistics(df: DataFrame, column: str, *keys: str) -> DataFrame:
    n, w = F.length(column), F.size(F.filter(F.split(column, "\\s+"), lambda x: x != ""))
    return df.groupBy(*keys).agg(F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.avg(n).alias("mean_length"), F.avg(w).alias("mean_words"))


def keyword_counts(df: DataFrame, column: str, keywords: list[str] = TOPICS) -> DataFrame:
    """keyword, n, percent: texts that contain each keyword, most first, ties in list order; those in no text are left out."""
    hits = F.filter(F.transform(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(keywords)]), lambda s: s), lambda s: F.contains(F.lower(column), s["k"]))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    found = df.select(F.explode(hits).alias("s")).groupBy("s.i", "s.k").agg(F.count(F.lit(1)).alias("n"))
    return found.crossJoin(F.broadcast(total)).select(F.col("k").alias("keyword"), "n", (100.0 * F.col("n") / F.col("total")).alias("percent"), "i").orderBy(F.col("n").desc(), "i").drop("i")


def head_buckets(df: DataFrame, column: str, heads: list[str] = HEADS, exact: bool = False, other: str = OTHER) -> DataFrame:
    """bucket, n: the first head that a text starts with. exact: no digit may follow it."""
    c = F.coalesce(F.col(column), F.lit(""))
    starts = (lambda h: F.rlike(c, F.lit(f"^{h}(?![0-9])"))) if exact else (lambda h: F.startswith(c, F.lit(h)))
    bucket = F.coalesce(*[F.when(starts(h), F.lit(h)) for h in heads], F.lit(other))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def share_where(df: DataFrame, condition, name: str = "n") -> DataFrame:
    """One row: how many rows meet a condition, and which percentage that is."""
    n = F.count_if(condition)
    return df.agg(n.alias(name), (100.0 * n / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("percent"))


def has_latex(*columns: str, dollars: bool = False):
    marks = ["\\(", "\\["] + (["$"] if dollars else [])
    out = F.lit(False)
    for c in columns:
        for m in marks:
            out = out | F.contains(F.coalesce(F.col(c), F.lit("")), F.lit(m))
    return out


def extremes(df: DataFrame, column: str, order: str, longest: int = 100) -> DataFrame:
    """kind, length, preview of the shortest and longest text that is not empty; the first on a tie."""
    held = df.where(F.length(column) > 0)
    pick = lambda sign: F.min_by(F.struct(F.length(column).alias("length"), F.substring(column, 1, longest).alias("preview")), F.struct((F.length(column) * sign).alias("n"), F.col(order).alias("o")))
    row = held.agg(F.array(F.struct(F.lit("shortest").alias("kind"), pick(1).alias("x")), F.struct(F.lit("longest").alias("kind"), pick(-1).alias("x"))).alias("r"))
    return row.select(F.explode("r").alias("r")).select("r.kind", "r.x.length", "r.x.preview")


def extrapolated(df: DataFrame, condition, order: str, first: int = 100) -> DataFrame:
    """One row: rows of the first ones that meet a condition, and the number that all would have at that rate."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    seen = df.orderBy(order).limit(first).agg(F.count_if(condition).alias("k"), F.count(F.lit(1)).alias("m"))
    return seen.crossJoin(total).select("k", "m", "total", F.floor(F.col("k") * F.col("total") / F.greatest(F.col("m"), F.lit(1))).alias("estimate"))


def last_per(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The last value of each key wins."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def filled_forward(df: DataFrame, group: str, order: str, column: str, name: str) -> DataFrame:
    """Adds the last value of a column so far that is not null."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))
