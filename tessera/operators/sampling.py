"""Order, limits, samples, splits, batches. All by an explicit key, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import held


def hashed(key: str, seed: int) -> Column:
    """A hash of key and seed that other engines have too."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f":{seed}")))


def head(df: DataFrame, order_by: str, n: int) -> DataFrame:
    return df.orderBy(order_by).limit(n)


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, all if there are fewer."""
    return df.orderBy(hashed(key, seed), key).limit(n)


def numbered(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """Adds the position from 0 by the order, without one task for all rows.

    Rows are range-partitioned and sorted; each partition numbers its own and adds the counts of those before it.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    kept = held(dealt)
    counts = kept.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__p").alias("q"), "first", before.alias("before"))
    return kept.join(F.broadcast(offsets), F.col("__p") == F.col("q")).withColumn(name, F.col("__i") - F.col("first") + F.col("before")).select(*df.columns, name)


def slice_rows(df: DataFrame, order_by: str, start: int, stop: int, few: int = 10_000) -> DataFrame:
    """Rows at positions start to stop - 1. Beyond the first few, rows are numbered in ranges instead of held in one queue."""
    if stop <= few:
        return df.orderBy(order_by).offset(start).limit(stop - start)
    return numbered(df, order_by, name="__n").where((F.col("__n") >= start) & (F.col("__n") < stop)).drop("__n")


def _bucket(h: Column) -> Column:
    """The first 16 bits of a hash."""
    return F.conv(F.substring(h, 1, 4), 16, 10).cast("int")


def shuffle_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42, round_up: bool = False) -> DataFrame:
    """Adds split: the last rows in hash order, an exact share of them, are test, the others train.

    The cut is one hash value: a histogram of the hashes' first 16 bits names the bucket that it falls into, and only that
    bucket's keys are sorted. The rows themselves are not moved.
    """
    h = hashed(key, seed)
    keys = df.select(h.alias("h"), F.col(key).alias("k"))
    counts = sorted(keys.groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    n = sum(r.n for r in counts)
    left = math.ceil(n * share) if round_up else int(n * share)
    if left <= 0:
        return df.withColumn("split", F.lit("train"))
    for r in counts:
        if left <= r.n:
            break
        left -= r.n
    cut = keys.where(_bucket(F.col("h")) == r.b).orderBy(F.col("h").desc(), F.col("k").desc()).offset(left - 1).limit(1).first()
    test = (h > cut.h) | (h == cut.h) & (F.col(key).isNull() if cut.k is None else F.col(key) >= cut.k)
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds split: of each stratum the ceiling of the share, in hash order, is test.

    Ranks are in two levels, buckets of the hash and rows inside a bucket, so a stratum is spread over many tasks.
    """
    marked = df.withColumns({"__h": hashed(key, seed)}).withColumn("__b", F.shiftright(_bucket(F.col("__h")), 4))
    counts = marked.groupBy(F.col(stratum).alias("__s"), F.col("__b").alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    sums = counts.select("__s", "__k", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy("__s")).alias("__all"))
    inside = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__h", key))
    ranked = marked.withColumn("__r", inside).join(sums, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__k")))
    test = F.col("__before") + F.col("__r") <= F.ceil(F.col("__all") * share)
    return ranked.withColumn("split", F.when(test, "test").otherwise("train")).select(*df.columns, "split")


def threshold_split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split by a threshold on the hash: about the share, with no shuffle at all."""
    return df.withColumn("split", F.when(F.conv(F.substring(hashed(key, seed), 1, 8), 16, 10).cast("long") < int(share * 2**32), "test").otherwise("train"))


def given_or_split(splits: dict[str, DataFrame], key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Tables of splits as one with a column split; where only train is given, it is split."""
    if "test" in splits:
        return splits["train"].withColumn("split", F.lit("train")).unionByName(splits["test"].withColumn("split", F.lit("test")))
    return shuffle_split(splits["train"], key, share, seed)


def shared_keys(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys that stand in more than one split; none if they are disjoint."""
    return df.groupBy(key).agg(F.count_distinct(split).alias("n")).where("n > 1").select(key)


def batches(df: DataFrame, order_by: str, size: int) -> DataFrame:
    """Adds batch, from 0; the last can be short."""
    return numbered(df, order_by, name="__n").withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")


def repeated(df: DataFrame, times: int, name: str = "copy") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def repeat_sampler(df: DataFrame, order_by: str, mini: int, batch: int, again: int, seed: int = 42) -> DataFrame:
    """Each prompt `mini` times in a row, batches of prompts `again` times; prompts in hash order. Adds slot."""
    spread = numbered(df.withColumn("__h", hashed(order_by, seed)), "__h", order_by, name="__n")
    whole = spread.withColumn("__b", F.floor(F.col("__n") / batch))
    copies = whole.withColumn("__a", F.explode(F.sequence(F.lit(0), F.lit(again - 1)))).withColumn("__m", F.explode(F.sequence(F.lit(0), F.lit(mini - 1))))
    slot = ((F.col("__b") * again + F.col("__a")) * batch + F.col("__n") % batch) * mini + F.col("__m")
    return copies.withColumn("slot", slot).drop("__h", "__n", "__b", "__a", "__m")


def draw_with_replacement(df: DataFrame, order_by: str, n: int, seed: int = 42) -> DataFrame:
    """n rows drawn by hashed positions. Adds draw."""
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("long") % max(total, 1)).alias("__n"))
    return numbered(df, order_by, name="__n").join(draws, "__n").drop("__n")


def grid(spark, **values: list) -> DataFrame:
    """Every combination of the values, a column for each name."""
    out = None
    for name, options in values.items():
        column = spark.createDataFrame([(o,) for o in options], [name])
        out = column if out is None else out.crossJoin(column)
    return out


def renumbered(df: DataFrame, order_by: str, excluded: DataFrame, name: str = "new_index") -> DataFrame:
    """Rows whose key is not excluded, numbered anew without gaps."""
    return numbered(df.join(excluded, order_by, "left_anti"), order_by, name=name)


def roll_over(df: DataFrame, order_by: str, every: int = 5) -> DataFrame:
    """Adds file: p1, p2, ... for each `every` rows in order; the short rest is 'last'."""
    n = df.count()
    filed = batches(df, order_by, every)
    return filed.withColumn("file", F.when(F.col("batch") < n // every, F.concat(F.lit("p"), (F.col("batch") + 1).cast("string"))).otherwise("last")).drop("batch")


def row_at(df: DataFrame, order_by: str, index: int) -> DataFrame:
    """The row at a position from 0; an IndexError beyond the last."""
    found = slice_rows(df, order_by, index, index + 1) if index >= 0 else df.limit(0)
    if found.isEmpty():
        raise IndexError(index)
    return found


def rows_of(df: DataFrame, key: str, *values) -> DataFrame:
    """The rows of some keys; a KeyError names those that are not there."""
    found = df.where(F.col(key).isin(list(values)))
    missing = set(values) - {r[0] for r in found.select(key).distinct().collect()}
    if missing:
        raise KeyError(sorted(missing))
    return found


def preview_rows(df: DataFrame, order_by: str, n: int = 5, longest: int = 300) -> DataFrame:
    """The first rows, long texts cut with an ellipsis."""
    from .web import preview

    cut = [preview(F.col(f.name), longest).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema]
    return head(df, order_by, n).select(*cut)
