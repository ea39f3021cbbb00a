"""Mixing sources to target weights along a time-varying curriculum.

Targets come from a water-filling over the sources: each asks for its share by weight of `budget_share` times all words,
no source goes beyond `max_repeats` times its own words, and what is cut off is shared out again by weight.

Inside a source, documents stand in the order of a hash of their id, one pass after the other, on an axis of words. The
mix takes that axis up to the target, so each source meets its target to the word; one document a source can be taken in
part. A source's weight over training time t in [0, 1] is 1 + slope * (2t - 1); its integral says which share of the
source's demand is met by t, and the inverse of that integral turns a place on the word axis into a training position.
Positions of all sources share one axis, by which documents are range-sorted.

Running sums are in two levels, hash buckets and rows inside a bucket, so a source that holds most rows is spread over as
many tasks as it has buckets.

Defined results: null text counts 0 words; a null source is a source of its own, last in order; a null doc_id hashes as
the text "null"; rows that repeat are separate documents with equal results up to their order; an empty table gives no
rows; columns that clash with ours are not read and not returned by `plan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, table

WEIGHTS = (3.0, 1.0, 2.0)
#: How the weight of a source changes over training, by the place of its weight in WEIGHTS.
SLOPES = (-0.5, 0.5, 0.0)
BUDGET_SHARE = 1.5
MAX_REPEATS = 2
#: Rows of a bucket, in the mean; the bucket count follows the rows.
BUCKET_ROWS = 4096


def _pick(values: tuple[float, ...], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.pmod(rank - 1, F.lit(len(values))) + 1).cast("int"))


def source_targets(
    sources: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget_share: float = BUDGET_SHARE,
    max_repeats: int = MAX_REPEATS,
    slopes: tuple[float, ...] = SLOPES,
) -> DataFrame:
    """sources: one row (source, source_size) per source. Adds weight, slope and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name)).select(
        "source",
        "source_size",
        _pick(weights, F.col("rank")).alias("weight"),
        _pick(slopes, F.col("rank")).alias("slope"),
        (F.col("source_size") * F.lit(float(max_repeats))).alias("most"),
    )
    by_need = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(budget_share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    capped = ranked.withColumn("capped", left * F.col("weight") >= F.col("most") * weight_left)
    spare = F.lit(budget_share) * F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("most")).otherwise(spare * F.col("weight") / open_weight)
    return capped.select("source", "source_size", "slope", target.alias("target"))


def _inverse(x: Column, slope: Column) -> Column:
    """The time t at which t + slope * (t * t - t) = x."""
    b = 1 - slope
    return F.when(slope == 0, x).otherwise((F.sqrt(b * b + 4 * slope * x) - b) / (2 * slope))


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn(
        "__key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    )


def _bucketed(rows: DataFrame, n: int) -> DataFrame:
    """rows with __key get the hash bucket that they fall into when n rows are dealt out."""
    bits = min(30, (n // BUCKET_ROWS).bit_length())
    return rows.withColumn("__bucket", F.shiftright(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), 32 - bits))


def plan(docs: DataFrame, keep: list[str] | None = None, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, position and position2 (of the words that the first and the second pass take; null where it takes none), pass1, pass2.

    keep: columns of docs to carry along.
    """
    measured = _measured(docs)
    slim = cut(measured.select("doc_id", "source", "__size", "__key"))
    stats = slim.groupBy("source").agg(F.sum("__size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    stats = cut(stats)
    n = stats.agg(F.sum("n")).first()[0] or 0
    rows = _bucketed(slim if keep is None else measured, n)
    targets = source_targets(stats.select("source", "source_size"), **options).withColumnRenamed("source", "t_source")
    before = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = _bucketed(slim, n).groupBy("source", "__bucket").agg(F.sum("__size").alias("__sum"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).select(F.col("source").alias("b_source"), F.col("__bucket").alias("b_bucket"), "__before")
    per_bucket = sums.join(targets, sums.b_source.eqNullSafe(targets.t_source)).drop("t_source")
    inside = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "__size").rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("__inside", F.coalesce(F.sum("__size").over(inside), F.lit(0)))
    placed = held.join(per_bucket, held.source.eqNullSafe(per_bucket.b_source) & (held["__bucket"] == per_bucket.b_bucket))
    goal = F.floor(F.col("target") + 0.5)
    start = F.col("__before") + F.col("__inside")
    size = F.col("__size")
    first = F.greatest(F.lit(0), F.least(size, goal - start)).cast("long")
    second = F.greatest(F.lit(0), F.least(size, goal - F.col("source_size") - start)).cast("long")

    def position(at: Column, taken: Column) -> Column:
        return F.when(taken > 0, _inverse((at + taken / 2) / goal, F.col("slope")))

    extra = [c for c in keep or [] if c not in ("doc_id", "source_size", "target", "position")]
    return placed.withColumns({"pass1": first, "pass2": second}).select(
        "doc_id",
        size.alias("size"),
        "source_size",
        "target",
        (F.col("pass1") + F.col("pass2")).alias("taken"),
        position(start, F.col("pass1")).alias("position"),
        position(start + F.col("source_size"), F.col("pass2")).alias("position2"),
        "pass1",
        "pass2",
        *extra,
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, range-sorted by training position: a row for each pass that takes words of a document.

    Columns are those of docs. Where the end of a source's demand falls inside a document, the text ends there.
    """
    # the row travels as one struct, so its names cannot clash with ours
    carried = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))
    held = plan(carried, keep=["row"], **options)
    passes = F.array(F.struct(F.col("pass1").alias("n"), F.col("position").alias("at")), F.struct(F.col("pass2").alias("n"), F.col("position2").alias("at")))
    taken = held.withColumn("taken_as", F.explode(passes)).where("taken_as.n > 0")
    whole = F.col("taken_as.n") == F.col("size")
    first_words = F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("taken_as.n").cast("string"), F.lit("}+"))
    text = F.when(whole, F.col("row.text")).otherwise(F.regexp_substr("row.text", first_words))
    # the text is cut behind the shuffle, which carries it once
    taken = taken.repartitionByRange(F.col("taken_as.at"), F.col("doc_id")).sortWithinPartitions("taken_as.at", "doc_id")

    def column(c: str):
        if c == "text":
            return text.alias(c)
        if c == "n_chars":
            return F.when(whole, F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema[c].dataType).alias(c)
        return F.col("row")[c].alias(c)

    return taken.select(*[column(c) for c in docs.columns])


def op8_curriculum_mixing(spark, sf_dir: str) -> DataFrame:
    planned = plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    ordered = planned.select("doc_id", "size", "source_size", "target", "taken", "position", "position2")
    return ordered.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank, 2.0::DOUBLE * source_size AS most FROM s),
q AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
             CASE (rank - 1) % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS slope FROM r),
b AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
                - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
             sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_weight
      FROM q),
c AS (SELECT *, spare * weight >= most * open_weight AS capped FROM b),
t AS (SELECT source, source_size, slope,
             CASE WHEN capped THEN most ELSE
               (1.5::DOUBLE * sum(source_size) OVER () - sum(CASE WHEN capped THEN most ELSE 0 END) OVER ()) * weight
               / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS target
      FROM c),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, floor(t.target + 0.5) AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, CAST(greatest(0, least(size, goal - start)) AS BIGINT) AS pass1,
             CAST(greatest(0, least(size, goal - source_size - start)) AS BIGINT) AS pass2 FROM p)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, pass1 + pass2 AS taken,
       CASE WHEN pass1 > 0 THEN CASE WHEN slope = 0 THEN (start + pass1 / 2.0::DOUBLE) / goal ELSE
         (sqrt((1 - slope) * (1 - slope) + 4 * slope * ((start + pass1 / 2.0::DOUBLE) / goal)) - (1 - slope)) / (2 * slope) END END AS position,
       CASE WHEN pass2 > 0 THEN CASE WHEN slope = 0 THEN (start + source_size + pass2 / 2.0::DOUBLE) / goal ELSE
         (sqrt((1 - slope) * (1 - slope) + 4 * slope * ((start + source_size + pass2 / 2.0::DOUBLE) / goal)) - (1 - slope)) / (2 * slope) END END AS position2
FROM u
"""
