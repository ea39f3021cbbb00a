"""JSON whose shape differs from row to row, as VARIANT: tool schemas, judges' answers, typed columns of chosen paths.

Text is parsed once into the binary form; a path that a row lacks, or whose value does not cast, is null there and breaks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a fenced block that a model puts around its JSON answer.
FENCE = "(?s)^\\s*```(?:json)?\\s*(.*?)\\s*```\\s*$"


def parsed(c: Column | str) -> Column:
    """The VARIANT of JSON text, in a fenced block or not; null where it does not parse."""
    return F.try_parse_json(F.regexp_replace(F.col(c) if isinstance(c, str) else c, FENCE, "$1"))


def at(c: Column, paths: list[str], kind: str) -> Column:
    """The first of the paths that a row has with a value of the type."""
    return F.coalesce(*(F.try_variant_get(c, p, kind) for p in paths))


def judge_scores(df: DataFrame, column: str = "answer", parts: tuple[str, ...] = ("accuracy", "style")) -> DataFrame:
    """df with a whole-number score for each part of a judge's answer; all null if one is missing, as the answer is then broken.

    A score may be a number or text that holds one, at <part>.score or, from terser judges, at <part> itself.
    """
    v = df.withColumn("__v", parsed(column))
    scores = {p: at(F.col("__v"), [f"$.{p}.score", f"$.{p}"], "int") for p in parts}
    whole = v.withColumns({f"__{p}": c for p, c in scores.items()})
    complete = F.lit(True)
    for p in parts:
        complete = complete & F.col(f"__{p}").isNotNull()
    return whole.withColumns({p: F.when(complete, F.col(f"__{p}")) for p in parts}).drop("__v", *(f"__{p}" for p in parts))


def tools(df: DataFrame, key: str, column: str = "tools") -> DataFrame:
    """(key, pos, name, description, schema): each function of a row's tools; schema is the VARIANT of its parameters.

    A row holds an array of tools or a single one; a tool is wrapped in "function" or not, and names its schema
    "parameters" or "input_schema". What has no name is no tool; text that does not parse gives no rows.
    """
    v = df.select(F.col(key).alias("__key"), parsed(column).alias("__v")).where("__v IS NOT NULL")
    array = F.schema_of_variant("__v").startswith("ARRAY")
    v = v.select("__key", F.when(array, F.col("__v")).otherwise(F.try_parse_json(F.concat(F.lit("["), F.to_json("__v"), F.lit("]")))).alias("__v"))
    each = v.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__v").outer())).select("__key", F.col("pos"), F.col("value").alias("tool"))
    first = lambda name, kind: at(F.col("tool"), [f"$.function.{name}", f"$.{name}"], kind)
    schema = F.coalesce(first("parameters", "variant"), first("input_schema", "variant"))
    return each.select(F.col("__key").alias(key), "pos", first("name", "string").alias("name"), first("description", "string").alias("description"), schema.alias("schema")).where("name IS NOT NULL")


def tool_parameters(df: DataFrame, key: str, column: str = "tools") -> DataFrame:
    """(key, pos, name, parameter, type, required): the parameters of every tool, whatever each row calls and types them.

    A type is the schema's, 'any' where it has none; a schema that is no object of properties gives no rows.
    """
    found = tools(df, key, column).select(F.col(key).alias("__key"), "pos", "name", F.try_variant_get("schema", "$.properties", "variant").alias("__p"), F.coalesce(F.try_variant_get("schema", "$.required", "array<string>"), F.array().cast("array<string>")).alias("__r"))
    found = found.withColumnRenamed("pos", "__pos").where("__p IS NOT NULL").where(F.schema_of_variant("__p").startswith("OBJECT"))
    each = found.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("__p").outer()))
    return each.select(F.col("__key").alias(key), F.col("__pos").alias("pos"), "name", F.col("key").alias("parameter"), F.coalesce(F.try_variant_get("value", "$.type", "string"), F.lit("any")).alias("type"), F.array_contains("__r", F.col("key")).alias("required"))


def shredded(df: DataFrame, column: str, paths: dict[str, tuple[str, str]], rest: str | None = None) -> DataFrame:
    """df with a typed column for each path (name -> (path, type)) of a JSON column; rest: name of a column for the whole VARIANT.

    The typed columns are plain Parquet columns once written, with statistics that filters can use.
    """
    v = df.withColumn("__v", parsed(column))
    v = v.withColumns({name: F.try_variant_get("__v", path, kind) for name, (path, kind) in paths.items()})
    return v.withColumnRenamed("__v", rest) if rest else v.drop("__v")


def merged_schema(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by, schema, n, broken): the schema that all of a group's values fit in, their number, and texts that do not parse."""
    v = df.select(*by, F.col(column).alias("__t"), parsed(column).alias("__v"))
    return v.groupBy(*by).agg(F.schema_of_variant_agg("__v").alias("schema"), F.count("__v").alias("n"), F.count_if(F.col("__t").isNotNull() & F.col("__v").isNull()).alias("broken"))
