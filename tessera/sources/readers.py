"""Readers: JSON arrays, CSV, text lines, YAML, splits. Paths go to Spark's readers only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .json_arrays import read_json_arrays

#: Extracted questions, and fetched pages.
QUESTION = "question string, image_url string, solution string, result string, error boolean"
PAGE = "url string, success boolean, method string, content string, html string, error string, duration double, content_length long"
#: Texts that a CSV holds for a missing value.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_json_array(spark: SparkSession, path: str | list[str], schema: str | StructType = QUESTION) -> DataFrame:
    """Records of JSON array files, with file and pos; a file that does not parse gives no rows. Files are read by byte ranges."""
    return read_json_arrays(spark, path, schema)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Quoted CSV with a head line; texts that stand for a missing value are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    df = (reader.schema(schema) if schema else reader).csv(path)
    return df.select(*[F.when(~F.col(f.name).isin(*MISSING), F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in df.schema])


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def read_yaml(spark: SparkSession, path: str) -> dict | None:
    """A settings file, read through Spark; null if it is not there or does not parse."""
    import yaml

    try:
        return yaml.safe_load(spark.read.text(path, wholetext=True).first().value)
    except Exception as error:
        if isinstance(error, yaml.YAMLError) or "PATH_NOT_FOUND" in str(error):
            return None
        raise


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines or Parquet, by the name."""
    return spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def read_splits(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "test", "validation")) -> DataFrame | None:
    """Those of the processed splits that exist, as one table with a column split."""
    out = None
    for split in splits:
        try:
            df = spark.read.json(f"{folder}/processed_{split}.json").withColumn("split", F.lit(split))
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def questions_by_file(spark: SparkSession, folder: str, prefix: str = "crawled_") -> DataFrame:
    """All question files of a folder whose names begin with the prefix; order is that of file names, then position."""
    return read_json_array(spark, f"{folder}/{prefix}*.json").orderBy("file", "pos")


def from_records(spark: SparkSession, records: list[dict], schema: str, repeat: int = 1) -> DataFrame:
    """Rows given in memory, each `repeat` times."""
    df = spark.createDataFrame(records, schema)
    return df if repeat == 1 else df.withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(repeat)))).drop("__k")


def require(df: DataFrame, column: str) -> DataFrame:
    """The table, if it has the column and its first text is not blank; an error otherwise."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    first = df.select(column).limit(1).first()
    if first is None or not str(first[0] or "").strip():
        raise ValueError(f"column {column} begins blank")
    return df
