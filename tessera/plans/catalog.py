"""Tables kept by name and version, with tags and notes in a catalogue table beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "name string, version int, path string, tags array<string>, notes map<string,string>"


class Catalog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/_catalog")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def latest(self, name: str) -> int | None:
        return self.entries().where(F.col("name") == name).agg(F.max("version")).first()[0]

    def save(self, df: DataFrame, name: str, tags: list[str] | None = None, notes: dict[str, str] | None = None) -> int:
        """A new version of the name."""
        version = (self.latest(name) or 0) + 1
        path = f"{self.folder}/{name}/version={version}"
        df.write.parquet(path)
        self.spark.createDataFrame([(name, version, path, tags or [], notes or {})], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.folder}/_catalog")
        return version

    def load(self, name: str, version: int | None = None) -> DataFrame:
        """The version, or else the latest."""
        version = version or self.latest(name)
        if version is None:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}/version={version}")

    def tagged(self, tag: str) -> DataFrame:
        return self.entries().where(F.array_contains("tags", tag))
