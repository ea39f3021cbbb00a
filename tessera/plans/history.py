"""Seen texts across runs: a history in hash buckets, against which a new batch is merged without moving the past.

The history is a table of text hashes in a fixed number of buckets, each bucket's files sorted by hash. A batch is dealt
to the same buckets; the join reads the history as it lies, so a run shuffles the batch and nothing else, and its cost in the network
follows the batch. Rows go if their text is in the history, or earlier in the batch. What is new is appended, bucketed alike.

Texts are equal if they are after white space is collapsed; null texts are one text. One run writes at a time; a run that fails
before the append leaves the history as it was, and a batch that is merged twice finds its texts seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.cleaning import held

BUCKETS = 64


class SeenHistory:
    """name: of the table in the session's catalogue; folder: where its files lie (all runs give the same two)."""

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS):
        self.spark, self.name, self.folder, self.buckets = spark, name, folder, buckets

    def _hashes(self, batch: DataFrame, column: str) -> DataFrame:
        return batch.withColumn("__h", F.coalesce(T.text_hash(column), F.lit("")))

    def attach(self) -> None:
        """The table in a new session's catalogue, from its files."""
        if not self.spark.catalog.tableExists(self.name):
            self.spark.sql(f"CREATE TABLE {self.name} (h STRING, run INT) USING parquet CLUSTERED BY (h) SORTED BY (h) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")

    def unseen(self, batch: DataFrame, column: str, order_by: str) -> DataFrame:
        """Rows of the batch whose text is not in the history: the first by order_by of each text, with its hash __h."""
        self.attach()
        dealt = self._hashes(batch, column).repartition(self.buckets, "__h")
        past = self.spark.table(self.name).hint("merge")
        new = dealt.join(past, F.col("__h") == F.col("h"), "left_anti")
        return new.withColumn("__r", F.row_number().over(Window.partitionBy("__h").orderBy(order_by))).where("__r = 1").drop("__r")

    def merge(self, batch: DataFrame, column: str, order_by: str, run: int) -> DataFrame:
        """The unseen rows; their texts are seen from now on."""
        new = held(self.unseen(batch, column, order_by))
        rows = new.select(F.col("__h").alias("h"), F.lit(run).cast("int").alias("run")).repartition(self.buckets, "h")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", self.folder).saveAsTable(self.name)
        return new.drop("__h")

    def detach(self) -> None:
        """The table leaves the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
