"""Retrieval over a corpus: Jaccard top-n, BM25, context assembly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.scores import jaccard

#: Queries that go to the texts at once, and texts that one step compares with them.
QUERIES = 2048
TEXTS = 512


def token_set(c: str) -> Column:
    return F.array_distinct(T.words(T.collapse_spaces(T.remove_ascii_punctuation(F.lower(F.col(c))))))


class _Block:
    """Token hashes of some queries: for each token the queries that hold it."""

    def __init__(self, rows: list, n: int, kind: pa.DataType):
        self.names, self.n = pa.array([r.query for r in rows], kind), n
        self.sizes = np.array([len(r.qt or []) for r in rows], np.int64)
        tokens = np.array([t for r in rows for t in r.qt or []], np.int64)
        of = np.repeat(np.arange(len(rows)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.of = of[order]
        self.tokens, self.first = np.unique(tokens[order], return_index=True)
        self.last = np.append(self.first[1:], len(tokens))

    def similarities(self, flat: np.ndarray, of: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Texts x queries; flat: the texts' token hashes, of: the text of each."""
        at = np.minimum(np.searchsorted(self.tokens, flat), max(0, len(self.tokens) - 1))
        hit = self.tokens[at] == flat if len(self.tokens) else np.zeros(len(flat), bool)
        at, of = at[hit], of[hit]
        width = self.last[at] - self.first[at]
        spot = np.repeat(self.first[at], width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        cell = np.repeat(of, width) * len(self.names) + self.of[spot]
        both = np.bincount(cell, minlength=len(sizes) * len(self.names)).reshape(len(sizes), -1)
        return both / np.maximum(1, sizes[:, None] + self.sizes - both)

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n best of a partition's texts for each query, ties to the smaller key."""
        keys: pa.ChunkedArray | None = None
        held = np.zeros((0, len(self.names)), np.int64), np.zeros((0, len(self.names)))
        count = 0
        every: list[pa.Array] = []
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS).sort_by("key")
                tokens = part.column("ct")
                sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(sizes)), sizes)
                found = self.similarities(tokens.flatten().to_numpy(zero_copy_only=False), of, sizes)
                # of each query the best of this part, by similarity and then by key, which the rows are sorted by
                top = np.argsort(-found, axis=0, kind="stable")[: self.n]
                every.append(part.column("key"))
                held = np.concatenate([held[0], top + count]), np.concatenate([held[1], np.take_along_axis(found, top, 0)])
                count += part.num_rows
        if not count:
            return
        keys = pa.chunked_array(every)
        rows, scores = held
        flat = rows.ravel()
        out = pa.table({"query": self.names.take(pa.array(np.tile(np.arange(len(self.names)), len(rows)))), "key": keys.take(pa.array(flat)), "similarity": scores.ravel()})
        # the best of the parts' best
        out = out.sort_by([("query", "ascending"), ("similarity", "descending"), ("key", "ascending")])
        names = out.column("query").to_pylist()
        keep, seen, last = [], 0, None
        for name in names:
            seen = seen + 1 if name == last else 1
            last = name
            keep.append(seen <= self.n)
        yield from out.filter(pa.array(keep)).to_batches()


def jaccard_top(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, n: int = 2, column: str = "text", block: int = QUERIES) -> DataFrame:
    """(query, key, similarity, rank): the n most similar texts of each query; ties in the order of key.

    Queries go to the texts in blocks of bounded size, as hashes of their tokens; each block is one pass over the corpus
    that gives n rows a query and partition. No pairs of queries and texts are made in Spark.
    """
    hashed = lambda c: F.transform(token_set(c), lambda t: F.xxhash64(t))
    q = queries.select(F.col(query_key).alias("query"), hashed(column).alias("qt")).where("query IS NOT NULL")
    c = corpus.select(F.col(key).alias("key"), hashed(column).alias("ct"))
    shape = f"query {q.schema['query'].dataType.simpleString()}, key {c.schema['key'].dataType.simpleString()}, similarity double"
    blocks = max(1, -(-q.count() // block))
    found = None
    for k in range(blocks):
        asked = _Block(q.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).orderBy("query").collect(), n, to_arrow_type(q.schema["query"].dataType))
        if len(asked.names):
            part = c.mapInArrow(asked.best, shape)
            found = part if found is None else found.union(part)
    if found is None:
        found = c.sparkSession.createDataFrame([], shape)
    w = Window.partitionBy("query").orderBy(F.col("similarity").desc(), "key")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def bm25(queries: DataFrame, corpus: DataFrame, query_key: str, key: str, column: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, key, score): Okapi BM25 with idf = ln(1 + (n - df + 0.5) / (df + 0.5))."""
    tokens = corpus.select(F.col(key).alias("key"), T.terms(column).alias("w")).select("key", F.size("w").alias("dl"), F.explode("w").alias("t"))
    # terms that no query has are not counted
    asked = queries.select(F.explode(T.terms(column)).alias("t")).distinct()
    tokens = tokens.join(asked, "t", "left_semi")
    tf = tokens.groupBy("key", "dl", "t").agg(F.count(F.lit(1)).alias("tf"))
    frequency = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus.agg(F.count(F.lit(1)).alias("n"), F.avg(F.regexp_count(F.lower(F.col(column)), F.lit(T.TERM))).alias("avgdl"))
    wanted = queries.select(F.col(query_key).alias("query"), F.explode(F.array_distinct(T.terms(column))).alias("t"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return wanted.join(tf, "t").join(frequency, "t").crossJoin(F.broadcast(stats)).groupBy("query", "key").agg(F.sum(part).alias("score"))


def normalised(scores: DataFrame, threshold: float = 0.35) -> DataFrame:
    """Scores over the best of their query, and only those at or over the threshold."""
    best = F.max("score").over(Window.partitionBy("query"))
    return scores.withColumn("relevance", F.col("score") / best).where(F.col("relevance") >= threshold)


def context(ranked: DataFrame, corpus: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(query, context): the ranked texts joined by newlines, in rank order."""
    texts = ranked.join(corpus.select(F.col(key).alias("key"), F.col(column).alias("__t")), "key")
    return texts.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "__t"))), lambda s: s["__t"]), "\n").alias("context"))


def answer_or(c: Column, otherwise: str = "No relevant text was found.") -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(otherwise))


def similarity(a: str, b: str) -> Column:
    return jaccard(token_set(a), token_set(b))
