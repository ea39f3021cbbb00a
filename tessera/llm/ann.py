"""Approximate nearest neighbours by cosine over an inverted multi-index.

Unit vectors are cut into two halves; each half is quantised by its own centroids, and a pair of centroids is a cell. A
query visits cells in the order of the summed distances of its halves to the two centroids; a heap yields the pairs
one after the other. It stops when the cells visited hold the share of all entries that a trial on the training sample
found to reach the wanted recall; entries of visited cells are ranked again by the cosine of the original vectors.

Equal vectors are one entry that keeps its smallest ids, so a group of copies costs one row. Entries are dealt to blocks
of bounded size, whole cells side by side and large cells split; a query goes once to each block that holds cells it
visits and streams past the block's entries, so a task holds one block and one batch of queries.

The sample is bounded (`sample` vectors); every vector is indexed. In a sample neighbours are farther apart than in the
whole, so its trial asks for more rather than less. The share that has to be visited is a matter of the vectors: small
where they cluster; where they do not, as in the sample tables, about half, for no cells part neighbours from others.

Defined results: vectors that are null, zero, of another dimension than most of the sample (the larger on a tie), or hold null or non-finite
components take no part, nor do null ids; rows that repeat count once; rows of one id with other vectors are entries of
their own, but no query finds its own id; ties go to the smaller id; with fewer candidates than k all are returned; an
empty table gives no rows; columns beyond the id and the vector are left alone.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

SAMPLE = 12_000
#: Centroids of a half: the square root of the sample's vectors, up to this.
CENTROIDS = 256
RECALL = 0.97
TRIALS = 300
#: Entries of a block, the least and the most; between them a block holds a quarter of a partition's share.
BLOCK = (1024, 65_536)
BATCH = 256


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        sums, counts = np.zeros_like(centers), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        empty = counts == 0
        centers = np.where(empty[:, None], x[rng.integers(len(x), size=k)], sums / np.maximum(counts, 1)[:, None])
    return centers


class MultiIndex:
    """Centroids of both halves, and how many entries each cell holds."""

    def __init__(self, first: np.ndarray, second: np.ndarray, counts: np.ndarray | None = None):
        self.first, self.second, self.counts = first, second, counts

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self.first.shape[1]
        a, b = x[:, :h], x[:, h:]
        return (self.first**2).sum(1) - 2 * a @ self.first.T, (self.second**2).sum(1) - 2 * b @ self.second.T

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visits(self, a: np.ndarray, b: np.ndarray, wanted: int) -> list[int]:
        """Non-empty cells by summed distance until they hold `wanted` entries, in the order of a heap of pairs."""
        order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        da, db, na, nb = a[order_a].tolist(), b[order_b].tolist(), len(a), len(b)
        ia, ib, counts = order_a.tolist(), order_b.tolist(), self.counts
        heap, out, held = [(da[0] + db[0], 0, 0)], [], 0
        while heap and held < wanted:
            _, i, j = heapq.heappop(heap)
            cell = ia[i] * nb + ib[j]
            if n := counts[cell]:
                out.append(cell)
                held += n
            if j + 1 < nb:
                heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
            if j == 0 and i + 1 < na:
                heapq.heappush(heap, (da[i + 1] + db[0], i + 1, 0))
        return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def trained(sample: np.ndarray, k: int, recall: float = RECALL, centroids: int = CENTROIDS) -> tuple[MultiIndex, float]:
    """The index and the share of entries that reaches the recall on the sample."""
    x = unit(sample)
    half = max(1, x.shape[1] // 2)
    n = max(1, min(centroids, int(np.sqrt(len(x)))))
    index = MultiIndex(kmeans(x[:, :half], n), kmeans(x[:, half:], n) if x.shape[1] > half else np.zeros((1, 0)))
    cells = index.cells(x)
    size = len(index.first) * len(index.second)
    counts = np.bincount(cells, minlength=size)
    trial = np.arange(min(TRIALS, len(x)))
    near = x[trial] @ x.T
    near[trial, trial] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return index, 1.0
    top = np.argpartition(-near, k - 1, axis=1)[:, :k]
    a, b = index.distances(x[trial])
    order = np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(trial), -1), axis=1)
    needs = np.empty(len(trial) * k)
    for t in range(len(trial)):
        reach = np.empty(size)
        reach[order[t]] = np.cumsum(counts[order[t]]) / len(x)
        needs[t * k : (t + 1) * k] = reach[cells[top[t]]]
    return index, float(np.quantile(needs, recall, method="higher"))


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    slim = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    return slim.where("id IS NOT NULL AND v IS NOT NULL AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity')) AND exists(v, c -> c <> 0)")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding", sample: int = SAMPLE, recall: float = RECALL, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query among all vectors with another id."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, column).distinct()
    few = Window.partitionBy("v").orderBy("id")
    classes = cut(rows.withColumn("r", F.row_number().over(few)).where(F.col("r") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    picked = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(sample).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not picked:
        return spark.createDataFrame([], out)
    sizes = np.array([len(r.v) for r in picked])
    counts = np.bincount(sizes)
    width = len(counts) - 1 - int(counts[::-1].argmax())  # the larger on a tie
    index, share = trained(np.array([r.v for r in picked if len(r.v) == width]), k, recall)
    classes = classes.where(F.size("v") == width)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"), width)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(index.cells(unit(x)), pa.int32())], [*b.schema.names, "cell"])

    entries = cut(classes.mapInArrow(celled, "v array<double>, ids array<long>, cell int"))
    counts = np.zeros(len(index.first) * len(index.second), np.int64)
    for r in entries.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[r.cell] = r.n
    index.counts = counts.tolist()
    total = int(counts.sum())
    wanted = max(k + 1, int(np.ceil(share * total)))
    block = block or min(BLOCK[1], max(BLOCK[0], total // (4 * shuffle_partitions(spark))))
    # cells side by side fill blocks; a cell over the size of a block is split
    splits = np.maximum(1, -(-counts // block))
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    shared = spark.sparkContext.broadcast((index, begin, splits))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, begin, splits = shared.value
        for b in batches:
            if b.num_rows:
                cell = b.column("cell").to_numpy()
                h = b.column("h").to_numpy().astype(np.uint64) % splits[cell].astype(np.uint64)
                home = _home(begin, splits, cell, h.astype(np.int64), block)
                nothing = pa.nulls(b.num_rows, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(np.zeros(b.num_rows, np.int32)), b.column("cell"), b.column("ids"), b.column("v"), nothing], ["home", "kind", "cell", "ids", "v", "cells"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, begin, splits = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"), width)
            a, c = index.distances(unit(x))
            rows = []
            for i in range(b.num_rows):
                homes: dict[int, list[int]] = {}
                for cell in index.visits(a[i], c[i], wanted):
                    for s in range(int(splits[cell])):
                        homes.setdefault(int(_home(begin, splits, cell, s, block)), []).append(cell)
                rows += [(home, i, sorted(set(cells))) for home, cells in homes.items()]
            at = pa.array([r[1] for r in rows], pa.int64())
            ids = b.column("id").take(at).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array(np.ones(len(rows), np.int32)), pa.nulls(len(rows), pa.int32()), pa.array([[q] for q in ids], pa.list_(pa.int64())), b.column("v").take(at), pa.array([r[2] for r in rows], pa.list_(pa.int32()))],
                ["home", "kind", "cell", "ids", "v", "cells"],
            )

    shape = "home long, kind int, cell int, ids array<long>, v array<double>, cells array<int>"
    homes = entries.withColumn("h", F.abs(F.xxhash64("v") / 2).cast("long")).mapInArrow(dealt, shape)
    asks = usable(queries, id_column, column).distinct().where(F.size("v") == width).mapInArrow(asked, shape)
    met = homes.union(asks).repartition("home").sortWithinPartitions("home", "kind", "cell")
    found = met.mapInArrow(lambda batches: _ranked(batches, width, k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    # a query of one id with several vectors keeps the best of all
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _home(begin, splits, cell, split, block: int):
    """The block of a split of a cell: where its first entry would stand if cells stood side by side."""
    return begin[cell] // block + split


def _ranked(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Entries of a block (kind 0) come before its queries (kind 1)."""
    home, cells, ids, parts = None, [], [], []
    ready = None
    for b in batches:
        if not b.num_rows:
            continue
        where, kind = b.column("home").to_numpy(), b.column("kind").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (where[1:] != where[:-1]) | (kind[1:] != kind[:-1]))))
        for a, z in zip(edges, np.append(edges[1:], len(where)), strict=True):
            piece = b.slice(int(a), int(z - a))
            if where[a] != home:
                home, cells, ids, parts, ready = where[a], [], [], [], None
            if kind[a] == 0:
                cells.append(piece.column("cell").to_numpy())
                ids += piece.column("ids").to_pylist()
                parts.append(_matrix(piece.column("v"), width))
                ready = None
            elif parts:
                if ready is None:
                    ready = np.concatenate(cells), np.concatenate(parts)
                for s in range(0, piece.num_rows, BATCH):
                    yield from _answers(piece.slice(s, BATCH), *ready, ids, width, k)


def _answers(asks: pa.RecordBatch, cell: np.ndarray, x: np.ndarray, ids: list[list[int]], width: int, k: int) -> Iterator[pa.RecordBatch]:
    q = _matrix(asks.column("v"), width)
    norm, own = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    near = np.full((len(q), len(x)), -np.inf)
    who: dict[int, list[int]] = {}
    for i, visited in enumerate(asks.column("cells").to_pylist()):
        for c in visited:
            who.setdefault(c, []).append(i)
    for c, rows in who.items():
        lo, hi = np.searchsorted(cell, c), np.searchsorted(cell, c, side="right")
        if hi > lo:
            near[rows, lo:hi] = q[rows] @ (x[lo:hi] / norm[lo:hi, None]).T / own[rows, None]
    out: list[tuple[int, int, float]] = []
    most = min(k + 1, len(x))
    floor = np.partition(near, len(x) - most, axis=1)[:, len(x) - most]
    for i, (name,) in enumerate(asks.column("ids").to_pylist()):
        at = np.flatnonzero((near[i] >= floor[i] - 1e-9) & np.isfinite(near[i]))
        exact = (x[at] * q[i]).sum(1) / (norm[at] * own[i])
        pairs = sorted((-s, v) for s, j in zip(exact.tolist(), at.tolist(), strict=True) for v in ids[j] if v != name)
        out += [(name, v, -s) for s, v in pairs[:k]]
    if out:
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
