"""Hard negatives by bit-sliced integer products.

Components become integers, floor(256 * x), and a score is the integer inner product with an anchor. The integers of the
rows are cut into bit planes, and an anchor meets the planes from the most significant one down: after some planes its
score with a row is known but for the planes left, which can add between (2^b - 1) times the sum of the anchor's negative
components and (2^b - 1) times that of its positive ones. These intervals halve with each plane. A row is dropped as soon
as its interval cannot qualify: below the k-th best lower bound where the nearest are wanted, and outside the positive's
range, or below the third best lower bound of rows that surely lie in it, where negatives are wanted. Planes go on
for all pairs of a block while many are left, then pair by pair. Scores of the pairs that are left at the end are exact.

Rows with the same label and integers are one entry with its smallest ids, as many as can ever be returned, so a group of
copies costs one entry. Entries are dealt to blocks of bounded size by their hash, whatever their labels; anchors, the
stated query set, go to every block in batches, and the best of each block are merged. Two passes: positives, then negatives.

Defined results: rows with a null id, a null label or vector, a null or non-finite component, or one of 32,768 or more
in size take no part; rows that repeat count once; rows of one id with other labels or vectors are rows and anchors of
their own, and none is a positive of another; vectors of different length never meet; equal scores go by the smaller id;
a negative or zero positive score follows the same inequality; with fewer rows than wanted all are returned; an empty
table gives no rows; columns beyond id, label and vector are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

POSITIVES = 5
NEGATIVES = 3
#: A component in this many parts, and the largest component.
SCALE = 256
LARGEST = 32_768
#: A negative's score lies between these hundredths of the positive's.
RANGE = (50, 95)
#: Components of the entries of a block at most, and entries.
BLOCK = (1 << 22, 1 << 14)
ENTRIES = 4096
ANCHORS = 256
#: All pairs of a block go on to the next plane while more than one in so many is left.
SPARSE = 16
#: Components that pairs gather at once.
GATHER = 1 << 22


def usable(rows: DataFrame, id_column: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """id, label, v (integers): the rows that take part, each once."""
    slim = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("x"))
    slim = slim.where(f"id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < {LARGEST})")
    return slim.select("id", "label", F.expr(f"transform(x, c -> cast(floor(c * {SCALE}) AS int))").alias("v")).distinct()


class Planes:
    """Scores of a batch of anchors with some entries, plane by plane."""

    def __init__(self, anchors: np.ndarray, entries: np.ndarray):
        self.q, self.x = anchors.astype(np.float64), entries
        self.sign = max(1, int(np.abs(entries).max(initial=0)).bit_length())  # the plane of weight -2^sign
        self.left = self.sign + 1
        self.known = np.zeros((len(anchors), len(entries)), np.int64)
        self.alive = np.ones(self.known.shape, bool)
        # sums fit in the 53 bits of a double: components are below 2^23
        self.below = np.minimum(anchors, 0).sum(1, dtype=np.int64)
        self.above = np.maximum(anchors, 0).sum(1, dtype=np.int64)

    def step(self) -> None:
        """One plane more."""
        self.left -= 1
        weight = -(1 << self.left) if self.left == self.sign else 1 << self.left
        n = int(np.count_nonzero(self.alive))
        if n * SPARSE > self.alive.size:
            plane = ((self.x >> self.left) & 1).astype(np.float64)
            self.known += weight * (self.q @ plane.T).astype(np.int64)
            return
        a, e = np.nonzero(self.alive)
        step = max(1, GATHER // max(1, self.x.shape[1]))
        for s in range(0, n, step):
            i, j = a[s : s + step], e[s : s + step]
            plane = (self.x[j] >> self.left) & 1
            self.known[i, j] += weight * np.einsum("ij,ij->i", self.q[i], plane).astype(np.int64)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """Least and most that the scores can be."""
        rest = (1 << self.left) - 1
        return self.known + rest * self.below[:, None], self.known + rest * self.above[:, None]


LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _kth(values: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row's living values; the least integer where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), LOW)
    masked = np.where(alive, values, LOW)
    return np.partition(masked, masked.shape[1] - k, axis=1)[:, masked.shape[1] - k]


def nearest(planes: Planes, k: int) -> np.ndarray:
    """Which of the living pairs can be among the k best of their anchor; scores are exact then."""
    while planes.left:
        planes.step()
        low, high = planes.bounds()
        planes.alive &= high >= _kth(low, planes.alive, k)[:, None]
    return planes.alive


def between(planes: Planes, least: np.ndarray, most: np.ndarray, k: int) -> np.ndarray:
    """Which living pairs can be among the k best of a range of their anchor; least, most: a row for each anchor, a column for each range."""
    while planes.left:
        planes.step()
        low, high = planes.bounds()
        alive = np.zeros_like(planes.alive)
        for a, z in zip(least.T, most.T, strict=True):
            can = planes.alive & (high >= a[:, None]) & (low <= z[:, None])
            sure = can & (low >= a[:, None]) & (high <= z[:, None])
            alive |= can & (high >= _kth(low, sure, k)[:, None])
        planes.alive = alive
    return planes.alive


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32, copy=False).reshape(len(column), width)


class _Block:
    """The entries of a block, in the order of their labels."""

    def __init__(self, parts: list[pa.RecordBatch], width: int):
        rows = pa.Table.from_batches(parts).combine_chunks()
        labels = rows.column("label").to_numpy()
        order = np.argsort(labels, kind="stable")
        self.labels = labels[order]
        self.x = _matrix(rows.column("v").combine_chunks(), width)[order]
        ids = rows.column("ids").to_pylist()
        self.ids = [ids[i] for i in order.tolist()]

    def pieces(self) -> Iterator[tuple[int, int]]:
        for s in range(0, len(self.labels), ENTRIES):
            yield s, min(s + ENTRIES, len(self.labels))


def _positives(block: _Block, asks: pa.RecordBatch, width: int, k: int) -> Iterator[tuple]:
    """key, id, score: in the block, the best other rows of an anchor's label."""
    labels, q = asks.column("label").to_numpy(), _matrix(asks.column("v"), width)
    keys, own = asks.column("key").to_pylist(), asks.column("id").to_pylist()
    for label in np.unique(labels):
        of = np.flatnonzero(labels == label)
        a, z = np.searchsorted(block.labels, label), np.searchsorted(block.labels, label, side="right")
        for s in range(a, z, ENTRIES):
            planes = Planes(q[of], block.x[s : min(z, s + ENTRIES)])
            alive = nearest(planes, k + 1)  # one more than wanted, for the anchor can be among them
            for i, anchor in enumerate(of.tolist()):
                at = np.flatnonzero(alive[i])
                best = sorted((-score, v) for score, e in zip(planes.known[i, at].tolist(), at.tolist(), strict=True) for v in block.ids[s + e] if v != own[anchor])
                for score, v in best[:k]:
                    yield keys[anchor], v, -score


def _negatives(block: _Block, asks: pa.RecordBatch, width: int, k: int) -> Iterator[tuple]:
    """key, positive score, id, score: in the block, the best rows of other labels in the range of a positive's score."""
    labels, q = asks.column("label").to_numpy(), _matrix(asks.column("v"), width)
    keys, wanted = asks.column("key").to_pylist(), [sorted(w) for w in asks.column("wanted").to_pylist()]
    most = max(map(len, wanted))
    least_of, most_of = np.full((len(keys), most), HIGH), np.full((len(keys), most), LOW)
    for i, scores in enumerate(wanted):
        for j, score in enumerate(scores):
            least_of[i, j], most_of[i, j] = -(-RANGE[0] * score // 100), RANGE[1] * score // 100
    for s, z in block.pieces():
        planes = Planes(q, block.x[s:z])
        planes.alive &= labels[:, None] != block.labels[None, s:z]
        alive = between(planes, least_of, most_of, k)
        for i, scores in enumerate(wanted):
            at = np.flatnonzero(alive[i])
            found = list(zip(planes.known[i, at].tolist(), at.tolist(), strict=True))
            for j, score in enumerate(scores):
                inside = sorted((-n, v) for n, e in found if least_of[i, j] <= n <= most_of[i, j] for v in block.ids[s + e])
                for n, v in inside[:k]:
                    yield keys[i], score, v, -n


def _blocks(batches: Iterator[pa.RecordBatch], answer, k: int, types: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    """Entries of a block (kind 0) come before its anchors (kind 1)."""
    home, parts, block = None, [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("width", "block", "kind")])
        edges = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(0))))
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), b.num_rows], strict=True):
            piece, (width, number, kind) = b.slice(a, z - a), keys[:, a].tolist()
            if (width, number) != home:
                home, parts, block = (width, number), [], None
            if kind == 0:
                parts.append(piece)
            elif parts:
                block = block or _Block(parts, width)
                for s in range(0, piece.num_rows, ANCHORS):
                    rows = list(answer(block, piece.slice(s, ANCHORS), width, k))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], [n for n, _ in types])


def _dealt(entries: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows of blocks: entries by the hash of their vector, anchors to all blocks of their width."""
    spark = entries.sparkSession
    sizes = entries.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each length of vectors
    blocks = {r.w: -(-r.n // max(1, min(BLOCK[1], BLOCK[0] // max(1, r.w)))) for r in sizes}
    # few blocks: each is read by several groups of anchors, so that there is work for all
    groups = {w: max(1, -(-2 * shuffle_partitions(spark) // n)) for w, n in blocks.items()}
    of = lambda numbers: F.coalesce(*[F.when(F.size("v") == w, F.lit(n)) for w, n in numbers.items()], F.lit(1))
    place, group = F.pmod(F.xxhash64("v"), of(blocks)), F.pmod(F.xxhash64("key"), of(groups))
    nothing = F.lit(None).cast("long")
    rows = entries.select(F.size("v").alias("width"), F.explode(F.sequence(F.lit(0), of(groups) - 1)).alias("g"), place.alias("e"), F.lit(0).alias("kind"), nothing.alias("key"), nothing.alias("id"), "label", "v", "ids", F.lit(None).cast("array<long>").alias("wanted"))
    asks = anchors.select(F.size("v").alias("width"), group.alias("g"), F.explode(F.sequence(F.lit(0), of(blocks) - 1)).alias("e"), F.lit(1).alias("kind"), "key", "id", "label", "v", F.lit(None).cast("array<long>").alias("ids"), "wanted")
    dealt = rows.unionByName(asks).withColumn("block", F.col("e").cast("long") * of(groups) + F.col("g")).drop("e", "g")
    return dealt.repartition("width", "block").sortWithinPartitions("width", "block", "kind")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """rows: from `usable`; anchors: those of them that are anchors. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    copies = Window.partitionBy("label", "v").orderBy("id")
    few = max(positives + 1, negatives)
    kept = rows.withColumn("r", F.row_number().over(copies)).where(F.col("r") <= few)
    entries = cut(kept.groupBy("label", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    anchors = cut(anchors.select(F.xxhash64("id", "label", "v").alias("key"), "id", "label", "v"))
    found = _dealt(entries, anchors.withColumn("wanted", F.lit(None).cast("array<long>"))).mapInArrow(
        lambda batches: _blocks(batches, _positives, positives, [("key", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())]), "key long, positive_id long, positive_score long"
    )
    # a row of one id with several vectors counts with each of them
    first = Window.partitionBy("key").orderBy(F.col("positive_score").desc(), "positive_id")
    best = cut(found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives).drop("r"))
    asks = anchors.join(best.groupBy(F.col("key").alias("k")).agg(F.collect_set("positive_score").alias("wanted")), F.col("key") == F.col("k")).drop("k")
    found = _dealt(entries, asks).mapInArrow(
        lambda batches: _blocks(batches, _negatives, negatives, [("key", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())]),
        "key long, positive_score long, negative_id long, negative_score long",
    )
    first = Window.partitionBy("key", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    named = best.join(anchors.select("key", F.col("id").alias("anchor_id")), "key")
    return named.join(ranked, ["key", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(vectors.select("vec_id", label.alias("label"), "embedding"))
    return hard_negatives(rows, rows.where("id % 50 = 0"))


OP12_SQL = """
WITH rows AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.id AS anchor_id, a.label AS anchor_label, r.id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM rows a, rows r WHERE a.id % 50 = 0 AND a.id <> r.id),
positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scored WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id)::INT AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
