"""SimHash near-duplicates over a Gray-order hierarchical index.

A fingerprint has 64 bits; bit b is 1 if over half the XXH64 values of the word shingles have it. Fingerprints link when
they differ in at most `radius` bits, and documents that links connect form one component.

Candidates. The 64 bits are cut into radius + 1 blocks; linked fingerprints agree in at least one whole block. For each
block, fingerprints are rotated so that the block leads, and sorted by Gray rank, so the rows that share the block stand
together under one upper node, and near neighbours tend to be close. Below it the tree is built bottom-up: a node covers a few children
and holds the bits in which all of them agree (their mask) and those bits' values. Bits that the node above holds already
count there. A search carries the differences gathered so far from node to node and drops a whole group once they pass
the radius, or once all that the group holds is already joined to the one who searches. An upper node that holds very
many fingerprints is split the same way over its remaining bits before it is dealt to tasks, twice at most, and then by
rows, so no task gets an unbounded group.

Only fingerprints that are distinct enter the index. Each task gives the links of a group as stars (member, smallest
member), which keep the components; those are joined by hash-to-min rounds with checkpoints, in which a row travels for
each node and star only.

`near_copies.py` builds on the same tree for a given Jaccard similarity, of which 64 bits are too rough a measure.

Defined results: null text counts as empty; no words give fingerprint zero, linked like any other; fewer words than a
shingle make one shingle of all words; rows that repeat get one component; a null doc_id gets the component of its
group, and null if no other id is in it; an empty table gives no rows; columns beyond doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, map_arrow, shuffle_partitions, table

BITS = 64
UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: An upper node with more fingerprints than this is split over its other bits.
NODE_ROWS = 4096
FANOUT = 8
#: Pairs of a query and a node that a search holds at once.
FRONT = 1 << 21
#: How often a node can be split.
SPLITS = 2
#: Neighbours of a node that one task reads.
HUB = 4096
#: Edges that one task joins, where a table has no more.
FEW = 4096


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass").translate(UPPER)
    words = raw.split()  # of bytes: at ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    hashes = shingle_hashes(text or "", shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        block = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << b for b in np.flatnonzero(2 * counts > len(hashes)).tolist()))


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def slim_rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash and fp, the fingerprint as a signed long."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = b.column("text")
        values = np.array([fingerprint(texts[i].as_py(), shingle) for i in range(len(texts))], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(values)], ["doc_id", "text_hash", "fp"])

    return map_arrow(slim_rows(docs), batch, "doc_id long, text_hash long, fp long")


def masks_of(bits: list[int], parts: int, agree: int = 1) -> list[int]:
    """bits cut into `parts` blocks; a mask, as a signed long, for each choice of `agree` blocks."""
    edges = [round(i * len(bits) / parts) for i in range(parts + 1)]
    blocks = [sum(1 << b for b in bits[x:y]) for x, y in zip(edges, edges[1:], strict=False)]
    sums = (sum(c) for c in combinations(blocks, agree))
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in sums]


def gray_rank(v: np.ndarray) -> np.ndarray:
    out = v.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


def agreeing(values: np.ndarray, masks: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of nodes from `heads` on: the bits that they all hold with one value, and those values."""
    ones = np.bitwise_and.reduceat(values & masks, heads)
    zeros = np.bitwise_and.reduceat(~values & masks, heads)
    return ones | zeros, ones


def group_pairs(group: np.ndarray, value: np.ndarray, radius: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j with equal group and values that differ in at most radius bits. Sorted by group, then Gray rank.

    value: one 64-bit word a row, or several. root: labels, which the caller may merge from pair to pair; what already
    has one label is not paired any more, and a node all of one label is skipped as a whole.
    """
    n, value = len(value), value.reshape(len(value), -1)
    if n < 2:
        return
    # for each level: the nodes' first leaves, the bits on which their leaves agree, and the values of those
    firsts, masks, values, children = [np.arange(n)], [np.full(value.shape, ~np.uint64(0))], [value], []
    owner, place = group, np.arange(n) - np.searchsorted(group, group)
    while place.max() > 0:
        place = place // FANOUT
        head = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1]))))
        children.append(np.append(head, len(owner)))
        mask, held = agreeing(values[-1], masks[-1], head)
        owner, place = owner[head], place[head]
        firsts.append(firsts[-1][head])
        masks.append(mask)
        values.append(held)
    lasts = [np.append(f[1:], n) for f in firsts]
    top = np.searchsorted(owner, group)
    asks = np.flatnonzero(np.append(firsts[-1][1:], n)[top] - np.arange(n) > 1)  # the last of a group has no later partner
    front = FRONT // value.shape[1]
    done, width = 0, 64
    while done < len(asks):
        part = asks[done : done + width]
        done, width = done + width, min(4 * width, max(64, front // 64))
        if root is not None:
            least, most = ([f(root, k) for k in firsts] for f in (np.minimum.reduceat, np.maximum.reduceat))
        stack = [(len(masks) - 1, part, top[part], np.zeros(len(part), np.int64), np.zeros((len(part), value.shape[1]), np.uint64))]
        while stack:
            level, who, node, gathered, known = stack.pop()
            fresh = masks[level][node] & ~known
            gathered = gathered + np.bitwise_count((value[who] ^ values[level][node]) & fresh).sum(1, dtype=np.int64)
            keep = (gathered <= radius) & (lasts[level][node] > who + 1)
            if level == 0:
                keep &= node > who
            if root is not None:
                keep &= (least[level][node] != root[who]) | (most[level][node] != root[who])
            who, node, gathered = who[keep], node[keep], gathered[keep]
            if not len(who):
                continue
            if level == 0:
                yield who, node
                continue
            known, edges = masks[level][node], children[level - 1]
            span = edges[node + 1] - edges[node]
            cuts = np.append(np.arange(0, len(who), max(1, front // FANOUT)), len(who))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                w = span[a:b]
                offset = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                stack.append((level - 1, np.repeat(who[a:b], w), np.repeat(edges[node[a:b]], w) + offset, np.repeat(gathered[a:b], w), np.repeat(known[a:b], w, 0)))


def stars(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Merges the labels, in place, of what pairs connect: each label is a smallest member."""
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            if not (differ := a != b).any():
                break
            np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
            while (root != root[root]).any():
                root[:] = root[root]
    return root


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 1 << 18) -> Iterator[pa.Table]:
    """A stream sorted by its first column, in tables that hold every value of that column whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            end = int(np.searchsorted(keys, keys[-1]))  # the last key can go on in the next batch
            if end:
                yield pa.Table.from_batches([*held[:-1], batch.slice(0, end)])
                held = [batch.slice(end)]
    if held:
        yield pa.Table.from_batches(held)


def local_links(groups: DataFrame, radius: int) -> DataFrame:
    """groups: (key, fp) in partitions that hold a key whole, sorted by key. Links (a, b) as stars of the groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches):
            _, group = np.unique(some.column(0).to_numpy(), return_inverse=True)
            v = some.column(1).to_numpy().view(np.uint64)
            order = np.lexsort((gray_rank(v), group))
            group, v = group[order], v[order]
            root = np.arange(len(v))
            stars(root, group_pairs(group, v, radius, root))
            far = np.flatnonzero(root != np.arange(len(root)))
            if len(far):
                yield pa.RecordBatch.from_arrays([pa.array(v[far].view(np.int64)), pa.array(v[root[far]].view(np.int64))], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long")


def split(many: DataFrame, masks: list[int], radius: int) -> tuple[DataFrame, list[int]]:
    """many: (key, choice, fp) of nodes that hold too much; masks: the bits that nodes of each choice hold.

    Each node goes to radius + 1 nodes below, by blocks of its other bits: two fingerprints of a node that differ in at
    most radius bits agree in one of those blocks at least. Returns the nodes below and their masks.
    """
    blocks = [masks_of([b for b in range(BITS) if not m >> b & 1], radius + 1) for m in masks]
    table_ = F.element_at(F.lit([[int(x) for x in r] for r in blocks]).cast("array<array<bigint>>"), F.col("choice") + 1)
    cells = F.transform(table_, lambda m, j: F.struct(F.xxhash64("key", j, F.col("fp").bitwiseAND(m)).alias("key"), (F.col("choice") * (radius + 1) + j).cast("int").alias("choice")))
    return many.select("fp", F.explode(cells).alias("c")).select("c.key", "c.choice", "fp"), [m | x for m, r in zip(masks, blocks, strict=True) for x in r]


def links(fps: DataFrame, scratch: Scratch, radius: int = 3, blocks: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """fps: distinct fingerprints in column fp. Stars (a, b) that connect all that links connect.

    blocks: how many blocks the bits are cut into, over radius; blocks - radius of them agree in every link. A node with
    more than node_rows fingerprints is split, and what it is split into once more. Nodes that are too large even then
    hold a cluster that no bits part: they are dealt as pairs of blocks of rows, so that every pair meets in some task.
    """
    blocks = blocks or radius + 1
    masks = masks_of(list(range(BITS)), blocks, blocks - radius)
    cells = F.array(*[F.struct(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))).alias("key"), F.lit(k).alias("choice")) for k, m in enumerate(masks)])
    nodes, found = fps.select("fp", F.explode(cells).alias("c")).select("c.key", "c.choice", "fp"), None
    for turn in range(SPLITS + 1):
        sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "k")
        many = scratch.stored(nodes.join(sizes, F.col("key") == F.col("k")).drop("k"))
        small = many.where(F.col("n") <= node_rows).select("key", "fp")
        found = small if found is None else found.union(small)
        large = many.where(F.col("n") > node_rows)
        if large.isEmpty():
            break
        if turn < SPLITS:
            nodes, masks = split(large, [m & (1 << BITS) - 1 for m in masks], radius)
        else:
            parts = F.ceil(F.col("n") / node_rows).cast("int")
            block = F.pmod(F.hash("fp"), parts)
            spots = F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.xxhash64("key", F.least(block, j), F.greatest(block, j)))
            found = found.union(large.select(F.explode(spots).alias("key"), "fp"))
    return local_links(found.repartition("key").sortWithinPartitions("key"), radius)


def renamed(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """rows with values of `column` replaced as `to` (via, to) says; a value that most rows have is dealt to several tasks."""
    salts = min(64, shuffle_partitions(rows.sparkSession))
    told = to.select("via", "to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    onto = (F.col(column) == F.col("via")) & (F.pmod(F.hash("node"), F.lit(salts)) == F.col("salt"))
    return rows.join(told, onto, "left").withColumn(column, F.coalesce("to", column)).drop("via", "to", "salt")


def components(edges: DataFrame, scratch: Scratch, hub: int = HUB) -> DataFrame:
    """edges (a, b). Smallest label reachable, for each node with an edge: (node, root).

    A round takes the neighbours' least label; a label of which some node learned a smaller one gives way to it
    wherever it stands; then labels are replaced by their own nodes' labels, so the way to the root halves. It ends when nothing
    changes. A node with more than `hub` neighbours is dealt to several tasks, and so are the nodes of one label.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("a", "b").distinct()
    degrees = scratch.stored(both.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / hub).cast("int").alias("parts")).withColumnRenamed("b", "node"))
    pairs = scratch.stored(both.join(degrees, F.col("b") == F.col("node")).select("a", "b", F.pmod(F.hash("a"), "parts").alias("part")))
    labels = scratch.stored(pairs.groupBy("a").agg(F.min("b").alias("m")).join(degrees, F.col("a") == F.col("node")).select("node", F.least("a", "m").alias("root"), "parts"))
    while True:
        told = labels.select("node", "root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"))
        near = pairs.join(told, (F.col("b") == F.col("node")) & (F.col("part") == F.col("p"))).groupBy("a").agg(F.min("root").alias("near"))
        step = scratch.stored(labels.join(near, labels.node == near.a).select("node", "parts", F.col("root").alias("old"), F.least("root", "near").alias("new"), F.col("root").alias("given")))
        lower = step.where("old <> new").groupBy(F.col("old").alias("via")).agg(F.min("new").alias("to"))
        step = scratch.stored(renamed(step, "given", lower).select("node", "parts", "old", F.least("new", "given").alias("root")))
        used = step.select(F.col("root").alias("via")).distinct()
        onward = used.join(step, F.col("via") == F.col("node")).where("root < via").select("via", F.col("root").alias("to"))
        labels = scratch.stored(renamed(step, "root", onward))
        if labels.where("old <> root").isEmpty():
            return labels.select("node", "root")


def joined(edges: DataFrame, scratch: Scratch, few: int = FEW) -> DataFrame:
    """components of a written table of edges; `few` of them or fewer take one task and no rounds, each of which is a dozen shuffles for the driver."""
    if edges.count() > few:
        return components(edges, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            ends = pa.Table.from_batches(held)
            node, at = np.unique(np.concatenate([ends.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
            root = stars(np.arange(len(node)), iter([tuple(at.reshape(2, -1))]))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[root])], ["node", "root"])

    return scratch.stored(edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, root long"))


def linked_rows(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, text_hash, fp, root (the component) and component_id for each row."""
    prints = cut(with_fingerprints(docs, shingle))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    with Scratch(docs.sparkSession) as scratch:
        roots = components(links(firsts.select("fp"), scratch, radius, blocks, node_rows), scratch)
        classes = cut(firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(classes.groupBy("root").agg(F.min("first").alias("component_id")))
    of = classes.join(least, "root").select(F.col("fp").alias("f"), "root", "component_id")
    return prints.join(of, prints.fp == of.f).select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, blocks: int | None = None, node_rows: int = NODE_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: the smallest doc_id that links reach."""
    rows = linked_rows(docs, shingle, radius, blocks, node_rows)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, method=linked_rows, **options) -> DataFrame:
    """One row of docs for each component: the one of the smallest doc_id (null last), then of the least hash of the text.

    method: gives doc_id, text_hash and root for each row. Rows are judged by id and text, so a null or repeated id takes
    no other text along; rows that repeat both are one.
    """
    rows = method(docs, **options).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n")).alias("k")
    chosen = cut(rows.groupBy("root").agg(least).select(F.col("k.doc_id").alias("c_id"), F.col("k.text_hash").alias("c_hash"), F.col("k.n").alias("c_n")))

    def of(some: DataFrame) -> DataFrame:
        return docs.join(some, docs.doc_id.cast("long").eqNullSafe(some.c_id) & (text_hash() == some.c_hash), "left_semi")

    again = chosen.where("c_n > 1")
    if again.isEmpty():
        return of(chosen)
    repeated = of(again).withColumn("__hash", text_hash()).dropDuplicates(["doc_id", "__hash"]).drop("__hash")
    return of(chosen.where("c_n = 1")).union(repeated)


def op5_simhash_components(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
