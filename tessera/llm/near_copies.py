"""Near copies at a given Jaccard similarity of shingle sets, over the Gray-order hierarchical index of SimHashes.

First all sets go through the index as it is in `simhash.py`: 64-bit SimHashes under upper nodes of blocks of bits that
lead in turn, in Gray order, searched for all within NEAR bits (`simhash.links`). What it links is decided by the exact
similarity of the sets.

A pair at similarity 0.8 differs in some 15 % of the bits of its SimHashes: so many bits apart leave no block of them
whole to look a partner up by, and 64 bits are too rough to tell such a pair from one at 0.6. So a wider search follows for the links that
the first left open. Its fingerprints have 512 bits, its upper nodes are bands of the sets' MinHashes (32 bands of four: a
pair at 0.8 shares none once in 20 million times), and below them the tree of `simhash.group_pairs` prunes whole groups by their accumulated differences: beyond a
radius, a pair is no candidate. Bits are independent, so the chance that a pair at 0.8 is beyond it follows from the sizes
of the sets: the majorities of 4 and 5 shingles differ in 0.19 of the bits, those of all larger pairs in 0.16 at most, and
the radius of each is over six standard deviations behind that (lost: one such pair in 10^11, and one in 10^9). What is
left is decided by the exact similarity of the sets.

Equal sets are one. Behind the index, one round compares the members of a band with two of them, which joins nearly all true copies. Then
bands that still hold several components are searched for members of different components within the radius: the search
gives a row for each such member, never a row for each pair. Members that candidates connect come together with their texts in
one task, which looks for links between components there, the closest first, and gives only those that join two.
Bands with more than `rows` members are dealt as pairs of blocks.

Defined results: null text counts as empty; fewer words than a shingle make one shingle of all words; texts without
words are copies of each other and of nothing else; rows that repeat get one component; a null doc_id gets the component of its group,
and null if no other id is in it; an empty table gives no rows; columns beyond doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, map_arrow
from .simhash import gray_rank, group_pairs, joined, links, shingle_hashes, slim_rows, stars, text_hash, whole_groups

#: Bands of a MinHash and hash functions in each; multipliers are odd.
BANDS, BAND_ROWS = 32, 4
MULTIPLY, ADD = np.random.default_rng(42).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64)
MULTIPLY |= np.uint64(1)
#: Words of a fingerprint, the numbers that give each of them other bits, and the bits in which candidates may differ.
WIDTH = 8
TWIST = np.random.default_rng(43).integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
RADIUS = 17 * WIDTH
#: The same where the smaller set has as many members as this, or fewer.
SMALL, SMALL_RADIUS = 4, 20 * WIDTH
#: Bits of the first word in which fingerprints that the index links may differ.
NEAR = 3
#: Members of a band that one task compares; beyond, pairs of blocks.
ROWS = 2048
#: Pairs of one member that one task confirms.
DEALT = 500


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of the set's MinHash: the least values of the band's hash functions, and the band's number."""
    least = np.full(BANDS * BAND_ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[at : at + 512, None] * MULTIPLY + ADD).min(0), out=least)
    rows = least.astype("<u8").reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDTH words: bit b is 1 if over half of the hashes have it after a mix of their own for each word."""
    counts = np.zeros(64 * WIDTH, np.int64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * TWIST
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        counts += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")


def with_sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash, id (of the set of shingles), n (its size), keys (of its bands; none if it is empty) and print."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, sizes, keys, prints = [], [], [], []
        for text in b.column("text"):
            hashes = np.unique(shingle_hashes(text.as_py() or "", shingle))
            ids.append(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), 42))
            sizes.append(len(hashes))
            keys.append(band_keys(hashes) if len(hashes) else None)
            prints.append(wide_fingerprint(hashes).view(np.int64))
        columns = [b.column("doc_id"), b.column("text_hash"), pa.array(np.array(ids, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "id", "n", "keys", "print"])

    return map_arrow(slim_rows(docs), batch, "doc_id long, text_hash long, id long, n int, keys array<long>, print array<long>")


def apart(a: str, b: str) -> Column:
    """Bits in which two columns of fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def texts_of(ids: DataFrame, docs: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """ids: column id. id and text, one of the texts with that set."""
    wanted = firsts.join(ids, "id").select("id", F.col("text_hash").alias("h"))
    texts = docs.select(text_hash().alias("text_hash"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return scratch.stored(wanted.join(texts, F.col("h") == F.col("text_hash")).select("id", "text").dropDuplicates(["id"]))


def confirmed(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, shingle: int, similarity: float, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of set ids whose sets have a Jaccard similarity of `similarity` or more."""

    def batch(r: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held, of, keep = None, None, []
        for x, y in zip(r.column("x"), r.column("y"), strict=True):
            x, y = x.as_py(), y.as_py()
            if x != held:
                held, of = x, np.unique(shingle_hashes(x, shingle))
            keep.append(jaccard(of, np.unique(shingle_hashes(y, shingle))) >= similarity)
        yield pa.RecordBatch.from_arrays([r.column("a"), r.column("b")], ["a", "b"]).filter(pa.array(keep))

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, firsts, scratch)
    # a member of many pairs is dealt to several tasks
    often = scratch.stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / DEALT).cast("int").alias("parts")))
    left = often.join(texts, often.a == texts.id).select(F.col("a").alias("l"), F.col("text").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = pairs.join(often, "a").select("a", "b", F.pmod(F.hash("b"), "parts").alias("p"))
    right = dealt.join(texts, dealt.b == texts.id).select("a", "b", "p", F.col("text").alias("y"))
    return map_arrow(right.join(left, (F.col("a") == F.col("l")) & (F.col("p") == F.col("part"))).select("a", "b", "x", "y"), batch, "a long, b long")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def index_pairs(firsts: DataFrame, similarity: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets that the hierarchical index of 64-bit SimHashes links, as stars, or whose SimHashes are equal.

    The SimHash is the first word of the print. Each one's set of the smallest id stands for it in the index.
    """
    prints = scratch.stored(firsts.where("n > 0").select("id", "n", F.element_at("print", 1).alias("fp")))
    head = F.min(F.struct("id", "n")).alias("h")
    heads = scratch.stored(prints.groupBy("fp").agg(head).select(F.col("fp").alias("of"), F.col("h.id").alias("a"), F.col("h.n").alias("m")))
    equal = prints.join(heads, F.col("fp") == F.col("of")).where("id <> a").select("a", "m", F.col("id").alias("b"), "n")
    stars_ = scratch.stored(links(heads.select(F.col("of").alias("fp")), scratch, NEAR).toDF("x", "y"))
    other = heads.select(F.col("of").alias("of_b"), F.col("a").alias("b"), F.col("m").alias("n"))
    linked = stars_.join(heads, F.col("x") == F.col("of")).join(other, F.col("y") == F.col("of_b")).select("a", "m", "b", "n")
    return equal.union(linked).where(F.least("n", "m") >= similarity * F.greatest("n", "m")).select("a", "b").distinct()


def open_members(state: DataFrame, drawn: DataFrame, similarity: float, rows: int, scratch: Scratch) -> DataFrame:
    """state: key, id, n, root; drawn: i (an id), print. unit, id, root, print: members that come within the radius of another component.

    A unit is what candidates of one band connect; bands that connect the same members give one unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, 1 << 15):
            _, group = np.unique(some.column("key").to_numpy(), return_inverse=True)
            ids, sizes, labels = (some.column(c).to_numpy() for c in ("id", "n", "root"))
            v = some.column("print").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WIDTH)
            order = np.lexsort((*[gray_rank(v[:, k]) for k in reversed(range(WIDTH))], group))
            group, ids, sizes, labels, v = group[order], ids[order], sizes[order], labels[order], v[order]
            _, at, label = np.unique(np.stack([group, labels]), axis=1, return_index=True, return_inverse=True)
            root = at[label.ravel()]

            def across(group=group, v=v, sizes=sizes, root=root) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                # a set that is alike to a small one has at most this many members
                small = np.flatnonzero(sizes * similarity <= SMALL)
                wider = ((small[i], small[j]) for i, j in group_pairs(group[small], v[small], SMALL_RADIUS, root[small])) if len(small) else ()
                for i, j in chain(group_pairs(group, v, RADIUS, root), wider):
                    a, b = sizes[i], sizes[j]
                    keep = (np.minimum(a, b) >= similarity * np.maximum(a, b)) & (root[i] != root[j])
                    if keep.any():
                        yield i[keep], j[keep]

            unit = stars(np.arange(len(ids)), across())
            many = np.bincount(unit, minlength=len(unit))
            members = np.flatnonzero(many[unit] > 1)
            if not len(members):
                continue
            members = members[np.lexsort((ids[members], unit[members]))]
            edges = np.flatnonzero(np.append(True, unit[members][1:] != unit[members][:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(members)), strict=True):
                own = members[a:b]
                name = np.uint64(xxhash.xxh64_intdigest(ids[own].tobytes(), 7)).view(np.int64)
                columns = [pa.array(np.full(len(own), name)), pa.array(ids[own]), pa.array(labels[own]), pa.array(list(v[own].view(np.int64)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["unit", "id", "root", "print"])

    parts = F.ceil(F.col("c") / rows).cast("int")
    counted = scratch.stored(state.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select(F.col("key").alias("k"), parts.alias("parts")))
    held = state.join(counted, F.col("key") == F.col("k")).join(drawn, F.col("id") == F.col("i"))
    block = F.pmod(F.hash("id"), "parts")
    spots = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.xxhash64("key", F.least(block, j), F.greatest(block, j)))
    dealt = held.select(F.explode(spots).alias("key"), "id", "n", "root", "print")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "unit long, id long, root long, print array<long>")


def linked_units(units: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """units: unit, id, root, print, text. Links (a, b) that join all components which links of a unit join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in whole_groups(batches, 1 << 12):
            units = some.column("unit").to_numpy()
            edges = np.flatnonzero(np.append(True, units[1:] != units[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(units)), strict=True):
                own = some.slice(int(a), int(b - a)).combine_chunks()
                found = list(_links(own, shingle, similarity))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def _links(own: pa.Table, shingle: int, similarity: float) -> Iterator[tuple[int, int]]:
    ids = own.column("id").to_pylist()
    _, root = np.unique(own.column("root").to_numpy(), return_inverse=True)
    v = own.column("print").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WIDTH)
    sets = [np.unique(shingle_hashes(t.as_py(), shingle)) for t in own.column("text")]
    sizes = np.array([len(s) for s in sets])
    near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(ids) - 1):
        j = np.arange(i + 1, len(ids))
        j = j[(root[j] != root[i]) & (np.minimum(sizes[j], sizes[i]) >= similarity * np.maximum(sizes[j], sizes[i]))]
        far = np.bitwise_count(v[j] ^ v[i]).sum(1, dtype=np.int64)
        keep = far <= np.where(np.minimum(sizes[j], sizes[i]) <= SMALL, SMALL_RADIUS, RADIUS)
        near.append((far[keep], np.full(keep.sum(), i), j[keep]))
    if not near:
        return
    far, one, two = (np.concatenate(c) for c in zip(*near, strict=True))
    for k in np.argsort(far, kind="stable").tolist():
        i, j = int(one[k]), int(two[k])
        if root[i] != root[j] and jaccard(sets[i], sets[j]) >= similarity:
            root[root == root[j]] = root[i]
            yield ids[i], ids[j]


def roots_of(firsts: DataFrame, docs: DataFrame, shingle: int, similarity: float, rows: int, scratch: Scratch) -> DataFrame:
    """firsts: id, text_hash, n, keys, print of distinct sets. node and root, for each set with a link."""
    cells = firsts.select(F.explode("keys").alias("key"), "id")
    shared = cells.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("key").alias("k"))
    sizes = firsts.select(F.col("id").alias("i"), "n")
    members = cells.join(shared, F.col("key") == F.col("k")).select("key", "id")
    members = scratch.stored(members.join(sizes, F.col("id") == F.col("i")).select("key", "id", "n"))
    drawn = firsts.select(F.col("id").alias("i"), "print")
    edges, roots = None, docs.sparkSession.createDataFrame([], "node long, root long")
    for turn in ("index", "heads", "open"):
        state = members.join(roots, members.id == roots.node, "left").select("key", "id", "n", F.coalesce("root", "id").alias("root"))
        if turn == "index":
            pairs = scratch.stored(index_pairs(firsts, similarity, scratch))
            if pairs.isEmpty():
                continue
            found = confirmed(pairs, docs, firsts, shingle, similarity, scratch)
        elif turn == "heads":
            head = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id").alias("a"), F.col("n").alias("m"), F.col("root").alias("to"))) for k in range(2)]
            heads = state.groupBy("key").agg(F.array(*head).alias("heads"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
            heads = scratch.stored(heads.select(F.col("key").alias("k"), F.explode("heads").alias("head")).select("k", "head.a", "head.m", "head.to"))
            alike = (F.col("root") != F.col("to")) & (F.least("n", "m") >= similarity * F.greatest("n", "m"))
            pairs = state.join(heads, F.col("key") == F.col("k")).where(alike).select("a", F.col("id").alias("b"), F.least("n", "m").alias("least")).distinct()
            pairs = pairs.join(drawn, F.col("a") == F.col("i")).select("a", "b", "least", F.col("print").alias("one"))
            pairs = pairs.join(drawn, F.col("b") == F.col("i")).where(apart("one", "print") <= F.when(F.col("least") <= SMALL, SMALL_RADIUS).otherwise(RADIUS))
            pairs = scratch.stored(pairs.select("a", "b"))
            if pairs.isEmpty():
                continue
            found = confirmed(pairs, docs, firsts, shingle, similarity, scratch)
        else:
            units = scratch.stored(open_members(state, drawn, similarity, rows, scratch).dropDuplicates(["unit", "id"]))
            if units.isEmpty():
                break
            texts = texts_of(units.select("id").distinct(), docs, firsts, scratch)
            found = linked_units(units.join(texts, "id"), shingle, similarity)
        found = found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = scratch.stored(found if edges is None else edges.union(found))
        roots = joined(edges, scratch)
    return roots


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, root, component_id: components of texts whose sets of shingles have a Jaccard similarity of `similarity` or more."""
    prints = cut(with_sketches(docs, shingle))
    sets = prints.groupBy("id").agg(F.min("doc_id").alias("first"), F.min(F.struct("text_hash", "n", "keys", "print")).alias("s"))
    firsts = cut(sets.select("id", "first", "s.text_hash", "s.n", "s.keys", "s.print"))
    with Scratch(docs.sparkSession) as scratch:
        roots = roots_of(firsts, docs, shingle, similarity, rows, scratch)
        classes = cut(firsts.join(roots, firsts.id == roots.node, "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    least = cut(classes.groupBy("root").agg(F.min("first").alias("component_id")))
    of = classes.join(least, "root").select(F.col("id").alias("i"), "root", "component_id")
    return prints.join(of, prints.id == of.i).select("doc_id", "text_hash", "root", "component_id")
