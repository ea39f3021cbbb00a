"""Texts that are near an earlier one by TF-IDF cosine, exactly, without a row for a term of a text or for a pair.

Texts are packed into blocks, a row each: numbers of terms (hashes of 64 bits) and how often a text has them. A block asks
for the frequency of each of its different terms once. Every block then meets every other in a task of its own (a
product of the table with itself, which needs no shuffle), and only the earliest text near each is kept, so what is
written grows with the texts. The work grows with the square of the texts, as all pairs do; memory is that of two blocks.

With terms ordered from rare to common, the prefix of a unit vector ends where the squared weights left fall to the
threshold's square; two vectors over the threshold share a term in both prefixes. Which terms those are is told once for
each block. In a task the prefixes are multiplied, and only pairs of texts that share a term of them take part: in a
table of all pairs where many do, else by sorting the products. Pairs go on if the product and the most that the weights
behind the shorter prefix can add pass the threshold, and those left are scored over all terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Terms of texts in a block, the least and the most, and the most texts.
BLOCK, TEXTS = (1 << 17, 1 << 21), 1 << 15
#: Products of two weights, and cells of the table that they are summed in, at a time.
PRODUCTS, CELLS = 1 << 22, 1 << 22
LEVELS = 64
#: Cells for one product from which on products are sorted instead of summed in a table.
SPARSE = 16


@contextmanager
def settings(spark: SparkSession, **given: str):
    """Settings of the session for what is executed inside, then as before; names have _ for the dots."""
    names = {k: k.replace("__", ".") for k in given}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, n in names.items():
        spark.conf.set(n, given[k])
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _press(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpress(raw: bytes, kind) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(pa.decompress(raw[8:], decompressed_size=n, codec="zstd", asbytes=True), kind)


def _blocks(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, copies, bag) become blocks; a block's name is the id of its first text."""
    ids, copies, lengths, terms, times, size = [], [], [], [], [], 0

    def packed() -> pa.RecordBatch:
        columns = [pa.array([ids[0]], pa.int64()), *(pa.array([_press(x)], pa.binary()) for x in (np.array(ids, "<i8"), np.array(copies, "<i8"), np.array(lengths, "<i8"), np.concatenate(terms), np.concatenate(times)))]
        return pa.RecordBatch.from_arrays(columns, ["block", "ids", "copies", "lengths", "terms", "times"])

    for b in batches:
        for i, n, bag in zip(*(b.column(c).to_pylist() for c in ("id", "copies", "bag")), strict=True):
            found = Counter(bag.split(" "))
            t = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in found), "<u8", len(found))
            order = np.argsort(t)
            ids.append(i)
            copies.append(n)
            lengths.append(len(t))
            terms.append(t[order])
            times.append(np.fromiter(found.values(), "<i4", len(found))[order])
            size += len(t)
            if size >= entries or len(ids) >= TEXTS:
                yield packed()
                ids, copies, lengths, terms, times, size = [], [], [], [], [], 0
    if ids:
        yield packed()


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, term, n): in how many texts, copies counted, a block has a term."""
    for b in batches:
        for block, copies, lengths, terms in zip(*(b.column(c).to_pylist() for c in ("block", "copies", "lengths", "terms")), strict=True):
            own, where = np.unique(_unpress(terms, "<u8"), return_inverse=True)
            n = np.bincount(where, np.repeat(_unpress(copies, "<i8"), _unpress(lengths, "<i8")), len(own)).astype("<i8")
            for a in range(0, len(own), 1 << 16):
                part = own[a : a + (1 << 16)].view("<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part), pa.array(n[a : a + (1 << 16)])], ["block", "term", "n"])


def _inside(lengths: np.ndarray, terms: np.ndarray, df: np.ndarray, square: np.ndarray, threshold: float) -> np.ndarray:
    """Of each term of each text, whether it is in the text's prefix; square: squared weights."""
    of = np.repeat(np.arange(len(lengths)), lengths)
    # from common to rare: the weight from the commonest term to each
    order = np.lexsort((terms, df, of))[::-1]
    summed = np.cumsum(square[order])
    begins = len(terms) - np.cumsum(lengths)
    before = np.where(begins > 0, summed[begins - 1], 0.0) if len(summed) else np.zeros(len(lengths))
    left = np.empty(len(summed))
    left[order] = summed - before[of[order]]
    return left >= threshold * threshold - 1e-9


def _weighted(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Blocks with frequencies, prefixes and the norm of each text; terms of one text only count in the norm and go."""
    for b in batches:
        for row in b.to_pylist():
            lengths, terms, times = _unpress(row["lengths"], "<i8"), _unpress(row["terms"], "<u8"), _unpress(row["times"], "<i4")
            known = np.array([x["term"] for x in row["found"] or ()], "<i8").view("<u8")
            count = np.array([x["df"] for x in row["found"] or ()], "<i8")
            order = np.argsort(known)
            known, count = known[order], count[order]
            df = np.ones(len(terms), "<i8")
            if len(known):
                at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
                df = np.where(known[at] == terms, count[at], 1)
            of = np.repeat(np.arange(len(lengths)), lengths)
            w = times * (np.log((1 + n) / (1 + df)) + 1)
            norm = np.sqrt(np.bincount(of, w * w, len(lengths)))
            kept = df > 1
            lengths, terms, times, df, weights = np.bincount(of[kept], minlength=len(lengths)).astype("<i8"), terms[kept], times[kept], df[kept], (w / norm[of])[kept]
            inside = _inside(lengths, terms, df, weights * weights, threshold)
            columns = [row["ids"], *(_press(x) for x in (lengths, norm, terms, times, df, inside))]
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), *(pa.array([c], pa.binary()) for c in columns)], ["block", "ids", "lengths", "norms", "terms", "times", "df", "inside"])


class _Block:
    """A block's vectors, terms in order within each text; prefixes, and what weighs behind them."""

    def __init__(self, row: dict, side: str, n: int, threshold: float):
        get = lambda name, kind: _unpress(row[name + side], kind)
        self.ids, lengths, self.terms = get("ids", "<i8"), get("lengths", "<i8"), get("terms", "<u8")
        df = get("df", "<i8")
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.of = np.repeat(np.arange(len(lengths)), lengths)
        self.weights = get("times", "<i4") * (np.log((1 + n) / (1 + df)) + 1) / get("norms", "<f8")[self.of]
        square = self.weights * self.weights
        inside = get("inside", "?") if "inside" + side in row else _inside(lengths, self.terms, df, square, threshold)
        level = np.log2(np.maximum(df, 1)).astype(np.int64)
        mass = np.bincount(self.of * LEVELS + level, square, len(lengths) * LEVELS).reshape(-1, LEVELS)
        #: Of each text: squared weight from each class of frequency (powers of two) on, behind its prefix, and the class where that ends.
        self.rest = np.concatenate((np.cumsum(mass[:, ::-1], axis=1)[:, ::-1], np.zeros((len(lengths), 1))), axis=1)
        self.behind = np.bincount(self.of[~inside], square[~inside], len(lengths))
        self.cut = np.full(len(lengths), LEVELS)
        np.minimum.at(self.cut, self.of[~inside], level[~inside])
        at = np.flatnonzero(inside)
        self.prefix = at[np.argsort(self.terms[at], kind="stable")]


def _runs(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """lo[k], lo[k] + 1 .. for n[k] places, one run after the other."""
    return np.arange(n.sum()) + np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n)


def _shared(a: _Block, b: _Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, product of the prefixes) of the texts of a and of b that share a term of them."""
    terms_b, wide = b.terms[b.prefix], max(1, len(b.ids))
    lo = np.searchsorted(terms_b, a.terms[a.prefix], "left")
    n = np.searchsorted(terms_b, a.terms[a.prefix], "right") - lo
    own, lo, n = a.prefix[n > 0], lo[n > 0], n[n > 0]

    def products(own, lo, n, first):
        with_a, with_b = np.repeat(own, n), b.prefix[_runs(lo, n)]
        return (a.of[with_a] - first) * wide + b.of[with_b], a.weights[with_a] * b.weights[with_b]

    if n.sum() <= min(PRODUCTS, len(a.ids) * wide // SPARSE):
        cell, product = products(own, lo, n, 0)
        cell, where = np.unique(cell, return_inverse=True)
        yield cell // wide, cell % wide, np.bincount(where, product, len(cell))
        return
    step = max(1, CELLS // wide)
    chunk = a.of[own] // step
    order = np.argsort(chunk, kind="stable")
    own, lo, n, chunk = own[order], lo[order], n[order], chunk[order]
    bounds = np.searchsorted(chunk, np.arange(-(-len(a.ids) // step) + 1))
    for c, (x, z) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        dots = np.zeros(min(step, len(a.ids) - c * step) * wide)
        for u, v in _parts(n[x:z]):
            cell, product = products(own[x + u : x + v], lo[x + u : x + v], n[x + u : x + v], c * step)
            dots += np.bincount(cell, product, len(dots))
        cell = np.flatnonzero(dots)
        yield cell // wide + c * step, cell % wide, dots[cell]


def _parts(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of n that add up to some PRODUCTS."""
    ends = np.cumsum(n)
    cuts = np.unique(np.searchsorted(ends, np.arange(PRODUCTS, ends[-1] if len(ends) else 0, PRODUCTS), "right"))
    return ((x, z) for x, z in zip([0, *cuts], [*cuts, len(n)], strict=True) if x < z)


def _places(b: _Block, j: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where text j[k] of b has terms[k], and whether it does: all are bisected at once."""
    lo, hi = b.starts[j], b.starts[j + 1]
    end = hi
    last = max(0, len(b.terms) - 1)
    for _ in range(int((hi - lo).max(initial=0)).bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (b.terms[np.minimum(mid, last)] < terms)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    place = np.minimum(lo, last)
    return place, (lo < end) & (b.terms[place] == terms)


def _near(a: _Block, b: _Block, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts of a and of b whose cosine is over the threshold; of one block, pairs once."""
    if not len(a.prefix) or not len(b.prefix):
        return
    for i, j, dots in _shared(a, b):
        most_a = dots + np.sqrt(a.behind[i] * b.rest[j, a.cut[i]])
        most_b = dots + np.sqrt(b.behind[j] * a.rest[i, b.cut[j]])
        most = np.where(a.cut[i] < b.cut[j], most_a, np.where(a.cut[i] > b.cut[j], most_b, np.maximum(most_a, most_b)))
        on = most > threshold - 1e-9
        if same:
            on &= i < j
        i, j = i[on], j[on]
        long = a.starts[i + 1] - a.starts[i]
        for x, z in _parts(long):
            entry = _runs(a.starts[i[x:z]], long[x:z])
            pair = np.repeat(np.arange(z - x), long[x:z])
            place, hit = _places(b, j[x:z][pair], a.terms[entry])
            score = np.bincount(pair[hit], a.weights[entry[hit]] * b.weights[place[hit]], z - x)
            over = score > threshold
            yield i[x:z][over], j[x:z][over]


def _met(batches: Iterator[pa.RecordBatch], n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """(id, near): of two blocks, the earliest text of the other that is near a text."""
    name = None
    for batch in batches:
        for row in batch.to_pylist():
            # a block meets several others, one after the other
            if row["block_a"] != name:
                name, a = row["block_a"], _Block(row, "_a", n, threshold)
            b = _Block(row, "_b", n, threshold)
            late = np.iinfo(np.int64).max
            of_a, of_b = np.full(len(a.ids), late), np.full(len(b.ids), late)
            for i, j in _near(a, b, threshold, row["block_a"] == row["block_b"]):
                np.minimum.at(of_a, i, b.ids[j])
                np.minimum.at(of_b, j, a.ids[i])
            ids, near = np.concatenate((a.ids, b.ids)), np.concatenate((of_a, of_b))
            some = near < np.minimum(ids, late)
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(near[some])], ["id", "near"])


def earliest_near(texts: DataFrame, total: int, count: int, n: int, threshold: float, held) -> DataFrame:
    """texts: id (long, unique), copies, bag (terms between blanks), read once; total, count: their terms and rows; n: how many
    texts there are, copies and those without terms counted.

    (id, near): the smallest id whose cosine with the text is over the threshold, where it is smaller than the text's own.
    held: keeps a table that is used several times.
    """
    spark = texts.sparkSession
    entries = int(min(BLOCK[1], max(BLOCK[0], 200 * total**0.5)))
    parts = max(1, -(-total // entries), -(-count // TEXTS))
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch="1000"):
        blocks = held(texts.select("id", "copies", "bag").coalesce(parts).mapInArrow(lambda it: _blocks(it, entries), "block long, ids binary, copies binary, lengths binary, terms binary, times binary"))
    with settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true", spark__sql__execution__arrow__maxRecordsPerBatch="1"):
        asked = blocks.mapInArrow(_asked, "block long, term long, n long")
        met = asked.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).where("df > 1")
        # wide, and read once: it goes straight on into the vectors
        found = met.groupBy(F.col("block").alias("__b")).agg(F.collect_list(F.struct("term", "df")).alias("found"))
        joined = blocks.join(found, F.col("block") == F.col("__b"), "left").drop("__b", "copies")
        vectors = held(joined.mapInArrow(lambda it: _weighted(it, n, threshold), "block long, ids binary, lengths binary, norms binary, terms binary, times binary, df binary, inside binary"))
        # the product has a task for each two partitions: no more of them than blocks, whatever the shuffle made
        few = vectors.coalesce(parts)
        side = lambda s: few.select(*(F.col(c).alias(c + s) for c in few.columns))
        pairs = side("_a").hint("shuffle_replicate_nl").crossJoin(side("_b")).where("block_a <= block_b")
        return held(pairs.mapInArrow(lambda it: _met(it, n, threshold), "id long, near long").groupBy("id").agg(F.min("near").alias("near")))
