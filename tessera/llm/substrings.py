"""Removal of long word sequences that an earlier document has, by difference-cover anchors.

A difference cover of a period v is a set D of residues such that any two residues become members of D by one shift. So
if two documents share `window` words, whatever the places, one of the first v places of the shared words stands at a
residue of D in both of them. Only there is a shorter run of window - v + 1 words hashed, an anchor: with v = 31 and six
residues one place in five. Two documents that share a window share an aligned anchor inside it.

Anchors that only one document has go. The others extend: all windows that hold a shared anchor are hashed whole (96
bits), and a window is marked if a document of a smaller id has it too. No pairs are made: a hash is compared with the
smallest id that has it. Every batch of documents is reduced before the shuffle, to one entry for each hash that it
holds; what the batch has found itself travels as ranges that are spread by document. So a passage that a third of all
documents share costs one entry a batch, and no task gets them all. Equal texts are found first; only the smallest id's is extended.

Defined results: a null text has no words; the words of a document shorter than a window stay; a row with a null id keeps
its words and takes none from others; rows of one id never take words from each other, whether texts are equal or not;
rows that repeat get equal results; an empty table gives no rows; columns beyond doc_id and text are left alone; texts
are read whole, one after the other, so memory is bounded by a batch and its longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut, map_arrow, table, text_or_empty

WINDOW = 50
#: Perfect difference sets, by period.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: An anchor has at least this share of a window's words.
ANCHOR_SHARE = 0.4
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
EMPTY = hashlib.sha256(b"").hexdigest()
KNOWN_WORDS = 1 << 20


class _Hashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


class Rolling:
    """Hashes of all runs of so many words."""

    def __init__(self):
        self.words = _Hashes()
        self.powers = [np.ones(1, np.uint64) for _ in range(4)]

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def runs(self, x: np.ndarray, size: int, second: bool = False) -> np.ndarray:
        """One hash for each start; the second kind sees the words' bits in another mixture."""
        if second:
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        up, down = self._powers(len(x) + 1, second)
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * down[: len(x) - size + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def _powers(self, n: int, second: bool) -> tuple[np.ndarray, np.ndarray]:
        k = 2 * second
        if len(self.powers[k]) < n:
            m = MULTIPLIERS[second]
            for place, base in ((k, m), (k + 1, pow(m, -1, 1 << 64))):
                powers = np.full(2 * n, base, np.uint64)
                powers[0] = 1
                self.powers[place] = np.cumprod(powers)
        return self.powers[k], self.powers[k + 1]


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors long enough, and its residues."""
    return max((v, d) for v, d in COVERS.items() if window - v + 1 >= max(1, ANCHOR_SHARE * window))


def anchor_places(n: int, window: int) -> np.ndarray:
    """Starts of anchors in a document of n words."""
    if n < window:
        return np.zeros(0, np.int64)
    period, residues = cover(window)
    starts = (np.arange(0, n, period)[:, None] + np.array(residues)).ravel()
    return starts[starts <= n - (window - period + 1)]


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For sorted keys: the number of the group of each row."""
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _ranges(doc: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of one document that meet or touch become one; of two ranges the one that starts first ends first."""
    order = np.lexsort((high, low, doc))
    doc, low, high = doc[order], low[order], high[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (low[1:] > high[:-1] + 1)
    last = np.ones(len(doc), bool)
    last[:-1] = new[1:]
    return doc[new], low[new], high[last]


def read(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n_words, sha (of the words joined by one space)."""

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        digests, sizes, shas = [], [], []
        for text in b.column("text").to_pylist():
            words = words_of(text)
            digests.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
            sizes.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).digest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary())], ["doc_id", "digest", "n_words", "sha"])

    return map_arrow(docs, batch, "doc_id long, digest binary, n_words long, sha binary")


def _entries(columns: list[tuple], names: tuple[str, ...], types: tuple) -> pa.RecordBatch:
    """One batch of several groups of columns."""
    arrays = [pa.array(np.concatenate([np.asarray(c[k]) for c in columns]), t) for k, t in enumerate(types)]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _asked(keys: tuple[np.ndarray, ...], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of key and document; which belong to a key's smallest document, and which keys have several."""
    order = np.lexsort((place, doc, *keys[::-1]))
    group = _groups(order, *[k[order] for k in keys])
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least, most = doc[order][first], doc[order][np.concatenate((first[1:], [len(order)])) - 1]
    return order, doc[order] == least[group], (least != most)[group]


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """Entries k, doc, low, high. With high = -1: an anchor of hash k at place low; else starts of windows known to be shared."""
    period, _ = cover(window)
    size = window - period + 1
    rolling = Rolling()

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, ids, places = [], [], []
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            words = words_of(text)
            at = anchor_places(len(words), window)
            if len(at):
                keys.append(_signed(rolling.runs(rolling.of_words(words), size)[at]))
                ids.append(np.full(len(at), doc))
                places.append(at)
        if not keys:
            return
        key, doc, place = np.concatenate(keys), np.concatenate(ids), np.concatenate(places)
        order, mine, several = _asked((key,), doc, place)
        ask = np.sort(order[mine])  # in the order of documents, in which neighbours are alike and take less room
        d, low, high = _ranges(doc[order[several]], np.maximum(place[order[several]] - (window - size), 0), place[order[several]])
        yield _entries([(key[ask], doc[ask], place[ask], np.full(len(ask), -1)), (_spread(d, low), d, low, high)], ("k", "doc", "low", "high"), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))

    return map_arrow(docs, batch, "k long, doc long, low int, high int")


def _spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys that deal entries out evenly."""
    return _signed(doc.astype(np.uint64) * np.uint64(MULTIPLIERS[0]) + place.astype(np.uint64) * np.uint64(MULTIPLIERS[1]))


def _by_key(batches: Iterator[pa.RecordBatch], n_keys: int, decide) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key and document: those known go on, the others once all rows of their key are there."""
    held: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        known = columns[-1] >= 0
        if known.any():
            yield _entries([tuple(c[known] for c in columns[n_keys:])], b.schema.names[n_keys:], tuple(b.schema.types[n_keys:]))
        columns = [c[~known] for c in columns]
        if held:
            columns = [np.concatenate((h, c)) for h, c in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        open_from = len(columns[0])
        tail = np.ones(open_from, bool)
        for k in range(n_keys):
            tail &= columns[k] == columns[k][-1]
        open_from = int(np.flatnonzero(~tail)[-1]) + 1 if not tail.all() else 0
        held = [c[open_from:] for c in columns]
        if open_from:
            yield from decide([c[:open_from] for c in columns])
    if held and len(held[0]):
        yield from decide(held)


def shared_ranges(entries: DataFrame, window: int) -> DataFrame:
    """doc, low, high: starts of windows that hold an anchor which another document has."""
    before = cover(window)[0] - 1

    def decide(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, doc, place, _ = columns
        _, _, several = _asked((key,), doc, place)  # rows come in this order
        if several.any():
            yield _entries([(doc[several], np.maximum(place[several] - before, 0), place[several])], ("doc", "low", "high"), (pa.int64(), pa.int32(), pa.int32()))

    dealt = entries.repartition("k").sortWithinPartitions("k", "doc", "low")
    return dealt.mapInArrow(lambda batches: _by_key(batches, 1, decide), "doc long, low int, high int")


def windows(found: DataFrame, window: int) -> DataFrame:
    """found: doc, part, text, spans (starts of windows). Entries k, k2, doc, at, high.

    at: part and start. With high = -1: a window of hashes k and k2; else starts that a smaller id of the batch has.
    """
    rolling = Rolling()

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, second, ids, places = [], [], [], []
        for doc, part, text, spans in zip(*[b.column(c).to_pylist() for c in ("doc", "part", "text", "spans")], strict=True):
            words = words_of(text)
            last = len(words) - window
            wanted = np.zeros(max(0, last + 1) + 1, np.int64)
            for s in spans:
                if s["low"] <= last:
                    wanted[s["low"]] += 1
                    wanted[min(s["high"], last) + 1] -= 1
            at = np.flatnonzero(np.cumsum(wanted)[:-1])
            if len(at):
                x = rolling.of_words(words)
                first.append(_signed(rolling.runs(x, window)[at]))
                second.append((rolling.runs(x, window, True)[at] >> np.uint64(33)).astype(np.int64))
                ids.append(np.full(len(at), doc))
                places.append(at + (part << 32))
        if not ids:
            return
        k, k2, doc, at = (np.concatenate(c) for c in (first, second, ids, places))
        order, mine, _ = _asked((k, k2), doc, at)
        ask, later = np.sort(order[mine]), order[~mine]  # neighbours are alike in the order of documents
        # ranges of one part of one document; parts are far from each other
        d, low, high = _ranges(doc[later], at[later], at[later])
        zero = np.zeros(len(d), np.int64)
        yield _entries([(k[ask], k2[ask], doc[ask], at[ask], np.full(len(ask), -1)), (_spread(d, low), zero, d, low, high & 0xFFFFFFFF)], ("k", "k2", "doc", "at", "high"), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))

    return map_arrow(found, batch, "k long, k2 int, doc long, at long, high int")


def marked(entries: DataFrame) -> DataFrame:
    """doc, at, high: windows that a document of a smaller id has; high: the last start of a range."""

    def decide(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, k2, doc, at, _ = columns
        _, mine, _ = _asked((k, k2), doc, at)
        if not mine.all():
            yield _entries([(doc[~mine], at[~mine], at[~mine] & 0xFFFFFFFF)], ("doc", "at", "high"), (pa.int64(), pa.int64(), pa.int32()))

    dealt = entries.repartition("k", "k2").sortWithinPartitions("k", "k2", "doc", "at")
    return dealt.mapInArrow(lambda batches: _by_key(batches, 2, decide), "doc long, at long, high int")


def kept_words(words: list[bytes], starts: list[tuple[int, int]], window: int) -> list[bytes]:
    """The words that no marked window covers; starts: ranges of starts of marked windows."""
    depth = np.zeros(len(words) + 1, np.int64)
    for low, high in starts:
        depth[low] += 1
        depth[min(high + window, len(words))] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()]


def without_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256; with `texts` also the words that stay, joined by one space, as kept."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        every = scratch.stored(read(slim))
        firsts = every.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("n_words").alias("n_words")).where(F.col("n_words") >= window)
        firsts = scratch.stored(firsts.select(F.col("digest").alias("f_digest"), "first"))
        # texts of one id are told apart by a part, zero where the id has one text
        parts = firsts.groupBy(F.col("first").alias("p_doc")).agg(F.count(F.lit(1)).alias("n"))
        named = firsts.join(parts, F.col("first") == F.col("p_doc")).select("f_digest", F.col("first").alias("doc"), F.when(F.col("n") > 1, F.abs(F.hash("f_digest") % (1 << 30))).otherwise(0).cast("long").alias("part"))
        ranges = shared_ranges(anchors(slim.where("doc_id IS NOT NULL"), window), window)
        spans = ranges.groupBy(F.col("doc").alias("s_doc")).agg(F.collect_list(F.struct("low", "high")).alias("spans"))
        chosen = named.join(spans, F.col("doc") == F.col("s_doc")).select("doc", "part", "f_digest", "spans")
        again = slim.withColumn("digest", F.unhex(F.md5("text")))
        met = scratch.stored(again.join(chosen, (F.col("doc_id") == F.col("doc")) & (F.col("digest") == F.col("f_digest"))).select("doc", "part", "digest", "text", "spans"))
        marks = marked(windows(met, window)).select("doc", F.expr("at >> 32").alias("part"), F.struct(F.expr("cast(at & 4294967295 AS int)").alias("low"), "high").alias("range"))
        marks = marks.groupBy(F.col("doc").alias("m_doc"), F.col("part").alias("m_part")).agg(F.collect_list("range").alias("ranges"))
        held = met.join(marks, (F.col("doc") == F.col("m_doc")) & (F.col("part") == F.col("m_part"))).select("doc", "digest", "text", "ranges")

        def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            sizes, shas, kept = [], [], []
            for text, ranges in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist(), strict=True):
                words = words_of(text)
                stay = kept_words(words, [(r["low"], r["high"]) for r in ranges], window)
                sizes.append(len(words) - len(stay))
                kept.append(b" ".join(stay))
                shas.append(hashlib.sha256(kept[-1]).digest())
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("digest"), pa.array(sizes, pa.int64()), pa.array(shas, pa.binary()), pa.array([k if texts else None for k in kept], pa.binary()).cast(pa.string())], ["c_doc", "c_digest", "removed", "c_sha", "c_kept"])

        changed = map_arrow(held, batch, "c_doc long, c_digest binary, removed long, c_sha binary, c_kept string").dropDuplicates(["c_doc", "c_digest"])
        # a text that a smaller id has goes whole
        out = every.join(firsts, F.col("digest") == F.col("f_digest"), "left").join(changed, (F.col("doc_id") == F.col("c_doc")) & (F.col("digest") == F.col("c_digest")), "left")
        whole = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
        removed = F.when(whole, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long")))
        sha = F.when(whole, F.lit(EMPTY)).otherwise(F.lower(F.hex(F.coalesce("c_sha", "sha"))))
        columns = ["doc_id", "n_words", removed.alias("n_removed"), sha.alias("kept_sha256")]
        if texts:
            columns += ["digest", F.when(whole, F.lit("")).otherwise(F.col("c_kept")).alias("kept")]
        return cut(out.select(*columns))


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
starts AS (SELECT r, doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM docs WHERE len(words) >= 50 AND doc_id IS NOT NULL),
runs AS (SELECT r, doc_id, p, md5(array_to_string(words[p:p + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS first FROM runs GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(range(p, p + 50)) AS i FROM runs JOIN firsts USING (h) WHERE doc_id > first),
removed AS (SELECT r, count(*) AS n FROM gone GROUP BY r),
each AS (SELECT r, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM docs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS text FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN removed USING (r) LEFT JOIN kept USING (r)
"""
