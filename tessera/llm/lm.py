"""Language-model scores by stupid backoff over n-gram counts of the whole corpus.

A document's score is the mean over its words of log S(word | words before it), where S is count(n-gram) over
count(context) if the n-gram was seen elsewhere, else `BACKOFF` times S with a context one word shorter, and at the end
count(word) over all words. Counts are those of all documents without the document's own, so a text is not judged by
itself; words seen nowhere else count as one. Order 3 (trigrams) is the default.

Relations. Documents are dealt to buckets by a hash. A bucket's n-grams are exploded to rows (key, count), where key is
a hash of the n-gram, of so many bits (64 at most) that it meets another n-gram's about once in a million; rows are packed by target partition into sorted arrays, so a row of the shuffle is many
n-grams. Count tables are partitioned by hash: a partition adds up its keys over all buckets and joins the sums back to
the rows it got. They return to their bucket, are looked up for each document's n-grams, and are summed per document.
What is gathered grows with the words of the corpus; no table of counts is held in one place. A frequent n-gram is one
key per bucket, whatever its count. There are as many buckets, and as many target partitions, as the text's bytes ask
for: a task holds one bucket's texts (16 to 128 MB) or one target's share of the counts, whatever the size of the corpus.

Words are runs of characters other than the ASCII white space, with A-Z lower-cased. Defined results: null text counts
as empty; a document without words has n_words 0 and a null score; in a corpus of one document all words are unseen;
rows that repeat are separate documents, each seeing the other's words; an empty table gives no rows; columns beyond
doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, text_or_empty

ORDER = 3
#: Bits of a key beyond those that number all n-grams.
SPARE = 20
BACKOFF = 0.4
#: Bytes of text in a bucket, the least and the most, and bytes of a bucket's text that share a message, in the mean.
BUCKET = (16 << 20, 128 << 20)
MESSAGE = 1024
WORDS = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """Word -> its hash; kept up to a bound."""

    MOST = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def word_hashes(text: str | None, known: Words) -> np.ndarray:
    """Bytes are lower-cased and split as the words ask for: of bytes, only ASCII counts as letters and as white space."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def key_bits(words: int, order: int) -> int:
    """Whole bytes' bits that tell all n-grams of so many words apart, but for one in a million."""
    return min(64, -(-((max(1, words * order)).bit_length() + SPARE) // 8) * 8)


def ngram_keys(words: np.ndarray, order: int, bits: int = 64) -> list[np.ndarray]:
    """For each length the keys of the n-grams that end at each word (of length n from word n - 1 on)."""
    out = [words]
    for _ in range(1, order):
        longer = (out[-1][:-1] * MIX) ^ (out[-1][:-1] >> np.uint64(29))
        out.append((longer + words[len(words) - len(longer) :]) * np.uint64(0xC2B2AE3D27D4EB4F) if len(longer) else np.zeros(0, np.uint64))
    return [k >> np.uint64(64 - bits) for k in out] if bits < 64 else out


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return slim.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text")


def _grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of a sorted stream by the value of a column."""
    value, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        v = b.column(column).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        for a, z in zip(edges, np.append(edges[1:], len(v)), strict=True):
            if value is not None and v[a] != value:
                yield value, held
                held = []
            value = v[a]
            held.append(b.slice(int(a), int(z - a)))
    if held:
        yield value, held


def _placed(parts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of all parts, sorted, and for each part the places of its keys among them."""
    keys = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    order = np.argsort(keys)
    held = keys[order]
    head = np.concatenate((np.ones(min(1, len(held)), bool), held[1:] != held[:-1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(head) - 1
    return held[head], np.split(place, np.cumsum([len(p) for p in parts])[:-1]) if parts else []


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    head = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.diff(np.append(head, len(keys)))


def _spread(keys: np.ndarray, parts: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """Sorted keys fall into ranges of equal width, one for each target partition: (target, from, to)."""
    width = (1 << bits) // parts + 1
    edges = np.searchsorted(keys, np.array([min((1 << bits) - 1, k * width) for k in range(1, parts)], np.uint64))
    edges = np.concatenate(([0], edges, [len(keys)]))
    for k in range(parts):
        if edges[k + 1] > edges[k]:
            yield k, int(edges[k]), int(edges[k + 1])


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bytes; a byte of 255 says that the next 8 bytes hold it."""
    if not len(counts) or counts.max() < 255:
        return counts.astype(np.uint8).tobytes()
    small = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return small + counts[counts >= 255].astype("<u8").tobytes()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys: the first one, how many bytes each step takes, and the steps."""
    steps = np.diff(keys)
    wide = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return keys[:1].astype("<u8").tobytes() + bytes([wide]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def _unpacked_keys(raw: bytes) -> np.ndarray:
    wide = raw[8]
    n = (len(raw) - 9) // wide
    out = np.zeros((n + 1, 8), np.uint8)
    out[0] = np.frombuffer(raw, np.uint8, 8)
    out[1:, :wide] = np.frombuffer(raw, np.uint8, offset=9).reshape(n, wide)
    return np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    if len(raw) > n:
        counts[counts == 255] = np.frombuffer(raw, "<u8", offset=n).astype(np.int64)
    return counts


def bucket_bytes(total: int) -> float:
    """Bytes of text in a bucket: enough for many n-grams in each of its messages, few enough for a task's memory."""
    return min(BUCKET[1], max(BUCKET[0], (total * MESSAGE) ** 0.5))


def scored(docs: DataFrame, order: int = ORDER, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, score, perplexity."""
    seen = docs.agg(F.sum(F.regexp_count("text", F.lit(WORDS))).alias("words"), F.sum(F.octet_length("text")).alias("bytes")).first()
    all_words, total = seen.words or 0, seen.bytes or 0
    buckets = buckets or max(1, -(-total // int(bucket_bytes(total))))
    parts = max(buckets, shuffle_partitions(docs.sparkSession))
    bits = key_bits(all_words, order)
    dealt = _bucketed(docs, buckets).repartition(parts, "bucket")

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for bucket, rows in _grouped(batches, "bucket"):
            levels: list[list[np.ndarray]] = [[] for _ in range(order)]
            for b in rows:
                for text in b.column("text").to_pylist():
                    for level, keys in enumerate(ngram_keys(word_hashes(text, known), order, bits)):
                        levels[level].append(keys)
            for level in range(order):
                keys, counts = _distinct(levels[level])
                levels[level] = []
                out = [(k, level, int(bucket), _packed_keys(keys[a:z]), _packed(counts[a:z])) for k, a, z in _spread(keys, parts, bits)]
                if out:
                    yield _batch(out)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The count table of one target partition and level, joined back to what each bucket sent."""
        for _, rows in _grouped(batches, "slot"):
            sent = [(b.column("target")[i].as_py(), b.column("level")[i].as_py(), b.column("bucket")[i].as_py(), _unpacked_keys(b.column("keys")[i].as_py()), b.column("counts")[i].as_py()) for b in rows for i in range(b.num_rows)]
            keys = np.concatenate([s[3] for s in sent])
            counts = np.concatenate([_unpacked(s[4], len(s[3])) for s in sent])
            table_, where = np.unique(keys, return_inverse=True)
            totals = np.zeros(len(table_), np.int64)
            np.add.at(totals, where, counts)
            at = 0
            for target, level, bucket, own, _ in sent:
                yield _batch([(target, level, bucket, b"", _packed(totals[where[at : at + len(own)]]))])
                at += len(own)

    def looked_up(texts: pa.Table, counted: pa.Table) -> pa.Table:
        """Sums per document of one bucket, with the counts that came back to it."""
        known = Words()
        grams = [ngram_keys(word_hashes(t, known), order, bits) for t in texts.column("text").to_pylist()]
        totals: list[dict[int, bytes]] = [{} for _ in range(order)]
        for level, target, raw in zip(*(counted.column(c).to_pylist() for c in ("level", "target", "counts")), strict=True):
            totals[level][target] = raw
        others = []
        for level in range(order):
            keys, places = _placed([g[level] for g in grams])
            counts = [_unpacked(totals[level][k], z - a) for k, a, z in _spread(keys, parts, bits)]
            counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            others.append([counts[p] - _own(p) for p in places])
        found = [_score([o[k] for o in others], all_words) for k in range(len(grams))]
        return pa.table({"doc_id": texts.column("doc_id"), "n_words": pa.array([n for n, _ in found], pa.int64()), "score": pa.array([s for _, s in found], pa.float64())})

    shape = "slot int, target int, level int, bucket int, keys binary, counts binary"
    sent = dealt.sortWithinPartitions("bucket").mapInArrow(exploded, shape)
    back = sent.repartition(parts, "slot").sortWithinPartitions("slot").mapInArrow(added, shape)
    # the documents' shuffle serves both passes
    met = dealt.groupBy("bucket").cogroup(back.select("bucket", "level", "target", "counts").groupBy("bucket"))
    return met.applyInArrow(looked_up, "doc_id long, n_words long, score double").withColumn("perplexity", F.exp(-F.col("score")))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    target, level, bucket, keys, counts = zip(*rows, strict=True)
    slots = [t * 8 + v for t, v in zip(target, level, strict=True)]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((slots, target, level, bucket, keys, counts), kinds, strict=True)], ["slot", "target", "level", "bucket", "keys", "counts"])


def _own(places: np.ndarray) -> np.ndarray:
    """How often the document itself has the n-gram at each place."""
    _, where, counts = np.unique(places, return_inverse=True, return_counts=True)
    return counts[where]


def _score(others: list[np.ndarray], all_words: int) -> tuple[int, float | None]:
    """Words, and the mean log score; others: for each length the counts in other documents of the n-grams in order."""
    n = len(others[0])
    if not n:
        return 0, None
    rest = max(1, all_words - n)
    score = np.log(np.maximum(others[0], 1) / rest)
    for level in range(1, len(others)):
        seen, context = others[level], others[level - 1][: len(others[level])]
        longer = np.log(np.maximum(seen, 1) / np.maximum(context, 1))
        score[level:] = np.where(seen > 0, longer, np.log(BACKOFF) + score[level:])
    return n, float(score.mean())


def op10_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
