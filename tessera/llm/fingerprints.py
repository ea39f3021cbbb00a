"""Document fingerprints by content-defined chunking.

A text is lower-cased and its white space runs become one blank. A gear hash runs over its bytes; its value at a byte
depends on the last 32 bytes only, so boundaries move along with the text when something before them changes. Chunks are
cut by normalised chunking: below the target size a boundary needs a stricter bit mask, beyond it an easier one, within
a smallest and a largest size. The fingerprint is the set of chunk digests, each with its weight, the chunk's bytes: ten
characters a chunk, in the order of digests, of which eight are the digest (48 bits) and two the weight (12 bits), six bits a
character. A chunk that repeats counts once. A fingerprint takes about a quarter of the text's size.

Likeness of two fingerprints is containment: the weight of the chunks they share over the smaller of their weights.

Defined results: null text counts as empty; a text with no characters beside white space has the empty fingerprint,
which is like the empty one (1) and unlike any other (0). For `with_next`, documents stand in descending order of doc_id,
null last, ties in the order of a hash of the text and then of the text; the one after the last is the first, so a lone
document is its own next. Rows that repeat stand side by side. An empty table gives no rows. Columns beyond doc_id and text are left alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import shuffle_partitions, table, text_or_empty

SMALLEST, TARGET, LARGEST = 8, 32, 128
#: Six bits a character, in the order of their codes, so fingerprints sort as numbers do.
SIGNS = np.frombuffer(b"+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8)
PLACES = np.zeros(128, np.uint64)
PLACES[SIGNS] = np.arange(64)
SHIFTS = np.arange(54, -1, -6).astype(np.uint64)
#: Bits of a boundary's mask: one chance in 2 ** bits at each byte.
STRICT, EASY = 6, 4
WINDOW = 32
GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32)
#: Bytes that the hash runs over at once.
BLOCK = 1 << 20


def gear_hash(raw: bytes) -> np.ndarray:
    """At each byte the sum over the window of GEAR[byte] shifted left by its distance, modulo 2 ** 32."""
    h = GEAR[np.frombuffer(raw, np.uint8)]
    span = 1
    while span < WINDOW:
        far = h[:-span] << np.uint32(span)
        h = h.copy()
        h[span:] += far
        span *= 2
    return h


def boundaries(raw: bytes) -> list[int]:
    """Ends of the chunks."""
    easy, strict = [], []
    for at in range(0, len(raw), BLOCK):
        lead = min(at, WINDOW - 1)
        h = gear_hash(raw[at - lead : at + BLOCK])[lead:]
        top = h >> np.uint32(32 - EASY)
        candidates = np.flatnonzero(top == 0)
        strong = candidates[h[candidates] >> np.uint32(32 - STRICT) == 0]
        easy += (candidates + at + 1).tolist()
        strict += (strong + at + 1).tolist()
    ends, start, n = [], 0, len(raw)
    while n - start > SMALLEST:
        k = bisect_left(strict, start + SMALLEST)
        end = strict[k] if k < len(strict) else n
        if end > start + TARGET:
            k = bisect_left(easy, start + TARGET)
            end = easy[k] if k < len(easy) else n
            end = min(end, start + LARGEST)
        if end >= n:
            break
        ends.append(end)
        start = end
    if n > start:
        ends.append(n)
    return ends


def chunks(text: str) -> dict[int, int]:
    """Digest of each chunk -> its bytes."""
    raw = " ".join(text.lower().split()).encode("utf-8", "surrogatepass")
    out, start, digest = {}, 0, xxhash.xxh3_64_intdigest
    for end in boundaries(raw):
        out[digest(raw[start:end]) >> 16] = end - start
        start = end
    return out


def written(found: dict[int, int]) -> str:
    if not found:
        return ""
    v = np.sort(np.fromiter((d << 12 | w for d, w in found.items()), np.uint64, len(found)))
    return SIGNS[((v[:, None] >> SHIFTS) & np.uint64(63)).astype(np.int64)].tobytes().decode()


def read(fingerprint: str) -> dict[int, int]:
    v = PLACES[np.frombuffer(fingerprint.encode(), np.uint8)].reshape(-1, len(SHIFTS))
    return {int(x) >> 12: int(x) & 4095 for x in (v << SHIFTS).sum(1, dtype=np.uint64)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    if not a or not b:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    return sum([w for d, w in a.items() if d in b]) / min(sum(a.values()), sum(b.values()))


def edited(text: str, follower: str) -> str:
    """The last half of the code points replaced by the first as many, or all, of another text."""
    half = len(text) // 2
    return text[: len(text) - half] + follower[:half]


class _Cuts:
    """Where the order of doc_id (descending, null last), and of the hash where one id has very many rows, is cut into parts."""

    def __init__(self, hashed: DataFrame, parts: int):
        shares = [i / parts for i in range(1, parts)] or [0.5]
        found = hashed.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or []
        often = [i for i, n in Counter(found).items() if n > 1] if parts > 1 else []
        # an id that several cuts fall on stands alone between two of them, and is cut by the hash itself
        self.ids = np.array(sorted({*found, *(i - 1 for i in often if i > -(1 << 63))}) if parts > 1 else [], np.int64)
        many = hashed.where(F.col("doc_id").isNull() | F.col("doc_id").isin(often)).groupBy("doc_id").agg(F.percentile_approx("h", shares, 10_000).alias("cuts"), F.count(F.lit(1)).alias("n"))
        inside: dict[int, np.ndarray] = {}
        for r in many.collect() if parts > 1 else []:
            region = len(self.ids) + 1 if r.doc_id is None else len(self.ids) - int(np.searchsorted(self.ids, r.doc_id))
            inside[region] = np.unique(np.array(r.cuts, float))
        widths = [1 + len(inside.get(k, ())) for k in range(len(self.ids) + 2)]
        self.inside, self.first = inside, np.concatenate(([0], np.cumsum(widths)))
        self.parts = int(self.first[-1])

    def part_of(self, ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        known = len(self.ids) - np.searchsorted(self.ids, ids.fill_null(0).to_numpy(zero_copy_only=False))
        region = np.where(none, len(self.ids) + 1, known)
        out = self.first[region]
        h = hashes.to_numpy(zero_copy_only=False)
        for k, cuts in self.inside.items():
            here = region == k
            out[here] += len(cuts) - np.searchsorted(cuts, h[here])
        return out


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id and text in about `parts` ranges of doc_id (of the text's hash too, where an id has very many rows), each followed by the first row of the next range as a guest.

    Columns: part, doc_id, text, guest. Each part stands whole in one partition, in order, the guest last.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    parts = parts or 2 * shuffle_partitions(docs.sparkSession)
    hashed = slim.withColumn("h", -(F.xxhash64("text") / 2))
    cuts = _Cuts(hashed, parts)

    @F.arrow_udf(LongType())
    def part(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(cuts.part_of(ids, hashes), pa.int64())

    # the first row of each part: its largest id, and of that the text of least hash
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    heads = hashed.groupBy(part("doc_id", "h").alias("part")).agg(F.max(order).alias("o")).orderBy("part").collect()
    at = np.zeros(cuts.parts, np.int64)
    at[[r.part for r in heads]] = range(len(heads))
    first = [(r.o.id if r.o.known else None, r.o.h) for r in heads]
    before = [heads[k - 1].part for k in range(len(heads))]  # the part that is followed by this one; the last by the first

    @F.arrow_udf(LongType())
    def guest_of(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The part that a first row visits as a guest; null for other rows."""
        where = at[cuts.part_of(ids, hashes)]
        heads_at = pa.array(where)
        own, h = (pa.array(c, t).take(heads_at) for c, t in zip(zip(*first, strict=True), (pa.int64(), pa.float64()), strict=True))
        same = pc.and_(pc.equal(h, hashes), pc.or_(pc.and_(ids.is_null(), own.is_null()), pc.equal(ids, own).fill_null(False)))
        return pc.if_else(same, pa.array(before, pa.int64()).take(heads_at), pa.scalar(None, pa.int64()))

    placed = hashed.withColumn("part", part("doc_id", "h")).withColumn("goes", guest_of("doc_id", "h"))
    own = F.struct("part", F.lit(False).alias("guest"))
    both = F.when(F.col("goes").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("goes").alias("part"), F.lit(True).alias("guest"))))
    dealt = placed.select("doc_id", "text", "h", F.explode(both).alias("c")).select("c.part", "doc_id", "text", "h", "c.guest")
    return dealt.repartition(max(1, len(heads)), "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), F.col("h").desc(), "text").drop("h")


def fingerprinted(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one has not come yet: part, doc_id, text, chunks
        done_guest = None
        for batch in batches:
            out: list[tuple] = []
            parts_, ids, texts, guests = (batch.column(c) for c in ("part", "doc_id", "text", "guest"))
            for i in range(batch.num_rows):
                part, name, text, guest = parts_[i].as_py(), ids[i].as_py(), texts[i].as_py(), guests[i].as_py()
                if guest and done_guest == part:
                    continue  # rows that repeat as the first of a part come as guests once each
                found = chunks(text)
                if held is not None and held[0] == part:
                    own = edited(held[2], text)
                    changed = chunks(own)
                    out.append((held[1], len(held[2]), hashlib.sha256(own.encode("utf-8", "surrogatepass")).hexdigest(), written(held[3]), written(changed), likeness(held[3], changed), likeness(held[3], found)))
                if guest:
                    done_guest, held = part, None
                else:
                    held = part, name, text, found
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_next(docs, parts).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
