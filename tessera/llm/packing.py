"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents are tokenised, an end id is added, and only those longer than a sequence are cut, from the end, into whole
sequences; the first piece may be shorter. Whole pieces are sequences by themselves. The others are dealt by a hash to
islands of bounded size. A chromosome is a packing: a list of bins of pieces. Crossover injects well-filled bins of one
parent into the other, removes the bins that now hold a piece twice, exchanges displaced pieces for smaller ones where
that fills a bin better, and puts the rest where they fit best. An island stops when it meets its lower bound, the tokens
divided by the sequence length, or when crossover has not lowered the bins for a while. At the bound no packing is better, so where the first chromosomes, best fits of several orders, meet
it, no crossover runs.

Two epochs run on the islands; between them each sends its fullest bins, as lists of sizes, to the next island, which
injects such bins where it has pieces of those sizes. Then pieces of all bins with room are dealt to new islands, with
their bins as one parent, so that no island keeps a remainder of its own.

Defined results: null text counts as empty and gives one piece with only the end id; rows that repeat, null ids among
them, are separate documents; very long texts give many pieces; an empty table gives no rows; columns beyond doc_id and
text are not read by `pack`. An island's random choices depend on the island's number only, so reruns agree when the input is split the same way.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow, table

LENGTH = 2048
ISLAND_ROWS = 8192
POPULATION = 4
CROSSOVERS = 40
#: Crossovers in a row without fewer bins after which an island stops.
PATIENCE = 8
#: Displaced pieces of a child for which an exchange is tried; the others go straight to best fit.
EXCHANGES = 1000
#: Bins that an island sends on.
ELITE = 64
#: Share of a bin that may stay empty when the last islands are dealt.
ROOM = 0.02
END = (0).to_bytes(4, "little")


def tokenized(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    ids = None

    def batch(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        nonlocal ids
        if ids is None:
            from .tokens import Ids

            ids = Ids(tokenizer)
        out: list[tuple] = []
        texts, names = b.column("text"), b.column("doc_id").to_pylist()
        for i, name in enumerate(names):
            raw = ids.of(texts[i].as_py() or "") + END
            n = len(raw) // 4
            first = n % length or length
            starts = [0, *range(first, n, length)]
            for k, (a, z) in enumerate(zip(starts, [*starts[1:], n], strict=True)):
                out.append((name, k, a, z - a, zlib.crc32(raw[4 * a : 4 * z])))
        columns = list(zip(*out, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(slim, batch, "doc_id long, piece int, start long, length long, ids_crc32 long")


class Packing:
    """Bins of item numbers, with the bins of each free room at hand."""

    def __init__(self, sizes: list[int], length: int, bins: list[list[int]] | None = None):
        self.sizes, self.length = sizes, length
        self.bins = bins or []
        self.room: dict[int, list[int]] = {}
        self.open = 0  # bit r: a bin has room r
        for k, b in enumerate(self.bins):
            self._offer(k, length - sum(sizes[i] for i in b))

    def _offer(self, k: int, room: int) -> None:
        if room:
            self.room.setdefault(room, []).append(k)
            self.open |= 1 << room

    def best_fit(self, items) -> "Packing":
        for i in items:
            size = self.sizes[i]
            fits = self.open >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                held = self.room[room]
                k = held.pop()
                if not held:
                    self.open ^= 1 << room
                self.bins[k].append(i)
            else:
                k, room = len(self.bins), self.length
                self.bins.append([i])
            self._offer(k, room - size)
        return self

    def fill(self, b: list[int]) -> int:
        return sum(self.sizes[i] for i in b)

    def worth(self) -> tuple[int, int]:
        """Fewer bins are better; among as many, those of uneven fill."""
        return -len(self.bins), sum(self.fill(b) ** 2 for b in self.bins)


def injected(into: Packing, bins: list[list[int]], sizes: list[int], length: int) -> Packing:
    """A packing with the given bins and what they leave of another."""
    came = {i for b in bins for i in b}
    kept, displaced = [], []
    for b in into.bins:
        if came.isdisjoint(b):
            kept.append(list(b))
        else:
            displaced += [i for i in b if i not in came]
    exchanged(kept, displaced, sizes, length)
    displaced.sort(key=lambda i: -sizes[i])
    return Packing(sizes, length, kept + [list(b) for b in bins]).best_fit(displaced)


def exchanged(bins: list[list[int]], displaced: list[int], sizes: list[int], length: int) -> None:
    """Displaced pieces, the largest first, take the place of smaller ones where that fills a bin best; those are displaced instead."""
    if not bins or not displaced:
        return
    items = np.array([i for b in bins for i in b])
    of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    size = np.array(sizes)[items]
    room = length - np.bincount(of, size).astype(np.int64)
    for place, d in enumerate(sorted(range(len(displaced)), key=lambda k: -sizes[displaced[k]])):
        more = sizes[displaced[d]] - size
        left = room[of] - more
        k = int(np.where((more > 0) & (left >= 0), left, length).argmin())
        if more[k] <= 0 or left[k] < 0 or place >= EXCHANGES:
            continue
        b = of[k]
        bins[b][bins[b].index(int(items[k]))] = displaced[d]
        displaced[d], items[k] = int(items[k]), displaced[d]
        room[b] -= more[k]
        size[k] += more[k]


def evolve(sizes: list[int], length: int, seed: int, given: list[list[int]] | None = None, immigrants: list[list[int]] | None = None, population: int = POPULATION, crossovers: int = CROSSOVERS) -> list[list[int]]:
    """The best packing found. given: a packing to start from; immigrants: bins as lists of sizes."""
    rng = np.random.default_rng(seed)
    n, least = len(sizes), -(-sum(sizes) // length)
    size = np.array(sizes)
    if given and len(given) == least:
        return [list(b) for b in given]
    people = [Packing(sizes, length, [list(b) for b in given])] if given else []
    people.append(Packing(sizes, length).best_fit(np.argsort(-size, kind="stable").tolist()))
    best = max(people, key=Packing.worth)
    if len(best.bins) == least:
        return best.bins
    while len(people) < population:
        people.append(Packing(sizes, length).best_fit(np.argsort(-size * rng.uniform(0.7, 1.3, n), kind="stable").tolist()))
    if immigrants:
        free: dict[int, list[int]] = {}
        for i, s in enumerate(sizes):
            free.setdefault(s, []).append(i)
        settled = []
        for wanted in immigrants:
            taken = [free[s].pop() for s in wanted if free.get(s)]
            if len(taken) == len(wanted):
                settled.append(taken)
            else:
                for i in taken:
                    free[sizes[i]].append(i)
        if settled:
            people.append(injected(best, settled, sizes, length))
    fewest, since = len(best.bins), 0
    for _ in range(crossovers):
        best = max(people, key=Packing.worth)
        since = 0 if len(best.bins) < fewest else since + 1
        fewest = len(best.bins)
        if fewest == least or since > PATIENCE:
            break
        one, two = rng.choice(len(people), 2, replace=False)
        donor, other = people[one], people[two]
        ranked = sorted(donor.bins, key=donor.fill, reverse=True)
        good = ranked[: max(1, len(ranked) // 2)]
        start = int(rng.integers(len(good)))
        part = good[start : start + max(1, len(good) // 4)]
        child = injected(other, part, sizes, length)
        worst = min(range(len(people)), key=lambda k: people[k].worth())
        if child.worth() > people[worst].worth():
            people[worst] = child
    return max(people, key=Packing.worth).bins


def _epoch(rows: DataFrame, islands: int, length: int) -> DataFrame:
    """rows: island, uid, size, bin (null at first), elite (list of sizes; then the rest is null). The same, evolved."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["uid"].notna()].sort_values("uid")
        guests = sorted((list(map(int, e)) for e in pdf.loc[pdf["uid"].isna(), "elite"]), reverse=True)
        sizes = own["size"].astype("int64").tolist()
        given = None
        if len(own) and own["bin"].notna().all():
            given = [list(g) for g in pd.Series(range(len(own))).groupby(own["bin"].astype("int64").to_numpy()).apply(list)]
        bins = evolve(sizes, length, int(key[0]), given, guests) if len(own) else []
        of, at, fill = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for k, b in enumerate(bins):
            b.sort()
            ends = np.cumsum([sizes[i] for i in b])
            of[b], at[b], fill[b] = k, np.concatenate(([0], ends[:-1])), ends[-1]
        out = pd.DataFrame({"island": int(key[0]), "uid": own["uid"].astype("Int64").to_numpy(), "size": np.array(sizes, np.int64), "bin": of, "at": at, "fill": fill, "elite": None})
        best = sorted((sorted((sizes[i] for i in b), reverse=True) for b in bins if len(b) > 1), key=lambda b: (-sum(b), b))[:ELITE]
        if islands > 1 and best:
            nan = pd.DataFrame({"island": (int(key[0]) + 1) % islands, "uid": pd.array([None] * len(best), "Int64"), "size": pd.array([None] * len(best), "Int64"), "bin": pd.array([None] * len(best), "Int64"), "at": pd.array([None] * len(best), "Int64"), "fill": pd.array([None] * len(best), "Int64"), "elite": best})
            out = pd.concat([out.astype({c: "Int64" for c in ("uid", "size", "bin", "at", "fill")}), nan])
        return out

    return rows.groupBy("island").applyInPandas(run, "island long, uid long, size long, bin long, at long, fill long, elite array<int>")


def _dealt(rows: DataFrame, n: int, key, *columns) -> tuple[DataFrame, int]:
    islands = max(1, -(-n // ISLAND_ROWS))
    return rows.select(F.pmod(F.xxhash64(key), F.lit(islands)).alias("island"), "uid", "size", *columns, F.lit(None).cast("array<int>").alias("elite")), islands


def packed(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """items: uid (unique), size (1 to length). uid, sequence (unique for the items given), at."""
    rows, islands = _dealt(items, items.count(), F.col("uid"), F.lit(None).cast("long").alias("bin"))
    first = cut(_epoch(rows, islands, length))
    second = cut(_epoch(first.select("island", "uid", "size", "bin", "elite"), islands, length).where("uid is not null"))
    name = F.shiftleft("island", 28) + F.col("bin")
    full = second.where(F.col("fill") >= (1 - ROOM) * length).select("uid", name.alias("sequence"), "at")
    weak = second.where(F.col("fill") < (1 - ROOM) * length).withColumn("bin", name)
    # a bin's pieces stay together, so the packing that they have is one of the parents
    rows, islands = _dealt(weak, weak.count(), F.col("bin"), "bin")
    last = _epoch(rows, islands, length).where("uid is not null")
    return full.union(last.select("uid", (F.shiftleft("island", 28) + F.col("bin") + F.lit(1 << 60)).alias("sequence"), "at"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(tokenized(docs, tokenizer, length))
    pieces = cut(pieces.withColumn("uid", F.monotonically_increasing_id()))
    whole = pieces.where(F.col("length") == length).select("*", (F.col("uid") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    part = pieces.where(F.col("length") < length)
    places = packed(part.select("uid", F.col("length").alias("size")), length)
    placed = part.join(places, "uid").select(*part.columns, (F.col("sequence") * 2 + 1).alias("sequence_id"), F.col("at").alias("offset"))
    return whole.union(placed).drop("uid")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())
