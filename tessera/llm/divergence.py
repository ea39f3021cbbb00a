"""How far the word use of sources lies apart, by two-dimensional tiles of groups.

A group is the documents of one language and source; its terms are counted, and those that stand in enough documents of
the language make the language's vocabulary. Every group, and each language as a whole, gives each vocabulary term the
share p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)), and two of them differ in a term by floor((p - q)^2 / (p + q)).

Pairs of groups. The vocabulary is cut into chunks of terms, and a group's counts in a chunk are packed into one row. The
groups of a language stand in blocks; a tile is a pair of blocks, and a packed vector goes to each tile of its block. A
task reads a tile's vectors chunk by chunk, turns them into a matrix of shares and adds up the tile's pairs, so it holds two blocks of one chunk
and the sums. Terms that neither block has differ by one number a pair, times how many they are. Where tiles are few,
chunks are dealt to several tasks and the sums added up.

Counting reduces every batch of documents to one row for each term of a group before the shuffle, so a source that
holds most documents sends no more than its batches.

All arithmetic is in integers: the division that makes p goes three digits at a time, so it is exact for sums up to 9e15.

Defined results: null text, lang and source count as empty texts; a group without terms has its shares like any other;
a language without vocabulary has pairs of value 0 and no terms; a source alone in its language has no pairs; ties go
by the item's UTF-8 bytes; rows that repeat count as often as they stand there; an empty table gives no rows; columns
beyond text, lang and source are left alone; texts are read whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, cut, shuffle_partitions, table

LEAST_DOCUMENTS = 10
TERMS = 10
UNIT = 1_000_000_000
#: Terms of a chunk, about, and groups of a block.
CHUNK = 2048
GROUPS = 32
#: Bytes that are no part of a term, [\x00-\x40\x5B-\x60\x7B-\x7F], become blanks; only A-Z change their case.
CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task counts before it sends them on.
HELD_TERMS = 500_000


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, documents: partial counts, to be added up. A group's rows with term null say that it occurs."""

    def rows(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        langs, sources, terms, counts, documents = [], [], [], [], []
        for (lang, source), (n, df) in held.items():
            langs += [lang] * (len(n) + 1)
            sources += [source] * (len(n) + 1)
            terms += [None, *(t.decode("utf-8", "surrogatepass") for t in n)]
            counts += [0, *n.values()]
            documents += [0, *(df[t] for t in n)]
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((langs, sources, terms, counts, documents), kinds, strict=True)], ["lang", "source", "term", "n", "documents"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*[b.column(c).to_pylist() for c in ("lang", "source", "text")], strict=True):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.encode("utf-8", "surrogatepass").translate(CLEAN).split())
                size -= len(n)
                n.update(own)
                df.update(own.keys())
                size += len(n)
                if size > HELD_TERMS:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    slim = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return slim.mapInArrow(counted, "lang string, source string, term string, n long, documents long")


def share(n: Column, m: Column) -> Column:
    """1 + floor(UNIT * n / m), 0 < n <= m, without a number over 1000 * m."""
    out, rest = F.lit(0).cast("long"), n
    for _ in range(3):
        rest = rest * 1000
        digits = _div(rest, m)
        out, rest = out * 1000 + digits, rest - digits * m
    return out + 1


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def shares(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / m) of integers 0 < n <= m, three digits at a time."""
    out, rest = n // m, n % m
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // m
        rest %= m
    return out + 1


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, a, b, part, chunk, size, side, source, m, places, counts, sorted; a chunk of a tile is whole before it is added up.

    side 0: vectors of block a, side 1: of block b; of a block with itself only side 0 is there.
    """
    tile, chunk, rows = None, None, []
    sums: dict[tuple[str, str], int] = {}
    for b in batches:
        for row in b.to_pylist():
            at = (row["lang"], row["a"], row["b"], row["part"])
            if tile is not None and (at != tile or row["chunk"] != chunk):
                _add(sums, rows)
                rows = []
                if at != tile:
                    yield _pairs(tile, sums)
                    sums = {}
            tile, chunk = at, row["chunk"]
            rows.append(row)
    if rows:
        _add(sums, rows)
        yield _pairs(tile, sums)


def _add(sums: dict[tuple[str, str], int], rows: list[dict]) -> None:
    """The differences of one chunk of a tile. All groups of a block are there for every chunk."""
    sides = [[r for r in rows if r["side"] == k] for k in (0, 1)]
    if rows[0]["a"] == rows[0]["b"]:
        sides[1] = sides[0]
    wanted = np.unique(np.concatenate([np.asarray(r["places"], np.int64) for r in rows]))
    absent = rows[0]["size"] - len(wanted)
    p = []
    for side in sides:
        counts = np.zeros((len(side), len(wanted) + 1), np.int64)  # the last column: a term that none has
        for i, r in enumerate(side):
            counts[i, np.searchsorted(wanted, np.asarray(r["places"], np.int64))] = r["counts"]
        p.append(shares(counts + 2, np.array([r["m"] for r in side], np.int64)[:, None]))
    for i, r in enumerate(sides[0]):
        f = difference(p[0][i][None, :], p[1])
        value = f[:, :-1].sum(1) + absent * f[:, -1]
        for s, v in zip(sides[1], value.tolist(), strict=True):
            key = (r["source"], s["source"])
            sums[key] = sums.get(key, 0) + v


def _pairs(tile: tuple, sums: dict) -> pa.RecordBatch:
    rows = [(tile[0], g, h, v) for (g, h), v in sums.items() if g != h]
    if tile[1] != tile[2]:
        rows += [(lang, h, g, v) for lang, g, h, v in rows]
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["lang", "source", "item", "value"])


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, terms: int = TERMS, chunk: int = CHUNK, groups: int = GROUPS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        counts = scratch.stored(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))
        words = counts.where("term IS NOT NULL")
        kept = scratch.stored(words.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("documents").alias("df")).where(F.col("df") >= least_documents).select(F.col("lang").alias("k_lang"), F.col("term").alias("k_term"), "all_n"))
        vocabulary = kept.groupBy(F.col("k_lang").alias("v_lang")).agg(F.count(F.lit(1)).alias("v"), F.sum("all_n").alias("all_words"))
        used = scratch.stored(words.join(kept, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term"))).select("lang", "source", "term", "n", "all_n"))
        totals = used.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(F.sum("n").alias("words"))
        every = counts.where("term IS NULL").select("lang", "source")
        every = every.join(totals, (F.col("lang") == F.col("t_lang")) & (F.col("source") == F.col("t_source")), "left").join(vocabulary, F.col("lang") == F.col("v_lang"), "left")
        two = 2 * F.coalesce("v", F.lit(0).cast("long"))
        numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
        every = every.select("lang", "source", (F.coalesce("words", F.lit(0).cast("long")) + two).alias("m"), (F.coalesce("all_words", F.lit(0).cast("long")) + two).alias("all_m"), F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.floor(numbered / groups).cast("int").alias("block"))
        every = scratch.stored(every)
        pairs = _pair_values(every, used, kept, chunk, scratch)
        named = every.select(F.col("lang").alias("e_lang"), F.col("source").alias("e_source"), "m", "all_m")
        p = used.join(named, (F.col("lang") == F.col("e_lang")) & (F.col("source") == F.col("e_source")))
        p = p.select("lang", "source", F.col("term").alias("item"), share(F.col("n") + 2, F.col("m")).alias("p"), share(F.col("all_n") + 2, F.col("all_m")).alias("q")).where("p > q")
        value = _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q"))
        ranks = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
        top = p.select("lang", "source", F.lit("term").alias("part"), "item", value.alias("value")).withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= terms)
        near = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranks))
        return cut(near.union(top))


def _pair_values(every: DataFrame, used: DataFrame, kept: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """lang, source, item, value of all ordered pairs of a language's sources."""
    spark = every.sparkSession
    # a chunk by hash and a place in it: the number of chunks follows the vocabulary
    chunks = every.groupBy(F.col("lang").alias("c_lang")).agg(F.greatest(F.lit(1), F.ceil(F.max("v") / chunk)).cast("int").alias("chunks"), (F.max("block") + 1).alias("blocks"))
    tasks = 2 * shuffle_partitions(spark)
    tiles = F.col("blocks") * (F.col("blocks") + 1) / 2
    chunks = scratch.stored(chunks.withColumn("parts", F.least("chunks", F.greatest(F.lit(1), F.ceil(F.lit(tasks) / tiles))).cast("int")))
    placed = kept.join(chunks, F.col("k_lang") == F.col("c_lang")).select("k_lang", "k_term", F.pmod(F.xxhash64("k_term"), F.col("chunks")).cast("int").alias("chunk"))
    placed = scratch.stored(placed.withColumn("place", F.row_number().over(Window.partitionBy("k_lang", "chunk").orderBy("k_term")) - 1))
    sizes = placed.groupBy(F.col("k_lang").alias("s_lang"), F.col("chunk").alias("s_chunk")).agg(F.count(F.lit(1)).cast("int").alias("size"))
    vectors = used.join(placed, (F.col("lang") == F.col("k_lang")) & (F.col("term") == F.col("k_term"))).groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("cells"))
    vectors = vectors.select(F.col("lang").alias("w_lang"), F.col("source").alias("w_source"), F.col("chunk").alias("w_chunk"), F.col("cells.place").alias("places"), F.col("cells.n").alias("counts"))
    # a row for every group and chunk, without cells where the group has none of its terms
    full = every.join(chunks, F.col("lang") == F.col("c_lang")).select("lang", "source", "m", "block", "blocks", "parts", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    full = full.join(sizes, (F.col("lang") == F.col("s_lang")) & (F.col("chunk") == F.col("s_chunk")), "left").join(vectors, (F.col("lang") == F.col("w_lang")) & (F.col("source") == F.col("w_source")) & (F.col("chunk") == F.col("w_chunk")), "left")
    none = F.array().cast("array<int>")
    full = full.select("lang", "source", F.greatest("m", F.lit(2)).alias("m"), "block", "blocks", F.pmod("chunk", "parts").alias("part"), "chunk", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("places", none).alias("places"), F.coalesce("counts", F.array().cast("array<long>")).alias("counts"))
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("a"), F.greatest("block", o).alias("b"), (F.col("block") > o).cast("int").alias("side"))))
    sent = full.select("lang", tile.alias("t"), "part", "chunk", "size", "source", "m", "places", "counts").select("lang", "t.a", "t.b", "part", "chunk", "size", "t.side", "source", "m", "places", "counts")
    dealt = sent.repartition("lang", "a", "b", "part").sortWithinPartitions("lang", "a", "b", "part", "chunk", "side", "source")
    sums = dealt.mapInArrow(_tiles, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def op13_divergence_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL),
vocabulary AS (SELECT lang, count(*) AS v, sum(n) AS words FROM kept GROUP BY lang),
totals AS (SELECT lang, source, sum(n) AS words FROM counts GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(t.words, 0) + 2 * coalesce(v, 0) AS m, coalesce(vocabulary.words, 0) + 2 * coalesce(v, 0) AS all_m
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN totals t USING (lang, source) LEFT JOIN vocabulary USING (lang)),
shares AS (SELECT lang, source, term, coalesce(counts.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(counts.n, 0) + 2)) // m AS p, 1 + (1000000000::HUGEINT * (kept.n + 2)) // all_m AS q
  FROM groups JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
"""
