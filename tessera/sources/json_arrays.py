"""Files that hold one JSON array each, read by byte ranges and written a file for each partition.

Reading. Spark's text reader cuts a file into byte ranges, and the text of a range into pieces at closing braces. Whether
a piece begins inside a string, and how many brackets are open there, follows from all that stands before it; so a first
pass adds up each range alone, for both cases (inside a string or not), and a row for each range goes to the driver, where
ranges are chained. The second pass knows how each range begins and gives its records; only a record that crosses from one range into
another is put together by a shuffle. Tasks hold one record at a time, so a file may be as long as it likes.

A file is whole if it is one array of objects that all parse, with commas between them and nothing around it; other files
give no rows, as do empty ones. Escapes in strings, nested objects and arrays, a byte order mark, and white space are read as JSON has them.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ESCAPE = re.compile(r"\\.?", re.S)
#: What stands before the first record of a file, before each other record, and after the last; or all there is without records.
OPENS, NEXT, CLOSES, BARE = (re.compile(p) for p in (r"[ \t\r\n]*\[[ \t\r\n]*", r"[ \t\r\n]*,[ \t\r\n]*", r"[ \t\r\n]*\][ \t\r\n]*", r"[ \t\r\n]*\[[ \t\r\n]*\][ \t\r\n]*"))
CORRUPT = "__corrupt"


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(file, start, size) and the pieces of each range, in order; pieces must be read before the next range."""

    def rows():
        for b in batches:
            yield from zip(*[b.column(c).to_pylist() for c in ("file", "start", "size", "value")], strict=True)

    every = rows()
    row = next(every, None)
    while row is not None:
        name = row[:3]

        def pieces():
            nonlocal row
            while row is not None and row[:3] == name:
                value = row[3]
                row = next(every, None)
                yield value

        yield name, pieces()


def _outside(piece: str) -> tuple[str, str, int]:
    """What of a piece stands outside of strings, if it begins outside and if it begins inside, and whether quotes are odd."""
    parts = (ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')
    return "".join(parts[::2]), "".join(parts[1::2]), (len(parts) - 1) & 1


def _levels(text: str) -> int:
    return text.count("{") + text.count("[") - text.count("]")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each range: quotes odd or even, and for both ways to begin the change of depth and how many braces close at each depth."""
    for (file, start, size), pieces in _ranges(batches):
        odd, depth, closed, length, n = 0, [0, 0], [defaultdict(int), defaultdict(int)], 0, 0
        for piece in pieces:
            texts = _outside(piece)
            for begins in (0, 1):
                inside = begins ^ odd
                depth[begins] += _levels(texts[inside])
                if not inside ^ texts[2]:
                    depth[begins] -= 1
                    closed[begins][depth[begins]] += 1
            odd ^= texts[2]
            length += len(piece.encode("utf-8", "surrogatepass"))
            n += 1
        columns = ([file], [start], [size], [odd], [depth[0]], [depth[1]], [list(closed[0].items())], [list(closed[1].items())], [length], [n])
        ints = pa.map_(pa.int64(), pa.int64())
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), ints, ints, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "start", "size", "odd", "depth0", "depth1", "closed0", "closed1", "length", "n"])


def _chained(ranges: list) -> tuple[dict[tuple[str, int], tuple[int, int, int, bool]], list[str]]:
    """For each range: inside a string, depth and records so far at its begin, and whether it is the file's last; files that cannot be whole."""
    begins, broken = {}, []
    by_file = defaultdict(list)
    for r in ranges:
        by_file[r.file].append(r)
    for file, rows in by_file.items():
        rows.sort(key=lambda r: r.start)
        inside = depth = records = 0
        for k, r in enumerate(rows):
            begins[file, r.start] = (inside, depth, records, k == len(rows) - 1)
            records += (r.closed1 if inside else r.closed0).get(1 - depth, 0)
            depth += r.depth1 if inside else r.depth0
            inside ^= r.odd
        # the last piece is taken to end with a brace like the others: it does not in a whole file; a byte order mark is skipped
        bare = rows[0].size - sum(r.length + r.n for r in rows) + 1 in (0, 3)
        if inside or depth != -1 or not bare:
            broken.append(file)
    return begins, broken


def _records(batches: Iterator[pa.RecordBatch], begins: dict) -> Iterator[pa.RecordBatch]:
    """file, pos, part, text, whole: records, and parts of those that cross into another range; pos null marks a file that is not whole."""
    for (file, start, _), pieces in _ranges(batches):
        inside, depth, pos, last = begins[file, start]
        open_text: list[str] | None = [] if depth > 1 or inside else None
        first_range, crossed, good, out = start == 0, open_text is not None, True, []
        fresh = first_range and depth == 0
        held: str | None = None

        def read(piece: str) -> None:
            nonlocal inside, depth, pos, open_text, crossed, good, fresh
            if open_text is None:
                at = piece.find("{")
                before = piece[:at] if at >= 0 else piece
                good &= at >= 0 and (OPENS if fresh else NEXT).fullmatch(before) is not None
                fresh, open_text, crossed = False, [], False
                depth += _levels(before)
                piece = piece[at:] if at >= 0 else ""
            texts = _outside(piece)
            depth += _levels(texts[inside])
            inside ^= texts[2]
            open_text.append(piece + "}")
            if not inside:
                depth -= 1
                if depth <= 1:
                    good &= depth == 1
                    out.append((file, pos, start, "".join(open_text), not crossed))
                    pos, open_text = pos + 1, None

        for piece in pieces:
            if held is not None:
                read(held)
            held = piece
            if len(out) >= 4096:
                yield _batch(out)
                out = []
        if held is not None and last:
            good &= open_text is None and (BARE if fresh else CLOSES).fullmatch(held) is not None
        elif held is not None:
            read(held)
        if open_text:
            out.append((file, pos, start, "".join(open_text), False))
        if not good:
            out.append((file, None, start, None, False))
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["file", "pos", "part", "text", "whole"])


def read_json_arrays(spark: SparkSession, path: str | list[str], schema: str | StructType) -> DataFrame:
    """Records of JSON array files, with file (its name) and pos, by byte ranges of spark.sql.files.maxPartitionBytes."""
    fields = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    pieces = _pieces(spark, path)
    ints = "map<long,long>"
    shape = f"file string, start long, size long, odd long, depth0 long, depth1 long, closed0 {ints}, closed1 {ints}, length long, n long"
    begins, broken = _chained(pieces.mapInArrow(_summaries, shape).collect())  # a row for each byte range
    shared = spark.sparkContext.broadcast(begins)
    found = pieces.mapInArrow(lambda batches: _records(batches, shared.value), "file string, pos long, part long, text string, whole boolean")
    crossing = found.where("NOT whole AND pos IS NOT NULL").groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("parts"))
    texts = found.where("whole").select("file", "pos", "text").union(crossing.select("file", "pos", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")))
    read = StructType([*fields.fields, StructField(CORRUPT, StringType())])
    rows = texts.select("file", "pos", F.from_json("text", read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = found.where("pos IS NULL").select("file").union(rows.where(F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()).select("file"))
    if broken:
        bad = bad.union(spark.createDataFrame([(b,) for b in broken], "file string"))
    whole = rows.join(bad.distinct().withColumnRenamed("file", "b"), F.col("file") == F.col("b"), "left_anti")
    name = F.url_decode(F.regexp_extract("file", "[^/]*$", 0))
    return whole.select(*[F.col("r")[f.name].alias(f.name) for f in fields.fields], name.alias("file"), F.col("pos").cast("int").alias("pos"))


def write_json_arrays(df: DataFrame, folder: str) -> None:
    """Each partition as one file with one JSON array, and a manifest of files with their rows in <folder>/_manifest."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = False
        for b in batches:
            if b.num_rows:
                rows = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([("," if begun or k else "[") + r for k, r in enumerate(rows)], pa.string())], ["value"])
                begun = True
        yield pa.RecordBatch.from_arrays([pa.array(["]" if begun else "[]"], pa.string())], ["value"])

    spark = df.sparkSession
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).mapInArrow(lines, "value string").write.text(folder)
    found = spark.read.text(folder).groupBy(F.col("_metadata.file_name").alias("file")).agg((F.count(F.lit(1)) - 1).alias("n_rows"))
    found.write.json(f"{folder}/_manifest")
