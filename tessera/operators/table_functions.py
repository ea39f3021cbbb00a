"""Table functions: one document becomes many records, in SQL and in the DataFrame API.

    SELECT p.page_id, r.* FROM pages p, LATERAL page_records(p.html, '{"baseSelector": "li", "fields": [...]}') r
    SELECT * FROM exam_questions(TABLE(lines) PARTITION BY paper ORDER BY pos)

Both tell Spark the columns of a call before it runs: those of page_records are the fields of its schema, exam_questions
gives the key the type that it has in the table. Rows travel in Arrow batches.

page_records keeps no state, so pages are read where they lie. exam_questions reads the lines of one paper in order, in the
task that has the paper's partition, and holds one question; a record goes out when the next question begins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions import text as T
from .selectors import Selector, records


class PageRecords:
    """(html, schema): pos and a text column for each field, a row for each element of the base selector.

    schema: JSON text {baseSelector, fields: [{name, selector, type, attribute}]}, the same for all rows. A null page has no
    records; a field that an element lacks is null.
    """

    def __init__(self):
        self.schema: tuple[str, dict] = ("", {})

    @staticmethod
    def analyze(html: AnalyzeArgument, schema: AnalyzeArgument) -> AnalyzeResult:
        if html.dataType != StringType():
            raise ValueError("page_records: html is a text column")
        if not schema.isConstantExpression or not isinstance(schema.value, str):
            raise ValueError("page_records: the schema is a constant JSON text")
        given = json.loads(schema.value)
        names = [f["name"] for f in given["fields"]]
        if len({*names, "pos"}) <= len(names):
            raise ValueError("page_records: names of fields differ from each other and from pos")
        for selector in (given["baseSelector"], *(f["selector"] for f in given["fields"] if f.get("selector"))):
            Selector(selector)
        return AnalyzeResult(StructType([StructField("pos", IntegerType()), *(StructField(n, StringType()) for n in names)]))

    def eval(self, html, schema) -> Iterator[tuple]:
        if self.schema[0] != schema:
            self.schema = (schema, json.loads(schema))
        given = self.schema[1]
        for pos, found in enumerate(records(html, given["baseSelector"], given["fields"])):
            yield (pos, *(found.get(f["name"]) for f in given["fields"]))


#: Marks of an answer's letter; the other marks are those of the line parser.
LETTER = "(?iu)(?:đáp án|answer|kết quả|result)[:.]?\\s*([A-D])"


class ExamQuestions:
    """TABLE(key, pos, line) PARTITION BY key ORDER BY pos: key, ordinal, question, method, solution, answer.

    A question begins at its head; options stay on lines of the question while no section is open; other lines go to the
    section that is open. Lines before the first head, blank lines and questions without text give nothing.
    """

    PARTS = ("question", "method", "solution", "answer")

    def __init__(self):
        self.head, self.option, self.letter = re.compile(T.QUESTION), re.compile(T.OPTION), re.compile(LETTER)
        self.sections = {name: re.compile(p) for name, p in T.SECTIONS.items()}
        self.key, self.ordinal, self.open = None, 0, "question"
        self.parts: dict[str, list[str]] = {}

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        fields = lines.dataType.fields if lines.isTable else []
        if [f.name for f in fields[1:]] != ["pos", "line"]:
            raise ValueError("exam_questions: a table of a key, pos and line")
        return AnalyzeResult(StructType([fields[0], StructField("ordinal", LongType()), *(StructField(p, StringType()) for p in ExamQuestions.PARTS)]))

    def eval(self, row) -> Iterator[tuple]:
        line = (row[2] or "").strip(" ")
        if not line:
            return
        self.key = row[0]
        if head := self.head.match(line):
            yield from self._record()
            self.ordinal, self.open = self.ordinal + 1, "question"
            self.parts = {p: [] for p in self.PARTS}
            self.parts["question"].append(head[3])
            return
        if not self.ordinal:
            return
        option = self.option.match(line) if self.open == "question" else None
        if option:
            self.parts["question"].append(f"\n{option[1]}. {option[2]}")
            return
        low = line.lower()
        mark = next((name for name, p in self.sections.items() if p.search(low)), None)
        self.open = mark or self.open
        letter = self.letter.search(line) if mark == "answer" else None
        if letter:
            self.parts["answer"].append(letter[1])
        elif self.open in ("question", "answer"):
            self.parts[self.open].append(f" {line}")
        else:
            self.parts[self.open].append(f"{line}\n")

    def terminate(self) -> Iterator[tuple]:
        yield from self._record()

    def _record(self) -> Iterator[tuple]:
        if self.ordinal and (texts := ["".join(self.parts[p]).strip(" \n") for p in self.PARTS])[0]:
            yield (self.key, self.ordinal, *texts)


page_records = F.udtf(PageRecords, useArrow=True)
exam_questions = F.udtf(ExamQuestions, useArrow=True)


def register(spark: SparkSession) -> None:
    """Both functions by their names in SQL."""
    spark.udtf.register("page_records", page_records)
    spark.udtf.register("exam_questions", exam_questions)


def lateral_page_records(pages: DataFrame, key: str, schema: dict, html: str = "html") -> DataFrame:
    """key, pos and the fields: pages without records give no row."""
    return pages.select(key, html).lateralJoin(page_records(F.col(html).outer(), F.lit(json.dumps(schema)))).drop(html)


def exam_lines(papers: DataFrame, key: str, column: str = "content") -> DataFrame:
    """key, pos, line: what exam_questions reads."""
    return papers.select(key, F.posexplode(F.split(column, "\n")).alias("pos", "line"))


def parsed_exams(papers: DataFrame, key: str, column: str | Column = "content") -> DataFrame:
    """The records of exams.line_parser, by the table function."""
    return exam_questions(exam_lines(papers, key, column).asTable().partitionBy(key).orderBy("pos"))
