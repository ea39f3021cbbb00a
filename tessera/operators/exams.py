"""Exam papers in markdown: question tables, detailed solutions, and their join into records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def numbered_lines(df: DataFrame, key: str, column: str = "content") -> DataFrame:
    return df.select(key, F.posexplode(F.split(column, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))


def _cell(k: int) -> Column:
    return F.trim(F.get(F.split("line", "\\|"), F.lit(k)))


#: The head of a question table, and headings of the parts of a solution.
TABLE_HEAD = ("|   TT |", "Câu hỏi")
METHOD = ("## phương pháp", "phương pháp")
SOLUTION = ("## lời giải", "lời giải", "loigiaih")
ANSWER = ("đáp án:", "## đáp án:")


def question_table(df: DataFrame, key: str, column: str = "content", continue_tables: bool = False, latex: bool = True) -> DataFrame:
    """(key, number, question) of the first question table; it ends at a blank line or heading unless tables continue."""
    lines = numbered_lines(df, key, column)
    head = F.contains("line", F.lit(TABLE_HEAD[0])) & F.contains("line", F.lit(TABLE_HEAD[1]))
    so_far = Window.partitionBy(key).orderBy("pos")
    began = F.max(F.when(head, 1).otherwise(0)).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.withColumn("began", F.coalesce(began, F.lit(0)))
    stop = (F.col("began") == 1) & (F.startswith("line", F.lit("##")) | F.startswith("line", F.lit("Lo")) | (F.col("line") == ""))
    marked = marked.withColumn("over", F.coalesce(F.max(F.when(stop, 1).otherwise(0)).over(so_far), F.lit(0)))
    row = (F.col("began") == 1) & ~head & F.startswith("line", F.lit("|")) & ~F.contains("line", F.lit("---"))
    if not continue_tables:
        row = row & (F.col("over") == 0)
    rows = marked.where(row).select(key, "pos", _cell(1).alias("n"), _cell(2).alias("q")).where(F.rlike("n", F.lit("^\\d+$")) & (F.coalesce(F.col("q"), F.lit("")) != ""))
    return rows.select(key, "pos", F.col("n").cast("int").alias("number"), (T.format_equation("q") if latex else F.col("q")).alias("question"))


def answer_table(df: DataFrame, key: str, column: str = "content") -> DataFrame:
    """(key, number, answer): third cells of numbered table rows; the last of a number wins."""
    lines = numbered_lines(df, key, column).where(F.startswith("line", F.lit("|")) & ~F.contains("line", F.lit("---")))
    rows = lines.select(key, "pos", _cell(1).alias("n"), _cell(3).alias("a")).where(F.rlike("n", F.lit("^\\d+$")) & (F.coalesce(F.col("a"), F.lit("")) != ""))
    return rows.groupBy(key, F.col("n").cast("int").alias("number")).agg(F.max_by("a", "pos").alias("answer"))


def _opens(low: Column, marks: tuple[str, ...]) -> Column:
    return F.startswith(low, F.lit(marks[0])) | low.isin(list(marks[1:]))


def detailed_solutions(df: DataFrame, key: str, column: str = "content", latex: bool = True) -> DataFrame:
    """(key, number, ordinal, method, solution, answer) of "Câu n." parts; the last part of a number wins."""
    lines = numbered_lines(df, key, column)
    low = F.lower("line")
    number = F.regexp_extract("line", "^Câu\\s+(\\d+)[.]", 1)
    answer = F.startswith(low, F.lit(ANSWER[0])) | F.startswith(low, F.lit(ANSWER[1]))
    kind = F.when(number != "", "question").when(_opens(low, METHOD), "method").when(_opens(low, SOLUTION), "solution").when(answer, "answer")
    skipped = (F.col("line") == "") | F.rlike("line", F.lit("^(?:<!--|##|[|]|---)"))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("kind", kind).withColumn("ordinal", F.sum(F.when(F.col("kind") == "question", 1).otherwise(0)).over(so_far))
    inside = Window.partitionBy(key, "ordinal").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("section", F.last(F.when(F.col("kind") != "question", F.col("kind")), ignorenulls=True).over(inside))
    own = F.when(F.col("kind") == "answer", F.trim(F.regexp_replace("line", "^[^:]*:", ""))).when(F.col("kind").isNull() & ~skipped & F.col("section").isNotNull(), F.col("line"))
    marked = marked.withColumn("piece", own).where("ordinal > 0")
    text = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("section") == s) & F.col("piece").isNotNull(), F.struct("pos", "piece")))), lambda x: x["piece"]), " ")
    done = (lambda c: T.format_equation(F.trim(c))) if latex else F.trim
    parts = marked.groupBy(key, "ordinal").agg(F.max(F.when(F.col("kind") == "question", number.cast("int"))).alias("number"), *[text(s).alias(s) for s in ("method", "solution", "answer")])
    last = Window.partitionBy(key, "number").orderBy(F.col("ordinal").desc())
    kept = parts.withColumn("r", F.row_number().over(last)).where("r = 1")
    return kept.select(key, "number", "ordinal", *[done(F.col(s)).alias(s) for s in ("method", "solution", "answer")])


def exam_records(df: DataFrame, key: str, column: str = "content", by_position: bool = False, missing: str = "") -> DataFrame:
    """Questions with method, solution and answer: detailed answers come before the table's, then `missing`."""
    questions = question_table(df, key, column).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("pos")))
    found = detailed_solutions(df, key, column).select(F.col(key).alias("k"), F.col("number").alias("n"), "method", "solution", F.col("answer").alias("detailed"))
    at = F.col("place") if by_position else F.col("number")
    table = answer_table(df, key, column).select(F.col(key).alias("tk"), F.col("number").alias("tn"), F.col("answer").alias("listed"))
    joined = questions.join(found, (F.col(key) == F.col("k")) & (at == F.col("n")), "left").join(table, (F.col(key) == F.col("tk")) & (F.col("number") == F.col("tn")), "left")
    pick = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c], F.lit(missing))
    return joined.select(key, "number", "question", pick("method").alias("method"), pick("solution").alias("solution"), pick("detailed", "listed").alias("answer"))


def line_parser(df: DataFrame, key: str, column: str = "content") -> DataFrame:
    """(key, ordinal, question, method, solution, answer) from question headers, options and section markers.

    Options stay on lines of the question; other lines go to the section that is open.
    """
    lines = numbered_lines(df, key, column).where("line <> ''")
    header = T.question_header("line")
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("head", header).withColumn("ordinal", F.sum(F.when(F.col("head.word").isNotNull(), 1).otherwise(0)).over(so_far)).where("ordinal > 0")
    inside = Window.partitionBy(key, "ordinal").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_head = F.col("head.word").isNotNull()
    option = T.option("line")
    before = Window.partitionBy(key, "ordinal").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # an option counts as one only while the question is open, where no section has begun
    marked = marked.withColumn("mark", F.when(is_head, "question").otherwise(T.section_of("line"))).withColumn("opt", option)
    marked = marked.withColumn("begun", F.coalesce(F.max(F.when((F.col("mark") != "question") & F.col("opt.letter").isNull(), 1).otherwise(0)).over(before), F.lit(0)))
    is_option = F.col("opt.letter").isNotNull() & (F.col("begun") == 0) & ~is_head
    marked = marked.withColumn("is_option", is_option).withColumn("section", F.last(F.when(~F.col("is_option"), F.col("mark")), ignorenulls=True).over(inside))
    letter = F.regexp_extract("line", "(?iu)(?:đáp án|answer|kết quả|result)[:.]?\\s*([A-D])", 1)
    piece = (
        F.when(is_head, F.col("head.rest"))
        .when(F.col("is_option"), F.concat(F.lit("\n"), F.col("opt.letter"), F.lit(". "), F.col("opt.text")))
        .when((F.col("mark") == "answer") & (letter != ""), letter)
        .when(F.col("section").isin("question", "answer"), F.concat(F.lit(" "), F.col("line")))
        .otherwise(F.concat(F.col("line"), F.lit("\n")))
    )
    marked = marked.withColumn("piece", piece)
    text = lambda s: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("pos", "piece")))), lambda x: x["piece"]), ""), F.lit(" \n"))
    return marked.groupBy(key, "ordinal").agg(*[text(s).alias(s) for s in ("question", "method", "solution", "answer")]).where("question <> ''")
