"""Scalar text functions: Column -> Column, inside code generation where Spark has the means."""

from __future__ import annotations

import json
import string
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as Python's str.split() sees it.
SPACE = "\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACES = f"[{SPACE}]+"
#: The same, told from most other characters by two comparisons.
BREAKS = f"[\\x00-\\x20\\x7f-\\x{{10FFFF}}&&[{SPACE}]]+"
#: Runs of two word characters or more; ASCII first, as that is found fastest.
TERM = "[a-z0-9_\\p{L}\\p{N}]{2,}+"
#: Frequent English words, as Spark's stop-word remover has them.
ENGLISH_STOP = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves"
    " what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while"
    " of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there"
    " when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
    " i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've"
    " isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could"
    " here's how's let's ought that's there's what's when's where's who's why's would"
).split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_spaces(c: Column | str) -> Column:
    """Runs of white space become one blank; none is left at the ends."""
    return F.trim(F.regexp_replace(_col(c), BREAKS, " "))


def remove_punctuation(c: Column | str) -> Column:
    """Keeps letters, numbers, marks of the underscore and white space."""
    # small letters, digits and the blank are left by few comparisons
    return F.regexp_replace(_col(c), f"[\\x00-\\x1f!-/:-`{{-\\x{{10FFFF}}&&[^a-zA-Z0-9_\\x20\\p{{L}}\\p{{N}}{SPACE}]]+", "")


def remove_ascii_punctuation(c: Column | str) -> Column:
    return F.translate(_col(c), string.punctuation, "")


def words(c: Column | str) -> Column:
    """White-space tokens."""
    return F.filter(F.split(_col(c), BREAKS), lambda w: w != "")


def word_tokens(c: Column | str) -> Column:
    """Runs of word characters, and each other sign by itself."""
    return F.regexp_extract_all(_col(c), F.lit(f"[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_{SPACE}]"), F.lit(0))


def terms(c: Column | str) -> Column:
    """Lower-cased runs of two word characters or more."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TERM), F.lit(0))


def remove_stop_words(tokens: Column | str, stop: list[str]) -> Column:
    """Tokens that are not in the list; long lists become a hash set in the plan."""
    return F.filter(_col(tokens), lambda w: ~w.isin(list(stop))) if stop else _col(tokens)


def english_stop_words() -> list[str]:
    return list(ENGLISH_STOP)


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def to_ascii(c: Column | str) -> Column:
    """Compatibility decomposition without what is then not ASCII; texts that are ASCII already stay in the JVM."""
    c = _col(c)
    return F.when(F.rlike(c, F.lit("^[\\x00-\\x7f]*$")), c).otherwise(_fold(c))


#: Letters that decomposition does not reach.
LETTERS = {"đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i"}


def transliterate(c: Column | str) -> Column:
    """Latin letters without marks; a documented subset of transliteration."""
    c = _col(c)
    for a, b in LETTERS.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return to_ascii(c)


def preprocess(c: Column | str) -> Column:
    """Lower case, no punctuation, single blanks."""
    return collapse_spaces(remove_punctuation(F.lower(_col(c))))


def text_hash(c: Column | str) -> Column:
    """md5 of the text with its white space collapsed; null stays null."""
    return F.md5(collapse_spaces(c))


def content_name(url: Column | str) -> Column:
    """md5 of the address, with the suffix of its path or .jpg."""
    url = _col(url)
    suffix = F.regexp_extract(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "([.][^./]+)$", 1)
    return F.concat(F.md5(url), F.when(suffix == "", ".jpg").otherwise(suffix))


def shingles(tokens: Column | str, k: int = 3) -> Column:
    """Overlapping word k-grams; none for fewer than k words."""
    tokens = _col(tokens)
    n = F.size(tokens)
    return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, F.lit(k)), " "))).otherwise(F.array().cast("array<string>"))


def chunks(tokens: Column | str, size: int = 1000, overlap: float = 0.0) -> Column:
    """Token windows of `size` that share `overlap` of it with the one before."""
    tokens = _col(tokens)
    step = max(1, int(size * (1 - overlap)))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(step))
    return F.when(F.size(tokens) > 0, F.transform(starts, lambda i: F.slice(tokens, i, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


#: How questions, options and sections of an exam paper begin.
QUESTION_NUMBER = "(?iu)^Câu\\s+\\d+[:.]\\s*"
QUESTION = "(?iu)^(Câu|Question|Bài)\\s*(\\d+)[:.]?\\s*(.*)"
OPTION = "(?i)^([A-D])[:.)]\\s*(.*)"
SECTIONS = {
    "method": "phương pháp|method|cách làm|giải|approach",
    "solution": "lời giải|solution|giải chi tiết|detailed solution",
    "answer": "(đáp án|answer|kết quả|result)[:.]?\\s*[a-d]",
}


def strip_question_number(c: Column | str) -> Column:
    """A leading "Câu 12." or "Câu 12:" goes, whatever its case."""
    return F.trim(F.regexp_replace(_col(c), QUESTION_NUMBER, ""))


def question_header(c: Column | str) -> Column:
    """struct(word, number, rest) of a line that opens a question; nulls where it does not."""
    c = _col(c)
    at = lambda k: F.when(F.rlike(c, F.lit(QUESTION)), F.regexp_extract(c, QUESTION, k))
    return F.struct(at(1).alias("word"), at(2).cast("int").alias("number"), at(3).alias("rest"))


def option(c: Column | str) -> Column:
    """struct(letter, text) of an answer option; nulls where the line is none."""
    c = _col(c)
    at = lambda k: F.when(F.rlike(c, F.lit(OPTION)), F.regexp_extract(c, OPTION, k))
    return F.struct(at(1).alias("letter"), at(2).alias("text"))


def section_of(c: Column | str) -> Column:
    """method, solution or answer, in this order of precedence; null for other lines."""
    low = F.lower(_col(c))
    return F.coalesce(*[F.when(F.rlike(low, F.lit(p)), F.lit(name)) for name, p in SECTIONS.items()])


#: Rewrites of plain mathematics, in order.
MATH_RULES = [
    ("(\\d+)\\s*/\\s*(\\d+)", "\\\\frac{$1}{$2}"),
    ("(\\w+)\\^(\\d+)", "$1^{$2}"),
    ("×", "\\\\times"),
    ("÷", "\\\\div"),
    ("≥", "\\\\geq"),
    ("≤", "\\\\leq"),
    ("≠", "\\\\neq"),
    ("²", "^2"),
    ("³", "^3"),
    ("√\\(([^)]+)\\)", "\\\\sqrt{$1}"),
    ("√(\\d+)", "\\\\sqrt{$1}"),
]


def math_to_latex(c: Column | str, literal_groups: bool = False) -> Column:
    """literal_groups: group references come out as the text \\1 and \\2, as some earlier data has them."""
    c = _col(c)
    for pattern, to in MATH_RULES:
        c = F.regexp_replace(c, pattern, to.replace("$1", "\\\\1").replace("$2", "\\\\2") if literal_groups else to)
    return c


def format_fractions(c: Column | str) -> Column:
    """"a b c" before an operator or the end is a - b/c; a trailing "a b" is a/b."""
    mixed = F.regexp_replace(_col(c), "(\\d+)\\s+(\\d+)\\s+(\\d+)(?=\\s*[=+\\-×÷]|\\s*$)", "$1 - \\\\frac{$2}{$3}")
    return F.regexp_replace(mixed, "(\\d+)\\s+(\\d+)(?=\\s*$)", "\\\\frac{$1}{$2}")


def format_equation(c: Column | str) -> Column:
    """Each side of the equals signs rewritten; dollar signs around what is mathematics by then."""
    c = _col(c)

    def side(p: Column) -> Column:
        p = format_fractions(math_to_latex(F.trim(p)))
        return F.regexp_replace(F.regexp_replace(p, "\\s+\\+\\s+", " + "), "\\s+-\\s+", " - ")

    done = F.array_join(F.transform(F.split(c, "="), side), " = ")
    maths = F.rlike(done, F.lit("\\\\frac|\\\\times|\\\\div|\\^|\\\\sqrt")) & ~F.startswith(done, F.lit("$"))
    return F.when(F.trim(c) == "", c).when(maths, F.concat(F.lit("$"), done, F.lit("$"))).otherwise(done)


IMAGE = "!\\[.*?\\]\\((.*?)\\)"


def image_links(c: Column | str, most: int | None = None) -> Column:
    found = F.regexp_extract_all(_col(c), F.lit(IMAGE), F.lit(1))
    return found if most is None else F.slice(found, 1, most)


def without_images(c: Column | str, mark: str = " ", longest: int | None = None) -> Column:
    """Image markup replaced by `mark`; beyond `longest` characters the text is cut and dots follow."""
    text = F.trim(F.regexp_replace(_col(c), IMAGE, mark))
    return text if longest is None else ellipsis(collapse_spaces(text), longest)


def ellipsis(c: Column | str, longest: int) -> Column:
    c = _col(c)
    return F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("..."))).otherwise(c)


def image_budget(question: Column, solution: Column, most: int) -> Column:
    """struct(question, solution): links of both cut to `most` in all; the first half goes to the question."""
    both = F.slice(F.concat(question, solution), 1, most)
    half = F.size(both) - F.floor(F.size(both) / 2).cast("int")
    return F.struct(F.slice(both, F.lit(1), half).alias("question"), F.slice(both, half + 1, F.lit(most)).alias("solution"))


def number_set(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit("\\d+"), F.lit(0)))


def has_special(c: Column | str) -> Column:
    return F.rlike(_col(c), F.lit("[^a-zA-Z0-9\\s]"))


def has_digits(c: Column | str) -> Column:
    return F.rlike(_col(c), F.lit("\\d"))


def is_upper(c: Column | str) -> Column:
    c = _col(c)
    return (F.upper(c) == c) & (F.lower(c) != c)


def strip_prefix(c: Column | str, prefix: str = "<bos>") -> Column:
    """The prefix goes once, only at the start."""
    c = _col(c)
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 2**31 - 1)).otherwise(c)


def after_last(c: Column | str, marker: str) -> Column:
    """The text behind the last marker, trimmed; all of it where there is none."""
    c = _col(c)
    return F.when(F.contains(c, F.lit(marker)), F.trim(F.substring_index(c, marker, -1))).otherwise(c)


def insert_image_token(c: Column | str, token: str = "<image>", special: str = "<start_of_turn>") -> Column:
    """The token comes after the first line of a text that starts with a special token, else first; once only."""
    c = _col(c)
    line = F.substring_index(c, "\n", 1)
    second = F.concat(line, F.lit("\n"), F.lit(token), F.substring(c, F.length(line) + 2, F.length(c)))
    opened = F.startswith(c, F.lit(special)) & F.contains(c, F.lit("\n"))
    return F.when(F.contains(c, F.lit(token)), c).when(opened, second).otherwise(F.concat(F.lit(token), c))


def fill(template: str, **columns: Column) -> Column:
    """Literal template with {name} places; values are not read as patterns."""
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(columns[name].cast("string"))
    return F.concat(*parts)


def int_list(c: Column | str) -> Column:
    """"[1, 2]" as an array; missing is empty, what does not parse is null."""
    c = _col(c)
    return F.when(c.isNull() | (F.trim(c) == ""), F.array().cast("array<int>")).otherwise(F.from_json(c, "array<int>"))


def list_or_text(c: Column | str) -> Column:
    """struct(values, text): a list of numbers as an array; missing is the empty list, and what does not parse stays as the text it is."""
    c = _col(c)
    values = int_list(c)
    return F.struct(values.alias("values"), F.when(values.isNull(), c).alias("text"))


def tool_schema(name: str, description: str, parameters: dict[str, str], required: list[str] | None = None) -> Column:
    """A function that a model can call, as the JSON text of its schema. parameters: name -> type."""
    own = {"type": "object", "properties": {k: {"type": t} for k, t in parameters.items()}, "required": required if required is not None else list(parameters)}
    return F.lit(json.dumps({"type": "function", "function": {"name": name, "description": description, "parameters": own}}, ensure_ascii=False))


def tool_names(c: Column | str) -> Column:
    """Names of the functions in a JSON array of tool schemas; empty where it does not parse."""
    parsed = F.from_json(_col(c), "array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>")
    return F.coalesce(F.transform(F.filter(parsed, lambda t: t["function"]["name"].isNotNull()), lambda t: t["function"]["name"]), F.array().cast("array<string>"))


#: Expressions of one exam paper, and the words before a ratio there.
PAPER_EXPRESSIONS = {"2 × a - 3 2 5 = 47 5": "2 \\times a - 3\\frac{2}{5} = \\frac{47}{5}", "3 8 4 48 ... 7 5 7 30 + + - =": "\\frac{3}{8} + \\frac{4}{48} - \\frac{7}{5} - \\frac{7}{30} ="}
RATIO = "tỉ số là"


def paper_rewrites(c: Column | str, expressions: dict[str, str] | None = None) -> Column:
    """Expressions of a known paper as mathematics, and a ratio of two numbers as a fraction."""
    c = _col(c)
    for was, becomes in (PAPER_EXPRESSIONS if expressions is None else expressions).items():
        c = F.replace(c, F.lit(was), F.lit(becomes))
    return F.regexp_replace(c, f"{RATIO}\\s+(\\d+)\\s+(\\d+)", f"{RATIO} \\$\\\\frac{{$1}}{{$2}}\\$")


def minhash(tokens: Column | str, functions: int = 16) -> Column:
    """The least md5 of number and token for each of the hash functions; null without tokens."""
    tokens = _col(tokens)

    def least(k: int) -> Column:
        return F.array_min(F.transform(tokens, lambda t: F.md5(F.concat(F.lit(f"{k}:"), t))))

    return F.when(F.size(tokens) > 0, F.array(*map(least, range(functions))))


def lsh_buckets(signature: Column | str, rows: int = 2) -> Column:
    """array<struct<band, bucket>>: a bucket for each `rows` values of a signature, in which similar sets meet."""
    signature = _col(signature)
    starts = F.sequence(F.lit(0), (F.size(signature) / rows).cast("int") - 1)
    return F.transform(starts, lambda b: F.struct(b.alias("band"), F.md5(F.array_join(F.slice(signature, b * rows + 1, F.lit(rows)), ",")).alias("bucket")))


def judgement(c: Column | str) -> Column:
    """struct(accuracy, style) of a judge's JSON answer; both null where it does not parse or lacks a score."""
    parsed = F.from_json(_col(c), "accuracy struct<analysis:string,score:int>, style struct<analysis:string,score:int>")
    whole = parsed["accuracy"]["score"].isNotNull() & parsed["style"]["score"].isNotNull()
    return F.struct(F.when(whole, parsed["accuracy"]["score"]).alias("accuracy"), F.when(whole, parsed["style"]["score"]).alias("style"))


def image_tag(image: Column | str, longest: int = 100) -> Column:
    """The beginning of an image's base64 text in a tag."""
    return F.concat(F.lit("<image>"), F.substring(F.base64(_col(image)), 1, longest), F.lit("</image>"))
