"""Column functions against plain Python, and worked examples."""

import hashlib
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import scores as S
from tessera.functions import text as T

SAMPLES = ["", " ", "  \x1c a  b\t", "...", "the of", "Đức straße İstanbul é 漢字 😀", "x" * 1001, "Câu 12. CÂU", None, "don't stop", "A1 b_2"]


def run(spark, column, texts=SAMPLES):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_normalisation_matches_python(spark):
    collapsed = [None if t is None else " ".join(t.split()) for t in SAMPLES]
    assert run(spark, T.collapse_spaces("t")) == collapsed
    assert run(spark, T.text_hash("t")) == [None if t is None else hashlib.md5(t.encode()).hexdigest() for t in collapsed]
    assert run(spark, T.words("t")) == [None if t is None else t.split() for t in SAMPLES]
    assert run(spark, T.to_ascii("t")) == [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in SAMPLES]
    assert run(spark, T.transliterate("t"))[5].startswith("Duc strasse Istanbul e")
    assert run(spark, T.is_upper("t"))[7] is False


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=20))
def test_spaces_collapse_as_in_python(spark, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert run(spark, T.collapse_spaces("t"), texts) == [" ".join(t.split()) for t in texts]


def test_exam_lines(spark):
    lines = ["CÂU 12. Tính", "Câu 1: x", "Bài 3 y", "A) one", "b. two", "Phương pháp giải", "Lời bàn", "Đáp án: B", "plain"]
    heads = run(spark, T.question_header("t"), lines)
    assert [h.number for h in heads[:3]] == [12, 1, 3] and heads[3].word is None
    assert [o.letter for o in run(spark, T.option("t"), lines)[3:5]] == ["A", "b"]
    assert run(spark, T.section_of("t"), lines)[5:] == ["method", None, "answer", None]
    assert run(spark, T.strip_question_number("t"), lines)[:2] == ["Tính", "x"]


def test_mathematics(spark):
    texts = ["3/4 + x^2", "√(a+b) × 2", "a = 47 5", "1 2 3 + 4", "plain words", "2 ÷ 3 = y"]
    assert run(spark, T.format_equation("t"), texts) == ["$\\frac{3}{4} + x^{2}$", "$\\sqrt{a+b} \\times 2$", "$a = \\frac{47}{5}$", "$1 - \\frac{2}{3} + 4$", "plain words", "$2 \\div 3 = y$"]
    assert run(spark, T.math_to_latex("t", literal_groups=True), ["3/4"]) == ["\\frac{\\1}{\\2}"]


def test_markup_and_lists(spark):
    assert run(spark, T.image_links("t", 1), ["a ![x](u) ![](v)", "none"]) == [["u"], []]
    assert run(spark, T.without_images("t", " ", 5), ["abc ![x](u) defg", "ab"]) == ["abc d...", "ab"]
    assert run(spark, T.int_list("t"), ["[1, 2]", None, "", "bad"]) == [[1, 2], [], [], None]
    assert run(spark, T.after_last("t", "<m>"), ["a<m>b<m> c", "d"]) == ["c", "d"]
    assert run(spark, T.insert_image_token("t"), ["x", "<image> y", "<start_of_turn>user\nq"]) == ["<image>x", "<image> y", "<start_of_turn>user\n<image>q"]
    out = run(spark, T.judgement("t"), ['{"accuracy":{"score":3},"style":{"score":2}}', "{bad", '{"accuracy":{"score":3}}'])
    assert [(o.accuracy, o.style) for o in out] == [(3, 2), (None, None), (None, None)]
    assert run(spark, T.content_name("t"), ["http://a/b.png?x", "http://a"]) == [hashlib.md5(b"http://a/b.png?x").hexdigest() + ".png", hashlib.md5(b"http://a").hexdigest() + ".jpg"]


def test_shingles_and_chunks(spark):
    assert run(spark, T.shingles(T.words("t"), 3), ["a b c d", "a b"]) == [["a b c", "b c d"], []]
    assert run(spark, T.chunks(T.words("t"), 2, 0.5), ["a b c", ""]) == [[["a", "b"], ["b", "c"], ["c"]], []]


def test_answer_scores(spark):
    df = spark.createDataFrame([("kết quả = 12", "Kết quả = 12"), ("7", "x 7 9"), ("", ""), ("a", "")], "a string, e string")
    m = {n: b(F.col("a"), F.col("e")) for n, b in S.METRICS.items()}
    rows = df.select(*[c.alias(n) for n, c in m.items()], S.weighted(m).alias("w")).collect()
    assert rows[0].keyword_matching == pytest.approx(2 / 12) and rows[0].number_matching == 1 and rows[0].exact_match == 1
    assert rows[1].number_matching == 0.5 and rows[2].length_similarity == 0 and rows[3].number_matching == 0
    assert rows[0].w == pytest.approx(0.3 * 2 / 12 + 0.4 + 0.2 + 0.1)
    with pytest.raises(KeyError):
        S.weighted(m, {"other": 1.0})
    assert re.match("j", "jaccard") and df.select(S.jaccard(T.words("a"), T.words("e")).alias("j")).collect()[2].j is None


def test_fast_patterns_tell_every_character_as_the_plain_ones(spark):
    places = spark.sparkContext.range(0x110000).filter(lambda k: not 0xD800 <= k < 0xE000)
    marks = places.map(lambda k: (chr(k),)).toDF("c string")
    marks = marks.select("c", F.concat(F.lit("a"), "c", F.lit("B")).alias("t"))
    kept = f"[^a-zA-Z0-9_\\x20\\p{{L}}\\p{{N}}{T.SPACE}]+"
    assert marks.where(F.size(T.words("t")) != F.when(F.col("c").rlike(T.SPACES), 2).otherwise(1)).count() == 0
    assert marks.where(T.remove_punctuation("t") != F.regexp_replace("t", kept, "")).count() == 0
    assert marks.where(T.collapse_spaces("t") != F.trim(F.regexp_replace("t", T.SPACES, " "))).count() == 0
    assert marks.where(F.col("c").rlike(T.SPACES)).count() == 29
