"""Personal data: running sums, overlaps and replaced spans against plain Python, and time that grows with the text."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 128, 4095, 4097, 9000])
def test_running_sums_in_blocks(spark, n):
    rng = random.Random(n)
    values = [rng.randint(0, 9) for _ in range(n)]
    df = spark.createDataFrame([(values,)], "v array<int>")
    sums, most = df.selectExpr(pii._running("v"), pii._running("v", "greatest({0}, {1})")).first()
    assert sums == [sum(values[: k + 1]) for k in range(n)] and most == [max(values[: k + 1]) for k in range(n)]


def test_tokens_that_overlap_are_not_free(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        at, tokens = 0, []
        for _ in range(rng.randint(0, 150)):
            at += rng.randint(0, 9)
            tokens.append((at, at + rng.randint(1, 8), "v", "p"))
            at = tokens[-1][1]
        others = [(a, a + rng.randint(1, 30), "o", "p") for a in (rng.randint(0, 1200) for _ in range(rng.randint(0, 40)))]
        rows.append((k, tokens, others))
    kind = pii.SPANS
    found = spark.createDataFrame(rows, f"k int, t {kind}, o {kind}").select("k", F.expr(pii.free("t", "o")).alias("free")).collect()
    for (_, tokens, others), r in zip(rows, sorted(found, key=lambda r: r.k), strict=True):
        assert [tuple(x) for x in r.free] == [t for t in tokens if not any(o[0] < t[1] and t[0] < o[1] for o in others)]


def test_replaced_spans_of_long_texts(spark):
    rng = random.Random(6)
    words = ["plain", "日本", "a@b.cc", "10.0.0.1", "+1 555 1234567", "x@1.2.3.4", "é" * 50, "4111 1111 1111 1111"]
    texts = [" ".join(rng.choices(words, k=k)) for k in (1, 5, 400, 3000)]
    df = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    tags = {"a@b.cc": "<EMAIL>", "10.0.0.1": "<IP>", "+1 555 1234567": "<PHONE>", "x@1.2.3.4": "<EMAIL>", "4111 1111 1111 1111": "<CARD>"}
    for k, text in enumerate(texts):
        # neighbours of digits and blanks can run together, so only texts without such are compared word by word
        plain = " ".join(tags.get(w, w) for w in text.split(" ")) if "+1" not in text and "4111" not in text and "10.0" not in text else None
        assert out[k].n_chars == len(out[k].text) and "@" not in out[k].text and (plain is None or out[k].text == plain)
        assert out[k].text.count("日本") == text.count("日本") and out[k].text.count("é") == text.count("é")


@pytest.mark.parametrize("unit", ["ab12345 ", "ab12345 a@b.cc ", "ab12345,x@y.zz,", "+1 555 1234567 q "])
def test_time_grows_with_the_text(spark, unit):
    times = []
    for kb in (4, 128, 512):
        df = spark.createDataFrame([(1, unit * (kb * 1024 // len(unit)))], "doc_id long, text string")
        began = time.perf_counter()
        pii.measured(df).selectExpr("size(seen)", "size(email)").first()
        times.append(time.perf_counter() - began)
    # four times the text: four times the time at most, and some for the noise of small runs
    assert times[2] < 4 * times[1] + 2 and times[2] < 10
