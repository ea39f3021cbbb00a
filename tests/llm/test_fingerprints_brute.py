"""Fingerprints against a plain gear hash, byte by byte, and an order made in one list."""

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tessera.llm import fingerprints as F

GEAR = np.random.default_rng(20_240_229).integers(0, 1 << 32, 256, dtype=np.uint32).tolist()
SIGNS = "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def plain_chunks(text):
    raw = " ".join(text.lower().split()).encode()
    out, start, values = {}, 0, []
    h = 0
    for byte in raw:
        h = (2 * h + GEAR[byte]) % 2**32
        values.append(h)
    while start < len(raw):
        end = len(raw)
        for k in range(start + 8, min(len(raw), start + 129)):
            size, v = k - start, values[k - 1]
            if size <= 32 and v < 2**26 or size >= 32 and v < 2**28 or size == 128:
                end = k
                break
        if len(raw) - start <= 8:
            end = len(raw)
        out[xxhash.xxh3_64_intdigest(raw[start:end]) // 2**16] = end - start
        start = end
    return out


def plain_string(chunks):
    out = ""
    for digest, size in sorted(chunks.items()):
        number = digest * 4096 + size
        out += "".join(SIGNS[number // 64**k % 64] for k in range(9, -1, -1))
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    return sum(w for d, w in a.items() if d in b) / min(sum(a.values()), sum(b.values()))


def texts(rng, n):
    words = ["alpha", "Beta", "größe", "漢字漢字", "x", "  ", "\n", "12345", "theta-iota", "a" * 40]
    return [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 400]))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_chunks_are_those_of_a_plain_gear_hash(seed):
    for text in [*texts(random.Random(seed), 60), "", " \n", "a" * 3000, "ab" * 70]:
        want = plain_chunks(text)
        assert F.chunks(text) == want and F.written(want) == plain_string(want) and F.read(plain_string(want)) == want


def test_rows_are_those_of_one_list(spark):
    rng = random.Random(8)
    rows = [(rng.choice([rng.randrange(200), rng.randrange(200), 77, None]), t) for t in texts(rng, 200)] + [(7, None), (None, None), (None, None), (3, "same"), (3, "same"), (9, "long words " * 20_000)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, part string, guest string")

    def place(row):
        i, t = row
        return (i is None, -(i or 0), hashes[t or ""], t or "")

    hashes = {r.text or "": r.h for r in docs.selectExpr("text", "xxhash64(coalesce(text, '')) / 2 AS h").collect()}
    order = [(i, t or "") for i, t in sorted(rows, key=place)]
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = map(plain_chunks, (t, edited, after))
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_string(a), plain_string(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    for parts in (1, 7, 40):
        out = [(*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in F.fingerprinted(docs, parts=parts).collect()]
        assert sorted(out, key=str) == sorted(want, key=str)
