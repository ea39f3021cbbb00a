"""The pipeline's stages against plain-Python versions of what they say, over a whole table with odd rows added."""

import hashlib
import re

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import packing, pii, toxicity
from tessera.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output; documents with null and repeated ids, null, empty and repeated texts, and a clashing column."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    long = " ".join(f"w{k}" for k in range(30_000))
    odd = [(None, "null id one two three four five", None), (None, None, "en"), (None, "null id one two three four five", None), (7, "a text of its own for seven", "en"), (90_001, "", "en"), (90_002, " \n\t", None), (90_003, long, "en"), (90_003, long, "en"), (90_004, long + " end", "de")]
    odd = spark.createDataFrame([(i, t, s, s, None if t is None else len(t)) for i, t, s in odd], docs.schema)
    docs = docs.union(odd).withColumn("score", F.lit(5.0)).withColumn("row", F.lit("mine"))
    docs.write.parquet(f"{folder}/in")
    docs, seen = spark.read.parquet(f"{folder}/in"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        seen[name] = docs, (docs := spark.read.parquet(f"{folder}/{k}"))
    return seen


def both(stages, name):
    before, after = stages[name]
    return [r.asDict() for r in before.collect()], [r.asDict() for r in after.collect()]


def plain_score(text, model):
    """Trees walked node by node, and the calibration read off by hand."""
    x = toxicity.features(text or "", model.lexicon)
    raw = model.trees.base
    for feature, cut, leaf in zip(model.trees.feature, model.trees.cut, model.trees.leaf, strict=True):
        node = 0
        for _ in range(model.trees.depth):
            node = 2 * node + (2 if x[feature[node]] > cut[node] else 1)
        raw += leaf[node - (2**model.trees.depth - 1)]
    at, rate = model.at.tolist(), model.rate.tolist()
    if raw <= at[0] or raw >= at[-1]:
        return rate[0] if raw <= at[0] else rate[-1]
    k = next(k for k in range(len(at)) if at[k] >= raw)
    return rate[k] if at[k] == raw else rate[k - 1] + (rate[k] - rate[k - 1]) * (raw - at[k - 1]) / (at[k] - at[k - 1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    before, after = both(stages, "toxicity")
    model = toxicity.train(stages["toxicity"][0], spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in before if plain_score(r["text"], model) < toxicity.THRESHOLD)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in after) == kept and len(kept) > 0.8 * len(before)
    assert all(r["score"] == 5.0 and r["row"] == "mine" for r in after)


def shingles(text):
    words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])


def test_one_document_of_each_near_duplicate_group_stays(stages):
    before, after = both(stages, "near_dedup")
    sets = [shingles(r["text"]) for r in before]
    label = list(range(len(before)))
    links = [(i, j) for j in range(len(before)) for i in range(j) if sets[i] == sets[j] or min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    assert links and len(after) == len(set(label)) < len(before)
    left = [shingles(r["text"]) for r in after]
    groups = {}
    for k, r in enumerate(before):
        groups.setdefault(label[k], []).append(r)
    for rows in groups.values():
        ids = {r["doc_id"] for r in rows}
        least = min((i for i in ids if i is not None), default=None)
        assert sum(r["doc_id"] == least and any(r["text"] == x["text"] for x in rows) for r in after) >= 1
    assert all(len(a & b) < 0.8 * len(a | b) for k, a in enumerate(left) for b in left[:k])


def test_personal_data_is_replaced_and_nothing_else(spark, stages):
    before, after = both(stages, "pii")
    spans = {}
    for r in pii.with_spans(stages["pii"][0]).collect():
        found = sorted((s.start, s.end, kind) for kind in (*pii.KINDS, pii.FOUND) for s in r[kind])
        spans[r.doc_id, r.h] = found
    hashes = {(r.doc_id, r.text): r.h for r in stages["pii"][0].selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()}
    want, n = [], 0
    for r in before:
        text, out, at = r["text"], "", 0
        merged = []
        for start, end, kind in spans[r["doc_id"], hashes[r["doc_id"], text]]:
            if merged and start < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end, kind])
        for start, end, kind in merged:
            out, at, n = out + text[at:start] + f"<{kind.upper()}>", end, n + 1
        new = text if text is None or not merged else out + text[at:]
        want.append((str(r["doc_id"]), new, r["n_chars"] if not merged else len(new), r["row"]))
    key = lambda x: (x[0], str(x[1]))
    assert sorted(((str(r["doc_id"]), r["text"], r["n_chars"], r["row"]) for r in after), key=key) == sorted(want, key=key) and n


def targets(sizes):
    """By source; the excess over twice a source's size is dealt again, by weight, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    capped, total = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in capped]
        spare = total - sum(capped.values())
        share = {s: spare * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] >= 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing_takes_the_words_of_two_passes(stages):
    before, after = both(stages, "mixing")
    words = [WORD.findall(r["text"] or "") for r in before]
    sizes = {}
    for r, w in zip(before, words, strict=True):
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(w)
    goal = {s: int(np.floor(x + 0.5)) for s, x in targets(sizes).items()}
    taken = []
    for s in sizes:
        own = sorted((hashlib.md5(("null" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest(), r["doc_id"] or -1, len(w), k) for k, (r, w) in enumerate(zip(before, words, strict=True)) if r["source"] == s)
        left = goal[s]
        for _ in range(2):
            for *_, size, k in own:
                if n := min(size, left):
                    taken.append((str(before[k]["doc_id"]), words[k][:n]))
                left -= n
    assert sorted((str(r["doc_id"]), WORD.findall(r["text"])) for r in after) == sorted(taken)


def test_packing_holds_every_token_once(stages):
    from tokenizers import Tokenizer

    before, after = both(stages, "packing")
    plain = Tokenizer.from_file(packing.public_tokenizer())
    lengths = sorted(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in before)
    assert sum(lengths) == sum(r["length"] for r in after)
    last = {}
    for r in after:
        assert r["piece"] == 0 or r["length"] == packing.LENGTH
        last[r["doc_id"]] = max(last.get(r["doc_id"], 0), r["start"] + r["length"])
    longest = {}
    for r in before:
        longest[r["doc_id"]] = max(longest.get(r["doc_id"], 0), len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1)
    assert last == longest
    bins = {}
    for r in after:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert len(bins) <= -(-sum(lengths) // packing.LENGTH) * 1.02 + 1


def test_an_empty_table_passes_through(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) == 13
