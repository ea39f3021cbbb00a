"""The hierarchical index of 64-bit SimHashes is the first search of near copies."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_copies
from tessera.llm.common import Scratch
from tessera.llm.simhash import shingle_hashes


def test_the_index_links_what_lies_within_its_radius(spark):
    rows = []
    for s in range(40):
        words = [f"w{s}x{k}" for k in range(400)]
        rows += [(s, " ".join(words)), (100 + s, " ".join([*words[:-1], "other"])), (200 + s, f"alone {s} of six words")]
    rows += [(300, ""), (301, None)]
    sketches = near_copies.with_sketches(spark.createDataFrame(rows, "doc_id long, text string"), 5).localCheckpoint()
    firsts = sketches.groupBy("id").agg(F.min(F.struct("text_hash", "n", "keys", "print")).alias("s")).select("id", "s.*")
    name = {r.id: r.doc_id for r in sketches.collect()}
    with Scratch(spark) as scratch:
        found = {tuple(sorted((name[r.a], name[r.b]))) for r in near_copies.index_pairs(firsts, 0.8, scratch).collect()}
    word = {i: int(near_copies.wide_fingerprint(np.unique(shingle_hashes(t or "", 5)))[0]) for i, t in rows}
    near = {(s, 100 + s) for s in range(40) if (word[s] ^ word[100 + s]).bit_count() <= near_copies.NEAR}
    assert near and near <= found and not any({300, 301} & set(p) for p in found)


def test_the_stage_asks_the_index_first(spark, monkeypatch):
    asked, plain = [], near_copies.links
    monkeypatch.setattr(near_copies, "links", lambda fps, scratch, radius: asked.append(radius) or plain(fps, scratch, radius))
    text = " ".join(f"w{k}" for k in range(400))
    found = near_copies.near_copies(spark.createDataFrame([(1, text), (2, text + " more"), (3, "x y z"), (4, "")], "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 4} and asked == [near_copies.NEAR]
