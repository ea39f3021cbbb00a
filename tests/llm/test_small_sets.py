"""Near copies whose sets of shingles are so small that their fingerprints lie far apart."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import near_copies
from tessera.llm.simhash import shingle_hashes


def pair(seed: int, size: int) -> tuple[str, str]:
    """Texts of size + 1 and size five-word shingles, the second's all among the first's."""
    words = [f"w{seed}x{k}" for k in range(size + 5)]
    return " ".join(words), " ".join(words[:-1])


def distance(one: str, two: str) -> int:
    a, b = (near_copies.wide_fingerprint(np.unique(shingle_hashes(t, 5))) for t in (one, two))
    return int(np.bitwise_count(a ^ b).sum())


def test_links_of_small_sets_are_kept(spark):
    far = {size: [distance(*pair(seed, size)) for seed in range(12_000 if size == 4 else 2_000)] for size in (4, 5, 12)}
    assert max(far[4]) <= near_copies.SMALL_RADIUS and max(far[5] + far[12]) <= near_copies.RADIUS
    # all pairs of 4 and 5 shingles that lie beyond the radius of larger sets, or near it, and some of the others
    seeds = [s for s, d in enumerate(far[4]) if d > near_copies.RADIUS - 12 or s < 300]
    assert max(far[4][s] for s in seeds) > 16 * near_copies.WIDTH
    rows = [(2 * s + k, t) for s in seeds for k, t in enumerate(pair(s, 4))]
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    groups = found.groupBy("component_id").agg(F.collect_set("doc_id").alias("ids")).collect()
    assert sorted(tuple(sorted(r.ids)) for r in groups) == [(2 * s, 2 * s + 1) for s in seeds]


def test_open_members_of_small_sets_meet_in_bands_of_many(spark):
    """A hub and its parts: sets of five shingles, and each of the two sets of four that are in them, all with shared bands."""
    rows = []
    for s in range(60):
        words = [f"v{s}x{k}" for k in range(9)]
        rows += [(3 * s, " ".join(words)), (3 * s + 1, " ".join(words[1:])), (3 * s + 2, " ".join(words[:-1]))]
    # and a chain of large sets, whose task has no small ones
    long = [f"u{k}" for k in range(60)]
    rows += [(1000 + k, " ".join(long[2 * k : 2 * k + 40])) for k in range(8)]
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.where("doc_id >= 1000").collect()} == {1000}
    assert all(r.component_id == r.doc_id - r.doc_id % 3 for r in found.where("doc_id < 1000").collect())
