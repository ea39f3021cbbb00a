"""Few edges are joined in one task, and near copies of a small table ask little of the driver."""

import random

from tessera.llm import near_copies
from tessera.llm.common import Scratch
from tessera.llm.simhash import joined


def test_one_task_gives_what_rounds_give(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(150)] + [(k + 1, k) for k in range(1000, 1030)] + [(7, 7)]
    with Scratch(spark) as scratch:
        table = scratch.stored(spark.createDataFrame(edges, "a long, b long").repartition(5))
        one, rounds = ({(r.node, r.root) for r in joined(table, scratch, few).collect()} for few in (len(edges), len(edges) - 1))
        assert one == rounds and {n for e in edges for n in e} == {n for n, _ in one}
        assert joined(table.limit(0), scratch).count() == 0


def test_near_copies_of_a_small_table_take_few_shuffles(spark):
    """Each shuffle takes threads and plans in the driver: one round for heads, none for few edges."""
    rng = random.Random(7)
    rows = []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(120)]
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words[:-1], "x"])), (3 * k + 2, " ".join(["y", *words[1:-4], "z"]))]
    sc = spark.sparkContext
    sc.setJobGroup("few", "few")
    found = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {r.doc_id: r.component_id for r in found} == {k: k // 3 * 3 for k in range(180)}
    assert jobs < 120
