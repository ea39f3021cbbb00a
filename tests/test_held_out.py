"""Held-out texts judged a slice of the vocabulary after the other."""

import pytest

from tessera.operators import language_models as M


def test_slices_judge_as_the_whole_model_does(spark):
    train = spark.createDataFrame([(0, "a b a b c a"), (0, "b c A"), (1, "x y z x y"), (1, None)], "fold int, text string")
    held = spark.createDataFrame([(0, 1, "a b x c"), (0, 1, "c a b"), (1, 2, "x y a"), (5, 3, "a b"), (0, 4, ""), (1, 5, None), (0, None, "b c")], "fold int, k long, text string")
    want = {r.k: (r.n_words, r.perplexity) for r in M.kneser_ney_perplexity(M.kneser_ney(train, by="fold", order=2), held, "k").collect()}
    found = M.held_out_perplexity(train, held, "k", order=2, by="fold", slices=2).collect()
    assert len(found) == len(want) == 6
    for r in found:
        assert r.n_words == want[r.k][0] and r.perplexity == (want[r.k][1] and pytest.approx(want[r.k][1]))
