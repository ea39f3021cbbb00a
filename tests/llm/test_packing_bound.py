"""An island that meets its bound is left as it is, and ids have their bytes at hand."""

import pytest

from tessera.llm import packing


def test_a_packing_at_its_bound_is_not_packed_again(monkeypatch):
    given = [[0, 1], [2, 3]]
    monkeypatch.setattr(packing, "Packing", lambda *a: pytest.fail("packed again"))
    assert packing.evolve([6, 4, 7, 3], 10, 0, given) == given
