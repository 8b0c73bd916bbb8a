"""Contracts without Spark."""

import pytest

from cairn.operators import settings as S


def test_sections():
    assert S.column_sections(["id__a", "raw__x", "raw__y", "__fold__"]) == {"id__": 1, "raw__": 2, "__fold__": 1}
    with pytest.raises(ValueError):
        S.column_sections(["other"])


def test_release_label():
    assert S.release_label({"release": "v3.4.0"}) == "v3.4.0"
    assert S.release_label({"slim_tables": "x"}, "/data/v2.1.2/db") == "v2.1.2-slim"
    with pytest.raises(ValueError):
        S.release_label({}, "/data")


def test_sweep():
    rows = [{"name": "a", "top_n": "all"}, {"name": "b", "mutation_selector": "seeded", "top_n": " 50 ", "fold_strategy": ""}]
    assert S.sweep(rows) == [S.Setting("a", top_n=None), S.Setting("b", "seeded", 50)]
    for bad in ({"name": "x", "mutation_selector": "chi2"}, {"name": "x", "mutation_selector": "rank_association"}, {"name": "x", "mutation_selector": "none"}):
        with pytest.raises(ValueError):
            S.sweep([bad])
    with pytest.raises(ValueError):
        S.sweep([{"name": "a"}, {"name": "a"}])
