"""Joins by key with one row per key on the looked-up side."""

import pytest

from tidycell.operators import joins as J


def test_a_repeated_key_is_an_error(rows):
    left = rows("year int, region_code string, value double", (2020, "1", 1.0), (2021, "1", 2.0))
    once = rows("year int, region_code string, gdp double", (2020, "1", 5.0), (2022, "1", None))
    assert sorted(tuple(r) for r in J.join_series(left, once, "left").collect()) == [(2020, "1", 1.0, 5.0), (2021, "1", 2.0, None)]
    twice = once.union(once)
    with pytest.raises(Exception, match="several rows"):
        J.join_series(left, twice).collect()
