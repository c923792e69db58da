"""Aggregate expressions whose result does not depend on the order rows arrive in.

Summing doubles in a different order changes the last bits.  Measures are decimal
figures, so they are summed as decimals of ``SCALE`` places, exactly: a rerun, a retry of a
lost executor or another partitioning gives the same sum.  If some value has
more places or is too large for that, the sum is the plain one of doubles.
Nothing is rounded before it is used; ``digits`` rounds a finished sum.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = None
SCALE = 12


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def total(c, digits: int | None = DIGITS) -> Column:
    c = _col(c)
    exact = c.try_cast(f"decimal(38,{SCALE})")
    fits = F.bool_and(c.isNull() | F.coalesce(exact.cast("double") == c, F.lit(False)))
    # At most 38 digits; a sum beyond them is NULL, and then the plain one counts.
    s = F.coalesce(F.when(fits, F.try_sum(exact).cast("double")), F.sum(c))
    return s if digits is None else F.round(s, digits)


def partial(c) -> Column:
    """The state of a sum, for a first step over groups: the exact sum, whether it holds all values, and the plain one."""
    c = _col(c)
    exact = c.try_cast(f"decimal(38,{SCALE})")
    fits = F.bool_and(c.isNull() | F.coalesce(exact.cast("double") == c, F.lit(False)))
    plain, n = F.sum(c), F.count(c)
    # A sum beyond 38 digits is NULL although there are values.
    return F.struct(F.try_sum(exact).alias("exact"), (fits & (F.try_sum(exact).isNotNull() | (n == 0))).alias("fits"), plain.alias("plain"))


def merged(state, digits: int | None = DIGITS) -> Column:
    """The total of the states of ``partial``: the same as ``total`` over all values at once."""
    state = _col(state)
    s = F.coalesce(F.when(F.bool_and(state["fits"]), F.try_sum(state["exact"]).cast("double")), F.sum(state["plain"]))
    return s if digits is None else F.round(s, digits)


def mean(c, digits: int | None = DIGITS) -> Column:
    return F.try_divide(total(c, digits), F.count(_col(c)))


def spread(c, digits: int | None = 4) -> Column:
    """Sample standard deviation; NULL for a single value."""
    s = F.stddev_samp(_col(c))
    return s if digits is None else F.round(s, digits)
