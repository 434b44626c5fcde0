"""Rounding that does not depend on the order in which floating sums were added up."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def rounded(value: Column | str, digits: int = 0) -> Column:
    """Half-up at `digits` after a first rounding to nine decimals, which takes away the noise of binary sums."""
    c = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.round(c.try_cast("decimal(28,9)"), digits).cast("double"), c.cast("double"))


def mean_over(value: Column | str, w: WindowSpec) -> Column:
    """Mean over a window, the same in any order of rows: from an exact sum, or the plain mean if a value has more than nine decimals or 19 digits before them."""
    c = F.col(value) if isinstance(value, str) else value
    exact = c.try_cast("decimal(28,9)")
    fits = F.bool_and(F.coalesce(exact.cast("double") == c, c.isNull())).over(w)
    return F.when(fits, F.try_divide(F.sum(exact).over(w).cast("double"), F.count(c).over(w))).otherwise(F.avg(c).over(w))


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where either side doesn't vary (the built-in one fails there in ANSI mode)."""
    return rounded(F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)), 4)
