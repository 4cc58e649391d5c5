"""The seven statistics of one value series, as aggregate columns.

``skew`` and ``kurtosis`` are the bias-corrected sample forms, so the built-in
population moments are rescaled by the number of values.  A constant group has
skew and kurtosis 0; too few values give null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from changemap import params as P


_REDUCERS = {
    "mean": "avg({v})",
    "stdDev": "stddev_samp({v})",
    "median": "median({v})",
    "min": "min({v})",
    "max": "max({v})",
    "skew": """CASE WHEN count({v}) < 3 THEN NULL WHEN min({v}) = max({v}) THEN 0D
        ELSE skewness({v}) * sqrt(count({v}) * (count({v}) - 1)) / (count({v}) - 2) END""",
    "kurtosis": """CASE WHEN count({v}) < 4 THEN NULL WHEN min({v}) = max({v}) THEN 0D
        ELSE (count({v}) - 1) / ((count({v}) - 2) * (count({v}) - 3)) * ((count({v}) + 1) * kurtosis({v}) + 6) END""",
}


def reducer(name: str, value: str) -> Column:
    """Aggregate of a column for one reducer name; unknown names raise."""
    if name not in _REDUCERS:
        raise ValueError(f"unknown reducer {name!r}; use one of {sorted(_REDUCERS)}")
    return F.expr(_REDUCERS[name].format(v=f"`{value}`"))


def moments(value: str, names: Sequence[str] = P.REDUCERS, prefix: str | None = None) -> list[Column]:
    """Aggregates of ``value`` named ``{prefix}_{reducer}``."""
    p = value if prefix is None else prefix
    return [reducer(r, value).alias(f"{p}_{r}" if p else r) for r in names]
