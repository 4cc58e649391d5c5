"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from changemap import params as P


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def millis_to_date(c: Column | str) -> Column:
    """Epoch milliseconds to a UTC calendar date, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(as_col(c) / F.lit(86_400_000)).cast("int"))


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def scale_to_byte(prob: Column | str, top: int = P.SCALE_MAX) -> Column:
    """0..1 to 0..255 by truncation.

    A mean over orbits depends on the order of the sum in its last bits; the tiny
    offset keeps a mean that is exactly a step from falling to the step below.
    """
    return (as_col(prob) * F.lit(float(top)) + F.lit(1e-9)).cast("int")


def decode_class(
    code: Column | str, names: Mapping[int, str] = P.CLASS_NAMES, default: str = P.UNKNOWN_CLASS
) -> Column:
    """Class code to its name, ``default`` for null or unlisted codes."""
    flat = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*flat), as_col(code).cast("int")), F.lit(default))


def location_key(x: Column | str, y: Column | str, digits: int = 6) -> tuple[Column, Column]:
    """Two columns naming a location: coordinates rounded half to even."""
    return F.bround(as_col(x), digits), F.bround(as_col(y), digits)


def area_at_least(area: Column | str, minimum: float = P.MIN_AREA_M2, inclusive: bool = True) -> Column:
    a = as_col(area)
    return a >= minimum if inclusive else a > minimum


def require_all(cols: Sequence[str]) -> Column:
    """True when none of ``cols`` is null."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def safe_ratio(num: Column, den: Column) -> Column:
    """``num/den`` with 0 where the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)
