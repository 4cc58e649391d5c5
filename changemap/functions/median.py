"""Exact grouped medians in one plan, for groups of any size and any distribution.

Groups of up to ``SMALL`` values are sorted as one array each. The others are counted, never
ranked: a double has an image among the 64-bit whole numbers that keeps order, and its middle
is found digit by digit. Each round counts the values below the prefix found so far by
their next digit, in partial sums dealt out by value, and picks the digit that holds the middle
rank; after the last one the prefix is one value. The number of rounds is fixed, a group has at
most ``2 ** 22`` counts in a round, and where no group is large adaptive execution drops all of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values up to which a group is held by one task. There are at most as many larger groups as
# rows / SMALL, two million at 10 ** 12 rows; their keys are what is broadcast.
SMALL = 500_000
_SHIFTS = (42, 20, 0)  # what is right of the digits: 22, 22 and 20 bits

# The image of a double ``_v``, in three steps: its size and a guess of its exponent; the exponent;
# exponent and fraction as the bits have them, negated for negative values. Both zeros
# give 0; NaN comes last. The power of two is divided out in halves, so that neither overflows.
_IMAGE = (
    "SELECT *, abs(_v) AS _a, least(floor(log2(abs(_v))), 1023L) AS _g FROM {0}",
    "SELECT *, greatest(_g + CAST(_a >= pow(2D, _g + 1) AS INT) - CAST(_a < pow(2D, _g) AS INT), -1022L) AS _e FROM ({0})",
    """SELECT * EXCEPT (_a, _g, _e), CASE WHEN _v < 0 THEN -1L ELSE 1L END * CASE WHEN _a = 0 THEN 0L
 WHEN isnan(_a) THEN 9223372036854775807L WHEN _a = double('Infinity') THEN 9218868437227405312L
 ELSE (_e + 1022) * 4503599627370496L
 + CAST(_a / pow(2D, floor(_e / 2)) / pow(2D, _e - floor(_e / 2)) * 4503599627370496D AS BIGINT) END AS _i FROM ({0})""",
)


def _image_sql(table: str) -> str:
    return reduce(lambda inner, step: step.format(inner), _IMAGE, table)


def image(df: DataFrame) -> DataFrame:
    """``df`` with ``_i``, a whole number for each double of ``_v``: its bits, in the order of the doubles."""
    return df.sparkSession.sql(_image_sql("{rows}"), rows=df)


def _same(x: str, y: str, names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{x}.`{k}`").eqNullSafe(F.col(f"{y}.`{k}`")) for k in names])


def counted_median(df: DataFrame, keys: Sequence[str], medians: dict[str, str]) -> DataFrame:
    """``keys`` and an exact median for each ``output: column``, found by counting; nulls are left
    out. Groups without any value have no row."""
    names = [f"`{k}`" for k in keys]
    one = ", ".join([*names, "_b"])
    mine = " AND ".join(f"x.{k} <=> y.{k}" for k in [*names, "_b"])
    series = ", ".join(f"named_struct('_b', {i}, '_v', CAST(`{c}` AS DOUBLE))" for i, c in enumerate(medians.values()))
    steps = [
        f"vals AS (SELECT {one}, _v + 0D AS _v, count(*) AS _c FROM (SELECT {', '.join(names)}, inline(array({series})) FROM {{rows}})"
        f" WHERE _v IS NOT NULL GROUP BY {one}, _v + 0D)",
        f"im AS ({_image_sql('vals')})",
        # the two middle ranks from 0, equal for an odd number: one series each
        f"f0 AS (SELECT {one}, posexplode(array_distinct(array((_n - 1) DIV 2, _n DIV 2))) AS (_t, _r)"
        f" FROM (SELECT {one}, sum(_c) AS _n FROM im GROUP BY {one}))",
    ]
    below = ""
    for k, shift in enumerate(_SHIFTS, 1):
        steps.append(
            f"h{k} AS (SELECT /*+ BROADCAST(y) */ {', '.join(f'x.{c}' for c in [*names, '_b'])}, y._t, shiftright(x._i, {shift}) AS _p, first(y._r) AS _r,"
            f" sum(x._c) AS _m, min(x._v) AS _v FROM im x JOIN f{k - 1} y ON {mine}{below}"
            f" GROUP BY {', '.join(f'x.{c}' for c in [*names, '_b'])}, y._t, shiftright(x._i, {shift}))")
        steps.append(
            f"f{k} AS (SELECT {one}, _t, _r - _w AS _r, _p, _v FROM (SELECT *, coalesce(sum(_m) OVER (PARTITION BY {one}, _t ORDER BY _p"
            f" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _w FROM h{k}) WHERE _w <= _r AND _r < _w + _m)")
        below = f" AND shiftright(x._i, {shift}) = y._p"
    out = ", ".join(f"sum(CASE WHEN _b = {i} THEN _v / _k END) AS `{o}`" for i, o in enumerate(medians))
    return df.sparkSession.sql(
        f"WITH {', '.join(steps)} SELECT {', '.join(names)}, {out}"
        f" FROM (SELECT *, count(*) OVER (PARTITION BY {one}) AS _k FROM f{len(_SHIFTS)}) GROUP BY {', '.join(names)}", rows=df)


def _middle(array: str) -> str:
    """The median of a sorted array without nulls."""
    hi = f"`{array}`[size(`{array}`) DIV 2]"
    return f"CASE WHEN size(`{array}`) = 0 THEN NULL WHEN size(`{array}`) % 2 = 1 THEN {hi} ELSE `{array}`[size(`{array}`) DIV 2 - 1] / 2 + {hi} / 2 END"


def grouped_agg(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], medians: dict[str, str], small: int | None = None) -> DataFrame:
    """``groupBy(keys).agg(aggs + medians)``. ``medians`` maps output name to input column,
    ``aggs`` must be mergeable aggregates of fixed size, which combine before their shuffle."""
    keys, small = list(keys), SMALL if small is None else small
    if not medians:
        return df.groupBy(*keys).agg(*aggs)
    rest = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()
    columns = list(dict.fromkeys(medians.values()))
    most = [F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)]
    large = reduce(lambda a, b: a | b, [F.col(f"_n{i}") > small for i in range(len(columns))])
    hot = F.broadcast(df.groupBy(*keys).agg(*most).where(large).select(*keys)).alias("y")
    values = df.select(*keys, *[c for c in columns if c not in keys]).alias("x")
    cold = values.join(hot, _same("x", "y", keys), "left_anti")
    arrays = cold.groupBy(*keys).agg(*[F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"_a{i}") for i, c in enumerate(columns)])
    few = arrays.select(*keys, *[F.expr(_middle(f"_a{columns.index(c)}")).alias(o) for o, c in medians.items()])
    mid = few.unionByName(counted_median(values.join(hot, _same("x", "y", keys), "left_semi"), keys, medians))
    return rest.alias("x").join(mid.alias("y"), _same("x", "y", keys), "left").select("x.*", *[f"y.{o}" for o in medians])
