"""Time windows.

A window list is a short run parameter (about 20 entries), so it enters plans
as an array literal: assigning an observation to its windows or giving a site
every window is a row-local ``explode``, with no join and no broadcast.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changemap import params as P

Span = tuple[dt.date, dt.date]
NAME_PATTERN = r"(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})"  # fixed value: file naming


def window_label(end_post: Column, change_date: dt.date = P.CHANGE_DATE) -> Column:
    """0 when the window ends on or before the change date, else 1."""
    return F.when(end_post <= F.lit(change_date), F.lit(0)).otherwise(F.lit(1))


def window_name(win: Column, start: Column, end: Column) -> Column:
    """``w07_2023-10-07_2023-12-06``"""
    return F.format_string("w%02d_%s_%s", win, start.cast("string"), end.cast("string"))


def window_array(spans: Sequence[Span], first: int = 1) -> Column:
    """Array literal of ``(win, start_post, end_post)`` structs."""
    items = [
        f"named_struct('win', {i}, 'start_post', DATE'{s}', 'end_post', DATE'{e}')"
        for i, (s, e) in enumerate(spans, first)
    ]
    return F.expr(f"array({', '.join(items)})")


def window_table(
    spark: SparkSession, spans: Sequence[Span], change_date: dt.date = P.CHANGE_DATE
) -> DataFrame:
    """``win, start_post, end_post, label, window_id``"""
    return with_id(
        spark.range(1)
        .select(F.inline(window_array(spans)))
        .withColumn("label", window_label(F.col("end_post"), change_date))
    )


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("window_id", window_name(F.col("win"), F.col("start_post"), F.col("end_post")))


def every_window(df: DataFrame, spans: Sequence[Span]) -> DataFrame:
    """One row per input row and window."""
    return df.select("*", F.inline(window_array(spans)))


def pairs(df: DataFrame, pre: Sequence[Span], post: Sequence[Span]) -> DataFrame:
    """One row per input row, pre period and post period."""
    pre_arr = F.array(*[F.struct(F.lit(s).alias("start_pre"), F.lit(e).alias("end_pre")) for s, e in pre])
    return every_window(df.select("*", F.inline(pre_arr)), post)


def _layers(spans: Sequence[Span], first: int) -> list[list[tuple[int, Span]]]:
    """The numbered windows in as few sets of disjoint windows as it takes."""
    layers: list[list[tuple[int, Span]]] = []
    for item in sorted(enumerate(spans, first), key=lambda t: t[1]):
        for layer in layers:
            if layer[-1][1][1] < item[1][0]:
                layer.append(item)
                break
        else:
            layers.append([item])
    return layers


def window_numbers(date_col: str, spans: Sequence[Span], inclusive_end: bool = True, first: int = 1) -> list[str]:
    """Numbers of the windows holding a date: one expression per set of disjoint
    windows, each a compiled chain of comparisons giving a number or null."""
    le = "<=" if inclusive_end else "<"
    return [
        "CASE "
        + " ".join(f"WHEN `{date_col}` >= DATE'{s}' AND `{date_col}` {le} DATE'{e}' THEN {i}" for i, (s, e) in layer)
        + " END"
        for layer in _layers(spans, first)
    ]


def tag(
    df: DataFrame, date_col: str, spans: Sequence[Span], inclusive_end: bool = True, first: int = 1, outside: int | None = None
) -> DataFrame:
    """One row per (row, window number ``win`` holding its date); rows in no window drop out,
    or get the number ``outside``."""
    nums = window_numbers(date_col, spans, inclusive_end, first)
    if outside is not None:
        nums[0] = f"coalesce({', '.join(nums)}, {outside})" if len(nums) == 1 else f"CASE WHEN coalesce({', '.join(nums)}) IS NULL THEN {outside} ELSE {nums[0]} END"
    win = F.expr(nums[0]) if len(nums) == 1 else F.expr(f"explode(array({', '.join(nums)}))")
    return df.select("*", win.alias("win")).where("win IS NOT NULL")


def assign(df: DataFrame, date_col: str, spans: Sequence[Span], inclusive_end: bool = True) -> DataFrame:
    """Range match of dates to windows: one row per (row, window holding it), with
    the window's number and dates."""
    w = F.element_at(window_array(spans), F.col("win"))
    return tag(df, date_col, spans, inclusive_end).select("*", w["start_post"].alias("start_post"), w["end_post"].alias("end_post"))


def from_names(df: DataFrame, name: Column | str = "path") -> DataFrame:
    """Distinct ``start_post, end_post`` found in a name column, sorted."""
    c = F.col(name) if isinstance(name, str) else name
    return (
        df.select(
            F.to_date(F.nullif(F.regexp_extract(c, NAME_PATTERN, 1), F.lit(""))).alias("start_post"),
            F.to_date(F.nullif(F.regexp_extract(c, NAME_PATTERN, 2), F.lit(""))).alias("end_post"),
        )
        .where(F.col("start_post").isNotNull())
        .distinct()
        .orderBy("start_post", "end_post")
    )


def split_sides(start_post: Column | str, change_date: dt.date = P.CHANGE_DATE) -> Column:
    """'before' or 'after' the change date, by window start."""
    c = F.col(start_post) if isinstance(start_post, str) else start_post
    return F.when(c < F.lit(change_date), F.lit("before")).otherwise(F.lit("after"))
