"""Column helpers for ordered daily series: windows, null rules, calendar labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(by: str | list[str] = "symbol", date: str = "date") -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by)).orderBy(date)


def rolling(agg: Callable[[Column], Column], c: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """A rolling aggregate of n rows, null until ``least`` (n by default) values are there."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= (n if least is None else least), agg(c).over(frame))


def change(c: Column, w: WindowSpec, k: int) -> Column:
    """Relative change over k rows; gaps are filled forward first."""
    filled = ffill(c, w)
    return F.try_divide(filled, F.lag(filled, k).over(w)) - 1


def ffill(c: Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def flag(c: Column) -> Column:
    """A comparison with null is false."""
    return F.coalesce(c, F.lit(False))


def friday(d: Column) -> Column:
    """The Friday that ends the week of a day: (previous Friday, Friday]."""
    return F.next_day(F.date_sub(d, 1), "FRI")


def sunday(d: Column) -> Column:
    return F.next_day(F.date_sub(d, 1), "SUN")


def last_known(c: str, date: str = "date") -> Column:
    """The group's last non-null value, by date."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(date)))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once, where they stand.

    Expressions that later steps mention several times would otherwise be copied into
    each mention, filters below included, and grow beyond what is compiled. A
    generator of one row keeps them apart.
    """
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))
