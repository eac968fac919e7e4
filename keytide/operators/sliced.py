"""Running results over groups of any size: groups are cut into slices of their order, and each slice starts
from what a summary of the slices before it carries over. No task holds more than a slice of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows a slice is meant to hold at most, and the least and greatest number of slices.
ROWS_PER_SLICE, LEAST_SLICES, MOST_SLICES = 1_000_000, 16, 4096


def bins_between(cuts: list) -> Callable[[Column], Column]:
    """A function that gives the number of the bin a column's value lies in: how many of the sorted ``cuts`` are no greater than it.

    Few cuts become a tree of comparisons, many a binary search in an array; a null value has no bin.
    """
    padded = F.array(*(F.lit(c) for c in cuts)) if cuts else None
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]

    def tree(value: Column, low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]), tree(value, low, middle)).otherwise(tree(value, middle + 1, high))

    def of(value: Column) -> Column:
        if padded is None:
            found = F.lit(0)
        elif len(cuts) < 32:
            found = tree(value, 0, len(cuts))
        else:
            found = F.aggregate(F.array(*(F.lit(s) for s in steps)), F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(padded, at + step - 1) <= value), at + step).otherwise(at))
        return F.when(value.isNotNull(), found)

    return of


def even_slices(rows: DataFrame, value: Column, most: int | None = None) -> Callable[[Column], Column]:
    """Slices of a number's order that hold like many of ``rows``, as a function that gives a value's slice.

    Cut at quantiles of all rows, into as many slices as keep each near ROWS_PER_SLICE (MOST_SLICES at most): no
    group, however hot or crowded in time, has more rows in a slice than a slice has. Only rows of one value stay together.
    """
    if most == 1:
        return bins_between([])
    number = value.cast("long")
    least = most or LEAST_SLICES
    n, cuts = _quantiles(rows, number, least)
    # A power of two, as many as the rows ask for; a second look where that is more than the first one gave.
    slices = most or min(MOST_SLICES, max(LEAST_SLICES, 1 << max(0, -(-n // ROWS_PER_SLICE) - 1).bit_length()))
    if slices > least:
        n, cuts = _quantiles(rows, number, slices)
    return bins_between(sorted(set(cuts)))


def _quantiles(rows: DataFrame, number: Column, slices: int) -> tuple[int, list[int]]:
    """How many rows have a number, and the values that cut them into so many slices."""
    points = F.array(*(F.lit(i / slices) for i in range(1, slices)))
    row = rows.select(number.alias("v")).agg(F.count("v").alias("n"), F.percentile_approx("v", points, F.lit(max(256, 8 * slices))).alias("q")).first()
    return row.n, list(row.q or [])


def seconds_of(ts: Column) -> Column:
    """Whole seconds from 1970 of a timestamp without time zone, whatever the session's; rises with it, null for null."""
    return F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60 + F.second(ts)


def revision_slice(rows: DataFrame, column: str = "revision", slices: int | None = None) -> Column:
    """Number of the slice that holds a revision; values beyond those of ``rows`` lie in the first and last slice."""
    return even_slices(rows, F.col(column), slices)(F.col(column))


def running_last(rows: DataFrame, keys: list[str], slice_col: str, order: list[str], value: Column, name: str, inclusive: bool) -> DataFrame:
    """``rows`` with ``name``: the last non-null ``value`` of its keys at or before it, or only before it.

    ``order`` rises with ``slice_col`` and tells rows apart; all of it must be orderable.
    """
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    before = Window.partitionBy(*keys).orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.withColumn("_value", value).groupBy(*keys, slice_col).agg(F.max(F.when(F.col("_value").isNotNull(), F.struct(*order, "_value"))).getField("_value").alias("_head"))
    carried = heads.withColumn("_carried", F.last("_head", ignorenulls=True).over(before)).drop("_head")
    return rows.withColumn("_here", F.last(value, ignorenulls=True).over(inside)).join(carried, [*keys, slice_col], "left").withColumn(name, F.coalesce("_here", "_carried")).drop("_here", "_carried")
