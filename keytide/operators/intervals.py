"""Continuous periods and gaps of closed intervals that overlap, nest, touch or leave gaps.

Method: session_window with a duration taken from each row merges the intervals of an
entity within one slice of time; then what reaches over from earlier slices is merged
in, touching periods are joined, and gaps come from lead. Slices keep an entity that holds
most rows from filling one task: only one row per entity and slice is ever put together.

session_window works on half-open windows and drops empty ones. Times are therefore doubled, and
an interval [s, e] becomes [2s, 2e + 1): intervals that touch overlap, those a microsecond
apart do not, and one of zero length is a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keytide.operators.sliced import even_slices
from keytide.session import materialize

_EPOCH = "1970-01-01 00:00:00"


def micros(ts: Column) -> Column:
    """Microseconds from 1970 of a timestamp without time zone, whatever the session's."""
    span = ts.cast("timestamp_ntz") - F.lit(_EPOCH).cast("timestamp_ntz")
    return (F.extract(F.lit("DAY"), span).cast("long") * 86_400_000_000 + F.extract(F.lit("HOUR"), span).cast("long") * 3_600_000_000 + F.extract(F.lit("MINUTE"), span).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), span) * 1_000_000).cast("long"))


def text_of(micros_col: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss.SSSSSS of microseconds from 1970, whatever the session's time zone."""
    day = F.floor(micros_col / 86_400_000_000)
    rest = F.pmod(micros_col, F.lit(86_400_000_000))
    return F.concat(
        F.date_format(F.date_from_unix_date(day.cast("int")), "yyyy-MM-dd"),
        F.format_string(" %02d:%02d:%02d.%06d", (rest / 3_600_000_000).cast("int"), F.pmod((rest / 60_000_000).cast("int"), F.lit(60)), F.pmod((rest / 1_000_000).cast("int"), F.lit(60)), F.pmod(rest, F.lit(1_000_000))),
    )


def periods_and_gaps(rows: DataFrame, entity: list[str], start: str, end: str, slices: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Periods (entity, period_start, period_end) and gaps (entity, gap_start, gap_end).

    Times of the results are microseconds from 1970. Intervals are closed: touching
    ones are one period, one of zero length is a period, repeated ones change nothing. Rows with a null in
    ``entity``, ``start`` or ``end``, or with the end before the start, cover nothing. No rows: both results are empty.
    """
    names = [f"e{i}" for i in range(len(entity))]
    valid = F.col(end) >= F.col(start)
    for c in entity:
        valid = valid & F.col(c).isNotNull()
    covered = rows.where(valid).select(*(F.col(c).alias(n) for c, n in zip(entity, names, strict=True)), F.col(start).alias("s_ts"), F.col(end).alias("e_ts")).select(*names, micros(F.col("s_ts")).alias("s"), micros(F.col("e_ts")).alias("e"))
    covered = covered.withColumn("slice", even_slices(covered, F.col("s"), slices)(F.col("s")))
    length = F.make_interval(secs=(((F.col("e") - F.col("s")) * 2 + 1).cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    merged = (
        covered.withColumn("at", F.timestamp_micros(F.col("s") * 2))
        .groupBy(*names, "slice", F.session_window("at", length))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .drop("session_window")
    )
    merged = materialize(merged, "sessions")
    by = Window.partitionBy(*names)
    # What reaches into a slice from earlier ones.
    reach = merged.groupBy(*names, "slice").agg(F.max("e").alias("most")).withColumn("reach", F.max("most").over(by.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select(*names, "slice", "reach")
    held = merged.join(reach, [*names, "slice"])
    opens = F.col("reach").isNull() | (F.col("s") > F.col("reach"))
    # In a slice, the sessions that open no period come before those that do.
    slices = (
        held.groupBy(*names, "slice", "reach")
        .agg(F.min(F.when(opens, F.col("s"))).alias("first_open"), F.max(F.when(~opens, F.col("e"))).alias("joined"), F.max("e").alias("most"))
        .withColumn("closed_at", F.greatest("reach", "joined"))
    )
    final = F.max("most").over(by)
    ends = slices.withColumn("final", final).where("first_open IS NOT NULL").withColumn("last_end", F.coalesce(F.lead("closed_at").over(by.orderBy("slice")), F.col("final"))).withColumn("next_start", F.lead("first_open").over(by.orderBy("slice"))).select(*names, "slice", "last_end", "next_start")
    inside = Window.partitionBy(*names, "slice").orderBy("s")
    periods = (
        held.where(opens)
        .withColumn("later", F.lead("s").over(inside))
        .join(ends, [*names, "slice"])
        .select(*(F.col(n).alias(c) for n, c in zip(names, entity, strict=True)), F.col("s").alias("period_start"), F.when(F.col("later").isNull(), F.col("last_end")).otherwise(F.col("e")).alias("period_end"), F.coalesce("later", "next_start").alias("next_start"))
    )
    gaps = periods.where(F.col("next_start") > F.col("period_end")).select(*entity, F.col("period_end").alias("gap_start"), F.col("next_start").alias("gap_end"))
    return periods.drop("next_start"), gaps
