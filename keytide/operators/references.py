"""Orphan references: child records whose parent is not in force when they refer to it.

Method: parents and children are tagged and united in one long form, grouped by parent
key, and the children of a group that lack a parent are kept and counted by period. As a
parent holds only for a time, the parent flag is the number of grants open at the child's
instant: a running sum of +1 and -1 edges. Groups are cut into slices of time so that no
task holds a whole key; what is open at the start of a slice comes from sums per slice,
which are combined before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.operators.sliced import even_slices, seconds_of


def standing_grants(leases: DataFrame) -> DataFrame:
    """One row (parent_key, opened, closed) for each grant, from its latest record.

    A grant is (id, granted_at). Rows with a null id or granted_at can be in force for
    nothing and are left out, as are grants closed no later than opened. Records tied on
    recorded_at: the later, and at last the null, closing counts.
    """
    far = F.coalesce("revoked_at", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz"))
    return (
        leases.where(F.col("id").isNotNull() & F.col("granted_at").isNotNull())
        .groupBy(F.col("id").alias("parent_key"), F.col("granted_at").alias("opened"))
        .agg(F.max(F.struct(F.col("recorded_at"), far.alias("far"), F.col("revoked_at"))).alias("latest"))
        .select("parent_key", "opened", F.col("latest.revoked_at").alias("closed"))
        .where(F.col("closed").isNull() | (F.col("closed") > F.col("opened")))
    )


def orphan_references(children: DataFrame, parents: DataFrame, slices: int | None = None) -> DataFrame:
    """Children (ref_table, ref_id) of which no parent is in force at ts.

    ``children``: ref_table, ref_id, parent_key, ts. ``parents``: parent_key, opened,
    closed (null: open for ever), in force while opened <= ts < closed. A child with a null
    or zero parent_key refers to nothing and is no case; one with a null ts is an orphan, as no
    parent can be in force then. Repeated children count once, with their earliest ts.
    Empty parents make every child an orphan; empty children give an empty result.
    """
    kept = children.where(F.col("parent_key").isNotNull() & (F.col("parent_key") != 0)).select("ref_table", "ref_id", "parent_key", "ts")
    edges = parents.select(
        "parent_key",
        F.explode(F.array(F.struct(F.col("opened").alias("ts"), F.lit(1).alias("delta")), F.struct(F.col("closed").alias("ts"), F.lit(-1).alias("delta")))).alias("edge"),
    ).select("parent_key", "edge.ts", "edge.delta").where(F.col("ts").isNotNull())
    none = F.lit(None)
    long = (
        edges.select("parent_key", "ts", F.col("delta").cast("long").alias("delta"), F.lit(1).alias("kind"), none.cast("string").alias("ref_table"), none.cast("long").alias("ref_id"))
        .unionByName(kept.select("parent_key", "ts", F.lit(0).cast("long").alias("delta"), F.lit(2).alias("kind"), "ref_table", F.col("ref_id").cast("long").alias("ref_id")))
        .withColumn("at", seconds_of(F.col("ts")))
    )
    # Cut where references lie close; of the edges no instant has more than its grants.
    long = long.withColumn("slice", even_slices(kept, seconds_of(F.col("ts")), slices)(F.col("at"))).drop("at")
    before = Window.partitionBy("parent_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        long.where(F.col("slice").isNotNull())
        .groupBy("parent_key", "slice")
        .agg(F.sum("delta").alias("delta"))
        .withColumn("delta", F.sum("delta").over(before))
        .where("delta <> 0")
        .select("parent_key", none.cast("timestamp_ntz").alias("ts"), "delta", F.lit(0).alias("kind"), none.cast("string").alias("ref_table"), none.cast("long").alias("ref_id"), "slice")
    )
    upto = Window.partitionBy("parent_key", "slice").orderBy(F.col("ts").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    return (
        long.unionByName(carried)
        .withColumn("open", F.sum("delta").over(upto))
        .where((F.col("kind") == 2) & (F.col("open") <= 0))
        .groupBy("ref_table", "ref_id")
        .agg(F.min("ts").alias("ts"), F.min("parent_key").alias("parent_key"))
    )


def lease_references(change_log: DataFrame, lease_ops: DataFrame) -> DataFrame:
    """The references to leases of both tables, as children: changes that carry a lease
    (progress marks, with a null key, carry no change) and keepalive, attach and detach."""
    changes = change_log.where(F.col("key").isNotNull()).select(F.lit("change_log").alias("ref_table"), F.col("mod_revision").alias("ref_id"), F.col("lease_id").alias("parent_key"), "ts")
    requests = lease_ops.where(F.lower(F.trim("op")).isin("keepalive", "attach", "detach")).select(F.lit("lease_ops").alias("ref_table"), F.col("op_id").alias("ref_id"), F.col("lease_id").alias("parent_key"), "ts")
    return reduce(DataFrame.unionByName, [changes, requests])


def orphans_by_period(orphans: DataFrame) -> DataFrame:
    """Number of orphans per table and day of ts: ref_table, day (yyyy-MM-dd or null), orphans."""
    return orphans.groupBy("ref_table", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("orphans"))
