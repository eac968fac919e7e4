"""Queries of the data-processing problems 1 to 5, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators import cdc, incremental, intervals, references, skew
from keytide.plans.registry import Registry
from keytide.session import shared_path
from keytide.sources.tables import table

REGISTRY = Registry()

_GONE = "upper(trim(coalesce(event_type, '0'))) IN ('DELETE', '1')"

_ORPHANS = """
WITH grants AS (
  SELECT id, granted_at, arg_max(coalesce(revoked_at, TIMESTAMP '9999-12-31'), recorded_at) AS closed
  FROM leases WHERE id IS NOT NULL AND granted_at IS NOT NULL GROUP BY id, granted_at),
refs AS (
  SELECT DISTINCT 'change_log' AS ref_table, mod_revision AS ref_id, lease_id, ts FROM change_log WHERE key IS NOT NULL AND lease_id <> 0
  UNION ALL
  SELECT DISTINCT 'lease_ops', op_id, lease_id, ts FROM lease_ops WHERE op IN ('keepalive', 'attach', 'detach') AND lease_id <> 0),
orphans AS (
  SELECT * FROM refs WHERE NOT EXISTS (SELECT 1 FROM grants WHERE grants.id = refs.lease_id AND granted_at <= ts AND closed > ts))
"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = references.lease_references(table(spark, sf_dir, "change_log"), table(spark, sf_dir, "lease_ops"))
    return references.orphan_references(children, references.standing_grants(table(spark, sf_dir, "leases")))


@REGISTRY.add("p1_found", _ORPHANS + "SELECT ref_table, ref_id FROM orphans")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to a lease that is not in force."""
    return _orphans(spark, sf_dir).select("ref_table", "ref_id")


@REGISTRY.add("p1_by_day", _ORPHANS + "SELECT ref_table, strftime(ts, '%Y-%m-%d') AS day, count(*) AS orphans FROM orphans GROUP BY ALL")
def p1_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their number per table and day."""
    return references.orphans_by_period(_orphans(spark, sf_dir))


_LAST = "SELECT *, row_number() OVER (PARTITION BY key ORDER BY mod_revision DESC, seq DESC, feed_pos) AS rn FROM change_log WHERE key IS NOT NULL"


@REGISTRY.add("p2_found", f"SELECT key, mod_revision FROM ({_LAST}) WHERE rn = 1 AND NOT {_GONE}")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys and the revision of the change that made them so."""
    return cdc.live_rows(cdc.apply_feed(table(spark, sf_dir, "change_log"))).select("key", "mod_revision")


@REGISTRY.add("p2_state", f"SELECT key, mod_revision, seq, {_GONE} AS deleted, value, ttl_seconds FROM ({_LAST}) WHERE rn = 1")
def p2_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole state with its tombstones."""
    return cdc.apply_feed(table(spark, sf_dir, "change_log")).select("key", "mod_revision", "seq", "deleted", "value", "ttl_seconds")


_BOUNDS = """
WITH runs AS (SELECT watch_id, run_id, arg_max(coalesce(status, '?'), recorded_at) AS status, max(read_until) AS read_until FROM watch_runs GROUP BY ALL),
last AS (SELECT watch_id, arg_max(status, run_id) AS status, arg_max(read_until, run_id) AS high, max(read_until) FILTER (status = 'ok') AS mark FROM runs GROUP BY watch_id),
bounds AS (SELECT w.watch_id, w.key, w.range_end, coalesce(w.start_revision, 0) AS start_revision, coalesce(mark, created_at) AS low, high
  FROM last JOIN watchers w ON w.watch_id = last.watch_id WHERE status <> 'ok')
"""


@REGISTRY.add(
    "p3_found",
    _BOUNDS
    + """, changes AS (SELECT mod_revision, seq, key, min(arrived_at) AS arrived_at FROM change_log WHERE key IS NOT NULL GROUP BY ALL)
SELECT watch_id, mod_revision, seq FROM bounds b JOIN changes c
ON arrived_at > low AND arrived_at <= high AND mod_revision >= start_revision
AND CASE WHEN coalesce(range_end, '') = '' THEN c.key = b.key ELSE c.key >= b.key AND c.key < range_end END""",
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that the unsuccessful latest runs had to handle."""
    return incremental.resume_watchers(*(table(spark, sf_dir, t) for t in ("change_log", "watchers", "watch_runs")))


@REGISTRY.add("p3_bounds", _BOUNDS + "SELECT watch_id, strftime(low, '%Y-%m-%d %H:%M:%S.%f') AS low, strftime(high, '%Y-%m-%d %H:%M:%S.%f') AS high FROM bounds")
def p3_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermark and upper limit of those runs."""
    bounds = incremental.run_bounds(table(spark, sf_dir, "watchers"), table(spark, sf_dir, "watch_runs"))
    return bounds.select("watch_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("low", "high")))


@REGISTRY.add(
    "p3_second_run",
    _BOUNDS
    + """, halves AS (SELECT *, make_timestamp(epoch_us(low) + (epoch_us(high) - epoch_us(low)) // 2) AS middle FROM bounds),
changes AS (SELECT mod_revision, seq, key, min(arrived_at) AS arrived_at FROM change_log WHERE key IS NOT NULL GROUP BY ALL)
SELECT CASE WHEN arrived_at <= middle THEN 1 ELSE 2 END AS run, watch_id, mod_revision, seq FROM halves b JOIN changes c
ON arrived_at > low AND arrived_at <= high AND mod_revision >= start_revision
AND CASE WHEN coalesce(range_end, '') = '' THEN c.key = b.key ELSE c.key >= b.key AND c.key < range_end END""",
)
def p3_second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in three runs: up to the middle of the time to handle, from there on, and once more, which finds nothing new."""
    log, path = table(spark, sf_dir, "change_log"), shared_path(spark, "increments")
    bounds = incremental.run_bounds(table(spark, sf_dir, "watchers"), table(spark, sf_dir, "watch_runs"))
    half = F.floor((intervals.micros(F.col("high")) - intervals.micros(F.col("low"))) / 2)
    middle = F.col("low") + F.make_dt_interval(secs=(half.cast("decimal(24,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return reduce(DataFrame.unionByName, [incremental.run_increment(log, b, path).select(F.lit(n).alias("run"), "*") for n, b in enumerate((bounds.withColumn("high", middle), bounds, bounds), 1)])


_DISTINCT = f"WITH c AS (SELECT key, mod_revision, seq, max(CASE WHEN {_GONE} THEN 1 ELSE 0 END) AS gone FROM change_log WHERE key IS NOT NULL GROUP BY ALL)"


@REGISTRY.add("p4_found", _DISTINCT + " SELECT key FROM c GROUP BY key HAVING count(*) * 100 >= (SELECT count(*) FROM c)")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that hold at least a hundredth of all changes."""
    return skew.heaviest(skew.per_key_results(table(spark, sf_dir, "change_log")), 0.01).select("key")


@REGISTRY.add("p4_per_key", _DISTINCT + " SELECT key, count(*) AS changes, CAST(sum(gone) AS BIGINT) AS deletes, min(mod_revision) AS first_revision, max(mod_revision) AS last_revision FROM c GROUP BY key")
def p4_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of every key."""
    return skew.per_key_results(table(spark, sf_dir, "change_log"))


_COVERED = """
WITH m AS (
  SELECT history_id, key, start_time AS s, end_time AS e,
    max(end_time) OVER (PARTITION BY history_id, key ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM ops WHERE history_id IS NOT NULL AND key IS NOT NULL AND end_time >= start_time)
"""


def _periods(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return intervals.periods_and_gaps(table(spark, sf_dir, "ops"), ["history_id", "key"], "start_time", "end_time")


@REGISTRY.add("p5_found", _COVERED + "SELECT history_id, key, strftime(before, '%Y-%m-%d %H:%M:%S.%f') AS gap_start, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS gap_end FROM m WHERE s > before")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps between the continuous periods of a key in a history."""
    gaps = _periods(spark, sf_dir)[1]
    return gaps.select("history_id", "key", *(intervals.text_of(F.col(c)).alias(c) for c in ("gap_start", "gap_end")))


@REGISTRY.add(
    "p5_periods",
    _COVERED
    + """, g AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY history_id, key ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS period FROM m)
SELECT history_id, key, strftime(min(s), '%Y-%m-%d %H:%M:%S.%f') AS period_start, strftime(max(e), '%Y-%m-%d %H:%M:%S.%f') AS period_end FROM g GROUP BY history_id, key, period""",
)
def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The continuous periods themselves."""
    periods = _periods(spark, sf_dir)[0]
    return periods.select("history_id", "key", *(intervals.text_of(F.col(c)).alias(c) for c in ("period_start", "period_end")))
