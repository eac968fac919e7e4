"""Queries that run streams over the files of a directory to their end, and queries on stored forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.cdc import StateTable
from keytide.plans.kv import _NEWEST, _sql
from keytide.plans.registry import Registry
from keytide.plans.stateful import _MATCH, _REQUESTS, FOLDED
from keytide.session import shared_path
from keytide.sources import snapshots
from keytide.sources.fixtures import STORE_LOG_SQL, store_log
from keytide.sources.tables import table
from keytide.streaming import feeds

REGISTRY = Registry()

#: Bytes of files that a batch takes: what a batch costs besides its rows (plans, commits of state, buckets written anew) then grows with the input, not with the number of its files.
BYTES_AT_ONCE = 256 << 20


def _finish(query) -> None:
    try:
        query.awaitTermination()
    finally:
        query.stop()


@REGISTRY.add("stream_watch_feed", _sql(STORE_LOG_SQL, _MATCH, select="SELECT watch_id, revision, seq, key FROM m"))
def stream_watch_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The watch feed as a stream."""
    out, watchers = shared_path(spark, "feed"), table(spark, sf_dir, "watchers")
    _finish(feeds.run_watch_feed(feeds.feed_stream(spark, sf_dir, bytes_per_trigger=BYTES_AT_ONCE), watchers, out, shared_path(spark, "checkpoint")))
    return spark.read.parquet(out).select("watch_id", "revision", "seq", "key")


@REGISTRY.add("stream_apply", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select="SELECT key, revision AS mod_revision, seq FROM newest WHERE op = 'put'"))
def stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys kept up to date by a stream."""
    path = shared_path(spark, "state")
    _finish(feeds.run_apply_loop(feeds.feed_stream(spark, sf_dir, bytes_per_trigger=BYTES_AT_ONCE), path, shared_path(spark, "checkpoint")))
    return StateTable(spark, path).read().where(~F.col("deleted")).select("key", "mod_revision", "seq")


@REGISTRY.add(
    "stream_leases",
    "WITH RECURSIVE " + _REQUESTS + ",\n" + FOLDED + """,
ended AS (SELECT lease_id, arg_max(coalesce(ttl, -1), n) AS ttl, arg_max(coalesce(renewed, TIMESTAMP '1970-01-01'), n) AS renewed, arg_max(held, n) AS held FROM folded GROUP BY lease_id)
SELECT lease_id, op_id, outcome, array_to_string(freed, ',') AS freed FROM folded WHERE n > 0
UNION ALL SELECT lease_id, -1, 'collected', array_to_string(list_sort(held), ',') FROM ended, (SELECT max(ts) - INTERVAL 4 DAY AS mark FROM lease_ops WHERE lease_id <> 0) WHERE ttl > 0 AND renewed + to_seconds(ttl) <= mark""",
)
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of lease requests as a stream, with timers; all files are one batch, followed by a last watermark, as its SQL has it."""
    out = shared_path(spark, "leases")
    rows = feeds.lease_stream(feeds.feed_stream(spark, sf_dir, "lease_ops", files_per_trigger=None))
    _finish(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start())
    return spark.read.parquet(out).select("lease_id", "op_id", "outcome", F.array_join("keys", ",").alias("freed"))


@REGISTRY.add("stream_windows", "SELECT strftime(date_trunc('hour', arrived_at), '%Y-%m-%d %H') AS from_hour, count(*) AS changes FROM change_log GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries by hour of arrival, as a stream."""
    out = shared_path(spark, "windows")
    _finish(feeds.run_windows(feeds.changes_per_window(feeds.feed_stream(spark, sf_dir)), out, shared_path(spark, "checkpoint")))
    return feeds.windows(spark, out).select(F.date_format("from_ts", "yyyy-MM-dd HH").alias("from_hour"), "changes")


@REGISTRY.add("snapshot_restore", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select="SELECT key, value, revision AS mod_revision, lease_id FROM newest WHERE op = 'put'"))
def snapshot_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys from a snapshot at half of the log and the log after it."""
    log, path = store_log(spark, sf_dir), shared_path(spark, "snapshots")
    top = log.agg(F.max("revision")).first()[0] or 0
    snapshots.create_snapshot(log, path, top // 2)
    return snapshots.open_store(spark, path, log)


@REGISTRY.add("backup_restore", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select="SELECT key, value, revision AS mod_revision, lease_id FROM newest WHERE op = 'put'"))
def backup_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys from a backup of a snapshot at the end of the log."""
    log, path, target = store_log(spark, sf_dir), shared_path(spark, "snapshots"), shared_path(spark, "backup")
    snapshots.create_snapshot(log, path, log.agg(F.max("revision")).first()[0] or 0)
    snapshots.backup(spark, path, target, node_id=1)
    return snapshots.restore(spark, target)[1].select("key", "value", "mod_revision", "lease_id")
