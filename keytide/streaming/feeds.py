"""The change log as streams: watch feeds, the apply loop, leases with timers, expiry of keys."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keytide.operators.cdc import StateTable
from keytide.operators.leasing import fold_lease
from keytide.operators.watching import match_watchers
from keytide.session import hadoop_fs


def feed_stream(spark: SparkSession, sf_dir: str, name: str = "change_log", files_per_trigger: int | None = 1, bytes_per_trigger: int | None = None) -> DataFrame:
    """A stream of the files of a table; its schema is read once, timestamps become instants for watermarks.

    A batch takes ``files_per_trigger`` files, or files of ``bytes_per_trigger`` (at least one) where that is given, or all that are there if both are None.
    """
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    elif files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    fs, jpath = hadoop_fs(spark, path)
    if fs.getFileStatus(jpath(path)).isDirectory():
        rows = reader.parquet(path)
    else:
        rows = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return rows.select(*(F.col(f.name).cast("timestamp").alias(f.name) if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields))


def run_watch_feed(changes: DataFrame, watchers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write (watch_id, revision, seq, key) of what each watcher sees, batch by batch; a batch that is
    repeated after a failure replaces its own output, so that nothing comes twice.

    Changes may come in any order and any time late: repeated deliveries are told by (mod_revision, seq), kept in the stream's state
    without a watermark, so that no change is dropped for being late and a batch costs as much as it brings; the state grows with the distinct changes (use the
    session's RocksDB state store for many). Progress marks are left out.
    """
    seen = changes.where(F.col("key").isNotNull()).select(F.col("mod_revision").alias("revision"), "seq", "key").dropDuplicates(["revision", "seq"])

    def each(batch: DataFrame, number: int) -> None:
        match_watchers(batch, watchers).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return seen.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_apply_loop(changes: DataFrame, path: str, checkpoint: str, keep: int = 2) -> StreamingQuery:
    """Keep a published state up to date: each batch rewrites the buckets it touches and is published at once; of what
    was published before, the last ``keep`` states stay readable.

    Applying a batch again changes nothing, as the state compares sequences, so that a restart needs no further care.
    """

    def each(batch: DataFrame, _: int) -> None:
        state = StateTable(batch.sparkSession, path)
        state.apply(batch)
        state.vacuum(keep)

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_LEASE_OUT = "lease_id long, op_id long, outcome string, keys array<string>"
#: JSON of a bucket's leases: by id [ttl, renewed, keys, milliseconds at which the watermark may collect it].
_LEASE_STATE = "leases string"
#: Leases share a state by buckets, as a call of Python costs more than the fold of a lease.
LEASE_BUCKETS = 128


def _fold_bucket(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    leases: dict[int, list] = {int(i): kept for i, kept in json.loads(state.get[0]).items()} if state.exists else {}
    mark = state.getCurrentWatermarkMs()
    out: list[tuple] = []
    if not state.hasTimedOut:
        rows = pd.concat(list(frames)).sort_values(["lease_id", "at", "op_id"])
        columns = (rows[c].tolist() for c in ("lease_id", "op_id", "op", "at", "ttl", "key"))
        for lease_id, group in groupby(zip(*columns, strict=True), lambda r: r[0]):
            kept = leases.pop(lease_id, None)
            held = {"ttl": kept[0], "renewed": kept[1], "keys": kept[2]} if kept else None
            for _, op_id, op, at, ttl, name in group:
                held, outcome, freed = fold_lease(held, (op or "").strip().lower(), at, None if pd.isna(ttl) else int(ttl), name if isinstance(name, str) else None)
                out.append((lease_id, op_id, outcome, freed))
            if held is not None:
                leases[lease_id] = [held["ttl"], held["renewed"], held["keys"], max(int((held["renewed"] + held["ttl"]) * 1000), mark + 1)]
    for lease_id in [i for i, kept in leases.items() if kept[3] < mark]:
        out.append((lease_id, -1, "collected", sorted(leases.pop(lease_id)[2])))
    if leases:
        state.update((json.dumps(leases),))
        state.setTimeoutTimestamp(max(min(kept[3] for kept in leases.values()), mark + 1))
    else:
        state.remove()
    yield pd.DataFrame(out, columns=["lease_id", "op_id", "outcome", "keys"])


def lease_stream(requests: DataFrame, late: str = "4 days", buckets: int = LEASE_BUCKETS) -> DataFrame:
    """Outcomes of lease requests in a stream (lease_id, op_id, outcome, keys), with a row 'collected'
    (op_id -1) and the keys it sets free when the watermark passes a lease's end.

    ``late`` must be more than requests take to arrive, as later ones are dropped. A lease that has run out stays, as in the batch fold, until
    it is revoked or the watermark collects it, so that what a request on it gives depends on which came first. A bucket's leases, and its requests
    of a batch, are held in memory at once; ``buckets`` must stay the same for a checkpoint.
    """
    named = requests.where(F.col("lease_id").isNotNull() & (F.col("lease_id") != 0) & F.col("ts").isNotNull()).withWatermark("ts", late).dropDuplicatesWithinWatermark(["op_id"])
    rows = named.select(F.pmod(F.xxhash64("lease_id"), F.lit(buckets)).alias("bucket"), "lease_id", "op_id", "op", "ts", F.col("ts").cast("double").alias("at"), "ttl", "key")
    return rows.groupBy("bucket").applyInPandasWithState(_fold_bucket, _LEASE_OUT, _LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def changes_per_window(changes: DataFrame, width: str = "1 hour", late: str = "8 days") -> DataFrame:
    """Changes and distinct keys, roughly, per window of arrival; late rows count while the watermark lets them."""
    return changes.withWatermark("arrived_at", late).groupBy(F.window("arrived_at", width)).agg(F.count("*").alias("changes"), F.approx_count_distinct("key").alias("keys")).select(F.col("window.start").alias("from_ts"), "changes", "keys")


def run_windows(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write windows' counts (from_ts and more) as they change, batch by batch; a repeated batch replaces its own output."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(spark: SparkSession, path: str) -> DataFrame:
    """Each window's last counts, as run_windows wrote them."""
    rows = spark.read.parquet(path)
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in ("from_ts", "batch"))), "batch").alias("last")
    return rows.groupBy("from_ts").agg(last).select("from_ts", "last.*")
