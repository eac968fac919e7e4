"""Change feeds for watchers of keys and ranges of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.operators.sliced import bins_between
from keytide.operators.versions import history, numbered


def match_watchers(changes: DataFrame, watchers: DataFrame, bins: int = 512, salts: int = 8) -> DataFrame:
    """(watch_id, revision, seq, key) of each change a watcher covers: revision >= start_revision
    (null: 0), and key exactly where range_end is null or empty, else key <= k < range_end.

    Matched through bins of keys, cut at range ends chosen by hash, each spread over ``salts``, so that the bin of a hot key is not one task's; a watcher with an inverted range or a null key has no rows.
    """
    exact = F.coalesce(F.col("range_end"), F.lit("")) == ""
    wanted = watchers.where(F.col("key").isNotNull() & (exact | (F.col("key") < F.col("range_end"))))
    cuts = wanted.select(F.explode(F.array("key", F.when(~exact, F.col("range_end")))).alias("cut")).where("cut is not null").distinct()
    bin_of = bins_between(sorted(r.cut for r in cuts.orderBy(F.xxhash64("cut"), "cut").limit(bins - 1).collect()))
    grid = wanted.select("watch_id", F.col("key").alias("from_key"), F.when(~exact, F.col("range_end")).alias("to_key"), F.coalesce("start_revision", F.lit(0)).alias("start_revision")).withColumn("bin", F.explode(F.sequence(bin_of(F.col("from_key")), bin_of(F.coalesce("to_key", "from_key"))))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    covers = (F.col("key") == F.col("from_key")) | (F.col("to_key").isNotNull() & (F.col("key") >= F.col("from_key")) & (F.col("key") < F.col("to_key")))
    return changes.where(F.col("key").isNotNull()).select("revision", "seq", "key", bin_of(F.col("key")).alias("bin"), F.pmod(F.hash("revision", "seq"), F.lit(salts)).alias("salt")).join(grid, ["bin", "salt"]).where(covers & (F.col("revision") >= F.col("start_revision"))).select("watch_id", "revision", "seq", "key")


def watch_events(log: DataFrame, spread_like: DataFrame | None = None) -> DataFrame:
    """Each change as an event: event_type (0 put, 1 delete), key, value ('' on delete), create_revision (0 on delete),
    mod_revision, seq, prev_value (null if the key was not there). ``spread_like``: as of history."""
    put = F.col("op") == "put"
    return history(log, spread_like=spread_like).select(F.when(put, 0).otherwise(1).alias("event_type"), "key", F.coalesce("value", F.lit("")).alias("value"), "create_revision", F.col("revision").alias("mod_revision"), "seq", "prev_value")


def registry_acks(requests: DataFrame) -> DataFrame:
    """Answers to requests to create and cancel watchers in the order of ``at``: at, kind, watch_id, ack.

    ``requests``: at, kind (create, cancel), watch_id. Creates take the ids 1, 2, ... in order and are always acknowledged; a cancel is
    if its watcher was created before and not cancelled yet. What a watcher that was cancelled had before stays valid.
    """
    made = numbered(requests.where("kind = 'create'").select("at"), ["at"], "watch_id")
    cancels = requests.where("kind = 'cancel'").select("at", "watch_id")
    known = cancels.join(made.select("watch_id", F.col("at").alias("made_at")), "watch_id", "left").withColumn("known", F.coalesce(F.col("made_at") < F.col("at"), F.lit(False)))
    first = known.where("known").groupBy("watch_id").agg(F.min("at").alias("first_at"))
    answered = known.join(first, "watch_id", "left").select("at", F.lit("cancel").alias("kind"), "watch_id", F.coalesce(F.col("known") & (F.col("at") == F.col("first_at")), F.lit(False)).alias("ack"))
    return made.select("at", F.lit("create").alias("kind"), "watch_id", F.lit(True).alias("ack")).unionByName(answered)


def active_watchers(acks: DataFrame) -> DataFrame:
    """(watch_id) created and not cancelled."""
    return acks.where("kind = 'create'").select("watch_id").join(acks.where("kind = 'cancel' AND ack").select("watch_id"), "watch_id", "left_anti")
