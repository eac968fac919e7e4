"""Applying committed commands to the store: changes, leases that keys hang on, and what a revoked lease deletes.

A lease's life depends on grants and revokes alone, so it is found first. A put with a lease in life attaches its key; a delete detaches the key from the
lease of the value it removes; a revoke deletes every key attached. Each step is a running result over a key's or a lease's commands in
slices, so that a hot key or lease is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.functions.codecs import decode_command
from keytide.operators.sliced import revision_slice, running_last
from keytide.session import materialize


def read_commands(log: DataFrame, committed: int) -> tuple[DataFrame, DataFrame]:
    """Commands of committed entries, and the entries that cannot be read (log_index, data).

    Commands: log_index, type (Put, Delete, LeaseGrant, LeaseRevoke), key, value, lease_id, ttl. No-ops, configuration changes and empty data hold
    none. A command without the parts its type needs (a key, a value, a lease) cannot be read.
    """
    normal = log.where((F.col("log_index") <= committed) & (F.col("entry_type") == "Normal") & (F.coalesce(F.length("data"), F.lit(0)) > 0))
    read = normal.withColumn("c", decode_command(F.col("data")))
    return read.where("c IS NOT NULL").select("log_index", "c.*"), read.where("c IS NULL").select("log_index", "data")


def applied_count(log: DataFrame, committed: int) -> DataFrame:
    """One row (applied): commands that could be read, and configuration changes, up to ``committed``."""
    commands = read_commands(log, committed)[0].select("log_index")
    changes = log.where((F.col("log_index") <= committed) & (F.col("entry_type") == "ConfigChange")).select("log_index")
    return commands.unionByName(changes).agg(F.count("*").alias("applied"))


def lease_lives(commands: DataFrame) -> DataFrame:
    """(lease_id, born, ended) of each life of a lease: from a grant that succeeds to the next revoke (null: none).

    A grant needs a positive ttl and an id other than 0; one of a lease in life fails.
    """
    kinds = commands.where((F.col("lease_id") != 0) & ((F.col("type") == "LeaseRevoke") | ((F.col("type") == "LeaseGrant") & (F.col("ttl") > 0)))).select("lease_id", "log_index", (F.col("type") == "LeaseGrant").alias("grant"))
    placed = _sliced(kinds)
    placed = running_last(placed, ["lease_id"], "slice", ["log_index"], F.col("grant"), "before", inclusive=False)
    # The first grant after a revoke opens a life; the first revoke after a grant ends it.
    turns = placed.where(F.col("grant") != F.coalesce("before", F.lit(False))).drop("before")
    ended = running_last(turns, ["lease_id"], "slice", ["log_index"], F.when(F.col("grant"), F.col("log_index")), "born", inclusive=True)
    return ended.groupBy("lease_id", "born").agg(F.min(F.when(~F.col("grant"), F.col("log_index"))).alias("ended"))


def _sliced(rows: DataFrame) -> DataFrame:
    return rows.withColumn("slice", revision_slice(rows, "log_index"))


def _last_before(rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """The last non-null value of ``by`` at an earlier entry."""
    return running_last(rows, [by], "slice", ["log_index", "kind"], value, name, inclusive=False)


def revoked_keys(commands: DataFrame) -> DataFrame:
    """(log_index, lease_id, key) of every key that a revoke deletes.

    A key hangs on a lease from a put that names it while it lives, until a delete of the key finds the value of such a put. If another
    lease's revoke has deleted the key before, that delete finds nothing and the key hangs on; so what revokes delete is found in rounds, the
    first without this, until a round adds nothing. As each adds keys that only earlier revokes decide, they end.
    """
    lives = materialize(lease_lives(commands), "lives")
    puts = commands.where((F.col("type") == "Put") & (F.col("lease_id") > 0)).select("lease_id", "key", "log_index", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("ended"))
    starts = lives.select("lease_id", F.lit(None).cast("string").alias("key"), F.col("born").alias("log_index"), F.lit(0).alias("kind"), F.coalesce("ended", F.lit(2**62)).alias("ended"))
    both = _sliced(starts.unionByName(puts))
    placed = _last_before(both, "lease_id", F.when(F.col("kind") == 0, F.struct(F.col("log_index").alias("born"), "ended")), "life").where("kind = 1")
    attached = placed.where(F.col("log_index") < F.col("life.ended")).groupBy("key", "lease_id", F.col("life.born").alias("born"), F.col("life.ended").alias("ended")).agg(F.max("log_index").alias("put_at"))
    doomed = attached.where(F.col("ended") < 2**62)
    # Deletes that find a value with a lease, by the put of that value.
    explicit = _sliced(commands.where(F.col("type").isin("Put", "Delete")).select("key", "log_index", F.lit(1).alias("kind"), F.coalesce("lease_id", F.lit(0)).alias("lease_id"), (F.col("type") == "Put").alias("put")))
    found = _last_before(explicit, "key", F.struct("put", "lease_id", "log_index"), "prev").where(~F.col("put") & F.col("prev.put") & (F.col("prev.lease_id") > 0))
    detached = found.select("key", F.col("prev.lease_id").alias("lease_id"), F.col("prev.log_index").alias("put_at"), F.col("log_index").alias("gone_at"))
    cases = doomed.join(detached, ["key", "lease_id", "put_at"], "left").withColumn("gone_at", F.when(F.col("gone_at") < F.col("ended"), F.col("gone_at")))
    cases = materialize(cases.select("key", "lease_id", F.col("ended").alias("log_index"), "put_at", "gone_at"), "cases")
    deleted, open_cases = cases.where("gone_at IS NULL").select("key", "lease_id", "log_index"), cases.where("gone_at IS NOT NULL")
    while open_cases.head() is not None:
        none = F.lit(None).cast("long")
        events = deleted.select("key", "log_index", F.lit(0).alias("kind"), none.alias("lease_id"), none.alias("put_at"), none.alias("revoke_at"))
        probes = open_cases.select("key", F.col("gone_at").alias("log_index"), F.lit(1).alias("kind"), "lease_id", "put_at", F.col("log_index").alias("revoke_at"))
        looked = _last_before(_sliced(events.unionByName(probes)), "key", F.when(F.col("kind") == 0, F.col("log_index")), "cut").where("kind = 1")
        looked = materialize(looked.select("key", "lease_id", F.col("revoke_at").alias("log_index"), "put_at", F.col("log_index").alias("gone_at"), (F.coalesce("cut", F.lit(-1)) > F.col("put_at")).alias("hangs")), "round")
        more = looked.where("hangs").select("key", "lease_id", "log_index")
        if more.head() is None:
            break
        deleted, open_cases = materialize(deleted.unionByName(more), "deleted"), looked.where("NOT hangs").drop("hangs")
    return deleted.select("log_index", "lease_id", "key")


def applied_events(log: DataFrame, committed: int) -> DataFrame:
    """What applying the committed commands tells watchers: log_index, event_type (0 put, 1 delete), key, value ('' on delete), lease_id, ttl_seconds,
    prev_value.

    prev_value is what a put or delete replaces, null where the key is not there; deletes by a revoke tell none. Events of an
    entry are told apart by key.
    """
    commands = materialize(read_commands(log, committed)[0], "commands")
    cascades = materialize(revoked_keys(commands), "revoked")
    own = commands.where(F.col("type").isin("Put", "Delete")).select("log_index", F.when(F.col("type") == "Put", 0).otherwise(1).alias("event_type"), "key", "value", F.coalesce("lease_id", F.lit(0)).alias("lease_id"), F.coalesce("ttl", F.lit(0)).alias("ttl_seconds"), F.lit(1).alias("kind"))
    # A key that two leases lose at one entry cannot be, as a revoke ends one; kind keeps the order total all the same.
    gone = cascades.select("log_index", F.lit(1).alias("event_type"), "key", F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("lease_id"), F.lit(0).cast("long").alias("ttl_seconds"), F.lit(0).alias("kind"))
    both = _sliced(own.unionByName(gone))
    told = _last_before(both, "key", F.struct("event_type", "value"), "prev")
    prev = F.when((F.col("kind") == 1) & (F.col("prev.event_type") == 0), F.col("prev.value"))
    return told.select("log_index", "event_type", "key", F.when(F.col("event_type") == 0, F.col("value")).otherwise("").alias("value"), "lease_id", "ttl_seconds", prev.alias("prev_value"))
