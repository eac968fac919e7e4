"""Optimistic transactions against a log: validation, write sets, compare-then-else."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.operators.versions import as_of, history


def validate(reads: DataFrame, writes: DataFrame, log: DataFrame) -> DataFrame:
    """Outcome of each transaction: txn_id, status (committed, conflict), conflicts, revision.

    ``reads``: txn_id, start_revision, commit_at, key; ``writes``: txn_id. A read key conflicts
    if its mod_revision (0: absent or deleted) differs between start_revision and commit_at. A
    transaction without writes commits at its start_revision and never conflicts; one that commits does so at commit_at + 1;
    one that conflicts has no revision. Reads of keys a transaction wrote itself must not be listed.
    """
    numbered = reads.where(F.col("key").isNotNull()).select("txn_id", "key", F.array(F.struct(F.lit(0).alias("which"), F.col("start_revision").alias("revision")), F.struct(F.lit(1).alias("which"), F.col("commit_at").alias("revision"))).alias("asked"))
    asked = numbered.select("txn_id", "key", F.explode("asked").alias("a")).select((F.col("txn_id") * 2 + F.col("a.which")).alias("pid"), "key", F.col("a.revision").alias("revision"))
    seen = as_of(asked, log).select(F.floor(F.col("pid") / 2).alias("txn_id"), "key", F.pmod("pid", F.lit(2)).alias("which"), F.coalesce("mod_revision", F.lit(0)).alias("mod_revision"))
    per_key = seen.groupBy("txn_id", "key").agg((F.max(F.when(F.col("which") == 0, F.col("mod_revision"))) != F.max(F.when(F.col("which") == 1, F.col("mod_revision")))).alias("changed"))
    conflicts = per_key.groupBy("txn_id").agg(F.count_if("changed").alias("conflicts"))
    has_writes = writes.select("txn_id").distinct().withColumn("writes", F.lit(True))
    txns = reads.groupBy("txn_id").agg(F.min("start_revision").alias("start_revision"), F.min("commit_at").alias("commit_at"))
    joined = txns.join(conflicts, "txn_id", "left").join(has_writes, "txn_id", "left")
    n = F.when(F.col("writes"), F.coalesce("conflicts", F.lit(0))).otherwise(0)
    return joined.select("txn_id", F.when(n > 0, "conflict").otherwise("committed").alias("status"), n.alias("conflicts"), F.when(n > 0, None).when(F.col("writes"), F.col("commit_at") + 1).otherwise(F.col("start_revision")).alias("revision"))


def surviving_writes(writes: DataFrame) -> DataFrame:
    """Per transaction and key the write with the greatest seq: of several to one key the last stands."""
    return writes.where(F.col("key").isNotNull()).groupBy("txn_id", "key").agg(F.max(F.struct("seq", "op", "value")).alias("w")).select("txn_id", "key", "w.seq", "w.op", "w.value")


def compare_and_choose(compares: DataFrame, latest: DataFrame) -> DataFrame:
    """Per transaction whether all its comparisons hold, so that its success operations run, else the others.

    ``compares``: txn_id, key, target (VERSION, VALUE), result (EQUAL, NOT_EQUAL, GREATER, LESS),
    version, value. ``latest``: key, version, value of live keys; a missing key has version 0 and value ''. A
    comparison with an unknown target or result does not hold; a transaction whose key is null compares nothing, which holds.
    """
    now = latest.select("key", F.col("version").alias("now_version"), F.col("value").alias("now_value"))
    joined = compares.join(now, "key", "left")
    rules = []
    for target, left, right in (("VERSION", F.coalesce("now_version", F.lit(0)), F.col("version")), ("VALUE", F.coalesce("now_value", F.lit("")), F.col("value"))):
        for result, holds in (("EQUAL", left == right), ("NOT_EQUAL", left != right), ("GREATER", left > right), ("LESS", left < right)):
            rules.append(((F.col("target") == target) & (F.col("result") == result), holds))
    holds = reduce(lambda at, rule: at.when(*rule), rules[1:], F.when(*rules[0])).otherwise(False)
    return joined.groupBy("txn_id").agg(F.bool_and(F.when(F.col("key").isNull(), True).otherwise(F.coalesce(holds, F.lit(False)))).alias("succeeded"))


def chosen_operations(chosen: DataFrame, operations: DataFrame) -> DataFrame:
    """The operations each transaction runs: those of its success branch if its comparisons hold, else of the other.

    ``chosen``: txn_id, succeeded; ``operations``: txn_id, on_success, seq and more. A branch without operations gives none.
    """
    return operations.join(chosen.select("txn_id", "succeeded"), "txn_id").where(F.col("on_success") == F.col("succeeded")).select(*(F.col(c) for c in operations.columns if c != "on_success"), "succeeded")


def reads_within(operations: DataFrame, log: DataFrame) -> DataFrame:
    """What each read of a transaction sees: txn_id, seq, key, value, own, mod_revision.

    ``operations``: txn_id, start_revision, seq, kind (read, put, delete), key, value. A read sees the transaction's own last write to its key
    before it (own; value null after a delete, mod_revision null), else the log at start_revision (mod_revision 0 where the key is not there).
    Reads that are not own make the read set that validation compares.
    """
    by = Window.partitionBy("txn_id", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # one transaction's
    wrote = F.when(F.col("kind") != "read", F.struct("kind", "value"))
    reads = operations.where(F.col("key").isNotNull()).withColumn("wrote", F.last(wrote, ignorenulls=True).over(by)).where("kind = 'read'")
    own = reads.where("wrote IS NOT NULL").select("txn_id", "seq", "key", F.when(F.col("wrote.kind") == "put", F.col("wrote.value")).alias("value"), F.lit(True).alias("own"), F.lit(None).cast("long").alias("mod_revision"))
    asked = reads.where("wrote IS NULL").select(F.struct("txn_id", "seq").alias("pid"), "key", F.col("start_revision").alias("revision"))
    seen = as_of(asked, log).select("pid.txn_id", "pid.seq", "key", "value", F.lit(False).alias("own"), F.coalesce("mod_revision", F.lit(0)).cast("long").alias("mod_revision"))
    return own.unionByName(seen)


def serial_outcomes(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(txn_id, status) of transactions that only meet each other, in the order of commit_at and
    txn_id: one conflicts if a key it read was written, after its start_revision, by an earlier one that committed.

    ``reads``: component, txn_id, start_revision, commit_at, key; ``writes``: component, txn_id, key. Whether a transaction counts as a writer depends
    on its own outcome, so that this is a fold in order. It streams through a task per component; what is held is one transaction and
    the last commit of each key, not the rows. Components must share no keys. One without writes never conflicts.
    """
    both = reads.select("component", "txn_id", "start_revision", "commit_at", "key", F.lit(True).alias("is_read")).unionByName(writes.select("component", "txn_id", F.lit(None).cast("long").alias("start_revision"), F.lit(None).cast("long").alias("commit_at"), "key", F.lit(False).alias("is_read")))
    keys = lambda of_read: F.array_distinct(F.collect_list(F.when(F.col("is_read") == of_read, F.col("key"))))  # noqa: E731 - one transaction's
    whole = both.groupBy("component", "txn_id").agg(F.min("commit_at").alias("commit_at"), F.min("start_revision").alias("start_revision"), keys(True).alias("read"), keys(False).alias("wrote")).where("commit_at IS NOT NULL")
    ordered = whole.repartition("component").sortWithinPartitions("component", "commit_at", "txn_id")

    def fold(batches):
        import pandas as pd

        component, last_write = None, {}
        for frame in batches:
            out = []
            for of, txn, commit_at, start, read, wrote in zip(*(frame[c] for c in ("component", "txn_id", "commit_at", "start_revision", "read", "wrote")), strict=True):
                if of != component:
                    component, last_write = of, {}
                conflict = len(wrote) > 0 and any(last_write.get(k, start) > start for k in read)
                if not conflict:
                    last_write.update(dict.fromkeys(wrote, commit_at))
                out.append((txn, "conflict" if conflict else "committed"))
            yield pd.DataFrame(out, columns=["txn_id", "status"])

    return ordered.mapInPandas(fold, "txn_id long, status string")


def written_once(outcomes: DataFrame, writes: DataFrame) -> DataFrame:
    """Change rows of committed transactions: txn_id, revision, seq, key, op, value; of several writes to one key the last stands, and
    seq numbers those that stand from 0."""
    committed = outcomes.where("status = 'committed'").select("txn_id", "revision")
    rows = surviving_writes(writes).join(committed, "txn_id")
    number = F.row_number().over(Window.partitionBy("txn_id").orderBy("seq")) - 1
    return rows.select("txn_id", "revision", number.alias("seq"), "key", "op", "value")


def created_by(changes: DataFrame, log: DataFrame) -> DataFrame:
    """The change rows (as of written_once) with create_revision: that of the key's life that a put goes on with, as the log has it just before the
    transaction's revision; the transaction's own revision where the key is not there; 0 for deletes."""
    lives = history(log).select("key", "revision", "seq", "op", F.col("create_revision").cast("string").alias("value"))
    asked = changes.select(F.struct("txn_id", "seq", "revision", "op", "value").alias("pid"), "key", (F.col("revision") - 1).alias("revision"))
    seen = as_of(asked, lives).select("pid.txn_id", "pid.revision", "pid.seq", "key", "pid.op", F.col("pid.value").alias("written"), F.col("value").cast("long").alias("created"))
    return seen.select("txn_id", "revision", "seq", "key", "op", F.col("written").alias("value"), F.when(F.col("op") == "put", F.coalesce("created", "revision")).otherwise(0).cast("long").alias("create_revision"))
