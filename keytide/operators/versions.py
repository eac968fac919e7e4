"""Reads, history and writes on a versioned change log.

A log has revision, seq, key, op ('put' or 'delete'), value, lease_id, ttl_seconds and may have more columns; (revision,
seq) orders it. Rows with a null key carry no change and are left out; empty logs give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keytide.operators.sliced import revision_slice, running_last
from keytide.session import materialize

_ORDER = ("revision", "seq")


def newest(log: DataFrame, at: int | None = None) -> DataFrame:
    """The newest version of every key, delete markers included, up to a revision.

    Combined before the shuffle, so a hot key costs no more than any other.
    """
    seen = log.where(F.col("key").isNotNull())
    if at is not None:
        seen = seen.where(F.col("revision") <= at)
    return seen.groupBy("key").agg(F.max(F.struct(*_ORDER, "op", "value", "lease_id", "ttl_seconds")).alias("v")).select("key", "v.*")


def in_range(rows: DataFrame, start: str | None = None, end: str | None = None, prefix: str | None = None) -> DataFrame:
    """Rows with start <= key < end, or with a prefix; end = '' is an empty range, None no bound."""
    if start is not None:
        rows = rows.where(F.col("key") >= start)
    if end is not None:
        rows = rows.where(F.col("key") < end)
    return rows.where(F.col("key").startswith(prefix)) if prefix is not None else rows


def history(log: DataFrame, slices: int | None = None, spread_like: DataFrame | None = None) -> DataFrame:
    """Every version with what its place in the key's history gives.

    create_revision: revision of the first put since the key's last delete, 0 for deletes; version_no: number of the put
    since then; prev_value, existed: of the version before, if it was a put; next_revision: where the version ends; rank_newest.
    Histories are cut into slices of revisions, so that a hot key is spread; ``spread_like`` (revision) has the revisions that say where to cut, where
    they are cheaper to read than the log's own.
    """
    put = F.col("op") == "put"
    slice_of = revision_slice(log if spread_like is None else spread_like, slices=slices)
    rows = log.where(F.col("key").isNotNull()).withColumn("slice", slice_of)
    inside = Window.partitionBy("key", "slice").orderBy(*_ORDER)
    earlier = inside.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("key", "slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    epoch = Window.partitionBy("key", "slice", "epoch")
    placed = (
        rows.withColumn("epoch", F.coalesce(F.sum((~put).cast("int")).over(earlier), F.lit(0)))
        .withColumn("prev", F.lag(F.struct("op", "value")).over(inside))
        .withColumn("next_here", F.lead("revision").over(inside))
        .withColumn("later_here", F.count("*").over(whole) - F.row_number().over(inside) + 1)
        .withColumn("first_here", F.min(F.when(put, F.col("revision"))).over(epoch.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("puts_here", F.count(F.when(put, 1)).over(epoch.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("deletes", F.count(F.when(~put, 1)).over(whole))
    )
    # A row per key and slice: its ends, and what is open after its last delete.
    tail = F.col("epoch") == F.col("deletes")
    by = Window.partitionBy("key").orderBy("slice")
    open_since = Window.partitionBy("key", "opened").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    summary = (
        placed.groupBy("key", "slice")
        .agg(F.max(F.struct(*_ORDER, "op", "value")).alias("last"), F.min("revision").alias("first_revision"), F.count("*").alias("n"), F.max("deletes").alias("deletes"), F.min(F.when(tail & put, F.col("revision"))).alias("tail_first"), F.count(F.when(tail & put, 1)).alias("tail_puts"))
        .withColumn("opened", F.sum((F.col("deletes") > 0).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("open_first", F.min("tail_first").over(open_since))
        .withColumn("open_puts", F.sum("tail_puts").over(open_since))
        .select(
            "key",
            "slice",
            F.lag(F.struct("last.op", "last.value")).over(by).alias("prev_in"),
            F.lead("first_revision").over(by).alias("next_in"),
            (F.sum("n").over(Window.partitionBy("key")) - F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0))).alias("later_in"),
            F.lag("open_first").over(by).alias("first_in"),
            F.coalesce(F.lag("open_puts").over(by), F.lit(0)).alias("puts_in"),
        )
    )
    joined = placed.join(summary, ["key", "slice"])
    before = F.coalesce("prev", F.when(F.col("prev_in.op").isNotNull(), F.col("prev_in")))
    first = F.when(F.col("epoch") == 0, F.coalesce("first_in", "first_here")).otherwise(F.col("first_here"))
    return joined.select(
        *(F.col(c) for c in log.columns),
        F.when(before["op"] == "put", before["value"]).alias("prev_value"),
        F.coalesce(before["op"] == "put", F.lit(False)).alias("existed"),
        F.coalesce("next_here", "next_in").alias("next_revision"),
        (F.col("later_here") + F.col("later_in")).alias("rank_newest"),
        F.when(put, first).otherwise(0).alias("create_revision"),
        F.when(put, F.col("puts_here") + F.when(F.col("epoch") == 0, F.col("puts_in")).otherwise(0)).otherwise(0).alias("version_no"),
    )


def live(log: DataFrame, at: int | None = None, spread_like: DataFrame | None = None, slices: int | None = None) -> DataFrame:
    """Key, value, create_revision, mod_revision, lease_id of live keys up to a revision.

    create_revision is that of the first put of a key's present life. The log is gone through once, in slices of revisions, each of which gives a row per key: its
    newest version, where a life began within it, and whether it starts with a put, which begins one if the slice before left the key deleted. ``spread_like``: as of history.
    """
    seen = log.where(F.col("key").isNotNull())
    if at is not None:
        seen = seen.where(F.col("revision") <= at)
    slice_of = revision_slice(seen if spread_like is None else spread_like, slices=slices)
    put = F.col("op") == "put"
    inside = Window.partitionBy("key", "slice").orderBy(*_ORDER)
    before = F.lag("op").over(inside)
    placed = seen.select("key", *_ORDER, "op", "value", "lease_id", slice_of.alias("slice")).withColumn("before", before)
    ends = placed.groupBy("key", "slice").agg(
        F.max(F.struct(*_ORDER, "op", "value", "lease_id")).alias("v"),
        F.max(F.when(put & (F.col("before") == "delete"), F.col("revision"))).alias("began"),
        F.max(F.when(put & F.col("before").isNull(), F.col("revision"))).alias("starts"),
    )
    by = Window.partitionBy("key").orderBy("slice")
    goes_on = F.coalesce(F.lag("v.op").over(by) == "put", F.lit(False))
    began = ends.withColumn("began", F.coalesce("began", F.when(~goes_on, F.col("starts"))))
    whole = began.groupBy("key").agg(F.max("v").alias("v"), F.max("began").alias("create_revision")).where("v.op = 'put'")
    return whole.select("key", "v.value", "create_revision", F.col("v.revision").alias("mod_revision"), "v.lease_id")


def get_many(log: DataFrame, keys: DataFrame, at: int | None = None) -> DataFrame:
    """For each row of ``keys`` (key) its value and mod_revision, '' and 0 where it has none."""
    now = newest(log, at).where(F.col("op") == "put").select("key", "value", F.col("revision").alias("mod_revision"))
    return keys.select("key").join(now, "key", "left").select("key", F.coalesce("value", F.lit("")).alias("value"), F.coalesce("mod_revision", F.lit(0)).alias("mod_revision"))


def range_page(log: DataFrame, start: str, end: str, limit: int = 0, at: int | None = None, spread_like: DataFrame | None = None) -> DataFrame:
    """Live keys in [start, end) in byte order, the first ``limit`` of them if that is positive. ``spread_like`` (key, revision): as of history."""
    like = None if spread_like is None else in_range(spread_like, start, end)
    rows = in_range(live(in_range(log, start, end), at, like), start, end).orderBy("key")
    return rows.limit(limit) if limit > 0 else rows


def as_of(probes: DataFrame, log: DataFrame, slices: int | None = None) -> DataFrame:
    """For each probe (pid, key, revision) the newest version of its key with a revision no greater: pid (of any type),
    key, value, mod_revision; null where there is none or it is a delete.

    Probes and versions are put in order together in ranges of revisions, so that a hot key is
    spread; what a range starts with comes from the newest version of each range before it.
    """
    slice_of = revision_slice(log, slices=slices)
    none = F.lit(None)
    versions = log.where(F.col("key").isNotNull()).select("key", *_ORDER, "op", "value", F.lit(0).alias("kind"), none.cast(probes.schema["pid"].dataType).alias("pid"))
    asked = probes.where(F.col("key").isNotNull()).select("key", F.col("revision").cast("long").alias("revision"), F.lit(2147483647).alias("seq"), none.cast("string").alias("op"), none.cast("string").alias("value"), F.lit(1).alias("kind"), "pid")
    both = versions.unionByName(asked).withColumn("slice", slice_of)
    version = F.when(F.col("kind") == 0, F.struct("revision", "op", "value"))
    found = running_last(both, ["key"], "slice", ["revision", "seq", "kind"], version, "found", inclusive=True).where("kind = 1")
    put = F.col("found.op") == "put"
    return found.select("pid", "key", F.when(put, F.col("found.value")).alias("value"), F.when(put, F.col("found.revision")).alias("mod_revision"))


def collect_garbage(log: DataFrame, min_revision: int, safe: bool = False) -> DataFrame:
    """Versions that stay: the newest of each key, whatever its op, and those from min_revision on.

    ``safe`` also keeps what a read at min_revision sees: the newest version no later than it.
    """
    kept = log.where(F.col("key").isNotNull())
    place = F.struct(*_ORDER)
    marks = kept.groupBy("key").agg(F.max(place).alias("newest"), F.max(F.when(F.col("revision") <= min_revision, place)).alias("visible"))
    stays = (place == F.col("newest")) | (F.col("revision") >= min_revision)
    if safe:
        stays = stays | F.coalesce(place == F.col("visible"), F.lit(False))
    return kept.join(marks, "key").where(stays).drop("newest", "visible")


def with_versions(log: DataFrame, writes: DataFrame) -> DataFrame:
    """The log with writes that bring their own revision (key, revision, value; a null value deletes), after all others of that revision.

    They may be older than what is there: reads go by revision, not by what came last.
    """
    own = writes.select("revision", F.lit(2147483647).alias("seq"), "key", F.when(F.col("value").isNull(), "delete").otherwise("put").alias("op"), "value")
    return log.unionByName(own, allowMissingColumns=True)


def expired_by_ttl(log: DataFrame, now: int) -> DataFrame:
    """Newest versions that are puts with ttl_seconds > 0 and revision + ttl_seconds <= now."""
    return newest(log).where((F.col("op") == "put") & (F.col("ttl_seconds") > 0) & (F.col("revision") + F.col("ttl_seconds") <= now))


def numbered(rows: DataFrame, order: list[str], name: str = "number", start: int = 1) -> DataFrame:
    """Rows numbered in order without bringing them into one task: numbers within ranges of the order, plus
    the sizes of the ranges before, of which there are as many as tasks."""
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    offsets, total = {}, start
    for row in sizes:
        offsets[row.part] = total
        total += row.n
    if not offsets:
        return ranged.drop("part").withColumn(name, F.lit(start).cast("long"))
    offset = F.create_map(*(F.lit(x) for kv in offsets.items() for x in kv))
    return ranged.withColumn(name, (F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.element_at(offset, F.col("part"))).cast("long")).drop("part")


def ttl_deletes(log: DataFrame, now: int) -> DataFrame:
    """The delete rows of a sweep: one per expired key, at new revisions in the order of keys."""
    top = log.agg(F.max("revision")).first()[0] or 0
    return numbered(expired_by_ttl(log, now).select("key"), ["key"], "revision", top + 1).select("revision", F.lit(0).alias("seq"), "key", F.lit("delete").alias("op"))

