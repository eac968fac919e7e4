"""Handing each run exactly the changes that came after the last successful one.

Method: a high-watermark per consumer on the order of arrival, an upper limit fixed when
the run starts, and one commit that holds the output together with the new watermarks, so
that a run either counts wholly or not at all. Covering ranges are matched through a grid of
key bins and slices of time, never by comparing every change with every watcher.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.sliced import bins_between, even_slices, seconds_of
from keytide.session import hadoop_fs, rename_new, shared_path


def run_bounds(watchers: DataFrame, watch_runs: DataFrame) -> DataFrame:
    """Bounds of each watcher's latest run, where that did not succeed.

    Result: watch_id, key, range_end, start_revision, low, high. low: greatest read_until
    of the watcher's ok runs, else created_at; high: read_until of
    the run with the greatest run_id. A run's status is that of its latest record; other
    records of it may carry the read_until that this one lacks. Watchers without a run,
    and runs with a null watch_id or run_id, give nothing.
    """
    runs = (
        watch_runs.where(F.col("watch_id").isNotNull() & F.col("run_id").isNotNull())
        .groupBy("watch_id", "run_id")
        .agg(F.max(F.struct("recorded_at", "status", "read_until")).alias("last"), F.max("read_until").alias("any_until"))
        .select("watch_id", "run_id", (F.lower(F.trim("last.status")) == "ok").alias("is_ok"), F.coalesce("last.read_until", "any_until").alias("read_until"))
    )
    latest = (
        runs.groupBy("watch_id")
        .agg(F.max(F.struct("run_id", "is_ok", "read_until")).alias("last"), F.max(F.when(F.col("is_ok"), F.col("read_until"))).alias("mark"))
        .where(~F.coalesce("last.is_ok", F.lit(False)) & F.col("last.read_until").isNotNull())
        .select("watch_id", "mark", F.col("last.read_until").alias("high"))
    )
    return (
        watchers.select("watch_id", "key", "range_end", F.coalesce("start_revision", F.lit(0)).alias("start_revision"), "created_at")
        .join(latest, "watch_id")
        .select("watch_id", "key", "range_end", "start_revision", F.coalesce("mark", "created_at").alias("low"), "high")
    )


def first_arrivals(change_log: DataFrame) -> DataFrame:
    """Each change once, with its earliest arrival: key, mod_revision, seq, arrived_at.

    Rows with a null key (progress marks) or arrived_at carry nothing that arrived.
    """
    return change_log.where(F.col("key").isNotNull()).groupBy("mod_revision", "seq", "key").agg(F.min("arrived_at").alias("arrived_at"))


def pending_changes(changes: DataFrame, bounds: DataFrame, bins: int = 512, slice_of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(watch_id, mod_revision, seq) of each change in low < arrived_at <= high of a watcher
    that covers its key, with mod_revision >= start_revision.

    A watcher covers key exactly where range_end is null or empty, else key <= k <
    range_end; a null key covers nothing, and a null bound admits nothing. ``bins``: number of key ranges, cut at range
    ends chosen by hash, of which so many at most come to the driver; it decides only about balance, as does ``slice_of``, slices of the seconds of arrival
    (even ones of ``changes`` unless given).
    """
    exact = F.coalesce(F.col("range_end"), F.lit("")) == ""
    wanted = bounds.where(F.col("key").isNotNull() & (exact | (F.col("key") < F.col("range_end"))) & (F.col("low") < F.col("high")))
    cuts = wanted.select(F.explode(F.array("key", F.when(~exact, F.col("range_end")))).alias("cut")).where("cut is not null").distinct()
    bin_of = bins_between(sorted(r.cut for r in cuts.orderBy(F.xxhash64("cut"), "cut").limit(bins - 1).collect()))
    slice_of = slice_of or even_slices(changes, seconds_of(F.col("arrived_at")))
    grid = (
        wanted.select("watch_id", F.col("key").alias("from_key"), F.when(exact, F.lit(None)).otherwise(F.col("range_end")).alias("to_key"), "start_revision", "low", "high", seconds_of(F.col("low")).alias("low_at"), seconds_of(F.col("high")).alias("high_at"))
        .withColumn("bin", F.explode(F.sequence(bin_of(F.col("from_key")), bin_of(F.coalesce("to_key", "from_key")))))
        .withColumn("slice", F.explode(F.sequence(slice_of(F.col("low_at")), slice_of(F.col("high_at")))))
    )
    placed = changes.where(F.col("arrived_at").isNotNull()).withColumn("bin", bin_of(F.col("key"))).withColumn("at", seconds_of(F.col("arrived_at"))).withColumn("slice", slice_of(F.col("at")))
    return (
        placed.join(grid, ["bin", "slice"])
        .where(
            ((F.col("key") == F.col("from_key")) | (F.col("to_key").isNotNull() & (F.col("key") >= F.col("from_key")) & (F.col("key") < F.col("to_key"))))
            & (F.col("mod_revision") >= F.col("start_revision"))
            & (F.col("arrived_at") > F.col("low"))
            & (F.col("arrived_at") <= F.col("high"))
        )
        .select("watch_id", "mod_revision", "seq")
    )


class IncrementalRun:
    """Commits of a consumer group: each is one folder ``<path>/run-<n>`` with ``output``
    and ``watermark``, put in place by one rename. A commit's watermark holds the marks of all consumers, those it did not move too."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_path(spark, "increments")

    def watermarks(self) -> DataFrame | None:
        """The marks of all consumers as of the latest commit (watch_id, mark), or None before the first."""
        last = self._last()
        return None if last is None else self._marks(last)

    def start(self, bounds: DataFrame) -> tuple[DataFrame, int]:
        """The bounds of a run, each low mark raised to the committed one, and the number its commit must take.

        What is not above its low mark any more has nothing to do and is left out.
        """
        last = self._last()
        if last is None:
            return bounds, 0
        marks = self._marks(last).select("watch_id", F.col("mark").alias("committed"))
        raised = bounds.join(marks, "watch_id", "left").withColumn("low", F.greatest("low", "committed")).drop("committed")
        return raised.where(F.col("low") < F.col("high")), last + 1

    def commit(self, output: DataFrame, marks: DataFrame, run: int | None = None) -> DataFrame:
        """Write the output and the marks it reaches, and publish both by one rename.

        If a job fails before the rename nothing is visible, and the next run starts from the same marks; after it,
        the next run starts from the new ones. ``run``: the number got from ``start``; if another run has taken it meanwhile, which may have handled the
        same changes, this one fails and leaves nothing.
        """
        last = self._last()
        if run is None:
            run = 0 if last is None else last + 1
        staged, final = f"{self.path}/.staged-{uuid.uuid4().hex}", f"{self.path}/run-{run:012d}"
        fs, jpath = hadoop_fs(self.spark, self.path)
        try:
            output.write.parquet(f"{staged}/output")
            moved = marks.select("watch_id", "mark")
            every = moved if run == 0 else self._marks(run - 1).unionByName(moved)
            every.groupBy("watch_id").agg(F.max("mark").alias("mark")).write.parquet(f"{staged}/watermark")
            if not rename_new(self.spark, staged, final):
                raise RuntimeError(f"another run has committed {final}")
        except BaseException:
            fs.delete(jpath(staged), True)
            raise
        return self.spark.read.schema(output.schema).parquet(f"{final}/output")

    def _marks(self, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/run-{run:012d}/watermark")

    def _last(self) -> int | None:
        fs, jpath = hadoop_fs(self.spark, self.path)
        if not fs.exists(jpath(self.path)):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(jpath(self.path))]
        return max((int(n[4:]) for n in names if n.startswith("run-")), default=None)


def run_increment(change_log: DataFrame, bounds: DataFrame, path: str | None = None) -> DataFrame:
    """One run over ``bounds`` (as of run_bounds): the changes between each watcher's committed watermark, or its low mark
    where that is later, and the high limit, which was fixed with the bounds; committed together with the marks they reach.

    Run again with the same bounds it gives nothing; with later ones, exactly what arrived since.
    """
    run = IncrementalRun(change_log.sparkSession, path)
    open_bounds, number = run.start(bounds)
    slice_of = even_slices(change_log.where(F.col("key").isNotNull()), seconds_of(F.col("arrived_at")))
    return run.commit(pending_changes(first_arrivals(change_log), open_bounds, slice_of=slice_of), open_bounds.select("watch_id", F.col("high").alias("mark")), number)


def resume_watchers(change_log: DataFrame, watchers: DataFrame, watch_runs: DataFrame, path: str | None = None) -> DataFrame:
    """Do again what each watcher's unsuccessful latest run had to do: give its changes and
    commit them together with the watermarks they reach. ``path`` keeps these between runs."""
    return run_increment(change_log, run_bounds(watchers, watch_runs), path)
