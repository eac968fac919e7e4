"""Results per key where a few keys hold most rows.

Method: two-stage salted aggregation. Heavy keys get a salt, partial results are made per
key and salt, and the partials are merged by key. The salt is drawn from a hash of the
change's identity: as even as a random one, the same when a lost task runs again, and it
brings the repeated deliveries of a change together.
"""

from __future__ import annotations

from fractions import Fraction
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.functions.changes import is_delete
from keytide.session import materialize


def at_least(share: float, total: int) -> int:
    """The least count that is ``share`` of ``total``, exactly, and 1 at least."""
    return max(1, ceil(Fraction(str(share)) * total))


def heavy_keys(rows: DataFrame, key: str, share: float) -> tuple[DataFrame, int]:
    """Keys with at least ``share`` of the rows, as (heavy_key, n), and the number of rows.

    There can be at most 1/share of them, whatever the input; counts are combined before the shuffle.
    """
    counts = materialize(rows.groupBy(F.col(key).alias("heavy_key")).agg(F.count("*").alias("n")), "key-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= at_least(share, total)), total


def per_key_results(change_log: DataFrame, share: float = 0.001) -> DataFrame:
    """key, changes, deletes, first_revision, last_revision of every non-null key.

    A change (mod_revision, seq) counts once, however often it was delivered; null parts
    of it are equal to each other. ``share``: part of all rows from which a key is salted in any case; with many tasks
    smaller ones are too, from half a task's mean.
    An empty feed gives an empty result.
    """
    spark = change_log.sparkSession
    rows = change_log.where(F.col("key").isNotNull()).select("key", "mod_revision", "seq", is_delete(F.col("event_type")).alias("gone"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A key is heavy from half of what a task gets on average: at most 2 x tasks, or 1/share, keys are.
    heavy, total = heavy_keys(rows, "key", min(share, 1 / (2 * parts)))
    target = max(1, ceil(total / (2 * parts)))
    salts = heavy.select("heavy_key", F.ceil(F.col("n") / target).alias("salts"))
    return (
        rows.join(F.broadcast(salts), rows["key"] == salts["heavy_key"], "left")  # at most the greater of 1/share and 2 x tasks rows
        .withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("mod_revision", "seq"), F.col("salts"))).otherwise(0))
        .repartition("key", "salt")
        .groupBy("key", "salt", "mod_revision", "seq")
        .agg(F.max("gone").alias("gone"))
        .groupBy("key", "salt")
        .agg(F.count("*").alias("changes"), F.sum(F.col("gone").cast("long")).alias("deletes"), F.min("mod_revision").alias("first_revision"), F.max("mod_revision").alias("last_revision"))
        .groupBy("key")
        .agg(F.sum("changes").alias("changes"), F.sum("deletes").alias("deletes"), F.min("first_revision").alias("first_revision"), F.max("last_revision").alias("last_revision"))
    )


def heaviest(results: DataFrame, share: float = 0.01) -> DataFrame:
    """The keys that hold at least ``share`` of all changes: key, changes, total."""
    kept = materialize(results.select("key", "changes"), "per-key")
    total = kept.agg(F.sum("changes")).first()[0] or 0
    return kept.where(F.col("changes") >= at_least(share, total)).select("key", "changes", F.lit(total).cast("long").alias("total"))
