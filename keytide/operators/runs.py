"""Sorted runs of a log-structured store: statistics, merged scans, compaction, filters of keys.

Entries have sst_id, level, key, value (null: tombstone). Of a key's entries the one of the smallest level, and in a level
of the greatest sst_id, is the newest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.codecs import encode_block, read_block

L0_TRIGGER, LEVEL_RATIO = 4, 10
#: Bytes of entries at which a block is closed.
BLOCK_SIZE = 4096


def cut_runs(log: DataFrame, runs: int = 10, newest_in_l0: int = 4) -> DataFrame:
    """Entries of a log cut into runs of equal ranges of revisions; the newest are level 0, the rest level 1."""
    top = log.agg(F.max("revision")).first()[0] or 0
    width = max(1, top // runs)
    return (
        log.where(F.col("key").isNotNull())
        .withColumn("sst_id", F.least(F.floor((F.col("revision") - 1) / width), F.lit(runs - 1)).cast("long"))
        .groupBy("sst_id", "key")
        .agg(F.max(F.struct("revision", "seq", F.when(F.col("op") == "put", F.coalesce("value", F.lit(""))).alias("value"))).alias("v"))
        .select("sst_id", F.when(F.col("sst_id") >= runs - newest_in_l0, 0).otherwise(1).alias("level"), "key", "v.value")
    )


def blocks(log: DataFrame, block_size: int = BLOCK_SIZE) -> DataFrame:
    """(places, data): all versions of a log by key, revision and seq, encoded in blocks that close once they hold block_size bytes.

    places: revision and seq of a block's entries in their order, as a block has none. Blocks are gathered in ranges of
    the whole order, so that a hot key is spread.
    """
    order = ("key", "revision", "seq")
    entry = pa.struct([("key", pa.string()), ("value", pa.string()), ("revision", pa.int64()), ("seq", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            closed = []
            for row in batch.to_pylist():
                held.append(row)
                size += 8 + len(row["key"].encode()) + len((row["value"] or "").encode())
                if size >= block_size:
                    closed.append(held)
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(closed, pa.list_(entry))], names=["entries"])
        yield pa.RecordBatch.from_arrays([pa.array([held] if held else [], pa.list_(entry))], names=["entries"])

    rows = log.where(F.col("key").isNotNull()).select("key", "value", F.col("revision").cast("long").alias("revision"), F.col("seq").cast("int").alias("seq"))
    gathered = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "entries array<struct<key:string,value:string,revision:bigint,seq:int>>")
    return gathered.select(F.transform("entries", lambda e: F.struct(e["revision"].alias("revision"), e["seq"].alias("seq"))).alias("places"), encode_block(F.col("entries")).alias("data"))


def entries_of_blocks(encoded: DataFrame) -> DataFrame:
    """(revision, seq, key, value) of what blocks() gave, read from the bytes; ValueError if a block has more or fewer entries than places."""
    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            read = [(p["revision"], p["seq"], *e) for places, data in pairs for p, e in zip(places, read_block(data), strict=True)]
            cols = zip(*read, strict=True) if read else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["revision", "seq", "key", "value"])

    return encoded.mapInArrow(run, "revision bigint, seq int, key string, value string")


def run_statistics(entries: DataFrame) -> DataFrame:
    """Per run: level, smallest and greatest key, entries, tombstones, bytes of keys and values."""
    size = F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))
    return entries.groupBy("sst_id", "level").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.count_if(F.col("value").isNull()).alias("tombstones"), F.sum(size).cast("long").alias("bytes"))


def level_counts(statistics: DataFrame) -> DataFrame:
    """Runs, entries and bytes of every level."""
    return statistics.groupBy("level").agg(F.count("*").alias("runs"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


def level_to_compact(levels: DataFrame, max_levels: int = 7) -> DataFrame:
    """The level (one row, or none) whose runs must be merged: 0 from 4 runs on, else the smallest level n
    in 1 to max_levels - 2 with more than 4 * 10^n runs."""
    over = (F.col("level") == 0) & (F.col("runs") >= L0_TRIGGER)
    deeper = F.col("level").between(1, max_levels - 2) & (F.col("runs") > L0_TRIGGER * F.pow(F.lit(LEVEL_RATIO), F.col("level")))
    return levels.where(over | deeper).agg(F.min("level").alias("level")).where("level IS NOT NULL")


def overlapping_runs(statistics: DataFrame, source_level: int) -> DataFrame:
    """Runs that a compaction of a level takes: all of it, and those of the next whose keys meet its range."""
    source = statistics.where(F.col("level") == source_level)
    span = source.agg(F.min("min_key").alias("from_key"), F.max("max_key").alias("to_key"))  # one row
    target = statistics.where(F.col("level") == source_level + 1).join(F.broadcast(span), (F.col("min_key") <= F.col("to_key")) & (F.col("max_key") >= F.col("from_key"))).drop("from_key", "to_key")
    return source.unionByName(target)


def merged(entries: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """The newest entry of every key over all runs; tombstones go unless they are kept."""
    now = entries.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct((-F.col("level")).alias("rank"), "sst_id", "value")).alias("v")).select("key", "v.value")
    return now if keep_tombstones else now.where(F.col("value").isNotNull())


def compact(entries: DataFrame, source_level: int, deepest_level: int) -> DataFrame:
    """Entries of the run that replaces the source level and what it overlaps: one per key,
    the newest, and tombstones only while a deeper level could still hold the key."""
    taken = overlapping_runs(run_statistics(entries), source_level).select("sst_id", "level")
    return merged(entries.join(taken, ["sst_id", "level"], "left_semi"), keep_tombstones=source_level + 1 < deepest_level).withColumn("level", F.lit(source_level + 1))


def write_run(entries: DataFrame, path: str) -> None:
    """Write a run: ranges of keys, sorted, with filters of keys, so that reads skip files and row groups."""
    entries.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(path)


def read_run(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Entries of a run within [start, end); the bounds reach the scan."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where(F.col("key") >= start)
    return rows.where(F.col("key") < end) if end is not None else rows


def bloom_sizes(expected: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter for ``expected`` items; the rate is kept in [0.0001, 0.5]."""
    rate, expected = min(max(rate, 1e-4), 0.5), max(expected, 1)
    bits = max(8, math.ceil(-expected * math.log(rate) / math.log(2) ** 2))
    return bits, max(1, round(bits / expected * math.log(2)))


def bloom_positions(key: str, bits: int, hashes: int):
    """Bit positions of a key column, from two hashes."""
    h1, h2 = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(F.lit("second"), F.col(key)), F.lit(bits))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: F.pmod(h1 + i * h2, F.lit(bits)))


def bloom_filter(rows: DataFrame, key: str, bits: int, hashes: int) -> DataFrame:
    """Set bits as (word, mask): 32 positions to a word, combined before the shuffle."""
    at = rows.where(F.col(key).isNotNull()).select(F.explode(bloom_positions(key, bits, hashes)).alias("at"))
    return at.groupBy(F.floor(F.col("at") / 32).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 32 AS int)))").alias("mask"))


def may_contain(probes: DataFrame, key: str, bloom: DataFrame, bits: int, hashes: int) -> DataFrame:
    """Probes with ``may``: false only if the key was surely never put in."""
    asked = probes.withColumn("at", F.explode(bloom_positions(key, bits, hashes))).withColumn("word", F.floor(F.col("at") / 32))
    hit = F.coalesce(F.expr("shiftright(mask, cast(at % 32 AS int)) & 1") == 1, F.lit(False))
    return asked.join(bloom, "word", "left").withColumn("hit", hit).groupBy(*probes.columns).agg(F.bool_and("hit").alias("may"))


def manifest_after(edits: DataFrame) -> DataFrame:
    """The runs of a store after edits of its manifest in the order of ``at`` (at, action: add, remove; sst_id, level): sst_id, level, next_id.

    A run counts if its last edit adds it, at the level that edit gives; next_id is above every id that was ever added.
    """
    last = edits.groupBy("sst_id").agg(F.max_by(F.struct("action", "level"), "at").alias("e"))
    next_id = edits.where("action = 'add'").agg((F.coalesce(F.max("sst_id"), F.lit(0)) + 1).alias("next_id"))  # one row
    return last.where("e.action = 'add'").select("sst_id", "e.level").join(F.broadcast(next_id))


def flushed(log: DataFrame, flushed_to: int, sst_id: int) -> DataFrame:
    """Entries of the level-0 run (sst_id, level, key, value) that a flush makes of the changes after a revision: the newest of each key, null for
    a tombstone, which stays as older runs may hold the key."""
    tail = log.where(F.col("key").isNotNull() & (F.col("revision") > flushed_to))
    newest = tail.groupBy("key").agg(F.max(F.struct("revision", "seq", F.when(F.col("op") == "put", F.coalesce("value", F.lit(""))).alias("value"))).alias("v"))
    return newest.select(F.lit(sst_id).cast("long").alias("sst_id"), F.lit(0).alias("level"), "key", "v.value")


def merged_with_memtable(entries: DataFrame, log: DataFrame, flushed_to: int) -> DataFrame:
    """The newest value of every key over the runs and the changes that are in memory only, those after ``flushed_to``."""
    memory = flushed(log, flushed_to, 0).withColumn("level", F.lit(-1))
    return merged(entries.select("sst_id", "level", "key", "value").unionByName(memory))
