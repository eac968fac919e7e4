"""Audits of operation histories and of simulated faults, and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytide.operators.sliced import even_slices, running_last, seconds_of


def distinct_operations(ops: DataFrame) -> DataFrame:
    """Operations without repeated deliveries: of an op_id the first recorded."""
    return ops.groupBy("op_id").agg(F.min_by(F.struct("history_id", "op_type", "key", "value", "start_time", "end_time", "result"), "recorded_at").alias("r")).select("op_id", "r.*")


def stale_reads(ops: DataFrame, slices: int | None = None) -> DataFrame:
    """Successful reads that give another value than the newest successful write of their key that ended before:
    history_id, op_id, key, value, expected.

    Order: end_time, then op_id. Reads of keys without an earlier write pass, as do operations that did not end
    or have a null key; null values are equal to each other.
    """
    done = ops.where((F.col("result") == "Ok") & F.col("key").isNotNull() & F.col("end_time").isNotNull()).select("history_id", "op_id", "op_type", "key", "value", "end_time").withColumn("at", seconds_of(F.col("end_time")))
    done = done.withColumn("slice", even_slices(done, F.col("at"), slices)(F.col("at"))).drop("at")
    written = F.when(F.col("op_type") == "Write", F.struct(F.col("value").alias("value")))
    seen = running_last(done, ["history_id", "key"], "slice", ["end_time", "op_id"], written, "last_write", inclusive=False)
    return seen.where((F.col("op_type") == "Read") & F.col("last_write").isNotNull() & ~F.col("value").eqNullSafe(F.col("last_write.value"))).select("history_id", "op_id", "key", "value", F.col("last_write.value").alias("expected"))


def first_violations(stale: DataFrame, ops: DataFrame) -> DataFrame:
    """The first stale read of each history: history_id, op_id."""
    return stale.join(ops.select("op_id", "end_time"), "op_id").groupBy("history_id").agg(F.min(F.struct("end_time", "op_id")).getField("op_id").alias("op_id"))


def outcome_counts(ops: DataFrame) -> DataFrame:
    """Operations of each history and type: all, successful, failed, never returned."""
    ok = F.coalesce(F.col("result") == "Ok", F.lit(False))
    return ops.groupBy("history_id", "op_type").agg(F.count("*").alias("operations"), F.count_if(ok).alias("succeeded"), F.count_if(~ok & F.col("result").isNotNull()).alias("failed"), F.count_if(F.col("result").isNull()).alias("open"))


def deliverable(edges: DataFrame, partitions: DataFrame) -> DataFrame:
    """Edges (from_id, to_id) that no partition of the same direction cuts."""
    return edges.join(partitions, ["from_id", "to_id"], "left_anti")


def draw(seed: int, *cols: str) -> Column:
    """A number in [0, 1) from a hash of columns, 32 bits of it: the same for the same row, however often it is computed, in any engine that knows MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *cols)), 1, 8)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 32))


def simulate_delivery(messages: DataFrame, partitions: DataFrame, loss: float, least_ms: int, most_ms: int, seed: int = 0) -> DataFrame:
    """Messages (message_id, from_id, to_id) that no partition and no loss keeps back, each with a delay_ms in [least_ms, most_ms].

    ``loss`` is kept in [0, 1]. The same seed gives the same result.
    """
    sent = deliverable(messages.select("message_id", "from_id", "to_id"), partitions)
    kept = sent.where(draw(seed, "message_id") >= min(max(loss, 0.0), 1.0))
    return kept.withColumn("delay_ms", (F.lit(least_ms) + F.floor(draw(seed + 1, "message_id") * (most_ms - least_ms + 1))).cast("long"))


def touched_ranges(reads: DataFrame, damaged: DataFrame, block: int = 4096) -> DataFrame:
    """Reads (offset, size) that meet a damaged range (offset, size): distinct offset, size, ranges.

    Both are cut into blocks and joined by block; a pair counts in the first block it shares. Empty ranges meet nothing.
    """
    cut = lambda o, n: F.explode(F.sequence(F.floor(o / block), F.floor((o + n - 1) / block)))
    asked = reads.select(F.col("offset"), F.col("size")).where("size > 0").distinct().withColumn("block", cut(F.col("offset"), F.col("size")))
    bad = damaged.select(F.col("offset").alias("d_offset"), F.col("size").alias("d_size")).where("d_size > 0").distinct().withColumn("block", cut(F.col("d_offset"), F.col("d_size")))
    meets = (F.col("offset") < F.col("d_offset") + F.col("d_size")) & (F.col("offset") + F.col("size") > F.col("d_offset"))
    first = F.col("block") == F.floor(F.greatest("offset", "d_offset") / block)
    return asked.join(bad, "block").where(meets & first).groupBy("offset", "size").agg(F.count("*").alias("ranges"))


def fill_disk(writes: DataFrame, capacity: int) -> DataFrame:
    """Writes (disk_id, at, size) in order, each with whether it was taken: one that would exceed
    the capacity is refused and uses nothing. disk_id, at, size, used, taken.

    Whether a write counts depends on those before, so each disk is a fold; rows stream through it in order.
    """

    def fold(frames):
        disk, used = None, 0
        for frame in frames:
            taken, after = [], []
            for d, size in zip(frame["disk_id"], frame["size"], strict=True):
                if d != disk:
                    disk, used = d, 0
                ok = used + size <= capacity
                used += size if ok else 0
                taken.append(ok)
                after.append(used)
            yield frame.assign(used=after, taken=taken)

    rows = writes.select("disk_id", "at", "size").repartition("disk_id").sortWithinPartitions("disk_id", "at")
    return rows.mapInPandas(fold, "disk_id long, at long, size long, used long, taken boolean")


def skewed_clock(ts: Column, offset_ms: Column, frozen_at: Column) -> Column:
    """What a clock shows: a frozen one its instant, any other the time plus its offset."""
    return F.coalesce(frozen_at, ts + F.make_dt_interval(secs=offset_ms / 1000))


def backoff_ms(attempt: Column, base: int = 100) -> Column:
    """Wait before a retry: base doubled with every attempt."""
    return (F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")


#: Upper bounds, in seconds, of the buckets of a latency histogram (fixed values).
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def histogram(samples: DataFrame, value: str, labels: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts per bound: labels, le (text; '+Inf' for all), n. Null values count only in '+Inf'."""
    counts = samples.groupBy(*labels).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("total"))
    pairs = F.array(*(F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return counts.select(*labels, F.explode(pairs).alias("p")).select(*labels, "p.le", "p.n")


def exposition(metrics: DataFrame) -> DataFrame:
    """Text lines of metrics (name, label, label_value, value): name{label="value"} n."""
    labels = F.when(F.col("label").isNotNull(), F.format_string('{%s="%s"}', "label", "label_value")).otherwise("")
    return metrics.select(F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def delivered(messages: DataFrame, actions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Whether a simulated network delivers each message (message_id, at, from_id, to_id), by the actions before it: message_id, delivered.

    ``actions``: at, action, a, b; ``nodes``: node_id. cut stops what goes from a to b, split what goes either way, isolate all to and from a; heal undoes both
    ways between a and b, heal_all everything. The last action on a direction counts; a direction without any delivers. Actions come
    before messages of the same instant.
    """
    pair = lambda x, y: F.struct(F.col(x).alias("from_id"), F.col(y).alias("to_id"))
    direct = actions.where(F.col("action").isin("cut", "split", "heal")).select("at", (F.col("action") == "heal").alias("opens"), F.explode(F.when(F.col("action") == "cut", F.array(pair("a", "b"))).otherwise(F.array(pair("a", "b"), pair("b", "a")))).alias("e"))
    others = actions.where("action = 'isolate'").join(F.broadcast(nodes), F.col("node_id") != F.col("a"))  # nodes of one network
    around = others.select("at", F.lit(False).alias("opens"), F.explode(F.array(pair("a", "node_id"), pair("node_id", "a"))).alias("e"))
    edges = direct.unionByName(around).select(F.col("at"), "opens", "e.from_id", "e.to_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("message_id"))
    asked = messages.select("at", F.lit(None).cast("boolean").alias("opens"), "from_id", "to_id", F.lit(1).alias("kind"), F.col("message_id").cast("long").alias("message_id"))
    both = edges.unionByName(asked)
    slice_of = even_slices(both, F.col("at"))
    last = running_last(both.withColumn("slice", slice_of(F.col("at"))), ["from_id", "to_id"], "slice", ["at", "kind", "message_id"], F.when(F.col("kind") == 0, F.struct("opens", F.col("at").alias("on"))), "last", inclusive=False).where("kind = 1")
    # Only the last healing of everything before a message matters; it is the same for all directions.
    healed = actions.where("action = 'heal_all'").select(F.lit(0).alias("all"), "at", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("message_id")).unionByName(messages.select(F.lit(0).alias("all"), "at", F.lit(1).alias("kind"), F.col("message_id").cast("long").alias("message_id")))
    when = running_last(healed.withColumn("slice", slice_of(F.col("at"))), ["all"], "slice", ["at", "kind", "message_id"], F.when(F.col("kind") == 0, F.col("at")), "healed_at", inclusive=False).where("kind = 1").select("message_id", "healed_at")
    open_again = F.coalesce(F.col("healed_at") >= F.col("last.on"), F.lit(False))
    return last.join(when, "message_id").select("message_id", (F.col("last").isNull() | F.col("last.opens") | open_again).alias("delivered"))


def disk_verdicts(operations: DataFrame) -> DataFrame:
    """Whether a simulated disk carries out each read and write (disk_id, at, action: read, write), by the switches before it (fail_reads,
    restore_reads, fail_writes, restore_writes): disk_id, at, action, ok. A disk without switches carries out all."""
    placed = operations.withColumn("slice", even_slices(operations, F.col("at"))(F.col("at")))
    for kind in ("reads", "writes"):
        switch = F.when(F.col("action") == f"fail_{kind}", True).when(F.col("action") == f"restore_{kind}", False)
        placed = running_last(placed, ["disk_id"], "slice", ["at"], switch, f"{kind}_fail", inclusive=False)
    asked = placed.where(F.col("action").isin("read", "write"))
    fails = F.when(F.col("action") == "read", F.col("reads_fail")).otherwise(F.col("writes_fail"))
    return asked.select("disk_id", "at", "action", (~F.coalesce(fails, F.lit(False))).alias("ok"))


def http_answers(requests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Answers to requests for a node's pages (request_id, path, leader_id): request_id, status, body.

    /metrics gives the lines of ``metrics`` (line) in order, /health is always well, /ready is 503 while no leader is known; other paths are 404.
    """
    text = metrics.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))  # a store's gauges and counters
    path, led = F.col("path"), F.col("leader_id").isNotNull()
    status = F.when(path.isin("/metrics", "/health"), 200).when(path == "/ready", F.when(led, 200).otherwise(503)).otherwise(404)
    body = F.when(path == "/metrics", F.col("text")).when(path == "/health", "OK").when(path == "/ready", F.when(led, "OK").otherwise("No leader")).otherwise("Not Found")
    return requests.join(F.broadcast(text)).select("request_id", status.alias("status"), body.alias("body"))
