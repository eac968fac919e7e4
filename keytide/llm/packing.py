"""Filling containers of fixed capacity with documents, unsplit unless one exceeds a container.

Method: best-two-fit. A bin is filled greedily with the largest documents that fit; then its smallest
is put back if two unpacked ones fill the place it leaves more tightly. Documents are
dealt by hash into shares that are packed independently, so that work spreads and a
share's size stays the same as the corpus grows; a share leaves at most a few bins unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytide.llm.tokenization import TOKENIZER_DIR, count_tokens
from keytide.session import materialize

#: Documents packed together.
SHARE = 20_000


def best_two_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of every size, numbered from 0; sizes must lie in 0 to capacity.

    Sizes of 0 take no place and go to bin 0. Equal sizes are taken in the order given.
    """
    by_size: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        by_size.setdefault(sizes[i], []).append(i)
    bins = [0] * len(sizes)
    by_size.pop(0, None)
    free = sum(1 << s for s in by_size)

    def largest(at_most: int) -> int:
        """The largest unpacked size up to a limit, else 0."""
        return max(0, (free & ((2 << at_most) - 1)).bit_length() - 1) if at_most > 0 else 0

    def take(size: int) -> int:
        nonlocal free
        item = by_size[size].pop()
        if not by_size[size]:
            free &= ~(1 << size)
        return item

    at = 0
    while free:
        held, gap = [], capacity
        while size := largest(gap):
            held.append(take(size))
            gap -= size
        if gap and free:
            smallest = sizes[held[-1]]
            room, best, pair = gap + smallest, smallest, None
            a = largest(room - 1)
            while 2 * a > best:
                b = largest(min(a, room - a))
                if b == a and len(by_size[a]) == 1:
                    b = largest(a - 1)
                if b and a + b > best:
                    best, pair = a + b, (a, b)
                    if best == room:
                        break
                a = largest(a - 1)
            if pair:
                back = held.pop()
                held += [take(pair[0]), take(pair[1])]
                by_size.setdefault(smallest, []).append(back)
                free |= 1 << smallest
        for item in held:
            bins[item] = at
        at += 1
    return bins


def _pack_share(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
    capacity = int(rows["capacity_tokens"].iloc[0])
    rows["bin_id"] = best_two_fit(rows["n_tokens"].tolist(), capacity)
    rows["bin_id"] = rows["bin_id"] + int(key[1]) * (1 << 32)
    return rows.drop(columns="share")


def pack_documents(sizes: DataFrame, containers: DataFrame, share: int = SHARE) -> DataFrame:
    """Which document, or piece of one, lies in which container.

    ``sizes``: doc_id, tokenizer, n_tokens; ``containers``: container_id, capacity_tokens, tokenizer, a
    small fixed table. Result, a row for each container_id and piece: container_id,
    capacity_tokens, bin_id (unique within a container_id), doc_id, piece, start_token, n_tokens. A document larger than
    the capacity is cut into pieces that fill a container each, and a rest; any other has
    the one piece 0. Documents without tokens are listed in their share's first container. A null size
    counts as 0. Repeated rows are packed as often as they occur. Containers with a null or
    non-positive capacity hold nothing and give no rows.
    """
    spark = sizes.sparkSession
    kinds = [(r.container_id, r.capacity_tokens, r.tokenizer) for r in containers.where("capacity_tokens > 0").select("container_id", "capacity_tokens", "tokenizer").collect()]
    schema = "container_id int, capacity_tokens int, doc_id bigint, piece int, start_token int, n_tokens int, bin_id bigint"
    if not kinds:
        return spark.createDataFrame([], schema).select("container_id", "capacity_tokens", "bin_id", "doc_id", "piece", "start_token", "n_tokens")
    into = F.array(*(F.struct(F.lit(i).cast("int").alias("container_id"), F.lit(c).cast("int").alias("capacity_tokens"), F.lit(t).alias("tokenizer")) for i, c, t in kinds))
    shares = max(1, -(-sizes.count() // share))
    n, cap = F.coalesce("n_tokens", F.lit(0)), F.col("capacity_tokens")
    pieces = (
        sizes.withColumn("container", F.explode(into))
        .where(F.col("container.tokenizer") == F.col("tokenizer"))
        .select("container.container_id", "container.capacity_tokens", F.col("doc_id").cast("long").alias("doc_id"), n.alias("n"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / cap) - 1).cast("int"))))
        .select(
            "container_id", "capacity_tokens", "doc_id", "piece",
            (F.col("piece") * cap).cast("int").alias("start_token"),
            F.least(cap, F.col("n") - F.col("piece") * cap).cast("int").alias("n_tokens"),
            F.pmod(F.xxhash64("doc_id"), F.lit(shares)).cast("int").alias("share"),
        )
    )
    packed = pieces.groupBy("container_id", "share").applyInPandas(_pack_share, schema)
    return packed.select("container_id", "capacity_tokens", "bin_id", "doc_id", "piece", "start_token", "n_tokens")


def document_sizes(documents: DataFrame, containers: DataFrame, directory: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, tokenizer, n_tokens) by every tokenizer the containers name, counted once and kept."""
    names: Iterator[str] = sorted({r.tokenizer for r in containers.select("tokenizer").distinct().collect() if r.tokenizer})
    parts = [count_tokens(documents, name, directory=directory).withColumn("tokenizer", F.lit(name)) for name in names]
    if not parts:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, n_tokens int, tokenizer string")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return materialize(out, "sizes")


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container_id: bins used, the fewest that could do, tokens, and the share of space that is filled."""
    return (
        packed.groupBy("container_id", "capacity_tokens", "bin_id")
        .agg(F.sum("n_tokens").alias("used"))
        .groupBy("container_id", "capacity_tokens")
        .agg(F.count("*").alias("bins"), F.sum("used").alias("tokens"))
        .select("container_id", "capacity_tokens", "bins", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("bins_at_least"), "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("filled"))
    )


def pack_faults(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """What must hold of a packing, per container_id: documents placed, and how many bins overflow, documents hold other tokens
    than their size, are split though they fit, or have pieces that do not follow each other."""
    overflows = packed.groupBy("container_id", "capacity_tokens", "bin_id").agg(F.sum("n_tokens").alias("used")).groupBy("container_id").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overflows"))
    placed = packed.groupBy("container_id", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("held"), F.count("*").alias("pieces"), F.max("piece").alias("last"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"))
    known = placed.join(sizes.groupBy("doc_id").agg(F.max(F.coalesce("n_tokens", F.lit(0))).alias("size")), "doc_id")
    faults = known.groupBy("container_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("held") != F.col("size")).alias("other_tokens"),
        F.count_if((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("split_needlessly"),
        F.count_if((F.col("last") + 1 != F.col("pieces")) | (F.col("end") != F.col("size"))).alias("out_of_order"),
    )
    return faults.join(overflows, "container_id")
