"""Snapshots of a store's live keys, backups of them, and small files of a node's state."""

from __future__ import annotations

import json
import struct
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.versions import live
from keytide.session import hadoop_fs, read_text_file, write_text_file


def _fingerprint(rows: DataFrame) -> dict[str, int]:
    """Number of rows and a checksum that does not depend on their order."""
    got = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(rows.columns))).alias("x"), F.sum(F.pmod(F.xxhash64(*sorted(rows.columns)), F.lit(1 << 31))).alias("s")).first()
    return {"rows": got.n, "xor": got.x or 0, "sum": got.s or 0}


def create_snapshot(log: DataFrame, path: str, revision: int, term: int = 0, keep: int = 1) -> dict:
    """Write the live keys as of a revision under ``path`` and publish them; older snapshots go, but for the newest ``keep``.

    A snapshot counts once its description is in place, which is written last.
    """
    spark = log.sparkSession
    # Of snapshots of one revision the one made last is the newest.
    number = max((int(n.split("-")[2]) for n in _published(spark, path)), default=0) + 1
    target = f"{path}/snapshot-{revision:020d}-{number:012d}-{uuid.uuid4().hex}"
    live(log, revision).write.parquet(f"{target}/data")
    meta = {"last_included_index": revision, "last_included_term": term, **_fingerprint(spark.read.parquet(f"{target}/data"))}
    write_text_file(spark, f"{target}/meta.json", json.dumps(meta))
    fs, jpath = hadoop_fs(spark, path)
    for old in _published(spark, path)[:-keep]:
        fs.delete(jpath(f"{path}/{old}"), True)
    return meta


def _published(spark: SparkSession, path: str) -> list[str]:
    fs, jpath = hadoop_fs(spark, path)
    if not fs.exists(jpath(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(jpath(path))]
    return sorted(n for n in names if n.startswith("snapshot-") and fs.exists(jpath(f"{path}/{n}/meta.json")))


def load_snapshot(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict, DataFrame] | None:
    """Description and rows of the newest snapshot, or None; ValueError if its rows are not those that were written."""
    names = _published(spark, path)
    if not names:
        return None
    meta = json.loads(read_text_file(spark, f"{path}/{names[-1]}/meta.json") or "{}")
    rows = spark.read.parquet(f"{path}/{names[-1]}/data")
    if verify and (found := _fingerprint(rows)) != {k: meta[k] for k in found}:
        raise ValueError(f"{names[-1]} is damaged")
    return meta, rows


def open_store(spark: SparkSession, path: str, log: DataFrame) -> DataFrame:
    """Live keys after a restart: the newest snapshot, and what the log holds after it."""
    loaded = load_snapshot(spark, path)
    if loaded is None:
        return live(log).select("key", "value", F.col("mod_revision"), "lease_id")
    meta, base = loaded
    tail = log.where(F.col("revision") > meta["last_included_index"])
    changed = tail.where(F.col("key").isNotNull()).groupBy("key").agg(F.max(F.struct("revision", "seq", "op", "value", "lease_id")).alias("v"))
    kept = base.join(changed.select("key"), "key", "left_anti").select("key", "value", "mod_revision", "lease_id")
    return kept.unionByName(changed.where("v.op = 'put'").select("key", "v.value", F.col("v.revision").alias("mod_revision"), "v.lease_id"))


def backup(spark: SparkSession, path: str, target: str, **about: int) -> dict:
    """Copy the newest snapshot to ``target`` with a description; ValueError if there is none."""
    loaded = load_snapshot(spark, path)
    if loaded is None:
        raise ValueError("there is no snapshot")
    meta = {**loaded[0], **about}
    loaded[1].write.parquet(f"{target}/data")
    write_text_file(spark, f"{target}/meta.json", json.dumps(meta))
    return meta


def restore(spark: SparkSession, source: str) -> tuple[dict, DataFrame]:
    """Description and rows of a backup; ValueError if it is incomplete or damaged."""
    text = read_text_file(spark, f"{source}/meta.json")
    if text is None:
        raise ValueError("the backup is incomplete")
    meta, rows = json.loads(text), spark.read.parquet(f"{source}/data")
    if (found := _fingerprint(rows)) != {k: meta[k] for k in found}:
        raise ValueError("the backup is damaged")
    return meta, rows


def backup_blob(meta: dict, payload: bytes) -> bytes:
    """A backup in one piece: length of the description, the description in JSON, the payload."""
    text = json.dumps(meta).encode()
    return struct.pack("<I", len(text)) + text + payload


def parse_backup_blob(blob: bytes) -> tuple[dict, bytes] | None:
    """Description and payload, or None if it is too short or no description."""
    if len(blob) < 4:
        return None
    (n,) = struct.unpack_from("<I", blob)
    if len(blob) < 4 + n:
        return None
    try:
        return json.loads(blob[4 : 4 + n]), blob[4 + n :]
    except ValueError:
        return None


def save_vote(spark: SparkSession, path: str, term: int, voted_for: int | None) -> None:
    """Keep a node's term and vote, replaced in one step."""
    write_text_file(spark, path, json.dumps({"current_term": term, "voted_for": voted_for}))


def load_vote(spark: SparkSession, path: str) -> dict:
    """A node's term and vote; a fresh state if there is none or it cannot be read."""
    try:
        return json.loads(read_text_file(spark, path) or "")
    except ValueError:
        return {"current_term": 0, "voted_for": None}
