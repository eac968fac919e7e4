"""Rebuilding the present state of a table from a feed of puts and deletes.

Method: the feed goes into an embedded DuckDB per task as an upsert whose conflict clause
compares stored sequences; deletes stay as tombstones, so that an older put that comes
later cannot revive a key. The first round runs on the rows as they are read and leaves one
row per key and task, which keeps a hot key from filling one bucket; the second runs on the hash
buckets of the keys, in the order of keys, so that a bucket of any size passes through a small table. Buckets that a feed touches are written anew,
and all of them are published at once by creating one manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.changes import is_delete
from keytide.session import hadoop_fs, materialize, read_text_file, shared_path, write_new_file

STATE_SCHEMA = "key string, mod_revision bigint, seq int, deleted boolean, value string, create_revision bigint, lease_id bigint, ttl_seconds bigint, ts timestamp_ntz, feed_pos bigint"
_COLUMNS = [c.split()[0] for c in STATE_SCHEMA.split(", ")]
_ARROW = pa.schema(
    [("key", pa.string()), ("mod_revision", pa.int64()), ("seq", pa.int32()), ("deleted", pa.bool_()), ("value", pa.string())]
    + [(c, pa.int64()) for c in ("create_revision", "lease_id", "ttl_seconds")]
    + [("ts", pa.timestamp("us")), ("feed_pos", pa.int64())]
)
#: Rows and bytes that go into DuckDB at once; keys and bytes after which a task hands on what it has.
ROWS_AT_ONCE, BYTES_AT_ONCE, KEYS_HELD, BYTES_HELD = 100_000, 32 << 20, 400_000, 128 << 20

_ORDER = "coalesce({0}mod_revision, -1), coalesce({0}seq, -1), -coalesce({0}feed_pos, 0)"
_UPSERT = f"""
INSERT INTO state
SELECT {", ".join(_COLUMNS)} FROM incoming
QUALIFY row_number() OVER (PARTITION BY key ORDER BY coalesce(mod_revision, -1) DESC, coalesce(seq, -1) DESC, coalesce(feed_pos, 0)) = 1
ON CONFLICT (key) DO UPDATE SET {", ".join(f"{c} = excluded.{c}" for c in _COLUMNS[1:])}
WHERE ({_ORDER.format("excluded.")}) > ({_ORDER.format("state.")})
"""
_CREATE = """
CREATE TABLE state (key VARCHAR PRIMARY KEY, mod_revision BIGINT, seq INTEGER, deleted BOOLEAN, value VARCHAR,
create_revision BIGINT, lease_id BIGINT, ttl_seconds BIGINT, ts TIMESTAMP, feed_pos BIGINT)
"""


def _upsert(batches: Iterator[pa.RecordBatch], by_key: bool = False) -> Iterator[pa.RecordBatch]:
    """Upsert a task's rows and give the rows of its table.

    A table that has become large is handed on early. Rows of a key may then come more than once, unless the
    task's rows are sorted ``by_key``: all keys but the last are complete at any time, and only they are handed on.
    """
    import duckdb

    def fresh():
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        con.execute(_CREATE)
        return con

    def take(con, rows: list[pa.RecordBatch]) -> int:
        con.register("incoming", pa.Table.from_batches(rows).cast(_ARROW))
        con.execute(_UPSERT)
        con.unregister("incoming")
        return con.execute("SELECT count(*) FROM state").fetchall()[0][0]

    def held(con, where: str = "") -> list[pa.RecordBatch]:
        return con.sql(f"SELECT * FROM state {where}").to_arrow_table().cast(_ARROW).to_batches(max_chunksize=20_000)

    con, waiting, rows, size, kept = fresh(), [], 0, 0, 0
    for batch in batches:
        waiting.append(batch)
        rows, size, kept = rows + batch.num_rows, size + batch.nbytes, kept + batch.nbytes
        if rows < ROWS_AT_ONCE and size < BYTES_AT_ONCE:
            continue
        keys, waiting, rows, size = take(con, waiting), [], 0, 0
        if keys >= KEYS_HELD or kept >= BYTES_HELD:
            yield from held(con, "WHERE key <> (SELECT max(key) FROM state)" if by_key else "")
            last = held(con, "WHERE key = (SELECT max(key) FROM state)") if by_key else []
            con.close()
            con, kept = fresh(), sum(b.nbytes for b in last)
            if last:
                take(con, last)
    if waiting:
        take(con, waiting)
    yield from held(con)
    con.close()


def normalise_feed(change_log: DataFrame) -> DataFrame:
    """The feed in the state's columns; rows with a null key are progress marks and carry no change."""
    return change_log.where(F.col("key").isNotNull()).select(
        "key",
        F.col("mod_revision").cast("long").alias("mod_revision"),
        F.col("seq").cast("int").alias("seq"),
        is_delete(F.col("event_type")).alias("deleted"),
        "value",
        *(F.col(c).cast("long").alias(c) for c in ("create_revision", "lease_id", "ttl_seconds")),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.col("feed_pos").cast("long").alias("feed_pos"),
    )


class StaleState(RuntimeError):
    """Another writer has published since this one read the state; nothing of this one's is visible."""


class StateTable:
    """A published state in buckets of keys.

    ``<path>/data/<id>/bucket=<n>/`` holds what one apply wrote of a bucket; ``<path>/manifest-<n>`` names, for every bucket, where its rows
    are. The greatest manifest is the state. An apply rewrites only the buckets its keys fall into and
    publishes by creating the next manifest, which succeeds for one writer only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _manifests(self) -> list[int]:
        fs, jpath = hadoop_fs(self.spark, self.path)
        if not fs.exists(jpath(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(jpath(self.path))]
        return sorted(int(n[9:]) for n in names if n.startswith("manifest-") and n[9:].isdigit())

    def manifest(self) -> tuple[int, dict]:
        """Number and content (buckets, and the folder of each) of the published manifest; -1 and {} before the first."""
        every = self._manifests()
        return (every[-1], self._manifest(every[-1])) if every else (-1, {})

    def _manifest(self, number: int) -> dict:
        return json.loads(read_text_file(self.spark, f"{self.path}/manifest-{number:012d}") or "{}")

    def read(self) -> DataFrame:
        """The published state with its tombstones; an empty table before the first."""
        return self._rows(self.manifest()[1].get("folders", {}).values())

    def _rows(self, folders: Iterable[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(STATE_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], STATE_SCHEMA)

    def apply(self, change_log: DataFrame, buckets: int | None = None) -> DataFrame:
        """Apply a feed to the published state and publish the result; gives it with tombstones.

        A feed may be applied in any pieces, in any order and again: the greatest
        (mod_revision, seq) of a key stands, of its repeated deliveries the earliest
        (feed_pos). A null mod_revision or seq is older than any other. An empty feed publishes what was.
        A run that fails publishes nothing, and its files are never read; one that finds another published meanwhile raises
        StaleState and may be repeated. ``buckets`` is fixed by the first apply.
        """
        number, held = self.manifest()
        buckets = held.get("buckets") or buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        bucket = F.pmod(F.hash("key"), F.lit(buckets))  # as repartition(buckets, "key") places keys
        partial = normalise_feed(change_log).mapInArrow(_upsert, STATE_SCHEMA)
        if held:
            partial = materialize(partial.withColumn("bucket", bucket), "partial")
            touched = [r.bucket for r in partial.select("bucket").distinct().collect()]  # at most buckets
            old = self._rows(f for b, f in held["folders"].items() if int(b) in touched).withColumn("bucket", bucket)
            placed = partial.unionByName(old).repartition(max(1, min(len(touched), buckets)), "bucket").drop("bucket")
        else:
            placed = partial.repartition(buckets, "key")
        folder = f"data/{uuid.uuid4().hex}"
        upserted = placed.sortWithinPartitions("key").mapInArrow(lambda rows: _upsert(rows, by_key=True), STATE_SCHEMA)
        upserted.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        fs, jpath = hadoop_fs(self.spark, self.path)
        written = [s.getPath().getName() for s in fs.listStatus(jpath(f"{self.path}/{folder}"))]
        folders = {**held.get("folders", {}), **{n[7:]: f"{folder}/{n}" for n in written if n.startswith("bucket=")}}
        if not write_new_file(self.spark, f"{self.path}/manifest-{number + 1:012d}", json.dumps({"buckets": buckets, "folders": folders})):
            fs.delete(jpath(f"{self.path}/{folder}"), True)
            raise StaleState(f"manifest {number + 1} of {self.path} exists")
        return self._rows(folders.values())

    def vacuum(self, keep: int = 2) -> int:
        """Delete all but the newest ``keep`` manifests, and folders that none of those names; gives how many folders.

        A read that began before on an older state may fail; applies that run meanwhile are not touched, if their files
        are newer than the newest manifest.
        """
        every = self._manifests()
        kept = every[-keep:]
        if not kept:
            return 0
        fs, jpath = hadoop_fs(self.spark, self.path)
        named = {f for n in kept for f in self._manifest(n)["folders"].values()}
        since = fs.getFileStatus(jpath(f"{self.path}/manifest-{kept[-1]:012d}")).getModificationTime()
        gone = 0
        for of_apply in fs.listStatus(jpath(f"{self.path}/data")):
            if of_apply.getModificationTime() > since:
                continue
            name = of_apply.getPath().getName()
            inside = [s.getPath().getName() for s in fs.listStatus(of_apply.getPath())]
            stale = [b for b in inside if b.startswith("bucket=") and f"data/{name}/{b}" not in named]
            gone += len(stale)
            if len(stale) == sum(b.startswith("bucket=") for b in inside):
                fs.delete(of_apply.getPath(), True)
            else:
                for b in stale:
                    fs.delete(jpath(f"{self.path}/data/{name}/{b}"), True)
        for n in every[:-keep]:
            fs.delete(jpath(f"{self.path}/manifest-{n:012d}"), False)
        return gone


def apply_feed(change_log: DataFrame, path: str | None = None) -> DataFrame:
    """State, with tombstones, after a feed; ``path`` keeps it between calls."""
    spark = change_log.sparkSession
    return StateTable(spark, path or shared_path(spark, "state")).apply(change_log)


def live_rows(state: DataFrame) -> DataFrame:
    """The rows of a state without its tombstones."""
    return state.where(~F.col("deleted"))
