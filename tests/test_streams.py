"""Streams over tables of many files."""

import datetime as dt
import os

import pytest

from keytide.session import shared_path
from keytide.streaming import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture
def put_files(spark, tmp_path):
    """Writes DataFrames as the files of a table, the first to be read first."""

    def put(name, parts):
        at = tmp_path / f"{name}.parquet"
        at.mkdir()
        for i, part in enumerate(parts):
            part.coalesce(1).write.parquet(str(tmp_path / f"{name}-part{i}"))
            (file,) = (tmp_path / f"{name}-part{i}").glob("*.parquet")
            os.rename(file, at / f"{i}.parquet")
            os.utime(at / f"{i}.parquet", (1_700_000_000 + i * 100,) * 2)
        return str(tmp_path)

    return put


@pytest.fixture
def equals_sql(spark, rows):
    """Whether a query over a directory gives what its SQL gives."""
    import duckdb

    import __spark_entry__ as entry

    def same(name, sf, *tables):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet{'/*.parquet' if os.path.isdir(f'{sf}/{t}.parquet') else ''}'")
        got = entry.queries()[name](spark, sf)
        cur = con.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in cur.description].index(c) for c in got.columns]
        return rows(got) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)

    return same


def test_leases_of_many_files_equal_their_sql(spark, put_files, equals_sql):
    ops = spark.read.parquet(f"{SF}/lease_ops.parquet")
    sf = put_files("lease_ops", [ops.where(f"op_id % 3 = {i}") for i in (2, 0, 1)])
    assert equals_sql("stream_leases", sf, "lease_ops")


def test_leases_of_a_bucket_end_one_by_one(spark, rows, put_files):
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    schema = "op_id long, ts timestamp, op string, lease_id long, ttl long, key string, arrived_at timestamp"
    parts = [
        [(1, 0, "grant", 7, 3600, None), (2, 0.5, "attach", 7, None, "b"), (3, 0.6, " Attach", 7, None, "a"), (4, 1, "grant", 8, 360_000, None), (5, 1, "grant", 9, 7200, None), (6, 1, "attach", 8, None, "c"), (6, 1, "attach", 8, None, "c")],
        [(7, 30, "keepalive", 8, None, None)],
        [(8, 31, "keepalive", 9, None, None), (9, 31, "attach", 8, None, "c"), (10, 31, "attach", 8, None, None), (11, 200, "keepalive", 10, None, None)],
    ]
    sf = put_files("lease_ops", [spark.createDataFrame([(i, at(h), op, lease, ttl, key, at(h)) for i, h, op, lease, ttl, key in part], schema) for part in parts])
    out = shared_path(spark, "leases")
    found = feeds.lease_stream(feeds.feed_stream(spark, sf, "lease_ops"), late="1 day", buckets=1)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    want = [(1, "granted", 7, []), (2, "attached", 7, []), (3, "attached", 7, []), (4, "granted", 8, []), (5, "granted", 9, []), (6, "attached", 8, []), (7, "renewed", 8, []), (9, "ignored", 8, []), (10, "ignored", 8, []), (11, "not found", 10, [])]
    want += [(8, "expired", 9, []), (-1, "collected", 7, ["a", "b"]), (-1, "collected", 9, []), (-1, "collected", 8, ["c"])]
    assert rows(spark.read.parquet(out), "op_id", "outcome", "lease_id", "keys") == sorted(want, key=str)


@pytest.mark.parametrize(("name", "step"), [("stream_apply", "StateTable"), ("stream_watch_feed", "match_watchers")])
def test_small_files_share_a_batch(spark, put_files, equals_sql, monkeypatch, name, step):
    log = spark.read.parquet(f"{SF}/change_log.parquet")
    sf = put_files("change_log", [log.where(f"feed_pos % 4 = {i}") for i in (3, 0, 2, 1)])
    spark.read.parquet(f"{SF}/watchers.parquet").write.parquet(f"{sf}/watchers.parquet")
    batches, of = [], getattr(feeds, step)
    monkeypatch.setattr(feeds, step, lambda *args: batches.append(1) or of(*args))
    assert equals_sql(name, sf, "change_log", "watchers") and len(batches) == 1
    monkeypatch.setattr("keytide.plans.streams.BYTES_AT_ONCE", 1)
    assert equals_sql(name, sf, "change_log", "watchers") and len(batches) == 1 + 4
