"""Queries that must cover the whole of their tables."""

import datetime as dt
import os

import pytest

from keytide.functions.codecs import read_block
from keytide.operators import runs
from keytide.session import shared_path
from keytide.sources.fixtures import store_log
from keytide.streaming import feeds

SF = "/root/testdata/sf0.001"


@pytest.fixture
def by_sql():
    """Rows of a query's SQL, in the order of given columns."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("change_log", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def run(name, columns):
        cur = con.execute(entry.oracle_sql()[name])
        at = [[d[0] for d in cur.description].index(c) for c in columns]
        return sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)

    return run


def test_every_delete_is_told(spark, rows, by_sql):
    import __spark_entry__ as entry

    log = sorted((r.revision, r.seq, r.key, r.op) for r in store_log(spark, SF).collect())
    there, want = set(), []
    for revision, seq, key, op in log:
        if op == "delete":
            want.append((revision, seq, key, key in there))
            there.discard(key)
        else:
            there.add(key)
    got = entry.queries()["delete_existed"](spark, SF)
    assert rows(got) == sorted(want, key=str) == by_sql("delete_existed", got.columns)
    assert any(not "t" <= r[2] < "v" for r in want) and {r[3] for r in want} == {True, False}


def test_blocks_hold_the_whole_log(spark, rows, by_sql):
    import __spark_entry__ as entry

    got = entry.queries()["block_codec"](spark, SF)
    whole = rows(got)
    assert whole == by_sql("block_codec", got.columns) == rows(store_log(spark, SF), *got.columns)
    assert any(r[2] >= "c" for r in whole) and any(r[3] is None for r in whole)
    size = lambda e: 8 + len(e[0].encode()) + len((e[1] or "").encode())
    read = [(len(r.places), read_block(bytes(r.data))) for r in runs.blocks(store_log(spark, SF), 1000).collect()]
    assert sum(len(b) for _, b in read) == len(whole) and max(n for n, _ in read) > 1
    assert all(n == len(b) and b == sorted(b, key=lambda e: e[0]) and sum(map(size, b[:-1])) < 1000 for n, b in read)
    assert sum(sum(map(size, b)) < 1000 for _, b in read) <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(runs.entries_of_blocks(runs.blocks(store_log(spark, SF).limit(0)))) == []


def test_feed_drops_no_file_that_is_read_late(spark, rows, tmp_path):
    schema = "mod_revision long, seq int, key string, arrived_at timestamp"
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    parts = [[(3, 0, "b", day(26)), (4, 0, "a", day(27))], [(1, 0, "a", day(1)), (2, 0, "z", day(2)), (5, 0, None, day(2)), (6, 0, "b", None)], [(1, 0, "a", day(3)), (3, 0, "b", day(12)), (2, 1, "b", day(3))]]
    at = tmp_path / "change_log.parquet"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        at.mkdir(exist_ok=True)
        (file,) = (tmp_path / f"part{i}").glob("*.parquet")
        os.rename(file, at / f"{i}.parquet")
        os.utime(at / f"{i}.parquet", (1_700_000_000 + i * 100,) * 2)
    watchers = spark.createDataFrame([(1, "a", "c", None), (2, "b", "", None)], "watch_id long, key string, range_end string, start_revision long")
    out = shared_path(spark, "feed")
    feeds.run_watch_feed(feeds.feed_stream(spark, str(tmp_path)), watchers, out, shared_path(spark, "checkpoint")).awaitTermination()
    got = rows(spark.read.parquet(out), "watch_id", "revision", "seq", "key")
    assert got == [(1, 1, 0, "a"), (1, 2, 1, "b"), (1, 3, 0, "b"), (1, 4, 0, "a"), (1, 6, 0, "b"), (2, 2, 1, "b"), (2, 3, 0, "b"), (2, 6, 0, "b")]
