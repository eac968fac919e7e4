"""Binary files, codecs and the streams' equality with batch."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from keytide.functions import codecs
from keytide.session import shared_path
from keytide.sources import files


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items()))
    return df.select(col.alias("x")).first().x


def test_integers_and_keys(spark):
    c = F.col
    assert bytes(one(spark, codecs.little_endian(c("n")), n=258)) == struct.pack("<q", 258)
    assert bytes(one(spark, codecs.little_endian(c("n"), 4), n=0xFFFFFFFF)) == b"\xff" * 4
    for n in (0, 1, -1, 2**62, -(2**63)):
        assert one(spark, codecs.read_little_endian(c("b"), 1), b=struct.pack("<q", n)) == n
    assert one(spark, codecs.read_little_endian(c("b"), 1), b=b"\x01\x02") is None
    assert bytes(one(spark, codecs.encode_key(c("k"), c("r")), k="key", r=5)).hex().upper() == "6B6579FFFFFFFFFFFFFFFA"
    assert tuple(one(spark, codecs.decode_key(codecs.encode_key(c("k"), c("r"))), k="é", r=7)) == ("é", 7)
    assert one(spark, codecs.decode_key(c("b")), b=b"short") is None


def test_records(spark):
    c = F.col
    data = b"\x00hello"
    body = struct.pack("<I", len(data)) + data
    assert bytes(one(spark, codecs.wal_record(c("b")), b=data)) == struct.pack("<I", zlib.crc32(body)) + body == files.wal_blob([data])
    assert one(spark, codecs.decode_wal_op(c("b")), b=b"\x07") is None
    assert one(spark, codecs.decode_entry(c("b")), b=b"\x00" * 20) is None
    assert one(spark, codecs.decode_entry(c("b")), b=b"\x00" * 16 + b"\x09" + b"\x00" * 4) is None
    assert one(spark, codecs.decode_footer(c("b")), b=b"\x00" * 40) is None
    block = one(spark, codecs.encode_block(F.array(F.struct(c("k").alias("key"), F.lit(None).cast("string").alias("value")), F.struct(F.lit("z").alias("key"), c("k").alias("value")))), k="ké")
    assert codecs.read_block(bytes(block)) == [("ké", None), ("z", "ké")]
    with pytest.raises(ValueError):
        codecs.read_block(bytes(block)[2:])


def test_peers(spark):
    assert one(spark, codecs.parse_peers(F.col("t")), t="1=a, 2 = b:1 ,bad,x=y,1=c,3=") == {2: "b:1", 1: "c", 3: ""}
    assert one(spark, codecs.parse_peers(F.col("t")), t="") == {}
    assert one(spark, codecs.leader_hint(F.col("t")), t="leader is None") is None


def test_files(spark, tmp_path):
    good = [b"a", b"", b"x" * 5000]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/one.log").write_bytes(files.wal_blob(good) + b"garbage!!!")
    (tmp_path / "logs/two.log").write_bytes(b"")
    read = files.read_wal(spark, str(tmp_path / "logs"))
    assert [bytes(r.data) for r in read.orderBy("seq").collect()] == good
    with pytest.raises(Exception, match="damaged"):
        files.read_wal(spark, str(tmp_path / "logs"), strict=True).collect()
    entries = [(f"key-{i:04d}", None if i % 7 == 0 else "v" * (i % 90)) for i in range(1000)]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/00000001.sst").write_bytes(files.run_blob(entries))
    got = files.read_runs(spark, str(tmp_path / "runs")).orderBy("key").collect()
    assert [(r.key, r.value) for r in got] == entries
    assert list(files.run_entries(files.run_blob([]))) == []
    for damaged in (b"", files.run_blob(entries)[:-1]):
        with pytest.raises(ValueError):
            list(files.run_entries(damaged))


def test_runs_are_read_where_it_is_needed():
    entries = [(f"k{i:05d}", None if i % 9 == 0 else "v" * (i % 50)) for i in range(0, 4000, 2)]
    blob = files.run_blob(entries, 1000)
    read = []

    def read_at(at, n):
        read.append(n)
        return blob[at : at + n]

    run = files.RunFile(len(blob), read_at)
    assert all(run.get(k) == (True, v) for k, v in entries)
    before = run.blocks_read
    missing = [f"k{i:05d}" for i in range(1, 4000, 2)] + ["", "a", "z"]
    assert not any(run.get(k)[0] for k in missing) and run.blocks_read - before < 0.03 * len(missing)  # what the filter lets through
    before = run.blocks_read
    assert list(run.scan("k00100", "k00120")) == [e for e in entries if "k00100" <= e[0] < "k00120"] and run.blocks_read - before <= 2
    assert list(run.scan()) == entries and list(run.scan("x")) == [] and list(run.scan(None, "a")) == [] and list(run.scan("k00002", "k00002")) == []


def test_run_files_written_in_tasks(spark, rows):
    rng = random.Random(4)
    entries = {(s, f"k{rng.randrange(900):03d}"): rng.choice([None, "", "x" * rng.randrange(80)]) for s in range(3) for _ in range(600)}
    frame = spark.createDataFrame([(s, 0, k, v) for (s, k), v in entries.items()], "sst_id long, level int, key string, value string")
    catalogue = files.write_run_files(frame, path := shared_path(spark, "runs"), target_bytes=1500, block_size=300)
    assert catalogue.count() > 10 and catalogue.agg(F.sum("entries")).first()[0] == len(entries)
    assert rows(files.scan_run_files(catalogue)) == sorted(((s, 0, k, v) for (s, k), v in entries.items()), key=str)
    assert rows(files.scan_run_files(catalogue, "k100", "k200"), "sst_id", "key") == sorted(((s, k) for s, k in entries if "k100" <= k < "k200"), key=str)
    newest = {}
    for (s, k), v in sorted(entries.items()):
        newest[k] = v
    keys = [f"k{i:03d}" for i in range(950)] + ["", "zz", "k001"]
    got = files.get_from_run_files(catalogue, spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string"), bins=5)
    want = [(k, "missing" if k not in newest else "tombstone" if newest[k] is None else "value", newest.get(k)) for k in {*keys, None}]
    assert rows(got) == sorted(want, key=str)
    empty = files.write_run_files(frame.limit(0), shared_path(spark, "runs"))
    assert empty.count() == 0 and files.scan_run_files(empty).count() == 0 and files.get_from_run_files(empty, spark.createDataFrame([("a",)], "key string")).first().state == "missing"
    assert path


def test_segments_of_a_log(spark, rows):
    records = spark.createDataFrame([(i, bytes([i % 256]) * (i % 70)) for i in range(1000)] + [(5000, None)], "seq long, data binary")
    catalogue = files.write_wal_files(records, shared_path(spark, "wal"))
    parts = catalogue.orderBy("first_seq").collect()
    assert sum(p.records for p in parts) == 1000 and all(a.last_seq < b.first_seq for a, b in zip(parts, parts[1:], strict=False))
    read = [bytes(r.data) for r in files.read_wal_files(catalogue).orderBy("first_seq", "at").collect()]
    assert read == [bytes([i % 256]) * (i % 70) for i in range(1000)]
    with open(parts[0].file.removeprefix("file://"), "r+b") as damaged:
        damaged.seek(20)
        damaged.write(b"xxxx")
    with pytest.raises(Exception, match="damaged"):
        files.read_wal_files(catalogue).count()
    assert files.read_wal_files(catalogue, strict=False).count() < 1000
    empty = files.write_wal_files(records.limit(0), shared_path(spark, "wal"))
    assert empty.count() == 0 and files.read_wal_files(empty).count() == 0


@pytest.mark.parametrize("name", ["p1_by_day", "p2_state", "kv_latest", "stream_apply", "stream_watch_feed", "stream_windows", "snapshot_restore", "commit_index", "stale_reads", "corrupt_reads"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in ("change_log", "leases", "lease_ops", "watchers", "ops", "events", "orders", "lineitem", "region", "nation", "part", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["key", "value", "create_revision", "mod_revision", "lease_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark):
    from keytide.__main__ import run
    from keytide.session import shared_path

    path = shared_path(spark, "cli")
    say = lambda *args: [tuple(r) for r in run(spark, [path, *args]).collect()]
    assert say("get", "a") == [] and say("put", "a", "1") == [(1, False)] and say("put", "b", "2") == [(2, False)]
    assert say("get", "a") == [("a", "1", 1)] and say("range", "a", "z", "1") == [("a", "1", 1)] and say("range", "z", "a") == []
    assert say("delete", "a") == [(3, True)] and say("delete", "q") == [(4, False)] and say("status") == [(4, 1, 2)]
    for wrong in ([], ["drop"], ["get"]):
        with pytest.raises(ValueError):
            run(spark, [path, *wrong] if wrong else [])
