"""Problems 1 to 5 against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from keytide.operators import cdc, incremental, intervals, references, skew, sliced
from keytide.session import shared_path

T0 = dt.datetime(2024, 1, 1)
LOG = "feed_pos long, mod_revision long, seq int, event_type string, key string, value string, create_revision long, lease_id long, ttl_seconds long, ts timestamp_ntz, arrived_at timestamp_ntz"
LEASES = "id long, granted_ttl long, granted_at timestamp_ntz, last_renewed timestamp_ntz, revoked_at timestamp_ntz, keys array<string>, recorded_at timestamp_ntz"
LEASE_OPS = "op_id long, ts timestamp_ntz, op string, lease_id long, ttl long, key string, arrived_at timestamp_ntz"
WATCHERS = "watch_id long, key string, range_end string, start_revision long, created_at timestamp_ntz"
RUNS = "run_id long, watch_id long, read_until timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, status string, recorded_at timestamp_ntz"
OPS = "op_id long, history_id long, op_type string, key string, value string, start_time timestamp_ntz, end_time timestamp_ntz, result string, recorded_at timestamp_ntz"
DELETES = [" delete ", "DELETE", "1", "Delete\t"]
PUTS = ["put", " PUT", "0", None, "Put ", ""]


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def change(pos, rev, seq, kind, key, value="v", lease=None, ts=0, arrived=0):
    return (pos, rev, seq, kind, key, value, None, lease, None, at(ts), at(arrived))


def random_log(rng, n=600):
    """Changes of several revisions, delivered one to three times, out of order; one key has half of them."""
    changes = []
    for rev in range(1, n):
        for seq in range(rng.choice([1, 1, 1, 2])):
            changes.append((rev, seq, rng.random() < 0.3, "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}", rng.choice(["v", "", None])))
    out = []
    for rev, seq, gone, key, value in changes:
        for _ in range(rng.choice([1, 1, 2, 3])):
            arrived = rev * 60 + rng.choice([0, 5, 86_400 * 2 * rng.random()])
            out.append((rev, seq, rng.choice(DELETES if gone else PUTS), key, value, arrived))
    rng.shuffle(out)
    marks = [change(100_000 + i, rng.randrange(n), 0, "PUT", None) for i in range(9)]
    return [change(i, rev, seq, kind, key, value, ts=rev * 60, arrived=arrived) for i, (rev, seq, kind, key, value, arrived) in enumerate(out)] + marks


def gone(kind):
    return (kind or "").strip().upper() in ("DELETE", "1")


# 1 ---------------------------------------------------------------------------------------------------------------------


def test_orphans_edges(spark, rows):
    leases = spark.createDataFrame(
        [
            (1, 60, at(100), at(100), None, ["a"], at(101)),  # later record: revoked at 200
            (1, 60, at(100), at(100), at(200), None, at(201)),
            (1, 60, at(100), at(100), at(200), None, at(201)),  # identical
            (1, None, at(300), None, None, None, at(301)),  # granted again
            (2, 60, at(50), None, at(50), None, at(51)),  # closed as it opened
            (None, 60, at(0), None, None, None, at(1)),
            (3, 60, None, None, None, None, at(1)),
        ],
        LEASES,
    )
    ops = spark.createDataFrame(
        [
            (1, at(99), "keepalive", 1, None, None, at(1)),
            (2, at(100), " Attach", 1, None, None, at(1)),
            (3, at(199), "detach", 1, None, None, at(1)),
            (4, at(200), "keepalive", 1, None, None, at(1)),
            (4, at(200), "keepalive", 1, None, None, at(2)),
            (5, at(90_000_000), "keepalive", 1, None, None, at(1)),
            (6, at(50), "keepalive", 2, None, None, at(1)),
            (7, at(50), "keepalive", None, None, None, at(1)),
            (8, at(50), "keepalive", 0, None, None, at(1)),
            (9, at(50), "grant", 77, None, None, at(1)),
            (10, None, "attach", 1, None, None, at(1)),
            (11, at(50), None, 5, None, None, at(1)),
            (12, at(50), "attach", 3, None, None, at(1)),
        ],
        LEASE_OPS,
    ).withColumn("parent_key", F.lit("clash"))
    log = spark.createDataFrame([change(1, 7, 0, "PUT", "k", lease=9), change(2, 7, 0, "PUT", "k", lease=9), change(3, 8, 0, "PUT", None, lease=9), change(4, 9, 0, "PUT", "k", lease=1, ts=150)], LOG)
    orphans = references.orphan_references(references.lease_references(log, ops), references.standing_grants(leases))
    assert rows(orphans, "ref_table", "ref_id") == [("change_log", 7), ("lease_ops", 1), ("lease_ops", 10), ("lease_ops", 12), ("lease_ops", 4), ("lease_ops", 6)]
    assert rows(references.orphans_by_period(orphans), "ref_table", "day", "orphans") == [("change_log", "2024-01-01", 1), ("lease_ops", "2024-01-01", 4), ("lease_ops", None, 1)]


def test_orphans_random_and_empty(spark, rows):
    rng = random.Random(1)
    grants = [(rng.randrange(6), (a := rng.randrange(400_000)), None if rng.random() < 0.2 else a + rng.randrange(1, 90_000)) for _ in range(60)]
    children = [("c", i, 0 if rng.random() < 0.5 else rng.randrange(8), rng.randrange(500_000)) for i in range(800)]
    parents = spark.createDataFrame([(k + 1, at(a), at(b)) for k, a, b in grants], "parent_key long, opened timestamp_ntz, closed timestamp_ntz")
    kids = spark.createDataFrame([(t, i, k + 1, at(s)) for t, i, k, s in children], "ref_table string, ref_id long, parent_key long, ts timestamp_ntz")
    expected = sorted((("c", i) for _, i, k, s in children if not any(g == k and a <= s and (b is None or b > s) for g, a, b in grants)), key=str)
    assert rows(references.orphan_references(kids, parents), "ref_table", "ref_id") == expected
    assert references.orphan_references(kids.limit(0), parents).count() == 0
    assert references.orphan_references(kids, parents.limit(0)).count() == 800


# 2 ---------------------------------------------------------------------------------------------------------------------


def replay(log):
    last = {}
    for r in log:
        if r[4] is not None and (r[4] not in last or (r[1], r[2]) > last[r[4]][:2]):
            last[r[4]] = (r[1], r[2], gone(r[3]))
    return sorted(((k, v[0]) for k, v in last.items() if not v[2]), key=str)


def test_state_of_random_feed_in_pieces(spark, rows):
    log = random_log(random.Random(2))
    feed = spark.createDataFrame(log, LOG)
    assert rows(cdc.live_rows(cdc.apply_feed(feed)), "key", "mod_revision") == replay(log)
    table = cdc.StateTable(spark, shared_path(spark, "state"))
    assert table.read().count() == 0
    for part in (log[400:], log[:300], log[200:500], log[:50]):
        table.apply(spark.createDataFrame(part, LOG), buckets=3)
    assert rows(cdc.live_rows(table.read()), "key", "mod_revision") == replay(log)


def test_state_rewrites_touched_buckets_only(spark, rows):
    log = random_log(random.Random(5))
    table = cdc.StateTable(spark, shared_path(spark, "state"))
    table.apply(spark.createDataFrame(log, LOG), buckets=8)
    before = table.manifest()[1]["folders"]
    one = [change(90_001, 9_999, 0, "PUT", "a fresh key"), change(90_002, 9_999, 1, "PUT", "a fresh key"), change(90_003, 1, 0, None, None)]
    table.apply(spark.createDataFrame(one, LOG), buckets=3)
    number, held = table.manifest()
    assert number == 1 and held["buckets"] == 8 and sum(before.get(b) != f for b, f in held["folders"].items()) == 1
    assert rows(cdc.live_rows(table.read()), "key", "mod_revision") == replay([*log, *one])
    table.apply(spark.createDataFrame(one, LOG).limit(0))
    assert table.manifest()[1]["folders"] == held["folders"]
    assert table.vacuum(keep=1) == 1 and table.vacuum(keep=1) == 0  # the bucket that was written again
    assert table._manifests() == [2] and rows(cdc.live_rows(table.read()), "key", "mod_revision") == replay([*log, *one])


def test_of_two_writers_one_is_told(spark, rows, monkeypatch):
    log = random_log(random.Random(6))
    first, second = (cdc.StateTable(spark, path) for path in [shared_path(spark, "state")] * 2)
    first.apply(spark.createDataFrame(log[:300], LOG), buckets=4)
    seen = second.manifest()
    monkeypatch.setattr(second, "manifest", lambda: seen)
    first.apply(spark.createDataFrame(log[300:450], LOG))
    with pytest.raises(cdc.StaleState):
        second.apply(spark.createDataFrame(log[450:], LOG))
    assert rows(cdc.live_rows(first.read()), "key", "mod_revision") == replay(log[:450])
    monkeypatch.undo()
    second.apply(spark.createDataFrame(log[450:], LOG))
    assert rows(cdc.live_rows(first.read()), "key", "mod_revision") == replay(log)


def test_state_edges(spark, rows):
    feed = spark.createDataFrame([change(5, None, None, "PUT", "n", "old"), change(6, 1, None, "PUT", "n", "new"), change(3, 4, 0, "PUT", "t", "first"), change(9, 4, 0, "put", "t", "first"), change(1, 2, 0, "PUT", "d"), change(2, 2, 1, "1", "d", "left over"), change(7, 1, 0, None, "K"), change(8, 1, 0, None, "k "), change(10, 1, 0, None, "", "x" * 100_000)], LOG).withColumn("deleted", F.lit("clash"))
    state = cdc.apply_feed(feed)
    assert rows(state, "key", "mod_revision", "deleted", "feed_pos") == [("", 1, False, 10), ("K", 1, False, 7), ("d", 2, True, 2), ("k ", 1, False, 8), ("n", 1, False, 6), ("t", 4, False, 3)]
    assert cdc.apply_feed(feed.limit(0)).count() == 0


def test_state_parts_handed_on_early(spark, rows, monkeypatch):
    log = random_log(random.Random(3), 300)
    monkeypatch.setattr(cdc, "ROWS_AT_ONCE", 1)
    monkeypatch.setattr(cdc, "KEYS_HELD", 5)
    import pyarrow as pa

    names = [c.split()[0] for c in cdc.STATE_SCHEMA.split(", ")]
    batch = pa.Table.from_pylist([dict(zip(names, (r[4], r[1], r[2], gone(r[3]), r[5], None, None, None, None, r[0]), strict=True)) for r in log if r[4] is not None], schema=cdc._ARROW)
    best = {}
    for part in cdc._upsert(iter(batch.to_batches(max_chunksize=20))):
        for r in part.to_pylist():
            if r["key"] not in best or (r["mod_revision"], r["seq"]) > best[r["key"]][:2]:
                best[r["key"]] = (r["mod_revision"], r["seq"], r["deleted"])
    assert sorted(((k, v[0]) for k, v in best.items() if not v[2]), key=str) == replay(log)
    whole = [r for part in cdc._upsert(iter(batch.sort_by("key").to_batches(max_chunksize=20)), by_key=True) for r in part.to_pylist()]
    assert len({r["key"] for r in whole}) == len(whole) == len(best)  # sorted by key, each comes once
    assert sorted(((r["key"], r["mod_revision"]) for r in whole if not r["deleted"]), key=str) == replay(log)


# 3 ---------------------------------------------------------------------------------------------------------------------


def pending(log, watchers, runs):
    first = {}
    for r in log:
        if r[4] is not None and r[10] is not None:
            k = (r[1], r[2])
            first[k] = (min(r[10], first[k][0]) if k in first else r[10], r[4])
    out = []
    for w, key, end, start, created in watchers:
        latest = {}
        for run in runs:
            if run[1] == w and (run[0] not in latest or run[6] > latest[run[0]][6]):
                latest[run[0]] = run
        if not latest or (top := latest[max(latest)])[5] == "ok":
            continue
        low = max((r[2] for r in latest.values() if r[5] == "ok"), default=created)
        for (rev, seq), (arrived, k) in first.items():
            covered = k == key if not end else key <= k < end
            if covered and rev >= (start or 0) and low < arrived <= top[2]:
                out.append((w, rev, seq))
    return sorted(out, key=str)


def test_increments_random(spark, rows):
    rng = random.Random(4)
    log = random_log(rng, 400)
    watchers = [(w, (key := rng.choice(["hot", f"k{rng.randrange(40)}"])), rng.choice([None, "", "k2", key + "~", "a"]), rng.choice([None, 0, 150]), at(rng.randrange(9_000))) for w in range(40)]
    runs = []
    for w in range(38):
        t = 0
        for i in range(rng.choice([1, 3, 5])):
            t += rng.randrange(1, 9_000)
            for status in rng.choice([["ok"], ["running", "ok"], ["running", "failed"], ["running"], ["running", None], ["failed"]]):
                runs.append((w * 10 + i, w, at(t), at(t), None, status, at(t + len(runs))))
                if rng.random() < 0.2:
                    runs.append(runs[-1])
    rng.shuffle(runs)
    frames = spark.createDataFrame(log, LOG), spark.createDataFrame(watchers, WATCHERS).withColumn("bin", F.lit(0)), spark.createDataFrame(runs, RUNS)
    expected = pending(log, watchers, runs)
    assert len(expected) > 50
    assert rows(incremental.resume_watchers(*frames)) == expected
    few = incremental.pending_changes(incremental.first_arrivals(frames[0]), incremental.run_bounds(*frames[1:]), bins=2)
    assert rows(few) == expected
    for i in range(3):
        assert incremental.resume_watchers(*(f.limit(0) if i == j else f for j, f in enumerate(frames))).count() == 0


def test_commit_holds_output_and_marks_together(spark, rows):
    run = incremental.IncrementalRun(spark)
    assert run.watermarks() is None
    out, marks = spark.createDataFrame([(1, 2, 3)], "watch_id long, mod_revision long, seq int"), spark.createDataFrame([(1, at(5))], "watch_id long, mark timestamp_ntz")
    assert rows(run.commit(out, marks)) == [(1, 2, 3)]
    assert rows(run.watermarks()) == [(1, at(5))]
    broken = out.withColumn("seq", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        run.commit(broken, marks.withColumn("mark", F.lit(at(9)).cast("timestamp_ntz")))
    assert rows(run.watermarks()) == [(1, at(5))]


def feed_and_bounds(spark, seed=11):
    rng = random.Random(seed)
    log = random_log(rng, 500)
    times = sorted(r[10] for r in log if r[10] is not None)
    low, middle, high = times[20], times[len(times) // 2], times[-20]
    watchers = [(1, "", "zzzz", 0), (2, "k", None, 0), (3, "a", "l", 3)]
    bounds = lambda until: spark.createDataFrame([(*w, low, until) for w in watchers], "watch_id long, key string, range_end string, start_revision long, low timestamp_ntz, high timestamp_ntz")
    return log, bounds(middle), bounds(high)


def test_a_second_run_starts_where_the_first_ended(spark, rows):
    log, half, full = feed_and_bounds(spark)
    feed, path = spark.createDataFrame(log, LOG), shared_path(spark, "increments")
    whole = rows(incremental.pending_changes(incremental.first_arrivals(feed), full))
    first = rows(incremental.run_increment(feed, half, path))
    assert rows(incremental.run_increment(feed, half, path)) == []  # nothing new
    only_one = full.where("watch_id = 1")
    second = rows(incremental.run_increment(feed, only_one, path))
    marks = dict(rows(incremental.IncrementalRun(spark, path).watermarks()))
    assert set(marks) == {1, 2, 3} and marks[1] > marks[2] == marks[3]  # those that did not run keep theirs
    third = rows(incremental.run_increment(feed, full, path))
    assert first and second and sorted(first + second + third, key=str) == whole and {r[0] for r in second} == {1} and 1 not in {r[0] for r in third}
    assert rows(incremental.run_increment(feed, full, path)) == []


def test_failures_before_and_after_the_commit(spark, rows, monkeypatch):
    log, half, full = feed_and_bounds(spark, 12)
    feed, path = spark.createDataFrame(log, LOG), shared_path(spark, "increments")
    whole = rows(incremental.pending_changes(incremental.first_arrivals(feed), full))
    first = rows(incremental.run_increment(feed, half, path))
    real = incremental.rename_new

    def lost(*_):
        raise OSError("lost")

    monkeypatch.setattr(incremental, "rename_new", lost)
    with pytest.raises(OSError, match="lost"):  # written, not published
        incremental.run_increment(feed, full, path)
    monkeypatch.setattr(incremental, "rename_new", lambda *a: real(*a) and lost())
    with pytest.raises(OSError, match="lost"):  # published, then the driver is gone: the output stands, and is not given again
        incremental.run_increment(feed, full, path)
    monkeypatch.undo()
    assert rows(incremental.run_increment(feed, full, path)) == []
    kept = spark.read.parquet(f"{path}/run-{1:012d}/output")
    assert sorted(first + rows(kept), key=str) == whole


def test_of_two_runs_one_commits(spark, rows):
    log, half, full = feed_and_bounds(spark, 13)
    run = incremental.IncrementalRun(spark)
    opened, number = run.start(half)
    also, same = run.start(full)
    marks = opened.select("watch_id", F.col("high").alias("mark"))
    out = spark.createDataFrame([(1, 2, 3)], "watch_id long, mod_revision long, seq int")
    run.commit(out, marks, number)
    with pytest.raises(RuntimeError, match="another run"):
        run.commit(out, also.select("watch_id", F.col("high").alias("mark")), same)
    assert rows(run.watermarks()) == rows(marks)


def test_slices_hold_like_many_rows_of_a_hot_key_in_one_hour(spark):
    """Half of all rows are one key's, within an hour of a year: none of its slices holds more than the bound."""
    hour, year = 3_600, 365 * 86_400
    rows = spark.range(64_000).selectExpr("if(id % 2 = 0, 'hot', concat('k', id % 1000)) AS key", f"if(id % 2 = 0, 100 * 86400 + (id * 7919) % {hour}, (id * 104729) % {year}) AS at", "id")
    slice_of = sliced.even_slices(rows, F.col("at"), slices := 32)
    most = rows.withColumn("slice", slice_of(F.col("at"))).groupBy("key", "slice").count().agg(F.max("count")).first()[0]
    assert most <= 64_000 / slices * 1.2
    nulls = rows.limit(3).select(slice_of(F.lit(None).cast("long")).alias("s"), slice_of(F.lit(-5)).alias("low"), slice_of(F.lit(10**12)).alias("high")).distinct().collect()
    assert [tuple(r) for r in nulls] == [(None, 0, slices - 1)]
    assert rows.limit(1).select(sliced.even_slices(rows.limit(0), F.col("at"))(F.col("at")).alias("s")).first().s == 0
    same = rows.select(F.lit(5).alias("at"))
    assert same.select(sliced.even_slices(same, F.col("at"))(F.col("at")).alias("s")).distinct().count() == 1


def test_bins_of_keys(spark):
    bounds = ["b", "d", "dd", "é"]
    bin_of = sliced.bins_between(bounds)
    keys = ["", "a", "b", "c", "d", "da", "dd", "e", "z", "é", "日"]
    got = {r.k: r.n for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", bin_of(F.col("k")).alias("n")).collect()}
    assert got == {k: sum(b.encode() <= k.encode() for b in bounds) for k in keys}


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_results_per_key(spark, rows):
    log = random_log(random.Random(5))
    distinct = {(r[1], r[2]): r for r in log if r[4] is not None}
    expected = {}
    for r in distinct.values():
        n, d, lo, hi = expected.get(r[4], (0, 0, r[1], r[1]))
        expected[r[4]] = (n + 1, d + gone(r[3]), min(lo, r[1]), max(hi, r[1]))
    feed = spark.createDataFrame(log, LOG).withColumn("salt", F.lit("clash")).withColumn("heavy_key", F.lit(1))
    got = skew.per_key_results(feed, share=0.05)
    assert rows(got) == sorted(((k, *v) for k, v in expected.items()), key=str)
    total = len(distinct)
    assert rows(skew.heaviest(got, 0.02), "key") == sorted(((k,) for k, v in expected.items() if v[0] * 50 >= total), key=str)
    empty = skew.per_key_results(feed.limit(0))
    assert empty.count() == 0 and skew.heaviest(empty).count() == 0


def test_share_is_exact():
    assert skew.at_least(0.01, 1_840_000) == 18_400 and skew.at_least(0.01, 101) == 2 and skew.at_least(0.01, 0) == 1


# 5 ---------------------------------------------------------------------------------------------------------------------


def merge(ops):
    out = {}
    for o in ops:
        if None not in (o[1], o[3], o[5], o[6]) and o[6] >= o[5]:
            out.setdefault((o[1], o[3]), []).append((o[5], o[6]))
    periods, gaps = [], []
    for e, spans in out.items():
        own = []
        for s, t in sorted(spans):
            if own and s <= own[-1][1]:
                own[-1][1] = max(own[-1][1], t)
            else:
                own.append([s, t])
        periods += [(*e, *p) for p in own]
        gaps += [(*e, a[1], b[0]) for a, b in zip(own, own[1:])]
    return sorted(periods, key=str), sorted(gaps, key=str)


@pytest.mark.parametrize("scale", [1, 400, 40_000])
def test_periods_random(spark, rows, scale):
    rng = random.Random(scale)
    micro = lambda n: T0 + dt.timedelta(microseconds=n)
    ops = []
    for i in range(500):
        s = rng.randrange(400) * scale * 1000
        e = s + rng.choice([0, 1, rng.randrange(3000) * scale, 86_400_000_000 if rng.random() < 0.05 else 5])
        ops.append((i, rng.choice([1, 1, 1, 2, None]), "Read", rng.choice(["a", "a", "b", None]), None, None if rng.random() < 0.03 else micro(s), rng.choice([None, micro(s - 1)]) if rng.random() < 0.05 else micro(e), None, None))
    ops += ops[:50]
    frame = spark.createDataFrame(ops, OPS).withColumn("slice", F.lit("clash")).withColumn("session_window", F.lit(1)).withColumn("e0", F.lit(1))
    periods, gaps = intervals.periods_and_gaps(frame, ["history_id", "key"], "start_time", "end_time")
    as_text = lambda df, *cols: rows(df.select("history_id", "key", *(intervals.text_of(F.col(c)) for c in cols)))
    text = lambda found: sorted(((h, k, *(t.strftime("%Y-%m-%d %H:%M:%S.%f") for t in ts)) for h, k, *ts in found), key=str)
    want_periods, want_gaps = merge(ops)
    assert as_text(periods, "period_start", "period_end") == text(want_periods)
    assert as_text(gaps, "gap_start", "gap_end") == text(want_gaps)


def test_periods_touch_and_empty(spark, rows):
    e = lambda i, s, t: (i, 1, "Read", "k", None, s, t, None, None)
    a = T0 - dt.timedelta(days=40 * 365, microseconds=1)
    us = dt.timedelta(microseconds=1)
    ops = [e(1, a, a + us), e(2, a + us, a + 2 * us), e(3, a + 3 * us, a + 3 * us), e(4, a + 3 * us, a + 3 * us)]
    frame = spark.createDataFrame(ops, OPS)
    periods, gaps = intervals.periods_and_gaps(frame, ["history_id", "key"], "start_time", "end_time")
    assert periods.count() == 2 and rows(gaps.select((F.col("gap_end") - F.col("gap_start")).alias("n"))) == [(1,)]
    assert rows(gaps.select(intervals.text_of(F.col("gap_end")))) == [((a + 3 * us).strftime("%Y-%m-%d %H:%M:%S.%f"),)]
    assert all(df.count() == 0 for df in intervals.periods_and_gaps(frame.limit(0), ["history_id", "key"], "start_time", "end_time"))
