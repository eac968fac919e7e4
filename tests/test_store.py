"""Reads, history, runs, transactions, watchers, leases, rules of replication: literal cases and replays."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from keytide.operators import applying, audit, consensus, leasing, runs, transactions, versions, watching
from keytide.session import shared_path
from keytide.sources import snapshots

LOG = "revision long, seq int, key string, op string, value string, lease_id long, ttl_seconds long"


def random_log(rng, n=500):
    log = []
    for rev in range(1, n):
        for seq in range(rng.choice([1, 1, 3])):
            put = rng.random() < 0.65
            log.append((rev, seq, rng.choice(["hot", "hot", "a", "ab", "b", "", "ÿ"]), "put" if put else "delete", rng.choice(["x", "", None]) if put else None, 0, rng.randrange(3) * 100 if put else 0))
    return log


def replay(log, top=None):
    """For each row: create_revision, version_no, prev_value, existed; and the live keys at the end."""
    state, out = {}, []
    for rev, seq, key, op, value, _, _ in sorted(log):
        if top is not None and rev > top:
            continue
        old = state.get(key)
        if op == "put":
            create, no = (old[0], old[1] + 1) if old else (rev, 1)
            state[key] = (create, no, value, rev)
        else:
            create, no = 0, 0
            state.pop(key, None)
        out.append((rev, seq, key, create, no, old[2] if old else None, old is not None))
    return out, state


def test_history_and_reads(spark, rows):
    log = random_log(random.Random(1))
    df = spark.createDataFrame(log, LOG).unionByName(spark.createDataFrame([(9, 9, None, "put", "x", 0, 0)], LOG))
    expected, state = replay(log)
    for slices in (1, 7, 64):
        got = versions.history(df, slices)
        assert rows(got, "revision", "seq", "key", "create_revision", "version_no", "prev_value", "existed") == sorted(expected, key=str)
    by_key = {}
    for r in sorted(log):
        by_key.setdefault(r[2], []).append(r)
    nexts = [(r[0], r[1], k, rs[i + 1][0] if i + 1 < len(rs) else None, len(rs) - i) for k, rs in by_key.items() for i, r in enumerate(rs)]
    assert rows(got, "revision", "seq", "key", "next_revision", "rank_newest") == sorted(nexts, key=str)
    assert rows(versions.live(df), "key", "value", "create_revision", "mod_revision") == sorted(((k, v[2], v[0], v[3]) for k, v in state.items()), key=str)
    _, half = replay(log, 250)
    assert rows(versions.live(df, 250), "key", "mod_revision") == sorted(((k, v[3]) for k, v in half.items()), key=str)
    keys = spark.createDataFrame([("hot",), ("absent",), (None,)], "key string")
    want = [(k, (state[k][2] or "") if k in state else "", state[k][3] if k in state else 0) for k in ("hot", "absent", None)]
    assert rows(versions.get_many(df, keys)) == sorted(want, key=str)
    assert versions.history(df.limit(0)).count() == 0 and versions.live(df.limit(0)).count() == 0


def test_as_of(spark, rows):
    rng = random.Random(2)
    log = random_log(rng)
    asked = [(i, rng.choice(["hot", "a", "none", None]), rng.randrange(-3, 600)) for i in range(300)]
    want = []
    for pid, key, rev in asked:
        if key is not None:
            seen = [r for r in log if r[2] == key and r[0] <= rev]
            last = max(seen, default=None)
            want.append((pid, key, *((last[4], last[0]) if last and last[3] == "put" else (None, None))))
    df, probes = spark.createDataFrame(log, LOG), spark.createDataFrame(asked, "pid long, key string, revision long")
    assert rows(versions.as_of(probes, df)) == sorted(want, key=str)
    assert rows(versions.as_of(probes, df, slices=3)) == sorted(want, key=str)
    assert rows(versions.as_of(probes.where("key is not null"), df.limit(0)), "value").count((None,)) == len(want)


def test_ranges(spark, rows):
    df = spark.createDataFrame([(i, 0, k, "put", k, 0, 0) for i, k in enumerate(["ab", "a", "b", "", "é", "z"])], LOG)
    page = lambda *a: [r.key for r in versions.range_page(df, *a).collect()]
    assert page("a", "c") == ["a", "ab", "b"] and page("a", "c", 2) == ["a", "ab"] and page("c", "a") == [] and page("a", "") == [] and page("", "zz")[0] == ""
    assert rows(versions.in_range(df, prefix="a").select("key")) == [("a",), ("ab",)]
    assert rows(versions.newest(df.where("key = 'a'")), "key") == [("a",)]


def test_garbage_and_expiry(spark, rows):
    put = lambda r, k, ttl=0: (r, 0, k, "put", "v", 0, ttl)
    log = [put(1, "k"), put(2, "k"), put(3, "k"), put(1, "o"), (2, 0, "d", "delete", None, 0, 0), put(1, "t", 5)]
    df = spark.createDataFrame(log, LOG)
    assert rows(versions.collect_garbage(df, 3), "key", "revision") == [("d", 2), ("k", 3), ("o", 1), ("t", 1)]
    assert ("k", 2) in rows(versions.collect_garbage(df, 2, safe=True), "key", "revision")
    assert versions.collect_garbage(df.where("key = 'o'"), 100).count() == 1
    assert versions.expired_by_ttl(df, 5).count() == 0 and rows(versions.expired_by_ttl(df, 6), "key") == [("t",)]
    assert rows(versions.ttl_deletes(df, 6)) == [(4, 0, "t", "delete")]
    assert versions.ttl_deletes(df.limit(0), 6).count() == 0


def test_runs(spark, rows, tmp_path):
    entries = spark.createDataFrame([(1, 1, "a", "old"), (1, 1, "b", "old"), (2, 0, "a", "mid"), (3, 0, "a", "new"), (3, 0, "b", None), (4, 1, "x", "far")], "sst_id long, level int, key string, value string")
    assert rows(runs.merged(entries)) == [("a", "new"), ("x", "far")]
    assert rows(runs.merged(entries, keep_tombstones=True)) == [("a", "new"), ("b", None), ("x", "far")]
    stats = runs.run_statistics(entries)
    assert rows(runs.overlapping_runs(stats, 0), "sst_id") == [(1,), (2,), (3,)]
    assert rows(runs.compact(entries, 0, 1), "key", "value") == [("a", "new")]
    assert rows(runs.compact(entries, 0, 3), "key", "value") == [("a", "new"), ("b", None)]
    level = lambda *n: rows(runs.level_to_compact(spark.createDataFrame(list(n), "level int, runs long")))
    assert level((0, 3)) == [] and level((0, 4), (1, 99)) == [(0,)] and level((1, 40)) == [] and level((1, 41)) == [(1,)] and level((6, 10**9)) == []
    runs.write_run(entries.select("key", "value").distinct(), str(tmp_path / "run"))
    assert rows(runs.read_run(spark, str(tmp_path / "run"), "b", "y").select("key").distinct()) == [("b",), ("x",)]
    assert runs.bloom_sizes(10_000, 0.01) == (95851, 7) and runs.bloom_sizes(0, 5) == (8, 6)


def test_transactions(spark, rows):
    log = spark.createDataFrame([(1, 0, "a", "put", "x", 0, 0), (3, 0, "a", "put", "y", 0, 0), (4, 0, "b", "put", "z", 0, 0), (5, 0, "b", "delete", None, 0, 0)], LOG)
    reads = spark.createDataFrame([(1, 1, 2, "a"), (2, 1, 3, "a"), (3, 1, 3, "a"), (4, 3, 5, "b"), (5, 2, 4, "a"), (5, 2, 4, "b"), (6, 1, 2, None)], "txn_id long, start_revision long, commit_at long, key string")
    writes = spark.createDataFrame([(t, s, k, o, v) for t, s, k, o, v in [(1, 1, "q", "put", "1"), (2, 1, "q", "put", "1"), (4, 1, "q", "put", "1"), (5, 1, "q", "put", "1"), (5, 2, "q", "delete", None), (6, 1, None, "put", "1"), (6, 2, "w", "put", "2")]], "txn_id long, seq int, key string, op string, value string")
    got = {r.txn_id: (r.status, r.conflicts, r.revision) for r in transactions.validate(reads, writes, log).collect()}
    assert got == {1: ("committed", 0, 3), 2: ("conflict", 1, None), 3: ("committed", 0, 1), 4: ("committed", 0, 6), 5: ("conflict", 2, None), 6: ("committed", 0, 3)}
    assert rows(transactions.surviving_writes(writes).where("txn_id > 4")) == [(5, "q", 2, "delete", None), (6, "w", 2, "put", "2")]
    latest = spark.createDataFrame([("a", 3, "y")], "key string, version long, value string")
    compare = [(1, "a", "VERSION", "EQUAL", 3, None), (1, "a", "VALUE", "GREATER", None, "x"), (2, "a", "VERSION", "LESS", 3, None), (3, "none", "VERSION", "EQUAL", 0, None), (4, "none", "VALUE", "EQUAL", None, ""), (5, "a", "OTHER", "EQUAL", 3, None), (6, None, None, None, None, None)]
    held = transactions.compare_and_choose(spark.createDataFrame(compare, "txn_id long, key string, target string, result string, version long, value string"), latest)
    assert rows(held) == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True)]
    serial_reads = spark.createDataFrame([(0, 1, 0, 1, "a"), (0, 2, 0, 2, "a"), (0, 3, 1, 3, "b"), (0, 4, 0, 4, "c")], "component long, txn_id long, start_revision long, commit_at long, key string")
    serial_writes = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (0, 3, "c"), (0, 4, "z")], "component long, txn_id long, key string")
    assert rows(transactions.serial_outcomes(serial_reads, serial_writes)) == [(1, "committed"), (2, "conflict"), (3, "committed"), (4, "conflict")]


def test_watchers(spark, rows):
    changes = spark.createDataFrame([(i, 0, k) for i, k in enumerate(["a", "key1", "key10", "b", "d", None])], "revision long, seq int, key string")
    watchers = spark.createDataFrame([(1, "key1", "", None), (2, "a", "d", 1), (3, "a", "d", 0), (4, "z", "a", 0), (5, None, "z", 0), (6, "d", None, 5)], "watch_id long, key string, range_end string, start_revision long")
    assert rows(watching.match_watchers(changes, watchers), "watch_id", "key") == [(1, "key1"), (2, "b"), (3, "a"), (3, "b")]
    assert watching.match_watchers(changes, watchers.limit(0)).count() == 0


def test_lease_fold(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    asked = [(1, 0, "grant", 10, None), (2, 5, "attach", None, "k"), (3, 6, "attach", None, "k"), (4, 9.99, "keepalive", None, None), (5, 15, "grant", 10, None), (6, 20, "keepalive", None, None), (7, 21, "revoke", None, None), (8, 22, "keepalive", None, None), (9, 23, "grant", 0, None), (10, 24, "grant", None, None), (11, 25, " Grant ", 5, None), (12, 26, None, None, None), (13, 27, "detach", None, "k")]
    ops = [(i, t0 + dt.timedelta(seconds=s), op, 7, ttl, key, t0) for i, s, op, ttl, key in asked]
    df = spark.createDataFrame(ops + ops[:3] + [(99, t0, "grant", None, 5, None, t0), (98, t0, "grant", 0, 5, None, t0)], "op_id long, ts timestamp_ntz, op string, lease_id long, ttl long, key string, arrived_at timestamp_ntz")
    requests = leasing.distinct_requests(df)
    got = {r.op_id: (r.outcome, r["keys"]) for r in leasing.lease_outcomes(requests).collect()}
    outcomes = ["granted", "attached", "ignored", "renewed", "exists", "expired", "revoked", "not found", "invalid", "invalid", "granted", "ignored", "ignored"]
    assert got == {i + 1: (o, ["k"] if o == "revoked" else []) for i, o in enumerate(outcomes)}
    assert leasing.liveness_gaps(requests).count() == 0  # signs of life at 0, 9.99, 15, 20, 22, 23, 24, 25 s
    sparse = requests.where("op_id in (1, 6, 8)")  # at 0, 20 and 22 s, with a ttl of 10 s
    assert rows(leasing.liveness_gaps(sparse), "lease_id", "seconds", "ttl") == [(7, 20, 10)]
    assert leasing.lease_outcomes(requests.limit(0)).count() == 0


def test_replication_rules(spark, rows):
    members = spark.createDataFrame([("old", i) for i in range(3)] + [("new", i) for i in range(5)], "config string, node_id long")
    log = spark.createDataFrame([(i, 1 if i < 5 else 2) for i in range(1, 10)], "log_index long, term long")
    acks = lambda *m: spark.createDataFrame(list(enumerate(m)), "node_id long, match_index long")
    point = lambda a, term=2, committed=0: consensus.commit_index(a, members, log, term, committed).first()[0]
    assert point(acks(9, 9, 9, 1, 1)) == 9 and point(acks(9, 7, 3, 8, 8)) == 7 and point(acks(9, 7, 3, 8, 8), committed=7) == 7
    assert point(acks(4, 4, 4, 4, 4)) == 0 and point(acks(9, 6, 6)) == 6 and point(acks(9)) == 0
    votes = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 0), (2, 1), (2, 3), (3, 9)], "ballot long, node_id long")
    assert rows(consensus.has_quorum(votes, members)) == [(1, 2, False), (2, 3, True), (3, 1, False)]
    follower = spark.createDataFrame([(i, 1) for i in range(1, 8)], "log_index long, term long")
    assert rows(consensus.first_conflict(log, follower)) == [(5, 7, 9)]
    assert rows(consensus.appended(log, follower)) == rows(log)
    longer = spark.createDataFrame([(i, 1 if i < 5 else 2) for i in range(1, 13)], "log_index long, term long")
    assert consensus.appended(log, longer).count() == 12 and rows(consensus.first_conflict(log, longer)) == [(None, 12, 9)]
    data = spark.createDataFrame([(1, 1, "Normal", '{"type":"Put","key":"k","value":"v"}'), (2, 1, "Noop", ""), (3, 1, "Normal", "{broken"), (4, 1, "Normal", None), (5, 1, "Normal", '{"type":"Odd"}')], "log_index long, term long, entry_type string, data string")
    good, bad = applying.read_commands(data, 9)
    assert rows(good, "log_index", "type", "key") == [(1, "Put", "k")] and rows(bad, "log_index") == [(3,), (5,)]


def commands_of(spark, entries):
    return spark.createDataFrame([(i, 1, kind, data) for i, (kind, data) in enumerate(entries, 1)], "log_index long, term long, entry_type string, data string")


def tagged(kind, **parts):
    return "Normal", json.dumps({kind: {k: list(v.encode()) if isinstance(v, str) else v for k, v in parts.items()}})


def test_commands_in_both_shapes(spark, rows):
    log = commands_of(spark, [tagged("Put", key="ké", value="", lease_id=2, ttl_seconds=9), tagged("Delete", key="k"), tagged("LeaseGrant", lease_id=2, ttl=5), tagged("LeaseRevoke", lease_id=2), ("Normal", '{"type":"Put","key":"a","value":"b","lease_id":3,"ttl_seconds":4}'), ("Normal", '{"Put":{"key":[1]}}'), ("Normal", '{"type":"Delete"}'), ("ConfigChange", "x"), ("Noop", "")])
    good, bad = applying.read_commands(log, 9)
    assert rows(good) == [(1, "Put", "ké", "", 2, 9), (2, "Delete", "k", None, None, None), (3, "LeaseGrant", None, None, 2, 5), (4, "LeaseRevoke", None, None, 2, None), (5, "Put", "a", "b", 3, 4)]
    assert rows(bad, "log_index") == [(6,), (7,)] and applying.applied_count(log, 9).first()[0] == 6 and applying.applied_count(log.limit(0), 9).first()[0] == 0


def fold_commands(commands):
    """What applying tells, one command after another."""
    store, leases, out = {}, {}, []
    for i, (_, data) in enumerate(commands, 1):
        ((kind, c),) = json.loads(data).items()
        key = bytes(c["key"]).decode() if "key" in c else None
        if kind == "Put":
            value = bytes(c["value"]).decode()
            out.append((i, 0, key, value, c["lease_id"], c["ttl_seconds"], store[key][0] if key in store else None))
            store[key] = (value, c["lease_id"])
            if c["lease_id"] in leases and c["lease_id"] > 0:
                leases[c["lease_id"]].add(key)
        elif kind == "Delete":
            value, lease = store.pop(key, (None, 0))
            out.append((i, 1, key, "", 0, 0, value))
            leases.get(lease, set()).discard(key)
        elif kind == "LeaseGrant":
            if c["ttl"] > 0:
                leases.setdefault(c["lease_id"], set())
        else:
            for key in leases.pop(c["lease_id"], set()):
                store.pop(key, None)
                out.append((i, 1, key, "", 0, 0, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_applying_commands_like_one_after_another(spark, rows, seed):
    rng, commands = random.Random(seed), []
    for i in range(500):
        key, lease = rng.choice("abc"), rng.randrange(1, 4)
        commands.append(rng.choice([tagged("Put", key=key, value=f"v{i}", lease_id=rng.choice([0, lease, lease]), ttl_seconds=i % 3), tagged("Delete", key=key), tagged("LeaseGrant", lease_id=lease, ttl=rng.choice([0, 5, 5])), tagged("LeaseRevoke", lease_id=lease)]))
    want = fold_commands(commands)
    log = commands_of(spark, commands)
    assert rows(applying.applied_events(log, 500)) == want
    assert sum(w[1] == 1 and w[6] is None for w in want) > 20  # revoked, or not there
    assert applying.applied_events(log.limit(0), 9).count() == 0


def test_a_key_hangs_on_where_another_lease_took_its_value(spark, rows):
    put = lambda lease: tagged("Put", key="k", value="v", lease_id=lease, ttl_seconds=0)
    grant, revoke = (lambda kind: lambda lease: tagged(kind, lease_id=lease, **({"ttl": 5} if kind == "LeaseGrant" else {})))("LeaseGrant"), lambda lease: tagged("LeaseRevoke", lease_id=lease)
    # Lease 2 deletes k, so the delete after it finds nothing to take off lease 1, and the revoke of 1 deletes k again.
    log = commands_of(spark, [grant(1), grant(2), put(1), put(2), put(1), revoke(2), tagged("Delete", key="k"), revoke(1)])
    assert rows(applying.revoked_keys(applying.read_commands(log, 9)[0])) == [(6, 2, "k"), (8, 1, "k")]
    without = commands_of(spark, [grant(1), put(1), tagged("Delete", key="k"), revoke(1)])
    assert applying.revoked_keys(applying.read_commands(without, 9)[0]).count() == 0


def test_transactions_among_themselves(spark, rows):
    log = spark.createDataFrame([(1, 0, "a", "put", "1"), (3, 0, "a", "put", "3"), (4, 0, "b", "delete", None)], "revision long, seq int, key string, op string, value string")
    ops = spark.createDataFrame([(1, 2, 1, "read", "a", None), (1, 2, 2, "put", "a", "mine"), (1, 2, 3, "read", "a", None), (1, 2, 4, "delete", "a", None), (1, 2, 5, "read", "a", None), (2, 9, 1, "read", "b", None), (2, 9, 2, "read", "a", None), (2, 9, 3, "read", None, None)], "txn_id long, start_revision long, seq int, kind string, key string, value string")
    assert rows(transactions.reads_within(ops, log)) == [(1, 1, "a", "1", False, 1), (1, 3, "a", "mine", True, None), (1, 5, "a", None, True, None), (2, 1, "b", None, False, 0), (2, 2, "a", "3", False, 3)]
    changes = spark.createDataFrame([(1, 5, 0, "a", "put", "x"), (1, 5, 1, "b", "put", "y"), (2, 6, 0, "a", "delete", None)], "txn_id long, revision long, seq int, key string, op string, value string")
    assert rows(transactions.created_by(changes, log), "txn_id", "key", "create_revision") == [(1, "a", 1), (1, "b", 5), (2, "a", 0)]
    chosen = spark.createDataFrame([(1, True), (2, False)], "txn_id long, succeeded boolean")
    branches = spark.createDataFrame([(1, True, 1, "put"), (1, False, 2, "get"), (2, True, 1, "put"), (3, True, 1, "put")], "txn_id long, on_success boolean, seq int, op string")
    assert rows(transactions.chosen_operations(chosen, branches)) == [(1, 1, "put", True)]


def test_changes_of_members(spark, rows):
    initial = spark.createDataFrame([(1, [0, 1]), (2, [7]), (3, [5])], "cluster_id long, members array<long>")
    steps = [("add", 1, "NodeAlreadyExists"), ("remove", 9, "NodeNotFound"), ("add", 4, "joint"), ("add", 5, "ChangeInProgress"), ("finalize", None, "finalized"), ("finalize", None, "nothing"), ("remove", 0, "joint"), ("abort", None, "aborted"), ("remove", 0, "joint"), ("finalize", None, "finalized"), ("odd", 1, "unknown")]
    lone = [("remove", 7, "CannotRemoveLastNode"), ("add", 8, "joint")]
    changes = spark.createDataFrame([(c, i, a, n) for c, own in ((1, steps), (2, lone)) for i, (a, n, _) in enumerate(own)], "cluster_id long, at long, action string, node_id long")
    got = consensus.membership_steps(changes, initial)
    assert rows(got, "cluster_id", "at", "status") == sorted(((c, i, s) for c, own in ((1, steps), (2, lone)) for i, (_, _, s) in enumerate(own)), key=str)
    assert rows(consensus.members_after(got, initial)) == [(1, 1), (1, 4), (2, 7), (3, 5)]  # a pending change is no member yet
    assert consensus.membership_steps(changes.limit(0), initial).count() == 0


def test_followers_answers(spark, rows):
    log = spark.createDataFrame([(i, 1 if i < 5 else 2) for i in range(1, 8)], "log_index long, term long")
    cases = [
        (1, 1, 7, 2, 9, []),  # an older term
        (2, 2, 9, 2, 9, []),  # lacks the entry before
        (3, 2, 6, 1, 9, []),  # has it in another term
        (4, 3, 7, 2, 9, [(8, 3), (9, 3)]),  # new entries
        (5, 2, 4, 1, 6, [(5, 2), (6, 3)]),  # conflict at 6
        (6, 2, 3, 1, 9, [(4, 1)]),  # already there: what is beyond stays
        (7, 2, 0, 0, 2, []),
    ]
    requests = spark.createDataFrame(cases, "request_id long, term long, prev_index long, prev_term long, leader_commit long, entries array<struct<log_index:long,term:long>>")
    assert rows(consensus.append_outcomes(requests, log, 2, 3)) == [(1, 2, False, 0, 3, None), (2, 2, False, 7, 3, None), (3, 2, False, 7, 3, None), (4, 3, True, 9, 9, None), (5, 2, True, 6, 6, 6), (6, 2, True, 7, 7, None), (7, 2, True, 7, 3, None)]
    peers = spark.createDataFrame([(1, 8), (2, 5), (3, 1)], "node_id long, next_index long")
    assert rows(consensus.append_requests(peers, log, 2, 4), "node_id", "prev_index", "prev_term", "first_index", "entries") == [(1, 7, 2, None, 0), (2, 4, 1, 5, 3), (3, 0, 0, 1, 7)]


@pytest.mark.parametrize("seed", range(2))
def test_lease_ids_like_one_after_another(spark, rows, seed):
    rng, next_id, want, grants = random.Random(seed), 1, [], []
    for i in range(400):
        asked, ttl = rng.choice([0, 0, None, rng.randrange(1, 90)]), rng.choice([0, 5, 5, 5, None])
        got = None
        if ttl:
            got = asked or next_id
            next_id = max(next_id, got + 1)
        want.append((i, got))
        grants.append((i, asked, ttl))
    assert rows(leasing.allocated_ids(spark.createDataFrame(grants, "at long, lease_id long, ttl long"))) == sorted(want, key=str)


def test_watcher_registry_and_faults(spark, rows):
    asked = spark.createDataFrame([(1, "create", None), (2, "cancel", 1), (3, "cancel", 1), (4, "cancel", 2), (5, "create", None), (6, "cancel", None)], "at long, kind string, watch_id long")
    acks = watching.registry_acks(asked)
    assert rows(acks, "at", "watch_id", "ack") == [(1, 1, True), (2, 1, True), (3, 1, False), (4, 2, False), (5, 2, True), (6, None, False)]
    assert rows(watching.active_watchers(acks)) == [(2,)]
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "node_id long")
    acts = spark.createDataFrame([(10, "cut", 0, 1), (20, "heal", 1, 0), (30, "split", 0, 1), (40, "heal_all", None, None), (50, "isolate", 2, None)], "at long, action string, a long, b long")
    sent = [(t, f, to) for t in (5, 15, 25, 35, 45, 55) for f, to in ((0, 1), (1, 0), (2, 0), (0, 2))]
    messages = spark.createDataFrame([(i, *m) for i, m in enumerate(sent)], "message_id long, at long, from_id long, to_id long")
    lost = {(15, 0, 1), (35, 0, 1), (35, 1, 0), (55, 2, 0), (55, 0, 2)}
    assert rows(audit.delivered(messages, acts, nodes)) == sorted(((i, m not in lost) for i, m in enumerate(sent)), key=str)
    assert rows(audit.delivered(messages, acts.limit(0), nodes)) == sorted(((i, True) for i in range(len(sent))), key=str)


def test_rules_at_their_edges(spark, rows):
    make = spark.createDataFrame
    asked = make([(3, "leader", False), (1, "leader", False), (2, "leader", True), (4, None, False), (5, "follower", True)], "at long, role string, transferring boolean")
    assert rows(consensus.proposals(asked, 7)) == [(1, "accepted", 8), (2, "TransferInProgress", None), (3, "accepted", 9), (4, "NotLeader", None), (5, "NotLeader", None)]
    states = make([(1, "leader", 3, 1, 1, 3), (2, "candidate", 3, 2, None, 4)], "node_id long, role string, term long, voted_for long, leader_id long, seen_term long")
    assert rows(consensus.stepped_down(states)) == [(1, "leader", 3, 1, 1, False), (2, "follower", 4, None, None, True)]
    transfers = make([(1, 0, 5), (2, 0, 5), (3, 0, 5), (4, 0, 5)], "transfer_id long, started_ms long, last_index long")
    seen = make([(1, 100, 4), (1, 101, 5), (1, 150, 9), (2, 100, 4), (2, 101, 5), (3, 50, 4)], "transfer_id long, at_ms long, match_index long")
    assert rows(consensus.transfer_outcomes(transfers, seen.where("at_ms <> 150"), 100)) == [(1, None, "TimedOut"), (2, None, "TimedOut"), (3, None, "Waiting"), (4, None, "Waiting")]
    assert rows(consensus.transfer_outcomes(transfers, seen, 140).where("transfer_id < 3")) == [(1, 101, "TimedOut"), (2, 101, "TimeoutNow")]
    offers = make([(1, 2, 9, 3, 0, 0, 0), (2, 3, 5, 3, 5, 6, 4), (3, 4, 9, 3, 5, 6, 10)], "offer_id long, leader_term long, included_index long, my_term long, snapshot_index long, commit_index long, applied_index long")
    assert rows(consensus.snapshot_verdicts(offers)) == [(1, "stale", 3, 0, 0), (2, "ignored", 3, 6, 4), (3, "installed", 4, 9, 10)]
    nodes, peers = make([(1, "leader"), (2, "follower"), (3, "leader")], "node_id long, role string"), make([(1, 0, 1), (1, 1, 4), (1, 2, 2), (2, 0, 1)], "node_id long, at long, peer_id long")
    assert rows(consensus.drain_targets(nodes, peers)) == [(1, 4), (2, None), (3, None)]
    switches = make([(1, 1, "read"), (1, 2, "fail_reads"), (1, 3, "read"), (1, 4, "write"), (1, 5, "restore_reads"), (1, 6, "read"), (2, 3, "write")], "disk_id long, at long, action string")
    assert rows(audit.disk_verdicts(switches), "disk_id", "at", "ok") == [(1, 1, True), (1, 3, False), (1, 4, True), (1, 6, True), (2, 3, True)]
    edits = make([(1, "add", 1, 0), (2, "add", 2, 0), (3, "remove", 1, None), (4, "add", 9, 1), (5, "remove", 9, None)], "at long, action string, sst_id long, level int")
    assert rows(runs.manifest_after(edits)) == [(2, 0, 10)] and runs.manifest_after(edits.limit(0)).count() == 0
    t = lambda n: dt.datetime(2024, 1, 1, 0, n)
    requests = [(1, "grant", None), (2, "attach", "a"), (3, "attach", "b"), (4, "detach", "a"), (5, "revoke", None), (6, "grant", None), (7, "attach", "c"), (8, "attach", "a"), (9, "detach", "a"), (10, "attach", "a")]
    frame = make([(i, t(i), op, 1, 3_600, key) for i, op, key in requests], "op_id long, ts timestamp_ntz, op string, lease_id long, ttl long, key string")
    assert rows(leasing.attachments_left(leasing.lease_outcomes(frame), frame)) == [(1, "a"), (1, "c")]


def test_audits(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    ops = [(i, 1, kind, key, value, t0, t0 + dt.timedelta(hours=h), result) for i, (kind, key, value, h, result) in enumerate([("Read", "k", "z", 0, "Ok"), ("Write", "k", "1", 1, "Ok"), ("Read", "k", "1", 2, "Ok"), ("Write", "k", "2", 3, "Error(x)"), ("Read", "k", "2", 4, "Ok"), ("Read", "k", None, 50, "Ok"), ("Write", "k", None, 60, "Ok"), ("Read", "k", None, 70, "Ok"), ("Read", None, "q", 71, "Ok"), ("Read", "k", "1", 72, None)])]
    df = spark.createDataFrame([(*o, t0) for o in ops + ops], "op_id long, history_id long, op_type string, key string, value string, start_time timestamp_ntz, end_time timestamp_ntz, result string, recorded_at timestamp_ntz")
    distinct = audit.distinct_operations(df)
    stale = audit.stale_reads(distinct)
    assert rows(stale, "op_id", "expected") == [(4, "1"), (5, "1")] and rows(audit.first_violations(stale, distinct)) == [(1, 4)]
    assert rows(audit.outcome_counts(distinct)) == [(1, "Read", 7, 6, 0, 1), (1, "Write", 3, 2, 1, 0)]
    rng = random.Random(3)
    reads, bad = [(rng.randrange(5000), rng.randrange(60)) for _ in range(200)], [(rng.randrange(5000), rng.randrange(900)) for _ in range(30)]
    want = sorted(((o, n, c) for o, n in set(reads) if (c := sum(n > 0 and m > 0 and o < d + m and o + n > d for d, m in set(bad)))), key=str)
    frame = lambda x: spark.createDataFrame(x, "offset long, size long")
    assert rows(audit.touched_ranges(frame(reads), frame(bad), 64)) == want
    writes = [(rng.randrange(3), i, rng.randrange(50)) for i in range(200)]
    used, expected = {}, []
    for d, i, n in writes:
        ok = used.get(d, 0) + n <= 300
        used[d] = used.get(d, 0) + n * ok
        expected.append((d, i, n, used[d], ok))
    assert rows(audit.fill_disk(spark.createDataFrame(writes, "disk_id long, at long, size long"), 300)) == sorted(expected, key=str)


def test_snapshots(spark, rows):
    log, path, target = spark.createDataFrame(random_log(random.Random(9), 80), LOG), shared_path(spark, "snapshots"), shared_path(spark, "backup")
    assert snapshots.load_snapshot(spark, path) is None
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.backup(spark, path, target)
    for revision in (10, 40):
        snapshots.create_snapshot(log, path, revision)
    meta, kept = snapshots.load_snapshot(spark, path)
    assert meta["last_included_index"] == 40 and rows(kept, "key", "mod_revision") == rows(versions.live(log, 40), "key", "mod_revision")
    assert rows(snapshots.open_store(spark, path, log), "key", "mod_revision") == rows(versions.live(log), "key", "mod_revision")
    other = spark.createDataFrame([(40, 0, "only", "put", "later", 0, 0)], LOG)
    for of in (log, other):
        snapshots.create_snapshot(of, f"{path}-two", 40)
    assert rows(snapshots.load_snapshot(spark, f"{path}-two")[1], "key") == [("only",)]  # of two of one revision, the later
    snapshots.backup(spark, path, target, node_id=3)
    assert snapshots.restore(spark, target)[0]["node_id"] == 3
    kept.limit(1).write.mode("append").parquet(f"{target}/data")
    with pytest.raises(ValueError, match="damaged"):
        snapshots.restore(spark, target)
    assert snapshots.parse_backup_blob(snapshots.backup_blob({"a": 1}, b"xy")) == ({"a": 1}, b"xy")
    assert snapshots.parse_backup_blob(b"x") is None and snapshots.parse_backup_blob(b"\xff\xff\x00\x00{}") is None and snapshots.parse_backup_blob(b"\x02\x00\x00\x00{x") is None
    vote = shared_path(spark, "vote")
    assert snapshots.load_vote(spark, vote)["voted_for"] is None
    snapshots.save_vote(spark, vote, 3, 2)
    snapshots.save_vote(spark, vote, 4, None)
    assert snapshots.load_vote(spark, vote) == {"current_term": 4, "voted_for": None}
