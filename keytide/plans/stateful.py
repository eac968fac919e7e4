"""Queries on transactions, watchers and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators import leasing, transactions, versions, watching
from keytide.plans.kv import _NEWEST, _sql
from keytide.plans.registry import Registry
from keytide.sources.fixtures import EVENT_LOG_SQL, OPERATIONS_SQL, SERIAL_SQL, STORE_LOG_SQL, TXNS_SQL, delivered_revisions, event_log, event_sizes, serial_reads, serial_writes, store_log, txn_operations, txn_reads, txn_writes
from keytide.sources.tables import table

REGISTRY = Registry()

_OUTCOME = """seen AS (SELECT r.txn_id, r.start_revision, r.commit_at, CASE WHEN a.op = 'put' THEN a.revision ELSE 0 END AS m0 FROM reads r ASOF LEFT JOIN log a ON a.key = r.key AND r.start_revision >= a.revision),
again AS (SELECT r.txn_id, CASE WHEN a.op = 'put' THEN a.revision ELSE 0 END AS m1 FROM reads r ASOF LEFT JOIN log a ON a.key = r.key AND r.commit_at >= a.revision),
outcome AS (SELECT s.txn_id, CASE WHEN m0 <> m1 AND w.txn_id IS NOT NULL THEN 'conflict' ELSE 'committed' END AS status, CASE WHEN m0 <> m1 AND w.txn_id IS NOT NULL THEN 1 ELSE 0 END AS conflicts,
  CASE WHEN w.txn_id IS NULL THEN start_revision WHEN m0 = m1 THEN commit_at + 1 END AS revision
  FROM seen s JOIN again a ON a.txn_id = s.txn_id LEFT JOIN (SELECT DISTINCT txn_id FROM writes) w ON w.txn_id = s.txn_id),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id, key ORDER BY seq DESC) AS rn FROM writes) WHERE rn = 1)"""


def _outcomes(spark: SparkSession, sf_dir: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    sizes = sizes or event_sizes(spark, sf_dir)
    return transactions.validate(txn_reads(spark, sf_dir, sizes), txn_writes(spark, sf_dir, sizes), event_log(spark, sf_dir))


def _committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = event_sizes(spark, sf_dir)
    return transactions.written_once(_outcomes(spark, sf_dir, sizes), txn_writes(spark, sf_dir, sizes))


@REGISTRY.add("txn_outcome", _sql(EVENT_LOG_SQL, TXNS_SQL, _OUTCOME, select="SELECT txn_id, status, conflicts, revision FROM outcome"))
def txn_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which transactions commit, and where."""
    return _outcomes(spark, sf_dir)


@REGISTRY.add("txn_write_set", _sql(EVENT_LOG_SQL, TXNS_SQL, _OUTCOME, select="SELECT txn_id, key, seq, op, value FROM last"))
def txn_write_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that survive within their transaction."""
    return transactions.surviving_writes(txn_writes(spark, sf_dir))


@REGISTRY.add("txn_committed_changes", _sql(EVENT_LOG_SQL, TXNS_SQL, _OUTCOME, select="SELECT l.txn_id, revision, row_number() OVER (PARTITION BY l.txn_id ORDER BY seq) - 1 AS seq, key, op, value FROM last l JOIN outcome o ON o.txn_id = l.txn_id AND status = 'committed'"))
def txn_committed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows of the transactions that commit."""
    return _committed(spark, sf_dir)


@REGISTRY.add(
    "txn_create_revisions",
    _sql(EVENT_LOG_SQL, TXNS_SQL, _OUTCOME, """epochs AS (SELECT *, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY revision) AS epoch FROM log),
lived AS (SELECT key, revision, op, min(revision) FILTER (op = 'put') OVER (PARTITION BY key, epoch) AS created FROM epochs)""",
         select="""SELECT l.txn_id, o.revision, row_number() OVER (PARTITION BY l.txn_id ORDER BY seq) - 1 AS seq, l.key, l.op, value, CASE WHEN l.op = 'delete' THEN 0 WHEN a.op = 'put' THEN a.created ELSE o.revision END AS create_revision
 FROM last l JOIN outcome o ON o.txn_id = l.txn_id AND status = 'committed' ASOF LEFT JOIN lived a ON a.key = l.key AND o.revision - 1 >= a.revision"""),
)
def txn_create_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the revision that created each key."""
    return transactions.created_by(_committed(spark, sf_dir), event_log(spark, sf_dir))


@REGISTRY.add(
    "txn_serial",
    "WITH RECURSIVE " + SERIAL_SQL + """, fold AS (
  SELECT DISTINCT component, 0::BIGINT AS n, 0::BIGINT AS txn_id, false AS conflict, list_transform(range(20), lambda x: -1000000::BIGINT) AS last FROM sall
  UNION ALL
  SELECT component, n, txn_id, conflict, list_transform(last, lambda x, i: CASE WHEN NOT conflict AND list_contains(wrote, i - 1) THEN txn_id ELSE x END) FROM (
    SELECT s.component, s.n, s.txn_id, s.wrote, f.last, len(s.wrote) > 0 AND f.last[s.key + 1] > s.start_revision AS conflict FROM fold f JOIN sall s ON s.component = f.component AND s.n = f.n + 1))
SELECT txn_id, CASE WHEN conflict THEN 'conflict' ELSE 'committed' END AS status FROM fold WHERE n > 0""",
)
def txn_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which transactions of a batch that only meet each other commit, in their order."""
    return transactions.serial_outcomes(serial_reads(spark, sf_dir), serial_writes(spark, sf_dir))


@REGISTRY.add(
    "txn_own_reads",
    _sql(EVENT_LOG_SQL, OPERATIONS_SQL, """placed AS (SELECT *, last_value(CASE WHEN kind <> 'read' THEN {'kind': kind, 'value': value} END IGNORE NULLS) OVER (PARTITION BY txn_id, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wrote FROM tops)""",
         select="""SELECT p.txn_id, p.seq, p.key, CASE WHEN p.wrote IS NOT NULL THEN p.wrote.value WHEN a.op = 'put' THEN a.value END AS value, p.wrote IS NOT NULL AS own, CASE WHEN p.wrote IS NULL THEN CASE WHEN a.op = 'put' THEN a.revision ELSE 0 END END AS mod_revision
 FROM (SELECT * FROM placed WHERE kind = 'read') p ASOF LEFT JOIN log a ON a.key = p.key AND p.start_revision >= a.revision"""),
)
def txn_own_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reads of transactions see, their own writes first."""
    return transactions.reads_within(txn_operations(spark, sf_dir), event_log(spark, sf_dir))


@REGISTRY.add(
    "txn_compare",
    _sql(EVENT_LOG_SQL, TXNS_SQL, _NEWEST.format(where=""), select="""SELECT txn_id, min(CASE
   WHEN c % 8 = 0 THEN coalesce(n.revision, 0) = start_revision WHEN c % 8 = 1 THEN coalesce(n.revision, 0) <> start_revision WHEN c % 8 = 2 THEN coalesce(n.revision, 0) > start_revision WHEN c % 8 = 3 THEN coalesce(n.revision, 0) < start_revision
   WHEN c % 8 = 4 THEN coalesce(n.value, '') = 'view' WHEN c % 8 = 5 THEN coalesce(n.value, '') <> 'view' WHEN c % 8 = 6 THEN coalesce(n.value, '') > 'view' ELSE coalesce(n.value, '') < 'view' END) AS succeeded
   FROM (SELECT *, txn_id % 8 AS c FROM reads) r LEFT JOIN newest n ON n.key = r.key AND n.op = 'put' GROUP BY txn_id"""),
)
def txn_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the comparisons of transactions hold."""
    pick = lambda names: F.get(F.array(*(F.lit(n) for n in names)), F.pmod("txn_id", F.lit(8)).cast("int"))
    results = ["EQUAL", "NOT_EQUAL", "GREATER", "LESS"]
    compares = txn_reads(spark, sf_dir).select("txn_id", "key", pick(["VERSION"] * 4 + ["VALUE"] * 4).alias("target"), pick(results * 2).alias("result"), F.col("start_revision").alias("version"), F.lit("view").alias("value"))
    latest = versions.newest(event_log(spark, sf_dir)).where("op = 'put'").select("key", F.col("revision").alias("version"), "value")
    return transactions.compare_and_choose(compares, latest)


@REGISTRY.add(
    "txn_branch",
    _sql(EVENT_LOG_SQL, TXNS_SQL, _NEWEST.format(where=""), "chosen AS (SELECT txn_id, coalesce(n.revision, 0) = start_revision OR coalesce(n.revision, 0) > start_revision AS succeeded FROM reads r LEFT JOIN newest n ON n.key = r.key AND n.op = 'put')",
         select="SELECT w.txn_id, seq, w.key, w.op, w.value, succeeded FROM writes w JOIN chosen c ON c.txn_id = w.txn_id WHERE (seq % 2 = 1) = succeeded"),
)
def txn_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operations transactions run, by whether their comparison holds."""
    sizes = event_sizes(spark, sf_dir)
    compares = txn_reads(spark, sf_dir, sizes).select("txn_id", "key", F.lit("VERSION").alias("target"), F.lit("LESS").alias("result"), F.col("start_revision").alias("version"), F.lit("").alias("value"))
    latest = versions.newest(event_log(spark, sf_dir)).where("op = 'put'").select("key", F.col("revision").alias("version"), "value")
    chosen = transactions.compare_and_choose(compares, latest).withColumn("succeeded", ~F.col("succeeded"))
    return transactions.chosen_operations(chosen, txn_writes(spark, sf_dir, sizes).withColumn("on_success", F.col("seq") % 2 == 1))


_MATCH = "m AS (SELECT watch_id, revision, seq, l.key FROM log l JOIN watchers w ON revision >= coalesce(start_revision, 0) AND CASE WHEN coalesce(range_end, '') = '' THEN l.key = w.key ELSE l.key >= w.key AND l.key < range_end END)"


@REGISTRY.add("watch_feed", _sql(STORE_LOG_SQL, _MATCH, select="SELECT watch_id, revision, seq, key FROM m"))
def watch_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change that every watcher sees."""
    return watching.match_watchers(store_log(spark, sf_dir), table(spark, sf_dir, "watchers"))


@REGISTRY.add("watch_counts", _sql(STORE_LOG_SQL, _MATCH, select="SELECT watch_id, count(*) AS events, min(revision) AS first_revision, max(revision) AS last_revision FROM m GROUP BY watch_id"))
def watch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each watcher."""
    return watch_feed(spark, sf_dir).groupBy("watch_id").agg(F.count("*").alias("events"), F.min("revision").alias("first_revision"), F.max("revision").alias("last_revision"))


@REGISTRY.add(
    "watch_events",
    _sql(STORE_LOG_SQL, select="""SELECT CASE WHEN l.op = 'put' THEN 0 ELSE 1 END AS event_type, l.key, coalesce(l.value, '') AS value, CASE WHEN l.op = 'delete' THEN 0 ELSE min(l.revision) FILTER (l.op = 'put') OVER (PARTITION BY l.key, epoch) END AS create_revision,
  l.revision AS mod_revision, l.seq, CASE WHEN prev_op = 'put' THEN prev END AS prev_value FROM (SELECT *, lag(op) OVER w AS prev_op, lag(value) OVER w AS prev, sum(CASE WHEN op = 'delete' THEN 1 ELSE 0 END) OVER w - CASE WHEN op = 'delete' THEN 1 ELSE 0 END AS epoch FROM log WINDOW w AS (PARTITION BY key ORDER BY revision, seq)) l"""),
)
def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes as events, with what they replace."""
    return watching.watch_events(store_log(spark, sf_dir), delivered_revisions(spark, sf_dir))


_STANDING = "standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, granted_at ORDER BY recorded_at DESC) AS rn FROM leases WHERE id IS NOT NULL AND granted_at IS NOT NULL) WHERE rn = 1), cut AS (SELECT max(recorded_at) AS cut FROM leases)"
_LAPSED = "lapsed AS (SELECT s.* FROM standing s, cut WHERE revoked_at IS NULL AND floor(date_diff('microsecond', last_renewed, cut) / 1000000.0) >= granted_ttl)"


def _lapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    leases = table(spark, sf_dir, "leases")
    return leasing.expired_at(leasing.standing_leases(leases), F.lit(leases.agg(F.max("recorded_at")).first()[0]).cast("timestamp_ntz"))


@REGISTRY.add("lease_expired_at", _sql(_STANDING, _LAPSED, select="SELECT id, strftime(granted_at, '%Y-%m-%d %H:%M:%S.%f') AS granted_at, granted_ttl FROM lapsed"))
def lease_expired_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases that have run out when the last record was made."""
    return _lapsed(spark, sf_dir).select("id", F.date_format("granted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("granted_at"), "granted_ttl")


@REGISTRY.add("lease_cascade", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), _STANDING, _LAPSED, select="SELECT e.id, n.key, n.revision AS mod_revision FROM (SELECT DISTINCT id, granted_at, unnest(keys) AS key FROM lapsed) e JOIN newest n ON n.key = e.key AND n.op = 'put'"))
def lease_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys that go with them."""
    now = versions.newest(store_log(spark, sf_dir)).where("op = 'put'").select("key", F.col("revision").alias("mod_revision"))
    return leasing.cascade(_lapsed(spark, sf_dir), now)


@REGISTRY.add("lease_ttl", _sql(_STANDING, select="SELECT id, strftime(granted_at, '%Y-%m-%d %H:%M:%S.%f') AS granted_at, greatest(granted_ttl - CAST(floor(date_diff('microsecond', last_renewed, cut) / 1000000.0) AS BIGINT), 0) AS remaining, len(list_distinct(coalesce(keys, []))) AS n_keys FROM standing, cut WHERE revoked_at IS NULL"))
def lease_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds left of every lease that is not revoked, and its keys."""
    leases = table(spark, sf_dir, "leases")
    now = F.lit(leases.agg(F.max("recorded_at")).first()[0]).cast("timestamp_ntz")
    left = F.when(F.col("granted_ttl").isNotNull() & F.col("last_renewed").isNotNull(), leasing.remaining_ttl(F.col("granted_ttl"), F.col("last_renewed"), now)).otherwise(0)
    return leasing.standing_leases(leases).where("revoked_at IS NULL").select("id", F.date_format("granted_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("granted_at"), left.alias("remaining"), F.size("keys").alias("n_keys"))


_REQUESTS = "requests AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY arrived_at) AS rn FROM lease_ops WHERE lease_id <> 0) WHERE rn = 1)"


@REGISTRY.add(
    "lease_gaps",
    _sql(_REQUESTS, """signs AS (SELECT *, row_number() OVER (PARTITION BY lease_id ORDER BY ts, op_id) AS at FROM requests WHERE op IN ('grant', 'keepalive')),
timed AS (SELECT s.*, p.ts AS from_ts, (SELECT arg_max(g.ttl, g.at) FROM signs g WHERE g.lease_id = s.lease_id AND g.op = 'grant' AND g.ttl IS NOT NULL AND g.at < s.at) AS lasts FROM signs s JOIN signs p ON p.lease_id = s.lease_id AND p.at = s.at - 1)""",
         select="SELECT lease_id, strftime(from_ts, '%Y-%m-%d %H:%M:%S.%f') AS from_ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS to_ts, CAST(floor(date_diff('microsecond', from_ts, ts) / 1000000.0) AS BIGINT) AS seconds, lasts AS ttl FROM timed WHERE lasts > 0 AND floor(date_diff('microsecond', from_ts, ts) / 1000000.0) >= lasts"),
)
def lease_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where leases gave no sign of life for their ttl."""
    gaps = leasing.liveness_gaps(leasing.distinct_requests(table(spark, sf_dir, "lease_ops")))
    return gaps.select("lease_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) for c in ("from_ts", "to_ts")), "seconds", "ttl")


#: Requests on each lease folded one after another.
FOLDED = """steps AS (SELECT lease_id, op_id, ts, lower(trim(op)) AS op, ttl, key, row_number() OVER (PARTITION BY lease_id ORDER BY ts, op_id) AS n FROM requests),
folded AS (
  SELECT lease_id, 0::BIGINT AS n, 0::BIGINT AS op_id, '' AS outcome, []::VARCHAR[] AS freed, NULL::BIGINT AS ttl, NULL::TIMESTAMP AS renewed, []::VARCHAR[] AS held FROM (SELECT DISTINCT lease_id FROM steps)
  UNION ALL
  SELECT lease_id, n, op_id, outcome, CASE WHEN outcome = 'revoked' THEN list_sort(held) ELSE [] END,
    CASE outcome WHEN 'granted' THEN asked WHEN 'revoked' THEN NULL ELSE ttl END, CASE WHEN outcome IN ('granted', 'renewed') THEN ts WHEN outcome = 'revoked' THEN NULL ELSE renewed END,
    CASE outcome WHEN 'granted' THEN [] WHEN 'revoked' THEN [] WHEN 'attached' THEN list_append(held, key) WHEN 'detached' THEN list_filter(held, lambda k: k <> key) ELSE held END
  FROM (SELECT s.lease_id, s.n, s.op_id, s.ts, s.key, s.ttl AS asked, f.ttl, f.renewed, f.held, CASE
      WHEN s.op = 'grant' THEN CASE WHEN f.ttl IS NOT NULL THEN 'exists' WHEN coalesce(s.ttl, 0) <= 0 THEN 'invalid' ELSE 'granted' END WHEN f.ttl IS NULL THEN 'not found'
      WHEN s.op = 'keepalive' THEN CASE WHEN date_diff('microsecond', f.renewed, s.ts) >= f.ttl * 1000000 THEN 'expired' ELSE 'renewed' END
      WHEN s.op = 'attach' THEN CASE WHEN s.key IS NULL OR list_contains(f.held, s.key) THEN 'ignored' ELSE 'attached' END
      WHEN s.op = 'detach' THEN CASE WHEN coalesce(list_contains(f.held, s.key), false) THEN 'detached' ELSE 'ignored' END WHEN s.op = 'revoke' THEN 'revoked' ELSE 'ignored' END AS outcome
    FROM folded f JOIN steps s ON s.lease_id = f.lease_id AND s.n = f.n + 1))"""


@REGISTRY.add("lease_outcomes", "WITH RECURSIVE " + _REQUESTS + ",\n" + FOLDED + "\nSELECT lease_id, op_id, outcome, array_to_string(freed, ',') AS freed FROM folded WHERE n > 0")
def lease_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of every lease request, folded in order, and the keys it sets free."""
    found = leasing.lease_outcomes(leasing.distinct_requests(table(spark, sf_dir, "lease_ops")))
    return found.select("lease_id", "op_id", "outcome", F.array_join("keys", ",").alias("freed"))


@REGISTRY.add("lease_attachments", "WITH RECURSIVE " + _REQUESTS + ",\n" + FOLDED + "\nSELECT lease_id, unnest(held) AS key FROM (SELECT lease_id, arg_max(held, n) AS held FROM folded GROUP BY lease_id)")
def lease_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys attached to leases after all requests."""
    requests = leasing.distinct_requests(table(spark, sf_dir, "lease_ops"))
    return leasing.attachments_left(leasing.lease_outcomes(requests), requests)


@REGISTRY.add("active_counts", _sql(_STANDING, select="SELECT (SELECT count(*) FROM standing WHERE revoked_at IS NULL) AS leases, (SELECT count(*) FROM watchers) AS watchers, (SELECT count(DISTINCT history_id) FROM ops) AS histories"))
def active_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standing leases, watchers and histories."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [count(leasing.standing_leases(table(spark, sf_dir, "leases")).where("revoked_at IS NULL"), "leases"), count(table(spark, sf_dir, "watchers"), "watchers"), table(spark, sf_dir, "ops").agg(F.count_distinct("history_id").alias("histories"))]
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # a row each
