"""Queries on replicated logs, histories, simulated faults, metrics and formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import codecs
from keytide.operators import applying, audit, consensus, leasing, runs
from keytide.plans.kv import _RUNS, _sql
from keytide.plans.registry import Registry
from keytide.session import materialize
from keytide.sources.fixtures import COMMAND_LOG_SQL, REPLICATED_LOG_SQL, STORE_LOG_SQL, command_log, event_sizes, replicated_log, store_log
from keytide.sources.tables import table

REGISTRY = Registry()
_N = "nn AS (SELECT count(*) AS n FROM events)"
_ACKS = "acks AS (SELECT r_regionkey AS node_id, n - (r_regionkey * r_regionkey * (n // 16)) % (n // 5 * 2) AS match_index FROM region, nn)"


def _acks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    n, _ = event_sizes(spark, sf_dir)
    return table(spark, sf_dir, "region").selectExpr("cast(r_regionkey AS bigint) AS node_id", f"{n} - (r_regionkey * r_regionkey * ({n} div 16)) % ({n} div 5 * 2) AS match_index"), n


def _members(spark: SparkSession, **configs: range) -> DataFrame:
    return spark.createDataFrame([(name, i) for name, ids in configs.items() for i in ids], "config string, node_id long")


def _commit_sql(quorums: str) -> str:
    return _sql(_N, _ACKS, REPLICATED_LOG_SQL, select=f"SELECT coalesce(max(c.match_index), 0) AS commit_index FROM acks c JOIN replog l ON l.log_index = c.match_index AND l.term = 4 WHERE {quorums}")


def _reached(below: int) -> str:
    return f"(SELECT count(*) FROM acks a WHERE a.node_id < {below} AND a.match_index >= c.match_index) >= {below // 2 + 1}"


@REGISTRY.add("commit_index", _commit_sql(_reached(5)))
def commit_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the log is committed."""
    acks, _ = _acks(spark, sf_dir)
    return consensus.commit_index(acks, _members(spark, now=range(5)), replicated_log(spark, sf_dir), 4, 0)


@REGISTRY.add("commit_index_joint", _commit_sql(f"{_reached(5)} AND {_reached(3)}"))
def commit_index_joint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while the members change from three to five."""
    acks, _ = _acks(spark, sf_dir)
    return consensus.commit_index(acks, _members(spark, old=range(3), new=range(5)), replicated_log(spark, sf_dir), 4, 0)


_BALLOTS = "ballots AS (SELECT event_id // 6 AS ballot, (event_id * 7 + event_id // 6) % 6 AS node_id FROM events WHERE event_type IN ('view', 'click'))"


@REGISTRY.add(
    "vote_tally",
    _sql(_BALLOTS, select="SELECT ballot, count(DISTINCT node_id) AS votes, count(DISTINCT node_id) FILTER (node_id < 3) >= 2 AND count(DISTINCT node_id) FILTER (node_id < 5) >= 3 AS quorum FROM ballots GROUP BY ballot"),
)
def vote_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which ballots have a majority in both configurations."""
    ballots = table(spark, sf_dir, "events").where("event_type IN ('view', 'click')").selectExpr("event_id div 6 AS ballot", "(event_id * 7 + event_id div 6) % 6 AS node_id")
    return consensus.has_quorum(ballots, _members(spark, old=range(3), new=range(5)))


_VOTERS = "voters AS (SELECT CAST(n_nationkey AS BIGINT) AS voter_id, 3 + n_nationkey % 3 AS my_term, CASE WHEN n_nationkey % 4 > 0 THEN CAST(n_nationkey % 7 AS BIGINT) END AS voted_for, 2 + n_nationkey % 3 AS my_last_term, n_nationkey * 100 AS my_last_index FROM nation)"
_ASKED = "asked AS (SELECT c_custkey % 7 AS candidate_id, c_custkey % 25 AS voter_id, 2 + c_custkey % 5 AS term, 2 + c_custkey % 4 AS last_term, c_custkey % 2500 AS last_index FROM customer)"


@REGISTRY.add("vote_grants", _sql(_VOTERS, _ASKED, select="""SELECT candidate_id, v.voter_id, term >= my_term AND (term > my_term OR voted_for IS NULL OR voted_for = candidate_id) AND (last_term > my_last_term OR (last_term = my_last_term AND last_index >= my_last_index)) AS vote,
 term > my_term AND (last_term > my_last_term OR (last_term = my_last_term AND last_index >= my_last_index)) AS pre_vote FROM asked a JOIN voters v ON v.voter_id = a.voter_id"""))
def vote_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes and pre-votes that are granted."""
    voters = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS voter_id", "3 + n_nationkey % 3 AS my_term", "if(n_nationkey % 4 > 0, cast(n_nationkey % 7 AS bigint), NULL) AS voted_for", "cast(2 + n_nationkey % 3 AS bigint) AS my_last_term", "cast(n_nationkey * 100 AS bigint) AS my_last_index")
    asked = table(spark, sf_dir, "customer").selectExpr("c_custkey % 7 AS candidate_id", "c_custkey % 25 AS voter_id", "2 + c_custkey % 5 AS term", "2 + c_custkey % 4 AS last_term", "c_custkey % 2500 AS last_index")
    return consensus.votes_granted(asked, voters)


_FOLLOWER = "follower AS (SELECT log_index, CASE WHEN log_index > n * 3 // 4 THEN term - 1 ELSE term END AS term FROM replog, rn WHERE log_index <= n * 9 // 10)"


def _follower(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, _ = event_sizes(spark, sf_dir)
    return replicated_log(spark, sf_dir).where(F.col("log_index") <= n * 9 // 10).select("log_index", (F.col("term") - (F.col("log_index") > n * 3 // 4).cast("int")).alias("term"))


@REGISTRY.add("log_conflict", _sql(REPLICATED_LOG_SQL, _FOLLOWER, select="SELECT (SELECT min(f.log_index) FROM follower f JOIN replog l ON l.log_index = f.log_index AND l.term <> f.term) AS conflict_index, (SELECT max(log_index) FROM follower) AS follower_last, (SELECT max(log_index) FROM replog) AS leader_last"))
def log_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a follower's log departs from the leader's."""
    return consensus.first_conflict(replicated_log(spark, sf_dir), _follower(spark, sf_dir))


@REGISTRY.add("log_after_append", _sql(REPLICATED_LOG_SQL, select="SELECT log_index, term FROM replog"))
def log_after_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The follower's log once it has taken the leader's entries."""
    return consensus.appended(replicated_log(spark, sf_dir), _follower(spark, sf_dir))


@REGISTRY.add("replication_lag", _sql(_N, _ACKS, select="SELECT node_id, match_index, match_index + 1 AS next_index, n - match_index AS lag, match_index + 1 <= n * 4 // 5 AS needs_snapshot FROM acks, nn"))
def replication_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the nodes are behind."""
    acks, n = _acks(spark, sf_dir)
    return consensus.replication_lag(acks, n, n * 4 // 5)


_RESPONSES = "responses AS (SELECT user_id AS node_id, event_id AS seen, event_type <> 'error' AS success, event_id AS match_index FROM events)"


@REGISTRY.add("append_responses", _sql(_RESPONSES, select="SELECT node_id, greatest(coalesce(max(match_index) FILTER (success) + 1, 1) - count(*) FILTER (NOT success AND seen > coalesce(ok, -1)), 1) AS next_index, coalesce(max(match_index) FILTER (success), 0) AS match_index FROM (SELECT *, max(seen) FILTER (success) OVER (PARTITION BY node_id) AS ok FROM responses) GROUP BY node_id"))
def append_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of each node after its responses."""
    responses = table(spark, sf_dir, "events").selectExpr("user_id AS node_id", "event_id AS at", "event_type <> 'error' AS success", "event_id AS match_index")
    state = responses.select("node_id", F.lit(1).cast("long").alias("next_index"), F.lit(0).cast("long").alias("match_index")).distinct()
    return consensus.after_responses(state, responses)


_READS = "asked AS (SELECT event_id // 7 AS request_id, min(event_id) AS read_index FROM events GROUP BY ALL), answers AS (SELECT event_id // 7 AS request_id, event_id * 3 % 5 AS node_id FROM events WHERE event_type IN ('view', 'click', 'signup'))"


@REGISTRY.add("read_fresh", _sql(_N, _READS, select="SELECT a.request_id, count(DISTINCT node_id) AS acks, count(DISTINCT node_id) >= 3 AS confirmed, count(DISTINCT node_id) >= 3 AND any_value(read_index) <= any_value(n) * 9 // 10 AS ready FROM asked a CROSS JOIN nn LEFT JOIN answers r ON r.request_id = a.request_id GROUP BY a.request_id"))
def read_fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which reads may be served."""
    events = table(spark, sf_dir, "events")
    n, _ = event_sizes(spark, sf_dir)
    asked = events.groupBy(F.expr("event_id div 7").alias("request_id")).agg(F.min("event_id").alias("read_index"))
    answers = events.where("event_type IN ('view', 'click', 'signup')").selectExpr("event_id div 7 AS request_id", "event_id * 3 % 5 AS node_id")
    return consensus.reads_ready(asked, answers, 5, n * 9 // 10)


@REGISTRY.add("transfer_checks", _sql(_N, _ACKS, select="""SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 4 = 3 THEN 'NotLeader' WHEN o_custkey % 7 = 0 THEN 'AlreadyLeader' WHEN o_orderkey % 11 = 0 THEN 'InProgress'
 WHEN a.node_id IS NULL THEN 'NotInCluster' WHEN match_index >= n * 15 // 16 THEN 'TimeoutNow' ELSE 'Waiting' END AS verdict FROM orders CROSS JOIN nn LEFT JOIN acks a ON a.node_id = o_custkey % 7"""))
def transfer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on requests to hand over leadership."""
    acks, n = _acks(spark, sf_dir)
    asked = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", "if(o_custkey % 4 = 3, 1, 0) AS node_id", "o_custkey % 7 AS target_id", "o_orderkey % 11 = 0 AS in_progress")
    return consensus.transfer_checks(asked, acks, 0, n * 15 // 16)


@REGISTRY.add("log_compacted", _sql(REPLICATED_LOG_SQL, select="SELECT term, count(*) AS entries, min(log_index) AS first_index, max(log_index) AS last_index FROM replog, rn WHERE log_index > n * 4 // 5 GROUP BY term"))
def log_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the log is left after a snapshot, by term."""
    n, _ = event_sizes(spark, sf_dir)
    return consensus.log_after_snapshot(replicated_log(spark, sf_dir), n * 4 // 5).groupBy("term").agg(F.count("*").alias("entries"), F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"))


_NORMAL = "normal AS (SELECT * FROM replog, (SELECT n * 9 // 10 AS committed FROM rn) WHERE entry_type = 'Normal' AND log_index <= committed)"


@REGISTRY.add("apply_commands", _sql(REPLICATED_LOG_SQL, _NORMAL, select="""SELECT log_index, CASE event_type WHEN 'error' THEN 'Delete' WHEN 'signup' THEN 'LeaseGrant' ELSE 'Put' END AS type, CASE WHEN event_type <> 'signup' THEN CAST(user_id AS VARCHAR) END AS key, CASE WHEN event_type NOT IN ('signup', 'error') THEN event_type END AS value,
 CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN user_id WHEN 'purchase' THEN user_id ELSE 0 END AS lease_id, CASE event_type WHEN 'signup' THEN 60 + event_id % 60 WHEN 'error' THEN NULL ELSE 0 END AS ttl FROM normal WHERE event_id % 101 <> 100"""))
def apply_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of the committed commands."""
    n, _ = event_sizes(spark, sf_dir)
    return applying.read_commands(replicated_log(spark, sf_dir), n * 9 // 10)[0]


@REGISTRY.add("apply_quarantine", _sql(REPLICATED_LOG_SQL, _NORMAL, select="SELECT log_index, '{broken' AS data FROM normal WHERE event_id % 101 = 100"))
def apply_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed commands that cannot be read."""
    n, _ = event_sizes(spark, sf_dir)
    return applying.read_commands(replicated_log(spark, sf_dir), n * 9 // 10)[1]


#: What revokes delete, as a fold over the commands that can matter to each key: its puts and deletes, and revokes of leases it was put with.
_REVOKED = """turns AS (SELECT * FROM (SELECT lease_id, log_index, type, lag(type) OVER (PARTITION BY lease_id ORDER BY log_index) AS before FROM cmds WHERE type = 'LeaseRevoke' OR (type = 'LeaseGrant' AND ttl > 0)) WHERE type <> coalesce(before, 'LeaseRevoke')),
lives AS (SELECT lease_id, log_index AS born, lead(log_index, 1, 9000000000) OVER (PARTITION BY lease_id ORDER BY log_index) AS ended, type FROM turns),
pairs AS (SELECT DISTINCT key, lease_id FROM cmds WHERE type = 'Put' AND lease_id > 0),
steps AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY log_index) AS n FROM (
  SELECT c.key, c.log_index, c.type, c.lease_id, l.born IS NOT NULL AS alive FROM cmds c LEFT JOIN lives l ON l.type = 'LeaseGrant' AND l.lease_id = c.lease_id AND c.log_index BETWEEN l.born AND l.ended WHERE c.type IN ('Put', 'Delete')
  UNION ALL SELECT p.key, l.ended, 'LeaseRevoke', p.lease_id, true FROM lives l JOIN pairs p ON p.lease_id = l.lease_id WHERE l.type = 'LeaseGrant' AND l.ended < 9000000000)),
fold AS (
  SELECT key, 0::BIGINT AS n, 0::BIGINT AS log_index, '' AS type, 0::BIGINT AS lease_id, 0::BIGINT AS holds, []::BIGINT[] AS hangs, false AS cut FROM (SELECT DISTINCT key FROM steps)
  UNION ALL
  SELECT s.key, s.n, s.log_index, s.type, s.lease_id,
    CASE WHEN s.type = 'Put' THEN s.lease_id WHEN s.type = 'Delete' OR list_contains(f.hangs, s.lease_id) THEN 0 ELSE f.holds END,
    CASE WHEN s.type = 'Put' THEN CASE WHEN s.alive AND s.lease_id > 0 AND NOT list_contains(f.hangs, s.lease_id) THEN list_append(f.hangs, s.lease_id) ELSE f.hangs END
      WHEN s.type = 'Delete' THEN list_filter(f.hangs, lambda x: x <> f.holds) ELSE list_filter(f.hangs, lambda x: x <> s.lease_id) END,
    s.type = 'LeaseRevoke' AND list_contains(f.hangs, s.lease_id)
  FROM fold f JOIN steps s ON s.key = f.key AND s.n = f.n + 1),
revoked AS (SELECT log_index, lease_id, key FROM fold WHERE cut)"""


def _recursive(*parts: str, select: str) -> str:
    return _sql(*parts, select=select).replace("WITH ", "WITH RECURSIVE ", 1)


@REGISTRY.add("apply_revoke", _recursive(COMMAND_LOG_SQL, _REVOKED, select="SELECT log_index, lease_id, key FROM revoked"))
def apply_revoke(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the revokes among the committed commands delete."""
    n, _ = event_sizes(spark, sf_dir)
    return applying.revoked_keys(materialize(applying.read_commands(command_log(spark, sf_dir), n * 9 // 10)[0], "commands"))


@REGISTRY.add(
    "apply_events",
    _recursive(COMMAND_LOG_SQL, _REVOKED, """told AS (SELECT log_index, CASE WHEN type = 'Put' THEN 0 ELSE 1 END AS event_type, key, CASE WHEN type = 'Put' THEN value END AS value, CASE WHEN type = 'Put' THEN lease_id ELSE 0 END AS lease_id, CASE WHEN type = 'Put' THEN ttl ELSE 0 END AS ttl_seconds, true AS own FROM cmds WHERE type IN ('Put', 'Delete')
 UNION ALL SELECT log_index, 1, key, NULL, 0, 0, false FROM revoked)""", select="SELECT log_index, event_type, key, coalesce(value, '') AS value, lease_id, ttl_seconds, CASE WHEN own THEN lag(value) OVER (PARTITION BY key ORDER BY log_index) END AS prev_value FROM told"),
)
def apply_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of applying the committed commands."""
    n, _ = event_sizes(spark, sf_dir)
    return applying.applied_events(command_log(spark, sf_dir), n * 9 // 10)


@REGISTRY.add("apply_count", "SELECT count(*) AS applied FROM events, (SELECT count(*) AS n FROM events) WHERE event_id + 1 <= n * 9 // 10 AND ((event_id + 1) % 997 = 0 OR event_id % 101 <> 100)")
def apply_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many committed entries count as applied."""
    n, _ = event_sizes(spark, sf_dir)
    return applying.applied_count(command_log(spark, sf_dir), n * 9 // 10)


@REGISTRY.add("status_row", _sql(_N, _ACKS, REPLICATED_LOG_SQL, select="SELECT max(log_index) AS last_index, max(term) AS term, arg_max(term, log_index) AS last_term, count(*) FILTER (entry_type = 'Noop') AS elections, count(*) AS entries FROM replog"))
def status_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of a log in one row."""
    return replicated_log(spark, sf_dir).agg(F.max("log_index").alias("last_index"), F.max("term").alias("term"), F.max_by("term", "log_index").alias("last_term"), F.count_if(F.col("entry_type") == "Noop").alias("elections"), F.count("*").alias("entries"))


_OPS = "hist AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY op_id ORDER BY recorded_at) AS rn FROM ops) WHERE rn = 1)"
_STALE = """done AS (SELECT *, row_number() OVER (PARTITION BY history_id, key ORDER BY end_time, op_id) AS at FROM hist WHERE result = 'Ok' AND key IS NOT NULL AND end_time IS NOT NULL),
looked AS (SELECT r.*, w.value AS expected, w.at AS w_at FROM (SELECT * FROM done WHERE op_type = 'Read') r ASOF JOIN (SELECT * FROM done WHERE op_type = 'Write') w ON r.history_id = w.history_id AND r.key = w.key AND r.at > w.at),
stale AS (SELECT history_id, op_id, key, value, expected, end_time FROM looked WHERE value IS DISTINCT FROM expected)"""


@REGISTRY.add("stale_reads", _sql(_OPS, _STALE, select="SELECT history_id, op_id, key, value, expected FROM stale"))
def stale_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that give another value than the newest write."""
    return audit.stale_reads(audit.distinct_operations(table(spark, sf_dir, "ops")))


@REGISTRY.add("first_violation", _sql(_OPS, _STALE, select="SELECT history_id, arg_min(op_id, (end_time, op_id)) AS op_id FROM stale GROUP BY history_id"))
def first_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first such read of every history."""
    ops = audit.distinct_operations(table(spark, sf_dir, "ops"))
    return audit.first_violations(audit.stale_reads(ops), ops)


@REGISTRY.add("op_outcomes", _sql(_OPS, select="SELECT history_id, op_type, count(*) AS operations, count(*) FILTER (result = 'Ok') AS succeeded, count(*) FILTER (result <> 'Ok') AS failed, count(*) FILTER (result IS NULL) AS open FROM hist GROUP BY ALL"))
def op_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of the operations of each history."""
    return audit.outcome_counts(audit.distinct_operations(table(spark, sf_dir, "ops")))


@REGISTRY.add("reachable", "SELECT DISTINCT c_custkey % 25 AS from_id, c_nationkey::BIGINT AS to_id FROM customer WHERE (c_custkey % 25 * 7 + c_nationkey * 3) % 11 <> 0")
def reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between nodes that no partition cuts."""
    edges = table(spark, sf_dir, "customer").selectExpr("c_custkey % 25 AS from_id", "cast(c_nationkey AS bigint) AS to_id").distinct()
    return audit.deliverable(edges, edges.where("(from_id * 7 + to_id * 3) % 11 = 0"))


_DRAW = "(('0x' || substr(md5('{seed}:' || message_id), 1, 8))::BIGINT / 4294967296.0)"


@REGISTRY.add("delivery_simulation", f"SELECT message_id, from_id, to_id, 5 + floor({_DRAW.format(seed=1)} * 46)::BIGINT AS delay_ms FROM (SELECT o_orderkey AS message_id, o_custkey % 5 AS from_id, o_orderkey % 5 AS to_id FROM orders) WHERE NOT ((from_id = 0 AND to_id = 1) OR (from_id = 1 AND to_id = 0)) AND {_DRAW.format(seed=0)} >= 0.25")
def delivery_simulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a simulated network with losses, delays and partitions delivers."""
    sent = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS message_id", "o_custkey % 5 AS from_id", "o_orderkey % 5 AS to_id")
    cut = spark.createDataFrame([(0, 1), (1, 0)], "from_id long, to_id long")
    return audit.simulate_delivery(sent, cut, 0.25, 5, 50).select("message_id", "from_id", "to_id", "delay_ms")


@REGISTRY.add("corrupt_reads", "SELECT l_partkey * 100 + l_linenumber * 9 AS \"offset\", 10::BIGINT AS size, count(DISTINCT p_partkey) AS ranges FROM lineitem JOIN part ON p_partkey BETWEEN l_partkey - 1 AND l_partkey + 1 AND l_partkey * 100 + l_linenumber * 9 < p_partkey * 100 + p_size AND l_partkey * 100 + l_linenumber * 9 + 10 > p_partkey * 100 GROUP BY ALL")
def corrupt_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that meet damaged ranges of a disk."""
    reads = table(spark, sf_dir, "lineitem").selectExpr("l_partkey * 100 + l_linenumber * 9 AS offset", "10L AS size")
    return audit.touched_ranges(reads, table(spark, sf_dir, "part").selectExpr("p_partkey * 100 AS offset", "cast(p_size AS bigint) AS size"), 512)


@REGISTRY.add(
    "disk_capacity",
    """WITH RECURSIVE w AS (SELECT o_custkey % 100 AS disk_id, o_orderkey AS "at", o_totalprice::DECIMAL(18, 2)::BIGINT AS size, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS n FROM (SELECT o_custkey, o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)),
f AS (SELECT DISTINCT disk_id, 0::BIGINT AS "at", 0::BIGINT AS size, 0::BIGINT AS n, 0::BIGINT AS used, false AS taken FROM w
  UNION ALL SELECT w.disk_id, w."at", w.size, w.n, CASE WHEN f.used + w.size <= 2000000 THEN f.used + w.size ELSE f.used END, f.used + w.size <= 2000000 FROM f JOIN w ON w.disk_id = f.disk_id AND w.n = f.n + 1)
SELECT disk_id, "at", size, used, taken FROM f WHERE n > 0""",
)
def disk_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes that a full disk takes or refuses."""
    return audit.fill_disk(table(spark, sf_dir, "orders").selectExpr("o_custkey % 100 AS disk_id", "o_orderkey AS at", "cast(o_totalprice AS bigint) AS size"), 2_000_000)


@REGISTRY.add("clock_skew", "SELECT event_id, strftime(CASE WHEN user_id % 9 = 0 THEN TIMESTAMP '2024-01-15' ELSE ts + to_milliseconds(user_id % 7 * 250 - 500) END, '%Y-%m-%d %H:%M:%S.%f') AS shown FROM events")
def clock_skew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What skewed and frozen clocks show."""
    frozen = F.when(F.col("user_id") % 9 == 0, F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(audit.skewed_clock(F.col("ts"), (F.col("user_id") % 7 * 250 - 500).cast("decimal(18,6)"), frozen), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("shown"))


@REGISTRY.add("backoff", "SELECT n_nationkey % 5 AS attempt, max(100 * power(2, n_nationkey % 5))::BIGINT AS wait_ms FROM nation GROUP BY ALL")
def backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits before retries."""
    return table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 5).alias("attempt")).distinct().withColumn("wait_ms", audit.backoff_ms(F.col("attempt")))


@REGISTRY.add(
    "op_histogram",
    "SELECT l_returnflag AS op, le, count(*) FILTER (le = '+Inf' OR l_orderkey % 1000 / 1000.0 <= TRY_CAST(le AS DOUBLE)) AS n FROM lineitem, (SELECT unnest(['0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1.0', '2.5', '5.0', '10.0', '+Inf']) AS le) GROUP BY ALL",
)
def op_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency histogram by operation."""
    samples = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("op"), (F.col("l_orderkey") % 1000 / 1000.0).alias("seconds"))
    return audit.histogram(samples, "seconds", ["op"])


_COUNTS = "counts AS (SELECT op, count(*) AS n FROM log GROUP BY op)"


@REGISTRY.add("op_counts", _sql(STORE_LOG_SQL, _COUNTS, select="SELECT op, n FROM counts"))
def op_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled counters of changes."""
    return store_log(spark, sf_dir).groupBy("op").agg(F.count("*").alias("n"))


@REGISTRY.add("metrics_text", _sql(STORE_LOG_SQL, _COUNTS, select="SELECT 'kv_ops_total{op=\"' || op || '\"} ' || n AS line FROM counts"))
def metrics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters as text."""
    return audit.exposition(op_counts(spark, sf_dir).select(F.lit("kv_ops_total").alias("name"), F.lit("op").alias("label"), F.col("op").alias("label_value"), F.col("n").alias("value")))


_GAUGES = """standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, granted_at ORDER BY recorded_at DESC) AS rn FROM leases WHERE id IS NOT NULL AND granted_at IS NOT NULL) WHERE rn = 1)"""


@REGISTRY.add(
    "store_metrics",
    _sql(STORE_LOG_SQL, REPLICATED_LOG_SQL, _RUNS, _GAUGES, select="""SELECT name || ' ' || value AS line FROM (
 SELECT 'log_term' AS name, max(term)::BIGINT AS value FROM replog UNION ALL SELECT 'log_last_index', max(log_index)::BIGINT FROM replog UNION ALL SELECT 'log_elections_total', count(*) FROM replog WHERE entry_type = 'Noop'
 UNION ALL SELECT 'log_proposals_total', count(*) FROM replog WHERE entry_type = 'Normal' UNION ALL SELECT 'log_config_changes_total', count(*) FROM replog WHERE entry_type = 'ConfigChange'
 UNION ALL SELECT 'storage_sstable_count', count(*) FROM stats UNION ALL SELECT 'storage_entries', sum(entries)::BIGINT FROM stats UNION ALL SELECT 'storage_bytes', sum(bytes)::BIGINT FROM stats UNION ALL SELECT 'storage_compaction_pending', (count(*) >= 4)::INT::BIGINT FROM stats WHERE level = 0
 UNION ALL SELECT 'lease_active', count(*) FROM standing WHERE revoked_at IS NULL UNION ALL SELECT 'lease_grants_total', count(*) FROM standing UNION ALL SELECT 'lease_revokes_total', count(*) FROM standing WHERE revoked_at IS NOT NULL
 UNION ALL SELECT 'watch_active', count(*) FROM watchers UNION ALL SELECT 'watch_events_published', count(*) FROM log UNION ALL SELECT 'kv_puts_total', count(*) FROM log WHERE op = 'put' UNION ALL SELECT 'kv_deletes_total', count(*) FROM log WHERE op = 'delete')"""),
)
def store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauges and counters of the log, the runs, leases and watchers, as lines of text."""
    log, replicated = store_log(spark, sf_dir), replicated_log(spark, sf_dir)
    kind = lambda k: F.count_if(F.col("entry_type") == k)
    standing = leasing.standing_leases(table(spark, sf_dir, "leases"))
    rows = [
        replicated.agg(F.max("term").alias("log_term"), F.max("log_index").alias("log_last_index"), kind("Noop").alias("log_elections_total"), kind("Normal").alias("log_proposals_total"), kind("ConfigChange").alias("log_config_changes_total")),
        runs.run_statistics(runs.cut_runs(log)).agg(F.count("*").alias("storage_sstable_count"), F.sum("entries").alias("storage_entries"), F.sum("bytes").alias("storage_bytes"), (F.count_if(F.col("level") == 0) >= 4).cast("int").alias("storage_compaction_pending")),
        standing.agg(F.count_if(F.col("revoked_at").isNull()).alias("lease_active"), F.count("*").alias("lease_grants_total"), F.count_if(F.col("revoked_at").isNotNull()).alias("lease_revokes_total")),
        table(spark, sf_dir, "watchers").agg(F.count("*").alias("watch_active")),
        log.agg(F.count("*").alias("watch_events_published"), F.count_if(F.col("op") == "put").alias("kv_puts_total"), F.count_if(F.col("op") == "delete").alias("kv_deletes_total")),
    ]
    lines = [row.select(F.explode(F.array(*(F.concat(F.lit(c + " "), F.col(c).cast("string")) for c in row.columns))).alias("line")) for row in rows]
    return reduce(DataFrame.unionByName, lines)


@REGISTRY.add("key_codec", _sql(STORE_LOG_SQL, select="SELECT key, revision, seq, hex(encode(key) || unhex(lpad(to_hex(18446744073709551615::UBIGINT - revision::UBIGINT), 16, '0'))) AS encoded, key AS back_key, revision AS back_revision FROM log"))
def key_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded keys, and back."""
    rows = store_log(spark, sf_dir).select("key", "revision", "seq", codecs.encode_key(F.col("key"), F.col("revision")).alias("raw")).withColumn("back", codecs.decode_key(F.col("raw")))
    return rows.select("key", "revision", "seq", F.hex("raw").alias("encoded"), F.col("back.key").alias("back_key"), F.col("back.revision").alias("back_revision"))


_OR_EMPTY = "coalesce(value, '')"


#: The bytes of an integer, lowest first, and of a sized text, in SQL.
def _le(n: str, size: int = 8) -> str:
    digits = f"lpad(to_hex(({n})::BIGINT), 16, '0')"
    return "upper(" + " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(size)) + ")"


def _sized(text: str) -> str:
    return f"{_le(f'strlen({text})', 4)} || hex(encode({text}))"


@REGISTRY.add("value_codec", _sql(STORE_LOG_SQL, select=f"SELECT revision, seq, CASE WHEN value IS NULL THEN '02' ELSE '01' || {_sized('value')} END || {_le('1')} || {_le('revision')} || {_le('lease_id')} || {_le('ttl_seconds')} AS encoded, value, revision AS mod_revision, lease_id, ttl_seconds AS ttl FROM log"))
def value_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned values, encoded and back."""
    raw = codecs.encode_value(F.col("value"), F.lit(1), F.col("revision"), F.col("lease_id"), F.col("ttl_seconds"))
    return store_log(spark, sf_dir).select("revision", "seq", raw.alias("raw")).select("revision", "seq", F.hex("raw").alias("encoded"), codecs.decode_value(F.col("raw")).alias("v")).select("revision", "seq", "encoded", "v.value", "v.mod_revision", "v.lease_id", "v.ttl")


@REGISTRY.add("wal_op_codec", _sql(STORE_LOG_SQL, select=f"SELECT revision, seq, CASE op WHEN 'put' THEN '01' || {_sized('key')} || {_sized(_OR_EMPTY)} ELSE '02' || {_sized('key')} END AS encoded, op, key, CASE WHEN op = 'put' THEN coalesce(value, '') END AS value FROM log"))
def wal_op_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged writes, encoded and back."""
    raw = codecs.encode_wal_op(F.col("op"), F.col("key"), F.coalesce("value", F.lit("")))
    return store_log(spark, sf_dir).select("revision", "seq", raw.alias("raw")).select("revision", "seq", F.hex("raw").alias("encoded"), codecs.decode_wal_op(F.col("raw")).alias("w")).select("revision", "seq", "encoded", "w.op", "w.key", "w.value")


_DATA = """CASE WHEN event_id % 101 = 100 THEN '{broken' WHEN event_type = 'error' THEN '{"type":"Delete","key":"' || user_id || '"}' WHEN event_type = 'signup' THEN '{"type":"LeaseGrant","id":' || user_id || ',"ttl":' || (60 + event_id % 60) || '}'
 ELSE '{"type":"Put","key":"' || user_id || '","value":"' || event_type || '","lease_id":' || CASE WHEN event_type = 'purchase' THEN user_id ELSE 0 END || '}' END"""


@REGISTRY.add("entry_codec", _sql(REPLICATED_LOG_SQL, f"held AS (SELECT *, {_DATA} AS data FROM replog)", select=f"SELECT {_le('log_index')} || {_le('term')} || CASE entry_type WHEN 'Normal' THEN '00' WHEN 'ConfigChange' THEN '01' ELSE '02' END || {_sized('data')} AS encoded, log_index, term, entry_type, data FROM held"))
def entry_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the replicated log, their bytes, and back."""
    raw = codecs.encode_entry(*(F.col(c) for c in ("log_index", "term", "entry_type", "data")))
    return replicated_log(spark, sf_dir).select(raw.alias("raw")).select(F.hex("raw").alias("encoded"), codecs.decode_entry(F.col("raw")).alias("e")).select("encoded", "e.*")


@REGISTRY.add("footer_codec", f"SELECT {_le('p_partkey')} || {_le('p_size')} || {_le('p_partkey + p_size')} || {_le('p_size * 2')} || {_le('p_size % 9', 4)} || {_le(str(codecs.FOOTER_MAGIC), 4)} AS encoded, p_partkey AS index_offset, p_size::BIGINT AS index_size, p_partkey + p_size AS bloom_offset, p_size * 2::BIGINT AS bloom_size, p_size % 9::BIGINT AS hashes FROM part")
def footer_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers of runs, their bytes, and back."""
    size = F.col("p_size").cast("long")
    raw = codecs.encode_footer(F.col("p_partkey"), size, F.col("p_partkey") + size, size * 2, size % 9)
    return table(spark, sf_dir, "part").select(raw.alias("raw")).select(F.hex("raw").alias("encoded"), codecs.decode_footer(F.col("raw")).alias("f")).select("encoded", "f.*")


@REGISTRY.add("command_json", _sql(STORE_LOG_SQL, select="SELECT revision, seq, CASE op WHEN 'put' THEN 'Put' ELSE 'Delete' END AS type, key, value FROM log"))
def command_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands as JSON, and back."""
    kind = F.when(F.col("op") == "put", "Put").otherwise("Delete")
    text = F.to_json(F.struct(kind.alias("type"), "key", "value", F.col("lease_id").alias("lease_id")))
    return store_log(spark, sf_dir).select("revision", "seq", F.from_json(text, codecs.COMMAND).alias("c")).select("revision", "seq", "c.type", "c.key", "c.value")


@REGISTRY.add("leader_hint", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey::BIGINT END AS leader FROM nation")
def leader_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders named in refusals."""
    message = F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("not leader, leader is Some("), F.col("n_nationkey").cast("string"), F.lit(")"))).otherwise("not leader, leader is None")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), codecs.leader_hint(message).alias("leader"))


@REGISTRY.add("peers_parse", "SELECT n_nationkey AS row_id, p.id::BIGINT AS id, p.address FROM nation, (SELECT unnest([{'id': 0, 'address': 'a'}, {'id': 1, 'address': 'b:1'}]) AS p) UNION ALL SELECT n_nationkey, 100 + n_nationkey::BIGINT, n_name FROM nation")
def peers_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of peers, taken apart."""
    text = F.concat(F.lit("0=x, 1 = b:1,bad,x=addr,0=a,"), (F.col("n_nationkey") + 100).cast("string"), F.lit("="), F.col("n_name"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_id"), F.explode(codecs.parse_peers(text)).alias("id", "address"))


@REGISTRY.add("block_codec", _sql(STORE_LOG_SQL, select="SELECT revision, seq, key, value FROM log"))
def block_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of the log, encoded in blocks of several entries and back."""
    return runs.entries_of_blocks(runs.blocks(store_log(spark, sf_dir)))


@REGISTRY.add("election_timeouts", "SELECT o_orderkey, 150 + ('0x' || substr(md5('3:' || o_custkey || ':' || o_orderkey), 1, 8))::BIGINT % 151 AS ms FROM orders")
def election_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn timeouts of nodes in their terms."""
    return table(spark, sf_dir, "orders").select("o_orderkey", codecs.election_timeout(150, 300, 3, "o_custkey", "o_orderkey").alias("ms"))


@REGISTRY.add("joint_json", "SELECT n_nationkey AS id, n_nationkey % 3 + 1 AS old_members, 2 AS new_members, 'addr-' || n_name AS first_address FROM nation")
def joint_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint configurations as JSON, and back."""
    member = lambda i, a: F.struct(i.cast("long").alias("id"), a.alias("address"))
    name = F.concat(F.lit("addr-"), "n_name")
    old = F.transform(F.sequence(F.lit(0), F.col("n_nationkey") % 3), lambda i: member(i, name))
    text = F.to_json(F.struct(old.alias("old"), F.array(member(F.lit(1), name), member(F.lit(2), name)).alias("new")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.from_json(text, codecs.JOINT).alias("j")).select(F.col("n_nationkey").alias("id"), F.size("j.old").alias("old_members"), F.size("j.new").alias("new_members"), F.col("j.old")[0]["address"].alias("first_address"))


@REGISTRY.add("snapshot_names", "SELECT n_nationkey AS id, 'snapshot-' || lpad(CAST(n_nationkey * 1000 AS VARCHAR), 20, '0') AS name FROM nation")
def snapshot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of snapshots."""
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), codecs.snapshot_name(F.col("n_nationkey") * 1000).alias("name"))
