"""Queries on the rules of replication, membership, registration and simulated faults. Their requests are derived from the events table, one each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators import audit, consensus, leasing, watching
from keytide.plans.kv import _sql
from keytide.plans.registry import Registry
from keytide.sources.fixtures import event_sizes
from keytide.sources.tables import table

REGISTRY = Registry()
_N = "nn AS (SELECT count(*) AS n FROM events)"


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*columns)


_FOLLOWER = "own AS (SELECT event_id + 1 AS log_index, 1 + event_id * 4 // n AS term FROM events, nn WHERE event_id + 1 <= n * 7 // 10)"
_APPENDS = "asked AS (SELECT event_id AS request_id, 1 + event_id % 5 AS term, event_id * 13 % n AS prev_index, CASE WHEN event_type = 'error' THEN 9 ELSE 1 + (event_id * 13 % n - 1) * 4 // n END AS prev_term, event_id % 4 AS k, event_id * 17 % n AS leader_commit, event_type = 'click' AS differs FROM events)".replace("FROM events)", "FROM events, nn)")


@REGISTRY.add(
    "append_outcome",
    _sql(_N, _FOLLOWER, _APPENDS, """new AS (SELECT request_id, unnest(range(1, k + 1)) AS i FROM asked),
per AS (SELECT a.request_id, max(prev_index + i) AS upto, min(CASE WHEN o.term <> CASE WHEN differs AND i > 1 THEN 7 ELSE 1 + (prev_index + i - 1) * 4 // n END THEN prev_index + i END) AS conflict
  FROM asked a JOIN new USING (request_id) CROSS JOIN nn LEFT JOIN own o ON o.log_index = prev_index + i GROUP BY a.request_id)""",
         select="""SELECT a.request_id, greatest(a.term, 3) AS term, good AS success, CASE WHEN a.term < 3 THEN 0 WHEN good THEN tail ELSE last END AS match_index,
  CASE WHEN good AND leader_commit > n // 2 THEN least(leader_commit, tail) ELSE n // 2 END AS commit_index, CASE WHEN good THEN conflict END AS truncated_at
  FROM (SELECT a.*, conflict, n, (SELECT max(log_index) FROM own) AS last, CASE WHEN conflict IS NOT NULL THEN upto ELSE greatest((SELECT max(log_index) FROM own), coalesce(upto, 0)) END AS tail, a.term >= 3 AND (prev_index = 0 OR coalesce(o.term = prev_term, false)) AS good
    FROM asked a CROSS JOIN nn LEFT JOIN per USING (request_id) LEFT JOIN own o ON o.log_index = prev_index) a"""),
)
def append_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to append requests of a follower that has seven tenths of the log."""
    n, _ = event_sizes(spark, sf_dir)
    own = _events(spark, sf_dir, "event_id + 1 AS log_index", f"1 + event_id * 4 div {n} AS term").where(F.col("log_index") <= n * 7 // 10)
    prev = f"event_id * 13 % {n}"
    entries = f"if(event_id % 4 > 0, transform(sequence(1, event_id % 4), i -> named_struct('log_index', {prev} + i, 'term', if(event_type = 'click' AND i > 1, 7, 1 + ({prev} + i - 1) * 4 div {n}))), array())"
    asked = _events(spark, sf_dir, "event_id AS request_id", "1 + event_id % 5 AS term", f"{prev} AS prev_index", f"if(event_type = 'error', 9, 1 + ({prev} - 1) * 4 div {n}) AS prev_term", f"event_id * 17 % {n} AS leader_commit", f"{entries} AS entries")
    return consensus.append_outcomes(asked, own, 3, n // 2)


@REGISTRY.add(
    "append_requests",
    _sql(_N, "peers AS (SELECT DISTINCT user_id AS node_id, 1 + user_id * 7919 % n AS next_index FROM events, nn)", select="""SELECT node_id, 4 AS term, next_index - 1 AS prev_index, CASE WHEN next_index = 1 THEN 0 ELSE 1 + (next_index - 2) * 4 // n END AS prev_term,
  next_index AS first_index, n AS last_index, n - next_index + 1 AS entries, n // 2 AS leader_commit FROM peers, nn"""),
)
def append_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a leader sends to each of many peers."""
    n, _ = event_sizes(spark, sf_dir)
    log = _events(spark, sf_dir, "event_id + 1 AS log_index", f"1 + event_id * 4 div {n} AS term")
    return consensus.append_requests(_events(spark, sf_dir, "user_id AS node_id", f"1 + user_id * 7919 % {n} AS next_index").distinct(), log, 4, n // 2)


@REGISTRY.add(
    "propose_outcome",
    "SELECT \"at\", verdict, CASE WHEN verdict = 'accepted' THEN 100 + row_number() OVER (PARTITION BY verdict ORDER BY \"at\") END AS log_index FROM (SELECT event_id AS \"at\", CASE WHEN user_id % 5 = 0 THEN 'NotLeader' WHEN event_id // 50 % 7 = 0 THEN 'TransferInProgress' ELSE 'accepted' END AS verdict FROM events)",
)
def propose_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which proposals are taken, and at which index."""
    return consensus.proposals(_events(spark, sf_dir, "event_id AS at", "if(user_id % 5 = 0, 'follower', 'leader') AS role", "event_id div 50 % 7 = 0 AS transferring"), 100)


@REGISTRY.add(
    "step_down",
    "SELECT event_id AS node_id, CASE WHEN event_id % 7 > user_id % 6 THEN 'follower' ELSE event_type END AS role, greatest(event_id % 7, user_id % 6) AS term, CASE WHEN event_id % 7 <= user_id % 6 THEN user_id END AS voted_for, CASE WHEN event_id % 7 <= user_id % 6 THEN user_id % 3 END AS leader_id, event_id % 7 > user_id % 6 AS stepped_down FROM events",
)
def step_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes after they saw another term."""
    return consensus.stepped_down(_events(spark, sf_dir, "event_id AS node_id", "event_type AS role", "user_id % 6 AS term", "user_id AS voted_for", "user_id % 3 AS leader_id", "event_id % 7 AS seen_term"))


@REGISTRY.add(
    "transfer_outcome",
    """SELECT transfer_id, min(at_ms) FILTER (at_ms - started <= 400 AND match_index >= 5) AS sent_ms, CASE WHEN max(at_ms) - started > 400 THEN 'TimedOut' WHEN count(*) FILTER (at_ms - started <= 400 AND match_index >= 5) > 0 THEN 'TimeoutNow' ELSE 'Waiting' END AS outcome
 FROM (SELECT event_id // 4 AS transfer_id, event_id // 4 * 1000 AS started, event_id // 4 * 1000 + event_id % 4 * (user_id % 200) AS at_ms, user_id % 9 AS match_index FROM events) GROUP BY transfer_id, started""",
)
def transfer_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How hand-overs of leadership end."""
    seen = _events(spark, sf_dir, "event_id div 4 AS transfer_id", "event_id div 4 * 1000 + event_id % 4 * (user_id % 200) AS at_ms", "user_id % 9 AS match_index")
    transfers = _events(spark, sf_dir, "event_id div 4 AS transfer_id", "event_id div 4 * 1000 AS started_ms", "5L AS last_index").distinct()
    return consensus.transfer_outcomes(transfers, seen, 400)


@REGISTRY.add(
    "snapshot_verdict",
    """SELECT event_id AS offer_id, CASE WHEN lt < mt THEN 'stale' WHEN inc <= snap THEN 'ignored' ELSE 'installed' END AS verdict, greatest(lt, mt) AS term, CASE WHEN lt < mt OR inc <= snap THEN com ELSE greatest(com, inc) END AS commit_index, CASE WHEN lt < mt OR inc <= snap THEN app ELSE greatest(app, inc) END AS applied_index
 FROM (SELECT event_id, event_id % 5 AS lt, user_id % 5 AS mt, event_id * 31 % 1000 AS inc, user_id % 700 AS snap, user_id % 700 + event_id % 200 AS com, user_id % 700 + event_id % 100 AS app FROM events)""",
)
def snapshot_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to offered snapshots."""
    return consensus.snapshot_verdicts(_events(spark, sf_dir, "event_id AS offer_id", "event_id % 5 AS leader_term", "user_id % 5 AS my_term", "event_id * 31 % 1000 AS included_index", "user_id % 700 AS snapshot_index", "user_id % 700 + event_id % 200 AS commit_index", "user_id % 700 + event_id % 100 AS applied_index"))


@REGISTRY.add(
    "drain_target",
    "SELECT node_id, CASE WHEN node_id % 3 = 0 THEN peer END AS transfer_to FROM (SELECT user_id AS node_id, arg_min(event_id % 11, event_id) FILTER (event_id % 11 <> user_id) AS peer FROM events GROUP BY user_id)",
)
def drain_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where leadership goes when nodes are drained."""
    nodes = _events(spark, sf_dir, "user_id AS node_id", "if(user_id % 3 = 0, 'leader', 'follower') AS role").distinct()
    return consensus.drain_targets(nodes, _events(spark, sf_dir, "user_id AS node_id", "event_id AS at", "event_id % 11 AS peer_id"))


_ADMIN = """admin AS (SELECT user_id % 40 AS cluster_id, event_id AS "at", CASE event_type WHEN 'view' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'abort' WHEN 'click' THEN 'remove' ELSE 'finalize' END AS action, user_id // 40 % 4 AS node_id,
  row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS k FROM events),
judged AS (
  SELECT cluster_id, 0::BIGINT AS k, 0::BIGINT AS "at", '' AS status, [0, 1]::BIGINT[] AS members, NULL::BIGINT[] AS pending FROM (SELECT DISTINCT cluster_id FROM admin)
  UNION ALL
  SELECT cluster_id, k, "at", status, CASE WHEN status = 'finalized' THEN pending ELSE members END,
    CASE WHEN status = 'joint' THEN CASE WHEN action = 'add' THEN list_sort(list_append(members, node_id)) ELSE list_filter(members, lambda m: m <> node_id) END WHEN status IN ('finalized', 'aborted') THEN NULL ELSE pending END
  FROM (SELECT a.cluster_id, a.k, a."at", a.action, a.node_id, j.members, j.pending, CASE
      WHEN action = 'finalize' THEN CASE WHEN j.pending IS NULL THEN 'nothing' ELSE 'finalized' END WHEN action = 'abort' THEN 'aborted' WHEN j.pending IS NOT NULL THEN 'ChangeInProgress'
      WHEN action = 'add' AND list_contains(j.members, a.node_id) THEN 'NodeAlreadyExists' WHEN action = 'remove' AND NOT list_contains(j.members, a.node_id) THEN 'NodeNotFound'
      WHEN action = 'remove' AND len(j.members) = 1 THEN 'CannotRemoveLastNode' ELSE 'joint' END AS status
    FROM judged j JOIN admin a ON a.cluster_id = j.cluster_id AND a.k = j.k + 1))"""


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    action = "CASE event_type WHEN 'view' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'abort' WHEN 'click' THEN 'remove' ELSE 'finalize' END AS action"
    initial = _events(spark, sf_dir, "user_id % 40 AS cluster_id").distinct().withColumn("members", F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    return consensus.membership_steps(_events(spark, sf_dir, "user_id % 40 AS cluster_id", "event_id AS at", action, "user_id div 40 % 4 AS node_id"), initial), initial


@REGISTRY.add("membership_changes", "WITH RECURSIVE " + _ADMIN + " SELECT cluster_id, \"at\", status, array_to_string(members, ',') AS members, coalesce(array_to_string(pending, ','), '') AS pending FROM judged WHERE k > 0")
def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of clusters' members: begun, finalized, aborted, refused."""
    text = lambda c: F.coalesce(F.array_join(c, ","), F.lit("")).alias(c)
    return _steps(spark, sf_dir)[0].select("cluster_id", "at", "status", text("members"), text("pending"))


@REGISTRY.add("members_after", "WITH RECURSIVE " + _ADMIN + " SELECT cluster_id, unnest(members) AS node_id FROM (SELECT cluster_id, arg_max(members, k) AS members FROM judged GROUP BY cluster_id)")
def members_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members after all changes."""
    return consensus.members_after(*_steps(spark, sf_dir))


@REGISTRY.add(
    "lease_ids",
    """WITH grants AS (SELECT event_id AS "at", CASE WHEN event_type IN ('view', 'purchase') THEN 0 ELSE user_id END AS lease_id, event_id % 9 AS ttl FROM events),
asked AS (SELECT *, count(*) FILTER (lease_id = 0 AND ttl > 0) OVER (ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS given FROM grants)
SELECT "at", CASE WHEN ttl <= 0 THEN NULL WHEN lease_id > 0 THEN lease_id ELSE given + greatest(1, coalesce(max(CASE WHEN lease_id > 0 AND ttl > 0 THEN lease_id + 1 - given END) OVER (ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) END AS lease_id FROM asked""",
)
def lease_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that grants get; the rule is tested against one grant after another."""
    return leasing.allocated_ids(_events(spark, sf_dir, "event_id AS at", "if(event_type IN ('view', 'purchase'), 0, user_id) AS lease_id", "event_id % 9 AS ttl"))


_WATCH_REQUESTS = """made AS (SELECT event_id AS "at", row_number() OVER (ORDER BY event_id) AS watch_id FROM events WHERE event_type = 'view'),
cancels AS (SELECT c.event_id AS "at", c.user_id AS watch_id, coalesce(m."at" < c.event_id, false) AS known FROM events c LEFT JOIN made m ON m.watch_id = c.user_id WHERE event_type <> 'view')"""


def _acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watching.registry_acks(_events(spark, sf_dir, "event_id AS at", "if(event_type = 'view', 'create', 'cancel') AS kind", "user_id AS watch_id"))


@REGISTRY.add("watch_registry", _sql(_WATCH_REQUESTS, select="SELECT \"at\", 'create' AS kind, watch_id, true AS ack FROM made UNION ALL SELECT \"at\", 'cancel', watch_id, known AND row_number() OVER (PARTITION BY watch_id, known ORDER BY \"at\") = 1 FROM cancels"))
def watch_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to requests to create and cancel watchers."""
    return _acks(spark, sf_dir)


@REGISTRY.add("watch_active", _sql(_WATCH_REQUESTS, select="SELECT watch_id FROM made WHERE watch_id NOT IN (SELECT watch_id FROM cancels WHERE known)"))
def watch_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watchers that are left."""
    return watching.active_watchers(_acks(spark, sf_dir))


_NETWORK = """acts AS (SELECT event_id AS "at", CASE WHEN event_id % 40 = 3 THEN 'heal_all' WHEN event_type = 'error' THEN 'cut' WHEN event_type = 'signup' THEN 'split' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'isolate' ELSE 'heal' END AS action, user_id % 7 AS a, event_id % 5 AS b FROM events WHERE event_type IN ('error', 'signup', 'purchase') OR event_id % 40 = 3),
edges AS (SELECT "at", action IN ('heal', 'heal_all') AS opens, a AS f, b AS t FROM acts WHERE action IN ('cut', 'split', 'heal') UNION ALL SELECT "at", action = 'heal', b, a FROM acts WHERE action IN ('split', 'heal')
  UNION ALL SELECT "at", false, a, x FROM acts, range(7) r(x) WHERE action = 'isolate' AND x <> a UNION ALL SELECT "at", false, x, a FROM acts, range(7) r(x) WHERE action = 'isolate' AND x <> a
  UNION ALL SELECT "at", true, f, t FROM acts, (SELECT i.x AS f, j.x AS t FROM range(7) i(x), range(7) j(x)) WHERE action = 'heal_all'),
last AS (SELECT "at", f, t, bool_or(opens) AS opens FROM edges GROUP BY ALL),
sent AS (SELECT event_id AS message_id, user_id % 7 AS f, (user_id + event_id) % 7 AS t FROM events WHERE event_type IN ('view', 'click') AND event_id % 40 <> 3)"""


@REGISTRY.add("network_delivery", _sql(_NETWORK, select="SELECT message_id, coalesce(l.opens, true) AS delivered FROM sent s ASOF LEFT JOIN last l ON l.f = s.f AND l.t = s.t AND s.message_id >= l.\"at\""))
def network_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages through a network that is cut, split, isolated and healed."""
    events = table(spark, sf_dir, "events")
    acts = events.where("event_type IN ('error', 'signup', 'purchase') OR event_id % 40 = 3").selectExpr("event_id AS at", "CASE WHEN event_id % 40 = 3 THEN 'heal_all' WHEN event_type = 'error' THEN 'cut' WHEN event_type = 'signup' THEN 'split' WHEN event_type = 'purchase' AND event_id % 3 = 0 THEN 'isolate' ELSE 'heal' END AS action", "user_id % 7 AS a", "event_id % 5 AS b")
    sent = events.where("event_type IN ('view', 'click') AND event_id % 40 <> 3").selectExpr("event_id AS message_id", "event_id AS at", "user_id % 7 AS from_id", "(user_id + event_id) % 7 AS to_id")
    return audit.delivered(sent, acts, spark.range(7).withColumnRenamed("id", "node_id"))


@REGISTRY.add(
    "disk_faults",
    """WITH acts AS (SELECT user_id % 30 AS disk_id, event_id AS "at", CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'error' THEN 'fail_' || CASE WHEN event_id % 2 = 0 THEN 'reads' ELSE 'writes' END ELSE 'restore_' || CASE WHEN event_id % 2 = 0 THEN 'reads' ELSE 'writes' END END AS action FROM events)
SELECT disk_id, "at", action, NOT coalesce(CASE action WHEN 'read' THEN r ELSE w END, false) AS ok FROM (SELECT *, last_value(CASE action WHEN 'fail_reads' THEN true WHEN 'restore_reads' THEN false END IGNORE NULLS) OVER d AS r, last_value(CASE action WHEN 'fail_writes' THEN true WHEN 'restore_writes' THEN false END IGNORE NULLS) OVER d AS w FROM acts WINDOW d AS (PARTITION BY disk_id ORDER BY "at")) WHERE action IN ('read', 'write')""",
)
def disk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of disks that fail and are restored."""
    half = "if(event_id % 2 = 0, 'reads', 'writes')"
    return audit.disk_verdicts(_events(spark, sf_dir, "user_id % 30 AS disk_id", "event_id AS at", f"CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' WHEN 'error' THEN concat('fail_', {half}) ELSE concat('restore_', {half}) END AS action"))


@REGISTRY.add(
    "http_answer",
    """SELECT event_id AS request_id, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 503 ELSE 200 END ELSE 404 END AS status,
 CASE event_type WHEN 'view' THEN 'a 1' || chr(10) || 'b 2' WHEN 'click' THEN 'OK' WHEN 'signup' THEN CASE WHEN user_id % 3 = 0 THEN 'No leader' ELSE 'OK' END ELSE 'Not Found' END AS body FROM events""",
)
def http_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to requests for metrics, health and readiness."""
    asked = _events(spark, sf_dir, "event_id AS request_id", "CASE event_type WHEN 'view' THEN '/metrics' WHEN 'click' THEN '/health' WHEN 'signup' THEN '/ready' ELSE '/none' END AS path", "if(user_id % 3 = 0, NULL, user_id) AS leader_id")
    return audit.http_answers(asked, spark.createDataFrame([("b 2",), ("a 1",)], "line string"))
