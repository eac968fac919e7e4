"""Relations of the engine, from the tables of a data directory.

``change_log`` gives the store's own log. Transactions, probes, replication logs and
the like, which no table holds, are derived from the events, orders and lineitem tables with
integer and string arithmetic that means the same in any SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions.changes import is_delete
from keytide.functions.codecs import bytes_of_text
from keytide.sources.tables import table

LOG_COLUMNS = ["revision", "seq", "key", "op", "value", "lease_id", "ttl_seconds", "ts"]


def distinct_changes(change_log: DataFrame) -> DataFrame:
    """The log without repeated deliveries and progress marks, in the engine's columns.

    Of the deliveries of a (mod_revision, seq) of a key the first to arrive (feed_pos) stands; bounds on keys reach the scan. A
    delete has no value; a null lease or ttl is 0.
    """
    gone = is_delete(F.col("event_type"))
    first = change_log.where(F.col("key").isNotNull()).groupBy("mod_revision", "seq", "key").agg(F.min_by(F.struct("event_type", "value", "lease_id", "ttl_seconds", "ts"), "feed_pos").alias("r"))
    return first.select("mod_revision", "seq", "key", "r.*").select(
        F.col("mod_revision").alias("revision"),
        "seq",
        "key",
        F.when(gone, "delete").otherwise("put").alias("op"),
        F.when(~gone, F.col("value")).alias("value"),
        F.coalesce("lease_id", F.lit(0)).cast("long").alias("lease_id"),
        F.coalesce("ttl_seconds", F.lit(0)).cast("long").alias("ttl_seconds"),
        "ts",
    )


def store_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store's log of a data directory."""
    return distinct_changes(table(spark, sf_dir, "change_log"))


def delivered_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, revision) of every delivered change, repeated ones too: where the log's revisions lie, from a scan alone."""
    return table(spark, sf_dir, "change_log").where(F.col("key").isNotNull()).select("key", F.col("mod_revision").alias("revision"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of one change per event, keyed by user; errors delete."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 AS revision",
        "0 AS seq",
        "concat('user-', lpad(cast(user_id AS string), 6, '0')) AS key",
        "if(event_type = 'error', 'delete', 'put') AS op",
        "if(event_type = 'error', NULL, concat(event_type, ':', props)) AS value",
        "if(event_type = 'purchase', 1 + user_id % 7, 0) AS lease_id",
        "if(event_type = 'error', 0, cast(get_json_object(props, '$.k') AS bigint)) AS ttl_seconds",
        "ts",
    )


def event_sizes(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """Number of events and of distinct users."""
    row = table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("u")).first()
    return row.n, row.u


def _user_key(number: str) -> str:
    return f"concat('user-', lpad(cast({number} AS string), 6, '0'))"


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of probes (pid, key, revision), one per order."""
    n, u = event_sizes(spark, sf_dir)
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS pid", f"{_user_key(f'o_custkey % {u}')} AS key", f"(o_orderkey * 37) % {n} AS revision")


def txn_reads(spark: SparkSession, sf_dir: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(txn_id, start_revision, commit_at, key): each transaction reads one key. ``sizes``: event_sizes, if known."""
    n, u = sizes or event_sizes(spark, sf_dir)
    start = f"(o_orderkey * 37) % {n}"
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS txn_id", f"{start} AS start_revision", f"least({n}, {start} + 1 + (o_orderkey * 11) % ({u} div 2 + 1)) AS commit_at", f"{_user_key(f'o_custkey % {u}')} AS key"
    )


def txn_writes(spark: SparkSession, sf_dir: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(txn_id, seq, key, op, value): a write per line of an order; returned lines delete. ``sizes``: event_sizes, if known."""
    _, u = sizes or event_sizes(spark, sf_dir)
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS txn_id",
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq",
        f"{_user_key(f'l_partkey % {u}')} AS key",
        "if(l_returnflag = 'R', 'delete', 'put') AS op",
        "if(l_returnflag = 'R', NULL, concat('part:', l_partkey)) AS value",
    )


def serial_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, txn_id, start_revision, commit_at, key): transactions whose components share no keys."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey % 50 AS component", "o_orderkey AS txn_id", "o_orderkey - o_orderkey * 11 % 2000 AS start_revision", "o_orderkey AS commit_at", "concat(o_custkey % 50, ':', o_custkey * 7 % 20) AS key")


def serial_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(component, txn_id, key) of their writes, a line of an order each; lines of small quantity write nothing."""
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", "o_custkey % 50 AS component")
    return table(spark, sf_dir, "lineitem").where("l_quantity > 10").join(orders, "l_orderkey").selectExpr("component", "l_orderkey AS txn_id", "concat(component, ':', l_partkey % 20) AS key")


def txn_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn_id, start_revision, seq, kind, key, value): an operation per line of an order, by turns reads, puts and deletes of a few keys."""
    n, u = event_sizes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS l_orderkey", f"(o_orderkey * 37) % {n} AS start_revision")
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq", "l_partkey", "l_returnflag")
    return lines.join(orders, "l_orderkey").selectExpr(
        "l_orderkey AS txn_id", "start_revision", "seq", "CASE WHEN l_returnflag = 'R' THEN 'delete' WHEN l_returnflag = 'A' THEN 'put' ELSE 'read' END AS kind", f"{_user_key(f'(l_orderkey + l_partkey % 2) % {u}')} AS key", "if(l_returnflag = 'A', concat('part:', l_partkey), NULL) AS value"
    )


def replicated_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_index, term, entry_type, data): a replicated log of commands in JSON."""
    n, _ = event_sizes(spark, sf_dir)
    term = f"1 + event_id * 4 div {n}"
    return table(spark, sf_dir, "events").selectExpr(
        "event_id + 1 AS log_index",
        f"{term} AS term",
        f"CASE WHEN event_id = 0 OR {term} <> 1 + (event_id - 1) * 4 div {n} THEN 'Noop' WHEN (event_id + 1) % 997 = 0 THEN 'ConfigChange' ELSE 'Normal' END AS entry_type",
        f"CASE WHEN event_id % 101 = 100 THEN '{{broken' WHEN event_type = 'error' THEN concat('{{\"type\":\"Delete\",\"key\":\"', user_id, '\"}}') "
        f"WHEN event_type = 'signup' THEN concat('{{\"type\":\"LeaseGrant\",\"id\":', user_id, ',\"ttl\":', 60 + event_id % 60, '}}') "
        "ELSE concat('{\"type\":\"Put\",\"key\":\"', user_id, '\",\"value\":\"', event_type, '\",\"lease_id\":', if(event_type = 'purchase', user_id, 0), '}') END AS data",
    )


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_index, term, entry_type, data): a replicated log whose commands share keys and leases and have their type as a tag."""
    n, _ = event_sizes(spark, sf_dir)
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id", "event_type", "event_id + 1 AS log_index", f"1 + event_id * 4 div {n} AS term", "if((event_id + 1) % 997 = 0, 'ConfigChange', 'Normal') AS entry_type", "concat('k', user_id * 7 % 97) AS key", "1 + user_id % 13 AS lease_id"
    )
    key, lease, value = bytes_of_text(F.col("key")), F.col("lease_id").cast("string"), bytes_of_text(F.concat("event_type", F.col("event_id").cast("string")))
    put = lambda of: F.concat(F.lit('{"Put":{"key":'), key, F.lit(',"value":'), value, F.lit(',"lease_id":'), of, F.lit(',"ttl_seconds":'), (F.col("event_id") % 60).cast("string"), F.lit("}}"))
    kind = F.col("event_type")
    data = (
        F.when(F.col("event_id") % 101 == 100, "{broken")
        .when(kind == "error", F.concat(F.lit('{"Delete":{"key":'), key, F.lit("}}")))
        .when(kind == "signup", F.concat(F.lit('{"LeaseGrant":{"lease_id":'), lease, F.lit(',"ttl":'), (F.col("event_id") % 60).cast("string"), F.lit("}}")))
        .when((kind == "click") & (F.col("event_id") % 3 == 0), F.concat(F.lit('{"LeaseRevoke":{"lease_id":'), lease, F.lit("}}")))
        .when(kind == "view", put(F.lit("0")))
        .otherwise(put(lease))
    )
    return rows.select("log_index", "term", "entry_type", data.alias("data"))


#: The relations above in SQL of DuckDB, for WITH clauses.
STORE_LOG_SQL = """log AS (
  SELECT mod_revision AS revision, seq, key, CASE WHEN gone THEN 'delete' ELSE 'put' END AS op, CASE WHEN gone THEN NULL ELSE value END AS value,
    coalesce(lease_id, 0) AS lease_id, coalesce(ttl_seconds, 0) AS ttl_seconds, ts
  FROM (SELECT *, upper(trim(coalesce(event_type, '0'))) IN ('DELETE', '1') AS gone, row_number() OVER (PARTITION BY mod_revision, seq ORDER BY feed_pos) AS rn
        FROM change_log WHERE key IS NOT NULL) WHERE rn = 1)"""
EVENT_LOG_SQL = """nu AS (SELECT count(*) AS n, count(DISTINCT user_id) AS u FROM events),
log AS (
  SELECT event_id + 1 AS revision, 0 AS seq, 'user-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op,
    CASE WHEN event_type <> 'error' THEN event_type || ':' || props END AS value, CASE WHEN event_type = 'purchase' THEN 1 + user_id % 7 ELSE 0 END AS lease_id,
    CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS ttl_seconds, ts FROM events)"""
PROBES_SQL = "probes AS (SELECT o_orderkey AS pid, 'user-' || lpad(CAST(o_custkey % u AS VARCHAR), 6, '0') AS key, (o_orderkey * 37) % n AS revision FROM orders, nu)"
TXNS_SQL = """reads AS (
  SELECT o_orderkey AS txn_id, (o_orderkey * 37) % n AS start_revision, least(n, (o_orderkey * 37) % n + 1 + (o_orderkey * 11) % (u // 2 + 1)) AS commit_at,
    'user-' || lpad(CAST(o_custkey % u AS VARCHAR), 6, '0') AS key FROM orders, nu),
writes AS (
  SELECT l_orderkey AS txn_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq,
    'user-' || lpad(CAST(l_partkey % u AS VARCHAR), 6, '0') AS key, CASE WHEN l_returnflag = 'R' THEN 'delete' ELSE 'put' END AS op,
    CASE WHEN l_returnflag <> 'R' THEN 'part:' || l_partkey END AS value FROM lineitem, nu)"""
REPLICATED_LOG_SQL = """rn AS (SELECT count(*) AS n FROM events),
replog AS (
  SELECT event_id + 1 AS log_index, 1 + event_id * 4 // n AS term,
    CASE WHEN event_id = 0 OR event_id * 4 // n <> (event_id - 1) * 4 // n THEN 'Noop' WHEN (event_id + 1) % 997 = 0 THEN 'ConfigChange' ELSE 'Normal' END AS entry_type,
    event_id, event_type, user_id FROM events, rn)"""
COMMAND_LOG_SQL = """rn AS (SELECT count(*) AS n FROM events),
cmds AS (
  SELECT event_id + 1 AS log_index, 'k' || (user_id * 7 % 97) AS key, event_type || event_id AS value, event_id % 60 AS ttl,
    CASE WHEN event_type = 'error' THEN 'Delete' WHEN event_type = 'signup' THEN 'LeaseGrant' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'LeaseRevoke' ELSE 'Put' END AS type,
    CASE WHEN event_type = 'view' THEN 0 ELSE 1 + user_id % 13 END AS lease_id
  FROM events, rn WHERE event_id % 101 <> 100 AND (event_id + 1) % 997 <> 0 AND event_id + 1 <= n * 9 // 10)"""
SERIAL_SQL = """sreads AS (SELECT o_custkey % 50 AS component, o_orderkey AS txn_id, o_orderkey - o_orderkey * 11 % 2000 AS start_revision, o_custkey * 7 % 20 AS key FROM orders),
swrites AS (SELECT l_orderkey AS txn_id, list(DISTINCT l_partkey % 20) AS wrote FROM lineitem WHERE l_quantity > 10 GROUP BY l_orderkey),
sall AS (SELECT r.*, coalesce(wrote, []) AS wrote, row_number() OVER (PARTITION BY component ORDER BY r.txn_id) AS n FROM sreads r LEFT JOIN swrites w ON w.txn_id = r.txn_id)"""
OPERATIONS_SQL = """tops AS (SELECT l_orderkey AS txn_id, (o_orderkey * 37) % n AS start_revision, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS seq,
    CASE l_returnflag WHEN 'R' THEN 'delete' WHEN 'A' THEN 'put' ELSE 'read' END AS kind, 'user-' || lpad(CAST((l_orderkey + l_partkey % 2) % u AS VARCHAR), 6, '0') AS key, CASE WHEN l_returnflag = 'A' THEN 'part:' || l_partkey END AS value
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey, nu)"""
