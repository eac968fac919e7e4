"""Queries on the store's log: reads, history, maintenance, sorted runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.functions import codecs
from keytide.operators import runs, versions
from keytide.plans.registry import Registry
from keytide.session import materialize, shared_path
from keytide.sources import files
from keytide.sources.fixtures import EVENT_LOG_SQL, PROBES_SQL, STORE_LOG_SQL, delivered_revisions, event_log, probes, store_log
from keytide.sources.tables import table

REGISTRY = Registry()
START, END, PREFIX, PAGE = "cache/", "lock/", "tenant-0", 100

_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC, seq DESC) AS rank FROM log{where}) WHERE rank = 1)"
_TOP = "top AS (SELECT max(revision) AS top FROM log)"
_CREATED = "created AS (SELECT n.key, min(l.revision) AS create_revision FROM newest n JOIN log l ON l.key = n.key AND l.op = 'put'{more} WHERE n.op = 'put' AND NOT EXISTS (SELECT 1 FROM log d WHERE d.key = l.key AND d.op = 'delete' AND (d.revision, d.seq) > (l.revision, l.seq){dmore}) GROUP BY n.key)"


def _sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _top(spark: SparkSession, sf_dir: str) -> int:
    return delivered_revisions(spark, sf_dir).agg(F.max("revision")).first()[0] or 0


_LIVE = (STORE_LOG_SQL, _NEWEST.format(where=""), _CREATED.format(more="", dmore=""))


@REGISTRY.add("kv_latest", _sql(*_LIVE, select="SELECT n.key, value, create_revision, revision AS mod_revision, lease_id FROM newest n JOIN created c ON c.key = n.key"))
def kv_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys with value, create and mod revision."""
    return versions.live(store_log(spark, sf_dir), spread_like=delivered_revisions(spark, sf_dir))


@REGISTRY.add(
    "kv_asof",
    _sql(STORE_LOG_SQL, "mid AS (SELECT max(revision) // 2 AS mid FROM log)", _NEWEST.format(where=", mid WHERE revision <= mid"), select="SELECT key, value, revision AS mod_revision, lease_id FROM newest WHERE op = 'put'"),
)
def kv_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys at half of the log."""
    now = versions.newest(store_log(spark, sf_dir), _top(spark, sf_dir) // 2).where("op = 'put'")
    return now.select("key", "value", F.col("revision").alias("mod_revision"), "lease_id")


@REGISTRY.add("kv_get", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select="SELECT key, value, revision AS mod_revision FROM newest WHERE op = 'put' AND key = (SELECT min(key) FROM newest WHERE op = 'put')"))
def kv_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key, the first that is live; the filter reaches the scan."""
    log = store_log(spark, sf_dir)
    first = versions.newest(log).where("op = 'put'").agg(F.min("key")).first()[0]
    return versions.newest(log.where(F.col("key") == F.lit(first))).where("op = 'put'").select("key", "value", F.col("revision").alias("mod_revision"))


@REGISTRY.add("kv_get_at", _sql(STORE_LOG_SQL, _TOP, select="SELECT key, value, revision AS mod_revision FROM (SELECT * FROM log, top WHERE key = 'cfg/rollout/active' AND revision <= top // 2 ORDER BY revision DESC, seq DESC LIMIT 1) WHERE op = 'put'"))
def kv_get_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key at half of the log."""
    log = store_log(spark, sf_dir)
    return versions.newest(log.where("key = 'cfg/rollout/active'"), _top(spark, sf_dir) // 2).where("op = 'put'").select("key", "value", F.col("revision").alias("mod_revision"))


@REGISTRY.add(
    "kv_get_many",
    _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select="SELECT w.key, coalesce(n.value, '') AS value, coalesce(n.revision, 0) AS mod_revision FROM (SELECT DISTINCT key FROM watchers) w LEFT JOIN newest n ON n.key = w.key AND n.op = 'put'"),
)
def kv_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the watchers, with defaults for those that are missing."""
    return versions.get_many(store_log(spark, sf_dir), table(spark, sf_dir, "watchers").select("key").distinct())


@REGISTRY.add(
    "kv_asof_probe",
    _sql(EVENT_LOG_SQL, PROBES_SQL, select="SELECT pid, p.key, CASE WHEN op = 'put' THEN value END AS value, CASE WHEN op = 'put' THEN l.revision END AS mod_revision FROM probes p ASOF LEFT JOIN log l ON p.key = l.key AND p.revision >= l.revision"),
)
def kv_asof_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of reads for many (key, revision)."""
    return versions.as_of(probes(spark, sf_dir), event_log(spark, sf_dir))


@REGISTRY.add("kv_range_limit", _sql(*_LIVE, select=f"SELECT n.key, value, create_revision, revision AS mod_revision, lease_id FROM newest n JOIN created c ON c.key = n.key WHERE n.key >= '{START}' AND n.key < '{END}' ORDER BY n.key LIMIT {PAGE}"))
def kv_range_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First page of a range of keys, in byte order."""
    return versions.range_page(store_log(spark, sf_dir), START, END, PAGE, spread_like=delivered_revisions(spark, sf_dir))


@REGISTRY.add("kv_range_count", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select=f"SELECT count(*) AS keys FROM newest WHERE op = 'put' AND key >= '{START}' AND key < '{END}'"))
def kv_range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys in a range."""
    return versions.newest(versions.in_range(store_log(spark, sf_dir), START, END)).where("op = 'put'").agg(F.count("*").alias("keys"))


@REGISTRY.add("kv_prefix", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select=f"SELECT key, value, revision AS mod_revision FROM newest WHERE op = 'put' AND key LIKE '{PREFIX}%'"))
def kv_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys with a prefix."""
    return versions.newest(versions.in_range(store_log(spark, sf_dir), prefix=PREFIX)).where("op = 'put'").select("key", "value", F.col("revision").alias("mod_revision"))


@REGISTRY.add("kv_latest_info", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select="SELECT key, op, revision AS mod_revision, ttl_seconds FROM newest"))
def kv_latest_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest version of every key, delete markers included."""
    return versions.newest(store_log(spark, sf_dir)).select("key", "op", F.col("revision").alias("mod_revision"), "ttl_seconds")


_EPOCHS = """ranked AS (SELECT *, row_number() OVER w AS at, (SELECT 0) AS z FROM log WINDOW w AS (PARTITION BY key ORDER BY revision, seq)),
epochs AS (SELECT r.*, p.op AS prev_op, p.value AS prev_raw, n.revision AS next_revision, count(*) FILTER (r.op = 'delete') OVER (PARTITION BY r.key ORDER BY r.at ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CASE WHEN r.op = 'delete' THEN 1 ELSE 0 END AS epoch
  FROM ranked r LEFT JOIN ranked p ON p.key = r.key AND p.at = r.at - 1 LEFT JOIN ranked n ON n.key = r.key AND n.at = r.at + 1)"""


@REGISTRY.add(
    "version_history",
    _sql(STORE_LOG_SQL, _EPOCHS, select="""SELECT e.revision, e.seq, e.key, e.op, CASE WHEN e.op = 'put' THEN f.first_put ELSE 0 END AS create_revision,
  CASE WHEN e.op = 'put' THEN row_number() OVER (PARTITION BY e.key, e.epoch ORDER BY e.at) ELSE 0 END AS version_no, CASE WHEN prev_op = 'put' THEN prev_raw END AS prev_value,
  coalesce(prev_op = 'put', false) AS existed, e.next_revision, count(*) OVER (PARTITION BY e.key) - e.at + 1 AS rank_newest
FROM epochs e LEFT JOIN (SELECT key, epoch, min(revision) AS first_put FROM epochs WHERE op = 'put' GROUP BY ALL) f ON f.key = e.key AND f.epoch = e.epoch"""),
)
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its place in its key's history."""
    return versions.history(store_log(spark, sf_dir), spread_like=delivered_revisions(spark, sf_dir)).select("revision", "seq", "key", "op", "create_revision", "version_no", "prev_value", "existed", "next_revision", "rank_newest")


@REGISTRY.add("delete_existed", _sql(STORE_LOG_SQL, select="SELECT revision, seq, key, existed FROM (SELECT *, coalesce(lag(op) OVER (PARTITION BY key ORDER BY revision, seq) = 'put', false) AS existed FROM log) WHERE op = 'delete'"))
def delete_existed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delete of the log, and whether the key was there."""
    return versions.history(store_log(spark, sf_dir), spread_like=delivered_revisions(spark, sf_dir)).where("op = 'delete'").select("revision", "seq", "key", "existed")


_GC = "gc AS (SELECT l.*, (SELECT top - top // 100 FROM top) AS m FROM log l), marked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC, seq DESC) AS rank, row_number() OVER (PARTITION BY key, revision <= m ORDER BY revision DESC, seq DESC) AS visible FROM gc)"


@REGISTRY.add("gc_collect", _sql(STORE_LOG_SQL, _TOP, _GC, select="SELECT key, revision, seq, op FROM marked WHERE rank = 1 OR revision >= m"))
def gc_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up of versions leaves."""
    log = store_log(spark, sf_dir)
    top = _top(spark, sf_dir)
    return versions.collect_garbage(log, top - top // 100).select("key", "revision", "seq", "op")


@REGISTRY.add("gc_collect_safe", _sql(STORE_LOG_SQL, _TOP, _GC, select="SELECT key, revision, seq, op FROM marked WHERE rank = 1 OR revision >= m OR (revision <= m AND visible = 1)"))
def gc_collect_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, keeping what a read at the threshold sees."""
    log = store_log(spark, sf_dir)
    top = _top(spark, sf_dir)
    return versions.collect_garbage(log, top - top // 100, safe=True).select("key", "revision", "seq", "op")


@REGISTRY.add("gc_count", _sql(STORE_LOG_SQL, _TOP, _GC, select="SELECT count(*) FILTER (NOT (rank = 1 OR revision >= m)) AS removed, count(*) FILTER (rank = 1 OR revision >= m) AS kept FROM marked"))
def gc_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many versions the clean-up removes."""
    log = store_log(spark, sf_dir)
    top = _top(spark, sf_dir)
    kept = versions.collect_garbage(log, top - top // 100).agg(F.count("*").alias("kept"))
    return kept.select((F.lit(log.count()) - F.col("kept")).alias("removed"), "kept")


_EXPIRED = "expired AS (SELECT n.* FROM newest n, top WHERE op = 'put' AND ttl_seconds > 0 AND revision + ttl_seconds <= top)"


@REGISTRY.add("ttl_sweep", _sql(STORE_LOG_SQL, _TOP, _NEWEST.format(where=""), _EXPIRED, select="SELECT key, revision, ttl_seconds FROM expired"))
def ttl_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose time to live has passed at the end of the log."""
    log = store_log(spark, sf_dir)
    return versions.expired_by_ttl(log, _top(spark, sf_dir)).select("key", "revision", "ttl_seconds")


@REGISTRY.add("ttl_sweep_deletes", _sql(STORE_LOG_SQL, _TOP, _NEWEST.format(where=""), _EXPIRED, select="SELECT top + row_number() OVER (ORDER BY key) AS revision, 0 AS seq, key, 'delete' AS op FROM expired, top"))
def ttl_sweep_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deletes of that sweep at new revisions, in the order of keys."""
    log = store_log(spark, sf_dir)
    return versions.ttl_deletes(log, _top(spark, sf_dir))


@REGISTRY.add("revision_alloc", _sql(STORE_LOG_SQL, select="SELECT revision, dense_rank() OVER (ORDER BY revision) AS number FROM (SELECT DISTINCT revision FROM log)"))
def revision_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of the revisions in use."""
    return versions.numbered(store_log(spark, sf_dir).select("revision").distinct(), ["revision"])


@REGISTRY.add("memtable_size", _sql(STORE_LOG_SQL, select="SELECT count(*) AS entries, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes, sum(strlen(key) + coalesce(strlen(value), 0)) >= 4194304 AS is_full FROM log"))
def memtable_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and bytes of the log as one buffer, and whether it is due to be written."""
    size = F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)))
    return store_log(spark, sf_dir).agg(F.count("*").alias("entries"), size.alias("bytes"), (size >= 4 * 1024 * 1024).alias("is_full"))


_RUNS = """width AS (SELECT greatest(1, max(revision) // 10) AS width FROM log),
cut AS (SELECT *, least((revision - 1) // width, 9) AS sst_id, row_number() OVER (PARTITION BY least((revision - 1) // width, 9), key ORDER BY revision DESC, seq DESC) AS rn FROM log, width),
entries AS (SELECT sst_id, CASE WHEN sst_id >= 6 THEN 0 ELSE 1 END AS level, key, CASE WHEN op = 'put' THEN coalesce(value, '') END AS value FROM cut WHERE rn = 1),
stats AS (SELECT sst_id, level, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, count(*) FILTER (value IS NULL) AS tombstones, CAST(sum(strlen(key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM entries GROUP BY ALL)"""


@REGISTRY.add("run_stats", _sql(STORE_LOG_SQL, _RUNS, select="SELECT * FROM stats"))
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the runs."""
    return runs.run_statistics(runs.cut_runs(store_log(spark, sf_dir)))


@REGISTRY.add("level_counts", _sql(STORE_LOG_SQL, _RUNS, select="SELECT level, count(*) AS runs, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(bytes) AS BIGINT) AS bytes FROM stats GROUP BY level"))
def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by level."""
    return runs.level_counts(runs.run_statistics(runs.cut_runs(store_log(spark, sf_dir))))


@REGISTRY.add("compaction_needed", _sql(STORE_LOG_SQL, _RUNS, select="SELECT level FROM (SELECT level, count(*) AS n FROM stats GROUP BY level) WHERE (level = 0 AND n >= 4) OR (level BETWEEN 1 AND 5 AND n > 4 * power(10, level)) ORDER BY level LIMIT 1"))
def compaction_needed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that is due to be merged."""
    return runs.level_to_compact(runs.level_counts(runs.run_statistics(runs.cut_runs(store_log(spark, sf_dir)))))


@REGISTRY.add("run_overlap", _sql(STORE_LOG_SQL, _RUNS, select="SELECT sst_id, level FROM stats WHERE level = 0 OR (level = 1 AND min_key <= (SELECT max(max_key) FROM stats WHERE level = 0) AND max_key >= (SELECT min(min_key) FROM stats WHERE level = 0))"))
def run_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that a compaction of level 0 takes."""
    return runs.overlapping_runs(runs.run_statistics(runs.cut_runs(store_log(spark, sf_dir))), 0).select("sst_id", "level")


_MERGED = "SELECT key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, sst_id DESC) AS rn FROM entries) WHERE rn = 1"


@REGISTRY.add("compact_merge", _sql(STORE_LOG_SQL, _RUNS, select=f"SELECT *, 1 AS level FROM ({_MERGED}) WHERE value IS NOT NULL"))
def compact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that replaces all others, level 1 being the deepest."""
    return runs.compact(runs.cut_runs(store_log(spark, sf_dir)), 0, 1)


@REGISTRY.add("compact_merge_shallow", _sql(STORE_LOG_SQL, _RUNS, select=f"SELECT *, 1 AS level FROM ({_MERGED})"))
def compact_merge_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while deeper levels exist: tombstones stay."""
    return runs.compact(runs.cut_runs(store_log(spark, sf_dir)), 0, 6)


@REGISTRY.add("engine_scan", _sql(STORE_LOG_SQL, _RUNS, select=f"SELECT * FROM ({_MERGED}) WHERE value IS NOT NULL AND key >= '{START}' AND key < '{END}'"))
def engine_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged scan of a range over all runs."""
    return runs.merged(versions.in_range(runs.cut_runs(store_log(spark, sf_dir)), START, END))


@REGISTRY.add("engine_get", _sql(STORE_LOG_SQL, _RUNS, select="SELECT key, value, CASE WHEN value IS NULL THEN 'tombstone' ELSE 'value' END AS state FROM (SELECT *, row_number() OVER (ORDER BY level, sst_id DESC) AS rn FROM entries WHERE key = 'lock/leader/scheduler') WHERE rn = 1"))
def engine_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point read through the runs, telling a tombstone from a value."""
    got = runs.merged(runs.cut_runs(store_log(spark, sf_dir)).where("key = 'lock/leader/scheduler'"), keep_tombstones=True)
    return got.withColumn("state", F.when(F.col("value").isNull(), "tombstone").otherwise("value"))


@REGISTRY.add("manifest_after", "SELECT sst_id, level, (SELECT max(user_id) + 1 FROM events WHERE event_type <> 'error') AS next_id FROM (SELECT user_id AS sst_id, arg_max(event_type, event_id) AS last, arg_max(event_id % 4, event_id) AS level FROM events GROUP BY user_id) WHERE last <> 'error'")
def manifest_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that edits of a manifest leave."""
    edits = table(spark, sf_dir, "events").selectExpr("event_id AS at", "if(event_type = 'error', 'remove', 'add') AS action", "user_id AS sst_id", "event_id % 4 AS level")
    return runs.manifest_after(edits)


_HALF = "half AS (SELECT max(revision) // 2 AS half FROM log), tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC, seq DESC) AS rn FROM log, half WHERE revision > half) WHERE rn = 1)"


@REGISTRY.add("flush_run", _sql(STORE_LOG_SQL, _HALF, select="SELECT 77 AS sst_id, 0 AS level, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, count(*) FILTER (op = 'delete') AS tombstones, CAST(sum(strlen(key) + coalesce(strlen(CASE WHEN op = 'put' THEN coalesce(value, '') END), 0)) AS BIGINT) AS bytes FROM tail"))
def flush_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the level-0 run that the changes of the log's second half become."""
    return runs.run_statistics(runs.flushed(store_log(spark, sf_dir), _top(spark, sf_dir) // 2, 77))


@REGISTRY.add("engine_with_memtable", _sql(STORE_LOG_SQL, _NEWEST.format(where=""), select="SELECT key, coalesce(value, '') AS value FROM newest WHERE op = 'put'"))
def engine_with_memtable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan over the runs of the log's first half and the changes in memory after it."""
    log, half = store_log(spark, sf_dir), _top(spark, sf_dir) // 2
    return runs.merged_with_memtable(runs.cut_runs(log.where(F.col("revision") <= half)), log, half)


@REGISTRY.add("put_versioned", _sql(STORE_LOG_SQL, "added AS (SELECT key, max(revision) // 2 AS revision, 'late' AS value FROM log GROUP BY key UNION ALL SELECT key, max(revision) + 1, 'new' FROM log WHERE length(key) % 2 = 0 GROUP BY key)", "every AS (SELECT key, revision, seq, op, value FROM log UNION ALL SELECT key, revision, 2147483647, 'put', value FROM added)",
      select="SELECT key, revision, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision DESC, seq DESC) AS rn FROM every) WHERE rn = 1 AND op = 'put'"))
def put_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys after writes that bring their own revisions, some older than what is there."""
    log = store_log(spark, sf_dir)
    tops = log.groupBy("key").agg(F.max("revision").alias("top"))
    late = tops.select("key", F.expr("top div 2").alias("revision"), F.lit("late").alias("value"))
    new = tops.where("length(key) % 2 = 0").select("key", (F.col("top") + 1).alias("revision"), F.lit("new").alias("value"))
    return versions.newest(versions.with_versions(log, late.unionByName(new))).where("op = 'put'").select("key", "revision", "value")


@REGISTRY.add("wal_files", _sql(STORE_LOG_SQL, select="SELECT op, key, value, count(*) AS records FROM (SELECT op, key, CASE WHEN op = 'put' THEN coalesce(value, '') END AS value FROM log) GROUP BY ALL"))
def wal_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's writes, appended to log files and read from them."""
    log = store_log(spark, sf_dir)
    data = codecs.encode_wal_op(F.col("op"), F.col("key"), F.coalesce("value", F.lit("")))
    catalogue = files.write_wal_files(log.select(F.col("revision").alias("seq"), data.alias("data")), shared_path(spark, "wal"))
    read = files.read_wal_files(catalogue).select(codecs.decode_wal_op(F.col("data")).alias("w")).select("w.op", "w.key", "w.value")
    return read.groupBy("op", "key", "value").agg(F.count("*").alias("records"))


@REGISTRY.add("run_file_scan", _sql(STORE_LOG_SQL, _RUNS, select=f"SELECT * FROM ({_MERGED}) WHERE value IS NOT NULL AND key >= '{START}' AND key < '{END}'"))
def run_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scan over runs in their binary files."""
    catalogue = files.write_run_files(runs.cut_runs(store_log(spark, sf_dir)), shared_path(spark, "runs"))
    return runs.merged(files.scan_run_files(catalogue, START, END))


@REGISTRY.add(
    "run_file_get",
    _sql(STORE_LOG_SQL, _RUNS, "asked AS (SELECT DISTINCT key FROM log UNION ALL SELECT DISTINCT key || '!' FROM log), newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY level, sst_id DESC) AS rn FROM entries) WHERE rn = 1)",
         select="SELECT a.key, CASE WHEN n.key IS NULL THEN 'missing' WHEN value IS NULL THEN 'tombstone' ELSE 'value' END AS state, value FROM asked a LEFT JOIN newest n ON n.key = a.key"),
)
def run_file_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point reads of every key, and of as many that are nowhere, from runs in their binary files."""
    log = store_log(spark, sf_dir)
    catalogue = files.write_run_files(runs.cut_runs(log), shared_path(spark, "runs"))
    keys = log.select("key").distinct()
    return files.get_from_run_files(catalogue, keys.unionByName(keys.select(F.concat("key", F.lit("!")).alias("key"))))


@REGISTRY.add("run_file_catalogue", _sql(STORE_LOG_SQL, _RUNS, select="SELECT sst_id, level, min_key, max_key, entries, tombstones FROM stats"))
def run_file_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the files of each run hold together."""
    catalogue = files.write_run_files(runs.cut_runs(store_log(spark, sf_dir)), shared_path(spark, "runs"))
    return catalogue.groupBy("sst_id", "level").agg(F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"), F.sum("entries").alias("entries"), F.sum("tombstones").alias("tombstones"))


@REGISTRY.add("manifest_names", _sql(STORE_LOG_SQL, _RUNS, select="SELECT level, sst_id, lpad(CAST(sst_id AS VARCHAR), 8, '0') || '.sst' AS file_name, (SELECT max(sst_id) + 1 FROM stats) AS next_id FROM stats"))
def manifest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue of the runs' file names and the next number."""
    stats = runs.run_statistics(runs.cut_runs(store_log(spark, sf_dir)))
    next_id = stats.agg((F.max("sst_id") + 1).alias("next_id"))  # one row
    return stats.select("level", "sst_id", F.concat(F.lpad(F.col("sst_id").cast("string"), 8, "0"), F.lit(".sst")).alias("file_name")).join(F.broadcast(next_id))


@REGISTRY.add("bloom_contract", _sql(STORE_LOG_SQL, select="SELECT DISTINCT key, true AS may FROM log UNION ALL SELECT 'of others at most 3 in 100', true"))
def bloom_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a filter of the keys may hold each of them, and whether it lets no more than 3 in 100 others through."""
    keys = store_log(spark, sf_dir).select("key").distinct()
    bits, hashes = runs.bloom_sizes(keys.count(), 0.01)
    bloom = runs.bloom_filter(keys, "key", bits, hashes)
    asked = keys.withColumn("inside", F.lit(True)).unionByName(keys.select(F.concat(F.lit("absent:"), "key").alias("key"), F.lit(False).alias("inside")))
    got = materialize(runs.may_contain(asked, "key", bloom, bits, hashes), "answers")
    wrong = got.where("NOT inside").agg((F.coalesce(F.avg(F.col("may").cast("int")), F.lit(0)) <= 0.03).alias("may"))
    return got.where("inside").select("key", "may").unionByName(wrong.select(F.lit("of others at most 3 in 100").alias("key"), "may"))
