"""Command line: python -m keytide STATE get KEY | range START END [LIMIT] | put KEY VALUE | delete KEY | load CHANGE_LOG | status."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.operators.cdc import StateTable
from keytide.session import build_session

FEED = "feed_pos long, mod_revision long, seq int, event_type string, key string, value string, create_revision long, lease_id long, ttl_seconds long, ts timestamp_ntz"


def run(spark: SparkSession, args: list[str]) -> DataFrame:
    """The result of a command as rows; ValueError if it is none."""
    if len(args) < 2:
        raise ValueError(__doc__)
    state, command, rest = StateTable(spark, args[0]), args[1], args[2:]
    now = state.read()
    live = now.where(~F.col("deleted")).select("key", "value", "mod_revision")
    if command == "get" and len(rest) == 1:
        return live.where(F.col("key") == rest[0])
    if command == "range" and len(rest) in (2, 3):
        found = live.where((F.col("key") >= rest[0]) & (F.col("key") < rest[1])).orderBy("key")
        return found.limit(int(rest[2])) if len(rest) == 3 and int(rest[2]) > 0 else found
    if (command, len(rest)) in (("put", 2), ("delete", 1)):
        revision = (now.agg(F.max("mod_revision")).first()[0] or 0) + 1
        gone = command == "delete"
        existed = bool(live.where(F.col("key") == rest[0]).take(1))
        state.apply(spark.createDataFrame([(0, revision, 0, command.upper(), rest[0], None if gone else rest[1], revision, 0, 0, None)], FEED))
        return spark.createDataFrame([(revision, existed)], "revision long, existed boolean")
    if command == "load" and len(rest) == 1:
        return state.apply(spark.read.parquet(rest[0])).agg(F.count("*").alias("keys"))
    if command == "status" and not rest:
        return now.agg(F.max("mod_revision").alias("revision"), F.count_if(~F.col("deleted")).alias("live"), F.count_if("deleted").alias("tombstones"))
    raise ValueError(__doc__)


if __name__ == "__main__":
    try:
        for row in run(build_session("keytide"), sys.argv[1:]).toLocalIterator():
            print(*row, sep="\t")
    except ValueError as wrong:
        sys.exit(str(wrong))
