"""Session defaults, the shared folder of a cluster, and lineage cuts through written tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "keytide", master: str | None = None, **conf: object) -> SparkSession:
    """A session with UTC, adaptive execution and skew handling; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(k, str(v))
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a session has none (local tests) one is made, on this machine.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="keytide-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        root = f"file://{os.path.abspath(root)}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, never used before."""
    return f"{shared_root(spark)}/keytide/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and later
    stages outlive the loss of executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """(FileSystem, Path class) of ``path``; metadata operations only."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path
    return jpath(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jpath


def read_text_file(spark: SparkSession, path: str) -> str | None:
    """A small control file, or None if it does not exist."""
    fs, jpath = hadoop_fs(spark, path)
    if not fs.exists(jpath(path)):
        return None
    stream = fs.open(jpath(path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Put a file or folder in place by one rename, unless the target exists; whether it did.

    Of several that try the same target one succeeds: the rename itself refuses, no test goes before it.
    """
    jvm = spark.sparkContext._jvm
    _, jpath = hadoop_fs(spark, target)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jpath(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(jpath(source), jpath(target), options)
    except Py4JJavaError as refused:
        if "FileAlreadyExistsException" in str(refused.java_exception.toString()):
            return False
        raise
    return True


def write_new_file(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small control file that must not exist yet; whether it did, so that of several writers one succeeds."""
    fs, jpath = hadoop_fs(spark, path)
    side = f"{path}.{uuid.uuid4().hex}.tmp"
    stream = fs.create(jpath(side), True)
    stream.write(bytearray(text.encode()))
    stream.close()
    done = rename_new(spark, side, path)
    if not done:
        fs.delete(jpath(side), False)
    return done


def write_text_file(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small control file: written beside it, then put in place by one rename."""
    jvm = spark.sparkContext._jvm
    fs, jpath = hadoop_fs(spark, path)
    side = jpath(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(side, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(side.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(side, jpath(path), overwrite)


def spread(scan: DataFrame) -> DataFrame:
    """A scan's rows over all cores, where its files have fewer parts than there are cores.

    For work that costs far more than moving the rows; ``scan`` must be a plain scan, as its parts are counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
