"""Session helpers: what workers can import, and where jobs may keep intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and sets the options its plans rely on.

    Workers on other machines get the package by ``--py-files`` as usual; a session on this
    machine finds it by path.
    """
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session on one machine (tests) may leave it unset,
    and gets a temporary one."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "helixframe-checkpoints")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders made by this driver that are not deleted yet.
_made: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the driver ends, if it isn't discarded before."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration() if spark.sparkContext._jsc else jvm.org.apache.hadoop.conf.Configuration()
    at.getFileSystem(conf).delete(at, True)
    _made.pop(path, None)


@atexit.register
def _tidy() -> None:
    """What results that are read lazily still needed goes with the driver."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # the JVM may be gone already
            _delete(spark, path)


#: How tables are settled: shuffle files go when the table is written, and columns of small numbers compress further.
_SETTLE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.parquet.compression.codec": "zstd"}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: later steps don't depend on the
    executors that made it."""
    spark = df.sparkSession
    path, before = scratch(spark, name), {k: spark.conf.get(k, None) for k in _SETTLE}
    try:
        for k, v in _SETTLE.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes settled tables that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._settled)
