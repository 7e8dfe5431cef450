"""Results that several later steps read: worked out once, as tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """Where this application's tables are: in spark.checkpoint.dir, or (unset, on a local master) in a temporary folder."""
    app = spark.sparkContext.applicationId
    if app not in _made:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _made[app] = f"{(found or 'file://' + tempfile.mkdtemp(prefix='maskwright-')).rstrip('/')}/maskwright-{app}"
    return _made[app]


def once(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: lineage is cut, and executors may be lost. (A checkpoint would carry the
    constraints of what it was made from along, which grow from round to round.)"""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def spread(table: DataFrame) -> DataFrame:
    """A table as read from files, dealt over all cores where it has fewer partitions than there are; large tables stay as they
    are. (For plain reads: counting the partitions of anything else would run its shuffles.)"""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table._jdf.rdd().getNumPartitions() < cores else table


def spread_by(table: DataFrame, *keys: str, per_core: int = 4) -> DataFrame:
    """A table dealt over several tasks for each core by its keys, for steps that work long on each row: a small file with many
    rows, or one of few row groups, is read by few tasks otherwise, whatever number of partitions it has."""
    spark = table.sparkSession
    tasks = max(per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return table.repartition(tasks, *keys)


def forget(*tables: DataFrame) -> None:
    """Deletes what once() wrote for tables that nothing reads any more."""
    for table in tables:
        if path := getattr(table, "_written_to", None):
            _delete(table.sparkSession, path)


def forget_all(spark: SparkSession) -> None:
    """Deletes all that once() wrote in this application; call it when its results are read."""
    if spark.sparkContext.applicationId in _made:
        _delete(spark, _made.pop(spark.sparkContext.applicationId))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
