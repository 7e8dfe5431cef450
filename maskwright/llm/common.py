"""Shared helpers: table access, materialising in the shared folder, Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (unset, on a local master) a temporary one of the application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _local.setdefault(spark.sparkContext.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='maskwright-')}"
        _local[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/maskwright-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Texts may be long: Arrow batches of few rows and bytes keep the Python workers of an executor small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def let(value: Column, body) -> Column:
    """body(value) with value computed once (a lambda variable stands for it)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of text; none for null or blank text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def texts_of(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; nulls are empty."""
    data, at = utf8(column)
    return [data[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 4 << 20):
    """Slices of batch with about `most` bytes of text each (one row at least), so that work arrays stay small."""
    _, at = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(at, at[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node reachable.

    Alternating large-star and small-star rounds: each node's neighbours are linked to the smallest of them, so that the
    number of edges never grows and paths shrink by half. Every round is written to the shared folder. Hubs only meet
    pre-aggregated minima in a group-by and an equi-join that Spark may split. Ends when all that is left are stars; raises
    an error if they are not reached in most_rounds.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = materialize(pairs)
    for _ in range(most_rounds):
        both = pairs.union(pairs.select("b", "a")).toDF("n", "m")
        low = both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("n", "lo").alias("lo"))
        large = both.join(low, "n").where("m > n").select(F.col("lo").alias("a"), F.col("m").alias("b")).where("a < b").distinct()
        large = materialize(large)
        down = large.toDF("m", "n")
        lows = down.groupBy("n").agg(F.min("m").alias("lo"))
        small = down.join(lows, "n").select(F.col("lo").alias("a"), F.col("m").alias("b")).union(lows.select(F.col("lo").alias("a"), F.col("n").alias("b")))
        small = materialize(small.where("a < b").distinct())
        pairs = small
        # Stars only, when no centre is also a leaf and each leaf (edges are distinct) hangs on one centre.
        centre_is_leaf = small.select("a").join(small.select(F.col("b").alias("a")), "a", "left_semi")
        if small.groupBy("b").agg(F.count("*").alias("centres")).where("centres > 1").isEmpty() and centre_is_leaf.isEmpty():
            break
    else:
        raise RuntimeError(f"connected components have not converged in {most_rounds} rounds")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).union(pairs.select("a", F.col("a").alias("component")).distinct())
