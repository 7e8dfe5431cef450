"""The same rules over streams. Streaming has no counterpart elsewhere in the library: state is only kept for histories and echoes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.redact import redact_lines


def read_conversations(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of conversations from Parquet files."""
    return spark.readStream.schema("conv_id long, turn int, role string, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def redacted_turns(turns: DataFrame) -> DataFrame:
    """Stateless: each turn with `redacted` and `n_masks`, line by line."""
    from ..operators.redact import redact_documents

    keyed = turns.withColumn("doc_id", F.struct("conv_id", "turn", "role"))
    return redact_documents(keyed).select("doc_id.*", "redacted", "n_masks")


def masks_per_window(lines: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """lines(ts, page_id, line_no, text, confidence): masks per window of event time; later lines than `late` are dropped."""
    found = redact_lines(lines.withWatermark("ts", late))
    return found.groupBy(F.window("ts", size)).agg(F.sum("n_masks").alias("n_masks"), F.count("*").alias("n_lines"))


def distinct_findings(found: DataFrame, late: str = "30 minutes") -> DataFrame:
    """findings(ts, page_id, kind, token, ...) without those repeated within the watermark."""
    return found.withWatermark("ts", late).dropDuplicatesWithinWatermark(["page_id", "kind", "token"])


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n): sessions of events that end after a gap."""
    grouped = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def histories(runs: DataFrame, depth: int = 20) -> DataFrame:
    """(key, number): stateful; the newest `depth` numbers of each key so far, sent on with every batch."""
    import pandas as pd

    def fold(key, frames, state):
        kept = list(state.get[0]) if state.exists else []
        for frame in frames:
            kept += frame["number"].tolist()
        kept = sorted(set(kept), reverse=True)[:depth]
        state.update((kept,))
        yield pd.DataFrame({"key": [key[0]] * len(kept), "number": kept})

    return runs.groupBy("key").applyInPandasWithState(fold, "key string, number long", "numbers array<long>", "update", "NoTimeout")
