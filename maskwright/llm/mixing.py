"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

A document's share of its source is decided by its hash alone: token sums by source and hash bucket give, by a running
sum, the bucket in which a source's budget ends; only that bucket is split again, by the next bits, until single hashes
are left. Thresholds nest: a larger budget takes a superset. No documents are sorted.

Cases: null text has size 0; a null source is a source of its own, last in order; an empty table gives no rows; rows that
repeat in doc_id and text share a hash and are taken together; all input columns but doc_id, text and source are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, words_of

#: Bits of the 60-bit hash that each level of histograms splits.
LEVELS = (12, 12, 12, 12, 12)
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def _hash_of():
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("text"))), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h) of each row."""
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), _hash_of().alias("h"))


def targets(rows: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """(source, source_size, target): share of all sizes by weight, none above most_repeats times its source's size."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Ranks without one task for all sources: positions in range partitions plus the rows of those before.
    ranged = materialize(sources.repartitionByRange(8, F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy("_p").count()  # eight rows at most
    offsets = counts.select("_p", (F.sum("count").over(W.orderBy("_p")) - F.col("count")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_p").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("_before")
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    ranked = materialize(ranged.join(offsets, "_p").select("source", "source_size", weight.alias("weight")))
    level, full = None, F.lit(False)
    while True:
        # One more source reaches its limit: its excess goes to the others by weight.
        x = ranked.select("*", full.alias("full")).agg(
            F.sum("source_size").alias("all"),
            F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size") * most_repeats)), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(F.col("full"), 1)).alias("n"),
        ).first()
        if not x["open"]:
            break
        level = (x["all"] * share - x["fixed"]) / x["open"]
        full = F.col("weight") * level > F.col("source_size") * most_repeats
        if ranked.where(full).count() == x["n"]:
            break
    share_of = F.col("weight") * F.lit(float(level or 0.0))
    limit = (F.col("source_size") * most_repeats).cast("double")
    return ranked.select("source", "source_size", F.least(share_of, limit).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame, levels=LEVELS) -> DataFrame:
    """budgets(source, budget) with `below`: hashes under it sum to the budget as nearly as whole hashes can."""
    left = sum(levels)
    state = budgets.select("source", "budget", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("sum"))
    for width in levels:
        left -= width
        unit = 1 << left
        at = state.select(F.col("source").alias("_s"), "start")
        end = F.col("start") + unit * (1 << width)
        inside = rows.join(at, rows["source"].eqNullSafe(at["_s"]) & (F.col("h") >= F.col("start")) & (F.col("h") < end))
        bucket = F.shiftright(F.col("h") - F.col("start"), left)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("tokens"))
        # At most 2**width buckets of a source meet.
        run = sums.withColumn("upto", F.sum("tokens").over(W.partitionBy("source").orderBy("bucket")))
        run = run.withColumnRenamed("source", "_s")
        both = state.join(run, F.col("source").eqNullSafe(F.col("_s")), "left")
        crossed = F.col("sum") + F.col("upto") > F.col("budget")
        state = both.groupBy("source", "budget", "start", "sum").agg(
            F.min(F.when(crossed, F.struct("bucket", "tokens", "upto"))).alias("hit"), F.max("upto").alias("all")
        )
        start = F.col("start") + F.coalesce(F.col("hit.bucket"), F.lit((1 << width) - 1)) * unit
        before = F.col("sum") + F.coalesce(F.col("hit.upto") - F.col("hit.tokens"), F.lit(0))
        whole = F.col("hit").isNull()
        state = materialize(
            state.select(
                "source",
                "budget",
                F.when(whole, F.col("start") + (1 << width) * unit).otherwise(start).cast("long").alias("start"),
                F.when(whole, F.col("sum") + F.coalesce("all", F.lit(0))).otherwise(before).cast("long").alias("sum"),
                F.when(whole, F.lit(0)).otherwise(F.col("hit.tokens")).cast("long").alias("edge"),
            )
        )
    # The boundary hash itself goes in when that brings the sum nearer.
    nearer = F.col("edge") < 2 * (F.col("budget") - F.col("sum"))
    below = F.when((F.col("edge") > 0) & nearer, F.col("start") + 1).otherwise(F.col("start"))
    return state.select("source", below.alias("below"))


def plan(rows: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """(_s: source, source_size, target, whole: repeats of every document, below: hashes under it get one more)."""
    goal = materialize(targets(rows, weights, most_repeats, share))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_repeats))).otherwise(0)
    goal = goal.withColumn("whole", whole.cast("long"))
    cut = thresholds(rows, goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    goal = goal.join(cut.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return materialize(goal).withColumnRenamed("source", "_s")


def _repeats(most_repeats: int):
    return F.least(F.col("whole") + (F.col("h") < F.col("below")).cast("long"), F.lit(most_repeats)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, repeats, taken."""
    rows = materialize(sized(docs))
    goal = plan(rows, weights, most_repeats, share)
    out = rows.join(goal, F.col("source").eqNullSafe(F.col("_s"))).withColumn("repeats", _repeats(most_repeats))
    return out.select("doc_id", "size", "source", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, most_repeats: int = MOST_REPEATS, share: float = 1.0) -> DataFrame:
    """The rows of docs that the mix takes, with `repeats`: how often (1 to most_repeats)."""
    goal = plan(materialize(sized(docs)), weights, most_repeats, share)
    kept = [c for c in docs.columns if c != "repeats"]
    own = docs.select(F.struct(*kept).alias("_row"), F.col("source").alias("_source"), _hash_of().alias("h"))
    out = own.join(goal, F.col("_source").eqNullSafe(F.col("_s"))).withColumn("repeats", _repeats(most_repeats))
    return out.where("repeats > 0").select("_row.*", "repeats")
