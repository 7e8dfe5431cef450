"""Evaluation: found against wanted."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, n / of).otherwise(1.0)


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: outlined, masked and precise shares of spans(page_id, kind, start, end); 1 where there is nothing to divide by.

    found has `enabled`; a hit is of the same kind and overlaps.
    """
    meet = (F.col("f.page_id") == F.col("t.page_id")) & (F.col("f.kind") == F.col("t.kind")) & (F.col("f.start") < F.col("t.end")) & (F.col("t.start") < F.col("f.end"))
    on = found.where("enabled")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        n(truth, "truths"),
        n(on, "masks"),
        n(truth.alias("t").join(found.alias("f"), meet, "left_semi"), "outlined"),
        n(truth.alias("t").join(on.alias("f"), meet, "left_semi"), "masked"),
        n(on.alias("f").join(truth.alias("t"), meet, "left_semi"), "right"),
    ]
    long = [p.select(F.lit(p.columns[0]).alias("name"), F.col(p.columns[0]).alias("n")) for p in parts]
    all_ = long[0]
    for p in long[1:]:
        all_ = all_.union(p)
    pick = lambda name: F.max(F.when(F.col("name") == name, F.col("n")))
    out = all_.agg(*[pick(x).alias(x) for x in ("truths", "masks", "outlined", "masked", "right")])
    c = F.col
    return out.select(_rate(c("outlined"), c("truths")).alias("outline_rate"), _rate(c("masked"), c("truths")).alias("masked_recall"), _rate(c("right"), c("masks")).alias("precision"))


def recall_by_kind(found: DataFrame, truth: DataFrame, cover: float = 0.5, longest: float = 2.0) -> DataFrame:
    """(kind, wanted, hit): a truth is hit if one span covers half of it and is at most twice as long, of whatever kind."""
    both = F.least("f.end", "t.end") - F.greatest("f.start", "t.start")
    size = F.col("t.end") - F.col("t.start")
    meet = (F.col("f.page_id") == F.col("t.page_id")) & (both >= cover * size) & (F.col("f.end") - F.col("f.start") <= longest * size)
    hit = truth.alias("t").join(found.alias("f"), meet, "left_semi").groupBy("kind").agg(F.count("*").alias("hit"))
    return truth.groupBy("kind").agg(F.count("*").alias("wanted")).join(hit, "kind", "left").select("kind", "wanted", F.coalesce("hit", F.lit(0)).cast("long").alias("hit"))


def edit_distance(a: Column, b: Column) -> Column:
    """F.levenshtein, in time linear in the texts where two bounds meet: characters that the other text doesn't have at all
    each cost an edit, and texts of one length are no farther apart than they have places that differ."""
    other = F.greatest(F.length(F.call_function("translate", a, b, F.lit(""))), F.length(F.call_function("translate", b, a, F.lit(""))))
    places = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)), F.lit(0), lambda n, x: n + x)
    return F.when(a == b, 0).when((F.length(a) == F.length(b)) & (other == places), other).otherwise(F.levenshtein(a, b))


def character_error_rate(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, exact, exact_no_space, cer) of pairs(*by, truth, read): whole texts; null counts as empty."""
    truth, read = F.coalesce("truth", F.lit("")), F.coalesce("read", F.lit(""))
    plain = lambda x: F.regexp_replace(x, r"\s+", "")
    edits = edit_distance(truth, read)
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum((truth == read).cast("long")).alias("exact"), F.sum((plain(truth) == plain(read)).cast("long")).alias("exact_no_space"),
        (F.sum(edits) / F.nullif(F.sum(F.length(truth)), F.lit(0))).alias("cer"),
    )


def substring_distance(pairs: DataFrame) -> DataFrame:
    """pairs with `edits`: the least edit distance of truth to any piece of read (semi-global alignment); Arrow batches."""

    def distance(truth: str, read: str) -> int:
        row = np.zeros(len(read) + 1, np.int64)  # an alignment may begin anywhere
        codes = np.array([ord(c) for c in read], np.int64)
        step = np.arange(len(read) + 1)
        for i, c in enumerate(truth):
            best = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
            best = np.concatenate([[i + 1], best])
            row = np.minimum.accumulate(best - step) + step
        return int(row.min())

    def edits(truth: pd.Series, read: pd.Series) -> pd.Series:
        return pd.Series([distance(a or "", b or "") for a, b in zip(truth, read)], dtype="int32")

    return pairs.withColumn("edits", F.pandas_udf(edits, "int")("truth", "read"))


def kind_counts(found: DataFrame, by: str) -> DataFrame:
    """Counts by kind and `by` with subtotals and the total."""
    return found.rollup("kind", by).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def tally(found: DataFrame, truth: DataFrame, most: float = 0.5, inside: float = 0.7) -> DataFrame:
    """(page_id, kind, wanted, hit, extra): greedy one-to-one matches of boxes by falling IoU; IoU of `most` or `inside` of the
    smaller box contained is needed. The candidate pairs of a page and kind are folded in one array."""
    w = F.greatest(F.least("f.r", "t.r") - F.greatest("f.l", "t.l"), F.lit(0))
    h = F.greatest(F.least("f.b", "t.b") - F.greatest("f.t", "t.t"), F.lit(0))
    size = lambda x: (F.col(f"{x}.r") - F.col(f"{x}.l")) * (F.col(f"{x}.b") - F.col(f"{x}.t"))
    iou = w * h / F.nullif(size("f") + size("t") - w * h, F.lit(0))
    near = (F.col("f.page_id") == F.col("t.page_id")) & (F.col("f.kind") == F.col("t.kind")) & ((iou >= most) | (w * h >= inside * F.least(size("f"), size("t"))))
    pairs = found.alias("f").join(truth.alias("t"), near).select("t.page_id", "t.kind", F.struct((-iou).alias("o"), F.col("t.id").alias("t"), F.col("f.id").alias("f")).alias("p"))
    one = pairs.groupBy("page_id", "kind").agg(F.sort_array(F.collect_list("p")).alias("all"))
    zero = F.array().cast(f"array<{pairs.schema['p'].dataType.simpleString()}>")
    taken = F.aggregate("all", zero, lambda out, p: F.when(F.exists(out, lambda o: (o["t"] == p["t"]) | (o["f"] == p["f"])), out).otherwise(F.concat(out, F.array(p))))
    hits = one.select("page_id", "kind", F.size(taken).cast("long").alias("hit"))
    n = lambda df, name: df.groupBy("page_id", "kind").agg(F.count("*").alias(name))
    both = n(truth, "wanted").join(n(found, "all_found"), ["page_id", "kind"], "full").join(hits, ["page_id", "kind"], "left")
    zero_ = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return both.select("page_id", "kind", zero_("wanted").alias("wanted"), zero_("hit").alias("hit"), (zero_("all_found") - zero_("hit")).alias("extra"))


def ensemble(one: DataFrame, other: DataFrame, least: float = 0.6) -> DataFrame:
    """one(page_id, line_no, l, t, r, b, text, confidence) with the text of its best partner in other where that is surer."""
    w = F.greatest(F.least("x.r", "y.r") - F.greatest("x.l", "y.l"), F.lit(0))
    h = F.greatest(F.least("x.b", "y.b") - F.greatest("x.t", "y.t"), F.lit(0))
    size = lambda x: (F.col(f"{x}.r") - F.col(f"{x}.l")) * (F.col(f"{x}.b") - F.col(f"{x}.t"))
    iou = w * h / F.nullif(size("x") + size("y") - w * h, F.lit(0))
    met = one.alias("x").join(other.alias("y"), (F.col("x.page_id") == F.col("y.page_id")) & (iou >= least))
    best = met.groupBy("x.page_id", "x.line_no").agg(F.max_by(F.struct("y.text", "y.confidence"), F.struct(iou, -F.col("y.line_no"))).alias("p"))
    both = one.join(best, ["page_id", "line_no"], "left")
    surer = F.coalesce(F.col("p.confidence") > F.col("confidence"), F.lit(False))
    return both.withColumns({"text": F.when(surer, F.col("p.text")).otherwise(F.col("text")), "confidence": F.greatest("confidence", "p.confidence")}).drop("p")


LONGEST_GAP = 6  # characters between two parts of an address: ", NY, "


def joined_spans(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """Spans of one kind on a line with nothing or one blank between, or, for addresses, a comma and a region code, as one."""
    own = lines.select("page_id", "line_no")
    keys = "page_id, line_no, kind"
    cut = spans.join(own.distinct().hint("merge"), ["page_id", "line_no"], "left_semi")
    reach = F.expr(f"max(`end`) over (partition by {keys} order by start, `end` rows between unbounded preceding and 1 preceding)")
    placed = cut.withColumn("_reach", reach)
    gap = F.col("start") - F.col("_reach")
    # Texts are long beside spans, and compressed ones look small: only spans with a gap that may count meet theirs.
    may = F.coalesce(gap.between(1, F.when(F.col("kind") == "POSTAL_ADDRESS", LONGEST_GAP).otherwise(1)), F.lit(False))
    between = F.substring("text", F.col("_reach") + 1, gap)
    read = placed.where(may).join(lines.select("page_id", "line_no", "text").hint("merge"), ["page_id", "line_no"]).withColumn("_between", between)
    fits = F.col("_between").rlike("^ ?$") | (F.col("kind") == "POSTAL_ADDRESS") & F.col("_between").rlike("^, ?(?:[A-Z]{2},? ?)?$")
    columns = ["page_id", "line_no", "kind", "start", "end"]
    judged = placed.where(~may).select(*columns, F.coalesce(gap <= 0, F.lit(False)).alias("_glued")).unionByName(read.select(*columns, F.coalesce(fits, F.lit(False)).alias("_glued")))
    run = judged.withColumn("_new", (~F.col("_glued")).cast("int")).withColumn("_run", F.expr(f"sum(_new) over (partition by {keys} order by start, `end` rows between unbounded preceding and current row)"))
    return run.groupBy("page_id", "line_no", "kind", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
