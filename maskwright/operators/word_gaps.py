"""Blanks between words and cuts between glyphs, from the columns of a line's pixels.

Recognisers of text seldom give blanks, and the places of their glyphs are coarse. Both are mended by the columns without ink in
the picture of the line: pixels are counted once per strip in Arrow batches, everything else is native.

Cases: strips without pixels, or whose width is null or no divisor of their size, have no columns: no blanks there, and cuts
half-way between glyphs; null and NaN pixels are paper. Glyphs of strips that are not given likewise. Repeated rows of a strip
count once; glyphs without a place have no cut and no blank, and those around them are judged as neighbours.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Contrast of ink; the width of a blank in heights of the text, by what stands beside it.
INK_CONTRAST = 0.25
BLANK, BLANK_DIGITS, BLANK_LATIN = 0.3, 0.45, 0.6

_RUNS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
PROFILE = "columns array<int>, height int, empty array<struct<a:int,b:int>>"


def ink_of(gray: np.ndarray) -> np.ndarray:
    """Pixels that differ from the paper: the median of 256 levels, the lower one of two."""
    known = ~np.isnan(gray)
    if not known.any():
        return np.zeros(gray.shape, bool)
    levels = (np.clip(gray[known], 0, 1) * 255).astype(np.int64)
    paper = np.searchsorted(2 * np.cumsum(np.bincount(levels, minlength=256)), levels.size) / 255
    return np.abs(np.where(known, gray, paper) - paper) > INK_CONTRAST


def profiles(strips: DataFrame) -> DataFrame:
    """(strip_id, columns, height, empty) of strips(strip_id, width, gray), gray by rows from 0 to 1: the ink of each column, the
    height from the first row with ink to the last (the strip's without ink), and the runs of columns without ink, ends exclusive."""

    def work(batches):
        for batch in batches:
            gray = batch.column("gray")
            pixels = pc.cast(gray.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(gray), 0).to_numpy(zero_copy_only=False))])
            columns, heights, empty = [], [], []
            for i, width in enumerate(batch.column("width").to_pylist()):
                own = pixels[at[i] : at[i + 1]]
                if not width or width < 0 or not own.size or own.size % width:
                    columns.append([]), heights.append(0), empty.append([])
                    continue
                ink = ink_of(own.reshape(-1, width))
                rows, counts = np.nonzero(ink.any(axis=1))[0], ink.sum(axis=0)
                edges = np.diff(np.pad((counts == 0).astype(np.int8), 1))
                columns.append(counts.tolist()), heights.append(int(rows[-1] - rows[0] + 1) if rows.size else ink.shape[0])
                empty.append([{"a": int(a), "b": int(b)} for a, b in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0])])
            out = [batch.column("strip_id"), pa.array(columns, pa.list_(pa.int32())), pa.array(heights, pa.int32()), pa.array(empty, _RUNS)]
            yield pa.RecordBatch.from_arrays(out, names=["strip_id", "columns", "height", "empty"])

    kind = strips.schema["strip_id"].dataType.simpleString()
    return strips.select("strip_id", "width", "gray").mapInArrow(work, f"strip_id {kind}, {PROFILE}")


def widest_gap(empty: Column, width: Column, left: Column, right: Column) -> Column:
    """The width of the widest empty run whose middle lies between left and right; runs at the edges are none. Null without one."""
    inside = F.filter(empty, lambda r: (r["a"] > 0) & (r["b"] < width) & ((r["a"] + r["b"]) / 2 > left) & ((r["a"] + r["b"]) / 2 < right))
    return F.array_max(F.transform(inside, lambda r: r["b"] - r["a"]))


def least_blank(left: Column, right: Column) -> Column:
    """How many heights of the text a gap between two glyphs must have to be a blank; null where none is put.

    Digits need more than characters outside ASCII, Latin letters most; ASCII punctuation never has a blank beside it that the
    recogniser did not give. A glyph of several characters counts as one outside ASCII.
    """
    plain = lambda x: x.rlike("^[\\x00-\\x7F]$")
    word = lambda x: x.rlike("^[A-Za-z0-9]$")
    digit = lambda x: x.rlike("^[0-9]$")
    by_script = F.when(~plain(left) | ~plain(right), BLANK).when(digit(left) & digit(right), BLANK_DIGITS).when(word(left) & word(right), BLANK_LATIN)
    return F.when((left != " ") & (right != " "), by_script)


def cut(columns: Column, empty: Column, left: Column, right: Column) -> Column:
    """Where to cut between glyphs with their middles at left and right.

    The middle of the empty run between them that is nearest to half-way, the first of two; without one the column with least
    ink in the middle half, the nearest to half-way and then the first of several; half-way where there is no column.
    """
    middle, quarter, size = (left + right) / 2, (right - left) / 4, F.size(columns)
    within = lambda x, top: F.greatest(F.lit(0), F.least(x.cast("int"), top))
    lo, hi = within(F.ceil(left), size), within(F.floor(right), size)
    clipped = F.transform(empty, lambda r: F.struct(F.greatest(r["a"], lo).alias("a"), F.least(r["b"], hi).alias("b")))
    centre = lambda r: (r["a"] + r["b"]) / 2
    nearest = F.array_min(F.transform(F.filter(clipped, lambda r: r["a"] < r["b"]), lambda r: F.struct(F.abs(centre(r) - middle).alias("d"), centre(r).alias("x"))))
    first, last = F.greatest(F.lit(0), F.ceil(left + quarter).cast("int")), F.least(F.floor(right - quarter).cast("int"), size - 1)
    ranked = F.transform(F.sequence(first, F.greatest(first, last)), lambda c: F.struct(F.get(columns, c).alias("n"), F.abs(c + 0.5 - middle).alias("d"), (c + 0.5).alias("x")))
    thinnest = F.when(first <= last, F.array_min(ranked)["x"])
    return F.when(size > 0, F.coalesce(nearest["x"], thinnest, middle)).otherwise(middle)


def between(strips: DataFrame, glyphs: DataFrame) -> DataFrame:
    """glyphs(strip_id, pos, token, x) with `blank`, whether a blank belongs in front, and `cut`, the bound towards the glyph before
    it (null for the first). One shuffle of glyphs by strip, which the join with the strips' columns keeps."""
    w = W.partitionBy("strip_id").orderBy("pos")
    # glyphs may have columns of any name: everything of our own is in one struct.
    placed = F.when(F.col("x").isNotNull(), F.struct("token", "x"))
    paired = glyphs.withColumn("_gap", F.last(placed, True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    seen = profiles(strips).dropDuplicates(["strip_id"]).select("strip_id", F.struct("columns", "height", "empty").alias("_strip"))
    left, p = F.col("_gap"), F.col("_strip")
    empty, columns = F.coalesce(p["empty"], F.array().cast("array<struct<a:int,b:int>>")), F.coalesce(p["columns"], F.array().cast("array<int>"))
    blank = widest_gap(empty, F.size(columns), left["x"], F.col("x")) >= p["height"] * least_blank(left["token"], F.col("token"))
    both = paired.join(seen, "strip_id", "left")
    at = F.when(F.col("x").isNotNull() & left.isNotNull(), cut(columns, empty, left["x"], F.col("x")))
    return both.withColumns({"blank": F.coalesce(blank, F.lit(False)), "cut": at}).drop("_gap", "_strip")


def spaced(found: DataFrame) -> DataFrame:
    """(strip_id, text) of what between() found: the glyphs in order with their blanks."""
    piece = F.concat(F.when(F.col("blank"), " ").otherwise(""), F.coalesce("token", F.lit("")))
    return found.groupBy("strip_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda x: x["piece"]), "").alias("text"))


def elements(found: DataFrame, strips: DataFrame) -> DataFrame:
    """The rows of between(strips, glyphs) with `l` and `r`: each glyph from its cut to the next one's; the first and the last reach
    to the strip's edges. Glyphs without a place or without a strip have no box and are left out, blanks of the recogniser too."""
    w = W.partitionBy("strip_id").orderBy("pos")
    ahead = F.struct(F.lag("pos").over(w).isNull().alias("first"), F.lead("pos").over(w).isNull().alias("last"), F.lead("cut").over(w).alias("cut"))
    wide = strips.select("strip_id", F.struct(F.col("width").cast("double").alias("w")).alias("_wide")).dropDuplicates(["strip_id"])
    placed = found.where("x is not null").withColumn("_next", ahead).join(wide, "strip_id").where("token is null or token <> ' '")
    bounds = {"l": F.when(F.col("_next.first"), 0.0).otherwise(F.col("cut")), "r": F.when(F.col("_next.last"), F.col("_wide.w")).otherwise(F.col("_next.cut"))}
    return placed.withColumns(bounds).drop("_next", "_wide")
