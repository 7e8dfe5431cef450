"""Glyphs of pages, what lies under a finger, and selections: a uniform grid instead of all pairs of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import once
from . import grid

CELL = 64.0
MOST_SENT = 200_000
_WIDE = "[ᄀ-ᇿ⺀-鿿가-힯豈-﫿＀-｠　-〿]"


def glyphs_of(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, i, c, space, l, t, r, b) of the characters of lines(page_id, line_no, text, l, t, r, b), blanks left
    out; East Asian characters are twice as wide as others; space: a blank stands in front."""
    chars = lines.select("page_id", "line_no", "l", "t", "r", "b", F.posexplode(F.split("text", "")).alias("i", "c")).where("c <> ''")
    wide = F.when(F.col("c").rlike(_WIDE), 2).otherwise(1)
    order = W.partitionBy("page_id", "line_no").orderBy("i")
    upto, whole = F.sum(wide).over(order), F.sum(wide).over(W.partitionBy("page_id", "line_no"))
    placed = chars.withColumns({"_w": wide, "_upto": upto, "_all": whole, "_ahead": F.coalesce(F.lag("c").over(order), F.lit("x"))})
    unit = (F.col("r") - F.col("l")).cast("double") / F.col("_all")
    out = placed.select("page_id", "line_no", "i", "c", F.col("_ahead").rlike(r"^\s$").alias("space"), (F.col("l") + (F.col("_upto") - F.col("_w")) * unit).alias("l"), F.col("t").cast("double").alias("t"), (F.col("l") + F.col("_upto") * unit).alias("r"), F.col("b").cast("double").alias("b"))
    return out.where(~F.col("c").rlike(r"^\s$"))


def distinct_lines(lines: DataFrame, most: float = 0.5) -> DataFrame:
    """lines(page_id, line_no, confidence, l, t, r, b, ...) without those read twice: of two that share more than `most` of
    their union the less sure one goes, the later of equals."""
    own = lines.select("page_id", "line_no", "confidence", "l", "t", "r", "b")
    pairs = grid.near_pairs(own, own, reach=0.0).where("line_no <> line_no_2")
    both = F.greatest(F.least("r", "r_2") - F.greatest("l", "l_2"), F.lit(0)) * F.greatest(F.least("b", "b_2") - F.greatest("t", "t_2"), F.lit(0))
    union = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t")) + (F.col("r_2") - F.col("l_2")) * (F.col("b_2") - F.col("t_2")) - both
    better = (F.col("confidence_2") > F.col("confidence")) | (F.col("confidence_2") == F.col("confidence")) & (F.col("line_no_2") < F.col("line_no"))
    worse = pairs.where(better & (both > most * union)).select("page_id", "line_no").distinct()
    return lines.join(worse, ["page_id", "line_no"], "left_anti")


def _cells(low: Column, high: Column, cell: float) -> Column:
    return F.sequence(F.floor(low / cell).cast("long"), F.floor(high / cell).cast("long"))


def glyph_at(touches: DataFrame, glyphs: DataFrame, reach: float, cell: float = CELL) -> DataFrame:
    """(touch_id, glyph): of touches(touch_id, page_id, x, y) that hit one of glyphs(page_id, glyph, l, t, r, b): the smallest
    that holds the point, else the nearest within reach; the first of equals. Glyphs lie in every cell that they, grown by
    reach, touch, so that a point meets the glyphs of its own cell only. Places touched many times meet them once; up to MOST_SENT
    places are sent to the glyphs, which are not shuffled then."""
    places = once(touches.select("page_id", "x", "y").distinct())
    few = places.count() <= MOST_SENT
    spread = glyphs.select("page_id", "glyph", "l", "t", "r", "b", F.explode(_cells(F.col("l") - reach, F.col("r") + reach, cell)).alias("_cx")).withColumn("_cy", F.explode(_cells(F.col("t") - reach, F.col("b") + reach, cell)))
    points = places.select("page_id", "x", "y", F.floor(F.col("x") / cell).cast("long").alias("_cx"), F.floor(F.col("y") / cell).cast("long").alias("_cy"))
    pairs = spread.join(F.broadcast(points) if few else points.hint("merge"), ["page_id", "_cx", "_cy"])
    dx, dy = F.greatest(F.col("l") - F.col("x"), F.col("x") - F.col("r"), F.lit(0)), F.greatest(F.col("t") - F.col("y"), F.col("y") - F.col("b"), F.lit(0))
    far = (dx * dx + dy * dy).cast("double")
    size = F.when(far == 0, (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))).otherwise(0).cast("double")
    found = pairs.where(far <= reach * reach).groupBy("page_id", "x", "y").agg(F.min(F.struct(far.alias("far"), size.alias("size"), "glyph"))["glyph"].alias("glyph"))
    return touches.join(F.broadcast(found) if few else found.hint("merge"), ["page_id", "x", "y"]).select("touch_id", "glyph")


def glyphs_along(strokes: DataFrame, glyphs: DataFrame, reach: float, step: float) -> DataFrame:
    """(stroke_id, glyph, first): glyphs under strokes(stroke_id, page_id, x0, y0, x1, y1), probed every step, with the number of
    the first probe that hits each."""
    n = F.greatest(F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / step), F.lit(1)).cast("int")
    probes = strokes.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = F.col("_k") / F.col("_n")
    points = probes.select(F.struct("stroke_id", "_k").alias("touch_id"), "page_id", (F.col("x0") + (F.col("x1") - F.col("x0")) * at).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * at).alias("y"))
    return glyph_at(points, glyphs, reach).groupBy(F.col("touch_id.stroke_id").alias("stroke_id"), "glyph").agg(F.min("touch_id._k").alias("first"))


def toggled(selected: DataFrame, touched: DataFrame) -> DataFrame:
    """What is selected after touched(page_id, glyph) change sides: the symmetric difference of both sets."""
    key = ["page_id", "glyph"]
    return selected.select(key).join(touched, key, "left_anti").union(touched.select(key).distinct().join(selected, key, "left_anti"))


def swept(selected: DataFrame, touched: DataFrame, select: bool) -> DataFrame:
    """What is selected after a stroke that selects, or takes away, all it touches."""
    key = ["page_id", "glyph"]
    return selected.select(key).union(touched.select(key)).distinct() if select else selected.select(key).join(touched, key, "left_anti")


def runs(selected: DataFrame, glyphs: DataFrame, gap: float = 1.0) -> DataFrame:
    """(page_id, run, first, last, l, t, r, b): one box per stretch of selected(page_id, glyph): neighbours of a line whose gap is
    at most `gap` times the lower height. glyphs(page_id, glyph, line_no, l, t, r, b) are numbered in reading order."""
    order = W.partitionBy("page_id").orderBy("glyph")
    at = glyphs.join(selected, ["page_id", "glyph"], "left_semi")
    before = lambda c: F.lag(c).over(order)
    low = F.least(F.col("b") - F.col("t"), before("b") - before("t"))
    goes_on = (before("glyph") == F.col("glyph") - 1) & (before("line_no") == F.col("line_no")) & (F.col("l") - before("r") <= gap * low)
    cut = at.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("run", F.sum("_new").over(order))
    return cut.groupBy("page_id", "run").agg(F.min("glyph").alias("first"), F.max("glyph").alias("last"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
