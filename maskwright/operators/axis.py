"""The axis along which a page's text runs: its longest direction, unless level or upright lines say otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Windows in degrees, shares of the total length, the least lines of an upright group.
TIGHT, WINDOW, SNAP = 5.0, 15.0, 2.0
MIN_SHARE, LEVEL_SHARE, SQUARE_SHARE, VERTICAL_SHARE, OTHER_SHARE, VERTICAL_LINES = 0.6, 0.25, 0.1, 0.15, 0.25, 3
ELONGATED, SAMPLE = 1.3, 5


def axis_of(degrees: Column) -> Column:
    """A direction as an axis: in (-90, 90]."""
    return 90.0 - F.pmod(90.0 - degrees.cast("double"), F.lit(180.0))


def between_axes(a: Column, b: Column) -> Column:
    """The angle between two axes, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def _modes(lines: DataFrame) -> DataFrame:
    """(page_id, group, mode): per group of lines(page_id, group, line_no, a, length) the axis of the line with most length
    within TIGHT of it, the first of equals. Window sums over the axes unrolled by half a turn each way."""
    turn = F.explode(F.array(F.lit(-180.0), F.lit(0.0), F.lit(180.0)))
    wide = lines.withColumn("turn", turn).withColumn("at", F.col("a") + F.col("turn"))
    near = F.expr(f"sum(length) over (partition by page_id, `group` order by at range between {TIGHT}D preceding and {TIGHT}D following)")
    own = wide.withColumn("near", near).where("turn = 0")
    return own.groupBy("page_id", "group").agg(F.max_by("a", F.struct(F.round("near", 6), -F.col("line_no"))).alias("mode"))


def text_axis(lines: DataFrame) -> DataFrame:
    """(page_id, axis) of lines(page_id, line_no, degrees, length, height), null where no direction prevails.

    Lines twice as long as high vote with their length. An upright group of three lines and 15 per cent wins over others; a
    slanted mode gives way to level or upright lines of 25 per cent, to a squarish group of 10 per cent, and to level where
    a quarter lies elsewhere. The axis is the mean of the lines near the mode, snapped to level and upright.
    """
    own = lines.where((F.col("length") >= 2 * F.col("height")) & (F.col("length") > 0)).select("page_id", "line_no", axis_of(F.col("degrees")).alias("a"), F.col("length").cast("double").alias("length"))
    upright, level = between_axes(F.col("a"), F.lit(90.0)), between_axes(F.col("a"), F.lit(0.0))
    groups = F.array_compact(F.array(F.lit("all"), F.when(upright <= WINDOW, F.lit("upright")), F.when((upright <= WINDOW) | (level <= WINDOW), F.lit("square"))))
    modes = _modes(own.withColumn("group", F.explode(groups))).groupBy("page_id").agg(*[F.max(F.when(F.col("group") == g, F.col("mode"))).alias(g) for g in ("all", "upright", "square")])
    when = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("length"))), F.lit(0.0))
    sums = own.groupBy("page_id").agg(
        F.sum("length").alias("total"), when(level <= SNAP).alias("level"), when(upright <= SNAP).alias("plumb"), when((level <= WINDOW) | (upright <= WINDOW)).alias("squarish"),
        F.count(F.when(upright <= WINDOW, 1)).alias("uprights"), when(upright <= WINDOW).alias("upright_length"),
    )
    page = modes.join(sums, "page_id")
    by_upright = (F.col("uprights") >= VERTICAL_LINES) & (F.col("upright_length") >= VERTICAL_SHARE * F.col("total"))
    page = page.withColumn("mode", F.when(by_upright, F.col("upright")).otherwise(F.col("all")))
    near = own.join(page.select("page_id", "mode"), "page_id").groupBy("page_id").agg(when(between_axes(F.col("a"), F.col("mode")) <= WINDOW).alias("near"))
    page = page.join(near, "page_id")
    mode = F.col("mode")
    slanted, off_level = between_axes(mode, F.lit(90.0)) > WINDOW, between_axes(mode, F.lit(0.0)) > WINDOW
    straight = F.greatest("level", "plumb") >= LEVEL_SHARE * F.col("total")
    squarish = off_level & (F.col("squarish") >= SQUARE_SHARE * F.col("total"))
    square_level = between_axes(F.col("square"), F.lit(0.0)) <= WINDOW
    elsewhere = (F.abs(mode) <= 45) & (F.col("total") - F.col("near") >= OTHER_SHARE * F.col("total"))
    fixed = F.when(slanted & straight, F.when(F.col("level") >= F.col("plumb"), 0.0).otherwise(90.0)).when(slanted & squarish & square_level, 0.0)
    unclear = slanted & ~straight & ~squarish & (F.col("near") < MIN_SHARE * F.col("total"))
    level_out = slanted & ~straight & ~squarish & ~unclear & elsewhere
    decided = page.select("page_id", F.when(level_out, 0.0).otherwise(fixed).alias("fixed"), unclear.alias("unclear"), F.when(slanted & squarish & ~straight, F.col("square")).otherwise(mode).alias("mode"))
    twice = F.radians(2 * F.col("a"))
    tight = own.join(decided, "page_id").where(between_axes(F.col("a"), F.col("mode")) <= TIGHT)
    mean = tight.groupBy("page_id", "fixed", "unclear").agg((F.degrees(F.atan2(F.sum(F.col("length") * F.sin(twice)), F.sum(F.col("length") * F.cos(twice)))) / 2).alias("mean"))
    # Whole degrees stay whole, whatever the noise of sines.
    mean = mean.withColumn("mean", F.round("mean", 9))
    snapped = F.when(F.abs("mean") < SNAP, 0.0).when(F.abs("mean") > 90 - SNAP, 90.0).otherwise(F.col("mean"))
    return mean.select("page_id", F.when(~F.col("unclear"), F.coalesce("fixed", snapped)).alias("axis"))


def fit(degrees: Column, length: Column, height: Column, axis: Column) -> Column:
    """How a box lies to an axis: ALONG, CROSS, SQUARE (too short to tell, its edges with the axis) or OTHER."""
    a = axis_of(degrees)
    along, cross = between_axes(a, axis) <= WINDOW, between_axes(a, axis + 90.0) <= WINDOW
    return F.when(length <= 0, "OTHER").when(length < ELONGATED * height, F.when(along | cross, "SQUARE").otherwise("OTHER")).when(along, "ALONG").when(cross, "CROSS").otherwise("OTHER")


def samples(lines: DataFrame, axes: DataFrame) -> DataFrame:
    """(page_id, line_no, rank): the SAMPLE longest lines within TIGHT of their page's axis, the earlier of equals first."""
    own = lines.where((F.col("length") >= 2 * F.col("height")) & (F.col("length") > 0)).join(axes, "page_id").where(between_axes(axis_of(F.col("degrees")), F.col("axis")) <= TIGHT)
    return own.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("length"), "line_no"))).where(F.col("rank") <= SAMPLE).select("page_id", "line_no", "rank")
