"""Detected regions (faces, codes) as tables (page_id, id, l, t, r, b, ...): native projections and joins keyed by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code formats with check digits; others are read by chance too often.
FORMATS = ("QR_CODE", "AZTEC", "DATA_MATRIX", "PDF417", "EAN_13", "EAN_8", "UPC_A", "UPC_E", "CODE_128")


def faces(found: DataFrame, share: float = 0.18, top: float = 1.4) -> DataFrame:
    """Face boxes, wider by a share of their shorter side (more at the top), within the image of (width, height)."""
    by = F.least(F.col("r") - F.col("l"), F.col("b") - F.col("t")) * share
    edges = {"l": F.greatest(F.col("l") - by, F.lit(0.0)), "t": F.greatest(F.col("t") - by * top, F.lit(0.0)), "r": F.least(F.col("r") + by, F.col("width").cast("double")), "b": F.least(F.col("b") + by, F.col("height").cast("double"))}
    return found.withColumns(edges | {"confidence": F.lit(0.95)})


def unturned(found: DataFrame) -> DataFrame:
    """Boxes found on an image turned by `turns` quarters clockwise, in the upright image of (width, height)."""
    k, w, h = F.pmod(F.col("turns"), F.lit(4)), F.col("width"), F.col("height")
    l, t, r, b = (F.col(c) for c in "ltrb")
    pick = lambda a, one, two, three: F.when(k == 1, one).when(k == 2, two).when(k == 3, three).otherwise(a)
    return found.withColumns({"l": pick(l, t, w - r, w - b), "t": pick(t, h - r, h - b, l), "r": pick(r, b, w - l, w - t), "b": pick(b, h - l, h - t, r)})


def _gap(a: str, b: str) -> Column:
    dx = F.greatest(F.greatest(f"{a}.l", f"{b}.l") - F.least(f"{a}.r", f"{b}.r"), F.lit(0))
    dy = F.greatest(F.greatest(f"{a}.t", f"{b}.t") - F.least(f"{a}.b", f"{b}.b"), F.lit(0))
    return F.greatest(dx, dy)


def _long(x: str) -> Column:
    return F.greatest(F.col(f"{x}.r") - F.col(f"{x}.l"), F.col(f"{x}.b") - F.col(f"{x}.t"))


def codes(found: DataFrame, strict: bool = True) -> DataFrame:
    """Codes of allowed formats with confidence and margin. Undecoded ones only stay beside a decoded one of like size, a side's
    length apart at most, or, where not strict, if they look printed."""
    own = found.where(F.col("format").isin(*FORMATS))
    like = F.greatest(_long("u"), _long("d")) <= 1.5 * F.least(_long("u"), _long("d"))
    beside = (F.col("u.page_id") == F.col("d.page_id")) & like & (_gap("u", "d") <= F.greatest(_long("u"), _long("d")))
    open_ = own.where("not decoded").alias("u")
    kept = open_.join(own.where("decoded").alias("d"), beside, "left_semi")
    if not strict:
        kept = kept.union(open_.join(own.where("decoded").alias("d"), beside, "left_anti").where("printed"))
    every = own.where("decoded").union(kept)
    by = 3 + 0.02 * F.least(F.col("r") - F.col("l"), F.col("b") - F.col("t"))
    return every.select("page_id", "id", "format", "decoded", (F.col("l") - by).alias("l"), (F.col("t") - by).alias("t"), (F.col("r") + by).alias("r"), (F.col("b") + by).alias("b"), F.when(F.col("decoded"), 0.98).otherwise(0.5).alias("confidence"))


def distinct_codes(found: DataFrame, most: float = 0.5) -> DataFrame:
    """Greedy: decoded first, then larger; one goes if a decoded one that stays holds more than half of it, or an undecoded one
    overlaps it by more than half. The boxes of a page are folded in one array."""
    rest = [c for c in found.columns if c != "page_id"]
    size = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    one = F.struct((~F.col("decoded")).alias("_d"), (-size).alias("_a"), F.col("id").alias("_i"), F.struct(*rest).alias("x"))
    grouped = found.groupBy("page_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    zero = F.array().cast(f"array<{found.select(F.struct(*rest).alias('x')).schema['x'].dataType.simpleString()}>")
    area = lambda z: (z["r"] - z["l"]) * (z["b"] - z["t"])

    def covered(kept, x):
        def by(k):
            both = F.greatest(F.least(k["r"], x["r"]) - F.greatest(k["l"], x["l"]), F.lit(0)) * F.greatest(F.least(k["b"], x["b"]) - F.greatest(k["t"], x["t"]), F.lit(0))
            return F.when(k["decoded"], both > most * F.least(area(k), area(x))).otherwise(both > most * (area(k) + area(x) - both))

        return F.exists(kept, by)

    kept = F.aggregate("all", zero, lambda out, y: F.when(covered(out, y["x"]), out).otherwise(F.concat(out, F.array(y["x"]))))
    return grouped.select("page_id", F.explode(kept).alias("x")).select("page_id", "x.*")


def spans_of(length: Column, tile: int, overlap: int) -> Column:
    """The starts of tiles that cover a length; the last one ends with it."""
    step = tile - overlap
    last = F.greatest(length - tile, F.lit(0))
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def bands(pages: DataFrame, size: int = 256, overlap: int = 64, *keep: str) -> DataFrame:
    """(page_id, k, top, bottom): overlapping bands over the height of pages(page_id, height), with columns of the pages to keep."""
    starts = spans_of(F.col("height").cast("int"), size, overlap)
    cut = pages.select("*", F.posexplode(starts).alias("k", "top"))
    return cut.select("page_id", *keep, "k", "top", F.least(F.col("top") + size, F.col("height").cast("int")).alias("bottom"))


def merged_tiles(lines: DataFrame, tile: int) -> DataFrame:
    """Lines of tiles (page_id, tile, l, t, r, b) in the coordinates of their page: tiles lie one below the other."""
    by = F.col("tile") * tile
    return lines.withColumns({"t": F.col("t") + by, "b": F.col("b") + by})


def watermark_grid(pages: DataFrame, step_x: int, step_y: int) -> DataFrame:
    """(page_id, row, col, x, y): places of a tiled text around the centre of pages(page_id, width, height), staggered by half a
    step, over the circle around the page, so that it covers the page at any angle."""
    radius = F.hypot(F.col("width"), F.col("height")) / 2
    rows, cols = F.ceil(radius / step_y).cast("int"), (F.ceil(radius / step_x) + 1).cast("int")
    grid = pages.select("page_id", "width", "height", cols.alias("n"), F.explode(F.sequence(-rows, rows)).alias("row")).select("page_id", "width", "height", "row", F.explode(F.sequence(-F.col("n"), F.col("n"))).alias("col"))
    x = F.col("width") / 2 + F.col("col") * step_x + F.when(F.pmod("row", F.lit(2)) == 1, step_x / 2).otherwise(0.0)
    return grid.select("page_id", "row", "col", x.alias("x"), (F.col("height") / 2 + F.col("row") * step_y).alias("y"))


def export_plan(plan: DataFrame, pages: DataFrame, most_pixels: int = 32_000_000) -> DataFrame:
    """plan(page_id, draw, l, t, r, b, style) in the pixels of what is written: pages(page_id, width, height, analysis_scale) are
    reduced by whole factors until they have most_pixels at most; draw keeps its order."""
    down = F.greatest(F.ceil(F.sqrt(F.col("width").cast("double") * F.col("height") / most_pixels)), F.lit(1)).cast("int")
    sized = pages.select("page_id", down.alias("down"), (1 / (F.col("analysis_scale") * down)).alias("by"))
    both = plan.join(sized, "page_id")
    return both.withColumns({c: F.col(c) * F.col("by") for c in "ltrb"}).drop("by")
