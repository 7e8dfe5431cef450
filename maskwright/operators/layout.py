"""Page layout: nearest neighbours, cells, rows, reading order and orientation over boxes (page_id, line_no, l, t, r, b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import grid


def _pairs(boxes: DataFrame, reach: float) -> DataFrame:
    """Each box with the others of its page that are at most reach heights of the taller one above or below, by bands."""
    return grid.near_pairs(boxes, boxes.select("page_id", "line_no", "l", "t", "r", "b"), reach)


def _row_share() -> Column:
    """Vertical overlap as a share of the lower of two boxes."""
    both = F.least("b", "b_2") - F.greatest("t", "t_2")
    return both / F.least(F.col("b") - F.col("t"), F.col("b_2") - F.col("t_2"))


def nearest_right(boxes: DataFrame, reach: float = 10.0, share: float = 0.5) -> DataFrame:
    """(page_id, line_no, right_no): the nearest box to the right on the same row, within reach heights."""
    pairs = _pairs(boxes, 0.0).where((F.col("l_2") >= F.col("r")) & (F.col("l_2") - F.col("r") <= reach * (F.col("b") - F.col("t"))) & (_row_share() >= share))
    w = W.partitionBy("page_id", "line_no").orderBy(F.col("l_2") - F.col("r"), "line_no_2")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("page_id", "line_no", F.col("line_no_2").alias("right_no"))


def nearest_below(boxes: DataFrame, reach: float = 1.5) -> DataFrame:
    """(page_id, line_no, below_no): the nearest box below that shares columns, within reach heights."""
    columns = F.least("r", "r_2") > F.greatest("l", "l_2")
    pairs = _pairs(boxes, reach).where((F.col("t_2") >= F.col("b")) & (F.col("t_2") - F.col("b") <= reach * (F.col("b") - F.col("t"))) & columns)
    w = W.partitionBy("page_id", "line_no").orderBy(F.col("t_2") - F.col("b"), "line_no_2")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("page_id", "line_no", F.col("line_no_2").alias("below_no"))


def wrap_of(boxes: DataFrame) -> DataFrame:
    """(page_id, line_no, wrap_no): the line that continues a line: directly below, of like height, its left within [-3h, +h]."""
    h, h2 = F.col("b") - F.col("t"), F.col("b_2") - F.col("t_2")
    like = (F.greatest(h, h2) <= 1.4 * F.least(h, h2)) & (F.col("t_2") > F.col("t")) & (F.col("t_2") - F.col("b") <= h) & (F.col("l_2") - F.col("l")).between(-3 * h, h)
    pairs = _pairs(boxes, 1.0).where((F.col("line_no") != F.col("line_no_2")) & like)
    w = W.partitionBy("page_id", "line_no").orderBy("t_2", "line_no_2")
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("page_id", "line_no", F.col("line_no_2").alias("wrap_no"))


def labelled_values(boxes: DataFrame, label: str, value: str) -> DataFrame:
    """(page_id, line_no, label_no): lines that match value whole and stand to the right of a label of its own, or else below it."""
    labels = boxes.where(F.col("text").rlike(rf"^\s*(?:{label})\s*[:：]?\s*$")).select("page_id", F.col("line_no").alias("label_no"))
    right = nearest_right(boxes, reach=30.0).withColumnRenamed("line_no", "label_no")
    below = nearest_below(boxes).withColumnRenamed("line_no", "label_no")
    values = boxes.where(F.col("text").rlike(rf"^\s*(?:{value})\s*$")).select("page_id", "line_no")
    placed = labels.join(right, ["page_id", "label_no"], "left").join(below, ["page_id", "label_no"], "left")
    beside = placed.join(values.withColumnRenamed("line_no", "right_no").withColumn("ok", F.lit(True)), ["page_id", "right_no"], "left")
    found = beside.select("page_id", "label_no", F.when(F.col("ok"), F.col("right_no")).otherwise(F.col("below_no")).alias("line_no"))
    return found.join(values, ["page_id", "line_no"], "left_semi").select("page_id", "line_no", "label_no")


def lone(boxes: DataFrame, pattern: str, gap: float = 1.5) -> DataFrame:
    """Lines that match pattern whole with no other line within gap heights."""
    h = F.col("b") - F.col("t")
    own = boxes.where(F.col("text").rlike(f"^(?:{pattern})$"))
    pairs = grid.near_pairs(own, boxes.select("page_id", "line_no", "t", "b"), gap).where((F.col("line_no") != F.col("line_no_2")) & (F.col("t_2") - F.col("b") < gap * h) & (F.col("t") - F.col("b_2") < gap * h))
    return own.join(pairs.select("page_id", "line_no").distinct(), ["page_id", "line_no"], "left_anti")


def cells(chars: DataFrame) -> DataFrame:
    """chars(page_id, line_no, i, l, r, h) with `cell`: a new one where the gap to the character before exceeds its height."""
    w = W.partitionBy("page_id", "line_no").orderBy("i")
    new = F.coalesce((F.col("l") - F.lag("r").over(w) > F.col("h")).cast("int"), F.lit(0))
    return chars.withColumn("_new", new).withColumn("cell", F.sum("_new").over(w)).drop("_new")


def _fold_rows(boxes: DataFrame, order: list, same) -> DataFrame:
    """(page_id, line_no, row): in the given order, a box joins the last row if same(first box of the row, box)."""
    one = F.struct(*[x.cast("double").alias(f"_{i}") for i, x in enumerate(order)], F.col("line_no"), F.col("t").cast("double").alias("t"), F.col("b").cast("double").alias("b"))
    grouped = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(one)).alias("all"))
    kind = boxes.schema["line_no"].dataType.simpleString()
    zero = F.struct(F.lit(None).cast("struct<t:double,b:double>").alias("first"), F.lit(-1).alias("row"), F.array().cast(f"array<struct<line_no:{kind},row:int>>").alias("out"))

    def step(acc, x):
        joins = (acc["row"] >= 0) & F.coalesce(same(acc["first"], x), F.lit(False))
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        first = F.when(joins, acc["first"]).otherwise(F.struct(x["t"].alias("t"), x["b"].alias("b")))
        return F.struct(first.alias("first"), row.alias("row"), F.concat(acc["out"], F.array(F.struct(x["line_no"].alias("line_no"), row.alias("row")))).alias("out"))

    return grouped.select("page_id", F.explode(F.aggregate("all", zero, step, lambda acc: acc["out"])).alias("x")).select("page_id", "x.*")


def rows(boxes: DataFrame, share: float = 0.5) -> DataFrame:
    """(page_id, line_no, row): from the top, a box joins the row if it overlaps the row's first box by more than share."""

    def same(first, x):
        return (F.least(first["b"], x["b"]) - F.greatest(first["t"], x["t"])) / F.least(first["b"] - first["t"], x["b"] - x["t"]) > share

    return _fold_rows(boxes, [F.col("t"), F.col("l")], same)


def mask_rows(boxes: DataFrame) -> DataFrame:
    """(page_id, line_no, row, pos): the order of a list of masks. By their centres, a mask joins the row if it and the row's
    first mask reach over each other's centre line; rows from the top, within a row from the left."""

    def same(first, x):
        a, b = (first["t"] + first["b"]) / 2, (x["t"] + x["b"]) / 2
        return (x["t"] <= a) & (a <= x["b"]) & (first["t"] <= b) & (b <= first["b"])

    placed = _fold_rows(boxes, [(F.col("t") + F.col("b")) / 2, F.col("l")], same).join(boxes.select("page_id", "line_no", "l"), ["page_id", "line_no"])
    return placed.withColumn("pos", F.row_number().over(W.partitionBy("page_id").orderBy("row", "l", "line_no"))).drop("l")


def reading_order(boxes: DataFrame, band: int = 10) -> DataFrame:
    """boxes with `pos`: by bands of ten pixels, then from the left."""
    return boxes.withColumn("pos", F.row_number().over(W.partitionBy("page_id").orderBy(F.floor(F.col("t") / band), "l", "line_no")))


def orientation_groups(lines: DataFrame, tolerance: float = 25, least: int = 3, share: float = 0.15) -> DataFrame:
    """lines(page_id, degrees, length) with `quarter` (0 to 3, null if between) and `group`: the main direction of the page, or
    its own where a direction has enough lines and length."""
    turned = F.pmod(F.round(F.col("degrees") / 90), F.lit(4)).cast("int")
    off = F.abs(F.col("degrees") - F.round(F.col("degrees") / 90) * 90)
    out = lines.withColumn("quarter", F.when(off <= tolerance, turned))
    sums = out.where("quarter is not null").groupBy("page_id", "quarter").agg(F.sum("length").alias("_len"), F.count("*").alias("_n"))
    page = W.partitionBy("page_id")
    ranked = sums.withColumn("_main", F.first("quarter").over(page.orderBy(F.desc("_len"), "quarter"))).withColumn("_all", F.sum("_len").over(page))
    own = (F.col("_n") >= least) & (F.col("_len") >= share * F.col("_all"))
    named = ranked.select("page_id", "quarter", F.when(own, F.col("quarter")).otherwise(F.col("_main")).alias("group"))
    return out.join(named, ["page_id", "quarter"], "left")


def reading_frames(lines: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """(page_id, degrees): the direction with most length within tolerance (the least of equals), and of the lines within
    tolerance of it the circular mean, weighted by length. Window sums over the directions unrolled by a turn each way."""
    turn = F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0)))
    own = F.pmod(F.col("degrees").cast("double"), F.lit(360.0))
    wide = lines.select("page_id", own.alias("d"), F.col("length").cast("double").alias("w")).select("page_id", "d", "w", turn.alias("turn")).withColumn("at", F.col("d") + F.col("turn"))
    near = f"over (partition by page_id order by at range between {float(tolerance)}D preceding and {float(tolerance)}D following)"
    sums = wide.selectExpr("page_id", "d", "turn", f"sum(w) {near} sum", f"sum(w * cos(radians(d))) {near} x", f"sum(w * sin(radians(d))) {near} y").where("turn = 0")
    best = sums.groupBy("page_id").agg(F.max_by(F.struct("x", "y"), F.struct(F.round("sum", 9), -F.col("d"))).alias("b"))
    return best.select("page_id", F.degrees(F.atan2("b.y", "b.x")).alias("degrees"))


def largest_cluster(values: DataFrame, tolerance: float) -> DataFrame:
    """(page_id, n): the most values(page_id, v) that lie within tolerance of the least among them."""
    w = W.partitionBy("page_id").orderBy("v").rangeBetween(0, tolerance)
    return values.withColumn("_n", F.count("*").over(w)).groupBy("page_id").agg(F.max("_n").alias("n"))
