"""Finders over several lines of a page as joins keyed by page: order numbers, echoes, following lines, plates, touches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import dates as D
from . import finders as P
from . import grid


def not_order_numbers(hits: DataFrame, boxes: DataFrame, hint: str) -> DataFrame:
    """hits(page_id, line_no, ...) whose line, nearest line to the left, and nearest line above don't have the hint."""
    own = boxes.select("page_id", "line_no", "l", "t", "r", "b", F.col("text").rlike(hint).alias("hint"))
    pairs = grid.near_pairs(own.drop("hint"), own, 1.5).where("line_no <> line_no_2")
    h = F.col("b") - F.col("t")
    row = F.least("b", "b_2") - F.greatest("t", "t_2") >= 0.5 * F.least(h, F.col("b_2") - F.col("t_2"))
    left = pairs.where(row & (F.col("r_2") <= F.col("l")) & (F.col("l") - F.col("r_2") <= 10 * h)).withColumn("gap", F.col("l") - F.col("r_2")).withColumn("way", F.lit(0))
    above = pairs.where((F.col("b_2") <= F.col("t")) & (F.col("t") - F.col("b_2") <= 1.5 * h) & (F.least("r", "r_2") > F.greatest("l", "l_2"))).withColumn("gap", F.col("t") - F.col("b_2")).withColumn("way", F.lit(1))
    near = left.union(above).withColumn("_n", F.row_number().over(W.partitionBy("page_id", "line_no", "way").orderBy("gap", "line_no_2"))).where("_n = 1 and hint_2")
    bad = near.select("page_id", "line_no").union(own.where("hint").select("page_id", "line_no")).distinct()
    return hits.join(bad, ["page_id", "line_no"], "left_anti")


def birth_echoes(ids: DataFrame, lines: DataFrame, event_words: str = "签发|有效|期限|issue|expir") -> DataFrame:
    """(page_id, line_no, start, end): dates that say the birth date within a resident's number on the same page; lines about
    other events are left out. An equi-join on page and date."""
    t = F.replace("token", F.lit(" "), F.lit(""))
    born = ids.select("page_id", *[F.substring(t, a, n).try_cast("int").alias(c) for c, a, n in (("y", 7, 4), ("m", 11, 2), ("d", 13, 2))]).distinct()
    found = lines.where(~F.coalesce(F.col("text").rlike(f"(?i){event_words}"), F.lit(False))).select("page_id", "line_no", F.explode(D.find(F.col("text"))).alias("x"))
    read = found.select("page_id", "line_no", "x.start", "x.end", F.explode(D.readings(F.col("x.token"))).alias("r")).select("page_id", "line_no", "start", "end", "r.*")
    # Sizes of compressed files tell little of the rows in them: never broadcast.
    return read.join(born.hint("merge"), ["page_id", "y", "m", "d"], "left_semi").select("page_id", "line_no", "start", "end").distinct()


def following_lines(starts: DataFrame, boxes: DataFrame, most: int = 3) -> DataFrame:
    """(page_id, line_no, step, next_no): up to `most` lines that carry on a line: directly below (a height at most), left edges
    a height apart at most, heights within 40 per cent. Each step is one join."""
    h, h2 = F.col("b") - F.col("t"), F.col("b_2") - F.col("t_2")
    fits = (F.col("t_2") >= F.col("b") - 0.5 * h) & (F.col("t_2") > F.col("t")) & (F.col("t_2") - F.col("b") <= h) & (F.abs(F.col("l_2") - F.col("l")) <= h) & (F.greatest(h, h2) <= 1.4 * F.least(h, h2))
    own = boxes.select("page_id", "line_no", "l", "t", "r", "b")
    pairs = grid.near_pairs(own, own, 1.0).where((F.col("line_no") != F.col("line_no_2")) & fits)
    after = pairs.withColumn("_n", F.row_number().over(W.partitionBy("page_id", "line_no").orderBy("t_2", F.abs(F.col("l_2") - F.col("l")), "line_no_2"))).where("_n = 1").select("page_id", F.col("line_no").alias("at"), F.col("line_no_2").alias("next_no"))
    now, out = starts.select("page_id", "line_no", F.col("line_no").alias("at")), None
    for k in range(1, most + 1):
        met = now.join(after, ["page_id", "at"]).select("page_id", "line_no", F.lit(k).alias("step"), "next_no")
        out = met if out is None else out.union(met)
        now = met.select("page_id", "line_no", F.col("next_no").alias("at"))
    return out


def lone_plates(boxes: DataFrame, gap: float = 1.5) -> DataFrame:
    """(page_id, line_no, start, end, token): lines that are a plate of any shape with no other line within gap heights."""
    whole = F.coalesce(F.nullif(F.size(P.alone_plate(F.col("text"))), F.lit(0)), F.size(P.plates(F.col("text"))))
    token = F.when(F.size(P.alone_plate(F.col("text"))) > 0, P.alone_plate(F.col("text"))[0]).otherwise(F.get(P.plates(F.col("text")), F.lit(0)))
    own = boxes.where(whole > 0).select("*", token.alias("x")).where(F.length(F.trim("text")) == F.length("x.token"))
    h = F.col("b") - F.col("t")
    pairs = grid.near_pairs(own, boxes.select("page_id", "line_no", "t", "b"), gap).where((F.col("line_no") != F.col("line_no_2")) & (F.col("t_2") - F.col("b") < gap * h) & (F.col("t") - F.col("b_2") < gap * h))
    return own.join(pairs.select("page_id", "line_no").distinct(), ["page_id", "line_no"], "left_anti").select("page_id", "line_no", "x.start", "x.end", "x.token")


def two_row_plates(boxes: DataFrame, shape: str = r"^[A-Z0-9]{2,4} [A-Z0-9]{2,5}$") -> DataFrame:
    """(page_id, upper_no, lower_no, token): a short line right over another that together read as a plate; each line once."""
    short = boxes.where(F.length(F.trim("text")).between(2, 6) & F.col("text").rlike("^[A-Z0-9 ]+$"))
    own = short.select("page_id", "line_no", "l", "t", "r", "b", F.trim("text").alias("text"))
    h = F.col("b") - F.col("t")
    pairs = grid.near_pairs(own, own, 1.0).where((F.col("t_2") >= F.col("b") - 0.3 * h) & (F.col("t_2") - F.col("b") <= h) & (F.col("t_2") > F.col("t")) & (F.least("r", "r_2") > F.greatest("l", "l_2")))
    token = F.concat_ws(" ", "text", "text_2")
    ok = pairs.withColumn("token", token).where(token.rlike(shape) & token.rlike("[0-9]") & token.rlike("[A-Z]"))
    first = ok.withColumn("_a", F.row_number().over(W.partitionBy("page_id", "line_no").orderBy("t_2", "line_no_2"))).where("_a = 1")
    once = first.withColumn("_b", F.row_number().over(W.partitionBy("page_id", "line_no_2").orderBy(F.desc("t"), "line_no"))).where("_b = 1")
    # A lower line is no upper one of another plate.
    free = once.alias("x").join(once.alias("y"), (F.col("x.page_id") == F.col("y.page_id")) & (F.col("x.line_no") == F.col("y.line_no_2")), "left_anti")
    return free.select("page_id", F.col("line_no").alias("upper_no"), F.col("line_no_2").alias("lower_no"), "token")


def near_anchors(guesses: DataFrame, anchors: DataFrame) -> DataFrame:
    """Guesses with an anchor near by geometry: on their line but not over them; or beside, sharing half the lower height; or
    a height and a half apart at most and two heights sideways. Both have page_id, line_no, start, end, l, t, r, b."""
    h = F.least(F.col("g.b") - F.col("g.t"), F.col("a.b") - F.col("a.t"))
    same = (F.col("g.line_no") == F.col("a.line_no")) & ~((F.col("g.start") < F.col("a.end")) & (F.col("a.start") < F.col("g.end")))
    beside = F.least("g.b", "a.b") - F.greatest("g.t", "a.t") >= 0.5 * h
    dy = F.greatest(F.greatest("g.t", "a.t") - F.least("g.b", "a.b"), F.lit(0))
    dx = F.greatest(F.greatest("g.l", "a.l") - F.least("g.r", "a.r"), F.lit(0))
    near = (F.col("g.page_id") == F.col("a.page_id")) & (same | (F.col("g.line_no") != F.col("a.line_no")) & (beside | (dy <= 1.5 * h) & (dx <= 2 * h)))
    return guesses.alias("g").join(anchors.alias("a"), near, "left_semi")


def covered_glyphs(glyphs: DataFrame, masks: DataFrame) -> DataFrame:
    """glyphs(page_id, line_no, i, x, y) whose centre lies in a mask(page_id, quad)."""
    from ..functions.geometry import contains

    within = (F.col("g.page_id") == F.col("m.page_id")) & contains(F.col("m.quad"), F.col("g.x"), F.col("g.y"))
    return glyphs.alias("g").join(masks.alias("m"), within, "left_semi")


def text_under(glyphs: DataFrame, masks: DataFrame) -> DataFrame:
    """(page_id, id, text): per mask(page_id, id, quad), from its first to its last glyph(page_id, line_no, i, x, y, c) of each
    line, lines parted by ' / '."""
    from ..functions.geometry import bounds, contains

    # The bounds of a mask are worked out once for the mask; only pairs within them meet its quad. (1e-6: no pair is lost by rounding.)
    edged = masks.withColumn("e", bounds(F.col("quad"))).select("page_id", "id", "quad", *[(F.col(f"e.{c}") + by).alias(c) for c, by in zip("ltrb", (-1e-6, -1e-6, 1e-6, 1e-6))])
    near = F.col("g.x").between(F.col("m.l"), F.col("m.r")) & F.col("g.y").between(F.col("m.t"), F.col("m.b"))
    within = (F.col("g.page_id") == F.col("m.page_id")) & near & contains(F.col("m.quad"), F.col("g.x"), F.col("g.y"))
    reach = glyphs.alias("g").join(edged.alias("m"), within).groupBy("g.page_id", "m.id", "g.line_no").agg(F.min("g.i").alias("lo"), F.max("g.i").alias("hi"))
    cut = glyphs.join(reach, ["page_id", "line_no"]).where("i between lo and hi")
    found = cut.groupBy("page_id", "id").agg(F.sort_array(F.collect_list(F.struct("line_no", "i", "c"))).alias("_all"))
    parted = lambda x, k: F.when(F.get("_all", k - 1)["line_no"] != x["line_no"], F.concat(F.lit(" / "), F.coalesce(x["c"], F.lit("")))).otherwise(x["c"])
    return found.select("page_id", "id", F.array_join(F.transform("_all", parted), "").alias("text"))


def tapped(touches: DataFrame, masks: DataFrame) -> DataFrame:
    """(touch_id, id): the topmost mask(page_id, id, draw, l, t, r, b) that holds a touch(touch_id, page_id, x, y); null if none."""
    within = (F.col("p.page_id") == F.col("m.page_id")) & F.col("p.x").between(F.col("m.l"), F.col("m.r")) & F.col("p.y").between(F.col("m.t"), F.col("m.b"))
    return touches.alias("p").join(masks.alias("m"), within, "left").groupBy("p.touch_id").agg(F.max_by("m.id", "m.draw").alias("id"))


def dismissed(found: DataFrame, gone: DataFrame, most: float = 0.5) -> DataFrame:
    """found without what overlaps a dismissed box by more than `most`."""
    w = F.greatest(F.least("f.r", "g.r") - F.greatest("f.l", "g.l"), F.lit(0))
    h = F.greatest(F.least("f.b", "g.b") - F.greatest("f.t", "g.t"), F.lit(0))
    size = lambda x: (F.col(f"{x}.r") - F.col(f"{x}.l")) * (F.col(f"{x}.b") - F.col(f"{x}.t"))
    cond = (F.col("f.page_id") == F.col("g.page_id")) & (w * h > most * (size("f") + size("g") - w * h))
    return found.alias("f").join(gone.alias("g"), cond, "left_anti")


def rerun(plan: DataFrame, again: DataFrame) -> DataFrame:
    """The plan after pages were read again: what users added stays, the rest is taken from the new run of the same pages."""
    manual = F.col("source").isin("MANUAL", "LINE")
    pages = again.select("page_id").distinct()
    return plan.where(manual).union(plan.where(~manual).join(pages, "page_id", "left_anti").select(*plan.columns)).union(again.where(~manual).select(*plan.columns))


def signature_free(hits: DataFrame, lines: DataFrame) -> DataFrame:
    """hits(page_id, line_no, start, end, ...) that don't lie in the bracketed signature at the beginning or end of a line."""
    text = F.col("text")
    head = F.length(F.regexp_extract(text, r"^\s*(?:【[^】]*】|\[[^\]]*\])", 0))
    tail = F.length(text) - F.length(F.regexp_extract(text, r"(?:【[^】]*】|\[[^\]]*\])\s*$", 0))
    both = hits.join(lines.select("page_id", "line_no", head.alias("_head"), tail.alias("_tail")), ["page_id", "line_no"])
    return both.where("`end` > _head and start < _tail").drop("_head", "_tail")


def plausible(kind: Column, quote: Column) -> Column:
    """Whether a quote has the shape of its kind: digits in numbers, letters and few words in names, an @ in mail addresses."""
    digits = F.regexp_count(quote, F.lit("[0-9]"))
    kin = quote.isin("妈妈", "爸爸", "老公", "老婆", "哥哥", "姐姐", "Mom", "Dad", "Mum", "Grandma", "Grandpa")
    name = quote.rlike(r"^[\p{L}·. '’-]{2,40}$") & (F.size(F.split(quote, " ")) <= 5) & ~kin & ~quote.rlike(r"^[a-z]")
    return F.coalesce(
        F.when(kind == "PERSON_NAME", name).when(kind == "PHONE", digits.between(5, 15)).when(kind == "EMAIL", quote.contains("@"))
        .when(kind.isin("PAYMENT_CARD", "ID_NUMBER", "LONG_NUMBER"), digits >= 4).when(kind == "POSTAL_ADDRESS", F.length(quote) >= 5).otherwise(F.length(quote) >= 2), F.lit(False),
    )
