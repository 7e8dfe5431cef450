"""Fronts of identity cards: an anchored layout, with labels that are found although characters of them are lost or wrong.

The row of the number anchors a card: a right number, or a run of digits behind what is left of its label. Rows of sex and
birth stand above it within the height of a card, the name above those, the address between the birth and the number. All
steps are joins by bands of the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spans as S
from . import finders, grid

# The label of the number and the shapes of the rows.
ID_LABEL = "公民身份号码"
_HAN = "一-鿿"
SEX_ROW = "[性别].{0,3}[男女].{0,4}[民族]|^[性别].{0,3}[男女]$"
BIRTH_ROW = "^(?:出生|出|生)[0-9]"
NAME = rf"[{_HAN}]{{2,6}}(?:·[{_HAN}]{{2,6}})?"
NO_NAME = "性别|民族|出生|住址|公民|身份|号码"
CARD_HEIGHT, NAME_GAP, NAME_REACH = 16.0, 2.5, 6.0


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two short texts: rows of the usual table as arrays."""

    def table(x, y):
        zero = F.transform(F.sequence(F.lit(0), F.size(y)), lambda _: F.lit(0))

        def row(above, c):
            def cell(left, j):
                last = F.get(left, F.size(left) - 1)
                value = F.when(F.get(y, j - 1) == c, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), last))
                return F.concat(left, F.array(value))

            return F.aggregate(F.slice(F.sequence(F.lit(0), F.size(y)), F.lit(2), F.size(y)), F.array(F.lit(0)), cell)

        return F.aggregate(x, zero, row, lambda out: F.get(out, F.size(out) - 1))

    chars = lambda v: F.filter(F.split(v, ""), lambda c: c != "")
    return S.let(chars(a), lambda x: S.let(chars(b), lambda y: table(x, y)))


def like_label(text: Column, label: str = ID_LABEL, least: int = 4) -> Column:
    """Whether the ten characters in front of the first digit have `least` characters of the label in their order."""
    head = F.left(F.regexp_extract(F.regexp_replace(text, r"\s", ""), "^[^0-9]*", 0), F.lit(10))
    shared = F.size(F.array_intersect(F.split(head, ""), F.split(F.lit(label), "")))
    # Only heads that share that many characters at all need the table.
    return F.when(shared >= least, lcs(head, F.lit(label)) >= least).otherwise(F.lit(False))


def number_rows(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, l, t, r, b) of the rows with a card's number."""
    text = F.col("text")
    return lines.where((F.size(finders.resident_ids(text)) > 0) | text.rlike("[0-9](?: ?[0-9]){13,16} ?[0-9Xx]") & like_label(text)).select("page_id", "line_no", "l", "t", "r", "b")


def _nearest_above(anchor: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """The lowest of rows above each anchor within the height of a card, as columns name_no, name_l, name_t, name_b."""
    h = F.col("b") - F.col("t")
    pairs = grid.below(anchor, rows, F.col("t") - CARD_HEIGHT * h, F.col("t").cast("double")).where((F.col("line_no_2") != F.col("line_no")) & ((F.col("t_2") + F.col("b_2")) / 2 < F.col("t")))
    best = pairs.withColumn("_n", F.row_number().over(W.partitionBy("page_id", "line_no").orderBy(F.desc("b_2"), "line_no_2"))).where("_n = 1")
    return best.select("page_id", "line_no", *[F.col(f"{c}_2").alias(f"{name}_{s}") for c, s in (("line_no", "no"), ("l", "l"), ("t", "t"), ("b", "b"))])


def fronts(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, kind, start, token, number_no) of names and addresses on cards in lines(page_id, line_no, text, l, t, r, b)."""
    key = ["page_id", "line_no"]
    own = lines.select("page_id", "line_no", "text", *[F.col(c).cast("double").alias(c) for c in "ltrb"])
    bare = F.regexp_replace("text", r"\s", "")
    ids = number_rows(own)
    sex = _nearest_above(ids, own.where(bare.rlike(SEX_ROW)), "sex")
    birth = _nearest_above(ids, own.where(bare.rlike(BIRTH_ROW)), "birth")
    card = ids.join(sex, key, "left").join(birth, key, "left").where("sex_no is not null or birth_no is not null").where("sex_no is null or birth_no is null or (sex_t + sex_b) < (birth_t + birth_b)")
    top = lambda c: F.coalesce(f"sex_{c}", f"birth_{c}")
    low = lambda c: F.coalesce(f"birth_{c}", f"sex_{c}")
    head = card.select("page_id", F.col("line_no").alias("number_no"), F.col("t").alias("number_t"), top("l").alias("l"), top("t").alias("t"), top("b").alias("b"), low("b").alias("low_b"), low("no").alias("low_no"), top("no").alias("line_no"))
    h = F.col("b") - F.col("t")
    near = grid.below(head, own, F.col("t") - (NAME_GAP + 3) * h, F.col("t")).where((F.col("b_2") + F.col("t_2") < 2 * F.col("t")) & (F.col("t") - F.col("b_2") <= NAME_GAP * h) & F.col("l_2").between(F.col("l") - h, F.col("l") + NAME_REACH * h))
    spaced = F.regexp_replace("text_2", rf"(?<=[{_HAN}]) +(?=[{_HAN}])", "")
    value = F.regexp_extract(spaced, rf"^\s*(?:姓名|姓|名)?[：: ]?({NAME})\s*$", 1)
    named = near.withColumn("token", value).where((value != "") & ~value.rlike(NO_NAME))
    first = named.withColumn("_n", F.row_number().over(W.partitionBy("page_id", "number_no").orderBy(F.desc("b_2"), "line_no_2"))).where("_n = 1")
    names = first.select("page_id", F.col("line_no_2").alias("line_no"), F.lit("PERSON_NAME").alias("kind"), "token", "number_no", F.col("text_2").alias("text"))
    between = grid.below(head.withColumn("_h", h), own, F.col("low_b") - F.col("_h"), F.col("number_t")).where(((F.col("t_2") + F.col("b_2")) / 2 > F.col("low_b")) & ((F.col("t_2") + F.col("b_2")) / 2 < F.col("number_t")) & (F.abs(F.col("l_2") - F.col("l")) <= 8 * h))
    place = F.regexp_extract("text_2", r"^\s*(?:住\s*址|住|址)?[：: ]*(\S.*?)\s*$", 1)
    addressed = between.withColumn("token", place).where(finders.has_address_words(F.col("token")) & ~F.col("text_2").rlike(NO_NAME.replace("住址|", "")))
    addresses = addressed.select("page_id", F.col("line_no_2").alias("line_no"), F.lit("POSTAL_ADDRESS").alias("kind"), "token", "number_no", F.col("text_2").alias("text"))
    out = names.unionByName(addresses).dropDuplicates(["page_id", "line_no", "kind"])
    start = F.when(F.instr("text", F.left("token", F.lit(1))) > 0, F.greatest(F.length("text") - F.length(F.ltrim(F.regexp_replace("text", r"^\s*(?:姓\s*名|姓|名|住\s*址|住|址)?[：: ]*", ""))), F.lit(0))).otherwise(0)
    return out.select("page_id", "line_no", "kind", start.cast("int").alias("start"), "token", "number_no")
