"""Fields of forms: labels from a dictionary, in several languages and with typing errors, and the values that go with them.

A page is a table of cells, pieces of a line parted by gaps wider than a character is high. Labels are found by a hash join,
not by a pattern per label: a phrase and an entry of the dictionary that are one deletion, insertion, change or swap of
neighbours apart share a key among their deletion neighbourhoods, and the pair is then verified. Labels of one field that
only joints part (姓名 / Name) are one label with its translations; labels of different fields joined by slashes are the
header row of a table and have no value of their own. A value stands behind its label in the cell, else in the cell to the
right, else in the column below.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spans as S
from ..sources.shared import once
from . import grid

_HAN = "一-鿿"
#: Labels of so many letters or more may have one error.
FUZZY_FROM = 7
LONGEST = 34
_JOINT = r"[ \t　/／|｜()（）.・·]*"
_SEPARATOR = r"[ \t　]*[:：#=][ \t　]*"
#: Words at a value's place that ask for one.
PROMPT = r"^(?:请|填写|输入|选择|点击|必填|选填|未填写|(?i:enter|select|choose|required|optional|type here|tap|click|please|n/?a$|none$))"


@dataclass(frozen=True)
class Field:
    """A field: its labels, what its value looks like, and the kind of finding it is (none: it only parts columns)."""

    name: str
    labels: tuple[str, ...]
    value: str = ".+"
    kind: str | None = None
    below: int = 1  # lines that a value below may have


_NAME = rf"(?:[A-Z][A-Za-z'’-]*\.?(?:[ ,]+[A-Z][A-Za-z'’-]*\.?){{0,4}}|[{_HAN}·]{{2,10}})"
_DATE = rf"[0-9{_HAN}][0-9A-Za-z {_HAN}./-]{{5,24}}"
# Labels of documents and forms.
FIELDS = (
    Field("name", ("Name", "Full Name", "Surname", "Given Names", "Given Name", "First Name", "Last Name", "Family Name", "Holder", "Nome", "姓名", "收货人", "收件人", "联系人", "持证人"), _NAME, "PERSON_NAME", 2),
    Field("birth", ("Date of Birth", "Birth Date", "Birthday", "DOB", "Data de Nascimento", "出生日期", "出生年月日", "生日"), _DATE, "BIRTH_DATE"),
    Field("birth_place", ("Place of Birth", "Birthplace", "出生地"), r".{2,40}", "POSTAL_ADDRESS"),
    Field("address", ("Address", "Home Address", "Shipping Address", "Billing Address", "Domicile", "Morada", "住址", "地址", "收货地址", "详细地址"), r".{4,60}", "POSTAL_ADDRESS", 3),
    Field("id_number", ("ID No", "ID Number", "Identity Number", "证件号码", "身份证号", "公民身份号码"), r"[0-9A-Z][0-9A-Z*()-]{4,19}", "ID_NUMBER"),
    Field("passport", ("Passport No", "Passport Number", "Document Number", "护照号", "护照号码"), r"[A-Z]{0,3}[0-9][A-Z0-9]{4,11}", "PASSPORT"),
    Field("plate", ("Plate No", "License Plate", "号牌号码", "车牌号"), r"[A-Z0-9一-鿿][A-Z0-9· -]{4,9}", "LICENSE_PLATE"),
    Field("vin", ("VIN", "Vehicle Identification Number", "车辆识别代号"), r"[A-Z0-9]{17}", "VIN"),
    Field("engine", ("Engine No", "Engine Number", "发动机号码"), r"[A-Z0-9]{6,12}", "VIN"),
    Field("sex", ("Sex", "Gender", "Sexo", "性别")),
    Field("nationality", ("Nationality", "国籍", "民族")),
    Field("issued", ("Date of Issue", "Issue Date", "Register Date", "签发日期", "注册日期")),
    Field("expiry", ("Date of Expiry", "Expiry Date", "Valid Until", "Valid From", "Valid Period", "有效期限", "有效期至")),
    Field("authority", ("Authority", "Issuing Authority", "签发机关")),
    Field("class", ("Class", "Vehicle Type", "准驾车型", "车辆类型")),
    Field("owner", ("Owner", "所有人"), _NAME, "PERSON_NAME"),
)


def cells_of(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, cell, start, text, l, t, r, b) of lines(page_id, line_no, text, l, t, r, b), whose characters share
    the width evenly: a new cell where a gap is wider than the line is high."""
    pitch = (F.col("r") - F.col("l")).cast("double") / F.greatest(F.length("text"), F.lit(1))
    words = lines.select("page_id", "line_no", "text", "l", "t", "b", pitch.alias("pitch"), F.explode(S.find_spans(F.col("text"), r"\S+")).alias("x"))
    order = W.partitionBy("page_id", "line_no").orderBy("x.start")
    gap = (F.col("x.start") - F.lag("x.end").over(order)) * F.col("pitch") > F.col("b") - F.col("t")
    cut = words.withColumn("cell", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(order).cast("int"))
    joined = cut.groupBy("page_id", "line_no", "cell").agg(F.min("x.start").alias("start"), F.max("x.end").alias("end"), *[F.first(c).alias(c) for c in ("text", "l", "t", "b", "pitch")])
    text = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    return joined.select("page_id", "line_no", "cell", "start", text.alias("text"), (F.col("l") + F.col("start") * F.col("pitch")).alias("l"), F.col("t").cast("double").alias("t"), (F.col("l") + F.col("end") * F.col("pitch")).alias("r"), F.col("b").cast("double").alias("b"))


def compact(text: Column) -> Column:
    """Small letters, & and Han only; rn counts as the m that it is read as."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"[^a-z&{_HAN}]", ""), "rn", "m")


def deletions(word: Column) -> Column:
    """The word, and if it may have an error also the word less each of its characters."""
    without = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.left(word, i - 1), F.substring(word, i + 1, F.length(word))))
    fuzzy = (F.length(word) >= FUZZY_FROM - 1) & ~word.rlike(f"[{_HAN}]")
    return F.when(fuzzy, F.array_distinct(F.concat(F.array(word), without))).otherwise(F.array(word))


def within_one(a: Column, b: Column) -> Column:
    """One deletion, insertion or change at most, or one swap of neighbours."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.left(a, i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (F.levenshtein(a, b) <= 1) | (F.length(a) == F.length(b)) & swapped


def dictionary(spark: SparkSession, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """(key, field, entry, upper): an entry per key of its deletion neighbourhood; upper is how many capitals it must begin with."""
    rows = []
    for f in fields:
        for label in f.labels:
            head = label.split(" ")[0]
            rows.append((f.name, label, len(head) if head.isascii() and head.isupper() and len(head) <= 3 else 0))
    base = spark.createDataFrame(rows, "field string, label string, upper int").withColumn("entry", compact(F.col("label")))
    return base.select(F.explode(deletions(F.col("entry"))).alias("key"), "field", "entry", "upper").distinct()


def _phrases(text: Column) -> Column:
    """(start, end) of phrases that may be labels: up to four Latin words from the beginning of a cell, a separator or Han
    on, up to a separator, Han or the end; from any other word on only up to a colon; and the first characters of Han runs."""
    words = S.find_spans(text, r"[A-Za-z&'’]+\.?")

    def from_words(w):
        def of(x, i):
            def upto(n):
                end = F.get(w, i + n)["end"]
                return F.struct(x["start"].alias("start"), end.alias("end"))

            return F.filter(F.transform(F.sequence(F.lit(0), F.lit(3)), upto), lambda p: p["end"].isNotNull())

        first = lambda x: S.before(text, x["start"], 3).rlike(rf"(?:^|[:：/／|｜(（{_HAN}]|[:：/／|｜(（{_HAN}][1lI])[ 　]*$")
        begins = lambda x: (S.before(text, x["start"], 1) == " ") | first(x)
        found = F.flatten(F.transform(w, lambda x, i: F.when(begins(x), of(x, i)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))))

        def fits(p):
            value = F.substring(text, p["start"] + 1, p["end"] - p["start"])
            behind = S.after(text, p["end"], 3)
            at = behind.rlike("^[ 　]*[:：]") | first(p) & behind.rlike(rf"^[ 　]*(?:$|[/／|｜)）#=(（{_HAN}])")
            return (p["end"] - p["start"] <= LONGEST) & value.rlike(r"^[A-Za-z&'’. ]+$") & at

        return F.filter(found, fits)

    runs = S.find_spans(text, rf"[{_HAN}]+")
    prefixes = F.flatten(F.transform(runs, lambda x: F.transform(F.sequence(F.lit(2), F.greatest(F.least(x["end"] - x["start"], F.lit(8)), F.lit(2))), lambda n: F.struct(x["start"].alias("start"), (x["start"] + n).alias("end")))))
    plain = lambda a: F.transform(a, lambda p: F.struct(p["start"].cast("int").alias("start"), p["end"].cast("int").alias("end")))
    return F.concat(plain(S.let(words, from_words)), plain(prefixes))


def labels_in(cells: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """(page_id, line_no, cell, field, from, to, translated, header) of the labels of cells, with their translations.

    from and to are places within the cell. A hash join with the deletion neighbourhoods of the dictionary, whose size
    doesn't depend on the input; then the longest phrase from each place, and none within another.
    """
    spark = cells.sparkSession
    entries = dictionary(spark, fields)
    if sum(len(f.labels) for f in fields) <= 10_000:
        entries = F.broadcast(entries)
    at = cells.select("page_id", "line_no", "cell", "text", F.explode(_phrases(F.col("text"))).alias("p"))
    phrase = F.substring("text", F.col("p.start") + 1, F.col("p.end") - F.col("p.start"))
    tried = at.select("page_id", "line_no", "cell", "text", F.col("p.start").alias("from"), F.col("p.end").alias("to"), phrase.alias("phrase")).withColumn("word", compact(F.col("phrase"))).where("word <> ''")
    met = tried.withColumn("key", F.explode(deletions(F.col("word")))).join(entries, "key")
    exact = F.col("word") == F.col("entry")
    fuzzy = (F.length("entry") >= FUZZY_FROM) & within_one(F.col("word"), F.col("entry"))
    capitals = (F.col("upper") == 0) | (F.length(F.regexp_extract(F.regexp_replace("phrase", "[^A-Za-z]", ""), "^[A-Z]*", 0)) >= F.col("upper"))
    good = met.where((exact | fuzzy) & capitals)
    # One field per phrase (an exact one first); then the longest phrase from each place.
    best = F.row_number().over(W.partitionBy("page_id", "line_no", "cell", "from").orderBy(F.desc("to"), F.desc(exact), "field"))
    longest = good.withColumn("_n", best).where("_n = 1")
    order = W.partitionBy("page_id", "line_no", "cell").orderBy("from")
    reach = F.max("to").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = longest.where("`from` >= 0").withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("from") >= F.col("_reach")))
    between = F.substring("text", F.lag("to").over(order) + 1, F.col("from") - F.lag("to").over(order))
    joined = F.coalesce(between.rlike(f"^{_JOINT}[1lI]?{_JOINT}$"), F.lit(False))
    same = joined & (F.lag("field").over(order) == F.col("field"))
    slash = F.coalesce(joined & between.rlike("[/／|｜]") & (F.lag("field").over(order) != F.col("field")), F.lit(False))
    marked = apart.withColumn("_new", (~same).cast("int")).withColumn("_slash", slash)
    grouped = marked.withColumn("_group", F.sum("_new").over(order)).withColumn("_row", F.max(F.col("_slash").cast("int")).over(W.partitionBy("page_id", "line_no", "cell")))
    return grouped.groupBy("page_id", "line_no", "cell", "_group").agg(F.first("field").alias("field"), F.min("from").alias("from"), F.max("to").alias("to"), (F.count("*") > 1).alias("translated"), (F.max("_row") > 0).alias("header")).drop("_group")


def _by_field(fields, of) -> Column:
    out = F.lit(None).cast("string")
    for f in fields:
        if (value := of(f)) is not None:
            out = F.when(F.col("field") == f.name, F.lit(value)).otherwise(out)
    return out


def _value_at(text: Column, start: Column, fields, whole: bool = False) -> Column:
    """The value of the row's field that begins at start (null: none), up to the end of the text."""
    rest = F.substring(text, start + 1, F.length(text))
    pattern = F.concat(F.lit("^(?:"), _by_field(fields, lambda f: f.value), F.lit(r")[ 　]*$" if whole else ")"))
    value = F.rtrim(F.call_function("regexp_extract", rest, pattern, F.lit(0)), F.lit(" 　"))
    return F.when((value != "") & ~rest.rlike(PROMPT), value)


def labelled(cells: DataFrame, fields: tuple[Field, ...] = FIELDS, labels: DataFrame | None = None) -> DataFrame:
    """(page_id, line_no, cell, field, kind, start, token, way) of values behind their labels ('line') or to their right ('right').

    In a cell a Latin label needs a separator, a Han one none. A label that ends its cell looks right: the nearest cell on the
    row within ten heights, one over 2.5 heights tall only for want of another, unless that is a label itself.
    """
    found = once(labels_in(cells, fields)) if labels is None else labels
    order = W.partitionBy("page_id", "line_no", "cell").orderBy("from")
    # A value ends where the next label begins.
    # Labels of many pages are few bytes in a file: tables of them and of cells meet by a shuffle, never by a broadcast.
    bounded = found.withColumn("_next", F.lead("from").over(order)).where("not header").hint("merge").join(cells, ["page_id", "line_no", "cell"])
    upto = F.when(F.col("_next").isNull(), F.col("text")).otherwise(F.left("text", F.col("_next")))
    rest = F.substring("text", F.col("to") + 1, F.length("text"))
    skipped = F.length(F.regexp_extract(rest, f"^(?:[)）]?{_SEPARATOR}|[)）]?[ 　]*)", 0))
    begins = F.col("to") + skipped
    may = rest.rlike(f"^[)）]?{_SEPARATOR}") | F.substring("text", F.col("from") + 1, F.lit(1)).rlike(f"[{_HAN}]") & (F.col("to") < F.length("text"))
    kinds = _by_field(fields, lambda f: f.kind)
    inside = bounded.where(may).withColumn("token", _value_at(upto, begins, fields)).where("token is not null")
    line = inside.select("page_id", "line_no", "cell", "field", kinds.alias("kind"), (F.col("start") + begins).cast("int").alias("start"), "token", F.lit("line").alias("way"), F.col("from").alias("_from"))
    last = bounded.where((F.col("_next").isNull()) & rest.rlike(f"^[)）]?(?:{_SEPARATOR})?[ 　]*$")).select("page_id", "line_no", "cell", "field", "l", "t", "r", "b")
    other = cells.select("page_id", "line_no", "cell", "start", "text", "l", "t", "r", "b")
    h = F.col("b") - F.col("t")
    beside = grid.near_pairs(last, other, reach=0.0).where((F.col("line_no") != F.col("line_no_2")) | (F.col("cell") != F.col("cell_2")))
    beside = beside.where((grid.row_share() >= 0.5) & ((F.col("l_2") + F.col("r_2")) / 2 > F.col("r")) & (F.col("l_2") - F.col("r") <= 10 * h))
    tall = (F.col("b_2") - F.col("t_2") > 2.5 * h).cast("int")
    nearest = beside.withColumn("_n", F.row_number().over(W.partitionBy("page_id", "line_no", "cell", "field").orderBy(tall, "l_2", "line_no_2", "cell_2"))).where("_n = 1")
    named = found.select("page_id", F.col("line_no").alias("line_no_2"), F.col("cell").alias("cell_2")).distinct()
    free = nearest.join(named.hint("merge"), ["page_id", "line_no_2", "cell_2"], "left_anti").withColumn("token", _value_at(F.col("text_2"), F.lit(0), fields)).where("token is not null")
    right = free.select("page_id", F.col("line_no_2").alias("line_no"), F.col("cell_2").alias("cell"), "field", kinds.alias("kind"), F.col("start_2").alias("start"), "token", F.lit("right").alias("way"))
    return line.drop("_from").unionByName(right)


def stacked(cells: DataFrame, fields: tuple[Field, ...] = FIELDS, labels: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(page_id, line_no, cell, field, kind, step, label_line, start, token): values in the column below labels that have none behind them.

    A frontier of one cell per label goes down, a join by bands each step, as many steps as the fields' values may have
    lines. The column reaches from two heights left of the label to the next label of its row. The next cell is the topmost
    one that begins in the column under the last one, a height and a half below it at most, no more than three label heights
    tall (watermarks), and itself no label. The gap of the first step rules the next ones: a wider one ends the block.
    """
    found = once(labels_in(cells, fields)) if labels is None else labels
    whole = found.hint("merge").join(cells, ["page_id", "line_no", "cell"])
    row = W.partitionBy("page_id", "line_no").orderBy("l")
    label = whole.withColumn("_l", F.col("l") + (F.col("r") - F.col("l")) * F.col("from") / F.greatest(F.length("text"), F.lit(1)))
    stops = label.select("page_id", "line_no", "cell", "field", "from", "_l").withColumn("stop", F.coalesce(F.lead("_l").over(W.partitionBy("page_id", "line_no").orderBy("_l")), F.lit(float("inf"))))
    steps = F.lit(1)
    for f in fields:
        steps = F.when(F.col("field") == f.name, f.below if f.kind else 0).otherwise(steps)
    ends = F.col("to") + F.length(F.regexp_extract(F.substring("text", F.col("to") + 1, F.length("text")), f"^[)）]?(?:{_SEPARATOR})?[ 　]*", 0)) >= F.length("text")
    open_ = label.where(ends | F.col("header")).drop("_l").join(stops.hint("merge"), ["page_id", "line_no", "cell", "field", "from"]).withColumn("_steps", steps).where("_steps > 0")
    frontier = open_.select("page_id", "field", F.col("line_no").alias("label_line"), F.col("cell").alias("label_cell"), "from", "stop", "_steps", F.col("_l").alias("left"), F.least("r", F.col("_l") + 6 * (F.col("b") - F.col("t"))).alias("edge"),
                            (F.col("b") - F.col("t")).alias("h"), "t", "b", F.lit(None).cast("double").alias("first"))
    named = found.select("page_id", F.col("line_no").alias("line_no_2"), F.col("cell").alias("cell_2")).distinct()
    other = cells.select("page_id", "line_no", "cell", "start", "text", "l", "t", "r", "b")
    key = ["page_id", "label_line", "label_cell", "from", "field"]
    out = None
    for step in range(1, (most or max(f.below for f in fields if f.kind)) + 1):
        own, tall = F.col("b") - F.col("t"), F.col("b_2") - F.col("t_2")
        pairs = grid.below(frontier.where(F.col("_steps") >= step), other, F.col("b") - 1.5 * F.col("h") - 0.5 * own, F.col("b") + 4.5 * F.col("h"))
        under = (F.col("t_2") + F.col("b_2")) / 2 > (F.col("t") + F.col("b")) / 2 + 0.5 * own
        near = F.col("t_2") - F.col("b") <= 1.5 * F.greatest(F.col("h"), tall)
        column = (F.col("l_2") + F.least(F.col("r_2") - F.col("l_2"), F.col("h")) / 2).between(F.col("left") - 2 * F.col("h"), F.col("stop")) & (F.col("l_2") < F.col("stop")) & (F.col("l_2") <= F.col("edge") + F.col("h"))
        fits = pairs.where(under & near & column & (tall <= 3 * F.col("h")) & ((F.col("line_no_2") != F.col("label_line")) | (F.col("cell_2") != F.col("label_cell"))))
        top = fits.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("t_2", "l_2", "line_no_2", "cell_2"))).where("_n = 1")
        gap = F.greatest(F.col("t_2") - F.col("b"), F.lit(0.0))
        even = F.col("first").isNull() | (gap <= F.greatest(1.5 * F.col("first"), 0.3 * F.col("h")))
        kept = top.where(even).join(named.hint("merge"), ["page_id", "line_no_2", "cell_2"], "left_anti").where(~F.col("text_2").rlike(r"[:：*][ 　]*$")).withColumn("token", _value_at(F.col("text_2"), F.lit(0), fields)).where("token is not null")
        hit = kept.select("page_id", F.col("line_no_2").alias("line_no"), F.col("cell_2").alias("cell"), "field", _by_field(fields, lambda f: f.kind).alias("kind"), F.lit(step).alias("step"), "label_line", F.col("start_2").alias("start"), "token")
        out = hit if out is None else out.unionByName(hit)
        frontier = kept.select(*key, "stop", "_steps", "left", "edge", "h", F.col("t_2").alias("t"), F.col("b_2").alias("b"), F.coalesce("first", gap).alias("first"))
    return out


def values(cells: DataFrame, fields: tuple[Field, ...] = FIELDS) -> DataFrame:
    """(page_id, line_no, field, kind, start, token) of all values of fields that are findings, each once."""
    found = once(labels_in(cells, fields))
    columns = ["page_id", "line_no", "field", "kind", "start", "token"]
    both = labelled(cells, fields, found).select(*columns).unionByName(stacked(cells, fields, found).select(*columns))
    return both.where("kind is not null").dropDuplicates(["page_id", "line_no", "kind", "start"])
