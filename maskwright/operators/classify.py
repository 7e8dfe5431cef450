"""Classification of pages: sure findings stand, guesses only beside something that speaks for a person.

Two phases. All rules run over lines in one projection; what finders marked as guesses found is set apart. Only pages with
guesses are read again for anchors: titles (which must touch the guess), telephone numbers, mail and postal addresses,
numbers of identity cards, masked numbers, labels of persons in Chinese and English, and kinds of tickets (which must be
near it). Anchors count whether or not their rule is on. Guess and anchor meet in bands of the page (grid.near_pairs).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import half_width_digits
from ..sources.shared import once
from . import finders as P
from . import fields, grid
from . import rules as R

# Words that stand beside names.
TITLES = "先生|女士|小姐|太太|夫人|老师|师傅|医生|大夫|教授|经理|主任|同学|阿姨|叔叔|律师|护士|队长|老板"
PERSON_FIELDS = "手机号码?|手机|联系电话|电话|身份证号?|证件号码?|乘客|旅客|入住人|住客|收件|收货|寄件|会员|车主|持卡人|持有人|学生|家长|患者|就诊人|性别|出生|国籍|民族|学号|工号|职务|职称|签名|法定代表人"
TICKETS = "成人票|儿童票|学生票|婴儿票|成人|儿童|学生|婴儿"
ENGLISH_FIELDS = "passengers?|travell?ers?|guests? name|guests?|recipient|attn|attention|customer name|patient|cardholder|account holder|date of birth|dob|nationality|gender|passport|seat|frequent flyer|membership no|member no|mobile|phone|tel|e-?mail|signature|ship to|bill to|deliver to|contact"
MASKED = r"(?<![0-9A-Za-z*＊•●])[0-9]{2,6}[*＊•●xX]{2,}[0-9Xx]{2,6}(?![0-9A-Za-z*＊•●])"
ATTACHED, NEARBY = "attached", "nearby"
_HAN = "一-鿿"
SPANS = "array<struct<start:int,end:int>>"


def _bare(found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))


def titles(text: Column) -> Column:
    return _bare(S.find_spans(text, rf"{S.by_first(TITLES)}|{S.by_first('Mr|Mrs|Ms|Miss|Dr|Prof', behind='(?<![A-Za-z])')}\.?(?![A-Za-z])"))


def nearby_anchors(text: Column) -> Column:
    """The places in a line that speak for a name near by."""
    none = F.array().cast(SPANS)
    # As in rules.hits, finders only run on lines that have what their matches need.
    where = lambda needed, *found: F.when(needed, F.concat(*map(_bare, found))).otherwise(none)
    of_rules = [where(text.rlike(R.NEEDS[rule]), *[f.spans(text) for f in R.BY_ID[rule].finders]) for rule in ("phone", "email", "address")]
    of_rules.append(where(text.rlike("(?=[0-9])(?:[0-9] ?){15}"), P.resident_ids(text)))
    of_rules.append(where(text.contains("("), F.filter(S.find_spans(text, r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6}\([0-9A]\)"), lambda x: R.V.hkid(x["token"]))))
    alone = f"(?<![{_HAN}A-Za-z])"
    words = rf"(?=[0-9]){MASKED}|{S.by_first(f'{R.NAME_LABELS}|{PERSON_FIELDS}', behind=alone)}|{S.by_first(TICKETS, behind=alone)}(?![{_HAN}])|{S.by_first(ENGLISH_FIELDS, True, '(?<![A-Za-z])')}(?![A-Za-z])"
    of_rules.append(_bare(S.find_spans(text, words)))
    may = rf"{R.NEEDS['phone']}|{R.NEEDS['email']}|{R.NEEDS['address']}|(?=[0-9])(?:[0-9] ?){{15}}|\(|{words}"
    return F.when(text.rlike(may), F.concat(*of_rules)).otherwise(none)


def span_box(start: Column, end: Column) -> list[Column]:
    """Edges of a span of a line with columns text, l, t, r, b: its characters share the line's width evenly."""
    pitch = (F.col("r") - F.col("l")).cast("double") / F.greatest(F.length("text"), F.lit(1))
    return [(F.col("l") + pitch * start).alias("l"), F.col("t").cast("double").alias("t"), (F.col("l") + pitch * end).alias("r"), F.col("b").cast("double").alias("b")]


@R.once_per_application
def _marked() -> Column:
    def of(reach, found):
        return F.transform(found, lambda x: F.struct(F.lit(reach).alias("reach"), x["start"].alias("start"), x["end"].alias("end")))

    return F.concat(of(ATTACHED, titles(F.col("_t"))), of(NEARBY, nearby_anchors(F.col("_t"))))


def anchors(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, reach, text, start, end, l, t, r, b) of lines(page_id, line_no, text, l, t, r, b); the text only comes
    with attached ones."""
    read = lines.withColumn("_t", half_width_digits(F.col("text")))
    found = read.withColumn("_a", _marked()).select("page_id", "line_no", "text", "l", "t", "r", "b", F.explode_outer("_a").alias("a")).where("a is not null")
    return found.select("page_id", "line_no", "a.reach", F.when(F.col("a.reach") == ATTACHED, F.col("text")).alias("text"), "a.start", "a.end", *span_box(F.col("a.start"), F.col("a.end")))


def supported(guesses: DataFrame, found: DataFrame) -> DataFrame:
    """Ids of guesses(id, page_id, line_no, start, end, l, t, r, b) that one of the anchors found supports.

    An attached one touches the guess, or blanks only are between. A near one stands elsewhere on the same line; or shares
    half the lower height; or is at most a height and a half above or below and two heights aside, the higher box counting.
    """
    close = guesses.alias("g").join(found.where(F.col("reach") == ATTACHED).alias("a"), ["page_id", "line_no"])
    low, high = F.least(F.col("g.end"), F.col("a.end")), F.greatest(F.col("g.start"), F.col("a.start"))
    touching = close.where(F.trim(F.substring("text", low + 1, F.greatest(high - low, F.lit(0)))) == "").select("id")
    near = found.where(F.col("reach") == NEARBY).drop("reach", "text")
    apart = (F.col("g.end") <= F.col("a.start")) | (F.col("a.end") <= F.col("g.start"))
    beside = guesses.alias("g").join(near.alias("a"), ["page_id", "line_no"]).where(apart).select("id")
    pairs = grid.near_pairs(guesses, near, reach=1.5).where("line_no <> line_no_2")
    h = F.greatest(F.col("b") - F.col("t"), F.col("b_2") - F.col("t_2"))
    dy = F.greatest("t", "t_2") - F.least("b", "b_2")
    dx = F.greatest("l", "l_2") - F.least("r", "r_2")
    around = pairs.where((grid.row_share() >= 0.5) | (dy <= 1.5 * h) & (dx <= 2 * h)).select("id")
    return touching.union(beside).union(around).distinct()


def classify(lines: DataFrame, states: dict[str, str] | None = None, floor: float = 0.5, mask_unanchored: bool = False, forms: bool = False, guesses: DataFrame | None = None) -> DataFrame:
    """Findings of lines(page_id, line_no, text, confidence, l, t, r, b) with their boxes; unsupported guesses are left out.

    (page_id, line_no, rule_id, kind, start, end, token, confidence, guess, enabled, l, t, r, b); enabled is the rule's own
    setting. With forms, values beside and below labels (fields) are findings too, where no finding of their kind lies over
    them: that cuts every line into cells, for pages of documents rather than for running text.
    guesses(page_id, line_no, start, end, token) are names that a recogniser (names) guessed. Lines are read by the rules once: what they found is written to the shared folder. Guesses are few beside the lines: only they,
    their pages' lines and anchors are shuffled. Pages without one aren't read twice.
    """
    read = lines.where(F.col("confidence") >= floor)
    chosen = R.chosen(states)
    found = R.with_hits(read, chosen, True).select("page_id", "line_no", "text", "l", "t", "r", "b", F.explode_outer("_hits").alias("h")).where("h is not null")
    if any(f.guess or getattr(f, "page", False) for r in chosen for f in r.finders):
        found = once(found)
    own_page = R.of_page(F.col("h"), chosen)
    if any(getattr(f, "page", False) for r in chosen for f in r.finders):
        sure = found.where(~own_page & ~R.is_guess(F.col("h"), chosen)).select("page_id", F.col("h.rule_id").alias("_rule")).distinct()
        cued = found.where(own_page).withColumn("_rule", F.col("h.rule_id")).join(sure, ["page_id", "_rule"], "left_semi").select(*found.columns)
        found = found.where(~own_page).unionByName(cued)
    hits = found.select(
        "page_id", "line_no", "h.rule_id", "h.kind", "h.start", "h.end", "h.token", "h.confidence", R.is_guess(F.col("h"), chosen).alias("guess"),
        F.col("h.rule_id").isin(*[r.id for r in chosen if r.enabled]).alias("enabled"), *span_box(F.col("h.start"), F.col("h.end")),
    )
    if forms:
        hits = hits.unionByName(form_values(hits, read, chosen))
    if guesses is not None and "name" in {r.id for r in chosen}:
        at = guesses.join(read.select("page_id", "line_no", "text", "l", "t", "r", "b"), ["page_id", "line_no"])
        own = at.select("page_id", "line_no", F.lit("name").alias("rule_id"), F.lit("PERSON_NAME").alias("kind"), "start", "end", "token", F.lit(0.6).alias("confidence"), F.lit(True).alias("guess"), F.lit(R.BY_ID["name"].enabled).alias("enabled"), *span_box(F.col("start"), F.col("end")))
        same = (F.col("n.page_id") == F.col("h.page_id")) & (F.col("n.line_no") == F.col("h.line_no")) & (F.col("h.kind") == "PERSON_NAME") & (F.col("n.start") < F.col("h.end")) & (F.col("h.start") < F.col("n.end"))
        hits = hits.unionByName(own.alias("n").join(hits.alias("h"), same, "left_anti"))
    if mask_unanchored or guesses is None and not any(f.guess for r in chosen for f in r.finders):
        return hits
    ident = F.struct("page_id", "line_no", "start", "end")
    unsure = hits.where("guess").withColumn("id", ident)
    # Sizes of compressed files tell little of the rows in them: never broadcast.
    pages = read.join(unsure.select("page_id").distinct().hint("merge"), "page_id", "left_semi")
    # Guesses meet anchors in four joins: lines are read for anchors once.
    good = supported(unsure.select("id", "page_id", "line_no", "start", "end", "l", "t", "r", "b"), once(anchors(pages)))
    kept_guesses = unsure.join(good, "id", "left_semi").drop("id")
    return hits.where(~F.col("guess")).unionByName(kept_guesses)


def form_values(hits: DataFrame, lines: DataFrame, chosen: tuple) -> DataFrame:
    """Values of the fields of forms as hits of the rules of their kinds, but for those that hits of the kind lie over."""
    own = {r.kind: r for r in chosen}
    by_kind = lambda of: F.coalesce(*[F.when(F.col("kind") == kind, F.lit(of(rule))) for kind, rule in own.items()])
    found = fields.values(fields.cells_of(lines)).where(F.col("kind").isin(*own))
    placed = found.join(lines.select("page_id", "line_no", "text", "l", "t", "r", "b"), ["page_id", "line_no"]).withColumn("end", (F.col("start") + F.length("token")).cast("int"))
    new = placed.select("page_id", "line_no", by_kind(lambda r: r.id).alias("rule_id"), "kind", F.col("start").cast("int").alias("start"), "end", "token", F.lit(0.8).alias("confidence"), F.lit(False).alias("guess"),
                        by_kind(lambda r: r.enabled).alias("enabled"), *span_box(F.col("start"), F.col("end")))
    same = (F.col("n.page_id") == F.col("h.page_id")) & (F.col("n.line_no") == F.col("h.line_no")) & (F.col("n.kind") == F.col("h.kind")) & (F.col("n.start") < F.col("h.end")) & (F.col("h.start") < F.col("n.end"))
    return new.alias("n").join(hits.where(~F.col("guess")).alias("h"), same, "left_anti")


def supported_within(texts: Column, hits_at, index: Column, hit: Column) -> Column:
    """The same test inside a row, for texts laid out a character of 20 by 20 at a time, a line every 40 (ingest.with_boxes):
    whether a guess of line `index` has an anchor on its line, or on the line before or behind within two characters."""
    own = F.get(texts, index)

    def touches(a):
        low, high = F.least(hit["end"], a["end"]), F.greatest(hit["start"], a["start"])
        return F.trim(F.substring(own, low + 1, F.greatest(high - low, F.lit(0)))) == ""

    apart = lambda a: (hit["end"] <= a["start"]) | (a["end"] <= hit["start"])
    aside = lambda a: F.greatest(hit["start"], a["start"]) - F.least(hit["end"], a["end"]) <= 2
    return F.exists(titles(own), touches) | F.exists(F.get(hits_at, index), apart) | F.exists(F.get(hits_at, index - 1), aside) | F.exists(F.get(hits_at, index + 1), aside)
