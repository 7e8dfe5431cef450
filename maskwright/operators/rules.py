"""The catalogue of rules: what is sensitive in a line, as data.

A rule is a list of finders, each an expression that gives spans with a confidence. All rules of a catalogue run in one
projection over lines: nothing is shuffled and no Python runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, mrz
from ..functions import spans as S
from ..functions import validators as V
from ..functions.text import LONE_HAN, half_width_digits, han_view, in_source
from . import finders as P

HIT = "struct<rule_id:string,kind:string,rule_ord:int,finder_ord:int,start:int,end:int,token:string,confidence:double>"


@dataclass(frozen=True)
class Finder:
    """pattern, a check on (token, text, start) of what it matches, and an optional inner pattern for the part that counts."""

    pattern: str
    confidence: float
    check: Callable[[Column, Column, Column], Column] | None = None
    inner: str | None = None
    guess: bool = False
    #: Only counts on pages with a sure finding of its rule (see classify).
    page: bool = False

    def spans(self, text: Column) -> Column:
        found = S.find_spans(text, self.pattern)
        if self.check:
            found = F.filter(found, lambda x: self.check(x["token"], text, x["start"]))
        return S.narrowed(found, self.inner) if self.inner else found


@dataclass(frozen=True)
class Scan:
    """A finder that is a function from a line's text to spans."""

    find: Callable[[Column], Column]
    confidence: float
    #: Only counts beside something that speaks for it (see classify).
    guess: bool = False
    #: Only counts on pages with a sure finding of its rule (see classify).
    page: bool = False
    #: Reads lines whose Chinese is set apart without the blanks between (see text.han_view).
    han: bool = False

    def spans(self, text: Column) -> Column:
        return F.transform(self.find(text), lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"), x["token"].alias("token")))


@dataclass(frozen=True)
class Rule:
    id: str
    kind: str
    finders: tuple[Finder | Scan, ...]
    enabled: bool = True
    yields_to: tuple[str, ...] = field(default=())
    #: What every match has in it, for rules outside the catalogue (see NEEDS); none: all lines are tried.
    needs: str | None = None


# Label words, hints.
_ORDER_HINTS = "order|invoice|receipt|ref no|ref\\.|tracking|订单|单号|流水|发票"
_PICKUP = "取件码|取货码|提货码|取件号|自提码|取餐码"
_EXPIRY = "Expiry|Expires|Exp\\.?|Valid thru|Good thru|有效期至?|有效期限"
_ADDRESS_LABELS = "Address|Shipping address|Billing address|收货地址|详细地址|家庭住址|住址|地址"
_CVV = "CVV2|CVC2|CVN2|CVV|CVC|安全码|卡验证码|卡片验证码"
_BIRTH = "出生日期|出生年月日|出生年月|出生时间|出生|生年月日|生日|Date of birth|Birth date|Birthdate|Birthday|DOB|D\\.O\\.B\\.|Born"
_PASSPORT = "Passport No\\.?|Passport Number|Passport #|Document No\\.?|Document Number|护照号码?|護照號碼?"
_ID_LABELS = "公民身份号码|身份证号码?|证件号码?|ID No\\.?|ID Number|Identity No\\.?"
_VIN_LABELS = "车辆识别代号|车架号|VIN"
NAME_LABELS = f"{P.NAME_LABELS_LATIN}|{P.NAME_LABELS_HAN}"
_SEP = r"\s{0,2}[:：]?\s{0,2}"


def this_year() -> Column:
    return F.year(F.current_date())


def _card_years(value: Column) -> Column:
    """An expiry of last year to twelve years ahead."""
    year = F.regexp_extract(value, "([0-9]{2})$", 1).cast("int") + 2000
    return year.between(this_year() - 1, this_year() + 12)


def _hinted(text: Column, start: Column, n: int = 12) -> Column:
    return F.lower(S.before(text, start, n)).rlike(_ORDER_HINTS)


def _phone(token, text, start):
    return token.startswith("+") | ~_hinted(text, start)


def _version(token, text, start):
    lead = F.lower(S.before(text, start, 12))
    return token.contains(":") | V.ipv4(token) & ~F.rtrim(lead).endswith("v") & ~lead.contains("version")


#: In order of priority within a line.
CATALOGUE: tuple[Rule, ...] = (
    Rule("card", "PAYMENT_CARD", (
        Scan(P.cards, 0.95),
        Scan(P.valued(f"(?<![A-Za-z])(?:{_CVV})", "(?<![0-9])[0-9]{3,4}(?![0-9])"), 0.8),
        Scan(P.valued(f"(?i)(?:{_EXPIRY})", "(?<![0-9/])(?:0[1-9]|1[0-2]) ?/ ?(?:20)?[0-9]{2}(?![0-9/])", check=_card_years), 0.8, page=True),
    ), yields_to=("PASSPORT", "ID_NUMBER")),
    Rule("iban", "IBAN", (Scan(P.ibans, 0.95),)),
    Rule("ssn", "SSN", (Scan(P.social_numbers, 0.95),)),
    Rule("mac", "MAC_ADDR", (Scan(P.hardware_addresses, 0.9),)),
    Rule("email", "EMAIL", (Scan(P.emails, 0.9),)),
    Rule("phone", "PHONE", (
        Finder(r"(?<![0-9A-Za-z])\+[1-9](?:[ ().-]{0,2}[0-9]){7,14}(?![0-9])", 0.9),
        Finder(r"(?<![0-9A-Za-z(+.-])\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9-])", 0.9, _phone),
        Finder(r"(?<![0-9A-Za-z+-])1[3-9][0-9][ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9-])", 0.9, _phone),
        Scan(lambda t: F.filter(P.landlines(t), lambda x: ~_hinted(t, x["start"])), 0.9),
        Scan(P.masked_mobiles, 0.85),
    ), yields_to=("PASSPORT", "ID_NUMBER")),
    Rule("passport", "PASSPORT", (
        Scan(mrz.find, 0.95),
        Finder(rf"(?i)(?:{_PASSPORT}){_SEP}(?-i:[A-Z]{{0,3}}[0-9][A-Z0-9]{{4,11}})(?![A-Za-z0-9])", 0.8, inner="[A-Z]{0,3}[0-9][A-Z0-9]{4,11}$"),
    )),
    Rule("idnumber", "ID_NUMBER", (
        Finder(rf"(?i)(?:{_ID_LABELS}){_SEP}(?-i:[0-9A-Z](?:[0-9A-Z*()-]{{4,19}}))", 0.8, lambda v, t, s: F.regexp_count(v, F.lit("[0-9]")) >= 5, inner="[0-9A-Z][0-9A-Z*()-]{4,19}$"),
        Scan(P.resident_ids, 0.9),
        Scan(P.checked(r"(?<![A-Za-z0-9])[A-Z][12][0-9]{8}(?![A-Za-z0-9])", V.tw_id, "身分證|身份证|身分证|ID"), 0.9),
        Scan(P.checked(r"(?<![A-Za-z0-9])[STFGM][0-9]{7}[A-Z](?![A-Za-z0-9])", V.nric), 0.9),
        Scan(P.checked(r"(?<![0-9-])[0-9]{6}-[1-8][0-9]{6}(?![0-9-])", V.rrn), 0.9),
        Scan(P.checked(r"(?<![0-9-])[0-9]{6}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda v: V.digits_of(v).rlike("^[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])"), "(?i)mykad|kad pengenalan|IC|NRIC"), 0.8),
        Scan(P.checked(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{8}[A-Z]{2}(?![A-Za-z0-9])", lambda v: F.lit(True), "在留カード|在留卡|(?i)residence card"), 0.8),
        Finder(r"(?<![0-9A-Za-z])[A-Z]{1,2}[0-9]{6}\([0-9A]\)", 0.9, lambda v, t, s: V.hkid(v)),
        Finder(r"(?<![0-9.-])[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}(?![0-9-])", 0.9, lambda v, t, s: V.cpf(v)),
    ), yields_to=("PASSPORT",)),
    Rule("vin", "VIN", (
        Finder(rf"(?i)(?<![A-Za-z])(?:{_VIN_LABELS}){_SEP}(?-i:[A-Z0-9*＊]{{17}})(?![A-Za-z0-9])", 0.8, inner="[A-Z0-9*＊]{17}$"),
        Scan(P.vins, 0.9),
        Scan(P.valued("(?i)(?:发动机号码?|engine no\\.?)", "(?<![A-Za-z0-9])[A-Z0-9]{6,12}(?![A-Za-z0-9])", check=lambda v: v.rlike("[0-9]")), 0.8),
    )),
    Rule("apikey", "API_KEY", (Scan(P.api_keys, 0.9),)),
    Rule("name", "PERSON_NAME", (
        Scan(P.labelled_names, 0.8, han=True),
        Scan(P.name_cues, 0.75),
        Scan(P.diploma_names, 0.8, han=True),
        Scan(P.names_before_phones, 0.7, han=True),
        Scan(P.name_pairs, 0.7, guess=True),
    )),
    Rule("address", "POSTAL_ADDRESS", (
        Scan(P.valued(f"(?i)(?:{_ADDRESS_LABELS})", "[^:： ][^:：]{3,59}$", r"\s{0,2}[:：]\s{0,2}", check=lambda v: v.rlike("[0-9一-鿿]|, ?[A-Z]")), 0.8, han=True),
        Scan(P.english_addresses, 0.8),
        Scan(P.chinese_addresses, 0.8, han=True),
    ), yields_to=("LICENSE_PLATE",)),
    Rule("pickup", "PICKUP_CODE", (
        Scan(P.valued(f"(?:{_PICKUP})", "(?<![A-Za-z0-9－-])[A-Za-z0-9]++(?: ?[-－] ?[A-Za-z0-9]++){0,6}", r"\s?[:：为是]?\s?", check=lambda v: v.rlike("[0-9]")), 0.8, han=True),
        Scan(P.collect_codes, 0.7, han=True),
    )),
    Rule("birthdate", "BIRTH_DATE", (
        Scan(P.valued(f"(?i)(?:{_BIRTH})", dates.SHAPE, r"\s{0,2}[:：]?\s{0,2}(?:on )?", check=lambda v: F.exists(dates.readings(v), lambda r: r["y"].between(this_year() - 110, this_year()))), 0.8, han=True),
        Scan(lambda t: dates.born_on(t, this_year()), 0.8, han=True),
    )),
    Rule("plate", "LICENSE_PLATE", (
        Scan(P.labelled_plates, 0.8),
        Scan(P.plates, 0.9),
    ), yields_to=("PASSPORT", "IBAN", "VIN", "ID_NUMBER")),
    Rule("url", "URL", (Finder(r"(?<![A-Za-z0-9@._-])(?:https?://)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}/[^\s]+", 0.7, lambda v, t, s: V.known_tld(F.regexp_extract(v, r"\.([A-Za-z]{2,24})/", 1)), inner="(?<=[A-Za-z]{2,24})(?<![/:])/[^/\\s][^\\s]*$"),), enabled=False),
    Rule("ip", "IP_ADDR", (Finder(r"(?<![\w.:])(?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4})(?![\w.:])", 0.6, _version),), enabled=False),
    Rule("longnum", "LONG_NUMBER", (Scan(P.long_numbers, 0.4),), enabled=False, yields_to=("*",)),
    Rule("datetime", "DATETIME", (Scan(P.dates_and_times, 0.6),), enabled=False, yields_to=("BIRTH_DATE", "PICKUP_CODE")),
)

BY_ID = {r.id: r for r in CATALOGUE}


def chosen(states: dict[str, str] | None = None, catalogue: tuple[Rule, ...] = CATALOGUE) -> tuple[Rule, ...]:
    """The rules that are on: as they come, but for ids with a state of their own (ON or OFF). Others never enter a plan."""
    states = states or {}
    return tuple(r for r in catalogue if states.get(r.id, "ON" if r.enabled else "OFF") == "ON")


def with_state(states: dict[str, str], rule_id: str, state: str) -> dict[str, str]:
    """states with one more; a state equal to the rule's own is not stored."""
    rest = {k: v for k, v in states.items() if k != rule_id}
    same = BY_ID[rule_id].enabled == (state == "ON")
    return rest if same else rest | {rule_id: state}


def _as_hit(rule: Rule, rule_ord: int, finder_ord: int, finder: Finder):
    def build(x: Column) -> Column:
        return F.struct(
            F.lit(rule.id).alias("rule_id"),
            F.lit(rule.kind).alias("kind"),
            F.lit(rule_ord).alias("rule_ord"),
            F.lit(finder_ord).alias("finder_ord"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            x["token"].alias("token"),
            F.lit(float(finder.confidence)).alias("confidence"),
        )

    return build


def of_page(hit: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a hit only counts on pages with another finding of its rule."""
    out = F.lit(False)
    for rule in rules:
        for j, f in enumerate(rule.finders):
            if getattr(f, "page", False):
                out = out | ((hit["rule_id"] == rule.id) & (hit["finder_ord"] == j))
    return out


def is_guess(hit: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether a hit is of a finder that guesses."""
    out = F.lit(False)
    for rule in rules:
        if any(f.guess for f in rule.finders):
            out = out | ((hit["rule_id"] == rule.id) & hit["finder_ord"].isin(*[j for j, f in enumerate(rule.finders) if f.guess]))
    return out


def reads_views(rules: tuple[Rule, ...]) -> bool:
    """Whether a finder of the rules reads lines by their Chinese view."""
    return any(getattr(f, "han", False) for r in rules for f in r.finders)


def _beside_others(rule: Rule):
    """Leaves hits of page finders only where another hit of the rule stands in the line."""
    return lambda found: F.filter(found, lambda y: ~of_page(y, (rule,)) | F.exists(found, lambda z: ~of_page(z, (rule,))))


def once_per_application(build):
    """Expressions over many rules take seconds to build: built once for each set of arguments and application."""

    @lru_cache(maxsize=64)
    def kept(_, *args):
        return build(*args)

    return lambda *args: kept(getattr(SparkContext._active_spark_context, "applicationId", None), *args)


def hits(text: Column, rules: tuple[Rule, ...], whole_page: bool = False) -> Column:
    """All hits of the rules in a line; within a rule, a hit that overlaps an earlier one is dropped.

    A line by itself is its own page: hits that only count on pages with another finding of their rule need that in the
    line. With whole_page they are left for the caller to judge (of_page).
    """

    def spans_of(finder: Finder | Scan, view: Column) -> Column:
        return in_source(finder.spans(view["text"]), view["origin"], text) if getattr(finder, "han", False) else finder.spans(text)

    def of_rule(k: int, rule: Rule, view: Column) -> Column:
        found = [F.transform(spans_of(finder, view), _as_hit(rule, k, j, finder)) for j, finder in enumerate(rule.finders)]
        own = F.concat(*found) if len(found) > 1 else found[0]
        own = S.let(own, lambda x: F.when(F.size(x) > 1, S.first_come(x, HIT)).otherwise(x)) if len(found) > 1 else own
        if not whole_page and any(getattr(f, "page", False) for f in rule.finders):
            own = S.let(own, _beside_others(rule))
        # Finders only run on lines that have what each match of the rule has.
        if (need := needs_of(rule)) is None:
            return own
        needed = text.rlike(need)
        if reads_views((rule,)):
            needed = needed | view["origin"].isNotNull() & view["text"].rlike(need)
        return F.when(needed, own).otherwise(F.array().cast(f"array<{HIT}>"))

    def of_all(view: Column | None) -> Column:
        # Building is mostly waiting for the JVM: rules are built side by side.
        with ThreadPoolExecutor(8) as pool:
            out = list(pool.map(lambda k: of_rule(k, rules[k], view), range(len(rules))))
        return F.concat(*out) if out else F.array().cast(f"array<{HIT}>")

    return S.let(han_view(text), of_all) if reads_views(rules) else of_all(None)


def yielded(text: Column, found: Column, rules: tuple[Rule, ...]) -> Column:
    """Hits after giving way to other kinds: judged on the hits as they were found, so that order plays no part.

    Guesses take nothing. A hit that starts within another, or loses more than half of its characters to others, goes; else it ends where the
    first of them begins, without trailing blanks and punctuation.
    """
    gives_way = {r.kind: r.yields_to for r in rules if r.yields_to}

    def taken(x):
        def wins(y):
            cond = F.lit(False)
            for kind, to in gives_way.items():
                cond = cond | ((x["kind"] == kind) & (y["kind"] != kind if to == ("*",) else y["kind"].isin(*to)))
            return cond & S.overlaps(x, y) & ~is_guess(y, rules)

        return F.filter(found, wins)

    def settle(x):
        def cut(rivals):
            first = F.array_min(F.transform(rivals, lambda y: y["start"]))
            lost = F.aggregate(S.merged(rivals), F.lit(0), lambda acc, y: acc + F.greatest(F.least(y["end"], x["end"]) - F.greatest(y["start"], x["start"]), F.lit(0)))
            rest = F.rtrim(F.substring(text, x["start"] + 1, first - x["start"]), F.lit(" ,.;:，。；：、-"))
            short = F.struct(*[x[c].alias(c) for c in ("rule_id", "kind", "rule_ord", "finder_ord", "start")], (x["start"] + F.length(rest)).alias("end"), rest.alias("token"), x["confidence"].alias("confidence"))
            return F.when(F.size(rivals) == 0, x).when((first <= x["start"]) | (2 * lost > x["end"] - x["start"]) | (F.length(rest) <= 1), F.lit(None)).otherwise(short)

        return S.let(taken(x), cut)

    return F.array_compact(F.transform(found, settle)) if gives_way else found


@dataclass(frozen=True)
class Need:
    """What every match of a rule has in it, as alternatives by their first character: a digit; a letter or Chinese character
    (words in one case, words in any); anything but a small letter."""

    digits: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    any_case: tuple[str, ...] = ()
    other: tuple[str, ...] = ()

    def pattern(self) -> str:
        parts = [f"(?=[0-9])(?:{'|'.join(self.digits)})"] if self.digits else []
        parts += [S.by_first("|".join(self.words))] if self.words else []
        parts += [S.by_first("|".join(self.any_case), True)] if self.any_case else []
        parts += [f"(?![a-z])(?:{'|'.join(self.other)})"] if self.other else []
        return "|".join(parts)


#: In text with half-width digits, for the rules of the catalogue. (A small letter behind the first character ends long runs.)
NEED = {
    "card": Need(("(?:[0-9][ -]?){13}",), (_CVV,), (_EXPIRY,)),
    "iban": Need(other=("[A-Z]{2}[0-9]{2}",)),
    "ssn": Need(("[0-9]-[0-9]{2}-[0-9]",)),
    "mac": Need(other=("(?<=[0-9A-Fa-f]{2})[:-][0-9A-Fa-f]{2}[:-]",)),
    "email": Need(other=("@",)),
    "phone": Need(("[0-9](?:[ ().-]{0,2}[0-9*＊•●xX]){6}",)),
    "passport": Need(any_case=(_PASSPORT,), other=(f"(?!.[a-z])[A-Z0-9<{mrz.FILLERS} ]{{30}}",)),
    "idnumber": Need(("[0-9]{6}", "[0-9]{3}\\.[0-9]{3}", "(?:[0-9] ?){15}"), any_case=(_ID_LABELS,)),
    "vin": Need(any_case=(_VIN_LABELS, "发动机号|engine no"), other=("(?!.[a-z])[A-Z0-9]{17}",)),
    "apikey": Need(words=P.KEY_PREFIXES),
    "name": Need(
        ("1[3-9][0-9]",),
        (r"Mr\.? |Mrs\.? |Ms\.? |Dr\.? |Prof\.? |Miss\.? ", "Driver:|Courier:|Seller:|Agent:|Host:|Doctor:|Teacher:", "joined|left|was added|was removed", NAME_LABELS, "学生|學生|男|女"),
        other=(r"^(?:Hi|Hey|Hello|Dear|From|To|Cc)\b", "<[^ >]+@", "[~～]", "/[A-Z]{2}", f"{S.by_first('|'.join(P.FIRST + P.PINYIN_SURNAMES), behind='(?<![A-Za-z])')} "),
    ),
    "address": Need(("[0-9][A-Za-z]? [A-Z0-9]", "(?<=[A-Z#a-z.] ?)[0-9]", "[0-9](?:号|栋|幢|单元|室|楼|层|座)"), tuple("省市区县镇乡村路街巷弄道园寓厦场"), (_ADDRESS_LABELS,)),
    "pickup": Need(words=("凭", _PICKUP)),
    "birthdate": Need(words=("生",), any_case=(_BIRTH,)),
    "plate": Need(("[0-9]",)),
    "url": Need(other=("/",)),
    "ip": Need(("[0-9]",), other=(":",)),
    "longnum": Need(("(?:[0-9][A-Z－-]*){8}",)),
    "datetime": Need(("[0-9]",)),
}
NEEDS = {rule: need.pattern() for rule, need in NEED.items()}


def needs_of(rule: Rule) -> str | None:
    """What every match of a rule has in it; null if nothing is known of it."""
    return NEEDS[rule.id] if BY_ID.get(rule.id) == rule else rule.needs


def may_match(text: Column, rules: tuple[Rule, ...]) -> Column:
    """Whether text with half-width digits has what one of the rules needs; true of all texts for rules that don't say."""
    if any(needs_of(r) is None for r in rules):
        return text.isNotNull()
    own = [NEED[r.id] for r in rules if BY_ID.get(r.id) == r] + [Need(other=(LONE_HAN,))] * reads_views(rules)
    # The needs of all rules that begin alike are tried together.
    every = Need(*[tuple(dict.fromkeys(x for need in own for x in getattr(need, part))) for part in ("digits", "words", "any_case", "other")])
    needs = [every.pattern()] * bool(own) + sorted({needs_of(r) for r in rules if BY_ID.get(r.id) != r})
    return text.rlike("|".join(needs)) if needs else F.lit(False)


@once_per_application
def _steps(rules: tuple[Rule, ...], whole_page: bool, fold: bool) -> tuple[Column, Column, Column, Column]:
    folded = half_width_digits(F.col("text")) if fold else F.col("text")
    return may_match(folded, rules), folded, hits(F.col("_t"), rules, whole_page), yielded(F.col("_t"), F.col("_hits"), rules)


def with_hits(lines: DataFrame, rules: tuple[Rule, ...], whole_page: bool = False, fold: bool = True) -> DataFrame:
    """The lines that may match, with the settled `_hits` of the rules in `_t`, their text with half-width digits (fold) or as it is."""
    may, folded, found, settled = _steps(rules, whole_page, fold)
    return lines.where(may).withColumn("_t", folded).withColumn("_hits", found).withColumn("_hits", settled)


def matches(lines: DataFrame, states: dict[str, str] | None = None, floor: float = 0.5, catalogue: tuple[Rule, ...] = CATALOGUE, fold: bool = True) -> DataFrame:
    """One row per hit of lines(page_id, line_no, text, confidence): (page_id, line_no, rule_id, kind, start, end, token, confidence)."""
    rules = chosen(states, catalogue)
    # Projections of their own: each array is worked out once. The outer explode keeps it out of inferred filters.
    resolved = with_hits(lines.where(F.col("confidence") >= floor), rules, fold=fold)
    return resolved.select("page_id", "line_no", F.explode_outer("_hits").alias("h")).where("h is not null").select("page_id", "line_no", "h.*")
