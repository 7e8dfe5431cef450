"""Dates as they stand in text: every reading of a stretch as year, month and day; native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans as S

# Eras with what is added to their years, month names, Chinese numerals.
ERAS = {"民国": 1911, "民國": 1911, "明治": 1867, "大正": 1911, "昭和": 1925, "平成": 1988, "令和": 2018, "M": 1867, "T": 1911, "S": 1925, "H": 1988, "R": 2018}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
NUMERALS = "〇零一二三四五六七八九"
READING = "array<struct<y:int,m:int,d:int>>"

_CJK = f"[0-9{NUMERALS}十]"
_WORD = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_ERA = "(?:民国|民國|明治|大正|昭和|平成|令和|[MTSHR](?=[0-9]{1,2}[.年]))"
#: One date: with an era, in Chinese order, in numbers with marks, or with a month's name.
SHAPE = (
    rf"{_ERA} ?(?:元|{_CJK}{{1,3}}) ?[年.] ?{_CJK}{{1,3}} ?[月.] ?{_CJK}{{1,3}} ?日?"
    rf"|{_CJK}{{4}} ?年 ?{_CJK}{{1,3}} ?月 ?{_CJK}{{1,3}} ?日?"
    r"|(?<![0-9])[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])"
    r"|(?<![0-9])[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4}(?![0-9])"
    rf"|(?<![0-9])[0-9]{{1,2}} (?i:{_WORD})\.?,? [0-9]{{4}}(?![0-9])|(?i:{_WORD})\.? [0-9]{{1,2}},? [0-9]{{4}}(?![0-9])"
)


def western(text: Column) -> Column:
    """Chinese numerals up to 99, and years given digit by digit, as Arabic ones."""
    return F.when(text.rlike(f"[{NUMERALS}十]"), _western(text)).otherwise(text)


def _western(text: Column) -> Column:
    out = F.regexp_replace(text, "([一二三四五六七八九])十(?=[一二三四五六七八九])", "$1")
    out = F.regexp_replace(out, "十(?=[一二三四五六七八九])", "一")
    out = F.regexp_replace(out, "([一二三四五六七八九])十", "$1〇")
    return F.translate(F.regexp_replace(out, "十", "一〇"), NUMERALS, "00123456789")


def _int(text: Column) -> Column:
    return F.when(text.rlike("^[0-9]{1,4}$"), text.try_cast("int"))


def is_real(y: Column, m: Column, d: Column) -> Column:
    """Whether the calendar has that day; false for nulls."""
    leap = (y % 4 == 0) & (y % 100 != 0) | (y % 400 == 0)
    days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce((m >= 1) & (m <= 12) & (d >= 1) & (d <= days) & (y >= 1), F.lit(False))


def readings(token: Column) -> Column:
    """Every real (y, m, d) that a token can mean: both orders where day and month can't be told apart."""

    def read(t: Column) -> Column:
        get = lambda pattern, k: F.regexp_extract(t, pattern, k)
        era = rf"^({'|'.join(ERAS)}) ?(元|[0-9]{{1,3}}) ?[年.] ?([0-9]{{1,2}}) ?[月.] ?([0-9]{{1,2}})"
        plus = F.try_element_at(F.create_map(*[F.lit(x) for pair in ERAS.items() for x in pair]), get(era, 1))
        ymd, xxy = r"^([0-9]{4}) ?[-/.年] ?([0-9]{1,2}) ?[-/.月] ?([0-9]{1,2})", r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})"
        dmy, mdy = r"^([0-9]{1,2}) ([A-Za-z]{3})[a-z]*\.?,? ([0-9]{4})", r"^([A-Za-z]{3})[a-z]*\.? ([0-9]{1,2}),? ([0-9]{4})"
        month = lambda x: F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(x)).cast("int"), F.lit(0))
        one = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"))
        n = lambda pattern, k: _int(get(pattern, k))
        # How a token begins tells the only shape it can have.
        every = (
            F.when(t.rlike("^[0-9]{4}"), F.array(one(n(ymd, 1), n(ymd, 2), n(ymd, 3))))
            .when(t.rlike("^[0-9]{1,2}[-/.]"), F.array(one(n(xxy, 3), n(xxy, 2), n(xxy, 1)), one(n(xxy, 3), n(xxy, 1), n(xxy, 2))))
            .when(t.rlike("^[0-9]"), F.array(one(n(dmy, 3), month(get(dmy, 2)), n(dmy, 1))))
            .when(t.rlike("^[A-Za-z]{3}"), F.array(one(n(mdy, 3), month(get(mdy, 1)), n(mdy, 2))))
            .otherwise(F.array(one(F.when(get(era, 2) == "元", 1).otherwise(n(era, 2)) + plus, n(era, 3), n(era, 4))))
        )
        return F.array_distinct(F.filter(every, lambda x: is_real(x["y"], x["m"], x["d"])))

    return S.let(western(token), read)


def read(text: Column) -> Column:
    """Spans of dates that are real, with their readings: array of (start, end, token, readings)."""
    both = F.transform(S.find_spans(text, SHAPE), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), readings(x["token"]).alias("readings")))
    return F.filter(both, lambda x: F.size(x["readings"]) > 0)


def find(text: Column) -> Column:
    """Spans of dates that are real in one reading at least."""
    return F.filter(S.find_spans(text, SHAPE), lambda x: F.size(readings(x["token"])) > 0)


def born_on(text: Column, this_year: int, oldest: int = 110) -> Column:
    """Spans of dates with a word for birth right behind or before them, of people of at most `oldest` years."""
    near = F.filter(S.find_spans(text, SHAPE), lambda x: S.after(text, x["end"], 4).rlike("^[ ,，]?(?:出生|生(?![效产成活意]))|^ ?born") | F.lower(S.before(text, x["start"], 8)).rlike("born (?:on )?$"))
    return F.filter(near, lambda x: F.exists(readings(x["token"]), lambda r: (r["y"] <= this_year) & (r["y"] >= this_year - oldest)))
