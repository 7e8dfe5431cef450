"""Spans of regular expressions as native expressions: half-open code-point offsets, no Python in the tasks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,token:string>>"
#: No character of any script: texts hardly ever have it.
MARK = "\ufdd0"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def none() -> Column:
    return F.array().cast(SPAN)


def by_first(words: str, ignore_case: bool = False, behind: str = "") -> str:
    """words, alternatives that begin with letters or Chinese characters, tried only where their first characters may stand (and
    behind holds): a matcher tries each of many alternatives at every place of a text otherwise."""

    def start(word: str) -> tuple[str, str]:
        second, rest = (word[2:3], word[3:4]) if word[1:2] == "\\" else (word[1:2], word[2:3])
        sure = second and rest not in tuple("?*{") and (second == "." if word[1] == "\\" else second.isalnum() or second in " _:")
        return word[0], second if sure else ""

    def both(chars) -> str:
        return "".join(sorted({x for c in chars for x in ((c.lower(), c.upper()) if ignore_case else (c,))}))

    flag, every = "i" if ignore_case else "", words.split("|")
    latin, han = [w for w in every if w[0].isascii() and w[0].isalpha()], [w for w in every if "一" <= w[0] <= "鿿"]
    if len(latin) + len(han) != len(every) or "(" in words:
        raise ValueError(f"not alternatives that begin with letters: {words}")
    out = []
    # Small letters are frequent: words with a capital don't add to what is tried there.
    for own in ([latin] if ignore_case else [[w for w in latin if w[0].islower()], [w for w in latin if w[0].isupper()]]):
        if own:
            second = [start(w)[1] for w in own]
            ahead = f"[{both(w[0] for w in own)}]" + (f"[{both(second)}]" if all(second) else "")
            out.append(f"(?={ahead}){behind}(?{flag}:{'|'.join(own)})")
    if han:
        out.append(f"(?=[一-鿿]){behind}(?:{'|'.join(han)})")
    return out[0] if len(out) == 1 else f"(?:{'|'.join(out)})"


def find_spans(text: Column, pattern: str) -> Column:
    """All matches of pattern, left to right: array of (start, end, token).

    Matches are put between marks, so that one search gives them and the pieces between, whose lengths give the offsets. (To
    split by the pattern itself compiles it for each text.) Texts that have the mark are split by the pattern.
    """

    def place(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.lit(False).alias("match"), none().alias("out"))

        def step(acc, x):
            end = acc["at"] + F.length(x)
            out = F.when(acc["match"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"), x.alias("token"))))).otherwise(acc["out"])
            return F.struct(end.alias("at"), (~acc["match"]).alias("match"), out.alias("out"))

        return F.when(F.size(parts) == 1, none()).otherwise(F.aggregate(parts, zero, step, lambda acc: acc["out"]))

    def by_pattern() -> Column:
        return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.flatten(F.transform(F.split(text, pattern, -1), lambda gap, i: F.when(i < F.size(m), F.array(gap, F.get(m, i))).otherwise(F.array(gap)))))

    by_mark = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    return let(F.when(text.contains(MARK), by_pattern()).otherwise(by_mark), place)


def narrowed(found: Column, inner: str) -> Column:
    """Spans narrowed to the first match of inner within each token; tokens without one go."""

    def narrow(x):
        value = F.regexp_extract(x["token"], f"({inner})", 1)
        # The place of the match, not of an equal piece before it.
        start = x["start"] + F.length(F.get(F.split(x["token"], inner, 2), F.lit(0)))
        return F.when(value != "", F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("token")))

    return F.array_compact(F.transform(found, narrow))


def before(text: Column, start: Column, n: int) -> Column:
    """The n code points in front of start."""
    return F.substring(text, F.greatest(start - n, F.lit(0)) + 1, F.least(start, F.lit(n)))


def after(text: Column, end: Column, n: int) -> Column:
    """The n code points behind end."""
    return F.substring(text, end + 1, F.lit(n))


def joined_close(spans: Column, text: Column, gap: str, n: int) -> Column:
    """Sorted spans that overlap, or with nothing but n characters of the class `gap` between, as one: array of (start, end, token)."""
    plain = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def step(out, x):
        def glue(last):
            between = F.substring(text, last["end"] + 1, F.greatest(x["start"] - last["end"], F.lit(0)))
            near = between.rlike(f"^[{gap}]{{0,{n}}}$")
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
            return F.when(near, F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(x)))

        return F.when(F.size(out) == 0, F.array(x)).otherwise(glue(F.get(out, F.size(out) - 1)))

    return F.transform(F.aggregate(plain, zero, step), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("token")))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def first_come(hits: Column, element: str) -> Column:
    """Greedy resolution: a hit stays unless one that already stays overlaps it."""
    zero = F.array().cast(f"array<{element}>")
    return F.aggregate(hits, zero, lambda kept, x: F.when(F.exists(kept, lambda y: overlaps(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def merged(spans: Column) -> Column:
    """The union of spans(start, end) as disjoint sorted spans."""
    plain = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    zero = F.array().cast("array<struct<start:int,end:int>>")

    def step(out, x):
        last = F.element_at(out, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] > x["start"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(plain, zero, step)


def replaced(text: Column, hits: Column) -> Column:
    """text with disjoint hits(start, end, label) replaced by [label], from the right to the left."""
    falling = F.reverse(F.array_sort(F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["label"].alias("label")))))
    return F.aggregate(falling, text, lambda acc, x: F.concat(F.substring(acc, F.lit(1), x["start"]), F.lit("["), x["label"], F.lit("]"), F.substring(acc, x["end"] + 1, F.length(acc))))
