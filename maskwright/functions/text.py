"""Text projections before rules run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let

_HAN = "一-鿿"


def half_width_digits(text: Column) -> Column:
    return F.translate(text, "０１２３４５６７８９", "0123456789")


#: What every line has in it that han_view reads without some of its blanks.
LONE_HAN = f"(?:^| )[{_HAN}](?: |$)"
_CJK = f"[{_HAN}\u3001-\u303f\uff01-\uffef]"


def han_view(text: Column) -> Column:
    """struct(text, origin): a line as Chinese finders read it, and where in the line each of its code points stands.

    Recognisers may set Chinese characters apart. A line of which two parts or more have Chinese, most of them one character
    long, loses each single blank between two other characters of which one is Chinese or a full-width mark. Other lines are
    read as they are and have no origin.
    """
    parts = F.filter(F.split(text, " "), lambda x: x.rlike(f"[{_HAN}]"))
    apart = text.rlike(LONE_HAN) & let(parts, lambda p: (F.size(p) >= 2) & (2 * F.size(F.filter(p, lambda x: F.length(x) == 1)) > F.size(p)))

    def kept(chars):
        def stays(c, i):
            ahead, behind = F.get(chars, i - 1), F.get(chars, i + 1)
            return (c != " ") | ahead.isNull() | behind.isNull() | (ahead == " ") | (behind == " ") | ~(ahead.rlike(_CJK) | behind.rlike(_CJK))

        return F.filter(F.transform(chars, lambda c, i: F.when(stays(c, i), F.struct(c.alias("c"), i.alias("i")))), lambda x: x.isNotNull())

    def view(left):
        return F.struct(F.array_join(F.transform(left, lambda x: x["c"]), "").alias("text"), F.transform(left, lambda x: x["i"]).alias("origin"))

    return F.when(apart, let(let(F.split(text, ""), kept), view)).otherwise(F.struct(text.alias("text"), F.lit(None).cast("array<int>").alias("origin")))


def in_source(found: Column, origin: Column, text: Column) -> Column:
    """Spans of a view as spans of the line; blanks within them come along."""

    def back(x):
        start, end = F.get(origin, x["start"]), F.get(origin, x["end"] - 1) + 1
        return F.struct(start.alias("start"), end.alias("end"), F.substring(text, start + 1, end - start).alias("token"))

    return F.when(origin.isNull(), found).otherwise(F.transform(found, back))


def han_joined(text: Column) -> Column:
    """The text of han_view."""
    return han_view(text)["text"]


def han_ratio(text: Column) -> Column:
    """Chinese characters among Chinese and Latin ones; 0 without either."""
    han, latin = F.regexp_count(text, F.lit(f"[{_HAN}]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when(han + latin > 0, han / (han + latin)).otherwise(0.0)


def folded(text: Column) -> Column:
    """Letters without accents, in capitals."""
    return F.upper(F.translate(text, "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"))
