"""Machine-readable travel documents: lines of 30, 36 or 44 characters, their fields and check digits; native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans as S
from . import validators as V

# Marks that are read in place of the filler, letters that are read in place of digits.
FILLERS = "«‹＜〈"
LETTERS, DIGITS = "OQDIZSB", "0001258"
FIELDS = "struct<format:string,number:string,birth:string,expiry:string,sex:string,names:string,checks:int>"


def plain(line: Column) -> Column:
    """The line without blanks, in capitals, with one kind of filler."""
    return F.translate(F.upper(F.regexp_replace(line, r"\s+", "")), FILLERS, "<" * len(FILLERS))


def _part(line: Column, start: int, n: int) -> Column:
    return F.substring(line, start + 1, n)


def _digits(value: Column) -> Column:
    """A field that only has digits, with look-alike letters put right."""
    return F.translate(value, LETTERS, DIGITS)


def _right(value: Column, check: Column) -> Column:
    return F.coalesce(V.mrz_check(value) == F.when(check == "<", 0).otherwise(_digits(check).try_cast("int")), F.lit(False)).cast("int")


def fields(line: Column) -> Column:
    """What a single line holds, as FIELDS; null where its length or shape is none of a document's."""

    def read(t: Column) -> Column:
        text = lambda x: F.nullif(F.rtrim(x, F.lit("<")), F.lit(""))
        null = F.lit(None).cast("string")

        def build(format, number, birth, expiry, sex, names, checks):
            return F.struct(format.alias("format"), number.alias("number"), birth.alias("birth"), expiry.alias("expiry"), sex.alias("sex"), names.alias("names"), checks.cast("int").alias("checks"))

        number, birth, expiry = _part(t, 0, 9), _digits(_part(t, 13, 6)), _digits(_part(t, 21, 6))
        lower = build(
            F.when(F.length(t) == 44, "TD3").otherwise("TD2"), text(number), birth, expiry, F.nullif(_part(t, 20, 1), F.lit("<")), null,
            _right(number, _part(t, 9, 1)) + _right(birth, _part(t, 19, 1)) + _right(expiry, _part(t, 27, 1)),
        )
        first = build(F.lit("TD1"), text(_part(t, 5, 9)), null, null, null, null, _right(_part(t, 5, 9), _part(t, 14, 1)))
        card_birth, card_expiry = _digits(_part(t, 0, 6)), _digits(_part(t, 8, 6))
        second = build(F.lit("TD1"), null, card_birth, card_expiry, F.nullif(_part(t, 7, 1), F.lit("<")), null, _right(card_birth, _part(t, 6, 1)) + _right(card_expiry, _part(t, 14, 1)))
        name = F.regexp_replace(F.regexp_replace(text(F.substring(t, F.when(F.length(t) == 30, 1).otherwise(6), F.lit(44))), "<<+", ", "), "<", " ")
        names = build(F.when(F.length(t) == 44, "TD3").when(F.length(t) == 36, "TD2").otherwise("TD1"), null, null, null, null, name, F.lit(0))
        return (
            F.when(t.rlike("^[PVAIC][A-Z<][A-Z<]{3}[A-Z]+<<[A-Z<]*$") & F.length(t).isin(36, 44), names)
            .when(t.rlike("^[A-Z]+(?:<[A-Z]+)*<<[A-Z<]*$") & (F.length(t) == 30), names)
            .when(t.rlike("^[A-Z0-9<]{9}[0-9OQDIZSB<][A-Z<]{3}[0-9OQDIZSB]{6}[0-9OQDIZSB][MFX<][0-9OQDIZSB]{6}[0-9OQDIZSB][A-Z0-9<]*$") & F.length(t).isin(36, 44), lower)
            .when(t.rlike("^[IAC][A-Z0-9<][A-Z<]{3}[A-Z0-9<]{9}[0-9OQDIZSB<][A-Z0-9<]{15}$"), first)
            .when(t.rlike("^[0-9OQDIZSB]{7}[MFX<][0-9OQDIZSB]{7}[A-Z<]{3}[A-Z0-9<]{12}$"), second)
        )

    return S.let(plain(line), read)


def is_line(line: Column) -> Column:
    """A line of a document: names with their fillers, or fields with two right check digits (one on a first line of a card)."""

    def ok(found: Column) -> Column:
        return F.coalesce(F.when(found["names"].isNotNull(), True).otherwise(found["checks"] >= F.when(found["birth"].isNull(), 1).otherwise(2)), F.lit(False))

    return S.let(fields(line), ok)


def find(text: Column) -> Column:
    """Spans of runs of such characters, blanks included, that are a line of a document. (The runs are of one class of
    characters: nested repeats would overflow the matcher's stack on long texts.)"""
    runs = S.find_spans(text, rf"[A-Z0-9<{FILLERS}][A-Z0-9<{FILLERS} ]{{28,}}+")

    def trimmed(x: Column) -> Column:
        value = F.rtrim(x["token"])
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(value)).alias("end"), value.alias("token"))

    sized = F.filter(runs, lambda x: F.length(plain(x["token"])).isin(30, 36, 44))
    return F.filter(F.transform(sized, trimmed), lambda x: is_line(x["token"]))


def read(lines: DataFrame) -> DataFrame:
    """(page_id, number, birth, expiry, sex, names): what the lines of each page say; for each field the first line counts."""
    own = lines.select("page_id", "line_no", F.when(is_line(F.col("text")), fields(F.col("text"))).alias("f")).where("f is not null")
    first = lambda c: F.min_by(f"f.{c}", F.when(F.col(f"f.{c}").isNotNull(), F.col("line_no"))).alias(c)
    return own.groupBy("page_id").agg(*[first(c) for c in ("number", "birth", "expiry", "sex", "names")])
