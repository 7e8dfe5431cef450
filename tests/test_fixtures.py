"""Rules, checks, dates and machine-readable lines over invented lines and public sample numbers."""

import datetime

import pytest
from pyspark.sql import functions as F

from maskwright.functions import dates, mrz
from maskwright.operators import metrics, rules
from maskwright.plans import fixtures
from maskwright.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_line_gives_its_finding_and_no_other(spark):
    got = {}
    for r in QUERIES["labelled_lines"](spark, SMALL).collect():
        got.setdefault(r.page_id, []).append((r.kind, r.token))
    n = len(fixtures.RULE_LINES)
    for page in range(1, n + 1):
        _, kind, token = fixtures.RULE_LINES[page % n]
        assert got.get(page, []) == ([(kind, token)] if kind else []), fixtures.RULE_LINES[page % n]


def test_a_line_that_a_gate_skips_has_no_finding(spark):
    """Each line of a rule passes the rule's own gate."""
    rows = [(t, next(r.id for r in rules.CATALOGUE if r.kind == k)) for t, k, _ in fixtures.RULE_LINES if k]
    table = spark.createDataFrame(rows, "t string, id string")
    for rule in rules.CATALOGUE:
        own = table.where(F.col("id") == rule.id)
        assert own.where(~F.col("t").rlike(rules.NEEDS[rule.id])).collect() == []


def test_checksum_vectors(spark):
    got = {(r.family, r.value): r.valid for r in QUERIES["checksum_vectors"](spark, SMALL).collect()}
    assert got == {(f, v): ok for f, v, ok in fixtures.CHECKSUMS}


@pytest.mark.parametrize(
    "text, expected",
    [("born 1990-02-31", []), ("昭和60年1月2日生", [(1985, 1, 2)]), ("二〇〇一年十二月三十一日", [(2001, 12, 31)]), ("03/04/2001", [(2001, 3, 4), (2001, 4, 3)]), ("13/04/2001", [(2001, 4, 13)]), ("R3.4.5", [(2021, 4, 5)]), ("5 May 2000", [(2000, 5, 5)]), ("民国八十年十月十日", [(1991, 10, 10)])],
)
def test_readings(spark, text, expected):
    t = F.lit(text)
    row = spark.range(1).select(F.flatten(F.transform(dates.find(t), lambda x: dates.readings(x["token"]))).alias("r")).first()
    assert sorted((x.y, x.m, x.d) for x in row.r) == expected


def test_real_days(spark):
    rows = [(y, m, d) for y in (1900, 1999, 2000, 2004) for m in range(0, 14) for d in (0, 1, 28, 29, 30, 31, 32)]

    def real(y, m, d):
        try:
            return bool(datetime.date(y, m, d))
        except ValueError:
            return False

    got = spark.createDataFrame(rows, "y int, m int, d int").select("*", dates.is_real(F.col("y"), F.col("m"), F.col("d")).alias("ok")).collect()
    assert all(r.ok == real(r.y, r.m, r.d) for r in got)


def test_machine_readable_page(spark):
    lines = [fixtures.MRZ3, fixtures.MRZ3B.replace("UTO7408", "UT07408"), "just some text", None]
    table = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)] + [(2, 0, "I<UTOD231458907<<<<<<<<<<<<<<<"), (2, 1, "7408122F1204159UTO<<<<<<<<<<<6"), (2, 2, "ERIKSSON<<ANNA<MARIA<<<<<<<<<<")], "page_id int, line_no int, text string")
    got = {r.page_id: r for r in mrz.read(table).collect()}
    assert got[2].number == "D23145890" and got[2].birth == "740812" and got[2].expiry == "120415" and got[2].names == "ERIKSSON, ANNA MARIA"
    assert got[1].names == "ERIKSSON, ANNA MARIA" and got[1].number is None  # a letter in the country's field is no digit


def test_error_rates_of_whole_texts(spark):
    def distance(a, b, free=False):
        row = [0 if free else j for j in range(len(b) + 1)]
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
            row = new
        return min(row) if free else row[-1]

    pairs = [("a", "naïve café\n" * 30, "naive cafe\n" * 30), ("a", None, "x"), ("b", "same text", "same  text"), ("b", "", "")]
    table = spark.createDataFrame(pairs, "theme string, truth string, read string")
    got = {r.theme: r for r in metrics.character_error_rate(table, ["theme"]).collect()}
    for theme in "ab":
        own = [(t or "", r or "") for k, t, r in pairs if k == theme]
        assert got[theme].cer == pytest.approx(sum(distance(*x) for x in own) / sum(len(t) for t, _ in own))
    assert (got["b"].exact, got["b"].exact_no_space) == (1, 2)
    near = {(r.truth, r.read): r.edits for r in metrics.substring_distance(table).collect()}
    assert all(v == distance(k[0] or "", k[1] or "", True) for k, v in near.items())
