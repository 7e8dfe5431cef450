"""Labels with errors and translations, values behind, beside and below them."""

import random

from pyspark.sql import functions as F

from maskwright.operators import fields
from maskwright.sources import ingest

BOXED = "page_id long, line_no int, text string, l double, t double, r double, b double"


def cells(spark, pages, h=20):
    rows = []
    for p, lines in enumerate(pages):
        for i, (text, l, t, *own) in enumerate(lines):
            high = own[0] if own else h
            rows.append((p, i, text, float(l), float(t), float(l) + high * len(text), float(t) + high))
    return fields.cells_of(spark.createDataFrame(rows, BOXED))


def test_cells(spark):
    got = cells(spark, [[("Name  Age city", 0, 0), ("", 0, 40), (" x", 0, 80)]]).orderBy("line_no", "cell").collect()
    assert [(r.line_no, r.cell, r.start, r.text, r.l, r.r) for r in got] == [(0, 0, 0, "Name", 0, 80), (0, 1, 6, "Age city", 120, 280), (2, 0, 1, "x", 20, 40)]


def test_within_one_against_brute_force(spark):
    r = random.Random(3)

    def osa(a, b):
        d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    pairs = [("".join(r.choices("abc", k=r.randint(6, 9))), "".join(r.choices("abc", k=r.randint(6, 9)))) for _ in range(800)]
    for a, _ in pairs[:300]:
        i = r.randrange(len(a) - 1)
        pairs.append((a, r.choice([a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "x" + a[i + 1 :], a[:i] + a[i + 1] + a[i] + a[i + 2 :]])))
    df = spark.createDataFrame(pairs, "a string, b string")
    shared = F.arrays_overlap(fields.deletions(F.col("a")), fields.deletions(F.col("b")))
    for x in df.select("a", "b", fields.within_one(F.col("a"), F.col("b")).alias("one"), shared.alias("shared")).collect():
        assert x.one == (osa(x.a, x.b) <= 1), (x.a, x.b)
        assert x.shared or not x.one or min(len(x.a), len(x.b)) < fields.FUZZY_FROM - 1


PAGES = [
    [("Name: John Smith", 0, 0)],
    [("姓名/Name: 张三", 0, 0)],
    [("姓名 Narne 张三", 0, 0)],
    [("收货人张三", 0, 0)],
    [("Date of Brith: 12 May 1990", 0, 0)],
    [("Dte of Brith: 12 May 1990", 0, 0)],  # two errors
    [("Nana: John Smith", 0, 0)],  # too short for errors
    [("Name / Address / Sex", 0, 0), ("John Smith", 0, 40)],  # a header row has a column below
    [("Name: 请输入姓名", 0, 0)],
    [("Name: Enter your name", 0, 0)],
    [("Passport No.", 0, 0), ("E12345678", 300, 2)],  # beside
    [("Passport No.", 0, 0), ("E12345678", 480, 2)],  # over ten heights away
    [("Passport No.", 0, 0), ("Nationality", 260, 2), ("E12345678", 500, 2)],  # the next cell is a label
    [("vin: 1M8GDM9AXKP042788", 0, 0)],  # an acronym in capitals only
    [("VIN: 1M8GDM9AXKP042788", 0, 0)],
    [("Name: John Smith Address: 12 Main Street", 0, 0)],
    [("Typeface: Arial Black", 0, 0)],
]
WANT = {0: [("name", "John Smith", "line")], 1: [("name", "张三", "line")], 2: [("name", "张三", "line")], 3: [("name", "张三", "line")], 4: [("birth", "12 May 1990", "line")], 10: [("passport", "E12345678", "right")], 12: [("nationality", "E12345678", "right")], 14: [("vin", "1M8GDM9AXKP042788", "line")], 15: [("address", "12 Main Street", "line"), ("name", "John Smith", "line")]}


def test_labels_and_values(spark):
    got = {}
    for r in fields.labelled(cells(spark, PAGES)).collect():
        got.setdefault(r.page_id, []).append((r.field, r.token, r.way))
    assert {p: sorted(x) for p, x in got.items()} == WANT


STACKS = [
    [("Surname", 0, 0), ("SMITH", 0, 25), ("JOHN", 0, 50)],
    [("Surname", 0, 0), ("SMITH", 0, 25), ("JOHN", 0, 100)],  # the second gap is wider
    [("Surname", 0, 0), ("SMITH", 0, 60)],  # a height and a half at most
    [("Surname   Passport No", 0, 0), ("SMITH", 0, 25), ("E12345678", 205, 26)],  # two columns
    [("Surname", 0, 0), ("Nationality", 0, 25), ("SMITH", 0, 50)],  # a label in between
    [("Surname", 0, 0), ("S", 0, 22, 70), ("SMITH", 0, 25)],  # a watermark
    [("Address", 0, 0, 12), ("12 Main Street", 0, 16, 12), ("Flat 4", 0, 32, 12), ("Springfield", 0, 48, 12), ("a fourth line", 0, 64, 12)],
    [("Name / Address", 0, 0), ("John", 0, 25)],
    [("Surname", 400, 0), ("SMITH", 0, 25)],  # not in the column
]


def test_stacked(spark):
    got = {}
    for r in fields.stacked(cells(spark, STACKS)).collect():
        got.setdefault(r.page_id, []).append((r.step, r.field, r.token))
    assert {p: sorted(x) for p, x in got.items()} == {
        0: [(1, "name", "SMITH"), (2, "name", "JOHN")],
        1: [(1, "name", "SMITH")],
        3: [(1, "name", "SMITH"), (1, "passport", "E12345678")],
        5: [(1, "name", "SMITH")],
        6: [(1, "address", "12 Main Street"), (2, "address", "Flat 4"), (3, "address", "Springfield")],
        7: [(1, "name", "John")],
    }


def test_a_page_of_very_many_cells(spark):
    lines = spark.range(30_000).selectExpr("1L page_id", "cast(id as int) line_no", "case when id % 3 = 0 then 'Surname' when id % 3 = 1 then 'SMITH' else '12' end text")
    boxed = ingest.with_boxes(lines).withColumn("t", F.col("line_no") * 25).withColumn("b", F.col("t") + 20)
    assert fields.stacked(fields.cells_of(boxed)).count() == 10_000
