"""Common subsequences by brute force and card fronts, clean and badly read."""

import random

from pyspark.sql import functions as F

from maskwright.operators import cards


def plain_lcs(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def test_lcs(spark):
    r = random.Random(2)
    pairs = [("".join(r.choices("abcd", k=r.randint(0, 8))), "".join(r.choices("abcd", k=r.randint(0, 8)))) for _ in range(300)]
    for x in spark.createDataFrame(pairs, "a string, b string").select("a", "b", cards.lcs(F.col("a"), F.col("b")).alias("n")).collect():
        assert x.n == plain_lcs(x.a, x.b), (x.a, x.b)


NUMBER = "11010519491231002X"
CARD = [("姓名 张 三", 0, 0), ("性别 男 民族 汉", 0, 40), ("出生1949年12月31日", 0, 80), ("住址 北京市朝阳区建国路8号", 0, 120), ("3单元502室", 44, 150), (f"公民身份号码 {NUMBER}", 0, 200)]


def on_pages(spark, pages):
    rows = [(p, i, text, float(l), float(t), float(l + 20 * len(text)), float(t + 20)) for p, lines in enumerate(pages) for i, (text, l, t) in enumerate(lines)]
    out = {}
    for x in cards.fronts(spark.createDataFrame(rows, "page_id long, line_no int, text string, l double, t double, r double, b double")).collect():
        out.setdefault(x.page_id, []).append((x.line_no, x.kind, x.token))
    return {p: sorted(v) for p, v in out.items()}


def test_fronts(spark):
    whole = [(0, "PERSON_NAME", "张三"), (3, "POSTAL_ADDRESS", "北京市朝阳区建国路8号"), (4, "POSTAL_ADDRESS", "3单元502室")]
    bad_number = CARD[:-1] + [("公尾身分号码 110105194912310999", 0, 200)]  # two characters of the label wrong, and the check digit
    lost_label = CARD[:-1] + [("合同编号 110105194912310999", 0, 200)]
    no_rows = [CARD[0], CARD[3], CARD[5]]
    far = CARD[:-1] + [(CARD[5][0], 0, 2000)]
    swapped = [CARD[0], (CARD[2][0], 0, 40), (CARD[1][0], 0, 80), *CARD[3:]]
    got = on_pages(spark, [CARD, bad_number, lost_label, no_rows, far, swapped])
    assert got == {0: whole, 1: whole}
