"""Lines whose Chinese is set apart, read without the blanks between and told in places of the line."""

import random

from pyspark.sql import functions as F

from maskwright.functions import text as T
from maskwright.operators import redact, rules


def is_han(c):
    return "一" <= c <= "鿿"


def wide(c):
    return is_han(c) or "、" <= c <= "〿" or "！" <= c <= "￯"


def by_hand(line):
    parts = [p for p in line.split(" ") if any(map(is_han, p))]
    if len(parts) < 2 or 2 * sum(len(p) == 1 for p in parts) <= len(parts):
        return line, None
    drop = {i for i in range(1, len(line) - 1) if line[i] == " " and " " not in (line[i - 1], line[i + 1]) and (wide(line[i - 1]) or wide(line[i + 1]))}
    left = [i for i in range(len(line)) if i not in drop]
    return "".join(line[i] for i in left), left


def test_views_equal_those_by_hand(spark):
    r = random.Random(5)
    lines = ["".join(r.choice("张三收货北： 　    a1😀。") for _ in range(r.randint(0, 14))) for _ in range(1500)]
    lines += ["收 货 地 址 是 北 京", "收货人 张三", "姓 名", "收 合肥市", "", " 张 三 ", "一  二 三"]
    df = spark.createDataFrame(list(enumerate(lines)) + [(-1, None)], "i int, t string").select("i", T.han_view(F.col("t")).alias("v"))
    got = {row.i: (row.v.text, row.v.origin) for row in df.collect()}
    assert got.pop(-1) == (None, None)
    for i, line in enumerate(lines):
        assert got[i] == by_hand(line), line
    assert sum(o is not None for _, o in got.values()) > 50


LINES = [
    ("姓 名 ： 沐 晨 冉", "PERSON_NAME", "沐 晨 冉"),
    ("请 交 给 收 件 人 : 张 三", "PERSON_NAME", "张 三"),
    ("北 京 市 朝 阳 区 建 国 路 1 8 号", "POSTAL_ADDRESS", None),
    ("出 生 日 期 ： 1990-05-12", "BIRTH_DATE", "1990-05-12"),
    ("收货人 张三", "PERSON_NAME", "张三"),
    ("晴 天 下 雨", None, None),
]


def test_rules_read_views(spark):
    lines = spark.createDataFrame([(i, 0, t, 0.95) for i, (t, _, _) in enumerate(LINES)], "page_id int, line_no int, text string, confidence double")
    states = {r.id: "OFF" for r in rules.CATALOGUE if r.id not in ("name", "address", "birthdate")}
    found = {}
    for h in rules.matches(lines, states).collect():
        assert LINES[h.page_id][0][h.start : h.end] == h.token
        found.setdefault(h.page_id, []).append((h.kind, h.token))
    for i, (line, kind, token) in enumerate(LINES):
        if kind is None:
            assert i not in found, line
        else:
            assert [k for k, _ in found[i]] == [kind] and token in (None, found[i][0][1]), (line, found[i])
    docs = spark.createDataFrame([(1, "plain\n姓 名 ： 沐 晨 冉")], "doc_id int, text string")
    assert redact.redact_documents(docs, states).first().redacted == "plain\n姓 名 ： [PERSON_NAME]"
