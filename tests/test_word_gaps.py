"""Blanks and cuts of drawn lines, and of random strips against a search over all columns."""

import math

import numpy as np
import pytest

from maskwright.operators import word_gaps as G

STRIPS = "strip_id int, width int, gray array<double>"
GLYPHS = "strip_id int, pos int, token string, x double"


def drawn(*bars, width=100, height=20, paper=1.0, ink=0.0):
    """A strip with bars (from, to) of full height but for two rows above and below."""
    page = np.full((height, width), paper)
    for a, b in bars:
        page[2:-2, a:b] = ink
    return page


def blank_by_hand(left, right, lx, rx, ink):
    counts, rows = ink.sum(axis=0), np.nonzero(ink.any(axis=1))[0]
    tall = rows[-1] - rows[0] + 1 if rows.size else ink.shape[0]
    gaps, a = [], None
    for c in range(ink.shape[1] + 1):
        if c < ink.shape[1] and counts[c] == 0:
            a = c if a is None else a
        elif a is not None:
            if a > 0 and c < ink.shape[1] and lx < (a + c) / 2 < rx:
                gaps.append(c - a)
            a = None
    if not gaps or " " in (left, right):
        return False
    if ord(left) > 127 or ord(right) > 127:
        need = 0.3
    elif left in "0123456789" and right in "0123456789":
        need = 0.45
    elif left.isalnum() and right.isalnum():
        need = 0.6
    else:
        return False
    return max(gaps) >= tall * need


def cut_by_hand(lx, rx, ink):
    counts, mid = ink.sum(axis=0).tolist(), (lx + rx) / 2
    lo, hi = (min(max(v, 0), len(counts)) for v in (math.ceil(lx), math.floor(rx)))
    runs, c = [], lo
    while c < hi:
        a = c
        while c < hi and counts[c] == 0:
            c += 1
        if c > a:
            runs.append((a + c) / 2)
        c = max(c, a + 1)
    if runs:
        return min(runs, key=lambda v: (abs(v - mid), v))
    q = (rx - lx) / 4
    inner = [c for c in range(len(counts)) if lx + q <= c <= rx - q]
    return min(inner, key=lambda c: (counts[c], abs(c + 0.5 - mid), c)) + 0.5 if inner else mid


def test_blanks_by_script(spark):
    # Text sixteen high: a blank takes 4.8 pixels, between digits 7.2, between Latin letters 9.6.
    gap = lambda n: drawn((10, 20), (20 + n, 30 + n))
    cases = [("件", "0", 5, True), ("件", "0", 4, False), ("9", "1", 5, False), ("9", "1", 8, True), ("a", "b", 8, False), ("a", "1", 10, True), ("*", "9", 30, False), ("a", " ", 30, False), ("ff", "i", 5, True)]
    strips = [(i, 100, gap(n).ravel().tolist()) for i, (_, _, n, _) in enumerate(cases)]
    glyphs = [(i, p, t, x) for i, (a, b, n, _) in enumerate(cases) for p, t, x in ((0, a, 15.0), (1, b, 25.0 + n))]
    found = G.between(spark.createDataFrame(strips, STRIPS), spark.createDataFrame(glyphs, GLYPHS))
    assert {r.strip_id: r.blank for r in found.where("pos = 1").collect()} == {i: want for i, (_, _, _, want) in enumerate(cases)}
    assert {r.strip_id: r.text for r in G.spaced(found).collect()} == {i: a + " " * want + b for i, (a, b, _, want) in enumerate(cases)}


def test_dark_paper_and_elements(spark):
    strips = spark.createDataFrame([(1, 100, drawn((10, 20), (24, 30), (60, 90), paper=0.1, ink=0.9).ravel().tolist())], STRIPS)
    glyphs = spark.createDataFrame([(1, 0, "收", 15.0), (1, 1, "件", 27.0), (1, 2, "人", 75.0), (1, 3, " ", None)], GLYPHS)
    found = G.between(strips, glyphs)
    assert [r.text for r in G.spaced(found).collect()] == ["收件 人 "]
    boxes = [(r.token, r.l, r.r) for r in G.elements(found, strips).orderBy("pos").collect()]
    assert boxes == [("收", 0.0, 22.0), ("件", 22.0, 45.0), ("人", 45.0, 100.0)]


def test_random_strips(spark):
    r = np.random.default_rng(11)
    strips, glyphs, want = [], [], {}
    for k in range(120):
        width, height = int(r.integers(4, 40)), int(r.integers(2, 12))
        ink = r.random((height, width)) < 0.4
        ink[:, r.random(width) < r.choice([0.0, 0.3, 0.6])] = False
        ink &= np.cumsum(ink.ravel()).reshape(ink.shape) * 2 < ink.size
        strips.append((k, width, np.where(ink, 0.2, 0.9).ravel().tolist()))
        xs = sorted(r.uniform(-2, width + 2, 4).round(2).tolist())
        tokens = [str(t) for t in r.choice(list("件a1- 9Z"), 4)]
        glyphs += [(k, p, t, x) for p, (t, x) in enumerate(zip(tokens, xs))]
        for p in range(1, 4):
            want[k, p] = (bool(blank_by_hand(tokens[p - 1], tokens[p], xs[p - 1], xs[p], ink)), cut_by_hand(xs[p - 1], xs[p], ink))
    found = G.between(spark.createDataFrame(strips, STRIPS).repartition(3), spark.createDataFrame(glyphs, GLYPHS)).where("pos > 0").collect()
    assert len(found) == len(want)
    for row in found:
        blank, at = want[row.strip_id, row.pos]
        assert row.blank == blank and row["cut"] == pytest.approx(at), (row, blank, at)


def test_cases(spark):
    strips = [(1, 4, []), (2, None, [0.5] * 8), (3, 3, [0.5] * 8), (4, 4, None), (5, 4, [None, float("nan"), 1.0, 1.0]), (5, 4, [None, float("nan"), 1.0, 1.0])]
    glyphs = [(k, p, t, x) for k in range(1, 7) for p, t, x in ((0, "一", 0.5), (1, "二", 3.5), (2, None, None))]
    one = spark.createDataFrame(strips, STRIPS)
    found = G.between(one, spark.createDataFrame([(*g, "own") for g in glyphs], GLYPHS + ", height string"))
    rows = found.collect()
    assert len(rows) == 18 and not any(r.blank for r in rows) and {r.height for r in rows} == {"own"}
    assert {r["cut"] for r in rows if r.pos == 1} == {2.0} and {r["cut"] for r in rows if r.pos == 2} == {None}
    assert G.spaced(found).where("text <> '一二'").count() == 0
    # Strips without a width have no right edge; glyphs without a token or a strip are kept or left out as stated.
    assert {(r.strip_id, r.pos, r.l, r.r) for r in G.elements(found, one).where("strip_id in (2, 3, 6)").collect()} == {(2, 0, 0.0, 2.0), (2, 1, 2.0, None), (3, 0, 0.0, 2.0), (3, 1, 2.0, 3.0)}
    none = spark.createDataFrame([], GLYPHS)
    assert G.between(one, none).count() == 0 and G.profiles(one.limit(0)).count() == 0
