"""Glyphs, seams and rounds of joins against plain Python."""

import random

from maskwright.operators import glyphs, graph, seams

BOX = "page_id long, line_no int, text string, confidence double, l double, t double, r double, b double"


def test_components_of_chains_and_random_links(spark):
    r = random.Random(6)
    links, nodes = [], list(range(120))
    chain = r.sample(range(60), 60)
    links += list(zip(chain, chain[1:]))
    links += [(r.randint(60, 119), r.randint(60, 119)) for _ in range(35)]
    got = {x.node: x.component for x in graph.components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "a long, b long")).collect()}
    want = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_greedy_choice(spark):
    r = random.Random(7)
    for n in (12, 40):
        pairs = sorted({tuple(sorted(r.sample(range(n), 2))) for _ in range(n)})
        got = sorted(x.node for x in graph.greedy(spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(pairs, "early long, late long")).collect())
        kept = []
        for i in range(n):
            if not any((k, i) in pairs for k in kept):
                kept.append(i)
        assert got == kept


def test_seams(spark):
    bands = spark.createDataFrame([(1, k, k * 100, k * 100 + 150, 550) for k in range(5)], "page_id long, k int, top int, bottom int, height int")
    boxes = [
        (1, 0, 0, 10, 10, 50, 30),  # whole, alone
        (1, 0, 1, 10, 110, 50, 130), (1, 1, 1, 10, 110, 50, 131),  # found twice
        (1, 0, 2, 200, 90, 240, 150), (1, 1, 2, 200, 100, 240, 250), (1, 2, 2, 200, 200, 240, 350), (1, 3, 2, 200, 300, 240, 400),  # in four pieces
        (1, 4, 3, 300, 401, 340, 450),  # a piece by itself
    ]
    got = seams.merged_bands(spark.createDataFrame(boxes, "page_id long, k int, i int, l int, t int, r int, b int"), bands).collect()
    assert sorted((x.l, x.t, x.r, x.b, x.pieces) for x in got) == [(10, 10, 50, 30, 1), (10, 110, 50, 130, 1), (200, 90, 240, 400, 4), (300, 401, 340, 450, 1)]


def _merged(boxes, bands, most=0.5):
    """What merged_bands() states, for the boxes (k, l, t, r, b) of one page, in plain Python."""
    size = lambda x: (x[3] - x[1]) * (x[4] - x[2])
    both = lambda x, y: max(min(x[3], y[3]) - max(x[1], y[1]), 0) * max(min(x[4], y[4]) - max(x[2], y[2]), 0)
    covers = lambda x, y: both(x, y) > 0 and both(x, y) / min(size(x), size(y)) > most
    kept, pieces, groups = [], [], []
    for x in sorted(boxes):
        top, bottom, height = bands[x[0]]
        if top > 0 and x[2] < top + seams.EDGE or bottom < height and x[4] > bottom - seams.EDGE:
            pieces.append(x)
        elif not any(y[0] != x[0] and covers(y, x) for y in kept):
            kept.append(x)
    for x in pieces:
        if not any(covers(y, x) for y in kept):
            near = [g for g in groups if any(both(x, y) > 0 for y in g)]
            groups = [g for g in groups if g not in near] + [sum(near, [x])]
    return sorted((len(g), *[float(pick(y[n] for y in g)) for n, pick in ((1, min), (2, min), (3, max), (4, max))]) for g in [[x] for x in kept] + groups)


def test_seams_of_pages_merged_in_place_and_by_rounds(spark, monkeypatch):
    r = random.Random(3)
    edges = {k: (k * 90, k * 90 + 150, 510) for k in range(5)}
    pages = {f"p{p}": [] for p in range(12)}
    for p, boxes in enumerate(pages.values()):
        for _ in range((1, 3, 8, 40)[p % 4]):
            l, t, w, h = r.randint(0, (60, 400)[p % 2]), r.randint(0, 505), r.choice([0, 4, 30, 90]), r.choice([-3, 0, 3, 20, 60, 300])
            for k, (top, bottom, _) in edges.items():
                if t < bottom and t + h > top or r.random() < 0.02:  # as it is cut, or found a little beside it
                    boxes.append((k, l + r.choice([0, 0, 1]), max(t, top) if r.random() < 0.9 else t, l + w, min(t + h, bottom)))
    rows = [(p, k, i, *map(float, box)) for p, boxes in pages.items() for i, (k, *box) in enumerate(boxes)]
    table = spark.createDataFrame(rows, "page_id string, k int, i int, l double, t double, r double, b double").repartition(3)
    bands = spark.createDataFrame([(p, k, *at) for p in pages for k, at in edges.items()], "page_id string, k int, top int, bottom int, height int")
    wanted = sorted((p, *x) for p, boxes in pages.items() for x in _merged(boxes, edges))
    most_in_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(most_in_batch)
    try:
        for most, size in ((2000, 10_000), (2000, 7), (20, 7), (1, 3)):  # batches end within pages; pages may be too large
            monkeypatch.setattr(seams, "MOST", most)
            spark.conf.set(most_in_batch, size)
            got = seams.merged_bands(table, bands).collect()
            assert sorted((x.page_id, x.pieces, x.l, x.t, x.r, x.b) for x in got) == wanted
    finally:
        spark.conf.set(most_in_batch, before)


def test_seams_of_a_page_that_meets_in_many_pairs(monkeypatch):
    import numpy as np

    r = np.random.default_rng(4)
    l, t = r.integers(0, 300, (2, 500)).astype(float)
    edges = np.repeat([0, 1, 2], [300, 0, 200]), l, t, l + 40, t + r.integers(1, 90, 500)
    pairs = sorted((i, j) for i in range(500) for j in range(i) if edges[0][i] == edges[0][j] and min(edges[3][i], edges[3][j]) > max(l[i], l[j]) and min(edges[4][i], edges[4][j]) > max(t[i], t[j]))
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(seams, "PAIRS", most)
        x, y, _ = seams._meeting(*edges)
        assert sorted(zip(np.maximum(x, y).tolist(), np.minimum(x, y).tolist())) == pairs


def test_seams_of_boxes_without_numbers(spark):
    nan, band = float("nan"), (0, 150, 150)
    rows = [(1, 0, 0, 1.0, 10.0, 5.0, 20.0, *band), (2, 0, 0, nan, 10.0, 5.0, 20.0, *band), (2, 0, 1, 10.0, 40.0, 50.0, 60.0, *band), (None, 0, 0, 1.0, 10.0, 5.0, 20.0, *band)]
    found = spark.createDataFrame(rows, "page_id long, k int, i int, l double, t double, r double, b double, top int, bottom int, height int")
    got = seams.merged(found.coalesce(1)).collect()
    assert sorted((x.page_id or 0, str(x.l), x.t) for x in got) == [(0, "1.0", 10.0), (1, "1.0", 10.0), (2, "10.0", 40.0), (2, "nan", 10.0)]


def test_glyphs_and_doubles(spark):
    lines = [(1, 0, "a中 b", 0.9, 0.0, 0.0, 50.0, 10.0), (1, 1, "a中 b", 0.8, 1.0, 0.0, 50.0, 10.0), (1, 2, "", 0.9, 0.0, 40.0, 0.0, 50.0), (2, 0, "a中 b", 0.8, 1.0, 0.0, 50.0, 10.0)]
    kept = glyphs.distinct_lines(spark.createDataFrame(lines, BOX))
    assert sorted((x.page_id, x.line_no) for x in kept.collect()) == [(1, 0), (1, 2), (2, 0)]
    got = glyphs.glyphs_of(kept).where("page_id = 1").orderBy("line_no", "i").collect()
    assert [(x.c, x.space, x.l, x.r) for x in got] == [("a", False, 0, 10), ("中", False, 10, 30), ("b", True, 40, 50)]


def test_touches_strokes_and_selections(spark):
    r = random.Random(1)
    boxes = [(p, i, float(x), float(y), float(x + r.choice([5, 30, 300])), float(y + r.choice([5, 30, 200]))) for p in (1, 2) for i in range(60) for x, y in [(r.randint(0, 400), r.randint(0, 400))]]
    touches = [(i, r.choice([1, 2]), r.randint(-20, 450) + 0.5, r.randint(-20, 450) + 0.25) for i in range(150)]
    df = spark.createDataFrame(boxes, "page_id long, glyph int, l double, t double, r double, b double")

    def plain(page, x, y, reach):
        best = None
        for p, g, l, t, rr, b in boxes:
            dx, dy = max(l - x, x - rr, 0), max(t - y, y - b, 0)
            if p == page and dx * dx + dy * dy <= reach * reach:
                key = (dx * dx + dy * dy, (rr - l) * (b - t) if dx == dy == 0 else 0, g)
                best = min(best or key, key)
        return best and best[2]

    got = {x.touch_id: x.glyph for x in glyphs.glyph_at(spark.createDataFrame(touches, "touch_id int, page_id long, x double, y double"), df, 9.0).collect()}
    assert got == {i: g for i, p, x, y in touches if (g := plain(p, x, y, 9.0)) is not None}
    stroke = spark.createDataFrame([(1, 1, 0.0, 0.0, 400.0, 300.0)], "stroke_id int, page_id long, x0 double, y0 double, x1 double, y1 double")
    first = {}
    for k in range(51):
        g = plain(1, 400 * k / 50, 300 * k / 50, 9.0)
        if g is not None:
            first.setdefault(g, k)
    assert {x.glyph: x.first for x in glyphs.glyphs_along(stroke, df, 9.0, 10.0).collect()} == first
    row = spark.createDataFrame([(1, i, 0 if i < 6 else 1, x, 0.0, x + 10, 10.0) for i, x in enumerate([0.0, 10.0, 21.0, 45.0, 55.0, 65.0, 75.0])], "page_id long, glyph int, line_no int, l double, t double, r double, b double")
    chosen = spark.createDataFrame([(1, i) for i in (0, 1, 2, 3, 5, 6)], "page_id long, glyph int")
    assert [(x["first"], x["last"], x.l, x.r) for x in glyphs.runs(chosen, row).orderBy("first").collect()] == [(0, 2, 0, 31), (3, 3, 45, 55), (5, 5, 65, 75), (6, 6, 75, 85)]
    other = spark.createDataFrame([(1, 0), (1, 4)], "page_id long, glyph int")
    ids = lambda d: sorted(x.glyph for x in d.collect())
    assert ids(glyphs.toggled(chosen, other)) == [1, 2, 3, 4, 5, 6] and ids(glyphs.swept(chosen, other, True)) == [0, 1, 2, 3, 4, 5, 6] and ids(glyphs.swept(chosen, other, False)) == [1, 2, 3, 5, 6]
