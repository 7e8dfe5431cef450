"""Components against flood fill, boxes of turned and level text, axes of pages."""

import random

import numpy as np
from pyspark.sql import functions as F

from maskwright.functions import geometry as G
from maskwright.operators import axis, detect


def flood(mask):
    seen, out = set(), []
    for start in zip(*np.nonzero(mask)):
        if start in seen:
            continue
        todo, own = [start], []
        seen.add(start)
        while todo:
            y, x = todo.pop()
            own.append((y, x))
            for p in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p] and p not in seen:
                    seen.add(p)
                    todo.append(p)
        out.append(sorted(own))
    return out


def test_components_equal_flood_fill():
    r = np.random.default_rng(4)
    for _ in range(300):
        mask = r.random((r.integers(1, 12), r.integers(1, 12))) < r.choice([0.2, 0.5, 0.7])
        got = [sorted((y, x) for y, a, b in runs for x in range(a, b)) for runs in detect.connected(mask)]
        assert sorted(got) == sorted(flood(mask))


def test_boxes(spark):
    page = np.zeros((40, 60))
    page[5:10, 10:40] = 0.9  # level
    page[20:23, 5:7] = 0.9  # too thin
    page[30:36, 10:30] = 0.4  # too faint
    maps = [(1, 60, page.ravel().tolist()), (2, 60, []), (3, None, None)]
    got = detect.text_boxes(spark.createDataFrame(maps, "map_id int, width int, values array<double>")).select("map_id", G.bounds(F.col("quad")).alias("o")).collect()
    d = 30 * 5 * 1.5 / 70
    assert len(got) == 1 and got[0].map_id == 1
    assert [round(v, 6) for v in got[0].o] == [round(v, 6) for v in (10 - d, 5 - d, 40 + d, 10 + d)]


PAGES = {
    "level": ([(1, 100), (0, 80), (3, 90)], 0.0),
    "snapped apart": ([(10, 100), (12, 80), (8, 90)], 10.0),
    "upright group": ([(0, 100), (0, 100), (0, 100), (90, 20), (91, 20), (89, 20)], 90.0),
    "level lines under a long watermark": ([(30, 300), (30, 300), (0, 200), (1, 100)], 0.0),
    "no direction": ([(30, 100), (-40, 100), (60, 100)], None),
    "short boxes have no say": ([(45, 5), (0, 50)], 0.0),
    "half a turn is the same axis": ([(179, 100), (-179, 100), (0, 10)], 0.0),
}


def test_axes(spark):
    rows = [(name, i, float(d), float(n), 10.0) for name, (lines, _) in PAGES.items() for i, (d, n) in enumerate(lines)]
    lines = spark.createDataFrame(rows, "page_id string, line_no int, degrees double, length double, height double")
    found = axis.text_axis(lines)
    got = {r.page_id: r.axis for r in found.collect()}
    assert got.keys() == PAGES.keys()
    for name, (_, want) in PAGES.items():
        assert (got[name] is None) == (want is None) and (want is None or abs(got[name] - want) < 0.5), name
    ranked = axis.samples(lines, found).where("page_id = 'upright group'").orderBy("rank").collect()
    assert [r.line_no for r in ranked] == [3, 4, 5]
    fits = spark.createDataFrame([(5.0, 50.0, 10.0), (95.0, 50.0, 10.0), (45.0, 50.0, 10.0), (92.0, 11.0, 10.0), (45.0, 11.0, 10.0), (0.0, 0.0, 0.0)], "d double, l double, h double")
    assert [r.f for r in fits.select(axis.fit(F.col("d"), F.col("l"), F.col("h"), F.lit(0.0)).alias("f")).collect()] == ["ALONG", "CROSS", "OTHER", "SQUARE", "OTHER", "OTHER"]
