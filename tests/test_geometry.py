"""Turned quads against sampling and against what they were made from."""

import math
import random

import pytest
from pyspark.sql import functions as F

from maskwright.functions import geometry as G


def turned(cx, cy, w, h, degrees):
    a = math.radians(degrees)
    return [(cx + x * math.cos(a) - y * math.sin(a), cy + x * math.sin(a) + y * math.cos(a)) for x, y in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]


def inside(quad, x, y):
    return all((b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) >= -1e-9 for a, b in zip(quad, quad[1:] + quad[:1]))


def test_turned_quads(spark):
    r = random.Random(3)
    pairs = [(turned(50, 50, 40, 20, r.uniform(0, 180)), turned(50 + r.uniform(-15, 15), 50 + r.uniform(-15, 15), 30, 25, r.uniform(0, 180))) for _ in range(12)]
    points = [(x + 0.5, y + 0.5) for x in range(100) for y in range(100)]
    table = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], f"id int, a {G.QUAD}, b {G.QUAD}")
    c = F.col
    table = table.select("*", G.iou("a", "b").alias("iou"), G.iou("a", F.reverse("b")).alias("other_way"), G.bounding_quad("a").alias("h"), G.expanded("a", F.lit(2.0)).alias("e"))
    got = table.select("id", "iou", "other_way", G.area(c("h")).alias("hull"), G.area(c("e")).alias("grown"), G.short_edge(c("a")).alias("short"), G.contains(c("b"), F.lit(50.0), F.lit(50.0)).alias("holds"))
    for row in got.collect():
        a, b = pairs[row.id]
        both = sum(inside(a, *p) and inside(b, *p) for p in points)
        either = sum(inside(a, *p) or inside(b, *p) for p in points)
        assert row.iou == pytest.approx(both / either, abs=0.03) and row.other_way == pytest.approx(row.iou)
        assert row.hull == pytest.approx(800, rel=1e-6) and row.grown == pytest.approx(44 * 24, rel=1e-6) and row.short == pytest.approx(20)
        assert row.holds == inside(b, 50, 50)


def test_many_hulls_and_offsets_are_those_of_single_ones():
    import random

    import numpy as np

    from maskwright.functions import geometry as G

    r = random.Random(4)
    for n in (1, 2, 3, 4, 5, 8):
        sets = [[(float(r.randint(0, 9)), float(r.randint(0, 9))) if k % 2 else (r.uniform(0, 99), r.uniform(0, 99)) for _ in range(n)] for k in range(200)]
        x, y = (np.array([[p[i] for p in s] for s in sets]) for i in (0, 1))
        for s, a, b in zip(sets, *G._least_rectangles(x, y)):
            want, got = G._least_rectangle(s), list(zip(a, b))
            assert abs(abs(G._area(want)) - abs(G._area(got))) < 1e-6
        for s, a, b in zip(sets, *G._grown_all(x, y, np.full(len(sets), 3.0))):
            assert np.allclose(G._grown(s, 3.0), list(zip(a, b)))
