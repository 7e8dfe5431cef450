"""Quadrilaterals as ARRAY<STRUCT<x, y>>, clockwise from the top left: measures as native expressions; clipping, hulls and
offsets as small vectorised helpers over Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

QUAD = "array<struct<x:double,y:double>>"


def of_box(l: Column, t: Column, r: Column, b: Column) -> Column:
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(point(l, t), point(r, t), point(r, b), point(l, b))


def _next(quad: Column, i: Column) -> Column:
    return F.get(quad, (i + 1) % F.size(quad))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def area(quad: Column) -> Column:
    return F.abs(_sum(F.transform(quad, lambda p, i: p["x"] * _next(quad, i)["y"] - _next(quad, i)["x"] * p["y"]))) / 2


def bounds(quad: Column) -> Column:
    xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("l"), F.array_min(ys).alias("t"), F.array_max(xs).alias("r"), F.array_max(ys).alias("b"))


def edges(quad: Column) -> tuple[Column, Column, Column, Column]:
    """l, t, r, b of a quad of four points, as columns that joins can compare without a loop over an array."""
    at = lambda c: [F.get(quad, F.lit(i))[c] for i in range(4)]
    return F.least(*at("x")), F.least(*at("y")), F.greatest(*at("x")), F.greatest(*at("y"))


def may_meet(a: Column, b: Column) -> Column:
    """Whether the bounds of two quads share an area: only then can the quads."""
    (al, at, ar, ab), (bl, bt, br, bb) = edges(a), edges(b)
    return (al < br) & (bl < ar) & (at < bb) & (bt < ab)


def center(quad: Column) -> Column:
    mean = lambda c: _sum(F.transform(quad, lambda p: p[c])) / F.size(quad)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def short_edge(quad: Column) -> Column:
    return F.array_min(F.transform(quad, lambda p, i: F.hypot(p["x"] - _next(quad, i)["x"], p["y"] - _next(quad, i)["y"])))


def scaled(quad: Column, by: Column) -> Column:
    return F.transform(quad, lambda p: F.struct((p["x"] * by).alias("x"), (p["y"] * by).alias("y")))


def sliced(quad: Column, start: Column, end: Column) -> Column:
    """The part of a quad from a share of its width to another, along its upper and lower edges."""

    def on(a: Column, b: Column, s: Column) -> Column:
        return F.struct((a["x"] + (b["x"] - a["x"]) * s).alias("x"), (a["y"] + (b["y"] - a["y"]) * s).alias("y"))

    q = [F.get(quad, F.lit(i)) for i in range(4)]
    return F.array(on(q[0], q[1], start), on(q[0], q[1], end), on(q[3], q[2], end), on(q[3], q[2], start))


def contains(quad: Column, x: Column, y: Column) -> Column:
    """Whether a point lies within, or on an edge: edges crossed by a ray to the right are counted."""

    def crossing(p, i):
        q = _next(quad, i)
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        return F.when((p["y"] > y) != (q["y"] > y), (x < at).cast("int")).otherwise(0)

    def on_edge(p, i):
        q = _next(quad, i)
        cross = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        within = x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))
        return (F.abs(cross) < 1e-9) & within

    odd = F.aggregate(F.transform(quad, crossing), F.lit(0), lambda a, v: a + v) % 2 == 1
    return F.coalesce(odd | F.exists(F.transform(quad, on_edge), lambda v: v), F.lit(False))


def turned(x: Column, y: Column, degrees: Column) -> Column:
    """A point turned about the origin: into a reading frame with degrees, out of it with their negative."""
    a = F.radians(degrees)
    return F.struct((x * F.cos(a) + y * F.sin(a)).alias("x"), (y * F.cos(a) - x * F.sin(a)).alias("y"))


def angle_between(a: Column, b: Column) -> Column:
    """The angle of two directions, 0 to 180 degrees."""
    d = F.abs(F.pmod(a - b, F.lit(360.0)))
    return F.least(d, 360.0 - d)


def _points(quad) -> list[tuple[float, float]]:
    return [(p["x"], p["y"]) for p in quad]


def _area(points) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def _clip(points, by):
    """What of a polygon lies within a convex one; which side is inside follows from the turning sense of the latter."""
    sense = 1 if _area(by) >= 0 else -1
    for a, b in zip(by, by[1:] + by[:1]):
        side = lambda p: sense * ((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]))  # noqa: B023, E731
        out = []
        for p, q in zip(points, points[1:] + points[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp > 0 > sq) or (sp < 0 < sq):
                k = sp / (sp - sq)
                out.append((p[0] + (q[0] - p[0]) * k, p[1] + (q[1] - p[1]) * k))
        points = out
        if not points:
            break
    return points


def _overlap(a, b) -> float:
    a, b = _points(a), _points(b)
    both = _clip(a, b)
    shared = abs(_area(both)) if len(both) > 2 else 0.0
    whole = abs(_area(a)) + abs(_area(b)) - shared
    return shared / whole if whole > 0 else 0.0


def _hull(points):
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for run in (points, points[::-1]):
        half = []
        for p in run:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return halves


def _least_rectangle(points):
    """The rectangle of least area around points: one of its sides lies on a side of their hull."""
    hull = _hull(points)
    if len(hull) < 3:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        return [(min(xs), min(ys)), (max(xs), min(ys)), (max(xs), max(ys)), (min(xs), max(ys))]
    best = None
    for (ax, ay), (bx, by) in zip(hull, hull[1:] + hull[:1]):
        n = math.hypot(bx - ax, by - ay)
        ux, uy = (bx - ax) / n, (by - ay) / n
        along, across = [x * ux + y * uy for x, y in hull], [y * ux - x * uy for x, y in hull]
        size = (max(along) - min(along)) * (max(across) - min(across))
        if best is None or size < best[0] - 1e-9:
            corners = [(s, c) for s, c in ((min(along), min(across)), (max(along), min(across)), (max(along), max(across)), (min(along), max(across)))]
            best = size, [(s * ux - c * uy, s * uy + c * ux) for s, c in corners]
    return best[1]


def _grown(points, by: float):
    """A convex polygon with every edge moved out by `by`; corners where moved edges meet."""
    sense = 1 if _area(points) >= 0 else -1
    lines = []
    for (ax, ay), (bx, by_) in zip(points, points[1:] + points[:1]):
        n = math.hypot(bx - ax, by_ - ay) or 1.0
        nx, ny = sense * (by_ - ay) / n, -sense * (bx - ax) / n
        lines.append((nx, ny, nx * ax + ny * ay + by))
    out = []
    for i, p in enumerate(points):
        (a, b, c), (d, e, f) = lines[i - 1], lines[i]
        det = a * e - b * d
        out.append(((c * e - b * f) / det, (a * f - c * d) / det) if abs(det) > 1e-9 else p)
    return out


def _iou_of(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_overlap(x, y) for x, y in zip(a, b)], dtype=float)


def _by_size(arrays: pa.Array):
    """Arrays of points by their number n: (rows, x, y), x and y of shape (rows, n)."""
    sizes = pc.list_value_length(arrays).to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    flat = arrays.flatten()
    x, y = (flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y"))
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        at = starts[rows][:, None] + np.arange(n)
        yield rows, x[at], y[at]


def _arrow_quads(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> pa.Array:
    """(rows, x, y) of all sizes as one array of quads in the order of rows."""
    size = np.zeros(n, np.int64)
    for rows, x, _ in found:
        size[rows] = x.shape[1]
    ends = np.cumsum(size)
    xs, ys = np.zeros(int(size.sum())), np.zeros(int(size.sum()))
    for rows, x, y in found:
        at = (ends - size)[rows][:, None] + np.arange(x.shape[1])
        xs[at], ys[at] = x, y
    points = pa.StructArray.from_arrays([pa.array(xs), pa.array(ys)], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), points)


def _grown_all(x: np.ndarray, y: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_grown for many polygons of one size."""
    x2, y2 = np.roll(x, -1, 1), np.roll(y, -1, 1)
    sense = np.where((x * y2 - x2 * y).sum(1) / 2 >= 0, 1, -1)[:, None]
    n = np.hypot(x2 - x, y2 - y)
    n[n == 0] = 1.0
    nx, ny = sense * (y2 - y) / n, -sense * (x2 - x) / n
    c = nx * x + ny * y + by[:, None]
    a, b, f0 = (np.roll(v, 1, 1) for v in (nx, ny, c))
    det = a * ny - b * nx
    ok = np.abs(det) > 1e-9
    safe = np.where(ok, det, 1.0)
    return np.where(ok, (f0 * ny - b * c) / safe, x), np.where(ok, (a * c - f0 * nx) / safe, y)


def _least_rectangles(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_least_rectangle for many sets of one size: the sides of each hull in turn, from its leftmost lowest point on."""
    m, n = x.shape
    row = np.arange(m)
    first = np.lexsort((y, x), axis=1)[:, 0] if n else np.zeros(m, int)
    at, corners, best = first.copy(), np.zeros((m, 4, 2)), np.full(m, np.inf)
    going, sides = np.ones(m, bool), np.zeros(m, int)
    for _ in range(n):
        dx, dy = x - x[row, at][:, None], y - y[row, at][:, None]
        far = dx * dx + dy * dy
        # The next point of the hull has no other to its right; of those in line the farthest.
        cross = dx[:, :, None] * dy[:, None, :] - dy[:, :, None] * dx[:, None, :]
        open_ = (far > 0) & (cross >= 0).all(2)
        to = np.where(open_, far, -1.0).argmax(1)
        going &= open_[row, to]
        sides += going
        length = np.where(going, np.hypot(dx[row, to], dy[row, to]), 1.0)
        ux, uy = (dx[row, to] / length)[:, None], (dy[row, to] / length)[:, None]
        along, across = x * ux + y * uy, y * ux - x * uy
        a0, a1, c0, c1 = along.min(1), along.max(1), across.min(1), across.max(1)
        size = (a1 - a0) * (c1 - c0)
        better = going & (~np.isfinite(best) | (size < best - 1e-9))
        best = np.where(better, size, best)
        for i, (s, c) in enumerate(((a0, c0), (a1, c0), (a1, c1), (a0, c1))):
            corners[better, i, 0], corners[better, i, 1] = (s * ux[:, 0] - c * uy[:, 0])[better], (s * uy[:, 0] + c * ux[:, 0])[better]
        at = np.where(going, to, at)
        going &= (x[row, at] != x[row, first]) | (y[row, at] != y[row, first])
        if not going.any():
            break
    for i in np.flatnonzero(sides < 3):  # fewer than three corners: the box along the axes
       
        corners[i] = _least_rectangle(list(zip(x[i].tolist(), y[i].tolist())))
    return corners[:, :, 0], corners[:, :, 1]


def _bounding_of(points: pa.Array) -> pa.Array:
    return _arrow_quads([(rows, *_least_rectangles(x, y)) for rows, x, y in _by_size(points)], len(points))


def _expanded_of(quad: pa.Array, by: pa.Array) -> pa.Array:
    d = by.to_numpy(zero_copy_only=False).astype(float)
    return _arrow_quads([(rows, *_grown_all(x, y, d[rows])) for rows, x, y in _by_size(quad)], len(quad))


def iou(a, b) -> Column:
    """Overlap of two convex quads as a share of their union, whatever their directions."""
    return F.pandas_udf(_iou_of, "double")(a, b)


def bounding_quad(points) -> Column:
    """The rectangle of least area around an array of points."""
    return F.arrow_udf(_bounding_of, QUAD)(points)


def expanded(quad, by) -> Column:
    """The quad with its edges moved out by a number of pixels."""
    return F.arrow_udf(_expanded_of, QUAD)(quad, by)
