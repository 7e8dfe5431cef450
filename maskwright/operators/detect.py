"""Boxes of text from maps of probabilities: connected pixels, their least rectangle, grown by what detection shrinks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

_POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def connected(mask: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Components of a mask by four neighbours, each as runs (row, from, to); in the order of their first pixels.

    Runs of a row meet those of the row above by a merge of both; labels are united by their smaller one.
    """
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, begins = np.nonzero(edges == 1)
    ends = np.nonzero(edges == -1)[1]
    runs = list(zip(rows.tolist(), begins.tolist(), ends.tolist()))
    parent = list(range(len(runs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1)).tolist()
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if runs[i][1] < runs[j][2] and runs[j][1] < runs[i][2]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
            if runs[i][2] < runs[j][2]:
                i += 1
            else:
                j += 1
    out: dict[int, list] = {}
    for k, run in enumerate(runs):
        out.setdefault(root(k), []).append(run)
    return list(out.values())


def components(maps: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(map_id, k, first, pixels, mean, points) of maps(map_id, width, values): per component its first pixel, its size, the mean of
    its values and the corners of its rows' first and last pixels. A map is one row; tasks see a map at a time."""

    def work(batches):
        for batch in batches:
            at, ks, firsts, sizes, means, points = [], [], [], [], [], []
            for i in range(batch.num_rows):
                values = np.array(batch.column("values")[i].as_py() or [], np.float64)
                width = batch.column("width")[i].as_py() or 0
                if not width or not len(values):
                    continue
                grid = np.nan_to_num(values[: len(values) // width * width].reshape(-1, width))
                for k, runs in enumerate(connected(grid > threshold)):
                    ys = {}
                    for y, a, b in runs:
                        lo, hi = ys.get(y, (a, b))
                        ys[y] = min(lo, a), max(hi, b)
                    n = sum(b - a for _, a, b in runs)
                    at.append(i), ks.append(k), firsts.append(min(y * width + a for y, a, _ in runs)), sizes.append(n)
                    means.append(sum(grid[y, a:b].sum() for y, a, b in runs) / n)
                    points.append([{"x": float(x), "y": float(v)} for y, (a, b) in ys.items() for x in (a, b) for v in (y, y + 1)])
            rows = pa.array(at, pa.int64())
            columns = [pa.array(ks, pa.int32()), pa.array(firsts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(means, pa.float64()), pa.array(points, _POINTS)]
            yield pa.RecordBatch.from_arrays([batch.column("map_id").take(rows), *columns], names=["map_id", "k", "first", "pixels", "mean", "points"])

    kind = maps.schema["map_id"].dataType.simpleString()
    return maps.select("map_id", "width", "values").mapInArrow(work, f"map_id {kind}, k int, first int, pixels int, mean double, points array<struct<x:double,y:double>>")


def text_boxes(maps: DataFrame, threshold: float = 0.3, least_mean: float = 0.6, unclip: float = 1.5, least: float = 3.0) -> DataFrame:
    """(map_id, k, quad): the least rectangle around each component of four pixels and a mean of least_mean or more, grown on all
    sides by area * unclip / circumference; those thinner than `least`, or than two more once grown, are left out."""
    found = components(maps, threshold).where((F.col("pixels") >= 4) & (F.col("mean") >= least_mean)).withColumn("rect", G.bounding_quad(F.col("points")))
    side = lambda q, i: F.hypot(F.get(q, i + 1)["x"] - F.get(q, i)["x"], F.get(q, i + 1)["y"] - F.get(q, i)["y"])
    sized = found.withColumn("w", side(F.col("rect"), F.lit(0))).withColumn("h", side(F.col("rect"), F.lit(1))).where(F.least("w", "h") >= least)
    grown = sized.withColumn("d", F.col("w") * F.col("h") * unclip / (2 * (F.col("w") + F.col("h")))).where(F.least("w", "h") + 2 * F.col("d") >= least + 2)
    return grown.select("map_id", "k", G.expanded("rect", F.col("d")).alias("quad"))
