"""Boxes found in overlapping bands of a page: those cut by a seam are put together again, those found twice kept once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..sources.shared import once
from . import graph, grid

EDGE = 2.0
#: Rows in which pieces meet: about the height of a band, so that each is entered in few of them.
ROWS = 256.0
#: Pages of more boxes than this are merged by rounds of joins, which deal one page over all tasks.
MOST = 2000
#: Pairs looked at in one step, and coordinates beyond which areas may be no numbers.
PAIRS, FAR = 1 << 20, 1e100


def _area(l: str, t: str, r: str, b: str):
    return (F.col(r) - F.col(l)) * (F.col(b) - F.col(t))


def _covered():
    """Intersection of a pair as a share of the smaller box."""
    both = F.greatest(F.least("r", "r_2") - F.greatest("l", "l_2"), F.lit(0.0)) * F.greatest(F.least("b", "b_2") - F.greatest("t", "t_2"), F.lit(0.0))
    return F.coalesce(both / F.nullif(F.least(_area("l", "t", "r", "b"), _area("l_2", "t_2", "r_2", "b_2")), F.lit(0.0)), F.lit(0.0))


def _overlapping(one: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs that may share an area: no reach beyond the boxes is needed."""
    return grid.near_pairs(one, other, reach=0.0, band=ROWS)


def merged_bands(boxes: DataFrame, bands: DataFrame, most: float = 0.5) -> DataFrame:
    """(page_id, pieces, l, t, r, b) of boxes(page_id, k, i, l, t, r, b) of bands(page_id, k, top, bottom, height): merged() of
    boxes that don't come with the edges of their band."""
    return merged(boxes.join(bands, ["page_id", "k"]).repartition("page_id").sortWithinPartitions("page_id"), most)


def merged(found: DataFrame, most: float = 0.5) -> DataFrame:
    """(page_id, pieces, l, t, r, b) of found(page_id, k, i, l, t, r, b, top, bottom, height), boxes with the edges of their band k.
    The rows of a page stand together in one partition, as a sort or a window by page_id leaves them.

    A box that comes within EDGE of an inner edge of its band is a piece. Of whole boxes, in the order of bands, one that a
    kept one of another band covers by more than `most` of the smaller goes. Pieces that a kept box covers go too; pieces that
    meet become one box around them, over any number of bands. Pages of up to MOST boxes are merged where they stand, many in
    one Arrow batch, without a shuffle; the others (and those with coordinates that are no numbers) by rounds of joins.
    """
    cut = (F.col("top") > 0) & (F.col("t") < F.col("top") + EDGE) | (F.col("bottom") < F.col("height")) & (F.col("b") > F.col("bottom") - EDGE)
    at = found.select("page_id", "k", "i", *[F.col(c).cast("double").alias(c) for c in "ltrb"], cut.alias("cut")).where("cut is not null")
    schema = StructType([StructField(f.name, f.dataType) for f in at.schema] + [StructField("pieces", LongType())])
    out = once(at.mapInArrow(_pages(most, MOST), schema))
    done, rest = out.where("pieces is not null").select("page_id", "pieces", "l", "t", "r", "b"), out.where("pieces is null")
    return done if rest.isEmpty() else done.unionByName(_by_rounds(rest, most))


def _by_rounds(boxes: DataFrame, most: float) -> DataFrame:
    """merged() of boxes(page_id, k, i, l, t, r, b, cut) of pages of any size: components of a join by bands of rows."""
    at = boxes.select("page_id", "k", F.struct("page_id", "k", "i").alias("node"), "l", "t", "r", "b", "cut")
    whole, pieces = at.where(~F.col("cut")).drop("cut"), at.where("cut").drop("cut")
    twice = _overlapping(whole, whole).where((F.col("k") < F.col("k_2")) & (_covered() > most))
    gone = graph.outdone(twice.select(F.col("node").alias("early"), F.col("node_2").alias("late")))
    kept = whole.join(gone, "node", "left_anti")
    hidden = _overlapping(pieces, kept).where(_covered() > most).select("node").distinct()
    left = once(pieces.join(hidden, "node", "left_anti"))
    meet = _overlapping(left, left).where((F.col("node") < F.col("node_2")) & (_covered() > 0)).select(F.col("node").alias("a"), F.col("node_2").alias("b"))
    of = graph.components(left.select("node"), meet)
    joined = left.join(of, "node").groupBy("component").agg(F.first("page_id").alias("page_id"), F.count("*").alias("pieces"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b")).drop("component")
    return kept.select("page_id", F.lit(1).cast("long").alias("pieces"), "l", "t", "r", "b").unionByName(joined)


def _meeting(page: np.ndarray, l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of one page that share an area, each pair once, and that area as a share of the smaller box: by a sweep down the pages."""
    n = len(page)
    rank = np.unique(np.concatenate((t, b)), return_inverse=True)[1].astype(np.int64)
    key = page * (2 * n) + rank[:n]
    order = np.argsort(key, kind="stable")
    # A row meets those behind it that begin above its bottom.
    count = np.maximum(np.searchsorted(key[order], (page * (2 * n) + rank[n:])[order]) - np.arange(1, n + 1), 0)
    upto, found = np.cumsum(count), []
    at = np.unique(np.concatenate(([0], np.searchsorted(upto, np.arange(PAIRS, upto[-1], PAIRS)), [n])))
    for low, high in zip(at[:-1], at[1:]):
        some = count[low:high]
        x = np.repeat(np.arange(low, high), some)
        y = np.arange(len(x)) - np.repeat(np.cumsum(some) - some, some) + x + 1
        x, y = order[x], order[y]
        both = np.maximum(np.minimum(r[x], r[y]) - np.maximum(l[x], l[y]), 0.0) * np.maximum(np.minimum(b[x], b[y]) - np.maximum(t[x], t[y]), 0.0)
        share = np.flatnonzero(both > 0)
        x, y, both = x[share], y[share], both[share]
        small = np.minimum((r[x] - l[x]) * (b[x] - t[x]), (r[y] - l[y]) * (b[y] - t[y]))
        found.append((x, y, both / small))
    return tuple(map(np.concatenate, zip(*found)))


def _merged(page: np.ndarray, k: np.ndarray, cut: np.ndarray, l: np.ndarray, t: np.ndarray, r: np.ndarray, b: np.ndarray, most: float):
    """The first row of each merged box, how many pieces it has, and its edges; rows of any number of pages, one behind the other."""
    x, y, share = _meeting(page, l, t, r, b)
    gone, much = np.zeros(len(page), bool), share > most
    twice = much & ~cut[x] & ~cut[y] & (k[x] != k[y])
    early, late = x[twice], y[twice]
    early, late = np.where(k[early] < k[late], early, late), np.where(k[early] < k[late], late, early)
    while len(late):  # the first of each chain stay, what they cover goes
        waits = np.zeros(len(page), bool)
        waits[late] = True
        gone[late[~waits[early]]] = True
        open_ = ~gone[early] & ~gone[late]
        early, late = early[open_], late[open_]
    mixed = much & (cut[x] != cut[y])
    piece, whole = np.where(cut[x], x, y)[mixed], np.where(cut[x], y, x)[mixed]
    gone[piece[~gone[whole]]] = True
    meet = cut[x] & cut[y] & ~gone[x] & ~gone[y]
    x, y, of = x[meet], y[meet], np.arange(len(page))
    while (apart := of[x] != of[y]).any():  # the higher ends of links hang on the lower ones
        x, y = x[apart], y[apart]
        np.minimum.at(of, np.maximum(of[x], of[y]), np.minimum(of[x], of[y]))
        while (of[of] != of).any():
            of = of[of]
    left = np.flatnonzero(~gone)
    left = left[np.argsort(of[left], kind="stable")]
    first, begin, pieces = np.unique(of[left], return_index=True, return_counts=True)
    return first, pieces, [least.reduceat(edge[left], begin) for least, edge in zip((np.minimum, np.minimum, np.maximum, np.maximum), (l, t, r, b))]


def _pages(most: float, most_rows: int):
    """The work of merged() on batches: merged boxes with `pieces`; rows of pages left to _by_rounds() as they are, without."""

    def asis(own: pa.Table) -> pa.RecordBatch:
        whole = [own.column(c).combine_chunks() for c in own.column_names]
        return pa.RecordBatch.from_arrays([*whole, pa.nulls(own.num_rows, pa.int64())], names=[*own.column_names, "pieces"])

    def merge(own: pa.Table, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        box = [own.column(c).to_numpy() for c in "ltrb"]
        plain = own.column("k").is_valid().to_numpy() & np.logical_and.reduce([np.abs(x) < FAR for x in box])
        here = np.repeat((sizes <= most_rows) & np.logical_and.reduceat(plain, np.cumsum(sizes) - sizes), sizes)
        page = np.repeat(np.arange(len(sizes)), sizes)[here]
        if not here.all():
            yield asis(own.filter(pa.array(~here)))
            own, box = own.filter(pa.array(here)), [x[here] for x in box]
        if own.num_rows:
            first, pieces, box = _merged(page, own.column("k").to_numpy(), own.column("cut").to_numpy(), *box, most)
            none = {c: pa.nulls(len(first), own.schema.field(c).type) for c in ("k", "i", "cut")}
            pages = own.column("page_id").combine_chunks().take(pa.array(first))
            yield pa.RecordBatch.from_arrays([pages, none["k"], none["i"], *map(pa.array, box), none["cut"], pa.array(pieces, pa.int64())], names=[*own.column_names, "pieces"])

    def work(batches):
        kept, long = None, None  # rows of the page that the next batch may go on with; [that page] if it has too many
        for batch in batches:
            own = pa.Table.from_batches([batch])
            own, kept = own if kept is None else pa.concat_tables([kept, own]), None
            if not own.num_rows:
                continue
            page = own.column("page_id").combine_chunks()
            ends = pc.run_end_encode(page).run_ends.to_numpy().astype(np.int64)
            if long and page[0].as_py() == long[0]:
                yield asis(own.slice(0, ends[0]))
                own, ends = own.slice(ends[0]), ends[1:] - ends[0]
                if not len(ends):
                    continue
            last = ends[-2] if len(ends) > 1 else 0
            if last:
                yield from merge(own.slice(0, last), np.diff(ends[:-1], prepend=0))
            kept, long = own.slice(last), None
            if kept.num_rows > most_rows:
                yield asis(kept)
                kept, long = None, [page[-1].as_py()]
        if kept is not None:
            yield from merge(kept, np.array([kept.num_rows]))

    return work
