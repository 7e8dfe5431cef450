"""How filters interact: what each removes, alone and behind others, in every order of application.

Documents meet only in counts: by part (source) and failure mask (one bit per filter), with the labelled rows among them.
The rest is algebra over at most 2^k masks and k! orders. The mask matrix (0 where a mask fails a filter, infinite where it
doesn't) combined with the inverse permutations (at which step an order applies a filter) by minimum over the filters gives
the removal rank of each mask in each order; the counts of a part are scattered to those ranks. Later failures of a mask
are redundant there, and a filter's removals summed over all orders are its Shapley share.

Cases: null texts and parts count as empty ones; repeated rows count each, and rows of one doc_id aren't copies of each
other; rows without a doc_id fail no comparison of doc_ids and have no label; a document is good or toxic if any of its
label rows says so; very long texts are read whole; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, words_of

FILTERS = "ABCDE"
#: Parts whose audits are worked out at once (600 rows each with five filters).
PARTS_AT_ONCE = 128
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A (1) short, B (2) repetitive, C (4) shouting, D (8) symbols."""

    def bits(text):
        def of_words(w):
            n, kinds = F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")
            return F.when(n < 50, 1).otherwise(0) + F.when(100 * kinds < 65 * n, 2).otherwise(0)

        length = F.length(text).cast("long")
        capitals = length - F.length(F.translate(text, _CAPITALS, ""))
        return let(words_of(text), of_words) + F.when(100 * capitals > 5 * length, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)

    return let(F.coalesce(text, F.lit("")), bits)


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by source and failed filters, E (16) being a copy of a smaller doc_id's text.

    Texts meet by their SHA-256, never as such. Copies are counted by text and source before the smallest doc_id of a text
    is told to its groups, so that a large group of copies is as many rows as it has sources.
    """
    flags = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), failures(F.col("text")).alias("fails"))
    marked = rows.join(flags, "id", "left").na.fill(0, ["good", "toxic"])
    ids = marked.groupBy("id", "part", "key", "fails").agg(F.count("*").alias("n"), F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counted = ids.select("id", "part", "key", "fails", "n", (F.col("n") * F.col("good")).alias("good"), (F.col("n") * F.col("toxic")).alias("toxic"))
    unnamed = F.col("id").isNull()
    groups = counted.groupBy("key", "part", "fails").agg(
        F.min("id").alias("id"),
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")],
        *[F.coalesce(F.min_by(c, "id"), F.lit(0)).alias(f"first_{c}") for c in ("n", "good", "toxic")],
        *[F.coalesce(F.sum(F.when(unnamed, F.col(c))), F.lit(0)).alias(f"unnamed_{c}") for c in ("n", "good", "toxic")],
    )
    smallest = F.min("id").over(Window.partitionBy("key"))
    own = F.coalesce(F.col("id") == F.col("smallest"), F.lit(False)).cast("int")
    passing = {c: F.col(f"unnamed_{c}") + own * F.col(f"first_{c}") for c in ("n", "good", "toxic")}
    sides = F.array(
        F.struct(F.col("fails").alias("mask"), *[passing[c].alias(c) for c in passing]),
        F.struct((F.col("fails") + 16).alias("mask"), *[(F.col(c) - passing[c]).alias(c) for c in passing]),
    )
    split = groups.withColumn("smallest", smallest).select("part", F.inline(sides))
    return split.where("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def removal_ranks(filters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(orders, positions, ranks) over all orders of so many filters.

    orders[o, s]: filter applied at step s; positions[f, o]: step of filter f, the inverse permutation; ranks[m, o]: step
    at which order o removes mask m, `filters` where it never does.
    """
    orders = np.array(list(permutations(range(filters))), dtype=np.int64).reshape(factorial(filters), filters)
    positions = np.argsort(orders, axis=1).T
    masks = np.where(np.arange(1 << filters)[:, None] >> np.arange(filters) & 1, 0, filters)
    ranks = np.full((1 << filters, len(orders)), filters, dtype=np.int64)
    for f in range(filters):
        ranks = np.minimum(ranks, masks[:, f, None] + positions[None, f])
    return orders, positions, ranks


def scatter(counts: np.ndarray, filters: int) -> dict[str, np.ndarray]:
    """Tallies [part, order, step] of counts[part, mask, (n, good, toxic)]."""
    orders, positions, ranks = removal_ranks(filters)
    parts, each = len(counts), np.arange(len(orders))
    removed = np.zeros((parts, len(orders), filters + 1, 3), dtype=np.int64)
    redundant = np.zeros((parts, len(orders), filters), dtype=np.int64)
    for mask in range(1 << filters):
        removed[:, each, ranks[mask]] += counts[:, mask, None]
        for f in range(filters):
            if mask >> f & 1:
                redundant[:, each, positions[f]] += counts[:, mask, None, 0] * (positions[f] > ranks[mask])
    removed = removed[:, :, :filters]
    share = np.stack([removed[:, each, positions[f], 0].sum(axis=1) for f in range(filters)], axis=1)
    alone = counts[:, 1 << np.arange(filters), 0]
    return {
        "kept": counts[:, :, 0].sum(axis=1)[:, None, None] - np.cumsum(removed[..., 0], axis=2),
        "removed": removed[..., 0],
        "redundant": redundant,
        "unique_fails": alone[:, orders],
        "good_lost": removed[..., 1],
        "toxic_lost": removed[..., 2],
        "shapley": share[:, orders],
    }


def audit(counts: DataFrame, letters: str = FILTERS) -> DataFrame:
    """A row per part, order of the filters and step, from counts(part, mask, n, good, toxic); bit i is the filter letters[i].

    A part's counts are at most 2^k entries; parts are dealt over the tasks.
    """
    k = len(letters)
    names = ["".join(letters[f] for f in order) for order in permutations(range(k))]

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                block = batch.slice(at, PARTS_AT_ONCE)
                dense = np.zeros((block.num_rows, 1 << k, 3), dtype=np.int64)
                for i, entries in enumerate(block.column("entries").to_pylist()):
                    for x in entries:
                        dense[i, x["mask"]] = x["n"], x["good"], x["toxic"]
                found = scatter(dense, k)
                shape = (block.num_rows, len(names), k)
                part = block.column("part").take(pa.array(np.repeat(np.arange(block.num_rows), len(names) * k)))
                order = pa.array(names).take(pa.array(np.broadcast_to(np.arange(len(names))[None, :, None], shape).ravel()))
                step = pa.array(np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), shape).ravel())
                yield pa.RecordBatch.from_arrays([part, order, step, *[pa.array(np.ascontiguousarray(v).ravel()) for v in found.values()]], names=["part", "filter_order", "step", *found])

    entries = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("entries")
    return counts.groupBy("part").agg(entries).mapInArrow(work, _SCHEMA)
