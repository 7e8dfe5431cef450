"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint maps to counts of set bits, one per segment. The Manhattan distance of two such points never exceeds
the Hamming distance, so fingerprints that differ in two bits lie within distance two on the grid, and each pair like that
shares a cell of the two unit balls around its points: every distinct fingerprint is sent to its own cell and those next to
it. A cell with two fingerprints is verified at once by the exact distance. The members of a crowded cell are placed anew on
the next grid of LEVELS, with narrower segments. On the last one a segment is one bit, so that the bound is the exact
distance: those who meet in a cell (65 at most) are within two bits of each other, and link to the least of them. No pairs
within a cell are ever made. The first grid has about 48 bits of entropy, so that cells stay apart at 10^10 fingerprints and
only true groups of near copies go on to the second.

Cases: null or blank texts have fingerprint zero and link to one another; fewer than three words make one shingle; copies
share a fingerprint and are one node; null ids are only chosen where a group has no other; rows that are the same in id and
text count as one for one_of_each; other columns, whatever their names, are ignored or kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, small_batches, texts_of

LEVELS = (32, 64)  # segments of the grids, from the first to the exact one
SEED = 42


def _fingerprints(texts: list[bytes], n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as xxh

    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        if len(words) > n:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[: -n].tolist()]
            hashes += [xxh(line[a:b], SEED) for a, b in zip(starts, (ends[n - 1 :] - 1).tolist())]
            sizes[i] = len(starts)
        elif words:
            hashes.append(xxh(b" ".join(words), SEED))
            sizes[i] = 1
    out = np.zeros(len(texts), np.uint64)
    h = np.array(hashes, np.uint64)
    ends = np.cumsum(sizes)
    for i in np.flatnonzero(sizes):
        own = h[ends[i] - sizes[i] : ends[i]]
        total = np.zeros(64, np.int64)
        for k in range(0, len(own), 1 << 14):
            total += np.unpackbits(own[k : k + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        out[i] = int.from_bytes(np.packbits(2 * total > sizes[i]).tobytes(), "big")
    return out


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns and the 64-bit `fp` (as a signed long) of each row's text."""
    keep = tuple(keep)
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.concatenate([_fingerprints(texts_of(batch.column("text").slice(k, 64)), shingle) for k in range(0, batch.num_rows, 64)] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fp.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, "text").mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


def _cells(fp: Column, segments: int) -> tuple[Column, Column]:
    """The cell of a fingerprint (its counts in one long) and what turns it into itself and the cells next to it, as XOR masks."""
    wide = 64 // segments
    bits = wide.bit_length()  # of a count
    counts = [F.bit_count(F.shiftrightunsigned(fp, wide * i).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))).cast("long") for i in range(segments)]
    own = F.lit(0).cast("long")
    for i, c in enumerate(counts):
        own = own.bitwiseOR(F.shiftleft(c, bits * i))
    up = [F.when(c < wide, F.shiftleft(c.bitwiseXOR(c + 1), bits * i)) for i, c in enumerate(counts)]
    down = [F.when(c > 0, F.shiftleft(c.bitwiseXOR(c - 1), bits * i)) for i, c in enumerate(counts)]
    return own, F.array_compact(F.array(F.lit(0).cast("long"), *up, *down))


def _spread(nodes: DataFrame, segments: int) -> DataFrame:
    """(fp, cell): each fingerprint in the cells of its unit ball."""
    own, steps = _cells(F.col("fp"), segments)
    placed = nodes.select("fp", own.alias("own"), F.explode(steps).alias("step"))
    return placed.select("fp", F.col("own").bitwiseXOR(F.col("step")).alias("cell"))


def links(nodes: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp`, enough to connect all that differ in two bits or fewer."""
    out = None
    for segments in levels:
        # Written once: the join below would work the cells out anew for each of its rows.
        spread = materialize(_spread(nodes, segments))
        cells = materialize(spread.groupBy("cell").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
        pairs = cells.where("n = 2").where(near).select("a", "b")
        out = pairs if out is None else out.union(pairs)
        crowded = cells.where("n > 2")
        if segments < 64:
            nodes = materialize(spread.join(crowded.select("cell"), "cell", "left_semi").select("fp").distinct())
        else:
            out = out.union(spread.join(crowded.select("cell", "a"), "cell").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b")))
    return out.distinct()


def components(prints: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(fp, component_id) per distinct fingerprint: the least id reachable over links."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_column).alias("least")))
    found = connected_components(links(nodes.select("fp")))
    named = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(least, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row."""
    prints = materialize(fingerprints(docs))
    return prints.join(materialize(components(prints)), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that of the least doc_id (nulls last), then the least text hash."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h"))
    prints = materialize(fingerprints(keyed, keep=("doc_id", "_h")))
    grouped = prints.join(materialize(components(prints)).withColumnRenamed("component_id", "_c"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_h").alias("h"))
    # Groups go by their id and, where that is null, by their fingerprint.
    best = grouped.groupBy("_c", F.when(F.col("_c").isNull(), F.col("fp")).alias("_f")).agg(F.min(order).alias("best"))
    best = best.select(F.col("best.id").alias("_id"), F.col("best.h").alias("_bh"))
    kept = keyed.join(best, keyed["doc_id"].eqNullSafe(best["_id"]) & (keyed["_h"] == best["_bh"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "_h"]).select("_row.*")
