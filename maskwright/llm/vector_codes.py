"""Vector code compression: vectors become one small code per part, by codebooks fitted in exact integers.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook that starts as parts of the
smallest ids and is refitted a fixed number of rounds. A part's nearest entry is found by equal-average search: entries
lie sorted by the sum of their components, the search starts at the part's own sum and goes outward on both sides, always
to the entry with the smaller gap. By the inequality of Cauchy and Schwarz no entry is nearer than gap^2 / dimension, so
a part is done once that strictly exceeds its best squared distance (strictly, as an equal distance may have a lower
index). Rounds are Spark jobs over the whole table; tasks send sums and counts per entry, never vectors, and the driver
holds codebooks only (entries x dimension integers).

Cases: vectors that are null or hold null, NaN or infinite components are dropped; fewer kept ids than entries give smaller
codebooks, none give no rows; repeated ids seed once (by their smallest vector) but are coded and counted each; null ids
never seed; null labels are one label; other columns are ignored. Vectors that aren't all of one length divisible by the
number of parts, or components so large that distances don't fit 63 bits, raise an error that says so.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors searched at once.
ROWS_AT_ONCE = 4096


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows whose vector is whole and finite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v")).where(F.col("v").isNotNull() & finite)


def integers(column: pa.Array, dimension: int, parts: int, scale: int) -> np.ndarray:
    """[row, part, component] of floor(scale * x)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != dimension).any():
        raise ValueError(f"vectors of {dimension} components expected, one has {lengths[lengths != dimension][0]}")
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() >= _largest(dimension // parts):
        raise ValueError("a component is too large: squared distances of its part may not fit 63 bits")
    return scaled.astype(np.int64).reshape(len(lengths), parts, dimension // parts)


def _largest(width: int) -> float:
    """Components below this keep width * squared distance * width under 2^62."""
    return 2.0**30 / max(width, 1)


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest of entries[k, width] for each x[n, width]; ties to the lower index."""
    n, width = x.shape
    k = len(entries)
    sums = entries.sum(axis=1)
    order = np.argsort(sums, kind="stable")
    sums = sums[order]
    own = x.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max // max(width, 1))
    index = np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    right = np.searchsorted(sums, own)
    left = right - 1
    far = np.iinfo(np.int64).max
    while rows.size:
        below = np.where(left >= 0, own[rows] - sums[np.maximum(left, 0)], far)
        above = np.where(right < k, sums[np.minimum(right, k - 1)] - own[rows], far)
        down, gap = below <= above, np.minimum(below, above)
        go = gap != far
        go[go] = gap[go] ** 2 <= best[rows[go]] * width
        rows, left, right, down = rows[go], left[go], right[go], down[go]
        entry = order[np.where(down, left, right)]
        apart = ((x[rows] - entries[entry]) ** 2).sum(axis=1)
        better = (apart < best[rows]) | ((apart == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = apart[better], entry[better]
        left, right = left - down, right + ~down
    return index, best


def seeds(kept: DataFrame, entries: int, parts: int, scale: int) -> np.ndarray | None:
    """Codebooks [part, entry, component] of the smallest ids; None without vectors."""
    first = kept.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    if not first:
        return None
    dimension = len(first[0]["v"])
    if dimension % parts or not dimension:
        raise ValueError(f"vectors of {dimension} components can't be cut into {parts} parts")
    rows = integers(pa.array([x["v"] for x in first], pa.list_(pa.float64())), dimension, parts, scale)
    return rows.transpose(1, 0, 2).copy()


def refit(kept: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: every part goes to its nearest entry, entries become the floors of their parts' means; unused ones stay."""
    parts, entries, width = books.shape

    def work(batches):
        sums = np.zeros(books.shape, dtype=np.int64)
        counts = np.zeros(books.shape[:2], dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                x = integers(batch.column("v").slice(at, ROWS_AT_ONCE), parts * width, parts, scale)
                for p in range(parts):
                    index, _ = nearest(x[:, p], books[p])
                    np.add.at(sums[p], index, x[:, p])
                    counts[p] += np.bincount(index, minlength=entries)
        p, e, j = np.nonzero(np.broadcast_to(counts[..., None], books.shape))
        columns = [p.astype(np.int32), e.astype(np.int32), j.astype(np.int32), counts[p, e], sums[p, e, j]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["p", "e", "j", "n", "total"])

    told = kept.select("v").mapInArrow(work, "p int, e int, j int, n long, total long")
    out = books.copy()
    for x in told.groupBy("p", "e", "j").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[x["p"], x["e"], x["j"]] = int(x["total"]) // x["n"]
    return out


def encode(kept: DataFrame, books: np.ndarray, scale: int) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part, squared distances summed over the parts."""
    parts, _, width = books.shape

    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                block = batch.slice(at, ROWS_AT_ONCE)
                x = integers(block.column("v"), parts * width, parts, scale)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                code = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
                error = sum(d for _, d in found)
                yield pa.RecordBatch.from_arrays([block.column("vec_id"), block.column("label"), pa.array(code, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    ids, label = kept.schema["vec_id"].dataType, kept.schema["label"].dataType
    return kept.mapInArrow(work, f"vec_id {ids.simpleString()}, label {label.simpleString()}, code string, error long")


def digest(books: np.ndarray | None) -> str:
    """SHA-256 of all entries' components in decimal, by part, entry and position."""
    numbers = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray | None]:
    """(coded, codebooks): vec_id, label, code, error and label_error of every usable vector; codebooks [part, entry, component].

    A label's errors are summed where they arise; only one row per label and task is shuffled.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    kept = usable(vectors, id_col, vector_col, label_col)
    books = seeds(kept, entries, parts, scale)
    if books is None:
        # Null ids never seed: without another kept row there are no codebooks and no codes.
        none = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
        return none.where(F.lit(False)), None
    for _ in range(rounds):
        books = refit(kept, books, scale)
    coded = encode(kept, books, scale)
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def decode(codes: DataFrame, books: np.ndarray, scale: int = 4096) -> DataFrame:
    """The columns of codes and `approximation`: the entries that a code names, scaled back."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x) / scale) for x in entry]) for entry in book]) for book in books])
    at = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(len(books))]
    return codes.withColumn("approximation", F.concat(*[table[p][i] for p, i in enumerate(at)]))
