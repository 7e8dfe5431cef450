"""Line dedup with two Bloom filters.

The first filter holds the hashes seen at least once, the second those seen at least twice; partial filters of the
partitions merge chunk by chunk (bits of the first that meet go to the second), so nothing but a bounded bit set reaches
the driver. Only lines whose hash is in the second filter are shuffled, as 128-bit digests of their keys, for the exact
count of documents and the choice of the first occurrence. A filter too small for its input lets more lines through to
the exact step and never loses one.

Cases: null or empty text is one empty line, and an empty key is never dropped; a key counts once per row, so repeated
rows count each; other columns pass through, except those that the operator's own columns replace (n_lines, n_dropped).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, materialize, small_batches, texts_of

CHUNK = 1 << 16  # bytes of a filter that travel together
MOST_BITS = 1 << 28  # 32 MB a filter, whatever the input
BITS_PER_DOC = 256
MOST_BROADCAST_KEYS = 400_000  # of 16 bytes; beyond it keys go to their documents by a join


def _keys(text: bytes, least: int) -> list[bytes | None]:
    """One key per line; None if it is too short to be dropped."""
    out = [x.strip(SPACE_BYTES).lower() for x in text.split(b"\n")]
    return [k if len(k) >= least and (least < 2 or len(k.decode()) >= least) else None for k in out]


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _places(digest: bytes, bits: int) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little") % bits, int.from_bytes(digest[8:], "little") % bits


def _put(once: np.ndarray, twice: np.ndarray, at: np.ndarray) -> None:
    """Counts each place; those met before go to twice."""
    places, n = np.unique(at, return_counts=True)
    byte, bit = places >> 3, (1 << (places & 7)).astype(np.uint8)
    again = (n > 1) | ((once[byte] & bit) > 0)
    np.bitwise_or.at(twice, byte[again], bit[again])
    np.bitwise_or.at(once, byte, bit)


def bloom_filter(docs: DataFrame, bits: int, least: int) -> bytes:
    """The second filter: places that two different (row, key) pairs or more have hit."""

    def build(batches):
        once, twice = np.zeros(bits >> 3, np.uint8), np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            at = [p for t in texts_of(batch.column(0)) for k in {*_keys(t, least)} - {None} for p in _places(_digest(k), bits)]
            if at:
                _put(once, twice, np.array(at, np.int64))
        for k in range(0, len(once), CHUNK):
            if once[k : k + CHUNK].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // CHUNK]), pa.array([once[k : k + CHUNK].tobytes()]), pa.array([twice[k : k + CHUNK].tobytes()])], ["chunk", "once", "twice"])

    def merge(batches):
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
                if k in found:
                    x, y = found[k]
                    y |= b | (x & a)
                    x |= a
                else:
                    found[k] = [a.copy(), b.copy()]
        for k, (_, b) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b.tobytes()])], ["chunk", "twice"])

    n = max(1, bits // 8 // CHUNK)
    parts = docs.select("text").mapInArrow(build, "chunk long, once binary, twice binary").repartition(min(n, 64), "chunk").mapInArrow(merge, "chunk long, twice binary")
    out = bytearray(bits >> 3)
    for row in parts.toLocalIterator():
        out[row.chunk * CHUNK : row.chunk * CHUNK + len(row.twice)] = row.twice
    return bytes(out)


def suspected(docs: DataFrame, bits: int, least: int, *columns: str) -> DataFrame:
    """(key, line, *columns) for the first line of each key of a row that is in the second filter."""
    seen = docs.sparkSession.sparkContext.broadcast(bloom_filter(docs, bits, least))
    schema = docs.select(*columns).schema.add("key", "binary").add("line", "integer")

    def find(batches):
        bloom = np.frombuffer(seen.value, np.uint8)
        for batch in batches:
            rows, keys, lines = [], [], []
            for i, text in enumerate(texts_of(batch.column("text"))):
                first: dict[bytes, int] = {}
                for j, k in enumerate(_keys(text, least)):
                    if k is not None and k not in first:
                        first[k] = j
                for k, j in first.items():
                    d = _digest(k)
                    if all(bloom[p >> 3] >> (p & 7) & 1 for p in _places(d, bits)):
                        rows.append(i)
                        keys.append(d)
                        lines.append(j)
            if rows:
                kept = batch.select([*columns]).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(keys, pa.binary()), pa.array(lines, pa.int32())], [*columns, "key", "line"])

    return docs.select("text", *[c for c in columns if c != "text"]).mapInArrow(find, schema)


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", broadcast_keys: int = MOST_BROADCAST_KEYS) -> DataFrame:
    """docs with the lines gone whose key is found in min_docs rows or more; text holds what stays.

    keep="none" drops them in every row; keep="first" leaves the first row's (least doc_id, then text digest; all its
    lines of that key). n_lines counts the lines before, n_dropped those that went.
    """
    spark = docs.sparkSession
    small_batches(spark)
    bits = 1 << 16
    rows = docs.count()
    while bits < min(MOST_BITS, rows * BITS_PER_DOC):
        bits *= 2
    marked = docs.select("text", F.col("doc_id").alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_text"))
    found = suspected(marked, bits, min_chars, "_id", "_text")
    frequent = found.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_text")).alias("first")).where(F.col("n") >= min_docs)
    frequent = materialize(frequent)
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    schema = docs.select(*rest).schema.add("n_lines", "long").add("n_dropped", "long")

    def cut(batches, keys_of):
        for batch in batches:
            kept, n, gone = [], [], []
            for text, keys in zip(texts_of(batch.column("text")), keys_of(batch)):
                lines = text.split(b"\n")
                if keys:
                    stays = [x for x, k in zip(lines, _keys(text, min_chars)) if k is None or _digest(k) not in keys]
                else:
                    stays = lines
                kept.append(b"\n".join(stays))
                n.append(len(lines))
                gone.append(len(lines) - len(stays))
            new = pa.array(kept, pa.binary()).cast(pa.string())
            columns = [new if c == "text" else batch.column(c) for c in rest]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64())], [*rest, "n_lines", "n_dropped"])

    if keep == "none" and frequent.count() <= broadcast_keys:
        all_keys = spark.sparkContext.broadcast({bytes(r.key) for r in frequent.select("key").toLocalIterator()})

        def by_set(batches):
            yield from cut(batches, lambda batch: [all_keys.value] * batch.num_rows)

        return docs.select(*rest).mapInArrow(by_set, schema)
    loses = found.join(frequent, "key")
    if keep == "first":
        loses = loses.where(~F.struct("_id", "_text").eqNullSafe(F.col("first")))
    loses = loses.groupBy("_id", "_text").agg(F.collect_set("key").alias("_keys"))
    own = docs.select(F.struct(*rest).alias("_row"), F.col("doc_id").alias("_own_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_own_text"))
    both = own.join(loses, own["_own_id"].eqNullSafe(loses["_id"]) & (own["_own_text"] == loses["_text"]), "left")
    # Arrow takes columns by name: the keys get one that no column of the table has.
    name = "_keys" + "_" * max(map(len, rest))
    with_keys = both.select("_row.*", F.col("_keys").alias(name))

    def by_row(batches):
        yield from cut(batches, lambda batch: [{*x} if x else () for x in batch.column(name).to_pylist()])

    return with_keys.mapInArrow(by_row, schema)
