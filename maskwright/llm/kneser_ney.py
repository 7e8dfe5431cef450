"""Interpolated Kneser-Ney character models, one per class, counted by Spark and looked up under full n-gram codes.

Texts are lower-cased, runs of anything but letters become one space, and each symbol takes 12 bits, so that an n-gram of
up to five symbols is one long. Letters below U+0800 are one symbol each; others are two, a lead and a trail of ten bits
each from ranges of their own, so that no two letters share a symbol row (in those scripts an n-gram spans fewer letters, and
lengths are counted in symbols). Tasks count the n-grams of their rows; Spark sums them over all rows and derives, order by
order, continuation counts, discounts, probabilities and backoff weights with group-bys and equi-joins. No n-gram is
dropped or merged with another. A model of at most MOST_SENT entries is sent to the executors as sorted arrays; a larger one
stays in Spark, where the distinct n-grams of the texts are joined to it and their values joined back to the texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces, utf8

BITS = 12
SYMBOLS = 1 << BITS
MOST_SENT = 4_000_000
SPACE_ID = 32

_tables: dict[str, np.ndarray] = {}


def _symbol_table() -> np.ndarray:
    """What each code point is before long ones are split: itself in lower case below 2048, 2048 more above; space if no letter."""
    if "symbols" not in _tables:
        out = np.full(0x110000, SPACE_ID, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                out[cp] = low if low < 2048 else 2048 + low
        _tables["symbols"] = out
    return _tables["symbols"]


def split_long(sym: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols over 2047 as a lead (2048 and up) and a trail (3072 and up), with the offsets moved along. Letters end far
    below U+100000."""
    wide = sym >= 2048
    if not wide.any():
        return sym, offsets
    ends = np.concatenate([[0], np.cumsum(1 + wide)])
    out = np.repeat(sym, 1 + wide)
    rest = sym[wide] - 2048
    out[ends[:-1][wide]] = 2048 + (rest >> 10)
    out[ends[:-1][wide] + 1] = 3072 + (rest & 1023)
    return out, ends[offsets]


def symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all texts one after another, offsets): a space before and after each word; nothing for texts without letters."""
    data, at = utf8(column)
    raw = data[at[0] : at[-1]] if len(at) else data[:0]
    lead = (raw & 0xC0) != 0x80  # the first byte of each code point
    before = np.concatenate([[0], np.cumsum(lead)])
    starts = before[at - at[0]]
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    sym = _symbol_table()[cp]
    n = len(starts) - 1
    # One space in front of every text parts it from the one before.
    row_of = np.repeat(np.arange(n), np.diff(starts))
    place = np.arange(len(sym)) + row_of + 1
    full = np.full(len(sym) + n, SPACE_ID, np.uint32)
    full[place] = sym
    first = starts[:-1] + np.arange(n)
    is_first = np.zeros(len(full), bool)
    is_first[first] = True
    space = full == SPACE_ID
    keep = ~(space & np.concatenate([[False], space[:-1]]) & ~is_first)
    offsets = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([first, [len(full)]])]
    return split_long(full[keep].astype(np.int64), offsets)


def codes(sym: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram ending at each symbol but the first of a text, offsets); histories are filled up with spaces."""
    code = sym.copy()
    row_start = np.repeat(offsets[:-1], np.diff(offsets))
    index = np.arange(len(sym))
    for k in range(1, order):
        back = index - k
        code |= np.where(back >= row_start, sym[np.maximum(back, 0)], SPACE_ID) << (BITS * k)
    keep = index != row_start
    return code[keep], np.maximum(offsets - np.arange(len(offsets)), 0)


def ngram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(cls, code, n) over all of rows(cls int, text)."""

    def count(batches):
        held: dict[int, list] = {}

        def squeeze(c):
            code = np.concatenate([x for x, _ in held[c]])
            n = np.concatenate([y for _, y in held[c]])
            inverse, unique = pd.factorize(code)
            held[c] = [(unique, np.bincount(inverse, n, len(unique)).astype(np.int64))]

        for batch in batches:
            for part in pieces(batch):
                sym, offsets = symbols(part.column("text"))
                code, offsets = codes(sym, offsets, order)
                cls = np.repeat(part.column("cls").to_numpy(zero_copy_only=False), np.diff(offsets))
                for c in np.unique(cls).tolist():
                    inverse, unique = pd.factorize(code[cls == c])
                    held.setdefault(c, []).append((unique, np.bincount(inverse, minlength=len(unique))))
                    if len(held[c]) >= 16:
                        squeeze(c)
        for c in held:
            squeeze(c)
            unique, n = held[c][0]
            for k in range(0, len(unique), 50_000):
                m = len(unique[k : k + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, c, np.int32)), pa.array(unique[k : k + m]), pa.array(n[k : k + m])], ["cls", "code", "n"])

    parts = rows.select("cls", "text").mapInArrow(count, "cls int, code long, n long")
    return parts.groupBy("cls", "code").agg(F.sum("n").alias("n"))


def model_table(counts: DataFrame, order: int, shared: int = 0) -> DataFrame:
    """(cls, ord, kind, code, val): probabilities ("p") of seen n-grams and weights ("b") of seen histories.

    The orders up to `shared` are taken from all classes together.
    """
    top = materialize(counts)
    classes = sorted(r.cls for r in top.select("cls").distinct().collect())
    levels = {order: top}
    for n in range(order - 1, 0, -1):
        shorter = levels[n + 1].select("cls", F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("code"))
        if n <= shared:
            pooled = levels[n + 1].select("code").distinct().select(F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("code"))
            # Every class gets a row of its own: two or a few for each n-gram.
            each = F.explode(F.array(*[F.lit(c).cast("int") for c in classes])).alias("cls")
            levels[n] = materialize(pooled.groupBy("code").agg(F.count("*").alias("n")).select(each, "code", "n"))
        else:
            levels[n] = materialize(shorter.groupBy("cls", "code").agg(F.count("*").alias("n")))
    out, lower = None, None
    for n in range(1, order + 1):
        level = levels[n]
        found = level.groupBy("cls").agg(F.count(F.when(F.col("n") == 1, 1)).alias("n1"), F.count(F.when(F.col("n") == 2, 1)).alias("n2"))
        discount = found.select("cls", F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.coalesce(F.col("n1") / F.nullif(F.col("n1") + 2 * F.col("n2"), F.lit(0)), F.lit(0.5)))).alias("d"))
        split = level.select("cls", "code", "n", F.shiftright("code", BITS).alias("history"), F.col("code").bitwiseAND(F.lit((1 << BITS * max(n - 1, 1)) - 1)).alias("suffix"))
        context = split.groupBy("cls", "history").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(F.broadcast(discount), "cls")
        context = context.withColumn("weight", F.col("d") * F.col("types") / F.col("total"))
        both = split.join(context, ["cls", "history"])
        own = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total")
        if n == 1:
            seen = both.select("cls", "code", "n", (own + F.col("weight") / SYMBOLS).alias("p"))
        else:
            below = lower.select("cls", F.col("code").alias("suffix"), F.col("p").alias("p0"))
            seen = both.join(below, ["cls", "suffix"], "left").select("cls", "code", "n", (own + F.col("weight") * F.coalesce("p0", F.lit(1.0 / SYMBOLS))).alias("p"))
        lower = materialize(seen)
        rows = lower.select("cls", F.lit(n).alias("ord"), F.lit("p").alias("kind"), "code", F.col("p").alias("val"))
        rows = rows.union(context.select("cls", F.lit(n).alias("ord"), F.lit("b").alias("kind"), F.col("history").alias("code"), F.col("weight").alias("val")))
        out = rows if out is None else out.union(rows)
    return out.withColumn("val", F.col("val").cast("float"))


def set_apart(total: int, most: int, share: float, *columns: str) -> Column:
    """A condition true of about `most` of `total` rows and of `share` of them at most, by a hash of columns."""
    scale = 1 << 30
    return F.pmod(F.xxhash64(F.lit("calibration"), *columns), F.lit(scale)) < F.lit(int(scale * min(share, most / max(total, 1))))


def _log_p(p: Column) -> Column:
    return F.log(F.greatest(p, F.lit(1e-12))).cast("float")


def joined_log_p(codes: DataFrame, table: DataFrame, order: int, classes: int) -> DataFrame:
    """(code, p): log-probabilities per class of codes(code) by joins with a model table, from order 1 up."""
    grams = materialize(codes.distinct())
    of_class = lambda name, c: F.element_at(name, F.lit(c))
    below = None
    for n in range(1, order + 1):
        own = lambda kind, name: table.where((F.col("ord") == n) & (F.col("kind") == kind)).groupBy(F.col("code").alias(name)).agg(F.map_from_entries(F.collect_list(F.struct("cls", "val"))).alias(kind))  # noqa: E731, B023
        level = grams.select(F.col("code").bitwiseAND(F.lit((1 << BITS * n) - 1)).alias("gram")).distinct().join(own("p", "gram"), "gram", "left")
        if n == 1:
            p = F.array(*[F.coalesce(of_class("p", c), F.lit(1.0 / SYMBOLS / 10)).cast("double") for c in range(classes)])
        else:
            level = level.withColumns({"history": F.shiftright("gram", BITS), "suffix": F.col("gram").bitwiseAND(F.lit((1 << BITS * (n - 1)) - 1))})
            level = level.join(own("b", "history"), "history", "left").join(below, "suffix")
            p = F.array(*[F.coalesce(of_class("p", c), F.coalesce(of_class("b", c), F.lit(1.0)) * F.get("p0", F.lit(c))).cast("double") for c in range(classes)])
        below = materialize(level.select(F.col("gram").alias("suffix"), p.alias("p0")))
    return below.select(F.col("suffix").alias("code"), F.transform("p0", _log_p).alias("p"))


class Scorer:
    """Runs body(part, model) over the texts of rows, whatever the size of the model table."""

    def __init__(self, table: DataFrame, order: int, classes: int, most: int | None = None):
        self.table, self.order, self.classes = materialize(table), order, classes
        small = self.table.count() <= (MOST_SENT if most is None else most)
        self.sent = table.sparkSession.sparkContext.broadcast(self.table.toArrow()) if small else None

    def run(self, rows: DataFrame, body, schema) -> DataFrame:
        order, classes, sent = self.order, self.classes, self.sent
        if sent is None:
            return self._joined(rows, body, schema)

        def score(batches):
            model = Model(sent.value, order, classes)
            for batch in batches:
                for part in pieces(batch):
                    yield body(part, model)

        return rows.mapInArrow(score, schema)

    def _joined(self, rows: DataFrame, body, schema) -> DataFrame:
        order, classes = self.order, self.classes
        rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))

        def distinct(batches):
            for batch in batches:
                for part in pieces(batch):
                    code, offsets = codes(*symbols(part.column("text")), order)
                    for row, a, b in zip(part.column("_row").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                        own = np.unique(code[a:b])
                        for k in range(0, len(own), 50_000):
                            some = own[k : k + 50_000]
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row, np.int64)), pa.array(some)], ["_row", "code"])

        def score(batches):
            for batch in batches:
                for part in pieces(batch):
                    known = part.column("_known").flatten()
                    yield body(part, Known(order, classes, pc.struct_field(known, "code").to_numpy(zero_copy_only=False), pc.struct_field(known, "p").flatten().to_numpy(zero_copy_only=False)))

        pairs = materialize(rows.select("_row", "text").mapInArrow(distinct, "_row long, code long"))
        values = joined_log_p(pairs.select("code"), self.table, order, classes)
        known = pairs.join(values, "code").groupBy("_row").agg(F.collect_list(F.struct("code", "p")).alias("_known"))
        return rows.join(known, "_row", "left").mapInArrow(score, schema)


class Known:
    """Log-probabilities of the n-grams of a few texts, looked up before."""

    def __init__(self, order: int, classes: int, code: np.ndarray, values: np.ndarray):
        self.order, self.classes = order, classes
        self.code, first = np.unique(code, return_index=True)
        self.values = values.reshape(-1, classes)[first]

    def log_p(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.code, code), self.values


class Model:
    """Sorted arrays of a model table; scores n-grams, each distinct one once while it is remembered."""

    MOST_KNOWN = 1_000_000

    def __init__(self, table: pa.Table, order: int, classes: int):
        self.order, self.classes = order, classes
        self.arrays = {}
        for c in range(classes):
            of_class = table.filter(pc.equal(table["cls"], c))
            for n in range(1, order + 1):
                for kind in "pb":
                    part = of_class.filter(pc.and_(pc.equal(of_class["ord"], n), pc.equal(of_class["kind"], kind)))
                    if part.num_rows:
                        code = part["code"].to_numpy()
                        by = np.argsort(code)
                        self.arrays[c, n, kind] = (code[by], part["val"].to_numpy()[by])
        self.known = np.zeros(0, np.int64)
        self.values = np.zeros((0, classes), np.float32)

    def _find(self, which, code, default):
        keys, values = self.arrays.get(which, (None, None))
        if keys is None:
            return np.full(len(code), default, np.float32), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(keys, code), len(keys) - 1)
        hit = keys[at] == code
        return np.where(hit, values[at], np.float32(default)), hit

    def _log_p(self, code: np.ndarray) -> np.ndarray:
        out = np.zeros((len(code), self.classes), np.float32)
        for c in range(self.classes):
            p, _ = self._find((c, 1, "p"), code & (SYMBOLS - 1), 1.0 / SYMBOLS / 10)
            for n in range(2, self.order + 1):
                gram = code & ((1 << BITS * n) - 1)
                seen, hit = self._find((c, n, "p"), gram, 0.0)
                weight, _ = self._find((c, n, "b"), gram >> BITS, 1.0)
                p = np.where(hit, seen, weight * p)
            out[:, c] = np.log(np.maximum(p, 1e-12))
        return out

    def log_p(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, values): log-probabilities per class of the distinct n-grams, and each n-gram's place among them."""
        index, unique = pd.factorize(code)
        at = np.searchsorted(self.known, unique)
        hit = np.zeros(len(unique), bool)
        if len(self.known):
            hit = self.known[np.minimum(at, len(self.known) - 1)] == unique
        values = np.zeros((len(unique), self.classes), np.float32)
        if hit.any():
            values[hit] = self.values[at[hit]]
        if not hit.all():
            new = unique[~hit]
            values[~hit] = self._log_p(new)
            if len(self.known) + len(new) > self.MOST_KNOWN:
                self.known, self.values = unique, values
            else:
                self.known, self.values = np.concatenate([self.known, new]), np.concatenate([self.values, values[~hit]])
            by = np.argsort(self.known)
            self.known, self.values = self.known[by], self.values[by]
        return index, values


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sum of values within each pair of offsets (0 where empty)."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
