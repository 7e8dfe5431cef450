"""Substring dedup over a log-structured fingerprint index.

Each window of words has one fingerprint: the least hash among the short grams within it (at the leftmost place), so that
equal windows have equal fingerprints, and neighbouring windows mostly share one. A batch of documents becomes an
immutable run, a table of (fingerprint, n), n being the number of places that carry it. Runs are bucketed and sorted by
fingerprint into the same number of buckets, so that a new batch is merge-joined with those before it bucket by bucket and
history is never shuffled; a fingerprint that now has two places or more is a repeat. Runs of the same level are compacted
into one of the next level, so that a batch meets only a few. A manifest names the runs: a later session opens the index
again by its path and adds the next batch.

Repeats are verified by their words. Windows of a text that take their fingerprint from one place form a stretch; a 128-bit
BLAKE2b digest of its words stands for them. Where all places of a repeated fingerprint (found through a Bloom filter of
bounded size, without misses) have one and the same stretch, as all windows of any stretch with two places, they are repeats.
Only where the stretches of a fingerprint differ are the windows of one place of each digested singly and counted; those
counted twice or more are repeats too. The fingerprints themselves decide nothing. Stretches and windows that hold more than
a thousandth of all rows (a thousand of them at most) are dealt to many tasks. Texts are not shuffled but for those rows that
hold a suspected window.

Cases: null texts have no words; texts shorter than a window keep all; windows repeat across and within rows and may
overlap; repeated rows count as repeats of each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pieces, shared_dir, small_batches, utf8

WINDOW = 35
GRAM = 8
BATCHES = 4
FAN_OUT = 2  # runs of a level that are compacted into one of the next
MOST_BITS = 1 << 28  # of the Bloom filter: 32 MB
HASH_BITS = 64
SALTS = 16  # tasks for a key with more than a thousandth of all rows
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _STEP
        x = (x ^ (x >> np.uint64(32))) * _STEP
        return x ^ (x >> np.uint64(32))


def _word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data."""
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word, taking eight bytes of every word at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    size = ends - starts
    h = _mixed(size.astype(np.uint64) + _ODD)
    live = np.arange(len(starts))
    k = 0
    with np.errstate(over="ignore"):
        while len(live):
            at = starts[live] + k
            left = size[live] - k
            chunk = np.zeros(len(live), np.uint64)
            for b in range(8):
                chunk |= np.where(b < left, padded[at + np.minimum(b, left)], 0).astype(np.uint64) << np.uint64(8 * b)
            h[live] = _mixed((h[live] ^ chunk) * _ODD + np.uint64(k + 1))
            k += 8
            live = live[left > 8]
    return h


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive values, by doubling."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, width = None, 0
        power, size, at = h, 1, n
        while at:
            if at & 1:
                out = power if out is None else _mixed(out[: len(out) - size] * _ODD + power[width:][: len(out) - size] + np.uint64(size)) if len(out) > size else out[:0]
                width += size
            at >>= 1
            if at:
                power = _mixed(power[: len(power) - size] * _ODD + power[size:] + np.uint64(1000 + size))
                size *= 2
    return out[: len(h) - n + 1]


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the leftmost least value in each n consecutive ones."""
    if len(values) < n:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(values)), 1
    while width < n:
        step = min(width, n - width)
        a, b = best[: len(best) - step], best[step:]
        best = np.where(values[b] < values[a], b, a)
        width += step
    return best


class _Texts:
    """The words of one piece of a batch, and the windows that lie within one text."""

    def __init__(self, column: pa.Array, window: int, bits: int = HASH_BITS):
        self.data, at = utf8(column)
        first = int(at[0]) if len(at) else 0
        # A separator of its own keeps texts apart.
        raw = self.data[first : int(at[-1])]
        gap = np.arange(len(at) - 1)
        joined = np.full(len(raw) + len(gap), 32, np.uint8)
        joined[np.arange(len(raw)) + np.repeat(gap, np.diff(at))] = raw
        self.bytes = joined
        self.starts, self.ends = _word_spans(joined)
        bounds = at[:-1] - first + gap
        self.first_word = np.concatenate([np.searchsorted(self.starts, bounds), [len(self.starts)]])
        self.window, self.shift = window, np.uint64(64 - bits)
        self.hash = _word_hashes(joined, self.starts, self.ends)
        n = max(0, len(self.starts) - window + 1)
        row = np.repeat(np.arange(len(gap)), np.diff(self.first_word))
        self.row = row
        self.inside = np.flatnonzero(row[:n] == row[window - 1 : window - 1 + n]) if n else np.zeros(0, np.int64)

    def fingerprints(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the fingerprint, fingerprint) of each window inside."""
        if not len(self.inside):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = _rolled(self.hash, gram) >> self.shift
        best = _least(grams, self.window - gram + 1)[self.inside]
        return best, grams[best]

    def digests(self, first: np.ndarray, last: np.ndarray, shape: np.ndarray) -> np.ndarray:
        """Two longs each: the BLAKE2b digest of the words from first to last and of a number."""
        word = ~_SPACE[self.bytes]
        keep = word | np.concatenate([[False], word[:-1]])  # each word and one space behind it
        place = np.concatenate([[0], np.cumsum(keep)])
        plain = self.bytes[keep]
        plain[_SPACE[plain]] = 32
        plain = memoryview(plain.tobytes())
        a, b = place[self.starts[first]].tolist(), place[self.ends[last]].tolist()
        salts = shape.astype(np.int64).tobytes()
        blake = hashlib.blake2b
        out = b"".join([blake(plain[x:y], digest_size=16, salt=salts[8 * i : 8 * i + 8]).digest() for i, (x, y) in enumerate(zip(a, b))])
        return np.frombuffer(out, np.int64).reshape(-1, 2)


def _places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return (values & mask).astype(np.int64), ((values >> np.uint64(33)) * np.uint64(2) & mask).astype(np.int64)


def fingerprint_counts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, bits: int = HASH_BITS) -> DataFrame:
    """(batch, fp, n): places per fingerprint within each batch of rows; a row's batch is a hash of its text."""

    def run(it):
        for batch in it:
            for part in pieces(batch):
                texts = _Texts(part.column("text"), window, bits)
                place, value = texts.fingerprints(gram)
                if not len(place):
                    continue
                keep = np.concatenate([[True], place[1:] != place[:-1]])
                place, value = place[keep], value[keep]
                of = part.column("batch").to_numpy()[texts.row[place]]
                yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(value.view(np.int64))], ["batch", "fp"])

    rows = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(batches)).cast("int").alias("batch"))
    return rows.mapInArrow(run, "batch int, fp long").groupBy("batch", "fp").agg(F.count("*").alias("n"))


class FingerprintIndex:
    """Immutable runs of (fp, n) in a shared folder, by level, bucketed and sorted by fp; opened again by its path."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}").rstrip("/")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version = 0
        self.runs: list[tuple[int, str]] = []  # level and name
        if path and self._files().exists(self._at(self.path)):
            rows = spark.read.schema("version int, level int, name string, buckets int").json(f"{self.path}/manifest-*").collect()
            self.version = max(r.version for r in rows)
            newest = [r for r in rows if r.version == self.version]
            self.runs, self.buckets = [(r.level, r.name) for r in newest if r.name], newest[0].buckets
            for _, name in self.runs:
                spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")

    def _at(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        name = f"run_{level}_{uuid.uuid4().hex}"
        sorted_ = run.select("fp", "n").sortWithinPartitions("fp")
        sorted_.write.format("parquet").option("path", f"{self.path}/{name}").option("compression", "zstd").bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        self.runs.append((level, name))
        return self.spark.table(name)

    def _note(self) -> None:
        """Writes the next version of the manifest; what it names is on disk by then."""
        self.version += 1
        rows = [(self.version, level, name, self.buckets) for level, name in self.runs] or [(self.version, 0, "", self.buckets)]
        self.spark.createDataFrame(rows, "version int, level int, name string, buckets int").coalesce(1).write.json(f"{self.path}/manifest-{self.version:06d}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (fp, n) as a run; returns its fingerprints that now have two places or more."""
        before = [name for _, name in self.runs]
        new = self._write(batch.repartition(self.buckets, "fp"), 0)
        repeats = new.where("n > 1").select("fp")
        for name in before:  # a few: runs are compacted
            repeats = repeats.union(new.select("fp").join(self.spark.table(name).hint("merge"), "fp", "left_semi"))
        repeats = materialize(repeats.distinct())
        self._note()
        self.compact()
        return repeats

    def compact(self) -> None:
        """Merges the runs of a level once there are FAN_OUT of them, bucket by bucket."""
        level, gone = 0, []
        while any(x == level for x, _ in self.runs):
            own = [name for x, name in self.runs if x == level]
            if len(own) >= FAN_OUT:
                merged = self._merged(own)
                self.runs = [(x, name) for x, name in self.runs if x != level]
                self._write(merged, level + 1)
                gone += own
            level += 1
        if gone:
            self._note()
            for name in gone:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                self._files().delete(self._at(f"{self.path}/{name}"), True)

    def _merged(self, names: list[str]) -> DataFrame:
        """(fp, n) summed over runs by merge joins. (Not by a union: that of bucketed columnar scans passes for partitioned by
        fp in this version of Spark although its partitions are strung together, and groups come out twice.)"""
        out = self.spark.table(names[0])
        for name in names[1:]:
            a, b = out.alias("a"), self.spark.table(name).hint("merge").alias("b")
            n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
            out = a.join(b, F.col("a.fp") == F.col("b.fp"), "full_outer").select(F.coalesce("a.fp", "b.fp").alias("fp"), n.alias("n"))
        return out

    def counts(self) -> DataFrame:
        """(fp, n) over all runs."""
        return self._merged([name for _, name in self.runs])


def _bloom(repeats: DataFrame, bits: int) -> bytes:
    """A Bloom filter of fp, put together chunk by chunk."""
    chunk = 1 << 16

    def build(batches):
        out = np.zeros(bits >> 3, np.uint8)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(0, len(out), chunk):
            if out[k : k + chunk].any():
                yield pa.RecordBatch.from_arrays([pa.array([k // chunk]), pa.array([out[k : k + chunk].tobytes()])], ["chunk", "bits"])

    def merge(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, b in zip(*(c.to_pylist() for c in batch.columns)):
                b = np.frombuffer(b, np.uint8)
                found[k] = found[k] | b if k in found else b
        for k, b in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([b.tobytes()])], ["chunk", "bits"])

    n = max(1, bits // 8 // chunk)
    out = bytearray(bits >> 3)
    for row in repeats.select("fp").mapInArrow(build, "chunk long, bits binary").repartition(min(n, 64), "chunk").mapInArrow(merge, "chunk long, bits binary").toLocalIterator():
        out[row.chunk * chunk : row.chunk * chunk + len(row.bits)] = row.bits
    return bytes(out)


def repeated_fingerprints(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None, bits: int = HASH_BITS) -> DataFrame:
    """Fingerprints of docs with two places or more, those of the index included, which is filled batch by batch."""
    counted = materialize(fingerprint_counts(docs, window, gram, batches, bits))
    index, found = index or FingerprintIndex(docs.sparkSession), None
    for k in range(batches):
        repeats = index.add(counted.where(F.col("batch") == k).select("fp", "n"))
        found = repeats if found is None else found.union(repeats)
    return found.distinct()


class _Filter:
    """A Bloom filter of fingerprints, of at most MOST_BITS, sent to the executors once."""

    def __init__(self, repeats: DataFrame):
        bits, n = 1 << 16, repeats.count()
        while bits < min(MOST_BITS, 16 * n):
            bits *= 2
        self.bits, self.sent = bits, repeats.sparkSession.sparkContext.broadcast(_bloom(repeats, bits))

    def has(self, values: np.ndarray) -> np.ndarray:
        seen, hit = np.frombuffer(self.sent.value, np.uint8), np.ones(len(values), bool)
        for at in _places(values, self.bits):
            hit &= (seen[at >> 3] >> (at & 7) & 1).astype(bool)
        return hit


def _anchors(texts: _Texts, place: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first window, number of windows, fingerprint, place of the fingerprint behind it) of each stretch of windows that
    share a place. Two windows that share a place overlap, so a stretch is one run of words."""
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([first, [len(place)]]))
    start = texts.inside[first]
    return start, n, value[first], place[first] - start


def suspected(docs: DataFrame, repeats: DataFrame, window: int, gram: int, bits: int = HASH_BITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(*keep, n_words, kept, text, row, starts, sizes, fps, stretches): kept where no window is suspected, else the text and
    its suspected stretches. Written once, so that a row's number stays what it is."""
    wanted = _Filter(repeats)
    keep = tuple(keep)
    schema = docs.select(*keep).schema.add("n_words", "long").add("kept", "string").add("text", "string")
    for c in ("starts", "sizes", "fps", "stretches"):
        schema = schema.add(c, "binary")

    def mark(it):
        for batch in it:
            for part in pieces(batch):
                texts = _Texts(part.column("text"), window, bits)
                start, n, value, offset = _anchors(texts, *texts.fingerprints(gram))
                hit = wanted.has(value)
                start, n, value, offset = start[hit], n[hit], value[hit], offset[hit]
                stretch = texts.digests(start, start + n + window - 2, offset)
                row = texts.row[start] if len(start) else np.zeros(0, np.int64)
                local = (start - texts.first_word[row]).astype(np.int32)
                packed = (local, n.astype(np.uint16), value, stretch)
                cut = np.searchsorted(row, np.arange(part.num_rows + 1))
                kept, open_, own = [], [], [[] for _ in packed]
                raw = texts.bytes.tobytes()
                for i, text in enumerate(part.column("text").to_pylist()):
                    a, b = cut[i], cut[i + 1]
                    w, x = texts.first_word[i], texts.first_word[i + 1]
                    kept.append(None if b > a else b" ".join(raw[texts.starts[w] : texts.ends[x - 1]].split()).decode() if x > w else "")
                    open_.append(text if b > a else None)
                    for out, values in zip(own, packed):
                        out.append(values[a:b].tobytes() if b > a else None)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.diff(texts.first_word), pa.int64()), pa.array(kept, pa.string()), pa.array(open_, pa.string()), *(pa.array(x, pa.binary()) for x in own)], schema.names)

    return materialize(docs.select(*keep, "text").mapInArrow(mark, schema).withColumn("row", F.monotonically_increasing_id()))


def _unpacked(marked: DataFrame) -> DataFrame:
    """(row, start, n, fp, s1, s2) of each suspected stretch; s1 and s2 are its digest."""
    kinds = {"starts": np.int32, "sizes": np.uint16, "fps": np.int64, "stretches": np.int64}

    def unpack(it):
        for batch in it:
            parts = {c: np.frombuffer(b"".join(batch.column(c).to_pylist()), k) for c, k in kinds.items()}
            digest = parts["stretches"].reshape(-1, 2)
            per = [len(x) // 4 for x in batch.column("starts").to_pylist()]
            row = np.repeat(batch.column("row").to_numpy(), per)
            for k in range(0, len(row), 50_000):
                part = slice(k, k + 50_000)
                columns = (row[part], parts["starts"][part], parts["sizes"][part].astype(np.int32), parts["fps"][part], digest[part, 0].copy(), digest[part, 1].copy())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "start", "n", "fp", "s1", "s2"])

    return marked.where("starts is not null").select("row", *kinds).mapInArrow(unpack, "row long, start int, n int, fp long, s1 long, s2 long")


def _spread(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, by: list[str]) -> DataFrame:
    """left_semi join of left with right on keys, where the rows of hot keys (a thousand at most) are dealt to SALTS tasks by a
    hash of the columns `by`."""
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    copies = right.join(hot, keys, "left").select(*keys, F.explode(salts).alias("_salt"))
    return dealt.join(copies, [*keys, "_salt"], "left_semi").drop("_salt")


def _hot(counted: DataFrame, n: str) -> DataFrame:
    """The rows of counted whose n is more than a thousandth of all."""
    total = counted.agg(F.sum(n)).first()[0] or 0
    return materialize(counted.where(F.col(n) * 1000 > total))


def _occurrence(row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A hash of a stretch's place."""
    with np.errstate(over="ignore"):
        return _mixed(_mixed(row.astype(np.uint64) * _ODD + np.uint64(1)) + start.astype(np.uint64))


def _windows_of(marked: DataFrame, chosen: DataFrame, window: int, gram: int, bits: int) -> DataFrame:
    """(row, start, h1, h2) of each window within the stretches of chosen(fp: hash of a place), or what seems to be one."""
    wanted = _Filter(chosen)

    def find(it):
        for batch in it:
            for part in pieces(batch):
                texts = _Texts(part.column("text"), window, bits)
                start, n, _, _ = _anchors(texts, *texts.fingerprints(gram))
                if not len(start):
                    continue
                row = part.column("row").to_numpy()
                hit = wanted.has(_occurrence(row[texts.row[start]], start - texts.first_word[texts.row[start]]))
                # The windows of a stretch stand one behind the other.
                n = n[hit]
                start = np.repeat(start[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if len(start):
                    of = texts.row[start]
                    digest = texts.digests(start, start + window - 1, np.zeros(len(start), np.int64))
                    columns = (row[of], (start - texts.first_word[of]).astype(np.int32), digest[:, 0].copy(), digest[:, 1].copy())
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "start", "h1", "h2"])

    return marked.where("starts is not null").select("row", "text").mapInArrow(find, "row long, start int, h1 long, h2 long")


def _places_of(chosen: DataFrame) -> DataFrame:
    """The hash, as fp, of the place of each stretch of chosen(row, start)."""

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array(_occurrence(batch.column("row").to_numpy(), batch.column("start").to_numpy()).view(np.int64))], ["fp"])

    return chosen.select("row", "start").mapInArrow(run, "fp long")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None, history: DataFrame | None = None, bits: int = HASH_BITS
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept: the words that stay, joined by one space) of each row.

    With an index of earlier batches and their texts as history(text), words that also stand there go as well; the index
    then holds docs too.
    """
    small_batches(docs.sparkSession)
    repeats = materialize(repeated_fingerprints(docs, window, gram, batches, index, bits))
    own = docs.select("doc_id", "text", F.lit(True).alias("_new"))
    if history is not None:
        own = own.union(history.select(F.lit(None).cast(docs.schema["doc_id"].dataType), "text", F.lit(False)))
    marked = suspected(own, repeats, window, gram, bits, ("doc_id", "_new"))
    stretches = _unpacked(marked)
    kinds = materialize(stretches.groupBy("fp", "s1", "s2").agg(F.count("*").alias("places"), F.min(F.struct("row", "start")).alias("first")))
    # Of a fingerprint with several stretches, one place of each shows its windows; those of single stretches are in doubt.
    several = materialize(kinds.groupBy("fp").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    shown = materialize(_places_of(_spread(kinds, several, ["fp"], _hot(several, "kinds"), ["s1", "s2"]).select("first.*")))
    twice = kinds.where("places > 1").select("s1", "s2", "places")
    whole = _spread(stretches, twice, ["s1", "s2"], _hot(twice, "places"), ["row", "start"]).select("row", "start", "n")
    windows = materialize(_windows_of(marked, shown, window, gram, bits))
    repeated = materialize(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1"))
    single = _spread(windows, repeated, ["h1", "h2"], _hot(repeated, "n"), ["row", "start"]).select("row", "start", F.lit(1).alias("n"))
    places = whole.union(single).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("found"))
    places = places.select("row", F.col("found.start").alias("starts"), F.col("found.n").alias("sizes"))
    marked = marked.where("_new")
    todo = marked.where("starts is not null").select("doc_id", "n_words", "text", "row").join(places, "row", "left")
    done_type = docs.select("doc_id").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def cut_out(it):
        for batch in it:
            kept, gone = [], []
            for text, starts, sizes in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "sizes"))):
                words = text.encode().split()
                cover = np.zeros(len(words) + 1, np.int64)
                if starts:
                    at = np.array(starts)
                    np.add.at(cover, at, 1)
                    np.subtract.at(cover, at + np.array(sizes) - 1 + window, 1)
                stays = np.cumsum(cover[:-1]) == 0
                kept.append(b" ".join(w for w, s in zip(words, stays.tolist()) if s).decode())
                gone.append(int((~stays).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], done_type.names)

    clean = marked.where("starts is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept")
    return clean.union(todo.select("doc_id", "n_words", "text", "starts", "sizes").mapInArrow(cut_out, done_type))
