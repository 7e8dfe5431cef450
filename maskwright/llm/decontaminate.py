"""Benchmark decontamination by a prefix-filtered set join; DataFrame functions only.

Every window of an item is a set of word shingles, all of which a text must hold. Shingles are ordered by how often the
corpus has them; as containment is whole, the prefix of a window is its one rarest shingle. Only texts with that shingle
are candidates; its place in the window fixes where the window would start, which must leave room for the whole window
within the text (positional and length bounds), and the window's words decide.

The windows of a benchmark are broadcast up to MOST_WINDOWS; beyond that, the shingles of texts (hashes and places, no
texts) are shuffled to them.

Cases: null texts have no words; items of fewer words than a window are one window, shorter than a shingle their own
shingle; items without words have none; copies of a text are judged once, by digest; repeated items and rows are allowed;
other columns are ignored or, in clean_rows(), kept.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

WINDOW = 13
SHINGLE = 5
MOST_WINDOWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Capital letters beyond A-Z, which lower() would change.
_OTHER_CAPITALS = r"[\p{Lu}\p{Lt}Ⅰ-ⅯⒶ-Ⓩ&&[^A-Z]]"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    return F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def words_of(text: Column) -> Column:
    """Words of ASCII letters, digits and all beyond ASCII, lower-cased in A-Z."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN), lambda x: x != "")


def _hash(w: Column, n: int, i: Column) -> Column:
    return F.xxhash64(*[F.get(w, i + d) for d in range(n)])


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, words, len, shingles: array of (size, place, hash)) of each window."""
    w = F.col("_w")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))
    cut = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(w, i + 1, window))).alias("words")).distinct()
    w = F.col("words")
    size = F.size(w)
    full = F.transform(F.sequence(F.lit(0), size - shingle), lambda i: F.struct(F.lit(shingle).alias("size"), i.alias("place"), _hash(w, shingle, i).alias("hash")))
    short = F.lit(None).cast("array<struct<size:int,place:int,hash:bigint>>")
    for n in range(1, shingle):
        short = F.when(size == n, F.array(F.struct(F.lit(n).alias("size"), F.lit(0).alias("place"), _hash(w, n, F.lit(0)).alias("hash")))).otherwise(short)
    return cut.select("item_id", "words", size.alias("len"), F.when(size >= shingle, full).otherwise(short).alias("shingles"))


def _places(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """texts(key, words) with one row per shingle of the given sizes: size, at, hash."""
    out = None
    for n in sizes:
        w = F.col("words")
        hashes = F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), partial(_hash, w, n)))
        # The outer form: the plain one filters by the array's size first, which would work it out anew for each shingle.
        part = texts.withColumn("_h", hashes).select("key", "words", F.posexplode_outer("_h").alias("at", "hash")).where("hash is not null").withColumn("size", F.lit(n))
        out = part if out is None else out.union(part)
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """(key, start, len, item_id): where windows of items stand in texts; key is the digest of the text."""
    windows = materialize(item_windows(benchmark, window, shingle))
    some = windows.select("len").distinct().collect()  # at most `window` lengths
    sizes = sorted({min(r["len"], shingle) for r in some})
    texts = docs.select(F.md5(F.coalesce("text", F.lit(""))).alias("key"), words_of(F.col("text")).alias("words"))
    if not sizes:
        return texts.select("key", F.lit(0).alias("start"), F.lit(0).alias("len"), F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id")).where("false")
    small = windows.count() <= most_windows
    hint = F.broadcast if small else (lambda x: x)
    spread = windows.select("item_id", "words", "len", F.explode("shingles").alias("s")).select("item_id", "words", "len", "s.*")
    places = _places(texts, sizes)
    known = spread.select("size", "hash").distinct()
    counts = materialize(places.select("size", "hash").join(hint(known), ["size", "hash"]).groupBy("size", "hash").agg(F.count("*").alias("n")))
    # A shingle that no text has rules its window out: the rest needs windows whose shingles all occur.
    rated = spread.join(counts, ["size", "hash"], "left").groupBy("item_id", "words", "len").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("place"), F.col("size"), F.col("hash"))).alias("rarest")
    )
    prefix = rated.where("rarest.n > 0").select("item_id", F.array_join("words", " ").alias("window"), "len", "rarest.place", "rarest.size", "rarest.hash")
    prefix = materialize(prefix)
    start = F.col("at") - F.col("place")
    fits = (start >= 0) & (start + F.col("len") <= F.size("words"))
    holds = F.array_join(F.slice("words", F.greatest(start, F.lit(0)) + 1, F.col("len")), " ") == F.col("window")
    if small:
        found = places.join(F.broadcast(prefix), ["size", "hash"]).where(fits & holds)
    else:
        candidates = places.select("key", "at", "hash", "size").distinct().join(prefix, ["size", "hash"]).where(start >= 0)
        found = candidates.join(texts.dropDuplicates(["key"]), "key").where(fits & holds)
    return found.select("key", start.alias("start"), "len", "item_id").distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(key, n_hit, items): per text with a hit, its words within windows and its items as sorted strings."""
    found = occurrences(docs, benchmark, window, shingle)
    spans = F.sort_array(F.collect_set(F.struct("start", "len")))
    none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))

    def step(acc, x):
        end = x["start"] + x["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["sum"] + F.greatest(end - F.greatest(x["start"], acc["end"]), F.lit(0))).alias("sum"))

    per = found.groupBy("key").agg(spans.alias("spans"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return per.select("key", F.aggregate("spans", none, step, lambda acc: acc["sum"]).cast("long").alias("n_hit"), F.sort_array("items").alias("items"))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def contaminated(n_hit: Column, n: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items and contaminated of each row."""
    own = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("key"), n_words(F.col("text")).alias("n_words"))
    both = own.join(materialize(hits(docs, benchmark)), "key", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), contaminated(n_hit, F.col("n_words")).alias("contaminated"))


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated rows."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), n_words(F.col("text")).alias("_n"), F.md5(F.coalesce("text", F.lit(""))).alias("_key"))
    bad = materialize(hits(docs, benchmark).select(F.col("key").alias("_key"), "n_hit"))
    both = keyed.join(bad, "_key", "left")
    return both.where(F.coalesce(~contaminated(F.col("n_hit"), F.col("_n")), F.lit(True))).select("_row.*")
