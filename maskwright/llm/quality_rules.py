"""Quality rules with risk-controlled cutoffs; DataFrame functions only.

Each rule rejects a document whose ratio lies above a cutoff of a fixed grid. On the labelled holdout, per stratum and
rule, cutoffs are tried from the mildest on: the exact binomial tail P(Bin(n, alpha / rules) <= k) for k rejected of n good
documents must stay within delta / (strata * rules). The first failure ends a sequence (fixed-sequence testing), and the
division by strata and rules is Bonferroni's. Each distinct text counts once in its stratum: copies are no further draws.
The promise is for new documents drawn like the labelled ones: with confidence 1 - delta no stratum loses more than alpha
of its good documents among those that pass the base rule. What the base rule rejects, and the labelled documents
themselves, on which the cutoffs were chosen, are outside of it. Among the certified cutoffs the one that rejects most bad and fewest good documents is taken. A stratum with too
few labels to certify anything keeps all.

Cases: null or blank texts have no words and fail the base rule; a null stratum is a stratum of its own; a document with
several labels, or a text with several documents, counts as good if one label says so; labels without a quality are ignored; repeated rows are judged each but
draw once; rows without a doc_id have no label; empty tables give no rows; input columns with the names of the features are replaced in rules() and left alone in filter_rows().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import let, materialize, words_of

ALPHA = 0.05
DELTA = 0.05
#: Rules in order, each a ratio of the counts below; all share one grid of cutoffs, mildest first.
RULES = {
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_word_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "shouts": ("n_shouts", "n_words"),
}
GRID = (2.0, 1.5, 1.0, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)
COST_OF_GOOD = 5  # a good document lost weighs as much as so many bad ones caught
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_word_lines", "n_shouts", "text_digest")
MOST_TERMS = 2000  # of the binomial tail summed one by one; the rest is bounded from above


def _repeat_words(w: Column) -> Column:
    """Words within 3-word windows that are found twice or more in w."""

    def covered(h: Column) -> Column:
        # Equal hashes stand side by side once sorted; the words themselves decide.
        def same(z, i, j):
            a, b = F.get(z, i), F.get(z, j)
            return F.coalesce((a["h"] == b["h"]) & F.reduce(F.array(*map(F.lit, range(3))), F.lit(True), lambda acc, d: acc & (F.get(w, a["i"] + d) == F.get(w, b["i"] + d))), F.lit(False))

        def starts(z):
            return F.sort_array(F.array_compact(F.transform(z, lambda x, k: F.when(same(z, k, k - 1) | same(z, k, k + 1), x["i"]))))

        def total(p):
            return F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1), x + 3) - x)), F.lit(0), lambda a, b: a + b)

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda z: let(starts(z), total))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    several = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(several).cast("long")


def with_counts(docs: DataFrame) -> DataFrame:
    """docs with the columns of COUNTS."""
    text = F.coalesce(F.col("text"), F.lit(""))
    taken = max(map(len, docs.columns))
    words, lines_ = "_w" * taken, "_l" * taken  # names that no column of docs has
    w = F.col(words)
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.drop(*COUNTS).withColumn(words, words_of(F.col("text"))).withColumn(lines_, lines)
    return out.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size(lines_) - F.size(F.array_distinct(lines_))).cast("long"),
            "n_repeat_words": _repeat_words(w),
            "n_word_lines": F.size(lines_).cast("long"),
            "n_shouts": F.regexp_count(text, F.lit(r"[!?]{2}")).cast("long"),
            "text_digest": F.md5(text),
        }
    ).drop(words, lines_)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(rule: str) -> Column:
    n, of = RULES[rule]
    return F.coalesce(F.col(n) / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))


def _log_factorial(n: Column) -> Column:
    """By Stirling's series, eight above n."""
    x = n.cast("double") + 9
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return series - sum((F.log(n.cast("double") + j) for j in range(2, 9)), F.log(n.cast("double") + 1))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) from above: exact in its MOST_TERMS largest terms, a geometric bound for the others; 1 from k >= n p on."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    down = F.sequence(k, F.greatest(k - MOST_TERMS, F.lit(0)), F.lit(-1))
    one = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(acc, i):
        # From the term of i to the one of i - 1.
        ratio = i * (1 - p) / ((n - i + 1) * p)
        return F.struct((acc["term"] * ratio).alias("term"), (acc["sum"] + acc["term"]).alias("sum"))

    def whole(acc):
        # What is left: the last term and, as ratios fall, less than a geometric series of it.
        last = F.greatest(k - MOST_TERMS, F.lit(0))
        ratio = last * (1 - p) / ((n - last + 1) * p)
        return F.least(F.lit(1.0), F.exp(top) * (acc["sum"] + F.when(last > 0, acc["term"] / (1 - ratio)).otherwise(0.0)))

    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(down, one, step, whole))


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, one cutoff per rule; null where none is certified)."""
    quality = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_good"))
    rows = counted.where(~base_failed()).select("doc_id", F.col(stratum).alias("_s"), "text_digest", *[_ratio(r).alias(f"_r_{r}") for r in RULES]).join(quality, "doc_id")
    held = rows.groupBy("_s", "text_digest").agg(F.max("_good").alias("_good"), *[F.max(f"_r_{r}").alias(f"_r_{r}") for r in RULES])
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"_r_{r}").alias("ratio")) for r in RULES])
    per_rule = held.select("_s", "_good", F.explode(each).alias("x")).select("_s", "_good", "x.rule", "x.ratio")
    good, bad = F.col("_good") > 0, F.col("_good") <= 0
    sums = [F.count(F.when(good, 1)).alias("n")]
    for i, c in enumerate(GRID):
        sums += [F.count(F.when(good & (F.col("ratio") > c), 1)).alias(f"k{i}"), F.count(F.when(bad & (F.col("ratio") > c), 1)).alias(f"b{i}")]
    table = materialize(per_rule.groupBy("_s", "rule").agg(*sums))
    tests = max(1, table.count())
    tried = table.select("_s", "rule", "n", F.posexplode(F.array(*[F.struct(F.lit(c).alias("cut"), F.col(f"k{i}").alias("k"), F.col(f"b{i}").alias("bad")) for i, c in enumerate(GRID)])).alias("pos", "t")).select("_s", "rule", "n", "pos", "t.*")
    tried = tried.withColumn("fails", (binomial_tail(F.col("n"), F.col("k"), alpha / len(RULES)) > delta / tests).cast("int"))
    # A sequence has as many rows as the grid.
    so_far = F.max("fails").over(W.partitionBy("_s", "rule").orderBy("pos"))
    passed = tried.withColumn("ended", so_far).where("ended = 0")
    value = F.struct((F.col("bad") - COST_OF_GOOD * F.col("k")).alias("gain"), (-F.col("k")).alias("lost"), (-F.col("pos")).alias("mild"), F.col("cut"))
    best = passed.groupBy("_s", "rule").agg(F.max(value).alias("best")).select("_s", "rule", "best.*").where("gain > 0")
    return best.groupBy("_s").agg(*[F.max(F.when(F.col("rule") == r, F.col("cut"))).alias(f"_cut_{r}") for r in RULES])


def judged(counted: DataFrame, chosen: DataFrame, stratum: str = "lang") -> DataFrame:
    """counted with base_failed, rejected_by (names of rules) and kept."""
    both = counted.join(chosen, counted[stratum].eqNullSafe(chosen["_s"]), "left")
    named = F.array_compact(F.array(*[F.when(_ratio(r) > F.col(f"_cut_{r}"), F.lit(r)) for r in RULES]))
    out = both.withColumn("base_failed", base_failed()).withColumn("rejected_by", named)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_s", *[f"_cut_{r}" for r in RULES])


def rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the stratum, the counts, base_failed, rejected_by and kept of each row."""
    counted = with_counts(docs.select("doc_id", "text", stratum)).drop("text")
    counted = materialize(counted)
    return judged(counted, materialize(cutoffs(counted, labels, stratum, alpha, delta)), stratum)


def filter_rows(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs without the rows that are not kept."""
    own = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", F.col(stratum).alias("_stratum"))
    counted = materialize(with_counts(own).drop("text"))
    chosen = materialize(cutoffs(counted, labels, "_stratum", alpha, delta))
    return judged(counted, chosen, "_stratum").where("kept").select("_row.*")
