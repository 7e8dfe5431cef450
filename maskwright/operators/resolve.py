"""Resolution of findings as joins within a page: priority, yielding, anchors, cues and echoes.

Every join has the page as its key and the geometry or span as a further condition, so that Spark hashes on pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def span_overlap(a: str, b: str) -> Column:
    return (F.col(f"{a}.line_no") == F.col(f"{b}.line_no")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def by_priority(spans: DataFrame, order: list[str]) -> DataFrame:
    """Greedy resolution of spans(page_id, line_no, start, end, ...): in the given order, a span stays unless one that already
    stays overlaps it. The spans of one line are folded in one array."""
    rest = [c for c in spans.columns if c not in ("page_id", "line_no")]
    one = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.struct(*rest).alias("x"))
    grouped = spans.groupBy("page_id", "line_no").agg(F.sort_array(F.collect_list(one)).alias("all"))
    kind = spans.select(F.struct(*rest).alias("x")).schema["x"].dataType.simpleString()
    zero = F.array().cast(f"array<{kind}>")

    def keep(out, y):
        x = y["x"]
        return F.when(F.exists(out, lambda o: (o["start"] < x["end"]) & (x["start"] < o["end"])), out).otherwise(F.concat(out, F.array(x)))

    kept = grouped.withColumn("kept", F.aggregate("all", zero, keep))
    return kept.select("page_id", "line_no", F.explode_outer("kept").alias("x")).select("page_id", "line_no", "x.*")


def giving_way(spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """spans that no span of a kind they yield to overlaps; pairs(kind, to) says who yields to whom, by the spans as found."""
    rivals = spans.alias("b").join(F.broadcast(pairs).alias("p"), F.col("b.kind") == F.col("p.to")).select(F.col("p.kind").alias("kind"), F.col("b.page_id").alias("page_id"), F.col("b.line_no").alias("line_no"), F.col("b.start").alias("start"), F.col("b.end").alias("end"))
    same = (F.col("a.page_id") == F.col("b.page_id")) & (F.col("a.kind") == F.col("b.kind")) & span_overlap("a", "b")
    return spans.alias("a").join(rivals.alias("b"), same, "left_anti")


def anchored(guesses: DataFrame, anchors: DataFrame, lines_apart: int = 1) -> DataFrame:
    """Guesses with an anchor on their own line (not the guess itself) or within lines_apart lines."""
    near = (F.col("g.page_id") == F.col("a.page_id")) & (F.abs(F.col("g.line_no") - F.col("a.line_no")) <= lines_apart)
    itself = (F.col("g.line_no") == F.col("a.line_no")) & (F.col("g.start") < F.col("a.end")) & (F.col("a.start") < F.col("g.end"))
    return guesses.alias("g").join(anchors.alias("a"), near & ~itself, "left_semi")


def attached(guesses: DataFrame, anchors: DataFrame, lines: DataFrame) -> DataFrame:
    """Guesses that touch an anchor of their line, with nothing but blanks between."""
    cut = lines.select("page_id", "line_no", F.col("text").alias("_text"))
    own = guesses.join(cut, ["page_id", "line_no"])
    low, high = F.least(F.col("g.end"), F.col("a.end")), F.greatest(F.col("g.start"), F.col("a.start"))
    gap = F.trim(F.substring(F.col("g._text"), low + 1, F.greatest(high - low, F.lit(0)))) == ""
    cond = (F.col("g.page_id") == F.col("a.page_id")) & (F.col("g.line_no") == F.col("a.line_no")) & gap
    return own.alias("g").join(anchors.alias("a"), cond, "left_semi").drop("_text")


def on_page_with(spans: DataFrame, lines: DataFrame, cue: str, unless: str | None = None) -> DataFrame:
    """spans of pages on which some line matches cue and none matches unless."""
    out = spans.join(lines.where(F.col("text").rlike(cue)).select("page_id").distinct(), "page_id", "left_semi")
    return out.join(lines.where(F.col("text").rlike(unless)).select("page_id").distinct(), "page_id", "left_anti") if unless else out


def value_echo(seeds: DataFrame, lines: DataFrame, pattern: str) -> DataFrame:
    """Places where a seed's value stands elsewhere on its page: an equi-join on the value.

    seeds(page_id, line_no, value); pattern cuts lines into comparable values.
    """
    cut = lines.select("page_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("value"))
    cond = (F.col("c.page_id") == F.col("s.page_id")) & (F.col("c.value") == F.col("s.value")) & (F.col("c.line_no") != F.col("s.line_no"))
    return cut.alias("c").join(seeds.alias("s"), cond, "left_semi")


def across_lines(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """quotes(page_id, quote) found over two neighbouring lines: (page_id, line_no, quote), line_no being the first."""
    pairs = lines.withColumn("_next", F.lead("text").over(W.partitionBy("page_id").orderBy("line_no"))).where("_next is not null")
    both = F.concat_ws(" ", "text", "_next")
    hit = F.instr(both, F.col("quote"))
    over = (hit > 0) & (hit <= F.length("text")) & (hit + F.length("quote") - 1 > F.length("text") + 1)
    return pairs.join(quotes, "page_id").where(over).select("page_id", "line_no", "quote")


def first_of_each(hits: DataFrame, priority: Column) -> DataFrame:
    """One hit per (page, line, span): that of the best priority."""
    w = W.partitionBy("page_id", "line_no", "start", "end").orderBy(priority)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def covered_by(hits: DataFrame, others: DataFrame, share: float = 0.5) -> DataFrame:
    """hits(page_id, l, t, r, b) left after those go that share more than half of the smaller box with another."""
    w = F.greatest(F.least("h.r", "o.r") - F.greatest("h.l", "o.l"), F.lit(0))
    h = F.greatest(F.least("h.b", "o.b") - F.greatest("h.t", "o.t"), F.lit(0))
    area = lambda x: (F.col(f"{x}.r") - F.col(f"{x}.l")) * (F.col(f"{x}.b") - F.col(f"{x}.t"))
    cond = (F.col("h.page_id") == F.col("o.page_id")) & (w * h > share * F.least(area("h"), area("o")))
    return hits.alias("h").join(others.alias("o"), cond, "left_anti")
