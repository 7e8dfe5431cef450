"""Second pass: prompts for a model of the user's choice, and its replies as findings. The reply comes from a table or a UDF."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE_CHARS, BUDGET = 120, 1200


def chunks(lines: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(page_id, chunk, line_no, n, text): lines, shortened to 120 characters, packed greedily to the budget, numbered from 1.

    The lengths of a page's lines are folded in one array; the texts stay in their rows.
    """
    usable = lines.where((F.col("confidence") >= 0.5) & (F.regexp_count("text", F.lit(r"[\p{L}0-9]")) >= 2)).select("page_id", "line_no", F.substring("text", 1, LINE_CHARS).alias("text"))
    sizes = usable.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("line_no", F.length("text").alias("size")))).alias("all"))
    kind = lines.schema["line_no"].dataType.simpleString()
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.lit(0).alias("n"), F.array().cast(f"array<struct<line_no:{kind},chunk:int,n:int>>").alias("out"))

    def step(acc, x):
        new = (acc["n"] > 0) & (acc["used"] + x["size"] > budget)
        chunk, n = acc["chunk"] + new.cast("int"), F.when(new, 1).otherwise(acc["n"] + 1)
        used = F.when(new, x["size"]).otherwise(acc["used"] + x["size"])
        return F.struct(chunk.alias("chunk"), used.alias("used"), n.alias("n"), F.concat(acc["out"], F.array(F.struct(x["line_no"].alias("line_no"), chunk.alias("chunk"), n.alias("n")))).alias("out"))

    placed = sizes.select("page_id", F.explode(F.aggregate("all", zero, step, lambda acc: acc["out"])).alias("x")).select("page_id", "x.*")
    return placed.join(usable, ["page_id", "line_no"]).select("page_id", "chunk", "line_no", "n", "text")


def parsed(replies: DataFrame, longest: int = 60) -> DataFrame:
    """(page_id, kind, quote) of replies(page_id, reply) with one 'kind|quote' per line; quotes of 2 to `longest` characters."""
    row = replies.select("page_id", F.explode(F.split("reply", "\n")).alias("line")).where(F.col("line").contains("|"))
    quote = F.trim(F.substring_index("line", "|", -1), F.lit(" \t\"'“”‘’「」"))
    return row.select("page_id", F.upper(F.trim(F.substring_index("line", "|", 1))).alias("kind"), quote.alias("quote")).where(F.length("quote").between(2, longest)).distinct()


def located(quotes: DataFrame, lines: DataFrame, first: bool = False) -> DataFrame:
    """(page_id, line_no, kind, start, end): all places of quotes that aren't part of a longer word or number; or, with first,
    the first place of each quote in a line, whatever stands around it."""
    both = lines.select("page_id", "line_no", "text").join(quotes, "page_id").where(F.col("text").contains(F.col("quote")))
    if first:
        at = F.instr("text", F.col("quote")) - 1
        return both.select("page_id", "line_no", "kind", at.alias("start"), (at + F.length("quote")).alias("end"))
    parts = F.split("text", F.concat(F.lit("\\Q"), "quote", F.lit("\\E")), -1)
    starts = both.select("*", parts.alias("_p")).select("*", F.posexplode(F.slice("_p", 1, F.size("_p") - 1)).alias("_i", "_x"))
    before = F.aggregate(F.slice("_p", F.lit(1), F.col("_i") + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.col("_i") * F.length("quote")
    placed = starts.withColumn("start", before).withColumn("end", before + F.length("quote"))
    glued = lambda a, b: a.rlike("[A-Za-z]$") & b.rlike("^[A-Za-z]") | a.rlike("[0-9]$") & b.rlike("^[0-9]")
    left = glued(F.substring("text", F.lit(1), F.col("start")), F.col("quote"))
    right = glued(F.col("quote"), F.substring("text", F.col("end") + 1, F.length("text")))
    return placed.where(~left & ~right).select("page_id", "line_no", "kind", "start", "end")


def vetoed(found: DataFrame, off_hits: DataFrame, least: float = 0.6) -> DataFrame:
    """found without what a rule that is off matches as a whole with enough confidence."""
    same = [F.col("f.page_id") == F.col("o.page_id"), F.col("f.line_no") == F.col("o.line_no"), F.col("f.start") == F.col("o.start"), F.col("f.end") == F.col("o.end"), F.col("o.confidence") >= least]
    cond = same[0]
    for s in same[1:]:
        cond = cond & s
    return found.alias("f").join(off_hits.alias("o"), cond, "left_anti")
