"""Redacted text: each finding replaced by its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans as S
from ..functions.text import half_width_digits
from . import classify as C
from . import rules as R


def redacted_text(text: Column, found: Column) -> Column:
    """text with the union of found replaced; a stretch of several kinds is named after the first."""

    def name(x):
        own = F.filter(found, lambda h: S.overlaps(x, h))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(own, 0)["kind"].alias("label"))

    return S.replaced(text, F.transform(S.merged(found), name))


def redact_lines(lines: DataFrame, states: dict[str, str] | None = None, floor: float = 0.5) -> DataFrame:
    """lines with `redacted` and `n_masks`; lines below the confidence floor stay as they are."""
    chosen = R.chosen(states)
    folded = half_width_digits(F.col("text"))
    may = (F.col("confidence") >= floor) & R.may_match(folded, chosen)
    none = F.array().cast(f"array<{R.HIT}>")
    found = lines.withColumn("_hits", F.when(may, R.hits(folded, chosen)).otherwise(none))
    settled = found.withColumn("_hits", F.when(F.size("_hits") > 0, R.yielded(F.col("text"), F.col("_hits"), chosen)).otherwise(F.col("_hits")))
    new = F.when(F.size("_hits") > 0, redacted_text(F.col("text"), F.col("_hits"))).otherwise(F.col("text"))
    return settled.withColumns({"redacted": new, "n_masks": F.size(F.when(F.size("_hits") > 0, S.merged(F.col("_hits"))).otherwise(F.array().cast("array<struct<start:int,end:int>>")))}).drop("_hits")


def redact_pages(lines: DataFrame, states: dict[str, str] | None = None, floor: float = 0.5, forms: bool = True) -> DataFrame:
    """(page_id, line_no, redacted, n_masks) of lines with boxes, by what classify finds on their pages."""
    hits = C.classify(lines, states, floor, forms=forms)
    one = F.struct("start", "end", "kind")
    found = hits.groupBy("page_id", "line_no").agg(F.sort_array(F.collect_list(one)).alias("_found"))
    both = lines.select("page_id", "line_no", "text").join(found, ["page_id", "line_no"], "left")
    new = F.when(F.col("_found").isNull(), F.col("text")).otherwise(redacted_text(F.col("text"), F.col("_found")))
    return both.select("page_id", "line_no", new.alias("redacted"), F.when(F.col("_found").isNull(), F.lit(0)).otherwise(F.size(S.merged(F.col("_found")))).alias("n_masks"))


@R.once_per_application
def _document_steps(chosen: tuple, fold: bool) -> tuple[Column, Column, Column, Column]:
    """The lines with their hits; anchors of the lines where one is a guess; rules with a sure hit; redacted lines."""

    half = half_width_digits if fold else lambda x: x

    def read(line):
        def settle(folded, found):
            return F.when(F.size(found) > 0, R.yielded(folded, found, chosen)).otherwise(found)

        def look(folded):
            none = F.array().cast(f"array<{R.HIT}>")
            return F.when(R.may_match(folded, chosen), S.let(R.hits(folded, chosen, whole_page=True), lambda found: settle(folded, found))).otherwise(none)

        # Digits are folded once per line.
        return F.struct(line.alias("text"), S.let(half(line), look).alias("hits"))

    guessing = any(f.guess for r in chosen for f in r.finders)
    cued = [r for r in chosen if any(getattr(f, "page", False) for f in r.finders)]
    folded = lambda: F.transform("_lines", lambda x: half(x["text"]))
    guessed = F.exists("_lines", lambda x: F.exists(x["hits"], lambda h: R.is_guess(h, chosen)))
    anchors = F.when(guessed, F.transform(folded(), C.nearby_anchors)) if guessing else F.lit(None)

    def sure(rule):
        return F.exists("_lines", lambda x: F.exists(x["hits"], lambda h: (h["rule_id"] == rule.id) & ~R.of_page(h, chosen) & ~R.is_guess(h, chosen)))

    def finish(x, i):
        kept = x["hits"]
        if guessing:
            kept = F.when(F.col("_anchors").isNull(), kept).otherwise(F.filter(kept, lambda h: ~R.is_guess(h, chosen) | C.supported_within(folded(), F.col("_anchors"), i, h)))
        if cued:
            kept = F.filter(kept, lambda h: ~R.of_page(h, chosen) | F.array_contains("_sure", h["rule_id"]))
        new = lambda found: F.struct(F.when(F.size(found) > 0, redacted_text(x["text"], found)).otherwise(x["text"]).alias("text"), F.size(S.merged(found)).alias("n"))
        return F.when(F.size(x["hits"]) == 0, F.struct(x["text"].alias("text"), F.lit(0).alias("n"))).otherwise(S.let(kept, new))

    return F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), read), anchors, F.array_compact(F.array(*[F.when(sure(r), F.lit(r.id)) for r in cued])), F.transform("_lines", finish)


def redact_documents(docs: DataFrame, states: dict[str, str] | None = None, catalogue: tuple[R.Rule, ...] = R.CATALOGUE, fold: bool = True) -> DataFrame:
    """(doc_id, redacted, n_masks): every finding of a document in place of its kind; a document is a page of lines.

    Nothing is shuffled: a document's lines stay in its row. Guesses need an anchor as in classify, by the layout that
    ingest.with_boxes gives to text; only documents with a guess are read again for anchors. Findings that only count beside
    another of their rule need that in the document. fold: full-width digits are read as half-width ones.
    """
    # Projections of their own: each array is worked out once.
    steps = _document_steps(R.chosen(states, catalogue), fold)
    done = docs.withColumn("_lines", steps[0]).withColumn("_anchors", steps[1]).withColumn("_sure", steps[2]).withColumn("_lines", steps[3])
    return done.select("doc_id", F.array_join(F.transform("_lines", lambda x: x["text"]), "\n").alias("redacted"), F.aggregate("_lines", F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_masks"))
