"""Candidates: duplicates, joins of neighbours, order of drawing, edits of a plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType

REGIONS = ("FACE", "BARCODE")
SOURCE_PRIORITY = {"RULE": 0, "FACE": 0, "BARCODE": 0, "MANUAL": 0, "LINE": 0, "ENTITY_MODEL": 1, "LLM": 2}


def area(p: str = "") -> Column:
    return (F.col(f"{p}r") - F.col(f"{p}l")) * (F.col(f"{p}b") - F.col(f"{p}t"))


def iou(a: str, b: str) -> Column:
    w = F.greatest(F.least(f"{a}.r", f"{b}.r") - F.greatest(f"{a}.l", f"{b}.l"), F.lit(0))
    h = F.greatest(F.least(f"{a}.b", f"{b}.b") - F.greatest(f"{a}.t", f"{b}.t"), F.lit(0))
    return F.coalesce(w * h / F.nullif(area(f"{a}.") + area(f"{b}.") - w * h, F.lit(0)), F.lit(0.0))


def source_priority(source: Column) -> Column:
    out = F.lit(3)
    for name, n in SOURCE_PRIORITY.items():
        out = F.when(source == name, n).otherwise(out)
    return out


def dedupe(candidates: DataFrame, most: float = 0.6) -> DataFrame:
    """Greedy suppression within a page and kind: by source, confidence and area, a box stays unless one that stays overlaps it
    by more than `most`; what it enables is passed on to the first that does. A native fold over the boxes of a page."""
    rest = [c for c in candidates.columns if c not in ("page_id", "kind")]
    one = F.struct(source_priority(F.col("source")).alias("_p"), (-F.col("confidence")).alias("_c"), (-area()).alias("_a"), F.col("id").alias("_i"), F.struct(*rest).alias("x"))
    grouped = candidates.groupBy("page_id", "kind").agg(F.sort_array(F.collect_list(one)).alias("_all"))
    zero = F.array().cast(f"array<{candidates.select(F.struct(*rest).alias('x')).schema['x'].dataType.simpleString()}>")

    def overlap(x, y):
        both = F.greatest(F.least(x["r"], y["r"]) - F.greatest(x["l"], y["l"]), F.lit(0)) * F.greatest(F.least(x["b"], y["b"]) - F.greatest(x["t"], y["t"]), F.lit(0))
        size = lambda z: (z["r"] - z["l"]) * (z["b"] - z["t"])
        return F.coalesce(both / F.nullif(size(x) + size(y) - both, F.lit(0)), F.lit(0.0)) > most

    def fold(kept, y):
        x = y["x"]
        at = F.array_position(F.transform(kept, lambda k: overlap(x, k)), True)  # 0 where none does
        passed = F.transform(kept, lambda k, i: F.when(i + 1 == at, k.withField("enabled", k["enabled"] | x["enabled"])).otherwise(k))
        return F.when(at == 0, F.concat(kept, F.array(x))).otherwise(passed)

    kept = grouped.select("page_id", "kind", F.explode(F.aggregate("_all", zero, fold)).alias("x"))
    return kept.select("page_id", "kind", "x.*").select(*candidates.columns)


def _joined(boxes: list[dict], gap: float) -> list[dict]:
    """The candidates of a page and kind after joining: the first takes in, pass by pass, whatever the box so far reaches."""
    todo, out = list(boxes), []
    while todo:
        own = dict(todo.pop(0))
        grew = own["source"] not in REGIONS
        while grew:
            grew, left = False, []
            for x in todo:
                h = max(own["b"] - own["t"], x["b"] - x["t"])
                apart = max(0.0, max(own["l"], x["l"]) - min(own["r"], x["r"]))
                if x["source"] in REGIONS or abs(own["t"] + own["b"] - x["t"] - x["b"]) > h or apart >= gap * h:
                    left.append(x)
                    continue
                grew = True
                own |= {"id": f"{own['id']}+{x['id']}", "l": min(own["l"], x["l"]), "t": min(own["t"], x["t"]), "r": max(own["r"], x["r"]), "b": max(own["b"], x["b"])}
                own |= {"confidence": max(own["confidence"], x["confidence"]), "enabled": own["enabled"] or x["enabled"]}
            todo = left
        out.append(own)
    return out


def join_adjacent(candidates: DataFrame, gap: float = 0.5) -> DataFrame:
    """Level candidates of one page and kind that stand side by side become one, in the order of dedupe.

    Two join if their centres differ by half the greater height at most and the gap is under gap heights; the joined box is
    compared on, until it reaches no more. Faces and codes never join. Spark gathers the candidates of a page and kind in one
    array; Python sees many such arrays per Arrow batch.
    """
    fields = ("id", "source", "l", "t", "r", "b", "confidence", "enabled")
    key = [source_priority(F.col("source")).alias("_p"), (-F.col("confidence")).alias("_c"), (-area()).alias("_a"), F.col("id").alias("_i")]
    grouped = candidates.groupBy("page_id", "kind").agg(F.sort_array(F.collect_list(F.struct(*key, F.struct(*fields).alias("x")))).alias("all"))
    box = candidates.select(*fields).schema
    schema = candidates.select("page_id", "kind").schema.add("boxes", ArrayType(box))

    def run(batches):
        for batch in batches:
            out = [_joined(x, gap) for x in batch.column("boxes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("kind"), pa.array(out, batch.column("boxes").type)], ["page_id", "kind", "boxes"])

    arrays = grouped.select("page_id", "kind", F.transform("all", lambda x: x["x"]).alias("boxes"))
    return arrays.mapInArrow(run, schema).select("page_id", "kind", F.explode("boxes").alias("x")).select("page_id", "kind", "x.*").drop("source")


def drawing_order(plan: DataFrame) -> DataFrame:
    """plan with `draw`: what was found first, by falling area, then what users added, in their order."""
    by_user = F.col("source").isin("MANUAL", "LINE")
    key = [by_user, F.when(~by_user, -area()), F.col("ord")]
    return plan.withColumn("draw", F.row_number().over(W.partitionBy("page_id").orderBy(*key)))


def mask_plan(candidates: DataFrame, style: str = "SOLID") -> DataFrame:
    """The enabled candidates with a look, largest first."""
    order = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc(area()), "id"))
    return candidates.where("enabled").select("page_id", order.alias("ord"), F.col("id").alias("candidate_id"), "kind", "source", "l", "t", "r", "b", F.lit(style).alias("style"))


def edited(plan: DataFrame, edits: DataFrame) -> DataFrame:
    """plan after edits(page_id, candidate_id, op, style): REMOVE takes out, RESTYLE changes the look; later steps count."""
    last = edits.withColumn("_n", F.row_number().over(W.partitionBy("page_id", "candidate_id").orderBy(F.desc("step")))).where("_n = 1").select("page_id", "candidate_id", "op", F.col("style").alias("_style"))
    both = plan.join(last, ["page_id", "candidate_id"], "left").where("op is null or op <> 'REMOVE'")
    return both.withColumn("style", F.when(F.col("op") == "RESTYLE", F.col("_style")).otherwise(F.col("style"))).drop("op", "_style")


def undo_stack(steps: DataFrame, depth: int = 50) -> DataFrame:
    """(page_id, states): the history of steps(page_id, step, op, state) after PUSH, UNDO and REDO, `depth` at most.

    Rows are dealt and sorted by page and step and streamed; a task holds one page's stack of `depth` states, whatever the
    length of its history. A push forgets what could be redone.
    """
    schema = steps.select("page_id").schema.add("states", ArrayType(StringType()))

    def run(batches):
        page, states, undone, open_ = None, [], [], False
        for batch in batches:
            done = []
            for own, op, state in zip(*(batch.column(c).to_pylist() for c in ("page_id", "op", "state"))):
                if open_ and own != page:
                    done.append((page, states))
                if not open_ or own != page:
                    page, states, undone, open_ = own, [], [], True
                if op == "UNDO":
                    if states:
                        undone.append(states.pop())
                        del undone[:-depth]
                elif op == "REDO":
                    if undone:
                        states.append(undone.pop())
                else:
                    states.append(state)
                    undone = []
                del states[:-depth]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], batch.schema.field("page_id").type), pa.array([list(x) for _, x in done], pa.list_(pa.string()))], ["page_id", "states"])
            last = batch.schema.field("page_id").type
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([page], last), pa.array([states], pa.list_(pa.string()))], ["page_id", "states"])

    return steps.select("page_id", "step", "op", "state").repartition("page_id").sortWithinPartitions("page_id", "step").mapInArrow(run, schema)


def newest(runs: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    """The newest n runs of each key."""
    return runs.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("number")))).where(F.col("_n") <= n).drop("_n")


def free_corner(masks: DataFrame, corners: DataFrame) -> DataFrame:
    """(page_id, corner): the first corner box(page_id, corner, l, t, r, b) that no mask meets; -1 where all are taken."""
    meets = (F.col("c.page_id") == F.col("m.page_id")) & (F.col("c.l") < F.col("m.r")) & (F.col("m.l") < F.col("c.r")) & (F.col("c.t") < F.col("m.b")) & (F.col("m.t") < F.col("c.b"))
    free = corners.alias("c").join(masks.alias("m"), meets, "left_anti").groupBy("page_id").agg(F.min("corner").alias("corner"))
    return corners.select("page_id").distinct().join(free, "page_id", "left").select("page_id", F.coalesce("corner", F.lit(-1)).alias("corner"))


def runs_of(selected: DataFrame) -> DataFrame:
    """Runs of selected glyphs(page_id, line_no, i): (page_id, line_no, first, last) of each run without a gap."""
    w = W.partitionBy("page_id", "line_no").orderBy("i")
    return selected.withColumn("_g", F.col("i") - F.row_number().over(w)).groupBy("page_id", "line_no", "_g").agg(F.min("i").alias("first"), F.max("i").alias("last")).drop("_g")


def ctc_decode(steps: DataFrame, blank: int = 0) -> DataFrame:
    """(seq_id, first, last, cls, p): greedy decoding of steps(seq_id, step, cls, p): best class, runs collapsed, blanks gone."""
    best = steps.withColumn("_n", F.row_number().over(W.partitionBy("seq_id", "step").orderBy(F.desc("p"), "cls"))).where("_n = 1")
    w = W.partitionBy("seq_id").orderBy("step")
    new = F.coalesce((F.col("cls") != F.lag("cls").over(w)).cast("int"), F.lit(1))
    runs = best.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return runs.where(F.col("cls") != blank).groupBy("seq_id", "_run", "cls").agg(F.min("step").alias("first"), F.max("step").alias("last"), F.avg("p").alias("p")).drop("_run")
