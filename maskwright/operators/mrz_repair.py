"""Damaged lines of machine-readable documents: aligned with the formats, the check digits choosing among cheap repairs.

A format is a row of slots, each for letters, digits, either, or a check digit. A line is aligned with it by dynamic
programming over (slot, character): a character that fits its slot costs nothing, one that only its look-alike fits costs
one, a filler lost or doubled costs one; other losses aren't repaired. All repairs up to a cost are kept side by side, equal
ones once, and the one with most right check digits, then the lowest cost, then the first by its characters is taken. Only
lines that nearly have the length and the digits of a document reach the alignment, which works on Arrow batches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mrz

# Layouts of the lines (A letter or filler, D digit, X any, C check digit, S sex), what is read for what.
FORMATS = {
    "TD3": "X" * 9 + "CAAA" + "D" * 6 + "CS" + "D" * 6 + "C" + "X" * 14 + "CC",
    "TD2": "X" * 9 + "CAAA" + "D" * 6 + "CS" + "D" * 6 + "C" + "X" * 7 + "C",
    "TD1-1": "AAAAA" + "X" * 9 + "C" + "X" * 15,
    "TD1-2": "D" * 6 + "CS" + "D" * 6 + "CAAA" + "X" * 11 + "C",
}
#: (from, to, check) of the fields with a check digit.
CHECKS = {"TD3": ((0, 9, 9), (13, 19, 19), (21, 27, 27)), "TD2": ((0, 9, 9), (13, 19, 19), (21, 27, 27)), "TD1-1": ((5, 14, 14),), "TD1-2": ((0, 6, 6), (8, 14, 14))}
TO_DIGIT = dict(zip("OQDILZSBG", "000112586"))
TO_LETTER = dict(zip("0125862", "OIZSBGZ"))
MOST = 2  # the dearest repair
SCHEMA = "page_id {0}, line_no {1}, format string, line string, cost int, checks int"


def check_digit(value: str) -> int:
    total = 0
    for i, c in enumerate(value):
        n = 0 if c == "<" else int(c) if c.isdigit() else ord(c) - 55
        total += n * (7, 3, 1)[i % 3]
    return total % 10


def right_checks(format: str, line: str) -> int:
    return sum(line[c] == str(check_digit(line[a:b])) for a, b, c in CHECKS[format])


def choices(slot: str, c: str) -> list[tuple[str, int]]:
    """What a character may stand for in a slot, with its cost."""
    letter, digit, filler = "A" <= c <= "Z", c.isdigit(), c == "<"
    out = []
    if slot == "A" and (letter or filler) or slot in "DC" and digit or slot == "C" and filler or slot == "X" or slot == "S" and c in "MFX<":
        out.append((c, 0))
    if slot in "DXC" and c in TO_DIGIT:
        out.append((TO_DIGIT[c], 1))
    if slot in "AX" and c in TO_LETTER:
        out.append((TO_LETTER[c], 1))
    if slot in "AX" and c == "K":
        out.append(("<", 1))
    return out


def repairs(line: str, format: str, most: int = MOST) -> dict[str, int]:
    """Every line of the format within that cost, with the least cost of each."""
    slots = FORMATS[format]
    if abs(len(line) - len(slots)) > most:
        return {}
    # at[j]: lines that the first slots read from the first j characters.
    at: dict[int, dict[str, int]] = {0: {"": 0}}

    def put(table, j, text, cost):
        known = table.setdefault(j, {})
        if cost < known.get(text, most + 1):
            known[text] = cost

    def skip(table):
        """A filler twice: characters passed over."""
        for j in range(len(line)):
            if j in table and line[j] == "<":
                for text, cost in list(table[j].items()):
                    if cost < most:
                        put(table, j + 1, text, cost + 1)

    skip(at)
    for slot in slots:
        after: dict[int, dict[str, int]] = {}
        for j, found in at.items():
            ways = choices(slot, line[j]) if j < len(line) else []
            for c, more in ways:
                for text, cost in found.items():
                    if cost + more <= most:
                        put(after, j + 1, text + c, cost + more)
            if slot in "AXCS":
                for text, cost in found.items():
                    if cost < most:
                        put(after, j, text + "<", cost + 1)
        skip(after)
        at = after
    return at.get(len(line), {})


def repaired(line: str) -> tuple[str, str, int, int] | None:
    """(format, line, cost, right checks) of the best repair: all checks right, or for a cost of one at most all but one of three.

    Repairs of lower cost are tried first: where one of them has all checks right, none of a higher cost is better. (There are
    some thirty times as many repairs for each step of cost.)"""
    for most in range(MOST + 1):
        best = best_within(line, most)
        if best and best[3] == len(CHECKS[best[0]]):
            break
    return best


def best_within(line: str, most: int) -> tuple[str, str, int, int] | None:
    """The best of all repairs up to a cost."""
    best = None
    for format, checks in CHECKS.items():
        for text, cost in repairs(line, format, most).items():
            n = right_checks(format, text)
            if n == len(checks) or len(checks) == 3 and n == 2 and cost <= 1:
                # A card's first line has one check only: its head must be a document's.
                if format == "TD1-1" and text[0] not in "IAC":
                    continue
                key = (n - len(checks), -cost, [-ord(c) for c in text])
                if best is None or key > best[0]:
                    best = (key, (format, text, cost, n))
    return best and best[1]


def repair(lines: DataFrame) -> DataFrame:
    """(page_id, line_no, format, line, cost, checks) of lines(page_id, line_no, text) that are no whole line of a document but
    can be repaired to one. Lines of names, which have no check digits, only get back fillers: those read as K, and those
    lost or doubled at their end (format TD3-1, no checks)."""
    text = mrz.plain(F.col("text"))
    near = lines.select("page_id", "line_no", text.alias("line")).where(F.length("line").between(28, 46) & F.col("line").rlike("^[A-Z0-9<]+$") & ~mrz.is_line(F.col("line")))
    kept = F.regexp_replace(F.rtrim(F.when(F.col("line").rlike("^P[A-Z<][A-Z]{3}.*KKKKK$"), F.regexp_replace("line", "K{2,}", "<<")).otherwise(F.col("line")), F.lit("<")), "<{2,}", "<<")
    names = near.where(F.length("line").between(40, 46) & F.col("line").rlike("^P[A-Z<K][A-Z<]{3}[A-Z]+(?:<<|KK)[A-Z<]*(?:<<|KKKKK)$"))
    head = names.select("page_id", "line_no", F.lit("TD3-1").alias("format"), F.rpad(kept, 44, "<").alias("line"), F.lit(1).alias("cost"), F.lit(0).alias("checks"))
    # Fourteen digits or their look-alikes are the least that fields with checks have.
    numbers = near.where(F.regexp_count("line", F.lit("[0-9OQDILZSBG]")) >= 8).where(F.regexp_count("line", F.lit("[0-9]")) >= 5)

    def work(batches):
        for batch in batches:
            found = [repaired(x) for x in batch.column("line").to_pylist()]
            at = pa.array([i for i, x in enumerate(found) if x], pa.int64())
            columns = [pa.array([x[k] for x in found if x], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(at), batch.column("line_no").take(at), *columns], names=["page_id", "line_no", "format", "line", "cost", "checks"])

    kinds = [lines.schema[c].dataType.simpleString() for c in ("page_id", "line_no")]
    return numbers.mapInArrow(work, SCHEMA.format(*kinds)).unionByName(head)


def read(lines: DataFrame) -> DataFrame:
    """mrz.read over pages whose damaged lines are repaired first."""
    mended = repair(lines).select("page_id", "line_no", F.col("line").alias("_line"))
    # Sizes of compressed files tell little of the rows in them: never broadcast.
    both = lines.select("page_id", "line_no", "text").join(mended.hint("merge"), ["page_id", "line_no"], "left")
    return mrz.read(both.select("page_id", "line_no", F.coalesce("_line", "text").alias("text")))
