"""Names in text without spaces: a word lattice from a trie, and the likeliest row of roles through it.

Nothing is shipped: words, how often they play which role (surname, given name, anything else) and which role follows which
are counted by Spark from a labelled table. A line becomes a lattice of all words of the trie from every place on, with runs
of letters or digits and single characters as unknown words; the best path over words and roles together is found by dynamic
programming from the left. Names are stretches of neighbouring words with roles of names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Words that a model may have: it is sent to the executors.
MOST_WORDS = 2_000_000
#: Words never seen that share what is left for them: as probable all together as words seen once.
UNSEEN = 20_000
_EDGE = ""


@dataclass(frozen=True)
class Model:
    """words: word -> {role: log P(word | role)}; unknown: role -> log P of a word never seen; steps: (role, next) -> log P."""

    words: dict[str, dict[str, float]]
    unknown: dict[str, float]
    steps: dict[tuple[str, str], float]
    names: tuple[str, ...]


def fit(tokens: DataFrame, names: tuple[str, ...], smooth: float = 0.5) -> Model:
    """A model from tokens(sentence, pos, token, role), roles of names being `names`. Counts are summed in Spark; the driver sees
    one row per distinct word and role (an error beyond MOST_WORDS) and one per pair of roles."""
    rows = tokens.where("token is not null and token <> '' and role is not null")
    counted = rows.groupBy("token", "role").agg(F.count("*").alias("n"))
    found = counted.limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} words: too many to send to the executors")
    order = W.partitionBy("sentence").orderBy("pos")
    pairs = rows.select(F.coalesce(F.lag("role").over(order), F.lit(_EDGE)).alias("a"), F.col("role").alias("b"), F.lead("role").over(order).isNull().alias("last"))
    steps: dict[tuple[str, str], float] = {}
    for x in pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("last")).collect():
        steps[x.a, x.b] = steps.get((x.a, x.b), 0.0) + x.n
        if x["last"]:
            steps[x.b, _EDGE] = steps.get((x.b, _EDGE), 0.0) + x["last"]
    roles = sorted({x.role for x in found})
    total = {r: sum(x.n for x in found if x.role == r) for r in roles}
    kinds = len({x.token for x in found}) + 1
    words: dict[str, dict[str, float]] = {}
    for x in found:
        words.setdefault(x.token, {})[x.role] = math.log((x.n + smooth) / (total[x.role] + smooth * kinds))
    seen_once = {r: sum(x.n == 1 for x in found if x.role == r) for r in roles}
    unknown = {r: math.log((seen_once[r] + smooth) / (total[r] + smooth * kinds) / UNSEEN) for r in roles}
    out_of = {a: sum(n for (x, _), n in steps.items() if x == a) for a in [_EDGE, *roles]}
    smoothed = {(a, b): math.log((steps.get((a, b), 0.0) + smooth) / (out_of[a] + smooth * (len(roles) + 1))) for a in [_EDGE, *roles] for b in [*roles, _EDGE]}
    return Model(words, unknown, smoothed, tuple(names))


def trie(words) -> dict:
    """Nested by character; the key None marks the end of a word."""
    root: dict = {}
    for word in words:
        at = root
        for c in word:
            at = at.setdefault(c, {})
        at[None] = word
    return root


def lattice(text: str, root: dict) -> list[list[tuple[int, str]]]:
    """From each place the (end, word) of the words of the trie, and of one unknown word: a run of ASCII letters, of digits, or
    a single character."""
    out = []
    for i, c in enumerate(text):
        edges, at, j = [], root, i
        while at is not None:
            if None in at and j > i:
                edges.append((j, text[i:j]))
            at = at.get(text[j]) if j < len(text) else None
            j += 1
        k = i + 1
        if c.isascii() and c.isalnum():
            while k < len(text) and text[k].isascii() and text[k].isalnum() and text[k].isdigit() == c.isdigit():
                k += 1
        if all(end != k for end, _ in edges):
            edges.append((k, text[i:k]))
        out.append(edges)
    return out


def emission(word: str, role: str, model: Model) -> float | None:
    """log P(word | role), None where it can't be: a word never seen is no surname (the first of the roles of names), and plays
    another role of names only if it is a letter beyond ASCII."""
    known = model.words.get(word)
    if known is not None:
        return known.get(role)
    if role in model.names and (role == model.names[0] or word.isascii() or not word.isalpha()):
        return None
    return model.unknown[role]


def best_path(text: str, model: Model, root: dict | None = None) -> tuple[float, list[tuple[int, int, str]]]:
    """(log probability, [(start, end, role)]) of the likeliest words and roles; of equals the first by places, then roles."""
    root = trie(model.words) if root is None else root
    roles = sorted(model.unknown)
    at: list[dict[str, tuple[float, int, str]]] = [{} for _ in range(len(text) + 1)]
    at[0][_EDGE] = (0.0, 0, _EDGE)
    edges = lattice(text, root)
    for i in range(len(text)):
        for role, (score, _, _) in at[i].items():
            for end, word in edges[i]:
                for new in roles:
                    emits = emission(word, new, model)
                    if emits is None:
                        continue
                    total = score + model.steps[role, new] + emits
                    if new not in at[end] or (-total, i, role) < (-at[end][new][0], at[end][new][1], at[end][new][2]):
                        at[end][new] = (total, i, role)
    if not text:
        return 0.0, []
    role = min(at[-1], key=lambda r: (-(at[-1][r][0] + model.steps[r, _EDGE]), r))
    score, end, path = at[-1][role][0] + model.steps[role, _EDGE], len(text), []
    while end:
        _, start, before = at[end][role]
        path.append((start, end, role))
        end, role = start, before
    return score, path[::-1]


def spans(path: list[tuple[int, int, str]], model: Model) -> list[tuple[int, int]]:
    """Stretches of words with roles of names; the first of those roles begins a new one."""
    out: list[list[int]] = []
    for k, (start, end, role) in enumerate(path):
        if role not in model.names:
            continue
        if out and k and path[k - 1][2] in model.names and out[-1][1] == start and role != model.names[0]:
            out[-1][1] = end
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def find(lines: DataFrame, model: Model, most: int = 400) -> DataFrame:
    """(page_id, line_no, start, end, token) of names of two characters or more in lines(page_id, line_no, text).

    Work per line grows with its length. A line of over `most` characters is cut behind a character that is no letter (if
    there is none, after `most`), so that memory stays bounded; nothing of it is left out.
    """
    sent = lines.sparkSession.sparkContext.broadcast(model)

    def pieces(text):
        at = 0
        while len(text) - at > most:
            end = next((k for k in range(at + most, at + most // 2, -1) if not text[k - 1].isalnum()), at + most)
            yield at, text[at:end]
            at = end
        yield at, text[at:]

    def work(batches):
        own = sent.value
        root = trie(own.words)
        for batch in batches:
            at, starts, ends, tokens = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for begin, piece in pieces(text or ""):
                    for a, b in spans(best_path(piece, own, root)[1], own):
                        if b - a >= 2:
                            at.append(i), starts.append(begin + a), ends.append(begin + b), tokens.append(piece[a:b])
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(rows), batch.column("line_no").take(rows), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(tokens, pa.string())], names=["page_id", "line_no", "start", "end", "token"])

    kinds = [lines.schema[c].dataType.simpleString() for c in ("page_id", "line_no")]
    return lines.select("page_id", "line_no", "text").mapInArrow(work, f"page_id {kinds[0]}, line_no {kinds[1]}, start int, end int, token string")
