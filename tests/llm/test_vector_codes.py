"""Vector codes: plain k-means over all pairs of parts and entries in Python's integers, and rare cases."""

import math
import random

import numpy as np
import pytest

from maskwright.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def brute(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return {}, []
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    seeds = {}
    for i, v, _ in kept:
        if i is not None:
            seeds[i] = min(seeds.get(i, v), v)
    books = [[seeds[i][p * width : (p + 1) * width] for i in sorted(seeds)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            to = [near(c[p], books[p])[1] for c in cut]
            for e in range(len(books[p])):
                mine = [c[p] for c, t in zip(cut, to) if t == e]
                if mine:
                    books[p][e] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for (i, _, label), c in zip(kept, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, books


def compressed(spark, rows):
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    return coded.select("vec_id", "label", "code", "error", "label_error").collect(), books


def compare(spark, rows):
    got, books = compressed(spark, rows)
    want, plain = brute(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in got), key=key) == sorted(want, key=key)
    assert books.tolist() == plain
    for r in got:
        assert r.label_error == sum(x[3] for x in want if x[1] == r.label)
    return got, books


def test_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(200)]), [rng.gauss(0, 0.05) for _ in range(24)], rng.choice([None, 1, 2]), "z") for _ in range(150)]
    rows += [(900, None, 1, "z"), (901, [None] * 24, 1, "z"), (902, [math.nan] * 24, 1, "z"), (903, [0.0] * 23 + [math.inf], 1, "z"), (-5, [-math.inf] * 24, 1, "z")]
    compare(spark, rows + rows[:20])


def test_ties_and_few_ids(spark):
    rng = random.Random(3)
    compare(spark, [(i, [float(rng.choice([-1, 0, 1])) / 4096 for _ in range(16)], 7, "") for i in range(60)])
    compare(spark, [(5, [0.25] * 8, None, ""), (5, [0.125] * 8, None, ""), (None, [9.0] * 8, None, "")])


def test_empty_and_unusable(spark):
    assert compressed(spark, []) == ([], None)
    assert compressed(spark, [(1, None, 1, ""), (None, [1.0] * 8, 1, "")]) == ([], None)
    with pytest.raises(Exception, match="components"):
        compressed(spark, [(1, [1.0] * 8, 1, ""), (2, [1.0] * 16, 1, "")])


def test_decoding_comes_as_near_as_the_error_says(spark):
    rng = random.Random(4)
    rows = [(i, [math.floor(rng.gauss(0, 300)) / 4096 for _ in range(16)], 1, "") for i in range(50)]
    coded, books = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    vectors = {i: v for i, v, *_ in rows}
    for r in vector_codes.decode(coded, books).collect():
        apart = sum((4096 * (a - b)) ** 2 for a, b in zip(vectors[r.vec_id], r.approximation))
        assert round(apart) == r.error
