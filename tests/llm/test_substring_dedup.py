import random
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import substring_dedup as sd

from .helpers import docs, empty, mixed

WINDOW = 35


def brute(texts, window):
    words = [(t or "").encode().split() for t in texts]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for k, w in enumerate(words):
        gone = set()
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((k, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def passages(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghé", k=r.randint(1, 20)))
    shared = [" ".join(word() for _ in range(k)) for k in (34, 35, 36, 60, 150)]
    out = []
    for _ in range(60):
        parts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(3)]
        parts.insert(r.randrange(3), r.choice(shared))
        out.append("\n ".join(parts))
    return out + ["a " * 200, "a b " * 40, "x " + "a " * 36]


@pytest.mark.parametrize("window, gram", [(35, 8), (5, 2), (3, 3)])
def test_against_brute_force(spark, window, gram):
    texts = mixed(11) + passages(4)
    got = sd.remove_repeats(docs(spark, texts), window, gram)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, window)


@pytest.mark.parametrize("bits", [3, 10])
def test_words_decide_where_fingerprints_collide(spark, bits):
    """A hash of a few bits gives unlike windows the same fingerprint everywhere."""
    texts = mixed(12) + passages(5)
    got = sd.remove_repeats(docs(spark, texts), 35, 8, bits=bits)
    assert sorted(tuple(r) for r in got.collect()) == brute(texts, 35)


def test_a_later_session_adds_a_batch(spark):
    old, new = passages(6), passages(7)
    new[:10] = old[:10]
    path = f"{sd.shared_dir(spark)}/index-{random.random()}"
    sd.remove_repeats(docs(spark, old), index=sd.FingerprintIndex(spark, path)).count()
    later = spark.newSession()
    table, history = (later.createDataFrame([(i, t) for i, t in enumerate(x)], "doc_id long, text string") for x in (new, old))
    opened = sd.FingerprintIndex(later, path)
    assert opened.runs and opened.version
    got = sd.remove_repeats(table, index=opened, history=history)
    expected = {k: rest for k, *rest in brute(new + old, WINDOW) if k < len(new)}
    assert {r.doc_id: [r.n_words, r.n_removed, r.kept] for r in got.collect()} == expected


def test_history_is_not_shuffled(spark):
    index = sd.FingerprintIndex(spark)
    frame = lambda k: spark.range(k, k + 1000).selectExpr("id * 7 AS fp", "1L AS n")
    index.add(frame(0))
    new = index._write(frame(500).repartition(index.buckets, "fp"), 0)
    plan = new.select("fp").join(spark.table(index.runs[0][1]).hint("merge"), "fp", "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_repeated_rows_nulls_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "x"), (1, text, "x"), (None, None, "y"), (None, "short text", "y")]
    got = sd.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, _new string")).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == [("1", 80, 80, ""), ("1", 80, 80, ""), ("None", 0, 0, ""), ("None", 2, 0, "short text")]


def test_index_finds_repeats_across_batches_and_compacts(spark):
    index = sd.FingerprintIndex(spark)
    frame = lambda rows: spark.createDataFrame(rows, "fp long, n long")
    assert index.add(frame([(1, 1), (2, 2)])).collect() == [(2,)]
    assert sorted(r.fp for r in index.add(frame([(1, 1), (3, 1)])).collect()) == [1]
    assert len(index.runs) == 1
    assert sorted(r.fp for r in index.add(frame([(3, 1), (4, 1)])).collect()) == [3]
    assert sorted(tuple(r) for r in index.counts().collect()) == [(1, 2), (2, 2), (3, 2), (4, 1)]


def test_rolling_hash_depends_on_content_only():
    h = np.arange(50, dtype=np.uint64) % 7
    for n in (1, 2, 3, 8, 35):
        rolled = sd._rolled(h, n)
        assert len(rolled) == 51 - n
        by = {}
        for i, x in enumerate(rolled.tolist()):
            assert by.setdefault(tuple(h[i : i + n].tolist()), x) == x
        assert len(set(by.values())) == len(by)


def test_empty_table(spark):
    assert sd.remove_repeats(empty(spark)).count() == 0
