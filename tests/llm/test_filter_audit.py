"""Filter interaction audit: each document walked through each order, and rare cases."""

import random
import re
from collections import defaultdict
from itertools import permutations

import numpy as np

from maskwright.llm import filter_audit

DOCS = "doc_id long, text string, source string, good string"
LABELS = "doc_id long, quality int, toxic int, text string"


def brute(docs, labels):
    first = {}
    for i, text, *_ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good = {i for i, q, *_ in labels if q == 1}
    toxic = {i for i, _, t, *_ in labels if t == 1}
    out = defaultdict(lambda: [0] * 6)
    parts = set()
    for i, text, source, *_ in docs:
        t, part = text or "", source or ""
        parts.add(part)
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, "".join(order), step]
                row[1] += fails[f] and not gone
                row[2] += fails[f] and gone
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += fails[f] and not gone and i in good
                row[5] += fails[f] and not gone and i in toxic
                gone |= fails[f]
                row[0] += not gone
    rows = set()
    for part in parts:
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                share = sum(out[part, "".join(o), o.index(f) + 1][1] for o in permutations("ABCDE"))
                rows.add((part, "".join(order), step, *out[part, "".join(order), step], share))
    return rows


def audited(spark, docs, labels):
    counts = filter_audit.mask_counts(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return [tuple(r) for r in filter_audit.audit(counts).collect()]


def test_against_walking_each_document(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "C", "#", "déjà", "x" * 9]) for _ in range(n)) for n in (0, 3, 49, 50, 51, 90) for _ in range(2)]
    texts += [" ".join(f"w{i}" for i in range(60)), " ".join(f"W{i}" for i in range(60)), None, "", "\n\t", "𝔘𝔘 A"]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", None, ""]), "x") for _ in range(120)]
    docs += docs[:15]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None]), "y") for _ in range(60)]
    got = audited(spark, docs, labels)
    assert len(got) == len(set(got)) and set(got) == brute(docs, labels)


def test_very_long_text_and_a_large_group_of_copies(spark):
    docs = [(i, "same " * 100_000, "hot", "") for i in range(30)] + [(99, "w", "hot", "")]
    assert set(audited(spark, docs, [(3, 1, 0, "")])) == brute(docs, [(3, 1, 0, "")])


def test_empty_tables(spark):
    assert audited(spark, [], []) == []
    assert len(audited(spark, [(None, None, None, None)], [])) == 600


def test_ranks_are_the_first_failing_step():
    orders, positions, ranks = filter_audit.removal_ranks(3)
    for o, order in enumerate(orders):
        assert [order[positions[f, o]] for f in range(3)] == [0, 1, 2]
        for mask in range(8):
            steps = [s for s, f in enumerate(order) if mask >> f & 1]
            assert ranks[mask, o] == (steps[0] if steps else 3)
    assert filter_audit.scatter(np.zeros((2, 8, 3), dtype=np.int64), 3)["kept"].shape == (2, 6, 3)
