from collections import Counter

import pytest

from maskwright.llm import line_dedup

from .helpers import docs, empty, mixed

WS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WS))


def brute(texts, least):
    split = [(t or "").split("\n") for t in texts]
    n = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    return [(i, len(x), sum(n[key(y)] >= least for y in x if key(y)), "\n".join(y for y in x if not key(y) or n[key(y)] < least)) for i, x in enumerate(split)]


@pytest.mark.parametrize("most", [400_000, 0])
@pytest.mark.parametrize("least", [2, 10])
def test_against_brute_force(spark, most, least):
    texts = mixed()
    got = line_dedup.drop_lines(docs(spark, texts), min_docs=least, broadcast_keys=most)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(texts, least)


def test_first_stays(spark):
    texts = ["same\nown1", "SAME \nown2", "own3\n same"]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(docs(spark, texts), min_docs=2, keep="first").collect()}
    assert got == {0: "same\nown1", 1: "own2", 2: "own3"}


def test_small_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 16)
    texts = mixed(3, 200)
    got = line_dedup.drop_lines(docs(spark, texts), min_docs=2)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()) == brute(texts, 2)


def test_empty_table(spark):
    assert line_dedup.drop_lines(empty(spark)).count() == 0
