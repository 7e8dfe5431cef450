import pytest

from maskwright.llm import mixing

from .helpers import docs, empty


def run(spark, sizes, sources, **kw):
    texts = [" ".join(["w"] * n) if n is not None else None for n in sizes]
    return mixing.mix(docs(spark, texts, sources=sources), **kw).collect()


def test_targets_and_takes(spark):
    sizes = [(7 * i) % 90 for i in range(400)] + [None, 0]
    sources = [["a", "b", "c", None, "hot", "hot"][i % 6] for i in range(402)]
    got = run(spark, sizes, sources)
    assert len(got) == 402
    total = sum(s or 0 for s in sizes)
    goals = {r.source: r.target for r in got}
    assert sum(goals.values()) == pytest.approx(total)
    for s in goals:
        own = [r for r in got if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert all(0 <= r.taken <= 3 * r.size for r in own)
        assert goals[s] <= 3 * own[0].source_size
        assert abs(sum(r.taken for r in own) - goals[s]) <= 45
    assert goals["a"] == 3 * next(r.source_size for r in got if r.source == "a") or goals["a"] / goals["b"] == pytest.approx(2.5)


def test_budgets_nest(spark):
    sizes, sources = [5 + i % 11 for i in range(200)], ["a"] * 200
    small = {r.doc_id for r in run(spark, sizes, sources, share=0.3) if r.taken}
    large = {r.doc_id for r in run(spark, sizes, sources, share=0.6) if r.taken}
    assert small < large


def test_repeated_rows_and_blank_tables(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert [r.taken for r in run(spark, [None, 0], ["a", None])] == [0, 0]
    table = docs(spark, ["a b c"] * 10)
    both = mixing.mix(table.union(table)).collect()
    by = {}
    for r in both:
        by.setdefault(r.doc_id, set()).add(r.taken)
    assert len(both) == 20 and all(len(x) == 1 for x in by.values())
