import random

import pytest

from maskwright.llm.common import connected_components


def brute(edges):
    lowest = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(lowest[a], lowest[b])
            changed |= lowest[a] != low or lowest[b] != low
            lowest[a] = lowest[b] = low
    return lowest


def found(spark, edges, **rounds):
    rows = connected_components(spark.createDataFrame(edges, "a long, b long"), **rounds).collect()
    assert len(rows) == len({r.node for r in rows})  # one component for each node
    return {r.node: r.component for r in rows}


def test_a_leaf_between_two_centres_is_not_the_end(spark):
    edges = [(1, 5), (5, 6), (6, 7), (7, 2)]
    assert found(spark, edges) == {1: 1, 2: 1, 5: 1, 6: 1, 7: 1}


def test_shuffled_chains(spark):
    draw, edges = random.Random(7), []
    for k in range(160):
        nodes = [100 * k + x for x in draw.sample(range(100), draw.randint(5, 12))]
        edges += list(zip(nodes, nodes[1:]))
    assert found(spark, edges) == brute(edges)


def test_rounds_that_run_out_are_an_error(spark):
    with pytest.raises(RuntimeError):
        found(spark, [(1, 5), (5, 6), (6, 7), (7, 2)], most_rounds=1)
