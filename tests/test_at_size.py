"""What keeps queries within their limits on large tables, seen on small ones."""

import pytest

from maskwright.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["long_numbers", "labelled_lines", "document_pages", "birth_echoes", "date_readings", "typed_labels", "damaged_documents"])
def test_long_work_on_rows_is_dealt_over_all_tasks(spark, name, monkeypatch):
    from maskwright.operators import fields

    monkeypatch.setattr(fields, "once", lambda df: df)  # the plan as a whole
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SMALL))


@pytest.mark.parametrize("name", ["values_beside", "stacked_values", "typed_labels", "birth_echoes", "damaged_documents"])
def test_tables_as_large_as_the_input_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan(QUERIES[name](spark, SMALL))


def test_a_place_touched_many_times_meets_its_glyphs_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from maskwright.operators import glyphs

    touches = spark.range(1000).select(F.col("id").alias("touch_id"), F.lit(1).alias("page_id"), (F.col("id") % 2 * 100).alias("x"), F.lit(5).alias("y"))
    own = spark.range(50).select(F.lit(1).alias("page_id"), F.col("id").alias("glyph"), (F.col("id") * 4).alias("l"), F.lit(0).alias("t"), (F.col("id") * 4 + 3).alias("r"), F.lit(9).alias("b"))
    for most in (200_000, 0):
        monkeypatch.setattr(glyphs, "MOST_SENT", most)
        places, whole = [], glyphs.once
        monkeypatch.setattr(glyphs, "once", lambda df: places.append(whole(df)) or places[-1])
        got = {r.touch_id: r.glyph for r in glyphs.glyph_at(touches, own, 9.0).collect()}
        assert got == {i: 25 if i % 2 else 0 for i in range(1000)}
        assert [p.count() for p in places] == [2]
        monkeypatch.undo()


def test_spans_with_nothing_between_need_no_text(spark):
    from maskwright.operators import metrics

    spans = spark.createDataFrame([(1, 0, "A", 0, 2), (1, 0, "A", 3, 5), (1, 0, "A", 9, 12), (1, 0, "A", 10, 14), (1, 1, "POSTAL_ADDRESS", 0, 3), (1, 1, "POSTAL_ADDRESS", 9, 12), (1, 1, "A", 0, 3), (1, 1, "A", 9, 12), (2, 0, "A", 0, 1)], "page_id int, line_no int, kind string, start int, end int")
    lines = spark.createDataFrame([(1, 0, "ab cd xx yyyyyyy"), (1, 1, "foo, NY, bar")], "page_id int, line_no int, text string")
    out = metrics.joined_spans(spans, lines)
    assert sorted(map(tuple, out.collect())) == [(1, 0, "A", 0, 5), (1, 0, "A", 9, 14), (1, 1, "A", 0, 3), (1, 1, "A", 9, 12), (1, 1, "POSTAL_ADDRESS", 0, 12)]
    # Windows sort spans without texts.
    assert not any("text" in line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line)


def test_distances_between_bounds_are_those_of_levenshtein(spark):
    import random

    from pyspark.sql import functions as F

    from maskwright.operators import metrics

    r = random.Random(6)
    words = ["".join(r.choices("aAbBÄä中 😀x", k=r.randint(0, 12))) for _ in range(400)]
    pairs = [(w, w.lower()) for w in words] + list(zip(words, words[1:])) + [("İI", "İI".lower()), ("ab", "ba"), ("", "")]
    table = spark.createDataFrame(pairs, "a string, b string")
    assert table.where(metrics.edit_distance(F.col("a"), F.col("b")) != F.levenshtein("a", "b")).count() == 0


def test_themes_come_with_the_lines(spark):
    assert "Join" not in plan(QUERIES["reading_errors"](spark, SMALL))


def test_only_boxes_in_conflict_are_chosen_among(spark):
    from maskwright.operators import graph

    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 9)], "early long, late long")
    assert sorted(r.node for r in graph.outdone(pairs).collect()) == [2, 9]


def test_boxes_cut_by_seams_are_shuffled_once_as_order_lines(spark, monkeypatch):
    from maskwright.operators import graph, seams

    told, whole = [], seams.once
    for module in (seams, graph):
        monkeypatch.setattr(module, "once", lambda df: told.append(plan(df)) or whole(df))
    told.append(plan(QUERIES["seamless_boxes"](spark, SMALL)))
    shuffles = [x for one in told for x in one.splitlines() if "Exchange" in x]
    assert len(shuffles) == 1 and "REPARTITION_BY_NUM" in shuffles[0]
    assert not any("Join" in one for one in told)


@pytest.mark.parametrize("name", ["text_under_masks", "anchored_names"])
def test_pages_are_dealt_once_over_all_tasks(spark, name, monkeypatch):
    from maskwright.operators import classify

    monkeypatch.setattr(classify, "once", lambda df: df)  # the plan as a whole
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SMALL))


def test_pages_of_masks_are_shuffled_by_nothing_else(spark):
    told = [x for x in plan(QUERIES["text_under_masks"](spark, SMALL)).splitlines() if "Exchange hashpartitioning" in x]
    assert told and all("REPARTITION_BY_NUM" in x for x in told)


def test_lines_are_read_for_anchors_once(spark, monkeypatch):
    from maskwright.operators import classify

    kept, whole = [], classify.once
    monkeypatch.setattr(classify, "once", lambda df: kept.append(df.columns) or whole(df))
    QUERIES["anchored_names"](spark, SMALL)
    assert len(kept) == 2 and "reach" in kept[1]


def test_spans_of_texts_that_have_the_mark(spark):
    from maskwright.functions import spans as S
    from pyspark.sql import functions as F

    texts = ["ab12c3", "12", "", "none", f"a{S.MARK}1 22", f"{S.MARK}", "😀7 é8", None]
    got = [r.x and [tuple(y) for y in r.x] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.find_spans(F.col("t"), "[0-9]+").alias("x")).orderBy("i").collect()]
    assert got == [[(2, 4, "12"), (5, 6, "3")], [(0, 2, "12")], [], [], [(2, 3, "1"), (4, 6, "22")], [], [(1, 2, "7"), (4, 5, "8")], None]


def test_text_under_a_turned_mask(spark):
    from pyspark.sql import functions as F

    from maskwright.operators import page

    glyphs = spark.createDataFrame([(1, 0, i, 10.0 * i, 5.0, c) for i, c in enumerate("abcde")] + [(1, 1, 0, 20.0, 9.0, None), (1, 2, 0, 20.0, 10.0, "z")], "page_id int, line_no int, i int, x double, y double, c string")
    quad = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((20.0, 0.0), (30.0, 5.0), (20.0, 10.0), (10.0, 5.0))])
    got = page.text_under(glyphs, spark.range(1).select(F.lit(1).alias("page_id"), F.lit(7).alias("id"), quad.alias("quad"))).collect()
    assert [tuple(r) for r in got] == [(1, 7, "bcd /  / z")]
