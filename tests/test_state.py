"""Histories, guarded replacement of a table and plans of pages."""

from pyspark.sql import functions as F

from maskwright.operators import merge
from maskwright.sources import ingest


def test_undo_and_redo_with_a_bounded_stack(spark):
    steps = [(1, i, "PUSH", f"s{i}") for i in range(60)] + [(1, 100, "UNDO", None), (1, 101, "UNDO", None), (1, 102, "REDO", None), (2, 1, "UNDO", None), (2, 2, "PUSH", "a"), (2, 3, "UNDO", None), (2, 4, "PUSH", "b"), (2, 5, "REDO", None)]
    table = spark.createDataFrame(steps, "page_id int, step int, op string, state string").repartition(3)
    got = {r.page_id: r.states for r in merge.undo_stack(table).collect()}
    assert got[2] == ["b"] and got[1] == [f"s{i}" for i in range(10, 59)]


def test_a_changed_table_is_not_replaced(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(5).write.parquet(path)
    seen = ingest.table_fingerprint(spark.read.parquet(path))
    spark.range(1, 6).write.mode("overwrite").parquet(path)  # as many rows, other values
    assert not ingest.write_if_unchanged(spark.range(9), path, seen)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 2, 3, 4, 5]
    assert ingest.write_if_unchanged(spark.range(9), path, ingest.table_fingerprint(spark.read.parquet(path)))
    assert spark.read.parquet(path).count() == 9 and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_line_numbers_of_long_turns_do_not_clash(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a\n" * 12000), (1, 2, "bot", "b\nc"), (2, 1, "user", None)], "conv_id int, turn int, role string, text string")
    lines = ingest.conversation_lines(turns)
    assert lines.where("page_id = 1").agg(F.count_distinct("line_no")).first()[0] == lines.where("page_id = 1").count() == 12003


def test_boxes_a_pixel_apart_join(spark):
    rows = [(1, "a", "EMAIL", "RULE", 0.9, True, 0.0, 4.0, 10.0, 14.0), (1, "b", "EMAIL", "RULE", 0.8, False, 11.0, 6.0, 20.0, 16.0), (1, "c", "EMAIL", "RULE", 0.7, True, 40.0, 6.0, 50.0, 16.0), (1, "f", "EMAIL", "FACE", 0.7, True, 12.0, 6.0, 50.0, 16.0)]
    table = spark.createDataFrame(rows, "page_id int, id string, kind string, source string, confidence double, enabled boolean, l double, t double, r double, b double")
    got = {r.id: (r.l, r.t, r.r, r.b, r.confidence, r.enabled) for r in merge.join_adjacent(table).collect()}
    assert got == {"a+b": (0, 4, 20, 16, 0.9, True), "c": (40, 6, 50, 16, 0.7, True), "f": (12, 6, 50, 16, 0.7, True)}
