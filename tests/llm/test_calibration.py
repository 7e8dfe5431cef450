from maskwright.llm import kneser_ney as kn
from maskwright.llm import language_id, toxicity

from .helpers import docs


def test_rows_set_apart_are_few_and_the_same_each_time(spark):
    rows = spark.range(200_000).selectExpr("id AS doc_id", "'x' AS text")
    apart = kn.set_apart(200_000, 20_000, 0.25, "doc_id", "text")
    first = rows.where(apart)
    assert 19_000 < first.count() < 21_000
    assert first.exceptAll(rows.repartition(7).where(apart)).isEmpty()
    few = rows.where(kn.set_apart(40_000, 20_000, 0.25, "doc_id", "text"))
    assert 49_000 < few.count() < 51_000  # the share bounds it where the corpus is small


def test_rows_that_are_not_for_calibration_are_counted(spark, monkeypatch):
    counted = []
    count = kn.ngram_counts

    def spy(rows, order):
        counted.append(rows.count())
        return count(rows, order)

    monkeypatch.setattr(kn, "ngram_counts", spy)
    for module in (toxicity, language_id):
        monkeypatch.setattr(module, "CALIBRATION_ROWS", 4)
    texts = [f"{'a calm walk' if i % 2 else 'vile filthy scum'} {i}" for i in range(200)]
    table = docs(spark, texts)
    toxicity.score(table, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    language_id.identify(table)
    assert all(n >= 185 for n in counted) and len(counted) == 2  # a fixed quarter would leave 150
