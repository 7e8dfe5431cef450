import os

import pytest

import corpus_pipeline
from maskwright.llm import quality_rules
from maskwright.llm.common import table

from . import test_line_dedup, test_simhash
from .test_decontaminate import brute as hits_of

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_stages_against_brute_force(spark):
    docs = table(spark, DATA, "documents")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    kept = {r.doc_id for r in quality_rules.rules(docs, table(spark, DATA, "labels")).where("kept").collect()}
    rows = sorted((r for r in docs.collect() if r.doc_id in kept), key=lambda r: r.doc_id)
    texts = [t for *_, t in test_line_dedup.brute([r.text for r in rows], 10)]
    ids = [r.doc_id for r in rows]
    prints = [test_simhash.brute_print(t) for t in texts]
    groups = test_simhash.brute_components(ids, prints)
    rows = [(i, t) for i, t, c in zip(ids, texts, groups) if i == c]
    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    found = hits_of([t for _, t in rows], items)
    clean = {i: t for (i, t), (n, hit, _) in zip(rows, found) if not (hit and 20 * hit >= n)}
    assert set(out) <= set(clean) and all(r.text == clean[i] and r.n_chars == len(r.text) and 1 <= r.repeats <= 3 for i, r in out.items())
    total = sum(len(t.split()) for t in clean.values())
    taken = sum(len(r.text.split()) * r.repeats for r in out.values())
    assert abs(taken - total) <= 0.1 * total


def test_rare_cases(spark, tmp_path):
    """Nulls, repeated rows, no ids, a column with a stage's own name, and an empty benchmark; then no rows at all."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text, "en", "a", 1, "x"), (1, text, "en", "a", 1, "x"), (None, text + " more", None, None, None, "y"), (2, None, "en", "a", 0, None), (3, "", "en", None, 0, "z")]
    rows += [(None, " ".join(f"v{i}" for i in range(90)), "de", "b", 5, "k")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string"
    for name, docs in (("some", rows), ("none", [])):
        folder = tmp_path / name
        spark.createDataFrame(docs, schema).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "some" / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "some"))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    # One of the copies; fingerprints more than two bits apart aren't linked.
    assert sorted(r.kept for r in docs.collect()) == ["k", "x", "y"]
    assert corpus_pipeline.run(spark, str(tmp_path / "some")).count() <= 3
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
