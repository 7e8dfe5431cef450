import os

import pytest

from maskwright.llm import toxicity
from maskwright.llm.common import table
from maskwright.llm.queries import op10_toxicity

from .helpers import docs, empty

DATA = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int, text string, score double"


def area_under_curve(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.toxic for r in table(spark, DATA, "labels").where("toxic is not null").collect()}
    out = op10_toxicity(spark, DATA).collect()
    judged = [(r.score, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert area_under_curve(judged) >= 0.9


def test_rare_cases(spark):
    kind, rude = "a calm and friendly walk in the park", "you vile filthy scum get lost"
    texts = [kind, rude] * 40 + [None, "", "!!", rude + " now", kind + " now"]
    labels = spark.createDataFrame([(i, 1, i % 2, "clash", 0.0) for i in range(80)] + [(None, 1, 1, "", 0.0), (1, 1, 0, "", 0.0), (2, None, None, "", 0.0)], LABELS)
    got = {r.doc_id: r for r in toxicity.score(docs(spark, texts), labels).collect()}
    assert len(got) == len(texts) and got[83].score > got[84].score
    assert got[80].score == got[81].score == got[82].score
    one_class = toxicity.score(docs(spark, texts), labels.where("toxic = 0")).collect()
    assert {r.score for r in one_class} == {0.0}
    assert toxicity.score(empty(spark), labels).count() == 0
