import os

import pytest

from maskwright.llm import language_id
from maskwright.llm.common import table
from maskwright.llm.queries import op8_language_id

from .helpers import docs, empty

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_held_out_accuracy(spark):
    truth = {r.doc_id: (r.lang, r.text) for r in table(spark, DATA, "documents").select("doc_id", "lang", "text").collect()}
    out = op8_language_id(spark, DATA).collect()
    assert len(out) == len(truth)
    judged = [r for r in out if r.held_out and truth[r.doc_id][0] is not None and len((truth[r.doc_id][1] or "").split()) >= 5]
    assert len(judged) > 100
    assert sum(r.lang_pred == truth[r.doc_id][0] for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in out)


def test_texts_without_letters_are_undetermined(spark):
    texts = ["the house and the garden"] * 30 + ["das haus und der garten"] * 30 + [None, "", "12 34 !?", "der garten", "the house", "the garden " * 5000]
    langs = ["en"] * 30 + ["de"] * 30 + ["en", "de", None, None, None, None]
    got = {r.doc_id: r for r in language_id.identify(docs(spark, texts, langs=langs)).collect()}
    assert [got[i].lang_pred for i in range(60, 66)] == ["und", "und", "und", "de", "en", "en"]
    assert all(got[i].score == 0 and got[i].rejected for i in (60, 61, 62))


def test_nothing_learned_and_empty_table(spark):
    assert [r.lang_pred for r in language_id.identify(docs(spark, ["a b", None], langs=[None, None])).collect()] == ["und", "und"]
    assert language_id.identify(empty(spark)).count() == 0
