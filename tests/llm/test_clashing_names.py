"""Columns named like the helpers of the operators are kept as they are."""

from pyspark.sql import functions as F

from maskwright.llm import decontaminate, line_dedup, quality_rules, simhash

from .helpers import docs, mixed

NAMES = ("_h", "_key", "_keys", "_own_id", "_own_text", "_words", "_lines", "_row", "_id", "_text", "_n", "_bh", "_c", "_s")


def table(spark):
    texts = mixed(3)
    texts[-1] = " ".join(f"w{i}" for i in range(300))
    return docs(spark, texts).select("doc_id", "text", "lang", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in NAMES])


def whole(out):
    rows = out.collect()
    assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in NAMES)
    return {r.doc_id for r in rows}


def test_clashing_columns_come_back(spark):
    own = table(spark)
    n = own.count()
    assert 0 < len(whole(simhash.one_of_each(own))) < n
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100, 160)))], "item_id long, text string")
    assert whole(decontaminate.clean_rows(own, bench)) == set(range(n - 1))
    for kind in ("none", "first"):
        for most in (0, 1000):
            assert len(whole(line_dedup.drop_lines(own, 3, 1, kind, most))) == n
    assert len(whole(quality_rules.with_counts(own))) == n
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert whole(quality_rules.filter_rows(own, labels))


def test_a_shared_folder_is_wanted_off_local_masters():
    import pytest

    from maskwright.llm.common import shared_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
