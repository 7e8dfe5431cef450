"""A corpus pipeline of five stages; each reads what the one before it wrote.

Quality rules, line dedup, SimHash near-dedup and benchmark decontamination return the columns of documents; mixing
returns the rows that the mix takes, with `repeats`: how often each is taken.

Cases: null and empty texts fail the base rule of the first stage; rows without a doc_id have no label and are judged like
others; repeated rows are copies of each other, of which the third stage keeps one; very long texts are read whole; an empty
table gives no rows, an empty benchmark removes none; extra columns, also with names that a stage uses for itself, come
through all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, line_dedup, mixing, quality_rules, simhash
from maskwright.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.filter_rows(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(docs, min_docs=10, min_chars=1)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash", near_duplicates), ("decontamination", benchmark), ("mixing", mix)]

#: The quality rules' cutoffs come from exact binomial bounds, which DuckDB's SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
