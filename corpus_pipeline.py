"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing to target weights, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm._util import finished, table
from leafmill.llm.line_dedup import drop_frequent_lines
from leafmill.llm.mixing import take_mix
from leafmill.llm.quality_gbt import keep_good
from leafmill.llm.queries import MIX_WEIGHTS, domain_of
from leafmill.llm.sentencepiece_scan import encode
from leafmill.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_frequent_lines(docs, min_docs=10, min_chars=1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs, {"domain": domain_of(), "lang": F.col("lang"), "source": F.col("source")}, MIX_WEIGHTS, share=1.0, max_epochs=2)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids, and the digest of the text that they decode to."""
    return encode(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("simhash near-dedup", near_dedup), ("mixing", mixing), ("sentencepiece", tokens)]

#: Trees, XXH64 fingerprints and BPE are not SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = finished(lambda f=apply, d=docs: f(spark, d, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
