"""From raw documents to packed training sequences: one stage for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm import line_crf, mixing, packing, rules, simhash
from tapewatch.llm.common import keep, table
from tapewatch.llm.queries import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF predicts to be good (score of 0.3 or more)."""
    model = line_crf.fit_model(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return line_crf.filter_documents(docs, model)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the base rules and their group's adaptive limits."""
    return rules.filter_documents(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every near-duplicate class; further rows with its id go."""
    return simhash.first_of_each_class(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source repeated at its target rate, in a global random order."""
    return mixing.poisson_mix(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("quality rules", rules_stage),
    ("simhash near-dedup", simhash_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]
#: The CRF, the fingerprints and the tokenizer can't be expressed in SQL; tests/llm compares with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
