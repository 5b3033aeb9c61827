"""A corpus pipeline: STAGES in order, each over what the one before it kept.

Quality rules reject documents, aligned repeated blocks go from later documents, one document of each group of near
copies (five-word Jaccard similarity 0.8 or more) stays, sources are replicated to their target weights, and the rest
is packed into sequences. Every stage is written as Parquet in the shared folder and read again.

All stages but the last return the columns of ``docs``, whatever they are besides doc_id, text and source. An empty
table stays empty in each; null texts and ids have the results that each stage names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ferrule.llm.common import Workspace
from ferrule.llm.linededup import drop_repeated_lines
from ferrule.llm.mixing import mix_sources
from ferrule.llm.nearcopies import keep_one
from ferrule.llm.packing import pack_documents, tokenizer_path
from ferrule.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules and their host's verdict keep. Null and empty texts have no words and go; a null source is never judged as a host."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the blocks that an earlier one has; one left without a word goes. Null texts stay as they are."""
    return drop_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least doc_id, then of the least text hash. Different texts under one doc_id are different documents; a null doc_id comes last; null and empty texts are one group."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate and its hash say, shuffled. Columns that happen to be named like the operator's own are kept as they were."""
    return mix_sources(docs).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. A null or empty text has the end id alone; copies and repeated rows are packed each for itself."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]
#: SQL has neither patience diff nor the packing's tokenizer; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
