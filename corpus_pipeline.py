"""A training corpus in five stages: each works on all rows that the stage before kept.

Every stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet in the shared folder and read
again as the next one's docs. All but the last return the columns of ``documents``.

The toxicity model is fitted on labelled rows of the stage's own documents; of each near-duplicate group (similarity 0.8
or more over five words) the row with the smallest doc_id stays; documents that leak a benchmark item go; mixing samples towards the target shares; the last
stage writes token files and returns one row per document read back from them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilake.llm.common import stash, table
from vigilake.llm.decontamination import without_leaks
from vigilake.llm.mixing import sampled
from vigilake.llm.near_dedup import GENERAL_PERCENT, survivors
from vigilake.llm.token_files import default_vocabulary, token_output
from vigilake.llm.toxicity import fit_from, without_toxic
from vigilake.session import new_scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return without_toxic(docs, fit_from(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return survivors(docs, GENERAL_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target shares of source, language and topic."""
    return sampled(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read back from the token files."""
    return token_output(docs, new_scratch_path(spark, "tokens"), default_vocabulary())


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_files", token_files),
]

#: No SQL for compression distances, signatures and token ids; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
