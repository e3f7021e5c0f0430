"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows to the
shared folder and reads them back before the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import mixing
from quarry.llm.common import materialize, plain, table
from quarry.llm.decontaminate import decontaminate_rows
from quarry.llm.jaccard_join import jaccard_rows
from quarry.llm.mixing import mix_rows, repeated
from quarry.llm.quality import classify_rows
from quarry.llm.token_files import token_output

#: Shares of clean, low and toxic documents in the mix: those of the operator, whatever the filters left of each.
TARGETS = mixing.TARGETS


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return plain(classify_rows(docs, table(spark, sf_dir, "labels")).where("predicted = 1"), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of the Jaccard join: one with the least id."""
    return plain(jaccard_rows(docs).where("kept"), docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return plain(decontaminate_rows(docs, table(spark, sf_dir, "benchmark")).where("NOT contaminated"), docs)


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate, rounded by a hash of the document, says."""
    kept = mix_rows(docs, table(spark, sf_dir, "labels"), TARGETS).where("copies > 0")
    return plain(repeated(kept, "copies"), docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    return token_output(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", one_of_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing to target weights", mix_to_targets),
    ("token-id output", write_tokens),
]

#: The stages' models and tokenizer are beyond SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
