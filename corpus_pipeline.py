"""Documents to packed training sequences: toxicity, line dedup, near dedup, decontamination, packing.

Every stage works on all that the one before kept. All but the last return the columns of documents; the last
returns a row for each piece of a document in a sequence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.common import TOKENIZER_FILE, staged, table
from terraloom.llm.decontaminate import decontaminated
from terraloom.llm.lines import pruned
from terraloom.llm.packing import packed
from terraloom.llm.shingles import one_of_each
from terraloom.llm.tokens import tokenizer_path
from terraloom.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the span tagger, trained on a bounded sample of the labelled texts, scores below its threshold."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated three-line passages removed but for their first occurrence; n_chars follows the text."""
    out = pruned(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8), that of the least doc_id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 ids and of shorter tiers."""
    return packed(docs, tokenizer_path(TOKENIZER_FILE), 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing),
]
ORACLE_SQL = None  # a trained tagger and XXH64 are beyond SQL; tests hold every stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
