"""From raw documents to token id files: quality, near duplicates, benchmark leaks, mixing, output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trigwatch.llm.common import Scratch, shared_folder, table
from trigwatch.llm.decontaminate import clean
from trigwatch.llm.jaccard import one_per_group
from trigwatch.llm.labelled import remainder
from trigwatch.llm.mixing import mixed
from trigwatch.llm.quality import fit_quality, good_only
from trigwatch.llm.tokens import read_ids, tokenizer_file, write_ids


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects. It is fitted on the labelled rows of
    its own input that the held-out fold does not contain."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return good_only(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares its shingles of five words to 0.8 or more."""
    return one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As often as the mix takes each document, the last one of a source up to the cut."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Written as token id files and read back: a row per document."""
    return read_ids(write_ids(docs, shared_folder(spark, "ids"), tokenizer_file()))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each but the last is stored before the next reads it, and removed
    when the next one is stored (the last one stores its files before it returns)."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        work = Scratch(spark, name)
        docs = work.stored(stage(spark, docs, sf_dir), name)
        if before:
            before.clear()
        before = work
    out = STAGES[-1][1](spark, docs, sf_dir)
    before.clear()
    return out
