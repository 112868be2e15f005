"""Training corpus pipeline: each stage's result is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelens.llm.common import read, stage, tokenizer_path
from triagelens.llm.decontaminate import clean
from triagelens.llm.langid import predict, train
from triagelens.llm.packing import pack_documents
from triagelens.llm.simhash import first_of_each
from triagelens.llm.suffixes import without_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; null texts and texts without letters are rejected."""
    seen = predict(docs, train(docs), prefix="language_id_")
    return seen.where("language_id_lang_pred <> 'und'").select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose five-word shingles are 0.8 alike or more: SimHash partners, verified, then an exact check."""
    return first_of_each(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 100 bytes or more that also start earlier; texts that had nothing else go."""
    cut = without_repeats(docs)
    return cut.where("text is null or text <> ''")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of at most 2048."""
    return pack_documents(docs, tokenizer_path(), 1)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: Trained classifiers, hashes and a tokenizer can't be written in SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
