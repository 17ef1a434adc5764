"""The corpus pipeline: STAGES over ``documents``, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns of
their input; nulls, empty and repeated rows are treated as the stage's operator says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callgauge.llm import decontaminate, jaccard, language, line_dedup, packing
from callgauge.llm.common import prepared, table, written
from callgauge.llm.queries import vocabulary_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; text without a letter, or of no clear language, goes."""
    prepared(spark)
    return language.accepted(docs)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines that appear on many sites out of the texts; ``n_chars`` follows the text, no document goes."""
    prepared(spark)
    return line_dedup.cleaned_documents(docs)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep, of each group of documents with similar shingles, the one of the smallest id."""
    prepared(spark)
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    prepared(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize what is left and pack it into sequences."""
    prepared(spark)
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate_lines),
    ("jaccard_dedup", keep_one_of_similar),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

# A trained network and a tokenizer have no SQL form; tests/llm checks the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
