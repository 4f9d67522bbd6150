"""A training corpus in five stages, each one operator over all that the stage before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of
``documents``, and a stage over very many small partitions hands on fewer.

Defined cases, for all stages: an empty table gives an empty one; columns beyond
those of ``documents`` are carried along, whatever their names; rows with a null
id are judged by their text like all others; texts of any length are read whole;
ties go to the smaller id. What a null, empty or repeated text comes to is said
at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import decontaminate, jaccard_join, language, packing, pii
from quillstream.llm.common import compact, forget, small_batches, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by compression; those that are rejected go.

    Null and empty texts and those without a letter are rejected; repeated rows
    are judged alike, so all stay or all go."""
    small_batches(spark)
    return compact(language.keep_identified(docs, language.learn(docs)), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links, that of the least id.

    Texts without a word, null ones among them, link to nothing and stay; of
    repeated rows one stays."""
    small_batches(spark)
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly such go.

    Null and empty texts stay as they are; repeated rows are cut alike; an empty
    benchmark changes nothing."""
    small_batches(spark)
    return compact(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes placeholders; no row goes.

    Null and empty texts stay as they are; repeated rows become alike."""
    small_batches(spark)
    return compact(pii.redact(docs), docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces and their places in sequences of permitted lengths.

    A null or empty text is one end mark; repeated rows are packed one by one."""
    small_batches(spark)
    return packing.pack(packing.token_counts(docs), expected=packing.expected_pieces(docs))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit),
]

#: Compression sizes, automata and packing are beyond SQL; tests/llm hold the
#: stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
