"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the
last return the columns of ``documents``.

Defined cases, for every stage: null and empty texts have no words, so they are clean, near-duplicates
of each other, and fill no budget; null ids, languages and sources stay as they are; of rows tied in
a group of near-duplicates, the least doc_id stays, among rows with that id one of them; repeated
rows are judged alike; an empty table passes through; columns beside those of ``documents`` pass
through all stages but the last, under any name, also one that a stage uses inside.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, mixing, simhash, token_files, toxicity
from quire.llm.common import staged, table
from quire.llm.queries import tokenizer_path


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Labels of the table mark what it learns from."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with eight words in a row of a benchmark item, or with two shorter items, go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their weights; a document taken twice is there twice."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files are written, and their digests are read back."""
    return token_files.token_output(docs, tokenizer_path())


STAGES = [("toxicity", toxic), ("near duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix), ("tokens", tokens)]

#: SQL cannot express the classifier, XXH64 fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each keeps is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), "kept")
    return STAGES[-1][1](spark, docs, sf_dir)
