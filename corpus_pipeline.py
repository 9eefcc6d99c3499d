"""The corpus pipeline: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.llm import common, decontamination, language, line_join, packing, similarity, token_file


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without a letter, or without a language of half their n-grams, go."""
    common.ship(spark)
    return language.identified(docs, language.fit(language.training_rows(docs)))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; a document that loses every line goes."""
    cut = line_join.without_repeated_lines(docs).where("NOT emptied")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return similarity.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    common.ship(spark)
    return packing.pack(docs, token_file.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = common.written(stage(spark, out, sf_dir), f"stage-{name}")
        if before is not None:
            common.discard(before)
        before = out
    return out


#: Tokens and mixture weights are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
