"""The corpus pipeline: language, repeated lines, near-duplicates, benchmark leaks, mix. Each stage works on all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from rosterlab.llm.common import table
from rosterlab.llm.decontaminate import without_leaks
from rosterlab.llm.language import identify
from rosterlab.llm.line_dedup import dedup_lines
from rosterlab.llm.mix import mix
from rosterlab.llm.simhash import keep_one
from rosterlab.session import shared_folder

LEAST_SCORE = 0.3  # a language named with less certainty is none


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without text or letters, and those no language claims, go. Learns from the rows' own labels."""
    named = identify(docs)
    return named.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("r.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of repeated three-line windows; n_chars follows the text."""
    done = dedup_lines(docs)
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("r.n_chars")).cast("long")}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("r")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken."""
    return mix(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mix", mix_sources),
]

#: SQL expresses neither the language models nor the fingerprints; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{folder}/{name}"
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
