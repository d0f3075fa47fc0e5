"""A corpus from documents to packed training sequences, in stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.llm import crf_quality, jaccard, line_templates, packing, unit_dedup
from tallyrook.llm.common import table, written
from tallyrook.llm.queries import MIN_PASSAGE


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Only documents that pass: at least 20 words, few repeats, mostly content lines. The
    classifier is fitted on the labelled documents among this stage's own."""
    model = crf_quality.fit(docs, table(spark, sf_dir, "labels"))
    judged = crf_quality.assess(docs, model, prefix="__quality_")
    return judged.where("__quality_kept").select(*(F.col(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that an earlier document has."""
    return _sized(line_templates.drop_templates(docs))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id. Documents without
    words or id belong to no group; rows that share an id are one document."""
    groups = jaccard.near_groups(docs.select("doc_id", "text"))
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*(F.col(c) for c in docs.columns))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines, sentences and paragraphs that occur earlier, where those
    side by side make up MIN_PASSAGE words or more."""
    return _sized(unit_dedup.drop_repeats(docs, min_passage=MIN_PASSAGE))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences with their token ids, one row for each piece of a document."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", jaccard_join), ("substring dedup", substring_dedup), ("packing", pack_sequences)]
#: The stages hold a trained model and a tokenizer, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
