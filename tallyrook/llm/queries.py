"""The queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import crf_quality, decontaminate, embedding_pairs, jaccard, line_templates, mixing_lm, packing, periodic, preference, tokenize, turn_repair, unit_dedup, warc
from .common import table
from .oracles import ORACLES  # noqa: F401

BPE_FILE = "byte_bpe_50k.json"
#: Words of repeating units side by side that op6 takes out; shorter repeats are lines that many documents share.
MIN_PASSAGE = 20


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.format_pairs(preference.neighbours(table(spark, sf_dir, "conversations")))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return crf_quality.assess(docs, crf_quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op5_mixing_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_lm.score(table(spark, sf_dir, "documents"))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), report="removed", min_passage=MIN_PASSAGE)


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_templates(table(spark, sf_dir, "documents").select("doc_id", "text"), report="dropped_lines")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pairs.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.report_damaged(table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents").select("doc_id", periodic.looped().alias("text")))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4's operator counts of each text, without a model's verdict, which SQL can't give."""
    judged = crf_quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text"), crf_quality.Model.plain())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_preference": op2_preference,
    "op3_bpe": op3_bpe,
    "op4_crf_quality": op4_crf_quality,
    "op5_mixing_lm": op5_mixing_lm,
    "op6_unit_dedup": op6_unit_dedup,
    "op7_line_templates": op7_line_templates,
    "op8_embeddings": op8_embeddings,
    "op9_packing": op9_packing,
    "op10_jaccard": op10_jaccard,
    "op11_turn_repair": op11_turn_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_decontaminate": op13_decontaminate,
    "quality_counts": quality_counts,
}
