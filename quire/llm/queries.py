"""Queries of the training-text problems, each over its whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.leakage import find_leaks
from quire.llm.mixture import count_tokens, draw_mixture
from quire.llm.ocr_repair import repair_scans
from quire.llm.pii import redact_pii
from quire.llm.residue import fields_of, score_residue
from quire.llm.splitting import split_oversized
from quire.llm.truncation import score_truncation, truncation_rates
from quire.scratch import spread, stage, table


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")


def _summary_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = fields_of(spread(table(spark, sf_dir, "test_summaries").select("summary_id", "medical_summary", "billing_highlights"), "summary_id"), "test_summaries", "summary_id", ["medical_summary", "billing_highlights"])
    return flat.unionByName(fields_of(spread(table(spark, sf_dir, "summary_sections").select("section_id", "content"), "section_id"), "summary_sections", "section_id", ["content"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_residue(_summary_values(spark, sf_dir)).filter("is_residue").select("record_table", "record_id", "field_name")


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that may go into summaries: those with residue are kept out whole, also where only a part is residue
    (:func:`~quire.llm.residue.score_residue` has what is left of them)."""
    return score_residue(_summary_values(spark, sf_dir)).filter("not is_residue").select("record_table", "record_id", "field_name", "clean_text")


#: Tables with personal data: name, id and text column.
_PII_TABLES = (("ocr_chunks", "delivery_id", "text"), ("summary_results", "result_id", "summary_text"), ("evidence_spans", "span_key", "text_snippet"))


def _pii_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [spread(table(spark, sf_dir, t).select(k, c), k).select(F.lit(t).alias("record_table"), F.col(k).alias("record_id"), F.col(c).alias("text")) for t, k, c in _PII_TABLES]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = redact_pii(_pii_texts(spark, sf_dir), "text", ["record_table", "record_id"], with_text=False)
    return found.select("record_table", "record_id", F.explode("pii_types").alias("pii_type"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts with placeholders in place of personal information."""
    return redact_pii(_pii_texts(spark, sf_dir), "text", ["record_table", "record_id"])


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = spread(table(spark, sf_dir, "ocr_chunks").select("delivery_id", "text", "page_range"), "delivery_id").select(F.lit("ocr_chunks").alias("record_table"), F.col("delivery_id").alias("record_id"), "text", F.col("page_range.start").alias("first_page"))
    samples = spread(table(spark, sf_dir, "ocr_samples").select("sample_id", "text", "pages"), "sample_id").select(F.lit("ocr_samples").alias("record_table"), F.col("sample_id").alias("record_id"), "text", F.array_min(F.col("pages.page_number")).alias("first_page"))
    return chunks.unionByName(samples)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair_scans(_scans(spark, sf_dir), with_text=False)
    return found.select("record_table", "record_id", F.explode("noise_kinds").alias("noise_kind"))


def p5_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scanned texts in continuous paragraphs."""
    return repair_scans(_scans(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).filter("piece_no = 0").select("delivery_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every oversized chunk message."""
    return split_oversized(spread(table(spark, sf_dir, "ocr_chunks").select("delivery_id", "text", "page_range"), "delivery_id"), "delivery_id", "text", "page_range")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every affected document with the items leaked into it and how much of each."""
    return find_leaks(_documents(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def _mixture(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = count_tokens(_documents(spark, sf_dir), "text")
    return draw_mixture(stage(docs, "tokens"), table(spark, sf_dir, "source_targets"))


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return _mixture(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached, by source."""
    return _mixture(spark, sf_dir)[1]


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_truncation(_documents(spark, sf_dir)).filter("truncated").select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source delivers truncated texts."""
    return truncation_rates(score_truncation(_documents(spark, sf_dir)))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p4_found, p4_redacted, p5_found, p5_repaired, p6_found, p6_pieces, p7_found, p7_leaks, p8_selection, p8_shares, p9_found, p9_rates)}

ORACLE_SQL = {"p6_found": "select delivery_id from ocr_chunks where length(text) > 4000"}
