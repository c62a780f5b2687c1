"""Whole-document composites: from pages or texts to a structured summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import mentions as N
from quire.functions import text as X
from quire.functions.redaction import mask_text
from quire.operators import chunks, evidence, pages, summaries
from quire.scratch import stage

_LISTS = ("key_points", "details", "care_plan", "diagnoses", "providers", "medications")
_LIMITS = {"key_points": 6, "details": 12, "care_plan": 8, "diagnoses": 12, "providers": 12, "medications": 12}


def summarise(
    docs: DataFrame, key: str, text: str, backend: Callable[[Column], Column] = summaries.extract_facts, target_chars: int = 2600, max_chars: int = 10_000, overlap_chars: int = 320, mask: bool = False
) -> DataFrame:
    """One row a document: key, chunks, overview, the merged lists, vitals and the summary in the fixed layout.

    Each window of the text goes through ``backend``, a function from a text to
    a struct like that of :func:`~quire.operators.summaries.extract_facts`; its
    lists are merged in order, without repeats and placeholders, each to its
    limit.  ``mask`` hides identifiers before the backend sees them.  Documents
    without text have no row; keys should be unique.
    """
    tidy = X.prepare_input(F.col(text))
    ready = docs.select(key, (mask_text(tidy) if mask else tidy).alias("_text")).filter("_text <> ''")
    parts = chunks.sliding_windows(ready, "_text", [key], target_chars, max_chars, overlap_chars)
    # read twice below, and the backend may be dear
    facts = stage(parts.select(key, "chunk_index", backend(F.col("text")).alias("f")).select(key, "chunk_index", "f.*"), "facts")
    lists = summaries.merge_lists(facts, key, ["chunk_index"], list(_LISTS), _LIMITS)
    first = facts.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.min_by("overview", "chunk_index").alias("overview"))
    whole = ready.select(key, X.vitals_sentence("_text").alias("vitals"), X.complaint_labels("_text").alias("_complaints"), N.signature_names("_text").alias("_signed"))
    joined = first.join(lists, key).join(whole, key)
    layout = summaries.fixed_layout(
        {
            "provider_seen": F.slice(F.concat("_signed", "providers"), 1, 1),
            "reason_for_visit": F.slice(F.array_distinct(F.concat(F.array("overview"), "key_points")), 1, 3),
            "clinical_findings": F.when(F.col("vitals").isNotNull(), F.concat("details", F.array("vitals"))).otherwise(F.col("details")),
            "treatment_follow_up_plan": F.col("care_plan"),
            "diagnoses": F.array_distinct(F.concat("diagnoses", "_complaints")),
            "healthcare_providers": F.array_distinct(F.concat("_signed", "providers")),
            "medications": F.col("medications"),
        },
        {"provider_seen": "Provider not documented.", "diagnoses": "No diagnoses documented.", "medications": "No medications or prescriptions recorded."},
    )
    return joined.select(key, "chunks", "overview", *_LISTS, "vitals", layout.alias("sections")).withColumn("summary", summaries.layout_text(F.col("sections")))


def routed(docs: DataFrame, key: str, text: str, page_count: str | None = None, requested: str = "auto", one_shot: Callable[[Column], Column] = summaries.extract_facts, chunked: Callable[[Column], Column] = summaries.extract_facts) -> DataFrame:
    """Documents summarised at once or window by window, as their figures ask for: the columns of :func:`summarise`, strategy and reason."""
    m = pages.routing_metrics(docs, [key, text], text, page_count).withColumn("_r", pages.summary_route(requested)).select(key, text, F.col("_r.strategy").alias("strategy"), F.col("_r.reason").alias("reason"))
    m = stage(m, "routes")
    whole = summarise(m.filter("strategy = 'one_shot'"), key, text, one_shot, target_chars=2_000_000, max_chars=2_000_001)
    parts = summarise(m.filter("strategy = 'chunked'"), key, text, chunked)
    return whole.unionByName(parts).join(m.select(key, "strategy", "reason"), key)


def contract(docs: DataFrame, sources: DataFrame, key: str, text: str, by: str | None = None) -> DataFrame:
    """Summaries as contracts: key, sections, claims and the notice why there are none.

    Sections come from the known headings, or are one section of the whole text;
    claims are matched to ``sources`` (key, source_no, page, text).  ``by`` names
    a column of ``docs`` that the sources have instead of ``key``, where several
    documents share their sources; it is a column of the result.
    """
    parts = F.col("_s")
    keys, of = ([key, by], [by]) if by else ([key], None)
    whole = F.array(F.struct(F.lit("summary").alias("slug"), F.lit("Summary").alias("title"), X.strip(F.col(text)).alias("content"), F.lit(1).alias("ordinal")))
    sectioned = docs.select(*keys, text).withColumn("_s", chunks.sections_of(text)).select(*keys, F.when(F.size(parts) > 0, parts).otherwise(whole).alias("sections"))
    if by:
        sectioned = stage(sectioned, "sections")  # read four times below
    flat = sectioned.select(*keys, F.inline("sections")).withColumn("kind", F.lit("mcc"))
    found = evidence.claims(evidence.statements(flat, keys), sources, [key], by=of)
    if by:
        found = stage(found, "claims")
    gathered = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("claim_no", "claim_id", "span_id", "title", "statement", "page", "snippet", "confidence"))).alias("claims"))
    notice = evidence.claims_notice(docs, sources, found, [key], of)
    return sectioned.join(gathered, key, "left").join(notice, key, "left")
