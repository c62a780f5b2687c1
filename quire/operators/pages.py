"""Pages of documents: metrics, routing and the choice of pages worth reading."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import lexicons as L
from quire.functions import text as X


#: What names a page of a visit (fixed values).
VISIT_PAGES = ("established patient visit", "new patient visit")


def native_metrics(pages: DataFrame, doc: list[str], text: str = "text", extractor_available: bool = True) -> DataFrame:
    """Per document: page_count, non_empty_pages, their ratio, total_chars, avg_chars_per_page,
    short_page_ratio (under 80 characters), alpha_ratio, and route and requires_ocr decided from them.

    pages: one row a page; null texts count as empty pages.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    size = F.length(X.strip(t))
    per_page = pages.select(*doc, size.alias("_n"), X.letters(t).alias("_a"), X.non_space(t).alias("_s"))
    out = per_page.groupBy(*doc).agg(
        F.count(F.lit(1)).cast("int").alias("page_count"),
        F.count_if(F.col("_n") > 0).cast("int").alias("non_empty_pages"),
        F.sum("_n").cast("int").alias("total_chars"),
        F.round(F.sum("_n") / F.count(F.lit(1)), 1).alias("avg_chars_per_page"),
        F.round(F.count_if(F.col("_n") < 80) / F.count(F.lit(1)), 3).alias("short_page_ratio"),
        F.round(F.sum("_a") / F.greatest(F.sum("_s"), F.lit(1)), 3).alias("alpha_ratio"),
    )
    out = out.withColumn("non_empty_page_ratio", F.round(F.col("non_empty_pages") / F.col("page_count"), 3))
    return out.withColumn("route", native_route(extractor_available)).withColumn("requires_ocr", F.col("route") != "native_text_sufficient")


def native_route(extractor_available: bool = True, min_chars: int = 200, min_page_ratio: float = 0.5, min_avg_chars: float = 80.0, min_alpha: float = 0.55, max_short: float = 0.8) -> Column:
    """Whether native text will do, from the columns of :func:`native_metrics`; the first rule that holds decides."""
    if not extractor_available:
        return F.lit("native_text_extractor_unavailable")
    return (
        F.when((F.col("total_chars") < min_chars) | (F.col("non_empty_pages") <= 0), "scan_or_image_only")
        .when(F.col("non_empty_page_ratio") < min_page_ratio, "scan_or_image_only")
        .when((F.col("avg_chars_per_page") < min_avg_chars) | (F.col("alpha_ratio") < min_alpha) | (F.col("short_page_ratio") > max_short), "native_text_low_confidence")
        .otherwise("native_text_sufficient")
    )


def routing_metrics(df: DataFrame, keep: list[str], text: str = "text", page_count: str | Column | None = None, max_noise: float = 0.35, max_short: float = 0.45) -> DataFrame:
    """Per document the figures that routing looks at.

    Columns: estimated_tokens, page_count, line_count, noise_line_count,
    noise_ratio, short_line_ratio, alpha_ratio, repeated_metadata_markers,
    mixed_packet_signals, average_words_per_line, quality_ok.  A document of
    four lines or fewer is judged by its sentences.  Null texts count as empty.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    pages = F.lit(0) if page_count is None else (F.col(page_count) if isinstance(page_count, str) else page_count)
    full = F.filter(F.transform(X.lines(t), X.strip), lambda x: x != "")
    judged = X.let(full, lambda f: F.when(F.size(f) <= 4, F.flatten(F.transform(f, X.sentences))).otherwise(f))
    rows = df.select(*keep, t.alias("_t"), F.coalesce(pages, F.lit(0)).cast("int").alias("page_count"), judged.alias("_l"))
    # of each line once: whether it is noise, and its words (lines are stripped and not empty)
    noisy = lambda x: x.rlike(L.CONSENT_LINE) | x.rlike(L.REASON_ONLY_LINE) | X.is_vitals_table(x) | X.has_legal_phrase(x)
    seen = F.transform("_l", lambda x: F.struct(noisy(x).alias("noise"), (F.regexp_count(x, F.lit(r"\s+")) + 1).alias("words")))
    sums = F.aggregate(
        seen,
        F.struct(F.lit(0).alias("noise"), F.lit(0).alias("short"), F.lit(0).alias("words")),
        lambda a, x: F.struct((a.noise + x.noise.cast("int")).alias("noise"), (a.short + (x.words <= 2).cast("int")).alias("short"), (a.words + x.words).alias("words")),
    )
    low = F.lower("_t")
    joined = F.array_join("_l", " ")
    rows = rows.select(
        *keep,
        "page_count",
        X.tokens_words("_t").alias("estimated_tokens"),
        F.size("_l").alias("line_count"),
        sums.alias("_s"),
        F.round(X.let(joined, lambda j: X.letters(j) / F.greatest(X.non_space(j), F.lit(1))), 3).alias("alpha_ratio"),
        F.regexp_count("_t", F.lit(L.REPEATED_MARKERS)).alias("repeated_metadata_markers"),
        X.occurrences(low, ("reason for visit:",)).alias("_visits"),
        X.occurrences(low, ("patient name:",)).alias("_names"),
    )
    least = F.greatest("line_count", F.lit(1))
    rows = rows.select(
        *keep,
        "page_count",
        "estimated_tokens",
        "line_count",
        F.col("_s.noise").alias("noise_line_count"),
        F.round(F.col("_s.noise") / least, 3).alias("noise_ratio"),
        F.round(F.col("_s.short") / least, 3).alias("short_line_ratio"),
        "alpha_ratio",
        F.round(F.col("_s.words") / least, 2).alias("average_words_per_line"),
        "repeated_metadata_markers",
        (
            ((F.col("repeated_metadata_markers") >= 6) & (F.col("page_count") >= 3)).cast("int")
            + (F.col("_visits") >= F.greatest(F.lit(3), F.col("page_count") + 1)).cast("int")
            + (F.col("_names") >= F.greatest(F.lit(2), F.col("page_count"))).cast("int")
        ).alias("mixed_packet_signals"),
    )
    ok = (F.col("line_count") > 0) & (F.col("noise_ratio") <= max_noise) & (F.col("short_line_ratio") <= max_short) & (F.col("alpha_ratio") >= 0.55) & (F.col("mixed_packet_signals") == 0)
    return rows.withColumn("quality_ok", ok)


def summary_route(requested: str = "auto", token_threshold: int = 120_000, max_pages: int = 80) -> Column:
    """struct<strategy, reason> from the columns of :func:`routing_metrics`; the first rule that holds decides."""
    make = lambda s, r: F.struct(F.lit(s).alias("strategy"), F.lit(r).alias("reason"))
    if requested in ("chunked", "one_shot"):
        return make(requested, f"strategy_forced_{requested}")
    return (
        F.when(F.col("estimated_tokens") > token_threshold, make("chunked", "estimated_tokens_exceed_operational_threshold"))
        .when(F.col("page_count") > max_pages, make("chunked", "page_count_exceeds_operational_threshold"))
        .when(F.col("mixed_packet_signals") > 0, make("chunked", "mixed_packet_signals_detected"))
        .when(~F.col("quality_ok"), make("chunked", "ocr_quality_requires_chunk_fallback"))
        .otherwise(make("one_shot", "within_operational_threshold_and_quality_budget"))
    )


def page_reason(text: str | Column, min_words: int = 40) -> Column:
    """Why a page isn't worth reading, null if it is: the first rule that holds, duplicates apart."""
    given = F.coalesce(X._col(text), F.lit(""))
    both = F.struct(given.alias("t"), F.lower(given).alias("low"))

    def rules(p: Column) -> Column:
        t, low = p["t"], p["low"]
        pair = reduce(lambda a, b: a | b, [low.contains(x) & low.contains(y) for x, y in L.PAGE_ADMIN_PAIRS])
        counts = F.struct(
            X.occurrences(low, L.PAGE_CLINICAL).alias("clinical"),
            X.occurrences(low, L.PAGE_ADMIN).alias("admin"),
            X.occurrences(low, L.PAGE_METADATA).alias("metadata"),
            X.contains_any(low, VISIT_PAGES).alias("visit"),
        )
        return (
            F.when(t == "", "empty")
            .when(F.regexp_count(low, F.lit(X.WORD)) < min_words, "too_short")
            .when(X.contains_any(low, L.PAGE_HARD_REJECT), "hard_reject")
            .when(pair, "workflow_admin")
            .otherwise(X.let(counts, lambda c: by_counts(t, low, c)))
        )

    def by_counts(t: Column, low: Column, c: Column) -> Column:
        numeric = X.let(F.greatest(X.non_space(t), F.lit(1)), lambda n: (X.digits(t) / n >= 0.14) & (X.letters(t) / n <= 0.78))
        return (
            F.when(c.admin >= c.clinical + 2, "admin_dominant")
            .when((c.metadata >= 4) & (c.clinical < 4), "metadata_dominant")
            .when(~c.visit & (c.clinical < 8) & (X.phrases_present(low, L.PAGE_HEADER_NOISE) >= 2), "header_noise")
            .when(~c.visit & (c.clinical < 12) & numeric, "numeric_noise")
            .when(~(c.visit | (c.clinical >= 3) | (low.contains("medication") & (c.admin == 0))), "low_signal")
        )

    return X.let(both, rules)


def is_visit_page(text: str | Column) -> Column:
    return X.contains_any(F.lower(X._col(text)), VISIT_PAGES)


def greedy_duplicates(signatures: list[list[str] | None], visits: list[bool], limit: float = 0.78, visit_limit: float = 0.60) -> list[bool]:
    """Which pages repeat an earlier kept page of their kind (Jaccard of their words)."""
    kept: list[tuple[bool, set[str]]] = []
    out = []
    for words, visit in zip(signatures, visits):
        own = set(words) if words is not None else None
        if own is None:
            out.append(False)
            continue
        near = max((len(own & s) / len(own | s) for v, s in kept if v == visit and own and s), default=0.0)
        out.append(near >= (visit_limit if visit else limit))
        if not out[-1]:
            kept.append((visit, own))
    return out


def select_pages(pages: DataFrame, doc: list[str], page_number: str, text: str = "text", min_words: int = 40) -> DataFrame:
    """Every page with its reason for rejection and whether it is selected.

    Columns: ``doc``, ``page_number``, reason (null if worth reading; "duplicate"
    for pages that repeat an earlier one), applied, selected.  The choice is
    applied to a document only if it keeps some pages but not all, and at least
    200 characters and a quarter of the text; else all pages with text are
    selected.  Whether a page repeats another depends on those kept before it,
    so that part folds over one document's word sets; everything else is an
    expression.  Documents are grouped by key; a document's pages are one group.
    """
    t = X.clean_paragraphs(F.coalesce(F.col(text), F.lit("")))
    rows = pages.select(*doc, F.col(page_number), t.alias("_t"))
    rows = rows.select(*doc, page_number, F.length("_t").alias("_n"), page_reason("_t", min_words).alias("reason"), is_visit_page("_t").alias("_visit"), X.page_signature("_t").alias("_words"))
    rows = rows.withColumn("_words", F.when(F.col("reason").isNull(), F.col("_words")))

    @F.pandas_udf("array<boolean>")
    def duplicates(column: pd.Series) -> pd.Series:
        return pd.Series([greedy_duplicates([None if p["_words"] is None else list(p["_words"]) for p in ps], [bool(p["_visit"]) for p in ps]) for ps in column])

    grouped = rows.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct(page_number, "_n", "reason", "_visit", "_words"))).alias("_p"))
    marked = grouped.withColumn("_d", duplicates("_p"))
    flat = marked.select(*doc, F.explode(F.arrays_zip("_p", "_d")).alias("z")).select(*doc, f"z._p.{page_number}", "z._p._n", F.when(F.col("z._d"), "duplicate").otherwise(F.col("z._p.reason")).alias("reason"))
    w = Window.partitionBy(*doc)
    good = F.col("reason").isNull()
    kept, chars = F.sum(good.cast("int")).over(w), F.sum(F.when(good, F.col("_n")).otherwise(0)).over(w)
    source = F.sum("_n").over(w)
    applied = (kept > 0) & (kept < F.count(F.lit(1)).over(w)) & (chars >= F.greatest(F.lit(200), F.floor(source * 0.25)))
    return flat.withColumn("applied", applied).select(*doc, page_number, "reason", "applied", F.when(F.col("applied"), good).otherwise(F.col("_n") > 0).alias("selected"))


def selection_report(selected: DataFrame, doc: list[str]) -> DataFrame:
    """Counts of the reasons of :func:`select_pages` by document."""
    admin = F.col("reason").isin("admin_dominant", "workflow_admin", "metadata_dominant", "header_noise", "numeric_noise")
    return selected.groupBy(*doc).agg(
        F.bool_or("applied").alias("applied"),
        F.count(F.lit(1)).alias("source_pages"),
        F.count_if(F.col("selected")).alias("selected_pages"),
        F.count_if(~F.col("selected")).alias("dropped_pages"),
        F.count_if(F.col("reason") == "duplicate").alias("duplicate_pages"),
        F.count_if(F.col("reason") == "hard_reject").alias("hard_reject_pages"),
        F.count_if(admin).alias("admin_reject_pages"),
        F.count_if(F.col("reason") == "low_signal").alias("low_signal_pages"),
    )


def rebased_pages(shards: DataFrame, doc: list[str], shard: str, text: str, separator: str = "\n\n") -> DataFrame:
    """Offsets at which shards start in the document they make together: ``doc``, ``shard``, text_offset, page_offset.

    Needs a ``page_count`` column; null texts are empty.
    """
    w = Window.partitionBy(*doc).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    return shards.select(
        *doc,
        shard,
        F.coalesce(F.sum(F.length(F.coalesce(F.col(text), F.lit(""))) + len(separator)).over(w), F.lit(0)).alias("text_offset"),
        F.coalesce(F.sum(F.coalesce("page_count", F.lit(0))).over(w), F.lit(0)).alias("page_offset"),
    )


def page_parts(page: Column) -> Column:
    """Text of a page struct: its paragraphs, else lines, else blocks, else its text, whichever comes first with content."""
    return F.coalesce(*(F.nullif(F.array_join(page[k], "\n"), F.lit("")) for k in ("paragraphs", "lines", "blocks")), page["text"])


def structure_metrics(pages: DataFrame, doc: list[str], text: str = "text") -> DataFrame:
    """Per document: blank-line paragraphs, lines and word tokens of its pages, and words a paragraph."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = pages.select(*doc, X.paragraph_count(t).alias("_p"), F.size(F.filter(X.lines(t), lambda x: X.strip(x) != "")).alias("_l"), F.size(X.word_tokens(t)).alias("_w"))
    return rows.groupBy(*doc).agg(
        F.sum("_p").alias("paragraphs"), F.sum("_l").alias("lines"), F.sum("_w").alias("tokens"), F.round(F.sum("_w") / F.greatest(F.sum("_p"), F.lit(1)), 2).alias("avg_paragraph_words")
    )
