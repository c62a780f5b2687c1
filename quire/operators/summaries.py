"""Partial results merged into summaries, and gates that summaries have to pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import lexicons as L
from quire.functions import text as X


def merge_parts(parts: DataFrame, key: str, order: list[str], text: str, separator: str = "\n") -> DataFrame:
    """The parts of each key joined in order: key, parts, chars, merged.

    Null and blank parts are left out of the text but counted.  A key's parts
    come together in one row, which is the operator's result; its order columns
    should be unique.
    """
    kept = F.filter(F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t")))), lambda p: F.coalesce(X.strip(p["_t"]) != "", F.lit(False)))
    out = parts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(kept, lambda p: p["_t"]), separator).alias("merged"))
    return out.select(key, "parts", F.length("merged").alias("chars"), "merged")


def completeness(parts: DataFrame, key: str, index: str, total: str) -> DataFrame:
    """Per key how many different parts came, how many were announced (the most), and whether all are there."""
    out = parts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(index).alias("received"), F.max(total).alias("announced"))
    return out.withColumn("complete", F.coalesce(F.col("received") >= F.col("announced"), F.lit(False)))


def merge_lists(parts: DataFrame, key: str, order: list[str], fields: list[str], limits: dict[str, int] | None = None) -> DataFrame:
    """List fields concatenated in order, without placeholders and repeats (case, marks and spaces apart), each cut to its limit.

    Repeats are collapsed by an aggregation and the distinct items ranked, so no
    key's parts come together in a task.  Items of parts with equal order columns
    go by their places in the lists.
    """

    def items(n: int, field: str) -> Column:
        tidy = F.transform(field, lambda x, i: F.struct(F.lit(n).alias("_f"), i.alias("_i"), X.strip(x).alias("_x")))
        return F.coalesce(F.filter(tidy, lambda p: (p["_x"] != "") & ~X.is_placeholder(p["_x"])), F.array().cast("array<struct<_f:int,_i:int,_x:string>>"))

    own = F.concat(*(items(n, f) for n, f in enumerate(fields)))
    flat = parts.filter(F.col(key).isNotNull()).select(key, *(F.col(o).alias(f"_o{n}") for n, o in enumerate(order)), F.inline_outer(own))
    place = F.struct(*(f"_o{n}" for n in range(len(order))), "_i", "_x")
    first = flat.groupBy(key, "_f", X.line_key("_x").alias("_k")).agg(F.min(place).alias("_p"))
    if limits and all(f in limits for f in fields):
        w = Window.partitionBy(key, "_f").orderBy("_p")
        first = first.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max(1, *limits.values()))
    merged = lambda n: F.transform(F.sort_array(F.collect_list(F.when(F.col("_f") == n, F.col("_p")))), lambda p: p["_x"])
    cut = lambda c, f: F.slice(c, 1, limits[f]) if limits and f in limits else c
    return first.groupBy(key).agg(*(cut(merged(n), f).alias(f) for n, f in enumerate(fields)))


def usage_totals(parts: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Sums of counters by key; a key whose counters are all zero or missing has nulls."""
    sums = parts.groupBy(key).agg(*(F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields))
    empty = reduce(lambda a, b: a & b, [F.col(f) == 0 for f in fields])
    return sums.select(key, *(F.when(~empty, F.col(f)).alias(f) for f in fields))


def best_variant(variants: DataFrame, key: list[str], attempt: str, passed: Column, length_score: Column, alignment: Column) -> DataFrame:
    """The variant of each key that is kept: the first that passed, else the best score (0.4 length + 0.6 alignment), else the earliest."""
    scored = variants.withColumn("score", F.round(0.4 * length_score + 0.6 * alignment, 3)).withColumn("_passed", F.coalesce(passed, F.lit(False)))
    w = Window.partitionBy(*key).orderBy(F.desc("_passed"), F.when(F.col("_passed"), F.col(attempt)), F.desc("score"), attempt)
    return scored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_passed")


def fixed_layout(fields: dict[str, Column], fallbacks: dict[str, str]) -> Column:
    """array<struct<slug, title, content, ordinal>> of all headings in fixed order, lists as bullets."""
    rows = [F.struct(F.lit(slug).alias("slug"), F.lit(title).alias("title"), X.bullets(F.coalesce(fields.get(slug, F.array().cast("array<string>")), F.array().cast("array<string>")), fallbacks.get(slug, "Not documented.")).alias("content"), F.lit(i + 1).alias("ordinal")) for i, (slug, title) in enumerate(L.HEADINGS)]
    return F.array(*rows)


def layout_text(sections: Column) -> Column:
    """Sections with title and content as ``Title:`` and the content, between empty lines."""
    full = F.filter(sections, lambda s: (X.strip(s.content) != "") & (s.title != ""))
    return F.array_join(F.transform(full, lambda s: F.concat(s.title, F.lit(":\n"), X.strip(s.content))), "\n\n")


def section_items(content: Column, items: Column) -> Column:
    """The items a section lists, else its lines that aren't headings, without list marks and blanks."""
    tidy = lambda x: X.strip_chars(x, "[ -]")
    listed = F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: X.strip(x) != ""), tidy)
    own = F.transform(F.filter(F.transform(X.lines(content), X.strip), lambda x: (x != "") & ~x.rlike(L.HEADING_ONLY)), tidy)
    return F.when(F.size(listed) > 0, listed).otherwise(F.filter(own, lambda x: x != ""))


def _enough_items(items: Column, hint: str) -> Column:
    """Whether some items, and of two or more at least half, show what the section is about and no admin phrase."""
    good = F.size(F.filter(items, lambda x: x.rlike(hint) & ~X.contains_any(F.lower(x), L.SUMMARY_ADMIN_PHRASES)))
    return (good > 0) & ((F.size(items) < 2) | (good * 2 >= F.size(items)))


def section_quality(sections: DataFrame, doc: list[str], order: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Whether a document's sections say enough that is clinical.

    sections: doc, slug, content, items (array) and order columns; of sections
    with one slug the last by ``order`` counts.  Slugs are compared in plain
    spelling, after ``aliases``.  Columns: doc, passed, missing_key_sections,
    admin_dominant_sections, mixed_sections and reasons (joined by commas),
    clinically_dense_sections, admin_token_ratio.
    """
    slug = F.trim(F.regexp_replace(F.lower("slug"), "[^a-z0-9]+", "_"), F.lit("_"))
    for name, other in (aliases or {}).items():
        slug = F.when(slug == name, other).otherwise(slug)
    last = F.max_by(F.struct(X.strip(F.coalesce("content", F.lit(""))).alias("content"), "items"), F.struct(*order)).alias("s")
    own = sections.select(*doc, slug.alias("_slug"), "content", "items", *order).groupBy(*doc, "_slug").agg(last)
    t = F.col("s.content")
    tokens = X.word_tokens(t)
    rows = own.select(
        *doc, "_slug", t.alias("_t"), (F.col("_slug").isin(*L.QUALITY_SLUGS) & ~F.coalesce(X.is_section_placeholder(t), F.lit(True)) & (F.size(tokens) > 0)).alias("_there"), section_items(t, F.col("s.items")).alias("_items"),
        X.let(tokens, lambda k: F.struct(F.size(k).alias("n"), F.size(F.filter(k, lambda x: x.isin(*L.SUMMARY_ADMIN_TOKENS))).alias("admin"), F.size(F.filter(k, lambda x: x.isin(*L.CLINICAL_TOKENS))).alias("clinical"), F.size(F.filter(k, lambda x: x.isin(*L.REASON_TOKENS))).alias("reason"))).alias("_k"),
        (X.occurrences(F.lower(t), L.SUMMARY_ADMIN_PHRASES) * 3).alias("_phrases"),
    )
    rows = rows.select(*doc, "_slug", "_t", "_there", "_items", F.col("_k.n").alias("_n"), F.col("_k.clinical").alias("_clinical"), F.col("_k.reason").alias("_reason"), (F.col("_k.admin") + F.col("_phrases")).alias("_admin"))
    plain = reduce(lambda x, p: F.regexp_replace(x, p, "$1$2"), L.DEGREES, F.col("_t"))
    provider = F.col("_t").rlike(L.PROVIDER_HINT) & ~F.col("_t").rlike(L.MEDICATION_HINT) & (F.col("_admin") < 2) & (F.regexp_count(plain, F.lit("[.!?]")) <= 1) & (F.col("_n") <= 18)
    n_lines = F.size(F.filter(X.lines(F.col("_t")), lambda x: X.strip(x) != ""))
    reason = (F.col("_admin") < 3) & ~X.contains_any(F.lower("_t"), L.REASON_ADMIN) & (F.col("_reason") >= 1) & ~((n_lines > 6) & (F.col("_reason") < 3))
    good = (
        F.when(F.col("_slug") == "provider_seen", provider)
        .when(F.col("_slug") == "reason_for_visit", reason)
        .when(F.col("_slug") == "diagnoses", _enough_items(F.col("_items"), L.DIAGNOSIS_HINT))
        .when(F.col("_slug") == "medications", _enough_items(F.col("_items"), L.MEDICATION_HINT))
    )
    dense = F.coalesce(good, (F.col("_clinical") >= 2) & (F.col("_admin") <= 1))
    judged = rows.select(*doc, "_slug", "_there", "_n", "_admin", ((F.col("_admin") >= 4) & (F.col("_admin") / F.greatest("_n", F.lit(1)) >= 0.12)).alias("_dominant"), (~F.coalesce(good, F.lit(True))).alias("_mixed"), dense.alias("_dense"))
    slugs = lambda test: F.sort_array(F.collect_set(F.when(F.col("_there") & test, F.col("_slug"))))
    there = lambda c: F.when(F.col("_there"), F.col(c))
    out = judged.groupBy(*doc).agg(
        F.array_except(F.array(*(F.lit(s) for s in L.QUALITY_SLUGS)), F.collect_set(there("_slug"))).alias("_missing"),
        slugs(F.col("_dominant")).alias("_dominant"),
        slugs(F.col("_mixed")).alias("_mixed"),
        F.count_if(F.col("_there") & F.col("_dense")).alias("clinically_dense_sections"),
        F.round(F.coalesce(F.sum(there("_admin")), F.lit(0)) / F.greatest(F.coalesce(F.sum(there("_n")), F.lit(0)), F.lit(1)), 3).alias("admin_token_ratio"),
    )
    reasons = F.array_compact(
        F.array(
            F.when(F.size("_missing") >= 3, F.lit("too_many_missing_key_sections")),
            F.when((F.size("_dominant") > 0) | (F.col("admin_token_ratio") >= 0.12), F.lit("boilerplate_dominant_sections")),
            F.when(F.size("_mixed") > 0, F.lit("mixed_section_content")),
            F.when(F.col("clinically_dense_sections") < 3, F.lit("clinical_information_density_low")),
        )
    )
    join = lambda c: F.array_join(c, ",")
    return out.withColumn("_reasons", reasons).select(
        *doc, (F.size("_reasons") == 0).alias("passed"), join("_missing").alias("missing_key_sections"), join("_dominant").alias("admin_dominant_sections"), join("_mixed").alias("mixed_sections"), "clinically_dense_sections", "admin_token_ratio", join("_reasons").alias("reasons")
    )


def _reasons(checks: dict[str, Column]) -> Column:
    """struct<passed, reason>: the names of the checks that don't hold."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))
    return X.let(failed, lambda f: F.struct((F.size(f) == 0).alias("passed"), F.array_join(f, ",").alias("reason")))


_LIST = r"\n\s*[-*]\s+|\n\s*\d+\.\s+"


def summary_figures(summary: Column) -> Column:
    """struct<size, headers, listed, paragraphs, hits, placeholder>: what the verdicts ask of a summary's text."""
    low = F.lower(X.strip(summary))
    return F.struct(
        F.length(X.strip(summary)).alias("size"),
        F.array(*(F.lower(summary).contains(h) for h in L.HEADER_TOKENS)).alias("headers"),
        summary.rlike(_LIST).alias("listed"),
        F.size(F.filter(F.split(summary, "\n\n"), lambda p: X.strip(p) != "")).alias("paragraphs"),
        _empty_words(low).alias("hits"),
        _is_empty(X.strip(summary)).alias("placeholder"),
    )


def _empty_words(low: Column) -> Column:
    return sum((((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).cast("int") for k in L.INVALID_KEYWORDS), F.lit(0))


def _is_empty(stripped: Column) -> Column:
    return F.substring(stripped, 1, 32).rlike(r"(?i)^(?:n/?a|no data|none|empty|tbd)[\s.\-]*$")


def section_figures(sections: DataFrame, key: str, order: list[str], title: str, content: str) -> DataFrame:
    """:func:`summary_figures` (column ``figures``) of each key's sections as ``title:``, a line end and the content, between empty lines.

    The text isn't made: its figures are sums over the sections, apart from those
    of the first and the last.  A title's colon keeps any section from being
    blank, and nothing that is looked for holds an empty line but list marks,
    which are sought in a section between the empty lines that it has around it.
    Sections without key, title or content are left out; order columns should be
    unique.
    """
    gap = F.lit("\n\n")
    part = sections.filter(F.col(key).isNotNull() & F.col(title).isNotNull() & F.col(content).isNotNull()).select(key, *(F.col(o).alias(f"_o{n}") for n, o in enumerate(order)), F.concat(title, F.lit(":\n"), content).alias("_t"))
    t, size = F.col("_t"), F.length("_t")
    edge = {
        "lead": size - F.length(F.regexp_replace("_t", f"^{X.SPACE}+", "")),
        "trail": size - F.length(F.regexp_replace("_t", f"{X.SPACE}+$", "")),
        "inner": F.concat(gap, t, gap).rlike(_LIST),
        "first": F.concat(t, gap).rlike(_LIST),
        "last": F.concat(gap, t).rlike(_LIST),
        "only": t.rlike(_LIST),
        "placeholder": _is_empty(F.regexp_replace("_t", f"^{X.SPACE}+", "")),
    }
    low = F.lower("_t")
    figures = part.select(
        key,
        F.struct(*(f"_o{n}" for n in range(len(order))), *(c.alias(n) for n, c in edge.items())).alias("_e"),
        size.alias("_size"),
        *(low.contains(h).alias(f"_h{n}") for n, h in enumerate(L.HEADER_TOKENS)),
        F.size(F.filter(F.split("_t", "\n\n"), lambda p: X.strip(p) != "")).alias("_paragraphs"),
        _empty_words(low).alias("_hits"),
    )
    sums = figures.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size"), F.min("_e").alias("_a"), F.max("_e").alias("_z"), F.count_if(F.col("_e.inner")).alias("_inner"),
        F.array(*(F.max(f"_h{n}") for n in range(len(L.HEADER_TOKENS)))).alias("_headers"), F.sum("_paragraphs").alias("_paragraphs"), F.sum("_hits").alias("_hits"),
    )
    between = F.col("_inner") - F.col("_a.inner").cast("int") - F.col("_z.inner").cast("int")
    return sums.select(
        key,
        F.struct(
            (F.col("_size") + 2 * (F.col("_n") - 1) - F.col("_a.lead") - F.col("_z.trail")).alias("size"),
            F.col("_headers").alias("headers"),
            F.when(F.col("_n") == 1, F.col("_a.only")).otherwise(F.col("_a.first") | F.col("_z.last") | (between > 0)).alias("listed"),
            F.col("_paragraphs").alias("paragraphs"),
            F.col("_hits").alias("hits"),
            F.col("_a.placeholder").alias("placeholder"),
        ).alias("figures"),
    )


def full_verdict(source_chars: Column, figures: Column, pages: Column, alignment: Column, quality_passed: Column, listed: Column | None = None, least_alignment: float = 0.8) -> Column:
    """struct<passed, reason>: length against the source, three headers and a list (for a hundred pages also paragraphs), alignment and quality.

    figures: :func:`summary_figures` of the summary's text; listed: whether the
    summary has list fields beside its text.
    """
    gate = length_gate(source_chars, figures.size, pages)
    has_list = figures.listed
    structured = (F.size(F.filter(figures.headers, lambda h: h)) >= 3) & (has_list if listed is None else has_list | listed)
    long_enough = (F.coalesce(pages, F.lit(0)) < 100) | (figures.paragraphs >= 3) | (figures.size >= 1000)
    return _reasons({"length_below_threshold": gate.ok, "structure_requirements_not_met": structured & long_enough, "content_alignment_low": alignment >= least_alignment, "summary_quality_low": quality_passed})


def simple_verdict(source_chars: Column, figures: Column, quality_passed: Column, floor: int = 300, ratio: float = 0.005) -> Column:
    """struct<passed, reason>: length, absolutely and against the source, fewer than two empty words and no placeholder, and quality.

    figures: :func:`summary_figures` of the summary's text.
    """
    n = figures.size
    return _reasons({"length_ok": n >= floor, "semantic_ok": (figures.hits < 2) & ~figures.placeholder, "ratio_ok": (source_chars > 0) & (n / F.greatest(source_chars, F.lit(1)) >= ratio), "summary_quality_low": quality_passed})


def length_gate(source_chars: Column, summary_chars: Column, pages: Column, min_ratio: float = 0.01, base: int = 200, long_base: int = 600, least: float = 0.75) -> Column:
    """struct<target, length_score, ok>: a summary's length against a share of its source, longer sources asking for more."""
    long = (F.coalesce(pages, F.lit(0)) > 50) | (source_chars > 100_000)
    target = F.greatest(F.floor(source_chars * min_ratio), F.when(long, long_base).otherwise(base))
    score = F.least(summary_chars / target, F.lit(1.0))
    return F.struct(target.cast("bigint").alias("target"), F.round(score, 3).alias("length_score"), (score >= least).alias("ok"))


def contract_issues(slugs: Column, text: Column, required: tuple[str, ...], forbidden: tuple[str, ...] = ()) -> Column:
    """What is wrong with a structured summary: missing slugs and headers that leaked into its text."""
    missing = F.transform(F.array_except(F.array(*(F.lit(r) for r in required)), slugs), lambda s: F.concat(F.lit("missing:"), s))
    leaks = F.array_compact(F.array(*(F.when(text.contains(f), F.lit(f"leak:{f}")) for f in forbidden))) if forbidden else F.array().cast("array<string>")
    return F.concat(missing, leaks)


def grounded(model: Column, extracted: Column, replace: bool = False) -> Column:
    """A model's list on the ground of an extracted one: replaced by it, or after it, repeats apart; the model's own if nothing was extracted."""
    have = F.size(F.coalesce(extracted, F.array().cast("array<string>"))) > 0
    own = F.coalesce(model, F.array().cast("array<string>"))
    return F.when(have, extracted if replace else F.array_distinct(F.concat(extracted, own))).otherwise(own)


def missing_headings(text: Column, headings: tuple[str, ...]) -> Column:
    """Headings that a text lacks, whatever their case."""
    return F.filter(F.array(*(F.lit(h) for h in headings)), lambda h: ~F.contains(F.lower(text), F.lower(h)))


_PLAN = ("plan", "follow", "therapy", "treatment", "continue", "started", "return", "review", "schedule", "repeat")
_DIAGNOSIS = ("diagnos", "assessment", "impression", "consistent with", "syndrome", "history of")
_PROVIDER = (r"(?:\bDr\.?\s|\bM\.?D\.?\b|\bNP\b|\bPA-C\b|\bRN\b|\bnurse\b|\bphysician\b|\btherapist\b)",)
_MEDICATION = r"(?i)\b\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|puffs?)\b|\b(?:tablet|capsule|patch|ointment|injection)s?\b"


def extract_facts(text: str | Column, limits: dict[str, int] | None = None) -> Column:
    """A struct of what a deterministic extractor finds: overview, key_points, details, care_plan, diagnoses, providers, medications.

    Sentences are sorted into lists by the words they contain; limits cut each
    list.  All expressions; an empty text has an empty overview and lists.
    """
    most = {"key_points": 5, "details": 10, "care_plan": 8, "diagnoses": 6, "providers": 5, "medications": 6} | (limits or {})
    found = F.transform(X.sentences(X.clean_text(text)), lambda s: F.substring(s, 1, 280))
    low = lambda s: F.lower(s)
    take = lambda name, test: F.slice(F.array_distinct(F.filter(found, test)), 1, most[name]).alias(name)
    return F.struct(
        F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("overview"),
        F.slice(F.array_distinct(found), 1, most["key_points"]).alias("key_points"),
        take("details", lambda s: F.size(F.split(s, r"\s+")) >= 6),
        take("care_plan", lambda s: X.contains_any(low(s), _PLAN)),
        take("diagnoses", lambda s: X.contains_any(low(s), _DIAGNOSIS)),
        take("providers", lambda s: s.rlike(_PROVIDER[0])),
        take("medications", lambda s: s.rlike(_MEDICATION)),
    )
