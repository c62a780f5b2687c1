"""Queries over documents, pages, statements and jobs, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch
from quire.functions import keys as K
from quire.functions import lexicons as L
from quire.functions import mentions as N
from quire.functions import redaction as R
from quire.functions import text as X
from quire.operators import chunks, evidence, jobs, pages, pipeline, ranking, summaries
from quire.scratch import table
from quire.sources.sinks import canonical_json
from quire.streaming import jobs as streams

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL pieces ---------------------------------------------------------------


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(by)}, 'g')"


def _chain(expr: str, rules: tuple[tuple[str, str], ...]) -> str:
    for pattern, by in rules:
        expr = _replace(expr, pattern, by)
    return expr


def _any(expr: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({expr}, {q(p)})" for p in phrases) + ")"


def _count(expr: str, phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"((length({expr}) - length(replace({expr}, {q(p)}, ''))) // {len(p)})" for p in phrases) + ")"


def _present(expr: str, phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({expr}, {q(p)})::int" for p in phrases) + ")"


_S = r"[\s\x{00a0}]"
_NL = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{0085}\x{2028}\x{2029}]"
_strip = lambda e: _replace(e, f"^{_S}+|{_S}+$", "")
_lines = lambda e: f"string_split_regex({e}, {q(_NL)})"
_letters = lambda e: f"length({_replace(e, r'[^\p{L}]', '')})"
_digits = lambda e: f"length({_replace(e, r'[^0-9]', '')})"
_nonspace = lambda e: f"length({_replace(e, _S, '')})"
_split_sentences = lambda e: f"list_filter(list_transform(string_split({_replace(_strip(e), r'([.!?])\s+', chr(92) + '1' + chr(1))}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"
_tokens = lambda e: f"regexp_extract_all(lower({e}), '[a-z0-9'']+')"
_VITALS_TABLE = lambda e: f"({_present(f'lower({e})', L.VITAL_TOKENS)} >= 2 and {_digits(e)} >= 4)"
_LEGAL = lambda e: _any(f"lower({e})", L.LEGAL_PHRASES)
_MASK = lambda e: _chain(e, tuple((p, L.MASK) for p in L.MASK_PATTERNS))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scratch.spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


# --- masking ------------------------------------------------------------------


@query(f"""select doc_id, {_MASK('text')} as masked, len({_split_sentences('text')}) as sentences,
           case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end as tokens from documents""")
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with identifiers masked, their sentences and token estimate."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", R.mask_text("text").alias("masked"), F.size(X.sentences("text")).alias("sentences"), X.tokens_floor("text").alias("tokens"))


@query(f"""select delivery_id, {_MASK("metadata['source_uri']")} as source_uri, cardinality(metadata) as n from ocr_chunks where metadata is not null""")
def mask_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message metadata masked value by value."""
    d = R.mask_frame(table(spark, sf_dir, "ocr_chunks").select("delivery_id", "metadata").filter("metadata is not null"), ["metadata"])
    return d.select("delivery_id", F.try_element_at("metadata", F.lit("source_uri")).alias("source_uri"), F.size("metadata").alias("n"))


@query("""select job_id, case when length(job_id) <= 8 then job_id[1:2] || '***' else job_id[1:4] || '***' || right(job_id, 4) end as masked_id,
          substr(sha256(concat_ws('|', nullif(trim(job_id), ''), nullif(trim(status), ''))), 1, 12) as fp from pipeline_jobs""")
def mask_job_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job ids with their middle hidden, and fingerprints."""
    d = table(spark, sf_dir, "pipeline_jobs")
    return d.select("job_id", R.mask_id("job_id").alias("masked_id"), R.fingerprint("job_id", "status").alias("fp"))


# --- cleaning -----------------------------------------------------------------

_NOISE = "(?i)(?:" + "|".join(f"(?:{p})" for p in L.NOISE_LINES) + ")"
_STRIP_NOISE = lambda e: _strip(
    _replace(
        _replace(f"array_to_string(list_filter(list_transform({_lines(e)}, lambda x: {_strip(_replace('x', L.TABLE_RULES, ' '))}), lambda x: not regexp_matches(x, {q(_NOISE)})), chr(10))", r"[ \t]{2,}", " "),
        r"\n{3,}", "\n\n",
    )
)


@query(f"select sample_id, {_STRIP_NOISE('text')} as cleaned, {_strip(_replace(_STRIP_NOISE('text'), _S + '+', ' '))} as one_line from ocr_samples")
def clean_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned texts without fax, billing and legal lines, with and without line ends."""
    d = table(spark, sf_dir, "ocr_samples")
    return d.select("sample_id", X.strip_noise("text").alias("cleaned"), X.clean_scan("text").alias("one_line"))


_CTRL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
_TIDY = lambda e: f"array_to_string(list_transform({_lines(_replace(e, _CTRL, ' '))}, lambda x: trim({_replace('x', _S + '+', ' ')})), chr(10))"
_PARAGRAPHS = lambda e: (
    f"array_to_string(list_transform(list_filter(string_split_regex({_TIDY(e)}, {q(chr(10) + '{2,}')}), lambda x: trim(replace(x, chr(10), ' ')) <> ''), lambda x: trim(replace(x, chr(10), ' '))), chr(10) || chr(10))"
)


@query(f"select doc_id, {_PARAGRAPHS('text')} as paragraphs, trim({_replace(_replace('text', _CTRL, ' '), _S + '+', ' ')}) as one_line from documents")
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with white space in order, paragraphs kept and not."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", X.clean_paragraphs("text").alias("paragraphs"), X.clean_text("text").alias("one_line"))


_COMMAS = "(length(lower(s)) - length(replace(lower(s), ',', '')))"
_NOISE_LINE_SQL = f"""({_LEGAL('s')} or (regexp_matches(s, {q(L.REASON_ONLY_LINE)}) and upper(s) = s) or regexp_matches(s, {q(L.CONSENT_LINE)})
    or {_any('lower(s)', L.FINAL_NOISE)} or (contains(lower(s), 'call') and contains(lower(s), 'immediately'))
    or ({_COMMAS} >= 4 and {_any('lower(s)', ('risk', 'hazard'))}) or {_letters('s')} < 4 or {_VITALS_TABLE('s')})"""


@query(f"""with l as (select section_id, u.pos, u.line, {_strip('u.line')} as s from
             (select section_id, unnest(list_transform({_lines('content')}, lambda x, i: {{'pos': i, 'line': x}})) as u from summary_sections where content is not null)),
           k as (select section_id, pos, case when s = '' then '' else line end as line from l where s = '' or not {_NOISE_LINE_SQL})
           select c.section_id, {_replace(_replace("coalesce(string_agg(k.line, chr(10) order by k.pos), '')", chr(10) + '{3,}', chr(10) * 2), chr(10) + '+$', '')} as cleaned
           from summary_sections c left join k using (section_id) where c.content is not null group by c.section_id""")
def clean_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section contents without lines that say nothing clinical."""
    d = table(spark, sf_dir, "summary_sections").filter("content is not null")
    return d.select("section_id", X.strip_noise_lines("content").alias("cleaned"))


_PRUNED = _replace(_replace(_strip(_replace("content", _S + "+", " ")), L.REASON_PREFIX, ""), "^[:\\- —]+|[:\\- —]+$", "")


@query(f"""select section_id, case when regexp_matches({_strip(_replace('content', _S + '+', ' '))}, {q(L.CONSENT_LINE)}) or {_any('lower(' + _strip(_replace('content', _S + '+', ' ')) + ')', L.WARNING_PHRASES)} then '' else {_PRUNED} end as pruned,
           {_chain('content', L.KEYWORD_REWRITES)} as rewritten, regexp_matches({_strip('content')}, {q(L.PLACEHOLDER)}) as placeholder from summary_sections where content is not null""")
def prune_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section contents without consent text and labels, with empty words spelt out, and placeholders marked."""
    d = table(spark, sf_dir, "summary_sections").filter("content is not null")
    return d.select("section_id", X.prune_admin("content").alias("pruned"), X.rewrite_keywords("content").alias("rewritten"), X.is_placeholder("content").alias("placeholder"))


@query(f"select doc_id, array_to_string(list_filter(list_transform({_lines('text')}, lambda x: {_strip('x')}), lambda x: not regexp_matches(x, {q(L.HEADING_ONLY)})), chr(10)) as body, len(list_filter({_lines('text')}, lambda x: regexp_matches(x, {q(L.HEADING_ONLY)}))) as headings from documents")
def strip_document_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that are headings only."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", X.strip_headings("text").alias("body"), X.heading_count("text").alias("headings"))


# --- extraction ---------------------------------------------------------------


def _vital(name: str, g: int = 1) -> str:
    return f"nullif(regexp_extract(text, {q(L.VITALS[name])}, {g}), '')"


_VITAL_PARTS = ", ".join(
    (
        f"'BP ' || {_vital('blood_pressure')} || ' mmHg'",
        f"'HR ' || {_vital('heart_rate')} || ' bpm'",
        f"'RR ' || {_vital('resp_rate')} || '/min'",
        f"'Temp ' || {_vital('temperature')} || '°' || coalesce(replace(upper({_vital('temperature', 2)}), '°', ''), 'F')",
        f"'SpO2 ' || {_vital('spo2')} || '%'",
    )
)


@query(f"""with v as (select doc_id, list_filter([{_VITAL_PARTS}], lambda x: x is not null) as p, list_filter([{', '.join(f"case when regexp_matches(text, {q(p)}) then {q(t)} end" for p, t in L.DIAGNOSES)}], lambda x: x is not null) as d from documents)
           select doc_id, case when len(p) > 0 then 'Vitals: ' || array_to_string(p, ', ') end as vitals, array_to_string(d, '; ') as complaints from v""")
def vitals_and_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence of vital signs and the complaints each document mentions."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", X.vitals_sentence("text").alias("vitals"), F.array_join(X.complaint_labels("text"), "; ").alias("complaints"))


_PROVIDER_TEXT = f"trim({_replace(_replace('line', _CTRL, ' '), _S + '+', ' ')})"
_EDGES = lambda e: _replace(e, "^[ ,;:-]+|[ ,;:-]+$", "")
_PROVIDER_LINE = _EDGES(_replace(_EDGES(_PROVIDER_TEXT), r"(?i)^(?:provider(?:'s)?\s+signatures?:?|provider:)\s*", ""))
_NAME_WORDS = f"list_filter(regexp_extract_all(lower(s), '[a-z][a-z''.-]*'), lambda t: not list_contains([{', '.join(q(w) for w in N.PROVIDER_AFFIXES)}], replace(t, '.', '')))"


@query(f"""with l as (select summary_id, unnest(string_split(providers_list, chr(10))) as line from test_summaries where providers_list is not null), k as (select *, {_PROVIDER_LINE} as s from l), n as (select *, {_NAME_WORDS} as w from k)
           select summary_id, line, length(s) > 0 and length(s) <= 80 and not regexp_matches(s, '[0-9:/|()]') and not {_LEGAL('s')} and not {_any('lower(s)', N.PROVIDER_ADMIN)} and regexp_matches(s, {q(N.PROVIDER_NAME)}) and len(w) between 2 and 4
                  and not list_has_any(w, [{', '.join(q(w) for w in N.PROVIDER_NOT_NAMES)}]) as is_name from n""")
def provider_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of providers' lists are names of people."""
    d = table(spark, sf_dir, "test_summaries").filter("providers_list is not null").select("summary_id", F.explode(F.split("providers_list", "\n")).alias("line"))
    return d.select("summary_id", "line", N.is_provider_name("line").alias("is_name"))


@query()
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deterministic extractor finds in each document."""
    d = _documents(spark, sf_dir)
    return d.select("doc_id", summaries.extract_facts("text").alias("f")).select("doc_id", "f.*")


# --- chunks -------------------------------------------------------------------


@query()
def packed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into chunks of sentences."""
    d = _documents(spark, sf_dir).select("doc_id", F.array("text").alias("pages"))
    return chunks.pack_pages(d, "pages", ["doc_id"], max_tokens=200, min_tokens=100)


@query()
def packed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned documents packed across their pages, with page ranges and overlap."""
    d = table(spark, sf_dir, "ocr_samples")
    texts = F.when(F.size("pages") > 0, F.transform(F.array_sort("pages"), lambda p: p.text)).otherwise(F.array("text"))
    return chunks.pack_pages(d.select("sample_id", texts.alias("pages")), "pages", ["sample_id"], max_tokens=200, min_tokens=100, overlap_tokens=20)


_NEXT = "least(length(text), least(lo + 3000, case when lo + 2600 >= length(text) then length(text) when regexp_matches(substr(text, lo + 2601, 401), '[ \n\t]') then lo + 2600 + length(regexp_extract(substr(text, lo + 2601, 401), '^[^ \n\t]*')) else lo + 3000 end))"


@query(f"""with recursive w as (
             select doc_id, text, 0 as lo, case when length(text) <= 3000 then length(text) else {_NEXT} end as hi from (select doc_id, text, 0 as lo from documents where length(text) > 0)
             union all select doc_id, text, lo, {_NEXT} as hi from (select doc_id, text, hi - 320 as lo from w where hi < length(text))),
           k as (select doc_id, case when length(text) <= 3000 then text else {_strip('substr(text, lo + 1, hi - lo)')} end as t, lo, length(text) as n from w),
           f as (select * from k where n <= 3000 or t <> '')
           select doc_id, (row_number() over (partition by doc_id order by lo))::int as chunk_index, (count(*) over (partition by doc_id))::int as chunk_total, t as text, greatest(1, ceil(length(t) / 4)::int) as approx_tokens from f""")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows over documents."""
    return chunks.sliding_windows(table(spark, sf_dir, "documents"), "text", ["doc_id"], target_chars=2600, max_chars=3000)


@query()
def word_filled_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of whole words."""
    return chunks.word_chunks(table(spark, sf_dir, "documents"), "text", ["doc_id"])


@query("""with n as (select job_id, max(total_pages) as n from ocr_chunks where total_pages is not null group by job_id)
          select job_id, i::int as part_index, (i * 25 + 1)::int as page_start, least(i * 25 + 25, n)::int as page_end from (select job_id, n, unnest(generate_series(0, (n + 24) // 25 - 1)) as i from n where n > 0)""")
def page_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges of 25 pages by job."""
    n = table(spark, sf_dir, "ocr_chunks").filter("total_pages is not null").groupBy("job_id").agg(F.max("total_pages").alias("n"))
    return chunks.page_ranges(n, "n", ["job_id"])


@query()
def summary_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headed sections found in medical summaries."""
    d = table(spark, sf_dir, "test_summaries").filter("medical_summary is not null")
    return d.select("summary_id", F.inline(chunks.sections_of("medical_summary")))


# --- pages --------------------------------------------------------------------

_PAGES = "(select sample_id, u.page_number as page_number, u.text as text from (select sample_id, unnest(pages) as u from ocr_samples where pages is not null))"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "ocr_samples").select("sample_id", F.explode("pages").alias("p")).select("sample_id", "p.page_number", "p.text")


def _all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every sample: those given, else those of its text, which form feeds part; without text there are none."""
    d = scratch.spread(table(spark, sf_dir, "ocr_samples").select("sample_id", "text", "pages"), "sample_id")
    split = F.transform(F.split("text", "\f"), lambda t, i: F.struct((i + 1).cast("int").alias("page_number"), t.alias("text")))
    given = F.transform("pages", lambda p: F.struct(p.page_number.alias("page_number"), p.text.alias("text")))
    own = F.when(F.size("pages") > 0, given).when(F.col("text") != "", split)
    return d.select("sample_id", F.explode(own).alias("p")).select("sample_id", "p.page_number", "p.text")


@query(f"""with p as (select sample_id, length({_strip("coalesce(text, '')")}) as n, {_letters("coalesce(text, '')")} as a, {_nonspace("coalesce(text, '')")} as s from {_PAGES}),
           m as (select sample_id, count(*)::int as page_count, count_if(n > 0)::int as non_empty_pages, sum(n)::int as total_chars, round(sum(n) / count(*), 1) as avg_chars_per_page,
                 round(count_if(n < 80) / count(*), 3) as short_page_ratio, round(sum(a) / greatest(sum(s), 1), 3) as alpha_ratio, round(count_if(n > 0) / count(*), 3) as non_empty_page_ratio from p group by sample_id),
           r as (select *, case when total_chars < 200 or non_empty_pages <= 0 or non_empty_page_ratio < 0.5 then 'scan_or_image_only'
                 when avg_chars_per_page < 80 or alpha_ratio < 0.55 or short_page_ratio > 0.8 then 'native_text_low_confidence' else 'native_text_sufficient' end as route from m)
           select *, route <> 'native_text_sufficient' as requires_ocr from r""")
def native_text_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pages' own text will do."""
    return pages.native_metrics(_pages(spark, sf_dir), ["sample_id"])


def _routing_sql(source: str, key: str, pages: str, mean: str = "round(coalesce(words, 0) / m, 2)") -> str:
    return f"""with a as (select {key}, {pages} as pages, text as t, list_filter(list_transform({_lines('text')}, lambda x: {_strip('x')}), lambda x: x <> '') as f from {source}),
           b as (select {key}, pages, t, case when len(f) <= 4 then flatten(list_transform(f, lambda y: {_split_sentences('y')})) else f end as l, {_PARAGRAPHS('t')} as par from a),
           c as (select {key}, pages, t, l, len(l) as n, greatest(len(l), 1) as m, array_to_string(l, ' ') as j, par,
                 len(list_filter(l, lambda s: {_LEGAL('s')} or regexp_matches(s, {q(L.CONSENT_LINE)}) or regexp_matches(s, {q(L.REASON_ONLY_LINE)}) or {_VITALS_TABLE('s')})) as noise,
                 len(list_filter(l, lambda s: len(string_split_regex(s, '\\s+')) <= 2)) as short, list_sum(list_transform(l, lambda s: len(string_split_regex(s, '\\s+')))) as words,
                 len(regexp_extract_all(t, {q(L.REPEATED_MARKERS)})) as mk, lower(t) as low from b),
           d as (select {key}, pages::int as page_count, case when par = '' then 0 else greatest(1, ceil(length(par) / 4)::int, ceil(len(list_filter(string_split_regex(par, '\\s+'), lambda w: w <> '')) * 11 / 10)::int) end as estimated_tokens,
                 n::int as line_count, noise::int as noise_line_count, round(noise / m, 3) as noise_ratio, round(short / m, 3) as short_line_ratio, round({_letters('j')} / greatest({_nonspace('j')}, 1), 3) as alpha_ratio,
                 {mean} as average_words_per_line, mk::int as repeated_metadata_markers,
                 ((mk >= 6 and pages >= 3)::int + ({_count('low', ('reason for visit:',))} >= greatest(3, pages + 1))::int + ({_count('low', ('patient name:',))} >= greatest(2, pages))::int) as mixed_packet_signals from c),
           e as (select *, line_count > 0 and noise_ratio <= 0.35 and short_line_ratio <= 0.45 and alpha_ratio >= 0.55 and mixed_packet_signals = 0 as quality_ok from d)
           select *, case when estimated_tokens > 120000 or page_count > 80 or mixed_packet_signals > 0 or not quality_ok then 'chunked' else 'one_shot' end as strategy from e"""


@query(_routing_sql("documents", "doc_id", "0"))
def document_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each document and how it would be summarised."""
    m = pages.routing_metrics(_documents(spark, sf_dir).filter("text is not null"), ["doc_id"])
    return m.withColumn("strategy", pages.summary_route()["strategy"])


# halves are rounded up
@query(_routing_sql("ocr_samples where text is not null", "sample_id", "greatest(coalesce(len(pages), 0), len(string_split(text, chr(12))))", "((coalesce(words, 0) * 200 + m) // (2 * m)) / 100"))
def sample_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each scanned document, its pages counted, and how it would be summarised."""
    d = scratch.spread(table(spark, sf_dir, "ocr_samples").select("sample_id", "text", "pages").filter("text is not null"), "sample_id")
    counted = F.greatest(F.coalesce(F.size("pages"), F.lit(0)), F.size(F.split("text", "\f")))
    m = pages.routing_metrics(d, ["sample_id"], page_count=counted)
    return m.withColumn("strategy", pages.summary_route()["strategy"])


_ADMIN, _CLIN, _META = (f"({_count('l', w)})" for w in (L.PAGE_ADMIN, L.PAGE_CLINICAL, L.PAGE_METADATA))
_VISIT = "(contains(l, 'established patient visit') or contains(l, 'new patient visit'))"
_PAIRS = " or ".join(f"(contains(l, {q(a)}) and contains(l, {q(b)}))" for a, b in L.PAGE_ADMIN_PAIRS)


@query(f"""with p as (select sample_id, page_number, {_PARAGRAPHS("coalesce(text, '')")} as t from {_PAGES}), k as (select *, lower(t) as l, greatest({_nonspace('t')}, 1) as sp from p)
           select sample_id, page_number, case when t = '' then 'empty' when len({_tokens('t')}) < 20 then 'too_short' when {_any('l', L.PAGE_HARD_REJECT)} then 'hard_reject' when {_PAIRS} then 'workflow_admin'
             when {_ADMIN} >= {_CLIN} + 2 then 'admin_dominant' when {_META} >= 4 and {_CLIN} < 4 then 'metadata_dominant' when not {_VISIT} and {_present('l', L.PAGE_HEADER_NOISE)} >= 2 and {_CLIN} < 8 then 'header_noise'
             when not {_VISIT} and {_digits('t')} / sp >= 0.14 and {_letters('t')} / sp <= 0.78 and {_CLIN} < 12 then 'numeric_noise' when not ({_VISIT} or {_CLIN} >= 3 or (contains(l, 'medication') and {_ADMIN} = 0)) then 'low_signal' end as reason from k""")
def page_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages aren't worth reading, duplicates apart."""
    p = _pages(spark, sf_dir).select("sample_id", "page_number", X.clean_paragraphs(F.coalesce("text", F.lit(""))).alias("t"))
    return p.select("sample_id", "page_number", pages.page_reason("t", 20).alias("reason"))


@query()
def selected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages worth reading, of all samples with pages or text."""
    return pages.select_pages(_all_pages(spark, sf_dir), ["sample_id"], "page_number", min_words=20)


@query()
def page_selection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages were rejected, by document, of all samples with pages or text."""
    return pages.selection_report(pages.select_pages(_all_pages(spark, sf_dir), ["sample_id"], "page_number"), ["sample_id"])


@query(f"""select sample_id, page_number, sum(n + 2) over w - (n + 2) as text_offset, row_number() over w - 1 as page_offset from (select sample_id, page_number, length(coalesce(text, '')) as n from {_PAGES}) window w as (partition by sample_id order by page_number)""")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pages start in the text they make together."""
    return pages.rebased_pages(_pages(spark, sf_dir).withColumn("page_count", F.lit(1)), ["sample_id"], "page_number", "text")


@query(f"""with p as (select sample_id, len(list_filter(string_split_regex(coalesce(text, ''), '\\n\\s*\\n'), lambda x: {_strip('x')} <> '')) as p, len(list_filter({_lines("coalesce(text, '')")}, lambda x: {_strip('x')} <> '')) as l, len({_tokens("coalesce(text, '')")}) as w from {_PAGES})
           select sample_id, sum(p)::bigint as paragraphs, sum(l)::bigint as lines, sum(w)::bigint as tokens, round(sum(w) / greatest(sum(p), 1), 2) as avg_paragraph_words from p group by sample_id""")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, lines and words of documents' pages."""
    return pages.structure_metrics(_pages(spark, sf_dir), ["sample_id"])


# --- ranking ------------------------------------------------------------------

_KEYWORDS = ("pain", "blood pressure", "plan")
_NOISY = f"""({_count('s', ('=',))} >= 5 or length(s) > 340 or {_LEGAL('s')} or {_letters('s')} = 0 or {_digits('s')} > {_letters('s')} * 2 or (len(string_split_regex(s, '\\s+')) <= 2 and {_digits('s')} > {_letters('s')})
    or (contains(lower(s), 'risk') and {_any('lower(s)', ('procedure', 'injection', 'hazard', 'complication', 'nerve'))}) or {_any('lower(s)', ('discharge instruction', 'patient education', 'life threatening emergency', 'no heavy lifting'))})"""


@query(f"""with l as (select doc_id, (u.pos - 1)::int as pos, {_strip('u.line')} as s from (select doc_id, unnest(list_transform({_lines('text')}, lambda x, i: {{'pos': i, 'line': x}})) as u from documents where text is not null)),
           k as (select doc_id, pos, s, trim({_replace('lower(s)', '[^a-z0-9]+', ' ')}) as key from l where s <> ''),
           f as (select *, round({_present('lower(s)', _KEYWORDS)} * 6 + {_letters('s')} / 140 - {_digits('s')} * 0.2 - greatest(0, length(s) - 220) / 160 - case when {_any('lower(s)', ('risk', 'hazard', 'complication'))} then 4 else 0 end
                 - case when {_any('lower(s)', ('instruction', 'education'))} then 3 else 0 end, 6) as score from k where key <> '' and not {_NOISY} and not {_any('lower(s)', L.UNWANTED_TOKENS)} and not {_any('lower(s)', L.FINAL_NOISE)} and not (contains(lower(s), 'call') and contains(lower(s), 'immediately')) and {_any('lower(s)', _KEYWORDS)}),
           g as (select *, row_number() over (partition by doc_id, key order by score desc, pos) as rk from f),
           h as (select *, row_number() over (partition by doc_id order by score desc, pos) as rn from g where rk = 1)
           select doc_id, pos, s as line, score from h where rn <= 5""")
def best_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best distinct lines of each document."""
    return ranking.ranked_lines(_documents(spark, sf_dir).filter("text is not null"), ["doc_id"], "text", 5, _KEYWORDS)


_STOP = "[" + ", ".join(q(w) for w in L.STOPWORDS) + "]"
_CONTENT = lambda e: f"list_filter({_tokens(e)}, lambda t: not list_contains({_STOP}, t) and not regexp_matches(t, '^[0-9]+$'))"


@query(f"""with t as (select doc_id, {_CONTENT("coalesce(text, '')")} as t from documents),
           w as (select doc_id, unnest(t) as phrase, 0 as kind, generate_subscripts(t, 1) - 1 as pos, t from t),
           p as (select doc_id, t[pos + 1] || ' ' || t[pos + 2] as phrase, 1 as kind, pos from w where pos + 2 <= len(t) and t[pos + 1] <> t[pos + 2]),
           c as (select doc_id, phrase, count(*) as n, min(kind) as kind, min(pos) as pos from (select doc_id, phrase, kind, pos from w union all select * from p) group by doc_id, phrase)
           select doc_id, rank::int as rank, phrase, n from (select *, row_number() over (partition by doc_id order by n desc, kind, pos) as rank from c) where rank <= 10""")
def document_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent phrases of each document."""
    return ranking.top_phrases(_documents(spark, sf_dir), ["doc_id"], "text", 10)


def _job_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each job's text (side 0) and of its summary (side 1): chunk texts and chunk summaries."""
    chunk = table(spark, sf_dir, "ocr_chunks").select("job_id", F.lit(0).alias("side"), F.col("delivery_id").alias("part"), "text")
    parts = table(spark, sf_dir, "summary_results").select("job_id", F.lit(1).alias("side"), F.col("result_id").alias("part"), F.col("summary_text").alias("text"))
    return chunk.unionByName(parts).filter("job_id is not null")


def _phrases_sql(side: str) -> str:
    return f"""(with t as (select job_id, {_CONTENT(side)} as t from pairs), w as (select job_id, unnest(t) as phrase, 0 as kind, generate_subscripts(t, 1) - 1 as pos, t from t),
        p as (select job_id, t[pos + 1] || ' ' || t[pos + 2] as phrase, 1 as kind, pos from w where pos + 2 <= len(t) and t[pos + 1] <> t[pos + 2]),
        c as (select job_id, phrase, count(*) as n, min(kind) as kind, min(pos) as pos from (select job_id, phrase, kind, pos from w union all select * from p) group by job_id, phrase)
        select job_id, phrase from (select *, row_number() over (partition by job_id order by n desc, kind, pos) as rank from c) where rank <= 200)"""


@query(f"""with s as (select job_id, coalesce(string_agg(case when {_strip('text')} <> '' then text end, chr(10) order by delivery_id), '') as source from ocr_chunks where job_id is not null group by job_id),
           r as (select job_id, coalesce(string_agg(case when {_strip('summary_text')} <> '' then summary_text end, chr(10) order by result_id), '') as summary from summary_results where job_id is not null group by job_id),
           pairs as (select job_id, source, summary from s join r using (job_id)), a as {_phrases_sql('source')}, b as {_phrases_sql('summary')},
           ca as (select job_id, count(*) as a from a group by job_id), cb as (select job_id, count(*) as b from b group by job_id), cc as (select job_id, count(*) as c from a join b using (job_id, phrase) group by job_id),
           o as (select job_id, list_distinct({_CONTENT('source')}) as x, list_distinct({_CONTENT('summary')}) as y from pairs),
           v as (select job_id, case when least(len(x), len(y)) = 0 then 0.0 else round(len(list_intersect(x, y)) / least(len(x), len(y)), 3) end as token_overlap from o),
           z as (select v.job_id, token_overlap, case when least(coalesce(a, 0), coalesce(b, 0)) > 0 then coalesce(c, 0) / least(a, b) else 0.0 end as ph, least(coalesce(a, 0), coalesce(b, 0)) as m from v left join ca using (job_id) left join cb using (job_id) left join cc using (job_id))
           select job_id, token_overlap, round(ph, 6) as phrase_overlap, case when m = 0 then 0.0 else round(0.55 * ph + 0.45 * token_overlap, 3) end as alignment from z""")
def job_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a job's text its summaries speak about."""
    return ranking.part_alignment(_job_parts(spark, sf_dir), ["job_id"], "side", ["part"], "text")


# --- evidence -----------------------------------------------------------------


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = table(spark, sf_dir, "summary_sections").select("job_id", "ordinal", F.concat(F.coalesce("slug", F.lit("section")), F.lit("-"), F.col("section_id").cast("string")).alias("slug"), "title", "content", "kind")
    sources = table(spark, sf_dir, "evidence_spans").select("job_id", F.col("span_key").alias("source_no"), "page", F.col("text_snippet").alias("text"))
    return evidence.claims(evidence.statements(sections.filter("content is not null"), ["job_id"]), sources, ["job_id"])


@query(f"""with sec as (select job_id, ordinal, coalesce(slug, 'section') || '-' || section_id as slug, title, content from summary_sections where content is not null and kind in ('mcc', 'clinical')),
           li as (select job_id, ordinal, slug, title, list_filter(list_transform({_lines('content')}, lambda x: {_strip("regexp_replace(" + _strip('x') + ", '^[-•]', '')")}), lambda x: x <> '') as l from sec),
           st as (select job_id, ordinal, slug, title, unnest(l[1:3]) as statement, generate_subscripts(l[1:3], 1) as no from li),
           src as (select job_id, span_key, page, text_snippet as t from evidence_spans where text_snippet is not null and text_snippet <> ''),
           p as (select *, {_tokens('statement')} as mine, {_tokens('t')} as theirs, instr(lower(t), lower({_strip('statement')})) as a, {_strip('statement')} as s from st join src using (job_id)),
           m as (select *, len(list_filter(mine, lambda x: list_contains(theirs, x))) as hits, list_filter(mine, lambda x: instr(lower(t), x) > 0)[1] as fw from p),
           sc as (select *, case when s <> '' and a > 0 then least(0.99, length(s) / greatest(length(t), 1)) when s <> '' and hits > 0 then least(0.95, hits / greatest(len(mine), 1)) end as score,
                  case when s <> '' and a > 0 then {_strip('substr(t, greatest(0, a - 33) + 1, least(length(t), a - 1 + length(s) + 32) - greatest(0, a - 33))')}
                       when s <> '' and hits > 0 then {_strip("substr(t, greatest(0, instr(lower(t), fw) - 41) + 1, least(length(t), instr(lower(t), fw) - 1 + 160) - greatest(0, instr(lower(t), fw) - 41))")} end as snippet from m),
           b as (select *, row_number() over (partition by job_id, ordinal, slug, title, no, statement order by score desc, span_key) as rk from sc where score is not null and snippet <> ''),
           c as (select *, row_number() over (partition by job_id order by ordinal nulls first, slug, no, statement) as claim_no from b where rk = 1)
           select job_id, claim_no::int as claim_no, slug || '-claim-' || claim_no as claim_id, slug || '-span-' || claim_no as span_id, slug, title, statement, page, snippet, round(score, 3) as confidence from c where claim_no <= 12""")
def supported_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of summaries with the evidence span that supports each best."""
    return _claims(spark, sf_dir)


@query("""select s.span_key, s.job_id from evidence_spans s where not exists (select 1 from summary_sections c where c.job_id = s.job_id)""")
def unreferenced_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence spans of jobs without any section."""
    return table(spark, sf_dir, "evidence_spans").select("span_key", "job_id").join(table(spark, sf_dir, "summary_sections").select("job_id").distinct(), "job_id", "left_anti").select("span_key", "job_id")


@query("""with a as (select distinct job_id from pipeline_jobs), b as (select distinct lower(trim(job_id)) as job_id from ocr_chunks where job_id is not null)
          select coalesce(a.job_id, b.job_id) as job_id, case when b.job_id is null then 'missing' else 'unexpected' end as side from a full outer join b on a.job_id = b.job_id where a.job_id is null or b.job_id is null""")
def job_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs known but without chunks, and the other way round."""
    seen = table(spark, sf_dir, "ocr_chunks").select(F.lower(F.trim("job_id")).alias("job_id"))
    return evidence.set_differences(table(spark, sf_dir, "pipeline_jobs"), seen, "job_id")


_REF = "trim(regexp_replace(lower(slug), '[^a-z0-9]+', '_', 'g'), '_') || '-span-' || ordinal"


@query(f"""select c.job_id, c.section_id::varchar as claim_id, {_REF} as span_id from summary_sections c where slug is not null and ordinal is not null and job_id is not null
           and not exists (select 1 from evidence_spans s where s.job_id = c.job_id and s.span_id = {_REF})""")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of sections to evidence spans that their job doesn't have."""
    slug = F.trim(F.regexp_replace(F.lower("slug"), "[^a-z0-9]+", "_"), F.lit("_"))
    wanted = table(spark, sf_dir, "summary_sections").filter("slug is not null and ordinal is not null and job_id is not null")
    wanted = wanted.select("job_id", F.col("section_id").cast("string").alias("claim_id"), F.array(F.concat(slug, F.lit("-span-"), F.col("ordinal").cast("string"))).alias("evidence_refs"))
    return evidence.dangling_references(wanted, table(spark, sf_dir, "evidence_spans"), ["job_id"]).select("job_id", "claim_id", "span_id")


# --- partial results ----------------------------------------------------------


@query(f"""select job_id, count(*) as parts, coalesce(length(string_agg(case when {_strip('summary_text')} <> '' then summary_text end, chr(10) order by section_index nulls first, result_id)), 0) as chars,
           coalesce(string_agg(case when {_strip('summary_text')} <> '' then summary_text end, chr(10) order by section_index nulls first, result_id), '') as merged from summary_results where job_id is not null group by job_id""")
def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk summaries of each job joined in order."""
    return summaries.merge_parts(table(spark, sf_dir, "summary_results"), "job_id", ["section_index", "result_id"], "summary_text")


@query("""select job_id, count(distinct section_index) as received, max(total_sections) as announced, coalesce(count(distinct section_index) >= max(total_sections), false) as complete from summary_results where job_id is not null group by job_id""")
def job_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all announced parts of a job came."""
    return summaries.completeness(table(spark, sf_dir, "summary_results"), "job_id", "section_index", "total_sections")


@query("""select job_id, nullif(coalesce(sum(tokens_used), 0), 0) as tokens_used from summary_results group by job_id""")
def job_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens used by job."""
    return summaries.usage_totals(table(spark, sf_dir, "summary_results"), "job_id", ["tokens_used"])


@query("""select job_id, round(avg(length(text)), 2) as avg_chunk_chars, count(*) as chunks from ocr_chunks where text is not null group by job_id""")
def chunk_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean chunk length by job."""
    return table(spark, sf_dir, "ocr_chunks").filter("text is not null").groupBy("job_id").agg(F.round(F.avg(F.length("text")), 2).alias("avg_chunk_chars"), F.count(F.lit(1)).alias("chunks"))


_PLACE = lambda e: f"regexp_matches({e}, {q(L.PLACEHOLDER)})"


def _merged_list(field: str) -> str:
    return f"""(select j.job_id, coalesce(m.v, '') as v from (select distinct job_id from test_summaries where job_id is not null) j left join (
        select job_id, string_agg(item, '; ' order by summary_id, i) as v from (select *, row_number() over (partition by job_id order by summary_id, i) as rn from (
            select *, row_number() over (partition by job_id, key order by summary_id, i) as first from (
                select job_id, summary_id, i, item, trim({_replace('lower(item)', '[^a-z0-9]+', ' ')}) as key from (
                    select job_id, summary_id, {_strip('u.x')} as item, u.i as i from (select job_id, summary_id, unnest(list_transform(string_split({field}, chr(10)), lambda x, i: {{'x': x, 'i': i}})) as u from test_summaries where {field} is not null))
                where item <> '' and not {_PLACE('item')})) where first = 1) where rn <= 12 group by job_id) m using (job_id))"""


@query(
    f"select d.job_id, d.v as diagnoses_list, p.v as providers_list, m.v as medications_list from {_merged_list('diagnoses_list')} d join {_merged_list('providers_list')} p using (job_id) join {_merged_list('medications_list')} m using (job_id)"
)
def diagnosis_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnoses, providers and medications of each job's summaries merged without repeats."""
    names = ["diagnoses_list", "providers_list", "medications_list"]
    d = table(spark, sf_dir, "test_summaries").select("job_id", "summary_id", *(F.split(f, "\n").alias(f) for f in names))
    merged = summaries.merge_lists(d, "job_id", ["summary_id"], names, {f: 12 for f in names})
    return merged.select("job_id", *(F.array_join(f, "; ").alias(f) for f in names))


_IN = lambda words: "(" + ", ".join(q(w) for w in words) + ")"
_DEGREES = lambda e: _chain(e, tuple((p, r"\1\2") for p in L.DEGREES))
_DASHES = lambda e: _replace(e, "^[ -]+|[ -]+$", "")
_GOOD_ITEMS = lambda hint: f"len(list_filter(items, lambda x: regexp_matches(x, {q(hint)}) and not {_any('lower(x)', L.SUMMARY_ADMIN_PHRASES)}))"
_ENOUGH = lambda hint: f"({_GOOD_ITEMS(hint)} > 0 and (len(items) < 2 or {_GOOD_ITEMS(hint)} * 2 >= len(items)))"
_QUALITY_SQL = f"""with a as (select job_id, trim({_replace('lower(slug)', '[^a-z0-9]+', '_')}, '_') as s0, coalesce(content, '') as c, extra, ordinal, section_id from summary_sections),
           a1 as (select *, case when s0 = 'treatment_plan' then 'treatment_follow_up_plan' else s0 end as slug from a),
           a2 as (select job_id, slug, {_strip('c')} as t, extra, row_number() over (partition by job_id, slug order by ordinal desc nulls last, section_id desc) as rn from a1),
           b as (select job_id, slug, t, {_replace('lower(' + _strip('t') + ')', '[.]+$', '')} as low, {_tokens('t')} as k, lower(t) as l,
                 list_transform(list_filter(coalesce(extra['items'], []), lambda x: {_strip('x')} <> ''), lambda x: {_DASHES('x')}) as given,
                 list_filter(list_transform(list_filter(list_transform({_lines('t')}, lambda x: {_strip('x')}), lambda x: x <> '' and not regexp_matches(x, {q(L.HEADING_ONLY)})), lambda x: {_DASHES('x')}), lambda x: x <> '') as own from a2 where rn = 1),
           c as (select *, case when len(given) > 0 then given else own end as items, slug in {_IN(L.QUALITY_SLUGS)} and not (low = '' or low in {_IN(L.SECTION_PLACEHOLDERS)}) and len(k) > 0 as there, len(k) as n,
                 len(list_filter(k, lambda x: x in {_IN(L.SUMMARY_ADMIN_TOKENS)})) + 3 * {_count('l', L.SUMMARY_ADMIN_PHRASES)} as admin, len(list_filter(k, lambda x: x in {_IN(L.CLINICAL_TOKENS)})) as clinical,
                 len(list_filter(k, lambda x: x in {_IN(L.REASON_TOKENS)})) as reason, len(list_filter({_lines('t')}, lambda x: {_strip('x')} <> '')) as nl from b),
           d as (select *, case slug when 'provider_seen' then regexp_matches(t, {q(L.PROVIDER_HINT)}) and not regexp_matches(t, {q(L.MEDICATION_HINT)}) and admin < 2 and len(regexp_extract_all({_DEGREES('t')}, '[.!?]')) <= 1 and n <= 18
                 when 'reason_for_visit' then admin < 3 and not {_any('l', L.REASON_ADMIN)} and reason >= 1 and not (nl > 6 and reason < 3)
                 when 'diagnoses' then {_ENOUGH(L.DIAGNOSIS_HINT)} when 'medications' then {_ENOUGH(L.MEDICATION_HINT)} end as good from c),
           e as (select job_id, list(slug) filter (there) as have, coalesce(list_sort(list(slug) filter (there and admin >= 4 and admin / greatest(n, 1) >= 0.12)), []) as dom, coalesce(list_sort(list(slug) filter (there and not coalesce(good, true))), []) as mix,
                 count_if(there and coalesce(good, clinical >= 2 and admin <= 1)) as clinically_dense_sections, round(coalesce(sum(admin) filter (there), 0) / greatest(coalesce(sum(n) filter (there), 0), 1), 3) as admin_token_ratio from d group by job_id),
           f as (select *, list_filter([{', '.join(q(x) for x in L.QUALITY_SLUGS)}], lambda x: not list_contains(coalesce(have, []), x)) as mis from e),
           g as (select *, list_filter([case when len(mis) >= 3 then 'too_many_missing_key_sections' end, case when len(dom) > 0 or admin_token_ratio >= 0.12 then 'boilerplate_dominant_sections' end, case when len(mix) > 0 then 'mixed_section_content' end,
                 case when clinically_dense_sections < 3 then 'clinical_information_density_low' end], lambda x: x is not null) as r from f)
           select job_id, len(r) = 0 as passed, array_to_string(mis, ',') as missing_key_sections, array_to_string(dom, ',') as admin_dominant_sections, array_to_string(mix, ',') as mixed_sections, clinically_dense_sections, admin_token_ratio, array_to_string(r, ',') as reasons from g"""


@query(_QUALITY_SQL)
def section_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each job's sections say enough that is clinical, and why not."""
    d = table(spark, sf_dir, "summary_sections").select("job_id", "slug", "content", F.try_element_at("extra", F.lit("items")).alias("items"), "ordinal", "section_id")
    return summaries.section_quality(d, ["job_id"], ["ordinal", "section_id"], {"treatment_plan": "treatment_follow_up_plan"})


_SECTION_TEXT = "title || ':' || chr(10) || content"


@query(f"""with s as (select job_id, string_agg({_SECTION_TEXT}, chr(10) || chr(10) order by ordinal nulls first, section_id) as t from summary_sections where content is not null and title is not null group by job_id),
           c as (select job_id, sum(length(text)) as n, max(total_pages) as pages from ocr_chunks where text is not null group by job_id), y as ({_QUALITY_SQL}), al as (select job_id, alignment from ({ORACLE_SQL['job_alignment']})),
           z as (select s.job_id, t, n, pages, coalesce(alignment, 0.0) as alignment, coalesce(passed, false) as ok, length({_strip('t')}) as size, lower(t) as l from s join c using (job_id) left join al using (job_id) left join y using (job_id)),
           r as (select *, greatest(floor(n * 0.01)::bigint, case when coalesce(pages, 0) > 50 or n > 100000 then 600 else 200 end) as target,
                 {_present('l', L.HEADER_TOKENS)} >= 3 and (regexp_matches(t, '\\n\\s*[-*]\\s+') or regexp_matches(t, '\\n\\s*\\d+\\.\\s+')) and (coalesce(pages, 0) < 100 or len(list_filter(string_split(t, chr(10) || chr(10)), lambda p: {_strip('p')} <> '')) >= 3 or size >= 1000) as st,
                 {' + '.join(f"((length(lower({_strip('t')})) - length(replace(lower({_strip('t')}), {q(k)}, ''))) // {len(k)})" for k in L.INVALID_KEYWORDS)} as hits from z),
           x as (select *, list_filter([case when least(size / target, 1.0) < 0.75 then 'length_below_threshold' end, case when not st then 'structure_requirements_not_met' end, case when alignment < 0.8 then 'content_alignment_low' end, case when not ok then 'summary_quality_low' end], lambda v: v is not null) as a,
                 list_filter([case when size < 300 then 'length_ok' end, case when hits >= 2 or regexp_matches(substr({_strip('t')}, 1, 32), '(?i)^(?:n/?a|no data|none|empty|tbd)[\\s.\\-]*$') then 'semantic_ok' end, case when not (n > 0 and size / greatest(n, 1) >= 0.005) then 'ratio_ok' end, case when not ok then 'summary_quality_low' end], lambda v: v is not null) as b from r)
           select job_id, len(a) = 0 as passed, array_to_string(a, ',') as reason, len(b) = 0 as passed_simple, array_to_string(b, ',') as reason_simple from x""")
def summary_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sections of each job make a summary of its text: the full and the simple rules."""
    parts = summaries.section_figures(table(spark, sf_dir, "summary_sections"), "job_id", ["ordinal", "section_id"], "title", "content")
    source = table(spark, sf_dir, "ocr_chunks").filter("text is not null").groupBy("job_id").agg(F.sum(F.length("text")).alias("n"), F.max("total_pages").alias("pages"))
    joined = parts.join(source, "job_id").join(job_alignment(spark, sf_dir).select("job_id", "alignment"), "job_id", "left").join(section_quality(spark, sf_dir).select("job_id", F.col("passed").alias("ok")), "job_id", "left")
    full = summaries.full_verdict(F.col("n"), F.col("figures"), F.col("pages"), F.coalesce("alignment", F.lit(0.0)), F.col("ok"))
    simple = summaries.simple_verdict(F.col("n"), F.col("figures"), F.col("ok"))
    return joined.select("job_id", full.alias("f"), simple.alias("s")).select("job_id", "f.passed", "f.reason", F.col("s.passed").alias("passed_simple"), F.col("s.reason").alias("reason_simple"))


@query(f"""with c as (select job_id, sum(length(text)) as n, max(total_pages) as pages from ocr_chunks where text is not null group by job_id),
           m as (select job_id, sum(length({_strip('summary_text')})) as s from summary_results where summary_text is not null group by job_id),
           g as (select job_id, greatest(floor(n * 0.01)::bigint, case when coalesce(pages, 0) > 50 or n > 100000 then 600 else 200 end) as target, s from c join m using (job_id))
           select job_id, target, round(least(s / target, 1.0), 3) as length_score, least(s / target, 1.0) >= 0.75 as ok from g""")
def length_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a job's summaries are long enough for its text."""
    c = table(spark, sf_dir, "ocr_chunks").filter("text is not null").groupBy("job_id").agg(F.sum(F.length("text")).alias("n"), F.max("total_pages").alias("pages"))
    m = table(spark, sf_dir, "summary_results").filter("summary_text is not null").groupBy("job_id").agg(F.sum(F.length(X.strip("summary_text"))).alias("s"))
    return c.join(m, "job_id").select("job_id", summaries.length_gate(F.col("n"), F.col("s"), F.col("pages")).alias("g")).select("job_id", "g.*")


@query()
def structured_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents summarised at once or in windows, as their figures ask for."""
    return pipeline.routed(_documents(spark, sf_dir).filter("text is not null"), "doc_id", "text")


@query()
def summary_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every medical summary as sections with claims and the evidence of its job."""
    docs = table(spark, sf_dir, "test_summaries").filter("medical_summary is not null").select("summary_id", "job_id", F.col("medical_summary").alias("text"))
    sources = table(spark, sf_dir, "evidence_spans").select("job_id", F.col("span_key").alias("source_no"), "page", F.col("text_snippet").alias("text"))
    return pipeline.contract(docs, sources, "summary_id", "text", "job_id")


def _bullets_sql(field: str | None, fallback: str) -> str:
    if field is None:
        return q(f"- {fallback}")
    items = f"list_filter(list_transform(string_split({field}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '')"
    return f"case when len(coalesce({items}, [])) > 0 then array_to_string(list_transform({items}, lambda x: '- ' || x), chr(10)) else {q('- ' + fallback)} end"


_LISTED = {"diagnoses": "diagnoses_list", "healthcare_providers": "providers_list", "medications": "medications_list"}
_LAYOUT = " || chr(10) || chr(10) || ".join(f"{q(title + ':')} || chr(10) || {_bullets_sql(_LISTED.get(slug), 'Not documented.')}" for slug, title in L.HEADINGS)


@query(f"select summary_id, {_LAYOUT} as summary from test_summaries")
def headed_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat summaries in the fixed layout."""
    d = table(spark, sf_dir, "test_summaries")
    fields = {slug: F.split(F.col(c), "\n") for slug, c in _LISTED.items()}
    return d.select("summary_id", summaries.layout_text(summaries.fixed_layout(fields, {"diagnoses": "Not documented."})).alias("summary"))


# --- jobs ---------------------------------------------------------------------

_HISTORY = "(select job_id, u.seq - 1 as seq, u.h.status as status, u.h.stage as stage, u.h.message as message, u.h.timestamp as timestamp from (select job_id, unnest(list_transform(history, lambda h, i: {'seq': i, 'h': h})) as u from pipeline_jobs where history is not null))"


@query(f"select job_id, status, stage, timestamp, n as events from (select *, count(*) over (partition by job_id) as n, row_number() over (partition by job_id order by timestamp desc, seq desc) as rn from {_HISTORY}) where rn = 1")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each job."""
    return jobs.latest_state(jobs.history_events(table(spark, sf_dir, "pipeline_jobs")), "job_id", "timestamp", "seq", ["status", "stage"])


@query(f"""select job_id, seq, status, stage from (select *, lag(status) over w as s0, lag(stage) over w as g0, row_number() over w as rn from {_HISTORY} window w as (partition by job_id order by seq))
           where rn = 1 or status is distinct from s0 or stage is distinct from g0""")
def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories without repeated entries."""
    e = jobs.history_events(table(spark, sf_dir, "pipeline_jobs"))
    return jobs.without_repeats(e, "job_id", "seq", ["status", "stage"]).select("job_id", "seq", "status", "stage")


@query("""with c as (select user_id, event_type, count(*) as n from events where event_type is not null group by user_id, event_type)
          select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as counters from c group by user_id""")
def event_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of event happened to each key."""
    m = jobs.counter_map(table(spark, sf_dir, "events"), "user_id", "event_type")
    return m.select("user_id", F.array_join(F.transform(F.map_entries("counters"), lambda e: F.concat(e.key, F.lit("="), e.value.cast("string"))), ",").alias("counters"))


@query("""select time_bucket(interval '5 minutes', ts) as window_start, event_type, count(*) as n from events group by 1, 2""")
def events_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind in windows of five minutes."""
    return jobs.status_counts(table(spark, sf_dir, "events"), "ts", "event_type", "5 minutes")


@query("""select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95 from events where value is not null group by 1, 2""")
def stage_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 95th percentile by stage and hour."""
    return jobs.latency_quantiles(table(spark, sf_dir, "events"), "ts", "event_type", "value", "1 hour")


@query("""with w as (select time_bucket(interval '1 hour', ts) as window_start, count_if(event_type = 'purchase') as good, count_if(event_type = 'click') as bad from events group by 1)
          select window_start, good, bad, case when good + bad > 0 then round(good / (good + bad), 6) end as share, coalesce(case when good + bad > 0 then good / (good + bad) end < 0.995, false) as breach from w""")
def success_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of good events by hour against its objective."""
    return jobs.rate_windows(table(spark, sf_dir, "events"), "ts", F.col("event_type") == "purchase", F.col("event_type") == "click", "1 hour")


@query("""select user_id, gap_start, gap_end from (select user_id, ts as gap_start, lead(ts) over (partition by user_id order by ts) as gap_end from events) where gap_end > gap_start + interval '2 days'""")
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of more than two days by key."""
    return jobs.absences(table(spark, sf_dir, "events"), "user_id", "ts", "2 days")


@query("select source_event_id, count(*) as n from ocr_chunks where source_event_id is not null group by source_event_id having count(*) > 1")
def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source events that more than one chunk message names."""
    return jobs.repeated_values(table(spark, sf_dir, "ocr_chunks"), "source_event_id")


@query("""with k as (select lower(trim(job_id)) || '|' || lower(trim(chunk_id)) as key, delivery_id, received_at from ocr_chunks where job_id is not null and chunk_id is not null),
          o as (select lower(trim(job_id)) || '|' || lower(trim(chunk_id)) as key from summary_results where job_id is not null and chunk_id is not null)
          select key, arg_min(delivery_id, {'r': received_at, 'd': delivery_id}) as delivery_id from k where key not in (select key from o) group by key""")
def unanswered_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks without a result, by their first delivery."""
    key = F.concat_ws("|", F.lower(F.trim("job_id")), F.lower(F.trim("chunk_id"))).alias("key")
    both = "job_id is not null and chunk_id is not null"
    incoming = table(spark, sf_dir, "ocr_chunks").filter(both).select(key, "received_at", "delivery_id")
    return jobs.new_keys(incoming, table(spark, sf_dir, "summary_results").filter(both).select(key), "key", ["received_at", "delivery_id"]).select("key", "delivery_id")


@query("""select bucket, count(*) as total, count_if(coalesce(status = 'COMPLETED', false)) as passed, count_if(not coalesce(status = 'COMPLETED', false)) as failed,
          round(avg(coalesce(status = 'COMPLETED', false)::int), 4) as success_rate, bool_and(coalesce(status = 'COMPLETED', false)) as ok from pipeline_jobs group by bucket""")
def run_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed jobs by bucket."""
    return jobs.run_report(table(spark, sf_dir, "pipeline_jobs"), F.col("status") == "COMPLETED", ["bucket"])


_SEED = "bucket || '/' || object_name || '@' || coalesce(nullif(generation, ''), 'nogeneration')"


@query(f"select job_id, {_SEED} || '#' || coalesce(nullif(substr({_replace('lower(md5_hash)', '[^\\p{L}\\p{N}]', '')}, 1, 32), ''), substr(sha256({_SEED}), 1, 32)) as dedupe_key from pipeline_jobs")
def job_dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that tell whether an object was taken in before."""
    d = table(spark, sf_dir, "pipeline_jobs")
    return d.select("job_id", K.dedupe_key(F.col("bucket"), F.col("object_name"), F.col("generation"), F.col("md5_hash")).alias("dedupe_key"))


@query("select delivery_id, job_id from ocr_chunks c where not exists (select 1 from pipeline_jobs p where p.job_id = c.job_id)")
def chunks_of_unknown_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows whose job id isn't known as written."""
    return table(spark, sf_dir, "ocr_chunks").select("delivery_id", "job_id").join(table(spark, sf_dir, "pipeline_jobs").select("job_id"), "job_id", "left_anti").select("delivery_id", "job_id")


@query("""select delivery_id, (row_number() over w - 1)::int as chunk_index, count(*) over (partition by job_id) as total_chunks, row_number() over w = count(*) over (partition by job_id) as is_last_chunk from ocr_chunks where job_id is not null window w as (partition by job_id order by delivery_id)""")
def chunk_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk's place in its job, the number of chunks, and the last one marked."""
    d = table(spark, sf_dir, "ocr_chunks").filter("job_id is not null").select("delivery_id", "job_id")
    return jobs.chunk_flags(d, ["job_id"], ["delivery_id"]).select("delivery_id", "chunk_index", "total_chunks", "is_last_chunk")


@query("select status, count(*) as n from pipeline_jobs group by status")
def status_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by status."""
    return jobs.outcome_counts(table(spark, sf_dir, "pipeline_jobs"), "status")


@query()
def section_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections as canonical JSON."""
    d = table(spark, sf_dir, "summary_sections").select("section_id", "slug", "title", "content", "ordinal", "kind", "extra")
    return d.select("section_id", canonical_json(d).alias("json"))


# --- streams, run to the end of what there is ----------------------------------


def _drained(stream: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Run a stream over the files there are, in update mode, into a sink by key, and read that.

    A batch's rows replace those that earlier batches gave for the same keys; a
    batch that is run again overwrites itself.
    """
    spark = stream.sparkSession
    path = scratch.new_dir(spark, label)

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(keep).trigger(availableNow=True).start()
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(f"{path}/rows")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in stream.columns))


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # as a pattern the path may be a file as well as a folder
    stream = streams.poll_files(spark, f"{sf_dir}/{name}.parque[t]", table(spark, sf_dir, name).schema, "parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind and hour, counted by a stream."""
    return _drained(streams.windowed_counts(_stream(spark, sf_dir, "events"), "ts", ["event_type"], "1 hour", "60 days"), ["window_start", "event_type"], "windows")


@query("select user_id, max(ts) as ts, max_by(event_type, {'ts': ts, 'e': event_type}) as event_type, count(*) as events from events group by user_id")
def streamed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each key, folded by a stream."""
    return _drained(streams.latest_states(_stream(spark, sf_dir, "events"), "user_id", "ts", ["event_type"]), ["user_id"], "states")
