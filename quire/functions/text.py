"""Text functions as expressions: every one takes and gives a Column and stays in the JVM.

Unless stated otherwise null gives null, an empty text an empty one, and texts
of any length are read whole.  Lines end at any of the usual line separators.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import lexicons as L

LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
WORD = r"[a-z0-9']+"
SPACE = "[\\s ]"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without white space at either end."""
    return strip_chars(c, SPACE)


def strip_chars(c: str | Column, chars: str) -> Column:
    """Without the given characters (a regex class) at either end."""
    return F.regexp_replace(_col(c), f"^{chars}+|{chars}+$", "")


def lines(c: str | Column) -> Column:
    return F.split(_col(c), LINE_END)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def any_of(phrases: tuple[str, ...]) -> str:
    """A pattern of the phrases that shares their beginnings, so that few branches are tried at each place."""
    tree: dict = {}
    for p in phrases:
        at = tree
        for ch in p:
            at = at.setdefault(ch, {})
        at[""] = {}

    def pattern(node: dict) -> str:
        branches = [_quote(ch) + pattern(below) for ch, below in sorted(node.items()) if ch]
        if not branches:
            return ""
        if "" in node:
            return ""  # a shorter phrase ends here and is enough
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return pattern(tree)


def contains_any(c: str | Column, phrases: tuple[str, ...]) -> Column:
    """Whether one of the phrases occurs (one pattern, compiled once)."""
    return _col(c).rlike(any_of(phrases))


def _quote(phrase: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$*+?()[]{}|" else ch for ch in phrase)


def occurrences(c: str | Column, phrases: tuple[str, ...]) -> Column:
    """How often the phrases occur, each counted for itself without overlaps.

    Where no phrase begins another or overlaps itself, one pass looks for the
    places at which any of them starts.
    """
    c = _col(c)
    begins = any(a != b and b.startswith(a) for a in phrases for b in phrases)
    if not begins and not any(p.endswith(p[:n]) for p in phrases for n in range(1, len(p))):
        return F.regexp_count(c, F.lit(f"(?={any_of(phrases)})"))
    return reduce(lambda a, b: a + b, [((F.length(c) - F.length(F.replace(c, F.lit(p), F.lit("")))) / len(p)).cast("int") for p in phrases])


def phrases_present(c: str | Column, phrases: tuple[str, ...]) -> Column:
    """How many of the phrases occur."""
    c = _col(c)
    return reduce(lambda a, b: a + b, [c.contains(p).cast("int") for p in phrases])


def letters(c: str | Column) -> Column:
    return F.length(F.regexp_replace(_col(c), r"[^\p{L}]", ""))


def digits(c: str | Column) -> Column:
    return F.length(F.regexp_replace(_col(c), r"[^0-9]", ""))


def non_space(c: str | Column) -> Column:
    return F.length(F.regexp_replace(_col(c), SPACE, ""))


# --- cleaning -----------------------------------------------------------------


def clean_text(c: str | Column) -> Column:
    """Control characters to spaces, white space collapsed, ends stripped."""
    c = F.regexp_replace(_col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    return F.trim(F.regexp_replace(c, SPACE + "+", " "))


def clean_paragraphs(c: str | Column) -> Column:
    """As :func:`clean_text` within lines; lines run on, empty lines part paragraphs."""
    c = F.regexp_replace(_col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    tidy = F.array_join(F.transform(lines(c), lambda x: F.trim(F.regexp_replace(x, SPACE + "+", " "))), "\n")
    parts = F.filter(F.split(tidy, r"\n{2,}"), lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" "))) != "")
    return F.array_join(F.transform(parts, lambda x: F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))), "\n\n")


def clean_page(c: str | Column) -> Column:
    """Blanks squeezed within lines, empty lines dropped."""
    tidy = F.transform(lines(c), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(tidy, lambda x: x != ""), "\n")


def is_noise_header(c: str | Column) -> Column:
    """Whether a line comes from a fax, a bill, an affidavit or instructions."""
    return _col(c).rlike("(?i)(?:" + "|".join(f"(?:{p})" for p in L.NOISE_LINES) + ")")


def strip_noise(c: str | Column) -> Column:
    """Without noise lines and table rules; empty lines squeezed to one."""
    tidy = F.transform(lines(c), lambda x: strip(F.regexp_replace(x, L.TABLE_RULES, " ")))
    kept = F.array_join(F.filter(tidy, lambda x: ~is_noise_header(x)), "\n")
    kept = F.regexp_replace(kept, r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(kept, r"\n{3,}", "\n\n"))


def clean_scan(c: str | Column) -> Column:
    """:func:`strip_noise`, on one line."""
    return strip(F.regexp_replace(strip_noise(c), SPACE + "+", " "))


def prepare_input(c: str | Column) -> Column:
    """Paragraph by paragraph :func:`clean_scan`, or :func:`clean_text` where that leaves nothing."""
    parts = F.split(clean_paragraph_marks(c), r"\n\s*\n")
    tidy = F.transform(parts, lambda p: F.coalesce(F.nullif(clean_scan(p), F.lit("")), clean_text(p)))
    return clean_paragraphs(F.array_join(F.filter(tidy, lambda p: p != ""), "\n\n"))


def clean_paragraph_marks(c: str | Column) -> Column:
    return F.regexp_replace(_col(c), r"\r\n?", "\n")


def prune_admin(c: str | Column) -> Column:
    """Empty for consent and warning lines; else without a leading "reason for visit" label and edge marks."""
    tidy = strip(F.regexp_replace(_col(c), SPACE + "+", " "))
    rest = strip_chars(F.regexp_replace(tidy, L.REASON_PREFIX, ""), "[:\\- —]")
    return F.when(tidy.rlike(L.CONSENT_LINE) | contains_any(F.lower(tidy), L.WARNING_PHRASES), F.lit("")).otherwise(rest)


def rewrite_keywords(c: str | Column) -> Column:
    """Empty words spelt out."""
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), L.KEYWORD_REWRITES, _col(c))


def has_legal_phrase(c: str | Column) -> Column:
    return contains_any(F.lower(_col(c)), L.LEGAL_PHRASES)


def is_vitals_table(c: str | Column) -> Column:
    """At least two names of vital signs and four digits."""
    return (phrases_present(F.lower(_col(c)), L.VITAL_TOKENS) >= 2) & (digits(c) >= 4)


def is_placeholder(c: str | Column) -> Column:
    return strip(c).rlike(L.PLACEHOLDER)


def is_section_placeholder(c: str | Column) -> Column:
    low = F.regexp_replace(F.lower(strip(c)), r"\.+$", "")
    return (low == "") | low.isin(*L.SECTION_PLACEHOLDERS)


def is_noise_line(c: str | Column, allow_numeric: bool = False) -> Column:
    """Whether a line says nothing: blank, ruled, over 340 characters, legal, without letters, mostly digits, or about risks and instructions."""
    s = strip(c)
    low, n_letters, n_digits = F.lower(s), letters(s), digits(s)
    words = F.size(F.split(s, r"\s+"))
    rules = [
        s == "",
        (F.length(s) - F.length(F.replace(s, F.lit("="), F.lit("")))) >= 5,
        F.length(s) > 340,
        has_legal_phrase(s),
        n_letters == 0,
        F.lit(False) if allow_numeric else n_digits > n_letters * 2,
        (words <= 2) & (n_digits > n_letters),
        low.contains("risk") & contains_any(low, ("procedure", "injection", "hazard", "complication", "nerve")),
        contains_any(low, ("discharge instruction", "patient education", "life threatening emergency", "no heavy lifting")),
    ]
    return reduce(lambda a, b: a | b, rules)


def strip_noise_lines(c: str | Column) -> Column:
    """Without legal, consent, instruction, vitals-table and nearly letterless lines."""

    def noise(line: Column) -> Column:
        s = strip(line)
        low = F.lower(s)
        commas = F.length(low) - F.length(F.replace(low, F.lit(","), F.lit("")))
        return (s != "") & (
            has_legal_phrase(s)
            | (s.rlike(L.REASON_ONLY_LINE) & (F.upper(s) == s))
            | s.rlike(L.CONSENT_LINE)
            | contains_any(low, L.FINAL_NOISE)
            | (low.contains("call") & low.contains("immediately"))
            | ((commas >= 4) & contains_any(low, ("risk", "hazard")))
            | (letters(s) < 4)
            | is_vitals_table(s)
        )

    kept = F.transform(F.filter(lines(c), lambda x: ~noise(x)), lambda x: F.when(strip(x) == "", F.lit("")).otherwise(x))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"\n+$", "")


def strip_headings(c: str | Column) -> Column:
    """Without lines that are a heading only; other lines stripped, empty ones kept."""
    return F.array_join(F.filter(F.transform(lines(c), strip), lambda x: ~x.rlike(L.HEADING_ONLY)), "\n")


# --- counts and tokens --------------------------------------------------------


def tokens_floor(c: str | Column) -> Column:
    """Token estimate of the chunker: characters / 4 rounded down, at least 1; 0 if empty."""
    n = F.length(_col(c))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def tokens_ceil(c: str | Column) -> Column:
    """Token estimate of windows: characters / 4 rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(_col(c)) / 4).cast("int"))


def tokens_words(c: str | Column) -> Column:
    """Token estimate of routing: the larger of characters / 4 and words x 1.1, rounded up."""
    tidy = clean_paragraphs(c)
    words = F.size(F.filter(F.split(tidy, r"\s+"), lambda w: w != ""))
    return F.when(tidy == "", 0).otherwise(F.greatest(F.lit(1), F.ceil(F.length(tidy) / 4), F.ceil(words * F.lit(11) / 10)).cast("int"))


def sentences(c: str | Column) -> Column:
    """Segments that end in . ! or ? and white space, stripped, without empty ones."""
    return F.filter(F.transform(F.split(strip(c), r"(?<=[.!?])\s+"), strip), lambda s: s != "")


def word_tokens(c: str | Column) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def content_tokens(c: str | Column) -> Column:
    """Word tokens without stop words and numbers."""
    return F.filter(word_tokens(c), lambda t: ~t.isin(*L.STOPWORDS) & ~t.rlike("^[0-9]+$"))


def page_signature(c: str | Column) -> Column:
    """Distinct words of three letters and more, without stop words."""
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[a-z']+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(*L.PAGE_STOPWORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements; 0 if either set is empty."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / both)


def line_key(c: str | Column) -> Column:
    """Lower case, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^a-z0-9]+", " "))


def paragraph_count(c: str | Column) -> Column:
    """Parts between empty lines that have text."""
    return F.size(F.filter(F.split(_col(c), r"\n\s*\n"), lambda p: strip(p) != ""))


def heading_count(c: str | Column) -> Column:
    return F.size(F.filter(lines(c), lambda x: x.rlike(L.HEADING_ONLY)))


def line_score(c: str | Column, keywords: tuple[str, ...] = ()) -> Column:
    """Worth of a line: hits and letters count for it, digits, length, risks and instructions against it.

    Without keywords no hit is counted.
    """
    c = _col(c)
    low = F.lower(c)
    hits = phrases_present(low, keywords) if keywords else F.lit(0)
    over = F.greatest(F.lit(0), F.length(c) - 220) / 160
    risk = F.when(contains_any(low, ("risk", "hazard", "complication")), 4).otherwise(0)
    teach = F.when(contains_any(low, ("instruction", "education")), 3).otherwise(0)
    return hits * 6 + letters(c) / 140 - digits(c) * F.lit(0.2) - over - risk - teach


# --- sentences made of facts ---------------------------------------------------


def bullets(items: Column, fallback: str) -> Column:
    """``- x`` a line for every non-blank item, or the fallback."""
    tidy = F.filter(F.transform(items, strip), lambda x: x != "")
    return F.when(F.size(tidy) > 0, F.array_join(F.transform(tidy, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise(F.lit(f"- {fallback}"))


def vitals_sentence(c: str | Column) -> Column:
    """The first value of each vital sign in one sentence, null if there is none."""
    c = _col(c)

    def value(name: str, group: int = 1) -> Column:
        return F.nullif(F.regexp_extract(c, L.VITALS[name], group), F.lit(""))

    unit = F.coalesce(F.replace(F.upper(value("temperature", 2)), F.lit("°"), F.lit("")), F.lit("F"))
    parts = F.array_compact(
        F.array(
            F.concat(F.lit("BP "), value("blood_pressure"), F.lit(" mmHg")),
            F.concat(F.lit("HR "), value("heart_rate"), F.lit(" bpm")),
            F.concat(F.lit("RR "), value("resp_rate"), F.lit("/min")),
            F.concat(F.lit("Temp "), value("temperature"), F.lit("°"), unit),
            F.concat(F.lit("SpO2 "), value("spo2"), F.lit("%")),
        )
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit("Vitals: "), F.array_join(parts, ", ")))


def complaint_labels(c: str | Column) -> Column:
    """Labels of the common complaints a text mentions, in fixed order."""
    return F.array_compact(F.array(*(F.when(_col(c).rlike(p), F.lit(label)) for p, label in L.DIAGNOSES)))


def min_summary_chars(source_chars: str | Column, ratio: float = 0.005, floor: int = 300) -> Column:
    """Least length of a summary: a share of the source, at least ``floor``."""
    return F.greatest(F.lit(floor), F.floor(_col(source_chars) * ratio).cast("int"))
