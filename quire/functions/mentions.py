"""People and medications in clinical text, error classes and traces, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _col, clean_text, contains_any, has_legal_phrase, lines, strip, strip_chars

# Fixed values -----------------------------------------------------------------

SIGNATURE_CUES = (
    "respectfully", "sincerely", "regards", "thank you", "signed electronically", "electronically signed", "dictated by", "attending physician", "attending provider",
    "provider signature", "provider:",
)
# repetitions are bounded: unbounded groups recurse in the regex engine and overflow its stack on long lines
SIGNATURE_NAME = (
    r"(?:\b((?i:dr\.?|doctor))\s+)?\b([A-Z][A-Za-z.'-]+(?:\s+(?:[A-Z][A-Za-z.'-]+|[A-Z]\.)){1,3})(?:,\s*((?i:M\.?D\.?|D\.?O\.?|DO|PA-C|NP|ARNP|FNP|DNP|DC|DPM))\b\.?)?"
)
PROVIDER_NAME = (
    r"^(?:(?:Dr\.?|Doctor|[A-Z]{2,})\s+)?(?:[A-Z][A-Za-z'.-]+|[A-Z]\.)(?:\s+(?:[A-Z][A-Za-z'.-]+|[A-Z]\.|Jr\.?|Sr\.?|[A-Z]{2,})){1,4}"
    r"(?:,\s*(?:M\.?D\.?|D\.?O\.?|PA-C|NP|ARNP|FNP|DNP|DC|DPM|FACS|FAANS))?$"
)
PROVIDER_AFFIXES = ("dr", "doctor", "facs", "faans", "md", "m", "d", "do", "pa", "c", "np", "arnp", "fnp", "dnp", "dc", "dpm", "jr", "sr")
PROVIDER_NOT_NAMES = (
    "if", "not", "met", "and", "read", "by", "provider", "providers", "signatures", "signature", "during", "should", "unless", "please", "patient", "care", "procedure", "office", "visit",
    "physical", "therapy", "current", "address", "referrals", "dressing", "packing", "red", "oak",
)
PROVIDER_ADMIN = (
    "provider at", "providers at", "health care provider", "healthcare provider", "drive them home", "driver license", "phone:", "fax:", "release of information",
    "assignment of recovery", "authorization", "pregnant", "provider signature",
)
MEDICATION = (
    r"\b(?:[A-Za-z]+\s+\d+(?:\.\d+)?\s*(?i:mg|mcg|g|ml)(?!/)"
    r"|(?i:ibuprofen|cyclobenzaprine|acetaminophen|lisinopril|hydrocodone|tramadol|gabapentin|naproxen|lidocaine|marcaine|kenalog|toradol|dexamethasone|biofreeze))\b"
)
MEDICATION_REJECTED = (
    "keep an active list of medications", "final active medications list", "please fill your prescriptions", "take all medications as directed", "operate a motor vehicle",
    "medication will be stopped", "medication list was updated", "share with other providers", "bring my medication bottle", "use my medications correctly",
    "it explains how i receive my medications", "i will not go to the er", "i will not use alcohol", "i agree to take my medication", "my providers may discuss my medications",
    "resume diet", "see medication reconciliation form", "referral", "evaluate", "appointment", "follow up medical evaluation", "symptoms are relieved", "oxygen therapy",
    "physical therapy", "occupational therapy", "the patient noted the pain medication", "after correct needle placement", "ingredients:", "blood sugar remains above",
)
RETRYABLE_STATUS = (429, 500, 502, 503, 504)
RETRYABLE_WORDS = ("429", "unavailable", "resource_exhausted", "internal")

# ------------------------------------------------------------------------------


def is_provider_name(c: str | Column) -> Column:
    """Whether a text has the form of a person's name with optional title and degree: two to four names, no figures."""
    s = strip_chars(F.regexp_replace(strip_chars(clean_text(c), "[ ,;:-]"), r"(?i)^(?:provider(?:'s)?\s+signatures?:?|provider:)\s*", ""), "[ ,;:-]")
    names = F.filter(F.regexp_extract_all(F.lower(s), F.lit(r"[a-z][a-z'.-]*"), F.lit(0)), lambda t: ~F.regexp_replace(t, r"\.", "").isin(*PROVIDER_AFFIXES))
    return (
        (F.length(s) > 0) & (F.length(s) <= 80) & ~s.rlike(r"[0-9:/|()]") & ~has_legal_phrase(s) & ~contains_any(F.lower(s), PROVIDER_ADMIN) & s.rlike(PROVIDER_NAME)
        & (F.size(names) >= 2) & (F.size(names) <= 4) & ~F.arrays_overlap(names, F.array(*(F.lit(w) for w in PROVIDER_NOT_NAMES)))
    )


def is_medication_line(c: str | Column) -> Column:
    """Whether a line names a medication: a dose or a known name, 24 words at most, no instructions."""
    s = strip_chars(clean_text(c), "[ ,;:-]")
    low = F.lower(s)
    other = low.contains("provider") & ~low.contains("mg") & ~low.contains("therapy")
    return (F.length(s) > 0) & (F.size(F.split(s, r"\s+")) <= 24) & ~has_legal_phrase(s) & ~contains_any(low, MEDICATION_REJECTED) & ~other & s.rlike(MEDICATION)


def signature_names(c: str | Column) -> Column:
    """Names in signatures, with title or degree, formatted, first mentions only; a line with a cue is read together with the next.

    The first name is the primary provider.
    """
    rows = F.filter(F.transform(lines(c), lambda x: strip(x)), lambda x: x != "")

    def with_next(x: Column, i: Column) -> Column:
        after = F.get(rows, i + 1)
        cue = contains_any(F.lower(x), SIGNATURE_CUES) | F.coalesce(F.lower(after).isin(*SIGNATURE_CUES), F.lit(False))
        return F.when(cue & after.isNotNull(), F.concat(x, F.lit(" "), after)).otherwise(x)

    def found(x: Column) -> Column:
        parts = F.arrays_zip(*(F.regexp_extract_all(x, F.lit(SIGNATURE_NAME), F.lit(g)).alias(n) for g, n in ((1, "title"), (2, "name"), (3, "degree"))))
        return F.transform(F.filter(parts, lambda p: (p.title != "") | (p.degree != "")), _formatted)

    return F.array_distinct(F.flatten(F.transform(F.transform(rows, with_next), found)))


def _formatted(p: Column) -> Column:
    plain = F.regexp_replace(F.upper(p.degree), r"\.", "")
    degree = F.when(plain == "MD", "M.D.").when(plain == "DO", "D.O.").otherwise(F.upper(p.degree))
    name = F.regexp_replace(F.regexp_replace(p["name"], r"\s+", " "), ",+$", "")
    doctor = (p.title != "") | (degree.isin("M.D.", "D.O.") & ~F.lower(name).startswith("dr "))
    return F.concat(F.when(doctor, F.lit("Dr. ")).otherwise(F.lit("")), name, F.when(degree != "", F.concat(F.lit(", "), degree)).otherwise(F.lit("")))


def is_retryable(status: Column, message: Column) -> Column:
    """Whether a call may be tried again: by its HTTP status or message; page limits may not."""
    low = F.lower(F.coalesce(message, F.lit("")))
    limit = contains_any(low, ("page_limit_exceeded", "page limit"))
    return ~limit & (F.coalesce(status.isin(*RETRYABLE_STATUS), F.lit(False)) | contains_any(low, RETRYABLE_WORDS))


def safe_trace(c: str | Column) -> Column:
    """An exception's trace with its frames and types and without messages."""
    frame = lambda x: x.startswith("Traceback") | x.startswith("  File ") | x.startswith("During handling of the above exception") | x.startswith("The above exception was the direct cause")
    kind = r"^([A-Za-z0-9_.]+): .*$"
    kept = F.transform(lines(c), lambda x: F.when(frame(x), x).when(x.rlike(kind), F.regexp_extract(x, kind, 1)))
    return F.array_join(F.filter(kept, lambda x: x.isNotNull()), "\n")


def bounded(c: str | Column, most_chars: int) -> Column:
    """A text without control characters, cut at six times ``most_chars``."""
    return F.substring(F.regexp_replace(_col(c), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), 1, 6 * most_chars)


def prompt(doc_type: Column, max_words: Column) -> Column:
    """The instruction that goes with a text to an external summariser."""
    return F.format_string("Summarise this %s in at most %d words. Keep findings, plan and medications.", F.coalesce(doc_type, F.lit("document")), F.coalesce(max_words, F.lit(200)))


def recognition_route(pages: Column, size_bytes: Column, most_pages: int = 30, most_bytes: int = 40 * 1024 * 1024, split_pages: int = 199) -> Column:
    """How a document would be recognised: at once, split, or in a batch."""
    return F.when((pages <= most_pages) & (size_bytes <= most_bytes), "sync").when(pages >= split_pages, "split").otherwise("batch")


def merged_fragments(fragments: Column) -> Column:
    """Fragments that go on in lower case appended to one that doesn't end a sentence."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        goes_on = (F.size(acc) > 0) & ~last.rlike(r"[.!?:]$") & x.rlike(r"^\p{Ll}")
        return F.when(goes_on, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(last, F.lit(" "), x)))).otherwise(F.concat(acc, F.array(x)))

    tidy = F.filter(F.transform(fragments, lambda x: clean_text(x)), lambda x: x != "")
    return F.aggregate(tidy, F.array().cast("array<string>"), step)


def joined_short_sentences(found: Column) -> Column:
    """Sentences of one or two words carried into the next one; a rest joins the last."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("carry"))

    def step(acc: Column, x: Column) -> Column:
        whole = strip(F.concat_ws(" ", F.nullif(acc.carry, F.lit("")), x))
        words = F.size(F.split(whole, r"\s+"))
        short = (words <= 2) & (F.length(whole) <= 32)
        open_end = (words <= 2) & ~whole.rlike(r"[.!?]$")
        carried = F.struct(acc.done.alias("done"), F.regexp_replace(whole, r"\.+$", "").alias("carry"))
        kept = F.struct(acc.done.alias("done"), whole.alias("carry"))
        return F.when(short, carried).when(open_end, kept).otherwise(F.struct(F.concat(acc.done, F.array(whole)).alias("done"), F.lit("").alias("carry")))

    def end(acc: Column) -> Column:
        n = F.size(acc.done)
        return F.when(acc.carry == "", acc.done).when(n == 0, F.array(acc.carry)).otherwise(F.concat(F.slice(acc.done, 1, n - 1), F.array(F.concat(F.element_at(acc.done, -1), F.lit(" "), acc.carry))))

    return F.aggregate(found, start, step, end)

