"""Values that hold what a template, a layout or a web server left behind.

Positive-unlabelled naive Bayes: a small set of trusted residue (placeholders in
the usual notations, filler, error pages, notices that scripts are required) is
the only labelled class; passages of the corpus are unlabelled, and
expectation-maximization settles how much of them is residue too: the share of
residue (the class prior) and the features' odds are estimated in turn with the
passages' posteriors.  A passage's score is that of its best run of tokens, so
residue inside a longer passage counts, and a value is residue if one of its
passages is.

Scale: every passage of every value takes part.  One narrow pass counts equal
passages inside its task and writes their feature slots; a round of the
expectation-maximization reads these integers, works on whole batches at once
and passes on sums by slot, of which there are ``FEATURES`` at most.  The model
is a table of that size; scoring is one narrow stage over all rows.
"""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.scratch import stage

FEATURES = 1 << 18
#: Rounds of the expectation-maximization, and the share of residue it starts from.
ROUNDS, PRIOR = 5, 0.01
#: Pseudo-observations that draw a feature's odds to those of the classes, so that features nobody has seen say nothing.
PULL = 4.0
#: Different passages that a task holds before it passes their counts on.
HELD_PASSAGES = 100_000
#: Log-odds from which on a passage is residue.
THRESHOLD = 0.0
#: Log-odds that one token, or one placeholder, can add at most.
MOST_TOKEN, MOST_PLACEHOLDER = 4.0, 8.0

#: Notations of placeholders; what stands inside is their name.
NOTATIONS = {
    "double brace": re.compile(r"\{\{\s*([^{}\n]{0,60}?)\s*\}\}"),
    "statement": re.compile(r"\{%\s*([^%\n]{0,60}?)\s*%\}"),
    "dollar": re.compile(r"\$\{\s*([^{}\n]{0,60}?)\s*\}"),
    "percent": re.compile(r"%\(\s*([^()\n]{0,60}?)\s*\)s"),
    "server": re.compile(r"<%=?\s*([^%\n]{0,60}?)\s*%>"),
    "double angle": re.compile(r"<<\s*([^<>\n]{0,60}?)\s*>>"),
    "double square": re.compile(r"\[\[\s*([^\[\]\n]{0,60}?)\s*\]\]"),
    "double at": re.compile(r"@@\s*([^@\n]{0,60}?)\s*@@"),
    "double underscore": re.compile(r"(?<!\w)__\s*([^\W_][^\n]{0,50}?)\s*__(?!\w)"),
    "hash": re.compile(r"(?<!\w)#([^\W\d_][^#\n]{0,50}?)#"),
    "tag": re.compile(r"</?(?:html|head|title|body|p|div|span|br|h[1-6]|b|i|a|noscript|script|center|hr)\b[^<>\n]{0,80}>", re.I),
    "angle": re.compile(r"<\s*([^\W\d_][^<>\n]{0,50}?)\s*>"),
    "square": re.compile(r"\[\s*([^\[\]\n]{1,60}?)\s*\]"),
    "brace": re.compile(r"\{\s*([^{}\n]{1,60}?)\s*\}"),
}
_MARK = re.compile(r"[{}\[\]<>$%@_#]")
_ANY = re.compile("|".join(f"(?P<n{i}>{p.pattern})" for i, p in enumerate(NOTATIONS.values())), re.I)
_NAMES = list(NOTATIONS)
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_PASSAGE = re.compile(r"\n+|(?<=[.!?])\s+")

#: Names of fields as templates for clinical and billing summaries have them (fixed values).
FIELD_NAMES = (
    "patient name", "first name", "last name", "dob", "date of birth", "visit date", "date", "diagnosis", "diagnoses", "medication",
    "medications", "dosage", "provider", "physician name", "facility", "insurer", "policy number", "amount due", "total", "cpt code", "icd code",
    "plan of care", "reason", "reason for visit", "summary", "signature", "address", "phone", "mrn", "age", "gender", "allergies", "notes",
)
#: Trusted wordings of filler, error pages and script notices (fixed values).
FILLER = (
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.",
    "Duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur.",
    "Vestibulum ante ipsum primis in faucibus orci luctus et ultrices posuere cubilia curae; fusce dapibus, tellus ac cursus commodo.",
    "Nulla vitae elit libero, a pharetra augue. Sapien ornare porta mattis, vitae libero tempor.",
    "Your text here", "Your text goes here.", "Enter text here", "Insert text here", "Text goes here", "Heading goes here", "Title goes here",
    "Placeholder text", "This is placeholder text.", "Sample text", "This is a sample paragraph, replace before release.", "Dummy text", "Dummy content",
    "Content coming soon", "Coming soon", "To be supplied by the author.", "Text to be supplied", "TODO: write this", "TODO", "FIXME: add content", "TBD", "Write this section",
    "Replace this text with your own.", "Remove before release.", "Used to fill the layout.", "blah blah blah", "foo bar baz", "asdf asdf qwer", "qwerty asdf", "xxxxx xxxx xxx", "test test test",
)
ERRORS = (
    "404 Not Found", "403 Forbidden", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "401 Unauthorized",
    "Error 404: the requested page was not found.", "The requested page could not be loaded.", "The page you requested does not exist.", "The page has been moved or deleted.",
    "The page you are looking for does not exist or has been moved.", "This page isn't working", "This site can't be reached.", "This site cannot be reached right now", "HTTP 500 returned by server", "Upstream connect error",
    "upstream request timeout", "Error while fetching the page", "An error occurred while processing your request.", "An unexpected error occurred.", "An unexpected error has occurred. Please try again later.",
    "Something went wrong.", "Oops! Something went wrong.", "Something went wrong on our end.", "Please try again later.", "Try again later", "Too many requests.", "Rate limit exceeded. Slow down and retry.", "Retry in 60 seconds.", "Your session has expired.", "Please sign in again.", "Please log in to continue.", "Access denied.", "Access to this resource is denied.", "Access to the requested resource was denied by the server.", "Access to this resource was denied.", "You do not have permission to access this page.",
    "The server is temporarily unavailable.", "The server is down for maintenance.", "Scheduled maintenance, check back soon.", "Service temporarily unavailable", "Internal error while rendering the page", "Traceback (most recent call last):", "NullPointerException", "undefined is not a function", "KeyError: 'name'",
    "Bad Gateway", "Gateway Timeout", "Not Found", "Service Unavailable", "Internal Server Error", "Forbidden", "Request id 0a1b2c", "Reference #18.2f", "incident id 7f3a", "trace id 9c0d",
)
SCRIPTS = (
    "Please enable JavaScript to continue.", "Please enable JavaScript to view this page.", "You need to enable JavaScript to run this app.", "JavaScript is disabled.", "JavaScript is required.", "This page requires JavaScript.", "This site requires JavaScript and cookies.",
    "Turn JavaScript on and reload the page.", "Turn on scripts in your browser.", "Scripts are disabled in your browser.", "Scripting must be enabled for this page to work.", "Activate scripts to see the content.", "Your browser is not supported.", "Your browser does not support JavaScript.", "Please update your browser.",
    "Update your browser to view this page.", "Cookies are disabled.", "Please enable cookies.", "Checking your browser before accessing the site.", "Checking your browser...", "noscript", "The app cannot start without scripts.", "Some parts of the page will not load.", "Reload the page to continue.", "Enable cookies and reload the page.",
)
#: Names of HTTP status codes (fixed values).
STATUS_NAMES = ("Bad Request", "Unauthorized", "Forbidden", "Not Found", "Request Timeout", "Too Many Requests", "Internal Server Error", "Bad Gateway", "Service Unavailable", "Gateway Timeout")
#: Trusted passages of shuffled dummy Latin.
LOREM_SEEDS = 120
_WRITE = {
    "double brace": "{{{{{}}}}}", "statement": "{{% if {} %}}", "dollar": "${{{}}}", "percent": "%({})s", "server": "<% {} %>", "double angle": "<<{}>>",
    "double square": "[[{}]]", "double at": "@@{}@@", "double underscore": "__{}__", "hash": "#{}#", "angle": "<{}>", "square": "[{}]", "brace": "{{{}}}",
}


def trusted() -> list[str]:
    """The labelled passages: every notation with every field name, and the wordings above."""
    out = list(itertools.chain(FILLER, ERRORS, SCRIPTS))
    for form in _WRITE.values():
        out += [form.format(name) for name in FIELD_NAMES]
    out += [f"[{verb} {name}{end}]" for name in FIELD_NAMES for verb, end in (("enter", ""), ("insert", " here"), ("your", ""))]
    out += [f"{code} {name}" for code in ("400", "404", "500") for name in STATUS_NAMES]
    rng = random.Random(3)
    stock = sorted({w.lower() for p in FILLER[:5] for w in _TOKEN.findall(p) if len(w) > 3})
    out += [" ".join(rng.choices(stock, k=rng.randint(6, 20))) for _ in range(LOREM_SEEDS)]
    out += ["<p>", "</p>", "<html><head><title>", "</title></head><body>", "</body></html>", "<div>", "<br>"] * 3
    return out


def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % FEATURES


_slots: dict[str, int] = {}


def _known(name: str) -> int:
    at = _slots.get(name)
    if at is None:
        if len(_slots) > 400_000:
            _slots.clear()
        at = _slots[name] = _slot(name)
    return at


def passages(text: str) -> list[str]:
    return [p for p in _PASSAGE.split(text) if p and not p.isspace()]


def units(passage: str) -> list[list[int]]:
    """Features of each token in order: words, word pairs and placeholders."""
    out: list[list[int]] = []
    previous = "^"

    def add_words(part: str) -> None:
        nonlocal previous
        for m in _TOKEN.finditer(part):
            w = re.sub(r"\d", "0", m.group().lower())
            if len(w) > 2 and len(set(w)) == 1 and w[0] != "0":
                w = "repeated letter"
            elif len(w) > 5 and any(c == "0" for c in w) and any(c != "0" for c in w):
                w = "mixed code"
            out.append([_known("w " + w), _known(f"b {previous} {w}")])
            previous = w

    at = 0
    for m in _ANY.finditer(passage) if _MARK.search(passage) else ():
        add_words(passage[at : m.start()])
        kind = next(i for i in range(len(_NAMES)) if m.group(f"n{i}") is not None)
        name = _NAMES[kind]
        inner = [re.sub(r"\d", "0", w) for w in _TOKEN.findall(m.group().lower().replace("_", " ")) if name != "tag"]
        out.append([_known("s " + name), *(_known("i " + w) for w in inner[:6]), _known(f"n {name} {len(inner)} {bool(inner) and inner[0].isdigit()}")])
        previous = "s " + name
        at = m.end()
    add_words(passage[at:])
    return out


def encode(passage: str) -> tuple[list[int], list[int]]:
    """Feature slots of all tokens, one after the other, and how many each token has."""
    us = units(passage)
    return [f for u in us for f in u], [len(u) for u in us]


def best_runs(odds: np.ndarray, slots: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Per passage the largest sum over consecutive tokens, 0 if all are negative.

    slots: features of all tokens of all passages; sizes: features by token;
    tokens: tokens by passage.
    """
    out = np.zeros(len(tokens))
    if not len(slots):
        return out
    total = np.add.reduceat(odds[slots].astype(float), np.cumsum(sizes) - sizes)
    # a word and its pair overlap, so their odds count two thirds
    value = np.clip(total / 1.5, -3.0, np.where(sizes == 2, MOST_TOKEN, MOST_PLACEHOLDER))
    full = np.flatnonzero(tokens)
    owner = np.repeat(np.arange(len(full)), tokens[full])
    # sums before and after each token, moved down by passage so that a running minimum doesn't look back into the one before
    after = np.cumsum(value)
    down = owner * (2.0 * np.abs(value).sum() + 1.0)
    least = np.minimum.accumulate(after - value - down) + down
    starts = np.cumsum(tokens[full]) - tokens[full]
    out[full] = np.maximum(0.0, np.maximum.reduceat(after - least, starts))
    return out


class _Counts:
    """What the labelled passages and the corpus say about features: sums by slot."""

    def __init__(self) -> None:
        labelled = [set(encode(p)[0]) for p in trusted()]
        self.seed = np.bincount([f for x in labelled for f in x], minlength=FEATURES).astype(float)
        self.labelled = len(labelled)
        self.all, self.passages = np.zeros(FEATURES), 0.0

    def odds(self, positive: np.ndarray, mass: float) -> np.ndarray:
        """Log-odds of the features when the corpus has ``mass`` passages of residue with these sums."""
        pos, neg = self.seed + positive, np.maximum(0.0, self.all - positive)
        n_pos, n_neg = self.labelled + mass, max(1.0, self.passages - mass)
        share = (pos + neg) / (n_pos + n_neg)
        odds = np.log((pos + PULL * share + 1e-9) / (n_pos + PULL)) - np.log((neg + PULL * share + 1e-9) / (n_neg + PULL))
        odds[(pos + neg) == 0] = 0.0
        return np.clip(odds, -4.0, 6.0).astype(np.float32)


def log_odds(runs: np.ndarray, tokens: np.ndarray, prior: float) -> np.ndarray:
    """Log-odds of residue: the best run is one of as many as there are tokens to start it."""
    return runs + np.log(prior / (1 - prior)) - np.log(np.maximum(1, tokens))


def posteriors(odds: np.ndarray) -> np.ndarray:
    """Probability of residue; what is next to none is none, which keeps the sums sparse."""
    p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return np.where(p < 0.05, 0.0, p)


class ResidueModel:
    """Hashed log-odds of residue against everything else, and the estimated share of residue."""

    def __init__(self, odds: np.ndarray, prior: float = PRIOR):
        self.odds, self.prior = odds, prior

    def scores(self, passages: list[str]) -> np.ndarray:
        """Log-odds of residue, above 0 where it is the likelier."""
        made = [encode(p) for p in passages]
        tokens = np.array([len(k) for _, k in made], np.int64)
        runs = best_runs(self.odds, np.array([f for s, _ in made for f in s], np.int64), np.array([n for _, k in made for n in k], np.int64), tokens)
        return log_odds(runs, tokens, self.prior)

    def score(self, passage: str) -> float:
        return float(self.scores([passage])[0])

    @classmethod
    def fit(cls, unlabelled: list[tuple[str, int]], rounds: int = ROUNDS) -> ResidueModel:
        """Expectation-maximization over passages with their counts, held in memory."""
        made = [(*encode(p), n) for p, n in unlabelled]
        frame = pd.DataFrame({"slots": [m[0] for m in made], "sizes": [m[1] for m in made], "n": [float(m[2]) for m in made]})
        return cls._rounds(lambda odds, prior: _sums(frame, odds, prior), rounds)

    @classmethod
    def _rounds(cls, sums_of: Callable[[np.ndarray | None, float], tuple[np.ndarray, float]], rounds: int) -> ResidueModel:
        """sums_of: (sums by slot, passages) of the corpus, all of it, or of the residue in it for given odds and prior."""
        counts, prior = _Counts(), PRIOR
        counts.all, counts.passages = sums_of(None, prior)
        positive, mass = np.zeros(FEATURES), 0.0
        for _ in range(rounds):
            positive, mass = sums_of(counts.odds(positive, mass), prior)
            prior = min(0.5, max(1e-6, (mass + 1.0) / (counts.passages + 100.0)))
        return cls(counts.odds(positive, mass), prior)


def _sums(frame: pd.DataFrame, odds: np.ndarray | None, prior: float) -> tuple[np.ndarray, float]:
    """Sums by slot over the passages of a frame (slots, sizes, n), each slot once a passage, and their number."""
    if not len(frame):
        return np.zeros(FEATURES), 0.0
    n = frame["n"].to_numpy(float)
    lengths = np.array([len(s) for s in frame.slots], np.int64)
    flat = np.concatenate([np.asarray(s, np.int64) for s in frame.slots])
    if odds is not None:
        sizes = np.concatenate([np.asarray(s, np.int64) for s in frame.sizes])
        tokens = np.array([len(s) for s in frame.sizes], np.int64)
        n = n * posteriors(log_odds(best_runs(odds, flat, sizes, tokens), tokens, prior))
        if not n.any():
            return np.zeros(FEATURES), 0.0
    owner = np.repeat(np.arange(len(frame)), lengths)
    held = n[owner] > 0
    once = np.unique(owner[held] * FEATURES + flat[held])
    return np.bincount(once % FEATURES, n[once // FEATURES], FEATURES), float(n.sum())


def fields_of(df: DataFrame, record_table: str, id_col: str, field_cols: list[str]) -> DataFrame:
    """One row per value: record_table, record_id, field_name, text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in field_cols))
    return df.select(F.lit(record_table).alias("record_table"), F.col(id_col).cast("bigint").alias("record_id"), F.explode(pairs).alias("f")).select("record_table", "record_id", "f.*")


def _norm(passage: str) -> str:
    return re.sub(r"\d", "0", passage.strip())


def fit_residue(values: DataFrame, rounds: int = ROUNDS) -> ResidueModel:
    """Fit on all passages of all values."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()

        def frame() -> pd.DataFrame:
            made = [(*encode(p), n) for p, n in sorted(counts.items())]
            counts.clear()
            return pd.DataFrame(made, columns=["slots", "sizes", "n"])

        for batch in batches:
            for text in batch.text:
                counts.update(_norm(p) for p in passages(text))
            if len(counts) > HELD_PASSAGES:
                yield frame()
        yield frame()

    encoded = stage(values.select("text").filter(F.col("text").rlike(r"\S")).mapInPandas(counted, "slots array<int>, sizes array<int>, n bigint"), "passages")

    def sums_of(odds: np.ndarray | None, prior: float) -> tuple[np.ndarray, float]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, mass = np.zeros(FEATURES), 0.0
            for batch in batches:
                own, n = _sums(batch, odds, prior)
                total += own
                mass += n
            at = np.flatnonzero(total)
            yield pd.DataFrame({"slot": np.append(at, -1).astype(np.int32), "s": np.append(total[at], mass)})

        out, mass = np.zeros(FEATURES), 0.0
        found = encoded.mapInPandas(add, "slot int, s double").groupBy("slot").agg(F.sum("s").alias("s")).toPandas()
        for slot, total in zip(found.slot, found.s):
            if slot < 0:
                mass = float(total)
            else:
                out[slot] = total
        return out, mass

    return ResidueModel._rounds(sums_of, rounds)


def score_residue(values: DataFrame, model: ResidueModel | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(record_table, record_id, field_name, score, is_residue, clean_text) of every value with text.

    values: record_table, record_id, field_name, text; other columns aren't
    read.  clean_text is the value without its residue passages, null if nothing
    is left.  Null, empty and blank values have no row.  Texts are read whole,
    whatever their length; repeated rows get equal results; an empty table
    gives an empty result.
    """
    model = model or fit_residue(values)
    rows = values.select("record_table", "record_id", "field_name", "text").filter(F.col("text").rlike(r"\S"))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[str, float] = {}
        for batch in batches:
            parts = [[_norm(p) for p in passages(text)] for text in batch.text]
            if len(memo) > 200_000:
                memo.clear()
            new = sorted({p for ps in parts for p in ps if p not in memo})
            memo.update(zip(new, model.scores(new).tolist()))
            best, clean = [], []
            for text, own in zip(batch.text, parts):
                top = max((memo[p] for p in own), default=0.0)
                best.append(top)
                if top < threshold:
                    clean.append(text)
                else:
                    kept = [line for line in (" ".join(p for p in passages(line) if memo[_norm(p)] < threshold) for line in text.split("\n")) if line.strip(" -*>")]
                    clean.append("\n".join(kept) or None)
            out = batch[["record_table", "record_id", "field_name"]].copy()
            out["score"], out["clean_text"] = best, clean
            out["is_residue"] = out["score"] >= threshold
            yield out[["record_table", "record_id", "field_name", "score", "is_residue", "clean_text"]]

    schema = T.StructType(
        [
            *rows.select("record_table", "record_id", "field_name").schema.fields,
            T.StructField("score", T.DoubleType()),
            T.StructField("is_residue", T.BooleanType()),
            T.StructField("clean_text", T.StringType()),
        ]
    )
    return rows.mapInPandas(score, schema)
