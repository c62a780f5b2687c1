"""Texts that stop before their own end.

A logistic regression over hashed features of a text's closing words, closing
characters, punctuation and length-to-limit scores how likely it was cut.  It is
trained on texts of the corpus itself: cut inside sentences, at random places and
at the lengths that stand out in their source, they are the positives; their
sentence ends, with or without the final stop, and their own ends where these
look complete are the negatives.  So it learns which words and lines can close a
text, and how much a length at a limit says.  How far a length stands out among
its source's lengths is counted over all rows.

Scale: examples are made in the tasks that read the texts, of a bounded sample of
whole texts chosen by a hash, so only feature slots of bounded number leave
them; scoring reads only the last characters of each text and its length, in one
narrow stage.  Length counts are aggregated before the shuffle and joined back
on (source, length).
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.mixture import source_key
from quire.scratch import stage

#: Texts the model is trained on, about and at most if there are no more (those with the smallest hashes of id and text).
TRAIN_TEXTS = 4000
#: Lengths of a source at which its texts are cut for training, the most outstanding ones.
TRAIN_LIMITS = 16
#: Examples made of each text, at most, of either class.
PER_TEXT = 12
#: Characters at the end of a text that features look at.
TAIL = 240
FEATURES = 1 << 18
#: How often a length must occur, against those around it, to stand out.
LEAST_LIFT = 8.0
#: Probability from which on a text counts as cut.
THRESHOLD = 0.5

#: Marks that systems leave at a cut (fixed values).
_MARK = re.compile(r"(?:\s*(?:…|\.\.\.+|\[\s*(?:…|\.\.\.|truncated|cut|more|continued)\s*\]|\(\s*(?:truncated|cut off|continued|more)\s*\)|<\s*truncated\s*>|-+\s*truncated\s*-+|�+))+\s*$", re.I)
_CLOSED = re.compile(r"[.!?。][\"'”’)\]]*$")
_WORD = re.compile(r"\w+(?:[-'’.]\w+)*|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[a-zà-ÿ)\d%])[.!?](?=\s+[\"(]?[A-ZÀ-Þ¿¡]|\s*$|\s*\n)")


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % FEATURES


def _plain(word: str) -> str:
    return re.sub(r"\d", "0", word)


def limit_level(lift: float | None) -> int:
    """How far a length stands out: 0 if it doesn't, else the power of two, 7 at most."""
    return 0 if lift is None or not lift >= LEAST_LIFT else min(7, int(math.log2(lift)))


def features(tail: str, whole: bool, lift: float | None = None) -> list[int]:
    """Feature slots of a text's end; ``whole``: the tail is the whole text; ``lift``: that of its length, see :func:`limit_evidence`."""
    at_limit = limit_level(lift)
    stripped = tail.rstrip()
    mark = _MARK.search(stripped)
    names = ["bias"]
    if mark:
        # a mark says it all for a text without it; three dots may also be style
        names += ["mark", "mark=" + re.sub(r"\.+", "...", mark.group().strip().lower())[:14]]
        stripped = stripped[: mark.start()].rstrip()
    if not stripped:
        return [_slot(n) for n in [*names, "empty", f"limit={at_limit}"]]
    line = stripped[stripped.rfind("\n") + 1 :]
    toks = _WORD.findall(line[-160:])
    plain = [_plain(t) for t in toks]
    w1, w2, w3 = (plain[-i] if len(plain) >= i else "^" for i in (1, 2, 3))
    last = stripped[-1]
    closed = bool(_CLOSED.search(stripped))
    if closed:
        names.append("closed")
    names += [f"limit={at_limit}", f"limit {at_limit > 0} closed {closed and not mark}"]
    names.append("end=" + (unicodedata.category(last) if not last.isascii() or last.isalnum() else last))
    alone = stripped.rfind("\n\n") == stripped.rfind("\n") - 1 and "\n" in stripped
    names += [
        f"w1={w1}",
        f"w2={w2} {w1}",
        f"w3={w3} {w2} {w1}",
        f"lw1={w1.lower()}",
        f"suf={w1[-3:]}",
        f"len1={min(len(w1), 8)}",
        f"words={min(len(plain), 6)}",
        f"list={line.lstrip()[:1] in '-*•'}{min(len(plain), 3)}",
        f"apart={alone}{min(len(plain), 5)}",
        f"title={bool(plain) and all(t[:1].isupper() or not t[:1].isalpha() for t in toks)}{min(len(plain), 4)}",
        f"code={any(c.isdigit() for c in toks[-1]) if toks else False}{len(toks) < 4}",
        f"open={line.count('(') > line.count(')')}{line.count('[') > line.count(']')}",
    ]
    before = stripped[: max(0, len(stripped) - len(line) - 1)].rstrip()
    previous = [_plain(t) for t in _WORD.findall(before[before.rfind("\n") + 1 :][-60:])]
    if len(plain) <= 6:
        names.append("line=" + " ".join(plain))
    if previous and len(previous) <= 4:
        names.append("previous=" + " ".join(previous))
    if whole:
        names.append(f"whole={min(len(plain), 4)}")
    return [_slot(n) for n in names]


def complete_end(text: str) -> bool:
    """Whether a text's end can be taken for its own: a final stop, or a short last
    paragraph (a signature, reference or list) apart from the running text.

    The latter also takes in some texts cut at the start of a paragraph; they are
    few against the closing lines that recur, and so only soften the weights.
    """
    text = text.rstrip()
    if _MARK.search(text):
        return False
    if _CLOSED.search(text):
        return True
    last = text[text.rfind("\n\n") + 2 :]
    return "\n\n" in text and all(len(line.split()) <= 6 for line in last.split("\n"))


def examples_of(text: str, rng: random.Random, limits: list[tuple[int, float]] | tuple = ()) -> tuple[list[list[int]], list[int]]:
    """Labelled feature lists from one intact text; limits: (length, lift) that stand out in its source."""
    xs: list[list[int]] = []
    ys: list[int] = []
    lifts = dict(limits)

    def add(part: str, cut: int, length: int | None = None) -> None:
        xs.append(features(part[-TAIL:], len(part) <= TAIL, lifts.get(len(part) if length is None else length)))
        ys.append(cut)

    whole = len(text)
    text = text.rstrip()
    if len(text) < 12:
        return xs, ys
    ends = [m.start() for m in _SENTENCE.finditer(text)]
    # negatives: the text as it ends, unless that is at a limit, and sentence ends with and without the stop
    if complete_end(text) and whole not in lifts:
        add(text, 0)
    for e in rng.sample(ends, min(PER_TEXT, len(ends))):
        part = text[: e + 1] if rng.random() < 0.4 else text[:e]
        if rng.random() < 0.2:  # ends a list item
            start = max(part.rfind(". ", 0, e - 1), part.rfind("\n", 0, e - 1)) + 1
            part = part[:start].rstrip() + "\n- " + part[start:].strip().rstrip(".")
        # a closed text can have a limit's length by chance
        by_chance = bool(lifts) and part[-1:] in ".!?" and rng.random() < 0.15
        add(part, 0, rng.choice(sorted(lifts)) if by_chance else None)
    stops = {p for e in ends for p in (e, e + 1, e + 2)} | {len(text) - 1, len(text)}
    within = [n for n in lifts if 8 <= n < len(text)]
    for _ in range(PER_TEXT if ends else 2):
        at_limit = bool(within) and rng.random() < 0.3
        at = rng.choice(within) if at_limit else rng.randrange(8, len(text))
        part = text[:at] if at_limit else text[:at].rstrip()
        if at in stops or not part.strip() or part.rstrip()[-1] in ".!?" or len(part.rstrip()) in stops:
            continue
        if not at_limit and rng.random() < 0.25:
            part += rng.choice(["…", "...", " [...]", " …", "�", " ...", " [truncated]"])
        add(part, 1)
    return xs, ys


def examples(texts: list[str], seed: int = 7) -> tuple[list[list[int]], list[int]]:
    """:func:`examples_of` all texts."""
    rng = random.Random(seed)
    made = [examples_of(t, rng) for t in texts]
    return [x for xs, _ in made for x in xs], [y for _, ys in made for y in ys]


def fit(xs: list[list[int]], ys: list[int], seed: int = 7, epochs: int = 6, rate: float = 0.25, decay: float = 1e-6) -> np.ndarray:
    """Weights of the logistic regression (AdaGrad on mini-batches)."""
    weights, squares = np.zeros(FEATURES), np.full(FEATURES, 1e-3)
    if not xs:
        weights[_slot("mark")] = 4.0
        weights[_slot("bias")] = -2.0
        return weights
    width = max(map(len, xs))
    pad = np.full((len(xs), width), FEATURES, np.int64)
    for i, x in enumerate(xs):
        pad[i, : len(x)] = x
    y, rng = np.array(ys, float), np.random.default_rng(seed)
    w = np.append(weights, 0.0)
    g2 = np.append(squares, 1.0)
    for _ in range(epochs):
        order = rng.permutation(len(xs))
        for lo in range(0, len(order), 256):
            rows = order[lo : lo + 256]
            x = pad[rows]
            p = 1 / (1 + np.exp(-w[x].sum(1)))
            slots, back = np.unique(x, return_inverse=True)
            grad = np.bincount(back.ravel(), np.repeat(p - y[rows], width), len(slots)) / 16 + decay * w[slots]
            g2[slots] += grad * grad
            w[slots] -= rate * grad / np.sqrt(g2[slots])
            w[FEATURES] = 0.0
    return w[:FEATURES].astype(np.float32)


def limit_evidence(counts: DataFrame) -> DataFrame:
    """(source, n, lift): how often length n occurs in a source against the mean of
    the 50 lengths around it; over the (source, length) pairs that stand out.

    counts: source, n and c, the number of all rows with them; the window runs over distinct lengths.
    """
    around = Window.partitionBy("source").orderBy("n").rangeBetween(-25, 25)
    mean = (F.sum("c").over(around) - F.col("c")) / 50.0
    return counts.withColumn("lift", F.col("c") / (mean + 0.25)).filter((F.col("c") >= 3) & (F.col("lift") >= LEAST_LIFT)).select("source", "n", "lift")


def score_truncation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", train_texts: int = TRAIN_TEXTS) -> DataFrame:
    """(id, source, n_chars, score, at_limit, truncated) of every row with text.

    source is given in one form for all its spellings, null if there is none.
    Null and blank texts have no row.  Texts of any length are judged by their
    last TAIL characters and their length.  Repeated rows are judged each for
    itself; the model doesn't depend on the order of rows.  An empty table gives
    an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), source_key(source_col).alias("source"), F.col(text_col).alias("text")).filter(F.col("text").rlike(r"\S"))
    counts = stage(rows.groupBy("source", F.length("text").alias("n")).agg(F.count(F.lit(1)).alias("c")), "lengths")
    limits = stage(limit_evidence(counts), "limits")
    weights = fit_truncation(rows, counts, limits, train_texts)
    short = rows.select("id", "source", F.length("text").alias("n"), F.substring("text", -TAIL, TAIL).alias("tail"))
    joined = short.join(limits, (short.source.eqNullSafe(limits.source)) & (short.n == limits.n), "left").select("id", short.source, short.n, "tail", "lift")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lift = batch.lift.fillna(1.0)
            total = np.array([float(weights[features(t, n <= TAIL, x)].sum()) for t, n, x in zip(batch["tail"], batch.n, lift)], float)
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pd.DataFrame({id_col: batch.id, "source": batch.source, "n_chars": batch.n, "score": p, "at_limit": batch.lift.notna(), "truncated": p >= THRESHOLD})

    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema["id"].dataType),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("at_limit", T.BooleanType()),
            T.StructField("truncated", T.BooleanType()),
        ]
    )
    return joined.mapInPandas(score, schema)


def fit_truncation(rows: DataFrame, counts: DataFrame, limits: DataFrame, train_texts: int = TRAIN_TEXTS) -> np.ndarray:
    """Weights from the texts (id, source, text) with the smallest hashes, about ``train_texts`` of them.

    The share of hashes taken follows from the number of rows, so the sample is
    found row by row, without an order over all of them.
    """
    total = counts.agg(F.sum("c")).first()[0] or 0
    hashed = rows.select("source", "text", F.xxhash64("id", "text").alias("h"))
    if total > train_texts:
        hashed = hashed.filter(F.col("h") <= -(1 << 63) + int(train_texts / total * 2.0**64))
    best = F.slice(F.sort_array(F.collect_list(F.struct("lift", "n")), asc=False), 1, TRAIN_LIMITS)
    by_source = limits.groupBy("source").agg(best.alias("limits"))
    sample = hashed.join(by_source, hashed.source.eqNullSafe(by_source.source), "left").select("h", "text", "limits")

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for h, text, found in zip(batch.h, batch.text, batch.limits):
                xs, ys = examples_of(text, random.Random(int(h)), [(int(x["n"]), float(x["lift"])) for x in found] if found is not None else [])
                made.append((h, [i for x in xs for i in x], [len(x) for x in xs], ys))
            yield pd.DataFrame(made, columns=["h", "slots", "sizes", "cut"])

    xs: list[list[int]] = []
    ys: list[int] = []
    for r in sorted(sample.mapInPandas(make, "h bigint, slots array<int>, sizes array<int>, cut array<int>").collect(), key=lambda r: (r.h, r.slots)):
        at = 0
        for n in r.sizes:
            xs.append(r.slots[at : at + n])
            at += n
        ys += r.cut
    return fit(xs, ys)


def truncation_rates(scored: DataFrame) -> DataFrame:
    """How often each source delivers truncated texts (a null source is a group of its own)."""
    return scored.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum(F.col("truncated").cast("bigint")).alias("truncated"),
        F.sum((F.col("truncated") & F.col("at_limit")).cast("bigint")).alias("truncated_at_limit"),
        F.avg(F.col("truncated").cast("double")).alias("share"),
    )
