"""Text of scanned pages repaired into continuous paragraphs.

Three learned parts, each an averaged perceptron:

* lines at the top and foot of pages are body, running header or page number,
  by their place, their repetition over the pages and how their numbers run;
* a mark at a line's end joins the parts of a divided word or stays;
* a character editor turns a word into another by keeping, replacing, deleting
  and inserting characters, or keeps it.  Pairs that recognisers confuse may be
  edited together; any other letter may be replaced, lost or too many once a word.

What is a word is counted over the whole corpus; forms that are a recogniser's
error away from a far more frequent one aren't words.  Training material is
made from these words and from generated pages; words left out of the list teach
which unknown words to keep, and how sure an edit of an ordinary letter must be.

Scale: the word list is bounded by relative frequency (a word must make up
``MIN_SHARE`` of all tokens, so there are at most 1 / MIN_SHARE), counted with
map-side combining, and its misread forms are sorted out in tasks; repair is one
narrow stage.  Edits of a word are looked for along the beginnings of the words
there are, so their number needs no limit.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.scratch import stage

MIN_SHARE, MIN_COUNT = 1e-6, 3
#: How much more frequent a word must be than a form that may be its misreading.
RATIO = 4.0
#: Words the editor is trained on, at most (the most frequent).
TRAIN_WORDS = 4000
NOISE_KINDS = ("hyphen", "misread", "header", "page_number")

#: What recognisers read, and what may have stood there (fixed values).
CONFUSIONS: dict[str, tuple[str, ...]] = {
    "0": ("o", "O"), "1": ("l", "i", "I"), "5": ("s", "S"), "9": ("g",), "8": ("B",), "6": ("b",), "2": ("z",), "4": ("A",), "|": ("i", "l", "I"), "!": ("l", "i"), "†": ("t",), "$": ("S", "s"), "€": ("e",), "@": ("a",), "£": ("E",), "¢": ("c",), "°": ("o",),
    "а": ("a",), "е": ("e",), "о": ("o",), "р": ("p",), "с": ("c",), "х": ("x",), "у": ("y",), "і": ("i",), "А": ("A",), "В": ("B",), "Е": ("E",), "О": ("O",), "Р": ("P",), "С": ("C",), "Т": ("T",), "Н": ("H",), "М": ("M",), "К": ("K",), "ο": ("o",), "α": ("a",), "ν": ("v",),
    "ﬁ": ("fi",), "ﬂ": ("fl",), "ﬀ": ("ff",), "ü": ("ti",), "rn": ("m",), "m": ("rn",), "cl": ("d",), "d": ("cl",), "c1": ("d",), "c|": ("d",), "c!": ("d",), "vv": ("w",), "w": ("vv",), "li": ("h",), "h": ("li",), "1i": ("h",), "l1": ("h",), "l|": ("h",), "l!": ("h",), "ii": ("u",), "u": ("ii",), "I": ("l",), "l": ("I",), "VV": ("W",),
}
#: Marks that can stand where a word is divided.
MARKS = "-‐‑¬\xad=~"
_SURE_MARKS = "‐¬\xad=~"

_ODD = [k for k in CONFUSIONS if len(k) == 1 and not (k.isascii() and k.isalpha())]
_STRANGE_SITE = re.compile("[" + "".join(map(re.escape, _ODD)) + "]")
_STRANGE = re.compile(r"[^\W\d_]*[0-9|!†$€@£¢°Ͱ-ӿﬁﬂﬀ]")
_ADDRESS = re.compile(r"@[^\s@]*\.|://|^www\.", re.I)
_CORE = re.compile(r"[^\W_]|[|!†$€£¢°]")


class Perceptron:
    """Averaged perceptron over named features."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = defaultdict(float)
        self._sum: dict[str, float] = defaultdict(float)
        self._at: dict[str, int] = defaultdict(int)
        self._step = 0

    def score(self, feats: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in feats])

    def update(self, good: list[str], bad: list[str]) -> None:
        self._step += 1
        for feats, by in ((good, 1.0), (bad, -1.0)):
            for f in feats:
                self._sum[f] += (self._step - self._at[f]) * self.weights[f]
                self._at[f] = self._step
                self.weights[f] += by

    def average(self) -> dict[str, float]:
        self._step += 1
        return {f: (self._sum[f] + (self._step - self._at[f]) * w) / self._step for f, w in self.weights.items()}


# --- words ------------------------------------------------------------------


def core(token: str) -> tuple[int, int]:
    """Bounds of a token without the punctuation around it; strange characters that can be letters belong to it."""
    lo, hi = 0, len(token)
    while lo < hi and not _CORE.match(token[lo]):
        lo += 1
    while hi > lo and not _CORE.match(token[hi - 1]):
        hi -= 1
    return lo, hi


Edit = tuple[str, str, int]  # what is seen, what is meant, and its place


def readings(word: str, words: Words, most_plain: int = 2) -> dict[str, list[Edit]]:
    """Known words (in the case they come out in) that ``word`` may be a misreading of, by their edits.

    Characters that can't stand in a word are all edited, ordinary letters, alone
    or in pairs, at ``most_plain`` places at most.
    """
    out: dict[str, list[Edit]] = {}
    n = len(word)

    def follow(at: int, low: str, result: str, edits: list[Edit], plain: int) -> None:
        if low and not words.begins(low):
            return
        if at == n:
            if edits and low in words.counts and (result not in out or len(edits) < len(out[result])):
                out[result] = edits
            return
        c = word[at]
        if c.isalpha() or c not in CONFUSIONS:
            follow(at + 1, low + c.lower(), result + c, edits, plain)
        for seen in (c, word[at : at + 2]) if at + 1 < n else (c,):
            for meant in CONFUSIONS.get(seen, ()):
                cost = 0 if any(x in _ODD for x in seen) else 1
                if plain + cost <= most_plain:
                    follow(at + len(seen), low + meant.lower(), result + meant, [*edits, (seen, meant, at)], plain + cost)

    follow(0, "", "", [], 0)
    return out


def guesses(word: str) -> Iterator[tuple[str, list[Edit]]]:
    """``word`` with all characters that can't stand in a word edited, without regard to what words there are:
    every combination for up to three of them, else the usual ones and every other choice at one place."""
    places = [m.start() for m in _STRANGE_SITE.finditer(word)]
    options = [[(q, seg, c) for q, seg in [(p, word[p])] + [(q, word[q : q + 2]) for q in (p - 1, p) if q >= 0 and len(word[q : q + 2]) == 2 and word[q : q + 2] in CONFUSIONS] for c in CONFUSIONS[seg]] for p in places]
    if not options:
        return
    usual = [o[0] for o in options]
    choices = product(*options) if len(options) <= 3 else [usual, *([*usual[:i], x, *usual[i + 1 :]] for i, o in enumerate(options) for x in o[1:])]
    for choice in choices:
        ops = sorted(choice)
        if any(x[0] + len(x[1]) > y[0] for x, y in zip(ops, ops[1:])):
            continue
        parts, at = [], 0
        for p, seen, meant in ops:
            parts += [word[at:p], meant]
            at = p + len(seen)
        yield "".join([*parts, word[at:]]), [(seen, meant, p) for p, seen, meant in ops]


def single_edits(word: str, words: Words) -> dict[str, list[Edit]]:
    """Known words that differ from ``word`` by one character of any kind, replaced, lost or too many."""
    low, have, out = word.lower(), words.counts, {}

    def add(at: int, seen: str, meant: str) -> None:
        upper = (seen or word[at - 1 : at] if at else word[:1]).isupper() and (at == 0 or word.isupper())
        out.setdefault(word[:at] + (meant.upper() if upper else meant) + word[at + len(seen) :], [(seen, meant, at)])

    for i in range(len(word) + 1):
        head, rest = low[:i], low[i:]
        if rest and head + rest[1:] in have:
            add(i, word[i], "")
        for c in words.letters:
            if rest and c != rest[0] and head + c + rest[1:] in have:
                add(i, word[i], c)
            if head + c + rest in have:
                add(i, "", c)
    return out


def keeps_case(word: str, result: str, edits: list[Edit]) -> bool:
    """Whether an edit leaves a word in one case, apart from its first letter, if the letters that stay are so."""
    touched = {i for seen, _, p in edits for i in range(p, p + len(seen))}
    stay = "".join(c for i, c in enumerate(word) if i not in touched and i > 0 and c.isalpha())
    if not stay or not (stay.islower() or stay.isupper()):
        return True
    inner = "".join(c for c in result[1:] if c.isalpha())
    return inner.islower() if stay.islower() else inner.isupper()


class Words:
    """Counts of the corpus's words in lower case; misread forms among them are left out unless ``checked`` already."""

    def __init__(self, counts: dict[str, int], checked: bool = False):
        self._take(counts)
        if not checked:
            self._take({w: n for w, n in counts.items() if not self.is_misread(w)})

    def _take(self, counts: dict[str, int]) -> None:
        self.counts, self._sorted = counts, sorted(counts)
        self.total = max(1, sum(counts.values()))
        letters: Counter = Counter()
        for w in counts:
            letters.update(w)
        total = sum(letters.values())
        #: the letters that make up a thousandth of the list's
        self.letters = sorted(c for c, n in letters.items() if c.isalpha() and n * 1000 >= total)

    def begins(self, start: str) -> bool:
        at = bisect_left(self._sorted, start)
        return at < len(self._sorted) and self._sorted[at].startswith(start)

    def is_misread(self, word: str) -> bool:
        """Whether a far more frequent word may have been read as this one."""
        n = self.counts[word]
        return any(self.counts[v.lower()] >= RATIO * n for v in readings(word, self) if v.lower() != word)

    def level(self, word: str) -> int:
        n = self.counts.get(word.lower(), 0)
        return 0 if not n else 1 + (n / self.total > 1e-5) + (n / self.total > 1e-4)


_BREAK = re.compile(rf"[{MARKS.replace('-', chr(92) + '-')}][ \t]*\n[ \t]*")
_SMALL = re.compile(r"[a-zß-öø-ÿ][^\W\d_]+")
#: Different tokens a task holds before it passes their counts on.
HELD_TOKENS = 200_000


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tokens, and the two parts of words at line ends, with their counts so far."""

    def frame() -> pd.DataFrame:
        rows = [(t, None, n) for t, n in tokens.items()] + [(a, b, n) for (a, b), n in parts.items()]
        tokens.clear()
        parts.clear()
        return pd.DataFrame(rows, columns=["t", "b", "n"])

    tokens: Counter = Counter()
    parts: Counter = Counter()
    for batch in batches:
        for text in batch.text:
            tokens.update(text.split())
            for m in _BREAK.finditer(text):
                at = m.start()
                while at and text[at - 1].isalpha():
                    at -= 1
                right = _SMALL.match(text, m.end())
                if m.start() - at > 1 and right:
                    parts[text[at : m.start()].lower(), right.group().lower()] += 1
        if len(tokens) > HELD_TOKENS:
            yield frame()
    yield frame()


def count_words(texts: DataFrame) -> dict[str, int]:
    """Words (lower case, without surrounding punctuation) by their counts over all rows of ``texts.text``.

    Words that only occur divided count by their parts at line ends, put
    together, if they were divided at two places or more: parts of a compound
    are always parted at the same place.  Tokens are counted inside the tasks,
    so what is shuffled is vocabulary, not text.
    """
    counted = stage(texts.select("text").filter("text is not null").mapInPandas(_count, "t string, b string, n bigint"), "words")
    strip = F.regexp_replace(F.lower("t"), r"^[^\p{L}\p{N}|!†$€]+|[^\p{L}\p{N}|†$€]+$", "")
    tokens = counted.filter("b is null").groupBy("t").agg(F.sum("n").alias("n"))
    words = tokens.select(strip.alias("w"), "n").filter(r"w rlike '\\p{L}{2}'").groupBy("w").agg(F.sum("n").alias("n"))
    words = stage(words, "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    least = max(MIN_COUNT, MIN_SHARE * total)
    counts = {r.w: r.n for r in words.filter(F.col("n") >= least).collect()}
    pairs = counted.filter("b is not null").groupBy("t", "b").agg(F.sum("n").alias("n"))
    joined = pairs.groupBy(F.concat("t", "b").alias("w")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("places"))
    for r in joined.filter((F.col("n") >= least) & (F.col("places") > 1)).collect():
        counts[r.w] = counts.get(r.w, 0) + r.n
    return counts


def known_words(texts: DataFrame) -> Words:
    """The words of all rows of ``texts.text``; misread forms are sorted out in tasks."""
    counts = count_words(texts)
    if not counts:
        return Words({}, checked=True)
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(counts)  # at most 1 / MIN_SHARE words, and as many divided ones

    def sound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(shared.value, checked=True)
        for batch in batches:
            yield batch[[not words.is_misread(w) for w in batch.w]]

    cores = spark.sparkContext.defaultParallelism
    rows = spark.createDataFrame(pd.DataFrame({"w": sorted(counts)}), "w string").repartition(cores, "w")
    good = rows.mapInPandas(sound, "w string").toPandas().w
    return Words({w: counts[w] for w in sorted(good)}, checked=True)


# --- character editor -------------------------------------------------------


def _shape(c: str) -> str:
    return "^" if not c else "d" if c.isdigit() else "u" if c.isupper() else "l" if c.isalpha() else "s"


class Editor:
    """Chooses among the edits of a word."""

    def __init__(self, words: Words, weights: dict[str, float] | None = None, margin: float = 0.0):
        self.words, self.weights, self.margin = words, weights or {}, margin
        self._memo: dict[tuple[str, bool], str] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "weights": self.weights, "margin": self.margin}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def candidates(self, word: str) -> list[tuple[str, list[str], bool]]:
        """(result, features, whether an ordinary character is edited), the word itself first."""
        here = self.words.level(word)
        strange = list(_STRANGE_SITE.finditer(word))
        kept = [f for m in strange for f in ("odd kept", f"keep {m.group()}", f"keep {m.group()} {_shape(word[m.start() - 1 : m.start()] if m.start() else '')}{_shape(word[m.end() : m.end() + 1])}")]
        out = [(word, [f"words {here} {here} False", f"edits 0 {here > 0}", f"strange {bool(_STRANGE.search(word))} False", *kept], False)]
        seen = {word}
        known = readings(word, self.words, 2 if not strange else 1)
        for result, ops in [*known.items(), *guesses(word)]:
            if result in seen or not keeps_case(word, result, ops):
                continue
            seen.add(result)
            level = self.words.level(result)
            f = [f"words {here} {level} True", f"edits {min(len(ops), 3)} {level > 0}", f"strange {bool(_STRANGE.search(result))} True"]
            for s, c, p in ops:
                before, after = _shape(word[p - 1 : p] if p else ""), _shape(word[p + len(s) : p + len(s) + 1])
                if not (s.isascii() and s.isalpha()):
                    f.append(f"odd op {level > 0}")
                f += [f"op {s}>{c}", f"op {s}>{c} {before}{after}", f"op {s} {level > 0}"]
            out.append((result, f, False))
        if not here and not known and len(word) > 3 and not word.istitle():  # which may be a name
            found = single_edits(word, self.words)
            for result, ((s, c, p),) in found.items():
                if result not in seen:
                    out.append((result, self._single(word, s, c, p, self.words.level(result), len(found)), True))
        return out

    @staticmethod
    def _single(word: str, seen: str, meant: str, at: int, level: int, many: int) -> list[str]:
        kind = "replace" if seen and meant else "delete" if seen else "insert"
        where = "first" if at == 0 else "last" if at + len(seen) >= len(word) else "inner"
        size, odd = min(len(word), 10), bool(seen) and not seen.isalpha()
        double = (seen or meant).lower() in (word[at - 1 : at].lower() if at else "", word[at + len(seen) : at + len(seen) + 1].lower())
        return [
            "single", f"single {kind} {where}", f"single {kind} {size}", f"single {where} {size}", f"single level {level} {size > 6}", f"single case {word[:1].isupper()} {word.isupper()}",
            f"single {kind} {seen.lower()}>{meant.lower()}", f"single many {min(many, 3)} {size > 6}", f"single double {double} {kind}", f"single odd {odd}", f"single {where} {kind} {seen.lower()}>{meant.lower()}",
        ]

    def best(self, word: str, singles: bool = True) -> str:
        get = self.weights.get
        scored = [(sum([get(f, 0.0) for f in feats]) - (self.margin if single else 0.0), result) for result, feats, single in self.candidates(word) if singles or not single]
        top = max(s for s, _ in scored)
        return next(r for s, r in scored if s == top)

    def repair(self, token: str, singles: bool = True) -> str:
        """The token with its word repaired; codes, numbers and addresses stay.

        ``singles`` false allows only edits that recognisers are known for.
        """
        done = self._memo.get((token, singles))
        if done is None:
            if len(self._memo) > 300_000:
                self._memo.clear()
            done = self._memo[token, singles] = self._repair(token, singles)
        return done

    def _repair(self, token: str, singles: bool) -> str:
        lo, hi = core(token)
        word = token[lo:hi]
        if word[-1:] == "!":  # an exclamation, unless the word with an l is the far more frequent one
            plain = word[:-1].lower()
            counts = self.words.counts
            if counts.get(plain, 0) * RATIO >= counts.get(plain + "l", 0) and counts.get(plain, 0):
                hi -= 1
                word = token[lo:hi]
        if self.words.level(word):
            return token
        letters = sum(c.isalpha() for c in word)
        digits = sum(c.isdigit() for c in word)
        if letters < 2 or digits * 2 > letters or _ADDRESS.search(word):
            return token
        if not digits and (parts := re.split(r"([-./])", word))[1:]:  # parts of a compound are words of their own
            return token[:lo] + "".join(self.repair(p, singles) if len(p) > 1 else p for p in parts) + token[hi:]
        fixed = self.best(word, singles)
        if re.search(r"\d\d|[./]", word) and not self.words.level(fixed):  # figures in a code, unless that makes a word
            return token
        return token[:lo] + fixed + token[hi:]

    @classmethod
    def train(cls, words: Words, epochs: int = 2, seed: int = 13) -> Editor:
        rng = random.Random(seed)
        backwards: dict[str, list[str]] = defaultdict(list)
        for seen, meant in CONFUSIONS.items():
            for m in meant:
                backwards[m].append(seen)
        keys = sorted(backwards, key=len, reverse=True)
        pattern = re.compile("|".join(map(re.escape, keys)))
        stock = [w for w, _ in sorted(words.counts.items(), key=lambda x: (-x[1], x[0]))[:TRAIN_WORDS] if w.isalpha() and len(w) > 2]
        unknown = ["".join(rng.choice(("bra", "cal", "dor", "fen", "mir", "quel", "stra", "ven", "zel", "tho", "lin", "kro")) for _ in range(2)) + rng.choice(("quist", "mann", "olm", "wick", "sley", "ette", "dottir", "")) for _ in range(max(200, len(stock) // 4))]
        umlauts = [u[:2] + "ü" + u[3:] for u in unknown[::3]] + ["für", "über", "Rücken", "fühlt", "Prüfung", "Müller", "natürlich"] * 8
        codes = [f"{rng.choice('BTKHM')}{rng.randrange(10)}" + rng.choice(("", "b", "c")) for _ in range(60)] + ["HbA1c", "SpO2", "B12", "L5", "CO2", "H2", "T4"]
        rng.shuffle(stock)
        unlisted = stock[: len(stock) // 6]  # words that the list lacks while the editor is trained
        left_out = set(unlisted)
        editor, model = cls(Words({w: n for w, n in words.counts.items() if w not in left_out}, checked=True)), Perceptron()
        stock = stock[len(unlisted) :]
        for turn in range(epochs):
            sample = [(w, True) for w in stock] + [(w, False) for w in unknown] + [(c, None) for c in (*codes, *umlauts, *unlisted)]
            rng.shuffle(sample)
            for word, known in sample:
                true = word.capitalize() if (known is False or rng.random() < 0.2) and known is not None else word.upper() if known and rng.random() < 0.03 else word
                observed, chance = true, rng.random()
                if known is not None and chance < 0.5:
                    places = list(pattern.finditer(true))
                    rng.shuffle(places)
                    # where no list helps, only characters that can't stand in a word give an error away
                    for m in sorted(places[: rng.choice((1, 1, 1, 2))], key=lambda m: -m.start()):
                        choices = [s for s in backwards[m.group()] if known or not s.isascii() or not s.isalpha()]
                        if choices:
                            observed = observed[: m.start()] + rng.choice(choices) + observed[m.end() :]
                elif known and chance < 0.7:
                    observed = damaged(true, words.letters, rng)
                if editor.words.level(observed) and observed != true:
                    continue
                found = editor.candidates(observed)
                gold = next((f for r, f, _ in found if r == true), None)
                if gold is None:
                    continue
                guess = max(found, key=lambda x: model.score(x[1]))
                if guess[0] != true:
                    model.update(gold, guess[1])
        weights = model.average()
        return cls(words, weights, cls(editor.words, weights).least_margin(unlisted))

    def least_margin(self, keep: list[str], wrong: float = 0.005, least: int = 100) -> float:
        """How far the edit of an ordinary letter must lead so that at most ``wrong`` of these unknown words are edited so;
        with fewer than ``least`` words to tell, no such edit is sure enough."""
        if len(keep) < least:
            return float("inf")
        lead = []
        for word in keep:
            scored = [(sum(self.weights.get(f, 0.0) for f in feats), single) for _, feats, single in self.candidates(word)]
            lead.append(max([s for s, single in scored if single], default=float("-inf")) - max(s for s, single in scored if not single))
        lead.sort()
        return max(0.0, lead[min(len(lead) - 1, int(len(lead) * (1 - wrong)))] + 1e-6)


def damaged(word: str, letters: list[str], rng: random.Random) -> str:
    """A word with one character replaced by any other, lost or added."""
    at = rng.randrange(len(word))
    new = rng.choice(letters) if rng.random() < 0.8 else rng.choice(";:*#%&+~^")
    return rng.choice((word[:at] + new + word[at + 1 :], word[:at] + new + word[at + 1 :], word[:at] + word[at + 1 :], word[:at] + new + word[at:]))


# --- divided words ----------------------------------------------------------

_LAST = re.compile(rf"(\S*?)([^\W_]+|[|!†$]+)([{MARKS}])[ \t]*$")
_FIRST = re.compile(r"\s*([^\W_|!†$]?[^\s]*)")


def join_features(left: str, mark: str, right: str, editor: Editor) -> list[str]:
    joined = editor.repair(left + right, singles=False)  # else two words may seem to be a third one
    lo, hi = core(joined)
    whole = editor.words.level(joined[lo:hi])
    lo, hi = core(right)
    l, r = editor.words.level(left), editor.words.level(right[lo:hi])
    return [
        f"mark {mark}", f"sure {mark in _SURE_MARKS}", f"whole {whole > 0} {mark in _SURE_MARKS}", f"parts {l > 0} {r > 0} {whole > 0}", f"digits {left[-1:].isdigit()} {right[:1].isdigit()}",
        f"case {left[:1].isupper()} {right[:1].isupper()}", f"short {len(left) < 2} {hi - lo < 2}", f"alpha {right[:1].isalpha()}",
    ]


class Joiner:
    """Whether the mark at a line's end divides one word."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def divides(self, left: str, mark: str, right: str, editor: Editor) -> bool:
        return sum(self.weights.get(f, 0.0) for f in join_features(left, mark, right, editor)) > 0

    @classmethod
    def train(cls, editor: Editor, seed: int = 17) -> Joiner:
        rng, model = random.Random(seed), Perceptron()
        stock = [w for w, _ in sorted(editor.words.counts.items(), key=lambda x: (-x[1], x[0]))[:TRAIN_WORDS] if w.isalpha()]
        long = [w for w in stock if len(w) > 5]
        if not long:
            return cls({"sure True": 1.0, "whole True False": 1.0, "digits True True": -3.0, "sure False": -0.5})
        unknown = lambda: "".join(rng.choice(("ext", "remi", "obs", "erva", "medi", "cati", "tion", "ment", "envi", "ron", "phys", "plic", "tab", "ilit")) for _ in range(3))
        data = []
        for _ in range(400):  # words no list has, and double names
            w = unknown()
            cut = rng.randrange(2, len(w) - 2)
            data.append((w[:cut], rng.choice(MARKS), w[cut:] + rng.choice(("", ".")), True))
            data.append((unknown()[:6].capitalize(), "-", unknown()[:7].capitalize() + rng.choice(("", ",")), False))
            data.append((rng.choice(stock), rng.choice(MARKS), unknown()[:5], True))
            data.append((unknown()[:3], "-", rng.choice(stock), False))
        for w in rng.sample(long, min(1500, len(long))):
            cut = rng.randrange(2, len(w) - 2)
            w = w.capitalize() if rng.random() < 0.15 else w
            data.append((w[:cut], rng.choice(MARKS), w[cut:] + rng.choice(("", "", ".", ",")), True))
            data.append((rng.choice(stock), "-", rng.choice(stock) + rng.choice(("", ".")), False))
            data.append((rng.choice(("pre", "post", "non", "self", "re", "anti", "mid")), "-", rng.choice(("and", "or", "to", rng.choice(stock))), False))
            data.append((str(rng.randrange(1, 99)), rng.choice("-‐~="), str(rng.randrange(1, 99)), False))
            data.append((rng.choice(stock).capitalize(), "-", rng.choice(("no", "not", "none", "a", "the", rng.choice(stock))), False))
        feats = [(join_features(a, m, b, editor), y) for a, m, b, y in data if not (not y and m == "-" and (a + b.strip(".")) in editor.words.counts)]
        for _ in range(4):
            rng.shuffle(feats)
            for f, y in feats:
                if (model.score(f) > 0) != y:
                    model.update(f if y else [], [] if y else f)
        return cls(model.average())


# --- page furniture ---------------------------------------------------------

_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_PAGE_LINE = re.compile(r"^\W*(?:(?:p\s?a\s?g\s?e|pg|p|sheet|seite|página|pagina|pág|folio|blatt)\W{0,3}\s*)?(\d{1,4}|[ivxlc]{1,8})(?:\s*(?:/|of|von|de|\|)\s*\d{1,4})?\W*$", re.I)
_PAGE_PART = re.compile(r"(?<![^\W_])(?:p\s?a\s?g\s?e|pg|p|sheet|seite|página|pág|folio)\W{0,3}\s*(\d{1,4})(?:\s*(?:/|of|von|de)\s*\d{1,4})?", re.I)


def _roman(s: str) -> int | None:
    s, total = s.lower(), 0
    if not re.fullmatch(r"c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", s) or not s:
        return None
    for a, b in zip(s, [*s[1:], ""]):
        v = _ROMAN[a]
        total += -v if b and _ROMAN[b] > v else v
    return total


def page_value(line: str) -> int | None:
    """The number a line shows if it has the form of a page number."""
    m = _PAGE_LINE.match(line)
    if not m:
        return None
    return int(m.group(1)) if m.group(1).isdigit() else _roman(m.group(1))


_NO_WORD, _FIGURES = re.compile(r"[^\w]+"), re.compile(r"\d+")


def _key(line: str) -> str:
    return _FIGURES.sub("0", _NO_WORD.sub("", line.lower()))


def _close(a: str, b: str) -> bool:
    """Whether two keys differ by a few recognition errors only."""
    if a == b:
        return True
    n = max(len(a), len(b))
    if n < 8 or abs(len(a) - len(b)) > 3 or (a[:4] != b[:4] and a[-4:] != b[-4:]):
        return False
    front = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), n)
    back = next((i for i, (x, y) in enumerate(zip(reversed(a), reversed(b))) if x != y), n)
    if front + back >= n - 2:
        return True
    x, y = {a[i : i + 3] for i in range(len(a) - 2)}, {b[i : i + 3] for i in range(len(b) - 2)}
    return len(x & y) >= 0.65 * max(len(x), len(y))


class Page:
    """The lines of a page or, where pages aren't marked, of a paragraph."""

    __slots__ = ("lines", "start", "kinds")

    def __init__(self, lines: list[str], start: bool):
        self.lines, self.start = lines, start
        self.kinds = ["body"] * len(lines)


def split_pages(text: str) -> tuple[list[Page], bool]:
    """Pages by form feeds, else blocks between empty lines; and whether pages are marked."""
    if "\f" in text:
        return [Page(p.split("\n"), True) for p in text.split("\f")], True
    return [Page(p.split("\n"), i == 0) for i, p in enumerate(re.split(r"\n[ \t]*\n+", text))], False


def _edges(page: Page) -> list[tuple[int, str]]:
    """(line, place) of the lines that furniture can be: two at the top, two at the foot, furniture that is known apart."""
    full = [i for i, line in enumerate(page.lines) if line.strip() and page.kinds[i] == "body"]
    out: dict[int, str] = {}
    for place, at in (("top0", 0), ("foot0", -1), ("top1", 1), ("foot1", -2)):
        if -len(full) <= at < len(full):
            out.setdefault(full[at], place)
    return list(out.items())


def _same_figures(a: tuple[str, ...], b: tuple[str, ...], apart: int) -> bool:
    """Whether two lines have the same numbers, but for one that can count the pages or one digit lost."""
    if len(a) == len(b):
        odd = [(x, y) for x, y in zip(a, b) if x != y]
        if not odd or (len(odd) == 1 and 0 < (int(odd[0][1]) - int(odd[0][0])) * (1 if apart > 0 else -1) <= abs(apart)):
            return True
    x, y = "".join(a), "".join(b)
    if min(len(x), len(y)) < 6 or abs(len(x) - len(y)) > 1:
        return False
    front = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
    back = next((i for i, (p, q) in enumerate(zip(x[::-1], y[::-1])) if p != q), min(len(x), len(y)))
    return front + back >= max(len(x), len(y)) - 1


def furniture_features(line: str, place: str, steady: bool, share: float, times: int, run: int, expected: bool | None, marked: bool, after: str, count: int) -> list[str]:
    """Features of a line at a page's edge.

    steady: a like line has the same numbers, but for a count of pages; share,
    times: on how much of the pages, and how often, a like line stands
    in the same place; run: pages of which the number fits the neighbours';
    expected: whether the number is the page's own, if that is known; after:
    what the line before ends with; count: lines of the page.
    """
    s = line.strip()
    number = page_value(s) is not None
    often = "all" if share > 0.85 and times > 1 else "most" if share >= 0.5 and times > 1 else "some" if times > 1 else "once"
    sentence = s[-1:] in ".;," or s[:1].islower()
    bare = s.isdigit()
    written = [w for w in re.findall(r"[^\W\d_]+", s) if len(w) > 1]
    small = sum(w[0].islower() for w in written) * 4 // max(1, len(written))  # running text is mostly in small letters
    return [
        f"small {small} {often}", f"small {small} steady {steady} long {len(written) > 4}", f"colon {s[-1:] == ':'} {often}",
        "bias", f"often {often}", f"often {often} steady {steady} number {number}", f"steady {steady} sentence {sentence} {often}", f"often {often} {marked} {place[:-1]}", f"number {number}", f"number {number} bare {bare} run {min(run, 3)} expected {expected}", f"number {number} {place}", f"sentence {sentence} {often}", f"sentence {sentence}",
        f"number {number} continues {after not in '.!?:' and after != ''} bare {bare}", f"long {len(s) > 60} {often}", f"place {place} {often}", f"number {number} alone {count <= 1}", f"number {number} word {bool(re.search(r'[^0-9ivxlc\W]', s.lower()))} expected {expected}",
    ]


class Furniture:
    """Labels lines at page edges: body, header or page_number."""

    LABELS = ("body", "header", "page_number")

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def label(self, pages: list[Page], marked: bool, first_page: int | None) -> None:
        """Mark furniture from the edges inwards, as long as pages have nothing else at an edge."""
        behind = False
        while self._label(pages, marked, first_page, behind):
            behind = True

    def _label(self, pages: list[Page], marked: bool, first_page: int | None, behind: bool = False, gold: Callable | None = None) -> bool:
        """Mark furniture among the outermost lines; whether there may be more behind it.

        ``behind`` known furniture only lines that stand on nearly all pages are more of it.
        """
        edges = [(k, i, place, page.lines[i]) for k, page in enumerate(pages) for i, place in _edges(page)]
        values = {(k, i): page_value(line.strip()) for k, i, _, line in edges}
        groups: list[tuple[str, str, set[int]]] = []
        exact: dict[tuple[str, str], int] = {}
        sides: dict[str, list[int]] = defaultdict(list)
        ends: dict[tuple[str, str, int], list[int]] = {}
        member: list[int] = []
        for k, i, place, line in edges:
            key, side = _key(line), place[:-1]
            at = exact.get((key, side))
            if at is None:
                # alike keys begin or end alike and differ in length by three at most
                if values[k, i] is None and len(key) > 4:
                    n, have = len(key), sides[side]
                    if len(have) <= 24:  # as many comparisons as the index needs
                        near = [g for g in have if -4 < len(groups[g][0]) - n < 4]
                    else:
                        near = sorted({g for end in (key[:4], "*" + key[-4:]) for m in range(n - 3, n + 4) for g in ends.get((side, end, m), ())})
                    at = next((g for g in near if _close(groups[g][0], key)), None)
                if at is None:
                    at = len(groups)
                    groups.append((key, side, set()))
                    sides[side].append(at)
                    for end in (key[:4], "*" + key[-4:]):
                        ends.setdefault((side, end, len(key)), []).append(at)
                exact[key, side] = at
            groups[at][2].add(k)
            member.append(at)
        by_place: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, i, place, _ in edges:
            if values[k, i] is not None:
                by_place[place].append((k, values[k, i]))
        have = set(by_place["top0"]) | set(by_place["top1"]) | set(by_place["foot0"]) | set(by_place["foot1"])
        n_pages = max(1, len(pages)) if marked else max(1, *(len(g[2]) for g in groups), 1)
        figures: dict[int, list[tuple[int, tuple[str, ...]]]] = defaultdict(list)
        for (k, _, _, line), g in zip(edges, member):
            if len(groups[g][2]) > 1:
                figures[g].append((k, tuple(re.findall(r"\d+", line))))
        new: dict[tuple[int, int], tuple[str, str]] = {}
        for (k, i, place, line), g in zip(edges, member):
            times = len(groups[g][2])
            value = values[k, i]
            if (times == 1 and value is None) or (behind and times / n_pages <= 0.85):
                if gold:
                    gold(k, i, None)
                continue
            run = 0
            expected: bool | None = None
            if value is not None:
                if marked:
                    run = 1 + ((k - 1, value - 1) in have) + ((k + 1, value + 1) in have)
                else:
                    near = [v for q, v in have if q != k]
                    run = 1 + (value - 1 in near) + (value + 1 in near)
                if first_page is not None:
                    expected = value == first_page + k if marked else first_page <= value <= first_page + len(pages)
            lines = pages[k].lines
            prior = next((x.rstrip()[-1] for x in reversed(lines[:i]) if x.strip()), "")
            own = tuple(re.findall(r"\d+", line))
            steady = times == 1 or any(q != k and _same_figures(own, other, q - k) for q, other in figures[g])
            feats = furniture_features(line, place, steady, times / n_pages, times, run, expected, marked, prior, sum(bool(x.strip()) for x in lines))
            if gold:
                gold(k, i, feats)
                continue
            w = self.weights
            kind = max(self.LABELS, key=lambda y: sum(w.get(f"{y} {f}", 0.0) for f in feats))
            if kind != "body":
                new[k, i] = kind, place
        for (k, i), (kind, _) in new.items():
            pages[k].kinds[i] = kind
        # behind both lines of an edge there may be more
        return any(sum(q == k and p[:-1] == place[:-1] for (q, _), (_, p) in new.items()) > 1 for (k, _), (_, place) in new.items() if place[-1] == "1")

    @classmethod
    def train(cls, documents: int = 1500, seed: int = 19) -> Furniture:
        rng, model = random.Random(seed), Perceptron()
        data = []
        for _ in range(documents):
            text, first, truth = _page_document(rng)
            pages, marked = split_pages(text)

            def take(k: int, i: int, feats: list[str] | None, pages: list[Page] = pages, truth: dict[str, str] = truth) -> None:
                if feats:
                    data.append((feats, truth.get(pages[k].lines[i], "body")))

            cls({})._label(pages, marked, first, gold=take)
        for _ in range(6):
            rng.shuffle(data)
            for feats, y in data:
                guess = max(cls.LABELS, key=lambda z: model.score([f"{z} {f}" for f in feats]))
                if guess != y:
                    model.update([f"{y} {f}" for f in feats], [f"{guess} {f}" for f in feats])
        return cls(model.average())


def _page_document(rng: random.Random) -> tuple[str, int | None, dict[str, str]]:
    """A generated document: text, its first page number if known, and the furniture among its lines."""
    stock = "the patient was seen for review of pain in left knee and plan includes rest with daily exercise at home before next visit no change is noted today under care of team".split()
    sentence = lambda: (" ".join(rng.choices(stock, k=rng.randint(5, 12))).capitalize() + ".")
    n, first, truth = rng.choice((1, 1, 2, 3, 4, 6)), rng.randrange(1, 200), {}
    name = " ".join(rng.choice(("North", "Green", "Lake", "Stone", "Hill", "West")) for _ in range(2)) + rng.choice((" Clinic", " Hospital", " Center", " Group"))
    header = rng.choice((None, None, f"CONFIDENTIAL * {name}", f"{name} - Report", "Chart Notes (continued)", f"Report | printed 0{rng.randrange(1, 9)}/12/2023", f"fax from {name} 01/02/2023 10:{rng.randrange(10, 60)}", f"{name.upper()}    SUMMARY", f"Released to requester 01/02/2023   {name}")) if n > 1 else None
    form = rng.choice((None, "Page {n} of 900", "[{n}]", "- {n} -", "~ {n} ~", "{n}", "PAGE {n}", "P a g e  {n}", "pg. {n}/900", "Sheet {n} / 900", "{r}"))
    inside, foot_header, foot_number = header and form and rng.random() < 0.25, rng.random() < 0.3, rng.random() < 0.7
    under = rng.random() < 0.4  # the number below a header at the top
    repeated, templated, pages = sentence(), rng.choice((0, 0, 0, 1)), []
    for k in range(n):
        body = [sentence() for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            body[rng.choice((0, -1, rng.randrange(len(body))))] = repeated
        if templated and rng.random() < 0.8:
            body[templated - 1] = f"Level was {rng.randrange(1, 99)}.{rng.randrange(10)} units and the rate was {rng.randrange(10, 99)}."
        lines: list[str] = []
        for _ in range(rng.choice((0, 0, 1, 2))):
            body.insert(rng.choice((0, rng.randrange(len(body) + 1))), rng.choice(("Plan:", "History:", "Examination:", "Medications:")))
        for s in body:
            if lines and (s[-1] == ":" or rng.random() < 0.1):
                lines.append("")
            ws = s.split(" ")
            while ws:
                lines.append(" ".join(ws[:9]))
                ws = ws[9:]
        if rng.random() < 0.25:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = ["Weekly scores were", *(str(rng.randrange(1, 30)) for _ in range(rng.randint(2, 4))), "with no missed week."]
        number = form and form.format(n=first + k, r=_to_roman(first + k))
        if header:
            h = header + (f"     {number}" if inside else "")
            if rng.random() < 0.25:
                at = rng.choice([j for j, c in enumerate(header) if c.isalnum()])
                h = h[:at] + rng.choice((" ", ".", "")) + h[at + 1 :]
            truth[h] = "header"
            lines = [*lines, h] if foot_header else [h, *lines]
        if number and not inside:
            truth[number] = "page_number"
            at = 1 if header and not foot_header and under else 0
            lines = [*lines, number] if foot_number else [*lines[:at], number, *lines[at:]]
        pages.append("\n".join(lines))
    return ("\f" if rng.random() < 0.6 else "\n\n").join(pages), first if rng.random() < 0.7 else None, truth


def _to_roman(n: int) -> str:
    out = ""
    for v, s in ((100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while n >= v:
            out, n = out + s, n - v
    return out


# --- repair -----------------------------------------------------------------


class Repairer:
    def __init__(self, editor: Editor, joiner: Joiner, furniture: Furniture):
        self.editor, self.joiner, self.furniture = editor, joiner, furniture
        self._good: set[str] = set()

    def __getstate__(self) -> dict:
        return {"parts": (self.editor, self.joiner, self.furniture)}

    def __setstate__(self, state: dict) -> None:
        self.__init__(*state["parts"])

    @classmethod
    def train(cls, words: Words) -> Repairer:
        editor = Editor.train(words)
        return cls(editor, Joiner.train(editor), Furniture.train())

    def repair(self, text: str, first_page: int | None = None, with_text: bool = True) -> tuple[str | None, list[str]]:
        """The text in paragraphs without noise, and the kinds of noise it had."""
        kinds: set[str] = set()
        pages, marked = split_pages(text)
        self.furniture.label(pages, marked, first_page)
        body: list[str] = []  # lines; an empty one ends a paragraph
        headers: dict[int, list[str]] = defaultdict(list)
        for k, page in enumerate(pages):
            if k and not marked:
                body.append("")
            for line, kind in zip(page.lines, page.kinds):
                if kind == "body":
                    body.append(line)
                else:
                    kinds.add(kind)
                    if kind == "header":
                        headers[k].append(line)
        if headers and "page_number" not in kinds and self._numbered(headers):
            kinds.add("page_number")
        lines = self._join(body, kinds)
        good, editor = self._good, self.editor
        if len(good) > 400_000:
            good.clear()
        out: list[str] = []
        for line in lines:
            tokens = line.split()
            if not good.issuperset(tokens):
                fixed = []
                for t in tokens:
                    r = t if t in good else editor.repair(t)
                    if r == t:
                        good.add(t)
                    else:
                        kinds.add("misread")
                        before = fixed[-1] if fixed else out[-1] if out else "."
                        if r[0].lower() != r[0] != t[0] and r[1:].islower() and before[-1:] not in ".!?:":
                            r = r[0].lower() + r[1:]  # inside a sentence
                    fixed.append(r)
                tokens = fixed
            if with_text:
                out.append(" ".join(tokens))
        return (self._paragraphs(out) if with_text else None), sorted(kinds)

    @staticmethod
    def _numbered(headers: dict[int, list[str]]) -> bool:
        """Whether page numbers run through the headers."""
        seen = {k: {int(m.group(1)) for line in lines for m in _PAGE_PART.finditer(line)} for k, lines in headers.items()}
        if sum(bool(v) for v in seen.values()) * 2 > len(seen):
            return True
        ends = {k: {int(x) for line in lines for x in re.findall(r"(?<![\d/:.-])\d{1,4}(?![\d/:.-])", line)} for k, lines in headers.items()}
        return len(ends) > 1 and sum(any(v + 1 in ends.get(k + 1, ()) for v in vs) for k, vs in ends.items()) * 2 >= len(ends) - 1 > 0

    def _join(self, lines: list[str], kinds: set[str]) -> list[str]:
        """Lines with divided words put together on the upper line."""
        out: list[str] = []
        at = 0
        lines = list(lines)
        while at < len(lines):
            line = lines[at]
            tail = line.rstrip()
            if tail and tail[-1] in MARKS:
                m = _LAST.search(line)
                nxt = next((j for j in range(at + 1, min(at + 4, len(lines))) if lines[j].strip()), None)
                if m and nxt is not None:
                    head = lines[nxt].lstrip()
                    word = head.split(None, 1)[0]
                    left = m.group(2)
                    if (left.isdigit() or not m.group(1)[-1:].isalnum()) and word[:1] and self.joiner.divides(left, m.group(3), word, self.editor):
                        kinds.add("hyphen")
                        lines[nxt] = head[len(word) :].lstrip()
                        line = line[: m.start(3)] + word
                        if not lines[nxt]:
                            del lines[nxt]
                        elif nxt > at + 1:  # the break between pages or paragraphs went through the word
                            del lines[at + 1 : nxt]
            out.append(line)
            at += 1
        return out

    @staticmethod
    def _paragraphs(lines: list[str]) -> str:
        """Lines run on within a paragraph; headings and list items keep their lines, and a
        paragraph that stops inside a sentence runs on after an empty line."""
        parts: list[str] = []
        fresh = True
        for line in lines:
            if not line:
                fresh = True
                continue
            if not parts:
                parts.append(line)
            elif re.match(r"[-*•]\s|\d+[.)]\s", line) or parts[-1].rsplit("\n", 1)[-1].endswith(":"):
                parts[-1 if not fresh else len(parts) :] = [parts[-1] + "\n" + line] if not fresh else [line]
            elif fresh and (parts[-1][-1:] in ".!?:)]\"" or not line[:1].islower()):
                parts.append(line)
            else:
                parts[-1] += " " + line
            fresh = False
        return "\n\n".join(parts)


def train_repairer(texts: DataFrame) -> Repairer:
    return Repairer.train(known_words(texts.select("text").filter("text is not null")))


def repair_scans(texts: DataFrame, repairer: Repairer | None = None, with_text: bool = True) -> DataFrame:
    """(record_table, record_id, clean_text, noise_kinds) of every row with text.

    texts: record_table, record_id, text, first_page (int, null where unknown).
    noise_kinds holds those of :data:`NOISE_KINDS` that the text had, sorted.
    Null and blank texts have no row; texts are repaired whole, whatever their
    length; repeated rows come out once each; an empty table gives an empty
    result.  ``with_text`` false leaves the text out, for reports.
    """
    repairer = repairer or train_repairer(texts)
    rows = texts.select("record_table", "record_id", "text", "first_page").filter(F.col("text").rlike(r"\S"))
    fields = [*rows.select("record_table", "record_id").schema.fields]
    if with_text:
        fields.append(T.StructField("clean_text", T.StringType()))
    fields.append(T.StructField("noise_kinds", T.ArrayType(T.StringType())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [repairer.repair(t, None if pd.isna(p) else int(p), with_text) for t, p in zip(batch.text, batch.first_page)]
            out = batch[["record_table", "record_id"]].copy()
            if with_text:
                out["clean_text"] = [d[0] for d in done]
            out["noise_kinds"] = [d[1] for d in done]
            yield out

    return rows.mapInPandas(run, T.StructType(fields))
