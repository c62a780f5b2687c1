"""Personal information in free text, found and replaced by typed placeholders.

A semi-Markov conditional random field over candidate segments.  Segments are
bounded spans that can be an e-mail address, a phone number, a number of a
person, a street address or a name at all; each is scored as a whole (its shape,
its words, what stands around it), and dynamic programming over the segments
chooses boundaries and types together.  Text outside segments scores zero.

The weights are trained by maximum likelihood (forward-backward over the same
lattice) on sentences generated from the grammar in :func:`training_sentences`;
no row of the corpus is needed, so the model is the same at every scale.
Redaction is one narrow stage over the text column.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = ("email", "phone", "id_number", "address", "name")
#: Most capitalised words of a name.
NAME_WORDS = 7
#: Small words inside names (fixed values).
PARTICLES = r"(?:de|del|della|di|da|do|dos|das|du|d'|la|las|los|le|van|von|der|den|ter|zu|zur|y|e|bin|ibn|al|el|af)"

#: Given names of many languages (fixed values).
GIVEN = frozenset(
    """adam ahmed aisha alan alex alice amina ana andre andrea andrew angela anita anna anne antonio arjun ava barbara ben carla carlos carmen carol
    caroline charles chen chloe chris claire clara daniel dario david deborah diana diego dmitri edward elena elif elizabeth ella emily emma eric eva
    fatima felix fiona frank gabriel george grace greta hannah hans hassan helen henry hiroshi hugo ibrahim ines ingrid irene isabel ivan jack jacob
    james jan jane javier jennifer jessica joan john jonas jose joseph juan julia karen karl kate kevin klaus laura leila lena leo linda lisa louis
    lucas lucia luis maja marco margaret maria marie mark marta martin mary matthew mei michael miguel mohammed nadia nancy natalia nicolas nina noah
    nora olga oliver olivia omar oscar pablo patricia paul pedro peter petra philip pierre piotr priya rachel raj rebecca richard robert rosa ruth
    samir samuel sandra sara sarah sofia sophie stefan susan sven tariq thomas tomas victor viktor walter wei william yara yuki yusuf zoe""".split()
)
#: Words after which a single capitalised word is a surname (fixed values).
TITLES = ("dr", "mr", "mrs", "ms", "miss", "mx", "prof", "professor", "doctor", "nurse", "herr", "frau", "sr", "sra", "srta", "señor", "señora", "rev", "madam")
#: Words of organisations, documents and products, which aren't parts of names (fixed values).
NOT_NAMES = frozenset(
    """clinic hospital center centre institute imaging practice care health group suite medical surgical rehabilitation community family urgent spine
    laboratory pharmacy department ward unit office insurance university college school associates partners services service system network street
    road avenue lane court way terrace boulevard blvd drive place square note notes report summary sheet copy record records packet progress discharge
    encounter therapy continuation chart page confidential billing patient patients provider providers plan assessment history diagnosis diagnoses
    medication medications findings scale index test score rating retard duo forte xr tablet tablets january february march april may june july august
    september october november december monday tuesday wednesday thursday friday saturday sunday the a an der die das el la los las un una eine ein
    this that these those there his her their our and of for with from on in at to by no not icd cpt vital blood review gait strength body serum
    follow coding seen imaging examination emergency contact home current electronically signed referred bill copy fax cell phone email address
    born form letter equipment registration identity reply portal results lives left call call reached handover daughter son spouse""".split()
)
#: Street words (fixed values).
STREETS = r"(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|court|ct|terrace|ter|way|drive|dr|place|pl|square|sq|parkway|pkwy|circle|crescent|close|highway|hwy|row|walk|alley)"

_UP = "A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĘĚĞĢĦĪİĶĹĻŁŃŇŐŒŔŘŚŞŠŢŤŪŮŰŹŻŽ"
_IN = r"\w'’|!†"
_CAP = rf"[{_UP}][{_IN}]*(?:-\s?[{_IN}]+)*"
#: Capitalised words in a row, also with small words of names between them, however many; only the spans inside are bounded.
_RUN = re.compile(rf"(?<![\w@.+]){_CAP}\.?(?:,?\s{{1,3}}(?:{PARTICLES}\s{{1,3}}){{0,3}}{_CAP}\.?)+")
#: A title and the word after it.  All alternatives start with a capital, which lets the scan skip; callers check what stands before.
_ONE = re.compile("(?:" + "|".join(sorted({v for t in TITLES for v in (t.capitalize(), t.upper())})) + rf")\b\.?\s{{1,3}}({_CAP})")
_NURSE = re.compile(rf"nurse\s{{1,3}}({_CAP})")
_PARTICLE = re.compile(rf"\s{PARTICLES}\s")
_WORD_IN_RUN = re.compile(_CAP)
_EMAIL = re.compile(r"[\w.+%-]{1,64}(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?)[\w-]+(?:(?:\s?[(\[{]\s?dot\s?[)\]}]\s?|\.)[\w-]+)+", re.I)
#: Runs of digits with the marks that join them; what a run holds is sorted out afterwards.
_DIGITS = re.compile(r"\d[\d().+\-/ \n]{4,}\d")
_DATE = r"(?<!\d)(?:0?[1-9]|[12]\d|3[01])[/.-](?:0?[1-9]|[12]\d|3[01])[/.-](?:(?:19|20)\d\d|\d\d)(?!\d)|(?<!\d)(?:19|20)\d\d-\d{2}-\d{2}(?!\d)"
_ONLY_DATE = re.compile(_DATE)
_JOINT = re.compile(_DATE + r"|\.\s+|\s{2,}|\n-|\d{3,5}/\d{2,}|\s/\s|\n(?=\d{1,2}(?![\d .-]))")
_STREET = re.compile(rf"\b{STREETS}\b", re.I)
_EXTENSION = re.compile(r"\s?(?:ext|extension|x)\.?\s?\d{1,5}\b", re.I)
_HOUSE = re.compile(
    rf"(?:(?:unit|apt|suite|flat)\.?\s+\d+ ?/ ?)?\d{{1,5}}(?:[-/]\d{{1,4}})?[a-z]?[ \t\n]{{1,2}}(?:[NSEW]\.?\s)?(?:[{_UP}][{_IN}-]*[ \t\n]{{1,2}}){{1,3}}{STREETS}\b\.?"
    rf"(?:,?[ \t\n]{{1,2}}(?:apt|unit|suite|flat|#)\.?\s?\w{{1,5}}\b)?(?:,[ \t\n]{{1,2}}{_CAP}(?:\s{_CAP})?(?:,?\s[A-Z]{{2}}\b)?)?(?:[ \t\n]{{1,2}}\d{{5}}(?:-\d{{4}})?\b)?",
    re.I,
)
_HOUSE_AT = re.compile(r"(?:\b(?:unit|apt|suite|flat)\.?\s+)?\d", re.I)
_AFTER = re.compile(
    rf"[{_UP}][\w-]*(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|ufer)\s{{1,2}}\d{{1,4}}[a-z]?\b(?:,\s{{1,2}}\d{{4,5}}\s{_CAP})?|(?:calle|avenida|avda\.|plaza|paseo|camino|c/)\s{{1,2}}(?:{_CAP}\s?){{1,3}},?\s?\d{{1,4}}\b(?:,\s{{1,2}}\d{{4,5}}\s{_CAP})?",
    re.I,
)
_CUES_AFTER = ("weg ", "weg\n", "WEG ", "straße", "strasse", "STRASSE", "tr. ", "gasse ", "platz ", "allee ", "Calle ", "calle ", "Avenida", "Avda", "Plaza ", "Paseo ", "Camino ", "C/")
_MARKS = ".,;:!?()[]{}'\"-*<>"
_plain_letters = str.maketrans("áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÉÈÊËÍÓÔÖÚÜÑÇ", "aaaaaaeeeeiiiiooooouuuuncAAAAEEEEIOOOUUNC")


def _plain(word: str) -> str:
    return word.lower().translate(_plain_letters).strip("-'’.")


def _number(text: str, lo: int, hi: int, out: list[tuple[int, int, str]]) -> None:
    """Add the phone and identity numbers that ``text[lo:hi]`` can be."""
    while lo < hi and not text[lo].isdigit():
        lo += 1
    while hi > lo and not text[hi - 1].isdigit():
        hi -= 1
    digits = sum(map(str.isdigit, text[lo:hi]))
    if not 6 <= digits <= 15 or text.count("/", lo, hi) > 1 or (hi < len(text) and (text[hi].isalpha() or text[hi] == ":")):
        return
    start = lo
    while start and start > lo - 3 and text[start - 1].isupper():
        start -= 1
    if start == lo and start and text[start - 1] == "(":
        start -= 1
    if start and text[start - 1] == "+" or start > 1 and text[start - 2 : start] == "+ ":
        start = text.rfind("+", 0, start)
    if start and text[start - 1].isalnum():
        return
    out += [(start, hi, "phone"), (start, hi, "id_number")]
    ext = _EXTENSION.match(text, hi)
    if ext:
        out.append((start, ext.end(), "phone"))


#: Runs longer than this, in characters, are rare and not remembered.
_LONG_RUN = 200


def _spans_of(run: str) -> tuple[tuple[int, int], ...]:
    """Spans of two to :data:`NAME_WORDS` words within a run of capitalised words that can be names."""
    parts = [w.span() for w in _WORD_IN_RUN.finditer(run)]
    known = [_plain(run[a:b]) in NOT_NAMES for a, b in parts]
    return tuple(
        (parts[i][0], parts[j][1])
        for i in range(len(parts))
        for j in range(i + 1, min(i + NAME_WORDS, len(parts)))
        if parts[j][1] - parts[j][0] > 1 and not (known[i] and known[j])
    )


_remembered_spans = functools.lru_cache(100_000)(_spans_of)


def _name_spans(run: str) -> tuple[tuple[int, int], ...]:
    return (_spans_of if len(run) > _LONG_RUN else _remembered_spans)(run)


def _is_address(span: str) -> bool:
    """Whether an e-mail address has the lengths that the mail standards allow and ends in a domain's letters,
    written in one case unless there are three at most (a sentence may follow an at sign without a blank)."""
    labels = re.split(r"\.|\s?[(\[{]\s?dot\s?[)\]}]\s?", re.split(r"@|[(\[{]\s?at\s?[)\]}]", span, flags=re.I)[-1].strip(), flags=re.I)
    last = labels[-1]
    return len(span) <= 254 and max(map(len, labels)) <= 63 and last.isalpha() and 2 <= len(last) <= 24 and (last.islower() or last.isupper() or len(last) < 4)


def segments(text: str) -> list[tuple[int, int, str]]:
    """Candidate segments (start, end, type); a span may stand for several types."""
    out: list[tuple[int, int, str]] = []
    if "@" in text or "at)" in text or "at]" in text or "at}" in text or "AT)" in text or "AT]" in text:
        out += [(m.start(), m.end(), "email") for m in _EMAIL.finditer(text) if _is_address(m.group())]
    for m in _DIGITS.finditer(text):
        if not _ONLY_DATE.fullmatch(m.group()):
            at = m.start()
            for j in [*_JOINT.finditer(text, m.start(), m.end()), None]:
                end = j.start() if j else m.end()
                if end - at >= 6:
                    _number(text, at, end, out)
                at = j.end() if j else end
    for m in _HOUSE_STARTS.finditer(text):
        h = _HOUSE.match(text, m.start())
        if h:
            out.append((*h.span(), "address"))
            if h.group()[-1] == ".":
                out.append((h.start(), h.end() - 1, "address"))
    if any(cue in text for cue in _CUES_AFTER):
        out += [(*h.span(), "address") for h in _AFTER.finditer(text)]
    for m in _RUN.finditer(text):
        at = m.start()
        out += [(at + a, at + b, "name") for a, b in _name_spans(m.group())]
    for m in (*_ONE.finditer(text), *_NURSE.finditer(text)) if "nurse " in text or "nurse\n" in text else _ONE.finditer(text):
        if len(m.group(1)) > 2 and not (m.start() and text[m.start() - 1].isalnum()):
            out.append((*m.span(1), "name"))
    return out


#: A number followed by a capitalised word: where street addresses can start.
_HOUSE_STARTS = re.compile(rf"(?<![\w/-])(?:[Uu](?:nit|NIT)\s+\d+\s?/\s?)?\d{{1,5}}(?:[-/]\d{{1,4}})?[a-z]?[ \t\n]{{1,2}}(?=[{_UP}])")


def _around(text: str, lo: int, hi: int) -> tuple[list[str], list[str]]:
    left = [w for x in text[max(0, lo - 48) : lo].lower().split()[-4:] if (w := x.strip(_MARKS))]
    right = [w for x in text[hi : hi + 28].lower().split()[:3] if (w := x.strip(_MARKS))]
    return left, right[:2]


def _inner(span: str, kind: str) -> tuple[list[str], str]:
    """Features of a whole segment by itself, and a summary of its form that context features are joined with."""
    f = [kind]
    if kind == "email":
        f.append("tld" + str(bool(re.search(r"(?:\.|dot\W{0,2})\s?[a-z]{2,8}$", span, re.I))))
        return f, ""
    if kind in ("phone", "id_number"):
        digits = sum(c.isdigit() for c in span)
        shape = re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", re.sub(r"\s", " ", span)))[:24]
        f += [f"shape={shape}", f"digits={digits}", f"lead={shape[:1]}", f"letters={'A' in shape}", f"dash={shape.count('-')}", f"paren={'(' in shape}", f"space={shape.count(' ')}"]
        if _EXTENSION.search(span):
            f.append("ext")
        return f, shape
    if kind == "address":
        f += [f"street={bool(_STREET.search(span))}", f"zip={bool(re.search(r'[0-9]{5}', span))}", f"town={',' in span}", f"stop={span[-1] == '.'}"]
        return f, ""
    tokens = [_plain(t) for t in _WORD_IN_RUN.findall(span)]
    comma = "," in span
    first = tokens[-1] if comma and len(tokens) > 1 else tokens[0]
    bad = sum(t in NOT_NAMES or any(p in NOT_NAMES for p in t.split("-")) for t in tokens)
    given = first in GIVEN
    n = min(len(tokens), 6)
    f += [f"particle={bool(_PARTICLE.search(span))}", f"n={n}", f"bad={min(bad, 2)}", f"given={given}{comma}", f"given={given}n{n}", f"firstbad={tokens[0] in NOT_NAMES}", f"lastbad={tokens[-1] in NOT_NAMES}"]
    f += [f"upper={span.isupper()}", f"initial={any(len(t) == 1 for t in tokens[1:-1])}", f"lastinitial={len(tokens[-1]) == 1}", f"othergiven={sum(t in GIVEN for t in tokens) - given}"]
    f.append(f"brk={bool(re.search(r'[.!?][ ]', span)) and not re.search(r'(?<![^ ,])[^0-9a-z_][.][ ]', span)}")
    return f, f"n{n}"


def _outer(kind: str, form: str, left: list[str], right: list[str], edge: str) -> list[str]:
    """Features of what stands around a segment."""
    if kind == "email":
        return []
    l1, r1 = (left[-1] if left else "^"), (right[0] if right else "$")
    if kind == "address":
        return [f"l1={l1}", f"r1={r1}", f"r1bad={r1 in NOT_NAMES}", f"edge={edge}"]
    if kind != "name":
        return [f"l1={l1}", f"r1={r1}", f"l1s={l1}|{form}", *(f"l={w}" for w in dict.fromkeys(left[-4:]))]
    f = [f"l1={l1}", f"r1={r1}", f"l2={left[-2] if len(left) > 1 else '^'} {l1}", f"edge={edge}", *(f"l={w}" for w in dict.fromkeys(left[-3:])), *(f"r={w}" for w in right)]
    if l1 in TITLES:
        f.append("title" + form)
    if r1 in NOT_NAMES:
        f.append("rightbad")
    if r1 in GIVEN:
        f.append("rightgiven")
    if l1 in GIVEN and not left_break(edge):
        f.append("leftgiven")
    return f


def left_break(edge: str) -> bool:
    return edge[:1] in ".!?:;\n^"


def _edge(text: str, lo: int, hi: int) -> str:
    """What stands just before and after the segment, ignoring blanks."""
    a, b = lo - 1, hi
    while a >= 0 and text[a] in " \t":
        a -= 1
    while b < len(text) and text[b] in " \t":
        b += 1
    one = lambda c: "w" if c.isalnum() else c
    return (one(text[a]) if a >= 0 else "^") + (one(text[b]) if b < len(text) else "$")


class SemiMarkov:
    """Weights per feature (type and feature name) and the decoding over segments."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._memo: dict[tuple, float] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__init__(state["weights"])

    def score(self, text: str, lo: int, hi: int, kind: str) -> float:
        w, span = self.weights, text[lo:hi]
        known = self._memo.get((kind, span))
        if known is None:
            if len(self._memo) > 200_000:
                self._memo.clear()
            f, form = _inner(span, kind)
            known = self._memo[kind, span] = (sum(w.get(f"{kind}:{x}", 0.0) for x in f), form)
        left, right = _around(text, lo, hi)
        head = kind + ":"
        return known[0] + sum([w.get(head + x, 0.0) for x in _outer(kind, known[1], left, right, _edge(text, lo, hi))])

    def decode(self, text: str) -> list[tuple[int, int, str]]:
        """The best set of segments that don't overlap."""
        scored = [(hi, lo, s, kind) for lo, hi, kind in segments(text) if (s := self.score(text, lo, hi, kind)) > 0]
        if not scored:
            return []
        if len(scored) == 1:
            hi, lo, _, kind = scored[0]
            return [(lo, hi, kind)]
        scored.sort()
        ends = [x[0] for x in scored]
        best: list[float] = [0.0]
        back: list[tuple[int, bool]] = [(0, False)]
        from bisect import bisect_right

        for i, (_, lo, s, _) in enumerate(scored):
            j = bisect_right(ends, lo, 0, i)
            take = best[j] + s
            best.append(max(best[i], take))
            back.append((j, True) if take > best[i] else (i, False))
        out, i = [], len(scored)
        while i:
            j, taken = back[i]
            if taken:
                hi, lo, _, kind = scored[i - 1]
                out.append((lo, hi, kind))
            i = j
        return out[::-1]


def train(sentences: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 4, rate: float = 0.3, decay: float = 2e-4, seed: int = 5) -> SemiMarkov:
    """Maximum likelihood by AdaGrad; marginals from forward-backward over each sentence's lattice."""
    rng = random.Random(seed)
    data = []
    for text, gold in sentences:
        found = sorted({(hi, lo, kind) for lo, hi, kind in segments(text)})
        if not found:
            continue
        truth = {(hi, lo, kind) for lo, hi, kind in gold}
        feats = []
        for hi, lo, kind in found:
            f, form = _inner(text[lo:hi], kind)
            feats.append([f"{kind}:{x}" for x in (*f, *_outer(kind, form, *_around(text, lo, hi), _edge(text, lo, hi)))])
        data.append((found, [x in truth for x in found], feats))
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-2)
    for _ in range(epochs):
        rng.shuffle(data)
        for found, gold, feats in data:
            scores = [sum(weights[f] for f in fs) for fs in feats]
            for p, g, fs in zip(_marginals(found, scores), gold, feats):
                error = p - g
                if abs(error) > 1e-3:
                    for f in fs:
                        grad = error + decay * weights[f]
                        squares[f] += grad * grad
                        weights[f] -= rate * grad / math.sqrt(squares[f])
    return SemiMarkov(dict(weights))


def _log_add(a: float, b: float) -> float:
    m = max(a, b)
    return m + math.log(math.exp(a - m) + math.exp(b - m))


def _marginals(found: list[tuple[int, int, str]], scores: list[float]) -> list[float]:
    """Probability of each segment (hi, lo, type), sorted by end, under the sums over all non-overlapping sets."""
    from bisect import bisect_left, bisect_right

    n = len(found)
    ends = [x[0] for x in found]
    before = [bisect_right(ends, lo) for _, lo, _ in found]
    forward = [0.0]
    for i in range(n):
        forward.append(_log_add(forward[i], forward[min(before[i], i)] + scores[i]))
    # backward over segments sorted by start
    order = sorted(range(n), key=lambda i: found[i][1])
    starts = [found[i][1] for i in order]
    backward = [0.0] * (n + 1)
    for k in range(n - 1, -1, -1):
        i = order[k]
        backward[k] = _log_add(backward[k + 1], backward[bisect_left(starts, found[i][0])] + scores[i])
    total = forward[n]
    return [math.exp(min(0.0, forward[min(before[i], i)] + scores[i] + backward[bisect_left(starts, found[i][0])] - total)) for i in range(n)]


# --- training grammar -------------------------------------------------------

_SYLLABLES = "bra cal dor fen gal hal ist jor kro lan mir nor orl pel quin ros stra tan ul ven wil yar zel thor mac ber ham dal gri sto".split()
_TAILS = "son man sen ley ton berg ez ski ova ini etti ard worth ford well mann quist dottir ic er a el o en is ine ade wick".split()
_DRUGS = "amoxil benor cetrin dolvan ezomil fluvane glucor hydrax ibunol jantol".split()


def _surname(rng: random.Random) -> str:
    s = rng.choice(_SYLLABLES) + (rng.choice(_SYLLABLES) if rng.random() < 0.3 else "") + rng.choice(_TAILS)
    s = s.capitalize()
    return s + "-" + _surname(rng).split("-")[0] if rng.random() < 0.08 else s


def _name(rng: random.Random) -> str:
    first, last = rng.choice(_given()).capitalize(), _surname(rng)
    if rng.random() < 0.15:  # names no list has
        first = (rng.choice(_SYLLABLES) + rng.choice("aeio")).capitalize()
    if rng.random() < 0.07:  # several given names or surnames, with small words between them
        more = " ".join(rng.choice(_given()).capitalize() for _ in range(rng.choice((0, 0, 1, 2))))
        small = rng.choice(("", "", "de ", "de la ", "del ", "van ", "van der ", "von ", "da ", "dos ", "di ", "al "))
        end = rng.choice(("", f" {_surname(rng)}", f" y {_surname(rng)}", f" {_surname(rng)} {_surname(rng)}"))
        s = " ".join(f"{first} {more} {small}{last}{end}".split())
        return s.upper() if rng.random() < 0.12 else s
    r = rng.random()
    s = f"{last}, {first}" if r < 0.12 else f"{first} {rng.choice('ABCDEFGHJKLMNPRST')}. {last}" if r < 0.25 else f"{first} {last}"
    return s.upper() if rng.random() < 0.12 else s


@functools.cache
def _given() -> tuple[str, ...]:
    return tuple(sorted(GIVEN))


def _digits(rng: random.Random, form: str) -> str:
    return "".join(str(rng.randrange(10)) if c == "9" else rng.choice("ABCDEFGHKLMNPRSTX") if c == "A" else c for c in form)


def _email(rng: random.Random) -> str:
    user = rng.choice(["{f}.{l}", "{l}.{i}", "{f}+{d}", "{l}_{n}", "{i}{l}", "{f}{n}"]).format(f=rng.choice(_given()), l=_surname(rng).lower(), i=rng.choice("abcdefgh"), d=rng.choice(["clinic", "home"]), n=rng.randrange(100))
    host, tld = rng.choice(["mail", "inbox", "north-gate", "home", "post"]), rng.choice(["example", "test", "org", "com", "net", "invalid"])
    r = rng.random()
    s = f"{user}@{host}.{tld}" if r < 0.6 else f"{user} @ {host}.{tld}" if r < 0.75 else f"{user}[at]{host}.{tld}" if r < 0.88 else f"{user} (at) {host} (dot) {tld}"
    return s.upper() if rng.random() < 0.1 else s


def _phone(rng: random.Random) -> str:
    s = _digits(rng, rng.choice(["(999) 999-9999", "999-999-9999", "+1-999-999-9999", "+1 999 999 9999", "+44 20 9999 9999", "+49 30 9999999", "999.999.9999", "9999999999", "999-9999", "+34 999 999 999", "+1 (999) 999-9999", "999 999 9999"]))
    return s + _digits(rng, rng.choice([" ext. 99", " ext 999", " x99"])) if rng.random() < 0.12 else s


_ID_FORMS = ["999-99-9999", "999 99 9999", "9999999", "99999999", "A9999999", "AA999999", "9999 999 999", "999999-9999", "99-99-9999", "99-9999999", "A99-9999-99", "999999999", "99999999A", "9999-9999"]
_ID_NAMES = ["SSN", "MRN", "social security number", "medical record no.", "record number", "member id", "member number", "policy holder no.", "policy number", "passport no.", "passport", "driver licence", "driver's license", "tax id", "tax number", "health card", "health card no.", "national identity number", "national id", "insurance member no.", "identity number", "NHS number", "patient id"]
_THING_FORMS = ["9999999999", "9999-99", "99A-9999", "999-99-9999", "99999", "9999 99", "A99999", "99-9999", "999999", "99999999", "9999-9999"]
_THINGS = ["Accession", "Specimen", "Device serial", "Infusion pump", "Vaccine lot", "Lot", "CPT", "Claim", "Invoice", "Order", "Room", "Serial no.", "Batch", "Reference", "Ref.", "Model", "Filed under no.", "Pump", "Catalog no.", "Ticket", "Packet", "Sheet"]


def _street(rng: random.Random) -> str:
    word = lambda: (rng.choice(_SYLLABLES) + rng.choice(_TAILS)).capitalize()
    name = rng.choice([word(), f"{word()} {rng.choice(['Bend', 'View', 'Hill', 'Park'])}", f"{rng.choice(['Old', 'North', 'Ninth', 'Upper'])} {word()}"])
    kind = rng.choice(["Street", "St", "Avenue", "Ave.", "Road", "Rd", "Blvd", "Lane", "Court", "Terrace", "Way", "Drive"])
    town, house = word(), str(rng.randrange(1, 999))
    if rng.random() < 0.15:
        return f"{word()}{rng.choice(['weg', 'straße', 'gasse'])} {rng.randrange(1, 90)}" + (f", {_digits(rng, '99999')} {town}" if rng.random() < 0.7 else "")
    s = f"{house} {name} {kind}"
    if rng.random() < 0.12:
        s = f"Unit {rng.randrange(1, 60)}/{s}"
    elif rng.random() < 0.12:
        s = f"{house}-{rng.randrange(1, 30)} {name} {kind}"
    if rng.random() < 0.2:
        s += f", Apt {rng.randrange(1, 60)}"
    if rng.random() < 0.65:
        s += f", {town}" + (f" {_digits(rng, '99999')}" if rng.random() < 0.6 else "")
    return s.upper() if rng.random() < 0.12 else s


_NAME_FRAMES = [
    "Patient {name}, born {date}, MRN {id}.", "Patient: {name}.", "Patient {name} was seen on {date}.", "The daughter, {name}, gave the history.", "His wife, {name}, was present.", "Emergency contact is {name} (sister).", "Emergency contact is {name}.", "{name} can be called on {phone}.",
    "Electronically signed by {name}, MD.", "Signed by {name}, RN.", "Referred by {name}, MD.", "{name} denies fever.", "{name} reports mild pain.", "{name} was accompanied by an interpreter.", "The form was completed by {name}.", "Bill to {name}, {address}.", "Next of kin: {name}.", "Contact: {name}, {phone}.",
    "Dr. {surname} reviewed the results.", "Dr. {surname} will see the patient.", "Mrs. {surname} declined the study.", "Mr. {surname} attended with the son.", "Ms. {surname} was accompanied by a friend.", "Handover was given to nurse {surname}.", "Discussed with Dr. {surname}.", "Dr. {name} was informed.", "Seen by {name} at {org}.", "{name} reviewed the chart.", "Mr. {name} called on {date}.", "cc: {name}", "Frau {surname} wurde informiert.", "Interpreter {name} was present.", "Guardian {name} consented.",
]
_OTHER_FRAMES = [
    "Home address is {address}.", "Lives at {address}.", "The letter was mailed to {address}.", "Current residence: {address}.", "Equipment was delivered to {address}.", "Moved to {address} in {month}.", "Address: {address}.", "Call back at {phone}.", "Cell: {phone} after 5 pm.", "Fax results to {phone} during the week.", "Left a message at {phone}.", "Reached by phone on {phone}.", "The caregiver can be reached at {phone}.",
    "Phone {phone}.", "Tel. {phone}", "Daytime telephone {phone}.", "Telephone {phone} during the week.", "Telephone: {phone}", "Mobile {phone} after 6 pm.", "Contact by e-mail at {email}.", "Copy of the letter went to {email}.", "The portal account is registered to {email}.", "Results can be sent to {email}.", "Reply address on the fax: {email}.", "Email: {email}", "The form lists {idname} {id}.", "On file: {idname} {id}.", "The chart is linked to {idname} {id}.", "Identity was verified with {idname} {id}.", "Registration shows {idname} {id}.", "{idname} {id}", "SSN corrected to {id}.", "{idname}: {id}.", "MRN {id}", "{idname} changed to {id} on {date}.",
]
_DECOYS = [
    "{thing} {code} was closed after the study.", "{thing} {code} was received in good condition.", "{thing} {code} passed its yearly check.", "{thing} {code} was checked and the battery level was 52 percent.", "{thing} {code} was given in the left arm.", "Seen in room {room} at {org} for a scheduled visit.", "Records from {org} were requested on {date}.", "The therapist at {org} will arrange the test.", "{org} called back.", "{org}, {doc}", "{doc}", "{doc} - {org}", "Confidential * {org}", "{brand} was tolerated without side effects.", "{brand} Retard was tolerated well.", "{brand} Duo was stopped.", "{thing} {code}.",
    "Score on the {scale} was 48, compared with 23 in {month}.", "Strength is 3 out of 10 on the {scale}; sensation is preserved.", "Blood pressure was 122/90 mmHg with a pulse of 80 per minute.", "Vital signs: BP 114/93, HR 91, temperature 98.9 F.", "Coding for this visit: CPT 99213, ICD-10 {icd} and {icd}.", "A study performed on {date} was borderline.", "Die Untersuchung ergab keine Schwellung.", "Der Patient berichtet über Schmerzen.", "La paciente refiere dolor. El examen fue normal.", "Page {room} of 900", "Fax from {org} {date}", "Distance walked was 179 feet in 7 minutes along the East Corridor.", "{drug} 250 mg was continued. {drug} 20 mg was stopped.", "No change. Follow-up in 3 weeks.", "In {month} the sleep study was repeated.", "The {org} on {streetname} is closed.", "Balance 160.53; copay 81.00; {thing} {code}", "{thing} {code} and {code} were checked.",
]


def training_sentences(n: int = 3000, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with their labelled segments, from the frames above; some wrapped at a line, some side by side."""
    rng = random.Random(seed)
    word = lambda: (rng.choice(_SYLLABLES) + rng.choice(_TAILS)).capitalize()
    org_words = ["Clinic", "Hospital", "Medical Group", "Imaging", "Urgent Care", "Family Practice", "Spine Institute", "Rehabilitation Center", "Health", "Surgical Suite", "Community Hospital", "Street Health", "Lane Family Practice"]
    fillers = {
        "name": (_name, "name"), "surname": (_surname, "name"), "address": (_street, "address"), "phone": (_phone, "phone"), "email": (_email, "email"), "id": (lambda r: _digits(r, r.choice(_ID_FORMS)), "id_number"),
        "date": (lambda r: f"{r.randrange(1, 13):02}/{r.randrange(1, 29):02}/{r.randrange(1950, 2025)}", None), "month": (lambda r: r.choice("January February March April May June July".split()), None), "idname": (lambda r: r.choice(_ID_NAMES), None),
        "thing": (lambda r: r.choice(_THINGS), None), "code": (lambda r: _digits(r, r.choice(_THING_FORMS)), None), "room": (lambda r: str(r.randrange(1, 500)), None), "icd": (lambda r: _digits(r, "A99.9"), None), "org": (lambda r: (word() if r.random() < 0.6 else f"{word()} {word()}") + " " + r.choice(org_words), None),
        "doc": (lambda r: r.choice(["Progress Note", "Chart Copy", "Discharge Report", "Imaging Packet", "Continuation Sheet", "Therapy Record", "Lab Report", "Consent Form", "Medical Records", "Visit Notes"]), None), "brand": (lambda r: word(), None), "drug": (lambda r: r.choice(_DRUGS).capitalize(), None),
        "scale": (lambda r: f"{word()} {r.choice(['scale', 'index', 'fatigue rating', 'balance test', 'Scale', 'Index'])}", None), "streetname": (lambda r: f"{word()} {r.choice(['Street', 'Lane', 'Road'])}", None),
    }
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(rng.choice((1, 1, 2, 3))):
            frame = rng.choice(rng.choice((_NAME_FRAMES, _OTHER_FRAMES, _DECOYS)))
            if text:
                text += rng.choice((" ", " ", "\n"))
            for part in re.split(r"(\{\w+\})", frame):
                if part[:1] == "{":
                    make, kind = fillers[part[1:-1]]
                    value = make(rng)
                    if kind == "address" and value.endswith("."):
                        value = value[:-1] + "."
                    if rng.random() < 0.06:
                        value = value.replace(" ", "\n", 1)
                    if kind:
                        gold.append((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += part
        if rng.random() < 0.05 and len(text.upper()) == len(text):  # a form in capitals
            text = text.upper()
        out.append((text, gold))
    return out


@functools.cache
def default_model() -> SemiMarkov:
    return train(training_sentences())


# --- operators --------------------------------------------------------------


def redact(text: str, model: SemiMarkov) -> tuple[str, list[str]]:
    """The text with ``[TYPE]`` in place of each mention, and the types mentioned."""
    found = model.decode(text)
    if not found:
        return text, []
    parts, at = [], 0
    for lo, hi, kind in found:
        parts += [text[at:lo], f"[{kind.upper()}]"]
        at = hi
    return "".join([*parts, text[at:]]), sorted({k for _, _, k in found})


def redact_pii(df: DataFrame, text_col: str, keep: list[str], model: SemiMarkov | None = None, with_text: bool = True) -> DataFrame:
    """``keep`` columns with clean_text and pii_types (sorted, distinct) of every row with text.

    Everything outside the mentions is left as it is.  Null and blank texts have
    no row; texts are read whole; repeated rows come out once each; an empty
    table gives an empty result; ``keep`` decides which other columns pass.
    ``with_text`` false leaves the text out, for reports.
    """
    model = model or default_model()
    rows = df.select(*keep, F.col(text_col).alias("_text")).filter(F.col("_text").rlike(r"\S"))
    fields = [*rows.select(*keep).schema.fields]
    if with_text:
        fields.append(T.StructField("clean_text", T.StringType()))
    fields.append(T.StructField("pii_types", T.ArrayType(T.StringType())))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("_text")
            if with_text:
                done = [redact(t, model) for t in texts]
                batch["clean_text"] = [d[0] for d in done]
                batch["pii_types"] = [d[1] for d in done]
            else:
                batch["pii_types"] = [sorted({k for _, _, k in model.decode(t)}) for t in texts]
            yield batch

    return rows.mapInPandas(run, T.StructType(fields))
