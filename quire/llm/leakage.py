"""Held-out passages inside corpus documents.

Candidates come from 64-bit SimHash fingerprints of windows whose width goes
with the passage's size: a quarter of it, rounded down to a ladder of widths, so
that every half of a passage holds whole windows of the document, which start at
every third of a width.  A fingerprint is cut into four blocks; of two fingerprints
within ``RADIUS`` bits one block differs in ``RADIUS // 4`` bits at most
(pigeonhole), so tables that hold every passage window under all such keys find
all of them with one lookup a block.

Candidates are verified by the exact weighted share of the passage's two-word
shingles (five-word shingles don't survive a changed word in every five).  The
share asked for there is the least that a stretch with enough words in order can
have, so this verification loses nothing; an order-preserving alignment decides.

Scale: the corpus is read once, in a narrow stage, however many passages there
are; nothing about documents is shuffled, sent to the driver or held between
rows.  Passages are a stated query set: blocks of bounded size are written to
the shared folder, and a task takes its documents past one block after the
other.  Weights are counted over all passages, so blocks don't change results.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch

#: Bits in which the fingerprints of two windows may differ.
RADIUS = 11
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
#: Windows are this part of a passage.
PARTS = 4
#: Words that more than this share of the passages have weigh one in a fingerprint, all others two.
COMMON = 0.25
#: Words of all passages in one block of the query set.
BLOCK_WORDS = 50_000
#: Blocks a task holds at once, and characters of documents it takes past them together.
HELD_BLOCKS, GROUP_CHARS = 4, 1_000_000
#: Share of a passage's words that a document must hold, in order.
LEAST_SHARE = 0.5
#: Words of the passage that may be missing, and foreign words that may stand (a page
#: header, say), between two matched stretches ("all but unbroken").
MOST_MISSING = 8
MOST_FOREIGN = 30
SHINGLE = 2

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def width_of(n: int) -> int:
    """Words of the windows of a passage of ``n`` words: a quarter, rounded down to 1, 2, 3, 4, 6, 8, 12, 16, ..."""
    most = max(1, n // PARTS)
    if most < 4:
        return most
    step = 1 << (most.bit_length() - 1)
    return step + step // 2 if most >= step + step // 2 else step


def word_signs(vocab: list[str], common: frozenset[str]) -> np.ndarray:
    """(n, 64) of plus and minus the words' weights, by the bits of their hashes."""
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in vocab], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
    weight = np.array([1 if w in common else 2 for w in vocab], np.int16)
    return (bits * 2 - 1) * weight[:, None]


def running(signs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(64, words + 1): sums of each bit before each word, ``signs[codes[i]]`` being those of word i.

    They may wrap round; their differences over windows don't.
    """
    out = np.zeros((64, len(codes) + 1), np.int16)
    for row, total in zip(np.ascontiguousarray(signs.T), out):
        np.cumsum(row[codes], dtype=np.int16, out=total[1:])
    return out


def fingerprints(sums: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the windows of ``width`` words at ``starts``."""
    ends = starts + width
    out = np.zeros(len(starts), np.uint64)
    for bit, total in enumerate(sums):
        out |= (total[ends] - total[starts] > 0).astype(np.uint64) << np.uint64(bit)
    return out


def _near_keys(bits: int, most: int) -> np.ndarray:
    return np.array([sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


class _Windows:
    """Windows of one width by the keys of their blocks."""

    def __init__(self, prints: np.ndarray, owners: np.ndarray):
        self.prints, self.owners = prints, owners
        near = _near_keys(BLOCK_BITS, RADIUS // BLOCKS)
        self.tables = []
        for b in range(BLOCKS):
            own = (prints >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)
            keys = (own[:, None] ^ near[None, :]).astype(np.uint16).ravel()
            order = np.argsort(keys, kind="stable")
            starts = np.searchsorted(keys[order], np.arange((1 << BLOCK_BITS) + 1)).astype(np.int64)
            self.tables.append(((order // len(near)).astype(np.int32), starts))

    def candidates(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, passage) of all pairs within RADIUS bits, each once."""
        pairs = []
        for b, (order, starts) in enumerate(self.tables):
            keys = ((found >> np.uint64(b * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)
            first, n = starts[keys], starts[keys + 1] - starts[keys]
            at = np.flatnonzero(n)
            if not len(at):
                continue
            n, first = n[at], first[at]
            pos = np.repeat(at, n)
            inner = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
            other = order[np.repeat(first, n) + inner]
            near = np.bitwise_count(found[pos] ^ self.prints[other]) <= RADIUS
            pairs.append(pos[near] * (1 << 32) + self.owners[other[near]])
        both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return both >> 32, (both & ((1 << 32) - 1)).astype(np.int64)


@dataclass
class Passage:
    """A passage: its words and, for each pair of neighbouring words, the number of passages that have it."""

    item: object
    tokens: list[str]
    owners: list[int]

    def least_weight(self, least_share: float) -> float:
        """The weight of shingles that any stretch with ``least_share`` of the words in order holds.

        Such a stretch has blocks of two matched words or more with two changed
        ones between them at most, hence a whole shingle in every four words.
        """
        n = len(self.tokens)
        if n < 4:
            return 0.0
        k = math.ceil((least_share * n + 2) / 4 - 1e-9)
        return float(np.sort(self.weights())[:k].sum())

    def weights(self) -> np.ndarray:
        return 1.0 / np.maximum(1, np.array(self.owners, float))


class PassageIndex:
    """The windows of a block of passages."""

    def __init__(self, passages: list[Passage], common: frozenset[str], least_share: float):
        self.passages, self.least_share = passages, least_share
        vocab = sorted({w for p in passages for w in p.tokens})
        at = {w: i for i, w in enumerate(vocab)}
        signs = word_signs(vocab, common) if vocab else np.empty((0, 64), np.int16)
        self.widths = [width_of(len(p.tokens)) for p in passages]
        by_width: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)
        for i, p in enumerate(passages):
            w = self.widths[i]
            sums = running(signs, np.array([at[t] for t in p.tokens], np.int64))
            by_width[w].append((fingerprints(sums, np.arange(len(p.tokens) - w + 1), w), i))
        self.windows = {w: _Windows(np.concatenate([f for f, _ in found]), np.repeat([i for _, i in found], [len(f) for f, _ in found]).astype(np.int64)) for w, found in sorted(by_width.items())}
        self.least = [p.least_weight(least_share) - 1e-9 for p in passages]
        self.shingles = [[tuple(p.tokens[j : j + SHINGLE]) for j in range(len(p.tokens) - SHINGLE + 1)] for p in passages]
        self.weights = [p.weights() for p in passages]

    def shingles_in(self, i: int, stretch: list[str]) -> np.ndarray:
        """Which shingles of passage ``i`` a stretch holds."""
        have = set(zip(stretch, stretch[1:]))
        return np.fromiter(map(have.__contains__, self.shingles[i]), bool, len(self.shingles[i]))

    def verified(self, i: int, shared: np.ndarray) -> bool:
        """Whether a stretch with these shingles of passage ``i`` can have enough of its words in order.

        Neither bound loses any: the weighted share, and the longest run of words
        in shared shingles, with no more missing between them than
        :func:`aligned_share` allows.
        """
        n = len(self.passages[i].tokens)
        return n < 4 or (self.weights[i] @ shared >= self.least[i] and longest_run(shared) >= self.least_share * n - 1e-9)


def longest_run(shared: np.ndarray, most_missing: int = MOST_MISSING) -> int:
    """Most words of a passage that an alignment over shared shingles can count."""
    at = np.flatnonzero(shared)
    if not len(at):
        return 0
    # words missing after one shared shingle and before the next; up to two count
    missing = np.maximum(0, np.diff(at) - 2)
    counted = np.diff(at) - np.where(missing > 2, missing, 0)
    runs = np.split(counted, np.flatnonzero(missing > most_missing))
    return max(int(r.sum()) if k == 0 else int(r[1:].sum()) for k, r in enumerate(runs)) + 2


def aligned_share(item: list[str], doc: list[str], most_missing: int = MOST_MISSING, most_foreign: int = MOST_FOREIGN) -> float:
    """Share of the item's words found in ``doc`` in their order and all but unbroken.

    Matching blocks of two words or more are chained while no more than
    ``most_missing`` words of the item and ``most_foreign`` of the document stand
    between them; up to two changed words between blocks count as found.
    """
    blocks = [b for b in SequenceMatcher(None, item, doc, autojunk=False).get_matching_blocks() if b.size >= min(2, len(item))]
    best = run = 0
    last = None
    for b in blocks:
        if last and b.a - last.a - last.size <= most_missing and b.b - last.b - last.size <= most_foreign:
            between = b.a - last.a - last.size
            run += b.size + (between if between <= 2 and b.b - last.b - last.size <= 4 else 0)
        else:
            run = b.size
        best, last = max(best, run), b
    return best / len(item)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage", least_share: float = LEAST_SHARE, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(item, doc, share, shingles) for every document that holds at least ``least_share``
    of a passage's words in order, whatever case, punctuation, spacing and layout.

    share is that of the best stretch, shingles its weighted share of the
    passage's shingles, those of many passages weighing less.  Repeated rows of
    one document id count once a row, repeated rows of an item once, with the
    best share; so the result is distinct if document ids are.  Null and empty
    texts and passages have no words and no rows; empty tables give an empty
    result; other columns aren't read.  block_words only bounds what a task holds.
    """
    rows = docs.select(docs[id_col].alias("doc"), docs[text_col].alias("text")).filter("text is not null")
    schema = T.StructType(
        [
            T.StructField(item_col, items.schema[item_col].dataType),
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("share", T.DoubleType()),
            T.StructField("shingles", T.DoubleType()),
        ]
    )
    paths = _write_blocks(items.select(items[item_col].alias("item"), items[passage_col].alias("passage")), least_share, block_words)
    return rows.mapInPandas(_finder(paths, [item_col, id_col, "share", "shingles"]), schema)


def _passages(items: DataFrame) -> tuple[DataFrame, frozenset[str]]:
    """Passages (item, tokens, owners) in the order of items, and their common words; counted over all of them."""

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"item": batch["item"], "tokens": [words(p) for p in batch.passage]})

    schema = T.StructType([items.schema["item"], T.StructField("tokens", T.ArrayType(T.StringType()))])
    rows = items.filter("passage is not null").mapInPandas(tokenise, schema).filter(F.size("tokens") > 0)
    rows = scratch.stage(rows.distinct().withColumn("no", F.monotonically_increasing_id()), "passages")
    total = rows.count()
    common = rows.select(F.explode(F.array_distinct("tokens")).alias("w")).groupBy("w").count().filter(F.col("count") > COMMON * total)
    pair = F.transform(F.slice("tokens", 2, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda b, i: F.concat(F.get("tokens", i), F.lit(" "), b))
    pairs = rows.select("no", F.posexplode(pair).alias("at", "pair"))
    owners = pairs.select("no", "pair").distinct().groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    per = pairs.join(owners, "pair").groupBy("no").agg(F.sort_array(F.collect_list(F.struct("at", "n"))).alias("o"))
    out = rows.join(per, "no", "left").select("item", "tokens", F.transform(F.coalesce("o", F.array().cast("array<struct<at:int,n:bigint>>")), lambda o: o.n).alias("owners")).orderBy("item", "tokens")
    # words of a quarter of the passages: at most four times the words of a mean passage
    return out, frozenset(r.w for r in common.collect())


def _write_blocks(items: DataFrame, least_share: float, block_words: int) -> list[str]:
    """Blocks of passages written to the shared folder, one held at a time."""
    rows, common = _passages(items)
    target = scratch.new_dir(items.sparkSession, "passages")
    paths: list[str] = []

    def write(block: list[Passage]) -> None:
        path = f"{target}/{len(paths)}.block"
        store, place = fs.FileSystem.from_uri(path)
        store.create_dir(place.rpartition("/")[0], recursive=True)
        with store.open_output_stream(place) as out:
            out.write(pickle.dumps((block, common, least_share)))
        paths.append(path)

    block: list[Passage] = []
    size = 0
    for r in rows.toLocalIterator():
        if block and size + len(r.tokens) > block_words and r["item"] != block[-1].item:
            write(block)
            block, size = [], 0
        block.append(Passage(r["item"], list(r.tokens), list(r.owners)))
        size += len(r.tokens)
    if block:
        write(block)
    return paths


_held: dict[str, PassageIndex] = {}


def _block(path: str) -> PassageIndex:
    if path not in _held:
        while len(_held) >= HELD_BLOCKS:
            del _held[next(iter(_held))]
        store, place = fs.FileSystem.from_uri(path)
        with store.open_input_stream(place) as f:
            _held[path] = PassageIndex(*pickle.loads(f.read()))
    return _held[path]


def _common(path: str) -> frozenset[str]:
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place) as f:
        return pickle.loads(f.read())[1]


def _finder(paths: list[str], names: list[str]):
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = _common(paths[0]) if paths else frozenset()
        signs: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for lo, texts in _groups(batch.text) if paths else ():
                group = Group(texts, common, signs)
                for path in paths:
                    out += [(item, batch.doc.iloc[lo + i], *shares) for i, item, *shares in search(_block(path), group)]
            yield pd.DataFrame(out, columns=names)

    return find


def _groups(texts: pd.Series) -> Iterator[tuple[int, list[str]]]:
    """Rows in groups of about as many characters, which bounds the arrays below."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= GROUP_CHARS:
            yield lo, list(texts.iloc[lo : i + 1])
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, list(texts.iloc[lo:])


class Group:
    """Some documents' words, one after the other, with their running sums."""

    def __init__(self, texts: list[str], common: frozenset[str], memo: dict[str, np.ndarray] | None = None):
        lists = [words(t) for t in texts]
        self.sizes = np.array([len(t) for t in lists], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = [w for t in lists for w in t]
        code = {w: i for i, w in enumerate(dict.fromkeys(self.flat))}
        codes = np.fromiter(map(code.__getitem__, self.flat), np.int64, len(self.flat))
        memo = {} if memo is None else memo
        if len(memo) > 300_000:
            memo.clear()
        new = [w for w in code if w not in memo]
        if new:
            memo.update(zip(new, word_signs(new, common)))
        self.sums = running(np.array([memo[w] for w in code], np.int16).reshape(-1, 64), codes)

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, start) of the windows at every third of a width, none over the end of a document."""
        step = max(1, width // 3)
        n = np.where(self.sizes >= width, (self.sizes - width) // step + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, self.starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step


def search(index: PassageIndex, group: Group) -> Iterator[tuple[int, object, float, float]]:
    """(document, item, share, shingles) of every pair that meets the index's share."""
    hits: dict[tuple[int, int], set[int]] = defaultdict(set)
    for width, table in index.windows.items():
        docs, starts = group.windows(width)
        for lo in range(0, len(docs), 1 << 15):
            part = starts[lo : lo + (1 << 15)]
            at, owner = table.candidates(fingerprints(group.sums, part, width))
            for d, o, p in zip(docs[lo + at].tolist(), owner.tolist(), part[at].tolist()):
                hits[d, o].add(p // len(index.passages[o].tokens))
    best: dict[tuple[int, object], tuple[float, float]] = {}
    for (d, o), places in hits.items():
        passage = index.passages[o]
        n, start = len(passage.tokens), int(group.starts[d])
        end = start + int(group.sizes[d])
        # a stretch around all hits that start within as many words as the passage has: bounded, and whole for what they belong to
        for place in sorted(places):
            more = n // 2 + MOST_FOREIGN
            stretch = group.flat[max(start, (place - 1) * n - more) : min(end, (place + 2) * n + more)]
            shared = index.shingles_in(o, stretch)
            if not index.verified(o, shared):
                continue
            share = aligned_share(passage.tokens, stretch)
            found = (share, float(index.weights[o] @ shared / index.weights[o].sum()) if n > 1 else 1.0)
            if share >= index.least_share and found > best.get((d, passage.item), (0.0, 0.0)):
                best[d, passage.item] = found
    for (d, item), (share, shingles) in best.items():
        yield d, item, share, shingles

