"""Texts and pages cut into chunks for downstream models.

All operators take one row a document and give one row a chunk.  Cutting depends
on what was cut before, so the folds over one document's segments run in Arrow
batches; page ranges, numbering and totals are expressions.  No operator
shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import lexicons as L
from quire.functions.text import lines, sentences, strip

PACKED = "array<struct<chunk_index:int,text:string,page_start:int,page_end:int,token_count:int>>"


def _estimate(text: str) -> int:
    return max(1, len(text) // 4) if text else 0


def packed_ranges(sizes: list[int], most: int, least: int, overlap: int = 0, strict_order: bool = False) -> list[list[int]]:
    """Which segments make up each chunk, from their sizes in tokens; see :func:`pack_segments`."""
    out: list[list[int]] = []
    held: list[int] = []
    size = 0

    def tail(items: list[int]) -> list[int]:
        """The last segments with ``overlap`` tokens, which open the next chunk."""
        if overlap <= 0:
            return []
        size = 0
        for k in range(len(items) - 1, -1, -1):
            size += sizes[items[k]]
            if size >= overlap:
                return items[k:]
        return items[:]

    for i, n in enumerate(sizes):
        alone = n >= most
        if held and ((size >= least or strict_order) if alone else (size + n > most and size >= least)):
            out.append(held)
            held = tail(held)
            size = sum(sizes[k] for k in held)
        if alone:
            out.append([i])
        else:
            held.append(i)
            size += n
    return [*out, held] if held else out


def pack_segments(segments: list[tuple[str, int]], most: int, least: int, overlap: int = 0, strict_order: bool = False) -> list[tuple[int, str, int, int, int]]:
    """Greedy packing of (segment, page) pairs: (index, text, first page, last page, tokens).

    A chunk is closed when the next segment would take it past ``most`` tokens
    and it has ``least``.  A segment of ``most`` tokens or more is a chunk of its
    own; what was collected before it comes out first only if it has ``least``
    tokens (``strict_order``: always).  With ``overlap`` a chunk starts with the
    last segments of its predecessor that have as many tokens.
    """
    sizes = [_estimate(text) for text, _ in segments]
    made = []
    for own in packed_ranges(sizes, most, least, overlap, strict_order):
        text = " ".join(segments[i][0] for i in own).strip()
        if text:
            pages = [segments[i][1] for i in own]
            made.append((len(made), text, min(pages), max(pages), sum(sizes[i] for i in own)))
    return made


def pack_pages(df: DataFrame, pages: str, keep: list[str], max_tokens: int = 4000, min_tokens: int | None = None, overlap_tokens: int = 0, strict_order: bool = False) -> DataFrame:
    """Sentences packed into chunks across a document's pages.

    pages: array of page texts in order (a null page is an empty one).  Gives
    ``keep`` and chunk_index (from 0), text, page_start, page_end, token_count.
    Documents without text have no chunk; every row is packed for itself.
    """
    least = max_tokens // 2 if not min_tokens else min_tokens
    # sentences are split in the JVM, only their packing is a fold
    tagged = F.flatten(F.transform(F.col(pages), lambda p, i: F.transform(sentences(F.coalesce(p, F.lit(""))), lambda s: F.struct(s.alias("s"), (i + 1).alias("p")))))
    rows = df.select(*keep, tagged.alias("_segments")).filter(F.size("_segments") > 0)

    @F.pandas_udf(PACKED)
    def pack(column: pd.Series) -> pd.Series:
        names = ("chunk_index", "text", "page_start", "page_end", "token_count")
        return pd.Series([[dict(zip(names, c)) for c in pack_segments([(x["s"], int(x["p"])) for x in xs], max_tokens, least, overlap_tokens, strict_order)] for xs in column])

    return rows.select(*keep, F.inline(pack("_segments")))


_BLANK = re.compile(r"[ \n\t]")


def window_cuts(text: str, target: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """Windows of ``target`` characters, lengthened to the next blank (``most`` at
    the most), each starting ``overlap`` before the end of the one before."""
    whole = len(text)
    if whole <= most:
        return [(0, whole)] if text else []
    ends = [0]
    while ends[-1] < whole:
        start = ends[-1] - overlap if len(ends) > 1 else 0
        blank = _BLANK.search(text, start + target, start + most)
        ends.append(min(whole, blank.start() if blank else start + most if start + target < whole else whole))
    starts = [0, *(e - overlap for e in ends[1:-1])]
    return [(a, b) for a, b in zip(starts, ends[1:]) if not text[a:b].isspace()]


def word_cuts(text: str, target: int, most: int) -> list[str]:
    """The text as it is up to ``most`` characters, else words filled up to ``target``."""
    if len(text) <= most:
        return [text] if text else []
    out: list[str] = []
    line = ""
    for word in text.split():
        if line and len(line) + 1 + len(word) > target:
            out.append(line)
            line = word
        else:
            line = f"{line} {word}" if line else word
    return [*out, line] if line else out


def _cut(df: DataFrame, text: str, keep: list[str], cut: Callable[[str], list[str]]) -> DataFrame:
    rows = df.select(*keep, F.col(text).alias("_text")).filter(F.length("_text") > 0)
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_total", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [cut(t) for t in batch.pop("_text")]
            out = batch.loc[batch.index.repeat([len(p) for p in parts])].copy()
            out["chunk_index"] = [i + 1 for p in parts for i in range(len(p))]
            out["chunk_total"] = [len(p) for p in parts for _ in p]
            out["text"] = [x for p in parts for x in p]
            yield out

    return rows.mapInPandas(run, schema).withColumn("approx_tokens", F.greatest(F.lit(1), F.ceil(F.length("text") / 4).cast("int")))


def sliding_windows(df: DataFrame, text: str, keep: list[str], target_chars: int = 2600, max_chars: int = 10_000, overlap_chars: int = 320) -> DataFrame:
    """Overlapping windows: ``keep``, chunk_index (from 1), chunk_total, text, approx_tokens.

    A blank window is left out and the cutting goes on.  Null and empty texts
    have no window.
    """
    if max_chars <= target_chars or overlap_chars >= target_chars:
        raise ValueError("needs overlap < target < max")
    return _cut(df, text, keep, lambda t: [t[a:b] if len(t) <= max_chars else t[a:b].strip() for a, b in window_cuts(t, target_chars, max_chars, overlap_chars)])


def word_chunks(df: DataFrame, text: str, keep: list[str], target_chars: int = 2500, max_chars: int = 3000) -> DataFrame:
    """Chunks of whole words: ``keep``, chunk_index (from 1), chunk_total, text, approx_tokens."""
    return _cut(df, text, keep, lambda t: word_cuts(t, target_chars, max_chars))


def page_ranges(df: DataFrame, page_count: str, keep: list[str], max_pages: int = 25) -> DataFrame:
    """Parts of at most ``max_pages`` pages: ``keep``, part_index (from 0), page_start, page_end.

    Rows of no page or null pages have no part.
    """
    n = F.col(page_count)
    parts = F.when(n > 0, F.sequence(F.lit(0), (F.ceil(n / max_pages) - 1).cast("int")))
    exploded = df.select(*keep, n.alias("_n"), F.explode(parts).alias("part_index"))
    start = F.col("part_index") * max_pages + 1
    return exploded.select(*keep, "part_index", start.cast("int").alias("page_start"), F.least(start + max_pages - 1, F.col("_n")).cast("int").alias("page_end"))


def sections_of(text: str | Column) -> Column:
    """array<struct<slug, title, content, ordinal>> of the parts under known headings.

    A heading is a line ``Title:`` of :data:`~quire.functions.lexicons.HEADINGS`.
    What stands before the first one is the beginning of the first section; a
    text without headings has none.
    """
    marked = F.transform(lines(text), lambda x: F.struct(F.regexp_replace(F.lower(strip(x)), ":+$", "").alias("key"), strip(x).endswith(":").alias("ends"), x.alias("line")))
    titles = {t.lower(): (slug, t) for slug, t in L.HEADINGS}
    # one fold: sections so far, each a struct of its heading and lines
    start = F.array().cast("array<struct<key:string,body:array<string>>>")
    first = F.struct(F.array().cast("array<string>").alias("lead"), start.alias("done"))

    def step(acc: Column, x: Column) -> Column:
        heading = x.ends & x.key.isin(*titles)
        n = F.size(acc.done)
        opened = F.struct(
            F.when(n == 0, F.array().cast("array<string>")).otherwise(acc.lead).alias("lead"),
            F.concat(acc.done, F.array(F.struct(x.key.alias("key"), F.when(n == 0, acc.lead).otherwise(F.array().cast("array<string>")).alias("body")))).alias("done"),
        )
        last = F.element_at(acc.done, -1)
        longer = F.struct(acc.lead.alias("lead"), F.concat(F.slice(acc.done, 1, F.greatest(n - 1, F.lit(0))), F.array(F.struct(last.key.alias("key"), F.concat(last.body, F.array(x.line)).alias("body")))).alias("done"))
        lead = F.struct(F.concat(acc.lead, F.array(x.line)).alias("lead"), acc.done.alias("done"))
        return F.when(heading, opened).when(n > 0, longer).otherwise(lead)

    slug_of = F.create_map(*(F.lit(v) for k, (s, _) in titles.items() for v in (k, s)))
    title_of = F.create_map(*(F.lit(v) for k, (_, t) in titles.items() for v in (k, t)))
    done = F.aggregate(marked, first, step, lambda acc: acc.done)
    return F.transform(
        done,
        lambda s, i: F.struct(slug_of[s.key].alias("slug"), title_of[s.key].alias("title"), strip(F.array_join(s.body, "\n")).alias("content"), (i + 1).cast("int").alias("ordinal")),
    )
