"""Oversized texts cut into bounded pieces at natural boundaries.

A text is bisected at the strongest boundary near its midpoint, halves are cut
again while they exceed the limit less the overlap, and then every piece but the
first is given the end of its predecessor.  Rows are independent, so the
operator is one narrow stage; rows within the limit never leave the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Boundaries from the strongest to the weakest; a cut is made at the end of the match.
BOUNDARIES = (
    re.compile(r"\f"),
    re.compile(r"\n[ \t]*\n+"),
    re.compile(r"(?<=[.!?:])[\"')\]]*\n+"),
    re.compile(r"\n+(?=\s*(?:[-*•]|\d+[.)])\s)"),
    re.compile(r"[.!?][\"')\]]*[ \t]+(?=[\"'(\[]*[^\W\d_a-zß-öø-ÿ])"),
    re.compile(r"\n+"),
    re.compile(r"[;:][ \t]+"),
    re.compile(r",[ \t]+"),
    re.compile(r"\s+"),
)


def _clean_cut(text: str, at: int, lo: int, hi: int) -> int:
    """The place nearest ``at`` that doesn't part a character from its combining marks."""
    for step in range(64):
        for p in (at + step, at - step):
            if lo < p < hi and not unicodedata.combining(text[p]) and text[p] not in "‍️" and text[p - 1] != "‍":
                return p
    return at


def best_cut(text: str, lo: int, hi: int, margin: int) -> int:
    """Where to halve ``text[lo:hi]``: the strongest boundary within a quarter of
    its length around the middle, else any that leaves ``margin`` on either side,
    else the middle itself."""
    mid, size = (lo + hi) // 2, hi - lo
    for reach in (size // 4, size // 2 - margin):
        start, end = max(lo + 1, mid - reach), min(hi - 1, mid + reach)
        for pattern in BOUNDARIES:
            # lookbehinds see what stands before ``start``
            cuts = [m.end() for m in pattern.finditer(text, start, end)]
            if cuts:
                return min(cuts, key=lambda c: (abs(c - mid), c))
    return _clean_cut(text, mid, lo, hi)


def bisect_text(text: str, limit: int, margin: int) -> list[tuple[int, int]]:
    """Consecutive spans that cover ``text``, none longer than ``limit``."""
    todo, out = [(0, len(text))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit:
            out.append((lo, hi))
        else:
            cut = best_cut(text, lo, hi, margin)
            todo += [(cut, hi), (lo, cut)]
    return out


def overlap_start(text: str, lo: int, cut: int, least: int, most: int) -> int:
    """Where the overlap before ``cut`` starts: at a boundary ``least`` to ``most``
    characters back, the strongest one there is."""
    first, last = max(lo, cut - most), max(lo, cut - least)
    for pattern in BOUNDARIES:
        starts = [m.end() for m in pattern.finditer(text, first, last) if m.end() <= last]
        if starts:
            return max(starts)
    return _clean_cut(text, (first + last) // 2, first - 1, last + 1) if last > first else first


def split_text(text: str, limit: int = 4000, overlap: tuple[int, int] = (100, 200)) -> list[tuple[int, int, int]]:
    """(start, body start, end) of every piece; the overlap is ``text[start:body start]``."""
    least, most = overlap
    if limit <= 3 * most:
        raise ValueError("the limit must be more than three times the overlap")
    if len(text) <= limit:
        return [(0, 0, len(text))]
    # longer than limit - most, so both halves of a cut have at least ``most`` characters
    spans = bisect_text(text, limit - most, most)
    out, start = [], 0
    for i, (lo, hi) in enumerate(spans):
        start = overlap_start(text, out[-1][0], lo, least, most) if i else 0
        out.append((start, lo, hi))
    return out


def page_starts(text: str, first: int | None, last: int | None) -> list[int] | None:
    """Offsets at which the pages of ``text`` start, if it shows as many pages as its range has."""
    if first is None or last is None or last < first:
        return None
    n = last - first + 1
    if n == 1:
        return [0]
    for pattern in (r"\f", r"\n[ \t]*\n+"):
        starts = [0, *(m.end() for m in re.finditer(pattern, text))]
        if len(starts) == n:
            return starts
    return None


PIECES = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("n_pieces", T.IntegerType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("body_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("piece", T.StringType()),
        T.StructField("first_page", T.IntegerType()),
        T.StructField("last_page", T.IntegerType()),
    ]
)


def split_oversized(df: DataFrame, id_col: str, text_col: str, page_range: str | None = None, limit: int = 4000, overlap: tuple[int, int] = (100, 200)) -> DataFrame:
    """The pieces of every text of more than ``limit`` code points, in order.

    Columns: the id, piece_no (from 0), n_pieces, start_char, body_char and
    end_char (offsets in the text; the overlap lies before body_char), piece,
    first_page and last_page.  Joining the pieces from body_char on gives the
    text back exactly.  Pages are null unless the row has a page range of one
    page, or as many pages (form feeds, else empty lines) as its range has.
    Null, empty and short texts have no pieces; repeated rows are cut alike,
    each for itself; other columns of the input aren't read.
    """
    pages = F.col(page_range) if page_range else F.lit(None).cast("struct<start:int,end:int>")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), pages["start"].alias("first"), pages["end"].alias("last")).filter(F.length("text") > limit)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", *PIECES.fieldNames()]
        for batch in batches:
            out = []
            for key, text, first, last in zip(batch.id, batch.text, batch["first"], batch["last"]):
                known = not (pd.isna(first) or pd.isna(last))
                starts = page_starts(text, int(first), int(last)) if known else None
                pieces = split_text(text, limit, overlap)
                for no, (lo, body, hi) in enumerate(pieces):
                    span = (None, None)
                    if starts:
                        at = [i for i, s in enumerate(starts) if s < hi and (i + 1 == len(starts) or starts[i + 1] > lo)]
                        span = (int(first) + at[0], int(first) + at[-1])
                    out.append((key, no, len(pieces), lo, body, hi, text[lo:hi], *span))
                if len(out) > 2000:
                    yield _frame(out, names)
                    out = []
            if out:
                yield _frame(out, names)

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *PIECES.fields])
    return rows.mapInPandas(cut, schema).withColumnRenamed("id", id_col)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"first_page": "Int32", "last_page": "Int32"})
