"""Statements matched to the evidence that supports them, and checks of references."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.functions import text as X
from quire.operators.ranking import snippet_score
from quire.scratch import stage


def statements(sections: DataFrame, doc: list[str], per_section: int = 3, kinds: tuple[str, ...] = ("mcc", "clinical")) -> DataFrame:
    """The first lines of each section as statements: ``doc``, ordinal, slug, title, statement_no (from 1), statement.

    sections: doc, slug, title, content, ordinal, kind.  List marks are taken
    off; blank lines don't count.  Statements of one document are ordered by
    (ordinal, slug, line).
    """
    rows = sections.filter(F.col("kind").isin(*kinds))
    tidy = F.filter(F.transform(X.lines(F.col("content")), lambda x: X.strip(F.regexp_replace(X.strip(x), "^[-•]", ""))), lambda x: x != "")
    return rows.select(*doc, "ordinal", "slug", "title", F.posexplode(F.slice(tidy, 1, per_section)).alias("_i", "statement")).select(*doc, "ordinal", "slug", "title", (F.col("_i") + 1).alias("statement_no"), "statement")


#: Statements and sources that meet in one group of :func:`best_sources`, about.
BLOCK = 4096


class _Index:
    """Sources of one group, in the order of their numbers, by the words they have."""

    def __init__(self, numbers: list, lows: list[str], sizes: list[int], words: list[str]):
        self.numbers, self.lows = numbers, lows
        self.sizes = np.array(sizes, dtype=np.float64)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            for t in set(w.split()):
                places.setdefault(t, []).append(i)
        self.places = {t: np.array(p) for t, p in places.items()}

    def best(self, low: str, size: int, words: list[str], prefer_exact: bool) -> tuple[bool, float, int] | None:
        """(inexact, score, place) of the first best source, as :func:`~quire.operators.ranking.snippet_score` has it."""
        hits = np.zeros(len(self.numbers), dtype=np.int32)

        def add(tokens: list[str]) -> None:
            for t in tokens:
                p = self.places.get(t)
                if p is not None:
                    hits[p] += 1

        # a source that has the statement verbatim has all its words but perhaps the outer two
        add(words[1:-1])
        near = np.flatnonzero(hits == len(words) - 2) if len(words) > 2 else range(len(self.lows))
        exact = [i for i in near if low in self.lows[i]]
        add(words[:1] + words[-1:] if len(words) > 1 else words)
        score = np.where(hits > 0, np.minimum(0.95, hits / max(len(words), 1)), -1.0)
        if exact:
            score[exact] = np.minimum(0.99, size / np.maximum(self.sizes[exact], 1))
        if prefer_exact and exact:
            at = exact[int(np.argmax(score[exact]))]
        else:
            at = int(np.argmax(score))
        return (at not in exact, float(score[at]), at) if score[at] >= 0 else None


def best_sources(wanted: DataFrame, sources: DataFrame, by: list[str], prefer_exact: bool = False) -> DataFrame:
    """The best source of each statement among all sources of its ``by``: ``by``, statement, source_no.

    wanted: by, statement, distinct.  sources: by, source_no, _source.  Scores
    and ties are those of :func:`claims`; statements without match are left out.
    Both sides of a ``by`` are cut into blocks of about :data:`BLOCK` and every
    block of statements meets every block of sources, so no task holds a whole
    key; in a group words are looked up, not compared pair by pair.
    """
    low = F.lower(X.strip("statement"))
    parts = lambda rows, name: rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    cut = parts(wanted, "_ns").join(parts(sources, "_nt"), by)
    block = lambda what, n: F.pmod(F.xxhash64(what), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    number = sources.schema["source_no"].dataType
    left = sources.join(cut, by).select(*by, block("source_no", "_nt").alias("_t"), every("_ns").alias("_s"), F.lit(0).alias("_side"), "source_no", F.lit(None).cast("string").alias("statement"), F.lower("_source").alias("_low"), F.length("_source").alias("_size"), F.array_join(X.word_tokens("_source"), " ").alias("_words"))
    right = wanted.join(cut, by).select(*by, every("_nt").alias("_t"), block("statement", "_ns").alias("_s"), F.lit(1).alias("_side"), F.lit(0).cast(number).alias("source_no"), "statement", low.alias("_low"), F.length(X.strip("statement")).alias("_size"), F.array_join(X.word_tokens(X.strip("statement")), " ").alias("_words"))
    key = [*by, "_t", "_s"]
    rows = left.unionByName(right.filter("_low <> ''")).repartition(*key).sortWithinPartitions(*key, "_side", "source_no")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, found, index = None, [], None
        held: tuple[list, list, list, list] = ([], [], [], [])
        for batch in batches:
            out = []
            for *k, side, no, statement, low, size, words in batch.itertuples(index=False, name=None):
                if k != group:
                    group, index, held = k, None, ([], [], [], [])
                if side == 0:
                    for values, v in zip(held, (no, low, size, words)):
                        values.append(v)
                    continue
                index = index or _Index(*held)
                found = index.best(low, size, words.split(), prefer_exact) if index.numbers else None
                if found:
                    out.append((*k[:-2], statement, *found[:2], index.numbers[found[2]]))
            yield pd.DataFrame(out, columns=[*by, "statement", "_inexact", "_score", "source_no"])

    schema = T.StructType([*(wanted.schema[c] for c in by), T.StructField("statement", T.StringType()), T.StructField("_inexact", T.BooleanType()), T.StructField("_score", T.DoubleType()), T.StructField("source_no", number)])
    order = F.struct((F.col("_inexact") if prefer_exact else F.lit(False)).alias("inexact"), (-F.col("_score")).alias("neg"), "source_no")
    return rows.mapInPandas(run, schema).groupBy(*by, "statement").agg(F.min(order).alias("o")).select(*by, "statement", "o.source_no")


def claims(statements_df: DataFrame, sources: DataFrame, doc: list[str], most: int = 12, prefer_exact: bool = False, by: list[str] | None = None) -> DataFrame:
    """Each statement with its best source of the same document, at most ``most`` a document.

    statements_df: as :func:`statements` gives them.  sources: doc, source_no,
    page, text.  Columns: ``doc``, claim_no, claim_id, span_id, slug, title,
    statement, page, snippet, confidence.

    Of equal scores the first source counts; statements without any match are
    left out and don't use up numbers.  ``prefer_exact`` puts verbatim matches
    before others whatever their scores.  Statements meet only the sources of
    their own document (an equi-join on ``doc``), and only those that can still
    get a number: about ``most`` a document, so pairs grow with the sources.  The
    best source of each distinct statement is found by the words they share
    (:func:`best_sources`); only its snippet is cut out.

    ``by`` names columns of the statements that the sources have instead of
    ``doc``, where many documents share their sources.
    """
    by = by or doc
    keys = [*doc, *(c for c in by if c not in doc)]
    usable = sources.filter(F.col("text").isNotNull() & (F.col("text") != "")).select(*by, "source_no", "page", F.col("text").alias("_source"))
    # a statement shares a word with some source or is too short to tell; the first ``most`` that do settle which can have a number
    words = usable.select(*by, F.explode(F.array_distinct(X.word_tokens("_source"))).alias("_w")).distinct()
    order_cols = ["ordinal", "slug", "title", "statement_no", "statement"]
    own = F.array_distinct(X.word_tokens("statement"))
    marked = (
        statements_df.select(*keys, *order_cols, F.explode_outer(own).alias("_w"))
        .join(words.withColumn("_hit", F.lit(True)), [*by, "_w"], "left")
        .groupBy(*keys, *order_cols)
        .agg(F.coalesce(F.max("_hit"), F.lit(False)).alias("_sure"))
    )
    before = Window.partitionBy(*doc).orderBy("ordinal", "slug", "statement_no", "statement").rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.filter(F.col("_sure") | (F.size(own) <= 2)).withColumn("_n", F.coalesce(F.sum(F.col("_sure").cast("int")).over(before), F.lit(0)))
    marked = stage(marked.filter(F.col("_n") < most).drop("_n", "_sure"), "statements")  # read three times below
    scored = snippet_score(F.col("statement"), F.col("_source"))
    chosen = best_sources(marked.select(*by, "statement").distinct(), usable, by, prefer_exact)
    # exploded, so that no filter computes it again
    usable_match = F.filter(F.array(scored), lambda m: m.isNotNull() & (m.snippet != ""))
    matched = chosen.join(usable, [*by, "source_no"]).select("*", F.explode(usable_match).alias("_m"))
    pairs = marked.join(matched, [*by, "statement"])
    exact = F.position(F.lower(X.strip("statement")), F.lower(F.col("_source"))) > 0
    order = F.struct((~exact if prefer_exact else F.lit(False)).alias("inexact"), (-F.col("_m.score")).alias("neg"), "source_no")
    best = pairs.groupBy(*doc, "ordinal", "slug", "title", "statement_no", "statement").agg(F.min(F.struct(order.alias("o"), F.col("page").alias("page"), F.col("_m.snippet").alias("snippet"))).alias("b"))
    w = Window.partitionBy(*doc).orderBy("ordinal", "slug", "statement_no", "statement")
    ranked = best.withColumn("claim_no", F.row_number().over(w)).filter(F.col("claim_no") <= most)
    return ranked.select(
        *doc,
        "claim_no",
        F.concat("slug", F.lit("-claim-"), "claim_no").alias("claim_id"),
        F.concat("slug", F.lit("-span-"), "claim_no").alias("span_id"),
        "slug",
        "title",
        "statement",
        "b.page",
        "b.snippet",
        F.round(-F.col("b.o.neg"), 3).alias("confidence"),
    )


def claims_notice(docs: DataFrame, sources: DataFrame, found: DataFrame, doc: list[str], by: list[str] | None = None) -> DataFrame:
    """Why a document has no claims: ``evidence_unavailable``, ``no_evidence_matches``, or null if it has some.

    ``by`` as in :func:`claims`.
    """
    by = by or doc
    keys = [*doc, *(c for c in by if c not in doc)]
    have = sources.filter(F.col("text") != "").select(*by).distinct().withColumn("_s", F.lit(1))
    got = found.select(*doc).distinct().withColumn("_c", F.lit(1))
    notice = F.when(F.col("_s").isNull(), "evidence_unavailable").when(F.col("_c").isNull(), "no_evidence_matches")
    return docs.select(*keys).distinct().join(have, by, "left").join(got, doc, "left").select(*doc, notice.alias("notice"))


def dangling_references(claims_df: DataFrame, spans: DataFrame, doc: list[str], refs: str = "evidence_refs") -> DataFrame:
    """References of claims to spans that don't exist in the document."""
    wanted = claims_df.select(*doc, "claim_id", F.explode(refs).alias("span_id"))
    return wanted.join(spans.select(*doc, "span_id").distinct(), [*doc, "span_id"], "left_anti")


def set_differences(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: key, side (``missing`` or ``unexpected``); nulls don't count."""
    a = expected.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    b = observed.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, key, "full_outer").filter("_a is null or _b is null")
    return both.select(key, F.when(F.col("_b").isNull(), "missing").otherwise("unexpected").alias("side"))


def existing_by_priority(wanted: DataFrame, stored: DataFrame, key: str, first: str, second: str, check: list[str]) -> DataFrame:
    """For every wanted row the stored one it equals: by ``first``, else by ``second``, in either case with equal ``check`` columns.

    Two equi-joins instead of one on an OR.  Gives key, matched_by and stored_id
    (the smallest); rows without a match are left out.
    """
    parts = []
    for rank, by in enumerate((first, second)):
        cols = list(dict.fromkeys([by, *check]))
        parts.append(wanted.select(key, *cols).join(stored.select(*cols, F.col("stored_id")), cols).select(key, F.struct(F.lit(rank).alias("rank"), F.lit(by).alias("matched_by"), "stored_id").alias("m")))
    return parts[0].unionByName(parts[1]).groupBy(key).agg(F.min("m").alias("m")).select(key, "m.matched_by", "m.stored_id")
