"""Ranked choices: distinct lines, top phrases, best snippets and alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import lexicons as L
from quire.functions import text as X


def ranked_lines(df: DataFrame, doc: list[str], text: str, limit: int, keywords: tuple[str, ...] = (), required: tuple[str, ...] = (), allow_numeric: bool = False) -> DataFrame:
    """The ``limit`` best distinct lines of each document, in the order of the text.

    Columns: ``doc``, pos (from 0), line, score.  Lines of noise, with unwanted
    words or without a keyword and a required word (where given) are left out;
    of lines with one key the best, then the first, counts; ties go to the
    earlier line.  Equal keys are collapsed by an aggregation before any line is
    ranked, so what is ranked in one task is one document's distinct lines.
    """
    # stripped before the explode: a filter would repeat what a projection after it computes
    at = df.select(*doc, F.posexplode(F.transform(X.lines(F.col(text)), X.strip)).alias("pos", "line"))
    low = F.lower("line")
    for needed in (required, keywords):  # cheap and selective, so first
        if needed:
            at = at.filter(X.contains_any(low, tuple(k.lower() for k in needed)))
    at = at.filter(~X.contains_any(low, L.UNWANTED_TOKENS) & ~X.contains_any(low, L.FINAL_NOISE) & ~(low.contains("call") & low.contains("immediately")) & ~X.is_noise_line("line", allow_numeric))
    at = at.withColumn("key", X.line_key("line")).filter("key != ''")
    scored = at.withColumn("score", F.round(X.line_score("line", tuple(k.lower() for k in keywords)), 6))
    best = scored.groupBy(*doc, "key").agg(F.min(F.struct((-F.col("score")).alias("n"), "pos", "line")).alias("b"))
    w = Window.partitionBy(*doc).orderBy("b.n", "b.pos")
    ranked = best.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    return ranked.select(*doc, "b.pos", "b.line", (-F.col("b.n")).alias("score"))


def distinct_in_order(items: Column, key: Column | None = None) -> Column:
    """An array without repeats, the first of each kept; ``key`` is an array of the keys to compare by."""
    if key is None:
        return F.array_distinct(items)
    pairs = F.arrays_zip(items.alias("item"), key.alias("key"))
    return F.transform(F.filter(pairs, lambda p, i: F.array_position(key, p.key) == i + 1), lambda p: p.item)


def top_phrases(df: DataFrame, doc: list[str], text: str, limit: int = 40) -> DataFrame:
    """The most frequent words and pairs of neighbouring, different words of each document.

    Columns: ``doc``, rank (from 1), phrase, n.  Stop words and numbers don't
    count.  Ties: words before pairs, then the earlier first place.
    """
    toks = df.select(*doc, X.content_tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    pairs = F.transform(
        F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda b, i: F.struct(F.lit(1).alias("kind"), i.alias("pos"), F.when(F.get("_t", i) != b, F.concat(F.get("_t", i), F.lit(" "), b)).alias("phrase"))
    )
    singles = F.transform("_t", lambda a, i: F.struct(F.lit(0).alias("kind"), i.alias("pos"), a.alias("phrase")))
    flat = toks.select(*doc, F.inline(F.concat(singles, F.filter(pairs, lambda p: p.phrase.isNotNull()))))
    counted = flat.groupBy(*doc, "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.min("pos").alias("pos"))
    w = Window.partitionBy(*doc).orderBy(F.desc("n"), "kind", "pos")
    return counted.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select(*doc, "rank", "phrase", "n")


def part_alignment(parts: DataFrame, key: list[str], side: str, order: list[str], text: str, limit: int = 200) -> DataFrame:
    """:func:`content_alignment` of texts in parts, which are never joined: side is 0 for parts of the source and 1 for those of the summary.

    Parts follow each other by ``order``; words on both sides of a border make a
    pair.  Keys with parts of both sides have a row.  Parts meet by key in one
    exchange and are read in order as a stream; what a task holds is a key's
    counted phrases, which can spill.
    """
    words = F.array_join(X.content_tokens(F.coalesce(F.col(text), F.lit(""))), " ").alias("_w")  # no token has a space
    own = parts.select(*key, F.col(side).alias("_side"), *(F.col(o).alias(f"_o{n}") for n, o in enumerate(order)), words).repartition(*key)
    own = own.withColumn("_n", F.when(F.col("_w") != "", F.size(F.split("_w", " "))).otherwise(0))
    w = Window.partitionBy(*key, "_side", F.col("_n") > 0).orderBy(*(f"_o{n}" for n in range(len(order))), "_w")
    own = own.select(*key, "_side", "_w", "_n", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_end"), F.lead(F.substring_index("_w", " ", 1)).over(w).alias("_next"))
    own = own.select(*key, "_side", "_n", (F.col("_end") - F.col("_n")).alias("_at"), F.when(F.col("_n") > 0, F.split(F.concat_ws(" ", "_w", "_next"), " ")).otherwise(F.array().cast("array<string>")).alias("_t"))
    singles = F.transform(F.slice("_t", 1, F.col("_n")), lambda a, i: F.struct(F.lit(0).alias("kind"), (F.col("_at") + i).alias("pos"), a.alias("phrase")))
    pairs = F.transform(
        F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0))), lambda b, i: F.struct(F.lit(1).alias("kind"), (F.col("_at") + i).alias("pos"), F.when(F.get("_t", i) != b, F.concat(F.get("_t", i), F.lit(" "), b)).alias("phrase"))
    )
    flat = own.select(*key, "_side", F.inline_outer(F.concat(singles, F.filter(pairs, lambda p: p.phrase.isNotNull()))))
    counted = flat.groupBy(*key, "_side", "phrase").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"), F.min("pos").alias("pos"))
    r = Window.partitionBy(*key, "_side").orderBy(F.col("phrase").isNull(), F.desc("n"), "kind", "pos")
    ranked = counted.withColumn("_top", F.col("phrase").isNotNull() & (F.row_number().over(r) <= limit)).filter("_top or kind = 0 or phrase is null")
    on = lambda c, s: F.max(F.col("_side").eqNullSafe(s) & c)
    there, single = F.lit(True), F.coalesce(F.col("kind") == 0, F.lit(False))
    per = ranked.groupBy(*key, "phrase").agg(on(there, 0).alias("a"), on(there, 1).alias("b"), on(single, 0).alias("wa"), on(single, 1).alias("wb"), on(F.col("_top"), 0).alias("ta"), on(F.col("_top"), 1).alias("tb"))
    has = per.groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b"), *(F.count_if(F.col(x)).alias(x) for x in ("wa", "wb", "ta", "tb")), F.count_if(F.col("wa") & F.col("wb")).alias("words"), F.count_if(F.col("ta") & F.col("tb")).alias("tops"))
    share = lambda both, x, y: F.when(F.least(x, y) > 0, F.col(both) / F.least(x, y)).otherwise(F.lit(0.0))
    found = has.filter("a and b").select(*key, F.round(share("words", "wa", "wb"), 3).alias("token_overlap"), share("tops", "ta", "tb").alias("_p"), (F.least("ta", "tb") == 0).alias("_none"))
    return found.select(*key, "token_overlap", F.round("_p", 6).alias("phrase_overlap"), F.when(F.col("_none"), F.lit(0.0)).otherwise(F.round(0.55 * F.col("_p") + 0.45 * F.col("token_overlap"), 3)).alias("alignment"))


def content_alignment(pairs: DataFrame, key: list[str], source: str, summary: str, limit: int = 200) -> DataFrame:
    """How much of a source a summary speaks about: ``key``, token_overlap, phrase_overlap, alignment.

    alignment = 0.55 x shared top phrases + 0.45 x shared tokens (3 places), 0 if
    a side has no tokens.  Keys must be unique.
    """
    sides = F.array(*(F.struct(F.lit(n).alias("_side"), F.col(c).alias("_text")) for n, c in enumerate((source, summary))))
    return part_alignment(pairs.select(*key, F.inline(sides)), key, "_side", [], "_text", limit)


def snippet_score(statement: Column, source: Column) -> Column:
    """struct<score, snippet>: how well a source supports a statement, null if it shares no word.

    Verbatim: 32 characters around it, the statement's length over the source's
    (0.99 at most).  Else the share of the statement's words, repeats counted,
    that the source has (0.95 at most), with 40 characters before and 160 after
    the first word that occurs in it.
    """

    def cut(source: Column, lo: Column, hi: Column) -> Column:
        start, end = F.greatest(F.lit(0), lo), F.least(F.length(source), hi)
        return X.strip(F.substring(source, start + 1, end - start))

    def found(score: Column, snippet: Column) -> Column:
        return F.struct(score.alias("score"), snippet.alias("snippet"))

    def verbatim(p: Column) -> Column:
        size = F.length(p["st"])
        return found(F.least(F.lit(0.99), size / F.greatest(F.length(p["source"]), F.lit(1))), cut(p["source"], p["at"] - 33, p["at"] - 1 + size + 32))

    def shared(p: Column) -> Column:
        tokens = F.struct(X.word_tokens(p["st"]).alias("mine"), X.word_tokens(p["source"]).alias("theirs"))
        hits = X.let(tokens, lambda t: F.struct(F.size(t.mine).alias("n"), F.filter(t.mine, lambda x: F.array_contains(t.theirs, x)).alias("hits"), F.filter(t.mine, lambda x: F.contains(p["low"], x)).alias("inside")))
        first = lambda h: F.position(F.get(h.inside, F.lit(0)), p["low"]) - 1
        score = lambda h: F.least(F.lit(0.95), F.size(h.hits) / F.greatest(h.n, F.lit(1)))
        return X.let(hits, lambda h: F.when(F.size(h.hits) > 0, X.let(first(h), lambda at: found(score(h), cut(p["source"], at - 40, at + 160)))))

    st, low = X.strip(statement), F.lower(source)
    both = X.let(F.struct(st.alias("st"), F.lower(st).alias("low_st"), source.alias("source"), low.alias("low")), lambda p: F.struct(p["st"].alias("st"), p["source"].alias("source"), p["low"].alias("low"), F.position(p["low_st"], p["low"]).alias("at")))
    return X.let(both, lambda p: F.when((p["st"] != "") & (p["source"] != ""), F.when(p["at"] > 0, verbatim(p)).otherwise(shared(p))))
