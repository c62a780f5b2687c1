"""A mixture of sources with target shares of all tokens.

Every document gets a random key from a hash of its id.  Within a source
documents are taken in key order until the source's token budget is used up; a
budget beyond one pass over the source starts another one.

Scale: keys are uniform, so their range is cut into equal bins without looking
at the data (by the number of documents only), and (source, bin) groups stay even when one source has a third of
all rows.  Prefix sums are formed over bin totals (sources x bins rows) and then
inside each bin, so no task ever orders a whole source.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.scratch import stage

#: Bins of the key range of each source, at least, and documents of one source in a bin, about and at most.
BINS, BIN_ROWS = 1024, 1 << 18
DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to byte-level BPE vocabularies of this kind (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def source_key(col: str | Column) -> Column:
    """One form for all spellings of a source: letters and digits in lower case, joined by ``_``."""
    c = F.col(col) if isinstance(col, str) else col
    c = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_")
    c = F.regexp_replace(c, r"^_+|_+$", "")
    return F.when(c != "", c)


def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text_col: str, tokenizer: str = DEFAULT_TOKENIZER) -> DataFrame:
    """``df`` without the text, with ``tokens``: the tokens of a public byte-level
    BPE vocabulary (a ``.tiktoken`` file); null texts have none."""
    keep = [c for c in df.columns if c != text_col]
    schema = df.select(*keep).withColumn("tokens", F.lit(0).cast("bigint")).schema

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(tokenizer)
        for batch in batches:
            texts = batch.pop(text_col)
            batch["tokens"] = [0 if t is None else len(encoder.encode_ordinary(t)) for t in texts]
            yield batch

    return df.mapInPandas(count, schema)


def plan_budgets(totals: list[dict], total_tokens: int | None = None, tolerance: float = 0.0) -> list[dict]:
    """Budget of each source, from its share, cap and available tokens.

    total_tokens: size of the mixture; by default the largest one at which the
    shares that can't be met (their sum, sources without documents apart) stay
    within ``tolerance``.  A source that can't fill its share gives all its
    copies; the others keep their proportions to each other.
    """
    live = [t for t in totals if t["share"] > 0 and t["available"] > 0 and t["cap"] > 0]
    reach = sorted((t["available"] * t["cap"] / t["share"], t["share"]) for t in live)
    if total_tokens is None:
        given, size = sum(s for _, s in reach) or 1.0, 0.0
        for most, _ in reach:
            lacking = sum(s * (1 - m / most) for m, s in reach if m < most)
            if lacking / given > tolerance + 1e-12:
                break
            size = most
        # with every live share met, theirs make up the whole mixture
        total_tokens = int(size * given) if tolerance == 0 else int(size)
    given = sum(t["share"] for t in live)
    budgets, short, left, weight = {}, set(), float(total_tokens), given
    while True:  # short sources are taken out until the rest fits
        more = [t for t in live if t["source"] not in short and t["available"] * t["cap"] < left * t["share"] / weight * (1 - 1e-9)]
        if not more:
            break
        for t in more:
            short.add(t["source"])
        left = total_tokens - sum(t["available"] * t["cap"] for t in live if t["source"] in short)
        weight = sum(t["share"] for t in live if t["source"] not in short)
        if weight <= 0:
            break
    for t in totals:
        usable = t in live
        full = t["available"] * t["cap"]
        budget = 0.0 if not usable else full if t["source"] in short or weight <= 0 else left * t["share"] / weight
        budgets[t["source"]] = min(float(full), budget)
    return [{**t, "budget": budgets[t["source"]], "short": t["source"] in short or (t["share"] > 0 and not t["available"])} for t in totals]


def draw_mixture(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", seed: int = 17, total_tokens: int | None = None, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Selection and report.

    docs: id, source, tokens.  targets: source, target_share, max_repeats (one
    row a source; shares are scaled to sum to 1 only in the report).

    Selection: id, source, tokens, copies (1 to max_repeats).  Report: source,
    target_share, max_repeats, documents, tokens_available, tokens_selected,
    actual_share, copies_max, is_short.

    A source's selected tokens miss its budget by less than one document.
    Spellings of a source count as that source; documents without a listed
    source, of null or no tokens are left out.  Equal hash keys are ordered by
    id; repeated rows are documents of their own.  Without documents the
    selection is empty and the report has zeros and a null actual share.
    """
    spark = docs.sparkSession
    listed = targets.select(source_key("source").alias("source"), F.col("target_share").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).filter("source is not null")
    keyed = docs.select(F.col(id_col).alias("id"), source_key("source").alias("source"), "tokens").filter("source is not null and tokens > 0")
    # the targets are one row a source: the size estimate of the scan decides on the join
    keyed = keyed.join(listed.select("source"), "source", "left_semi")
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40))
    # more documents, more bins: what is sorted in a task keeps its size
    n_bins = max(BINS, 1 << max(0, docs.count() // BIN_ROWS).bit_length())
    keyed = keyed.withColumn("u", unit).withColumn("bin", F.expr(f"cast(u div {(1 << 40) // n_bins} as int)"))
    bins = keyed.groupBy("source", "bin").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row a source and bin: the totals are read once and planned on the driver
    bins = stage(bins, "mixture-bins")
    totals = bins.groupBy("source").agg(F.sum("t").alias("available"), F.sum("n").alias("documents"))
    facts = [
        {"source": r.source, "share": float(r.target_share or 0), "cap": int(r.max_repeats or 0), "available": int(r.available or 0), "documents": int(r.documents or 0)}
        for r in listed.join(totals, "source", "left").collect()
    ]
    plan = plan_budgets(facts, total_tokens, tolerance)
    plan_schema = "source string, target_share double, max_repeats int, documents bigint, tokens_available bigint, budget double, is_short boolean"
    budgets = spark.createDataFrame([(p["source"], p["share"], p["cap"], p["documents"], p["available"], p["budget"], p["short"]) for p in plan], plan_schema)
    starts = bins.select("source", "bin", before.alias("before")).join(budgets.select("source", "budget", "tokens_available", "max_repeats"), "source")
    inside = Window.partitionBy("source", "bin").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("inner_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(starts, ["source", "bin"])
    at = F.col("before") + F.col("inner_before")
    rest = F.col("budget") - F.floor(F.col("budget") / F.col("tokens_available")) * F.col("tokens_available")
    # a document is in the last, partial pass if at least half of it lies within the budget
    partial = (at + F.col("tokens") / 2 <= rest).cast("int")
    copies = F.least(F.floor(F.col("budget") / F.col("tokens_available")).cast("int") + partial, F.col("max_repeats"))
    selection = placed.select(F.col("id").alias(id_col), "source", "tokens", copies.alias("copies")).filter("copies > 0")
    got = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens_selected"), F.max("copies").alias("copies_max"))
    report = budgets.join(got, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "tokens_available",
        F.coalesce("tokens_selected", F.lit(0)).alias("tokens_selected"),
        (F.coalesce("tokens_selected", F.lit(0)) / F.nullif(F.sum("tokens_selected").over(Window.partitionBy()), F.lit(0))).alias("actual_share"),
        F.coalesce("copies_max", F.lit(0)).alias("copies_max"),
        "is_short",
    )
    return selection, report
