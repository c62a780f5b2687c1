"""Masking of identifiers and of diagnostic values, as expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import lexicons as L
from quire.functions.text import _col, strip


def mask_text(c: str | Column, patterns: tuple[str, ...] = L.MASK_PATTERNS, replacement: str = L.MASK) -> Column:
    """Every match of the patterns replaced, one pattern after the other; null stays null."""
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return reduce(lambda x, p: F.regexp_replace(x, p, literal), patterns, _col(c))


def mask_nested(c: Column, kind: T.DataType, mask: Callable[[Column], Column] = mask_text) -> Column:
    """All texts inside a value of any type masked; keys, numbers and nulls stay."""
    if isinstance(kind, T.StringType):
        return mask(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: mask_nested(x, kind.elementType, mask))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: mask_nested(v, kind.valueType, mask))
    if isinstance(kind, T.StructType):
        fields = F.struct(*(mask_nested(c[f.name], f.dataType, mask).alias(f.name) for f in kind.fields))
        return F.when(c.isNotNull(), fields)
    return c


def mask_frame(df: DataFrame, columns: list[str] | None = None, mask: Callable[[Column], Column] = mask_text) -> DataFrame:
    """The named columns (default: all) masked, whatever their types."""
    chosen = set(columns if columns is not None else df.columns)
    return df.select(*(mask_nested(df[f"`{f.name}`"], f.dataType, mask).alias(f.name) if f.name in chosen else df[f"`{f.name}`"] for f in df.schema.fields))


def fingerprint(*parts: str | Column) -> Column:
    """Twelve hex digits of the SHA-256 of the non-blank parts joined by ``|``, null if there are none."""
    seed = F.concat_ws("|", *(F.nullif(strip(p), F.lit("")) for p in parts))
    return F.when(seed != "", F.substring(F.sha2(seed, 256), 1, 12))


def safe_diagnostic(c: str | Column) -> Column:
    """Tokens and addresses stay, free text becomes ``[redacted]``, blank becomes null."""
    s = strip(c)
    safe = s.rlike(r"^(?:gs://|https?://|projects/)") | s.rlike(r"^[A-Za-z0-9._/@:+#=-]{1,160}$")
    return F.when(s == "", F.lit(None)).when(safe, s).otherwise(F.lit("[redacted]"))


def safe_diagnostics(c: str | Column) -> Column:
    """A map without error texts, its other values made safe; null if nothing is left."""
    kept = F.map_filter(_col(c), lambda k, v: ~k.isin("error", "message", "detail", "details", "reason") & safe_diagnostic(v).isNotNull())
    safe = F.transform_values(kept, lambda _, v: safe_diagnostic(v))
    return F.when(F.size(safe) > 0, safe)


def mask_id(c: str | Column) -> Column:
    """An identifier with its middle hidden: two characters of short ones, four at either end of others."""
    c = _col(c)
    return F.when(F.length(c) <= 8, F.concat(F.substring(c, 1, 2), F.lit("***"))).otherwise(F.concat(F.substring(c, 1, 4), F.lit("***"), F.right(c, F.lit(4))))


def allowed_fields(c: str | Column, allowed: tuple[str, ...]) -> Column:
    """A map with the allowed keys only, without null values."""
    return F.map_filter(_col(c), lambda k, v: k.isin(*allowed) & v.isNotNull())


def public_history(history: Column) -> Column:
    """A job's history with the messages of failures replaced by a fixed text and a fingerprint."""
    return F.transform(
        history,
        lambda h: F.struct(
            h.status.alias("status"),
            h.stage.alias("stage"),
            F.when(F.upper(h.status) == "FAILED", F.lit("failed")).otherwise(h.message).alias("message"),
            F.when(F.upper(h.status) == "FAILED", fingerprint(h.status, h.stage, h.message)).alias("fingerprint"),
            h.timestamp.alias("timestamp"),
        ),
    )
