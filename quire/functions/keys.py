"""Identifiers, addresses, encodings and tolerant casts, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import _col, strip


def alnum(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}]", "")


def dedupe_key(bucket: Column, name: Column, generation: Column, digest: Column) -> Column:
    """``bucket/name@generation#digest``: the digest's letters and digits, or a hash of the rest."""
    seed = F.concat(bucket, F.lit("/"), name, F.lit("@"), F.coalesce(F.nullif(generation, F.lit("")), F.lit("nogeneration")))
    own = F.nullif(F.substring(alnum(digest), 1, 32), F.lit(""))
    return F.concat(seed, F.lit("#"), F.coalesce(own, F.substring(F.sha2(seed, 256), 1, 32)))


def digest_component(value: Column, seed: Column) -> Column:
    """Hex of a base64 digest, else its letters and digits, else a hash of the seed; 32 characters."""
    s = strip(value)
    raw = F.when(s.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$") & (s != ""), F.unbase64(s))
    plain = F.nullif(F.substring(alnum(s), 1, 32), F.lit(""))
    return F.coalesce(F.substring(F.lower(F.hex(raw)), 1, 32), plain, F.substring(F.sha2(seed, 256), 1, 32))


def split_uri(c: str | Column, scheme: str = "gs") -> Column:
    """struct<bucket, path> of ``scheme://bucket/path``, null if it isn't one."""
    p = rf"^{scheme}://([^/]+)/(.+)$"
    c = _col(c)
    return F.when(c.rlike(p), F.struct(F.regexp_extract(c, p, 1).alias("bucket"), F.regexp_extract(c, p, 2).alias("path")))


def join_uri(bucket: Column, path: Column, scheme: str = "gs") -> Column:
    return F.concat(F.lit(f"{scheme}://"), bucket, F.lit("/"), F.regexp_replace(path, "^/+", ""))


def trace_parts(c: str | Column) -> Column:
    """struct<trace_id, span_id> of ``TRACE/SPAN;o=1`` or of a ``00-trace-span-flags`` header."""
    c = _col(c)
    w3c = r"^[0-9a-f]{2}-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-f]{2}$"
    plain = r"^([0-9A-Fa-f]+)(?:/(\d+))?(?:;.*)?$"
    span = F.when(c.rlike(w3c), F.conv(F.regexp_extract(c, w3c, 2), 16, 10)).otherwise(F.nullif(F.regexp_extract(c, plain, 2), F.lit("")))
    trace = F.when(c.rlike(w3c), F.regexp_extract(c, w3c, 1)).otherwise(F.nullif(F.regexp_extract(c, plain, 1), F.lit("")))
    return F.when(trace.isNotNull(), F.struct(trace.alias("trace_id"), span.alias("span_id")))


def first_non_blank(*cols: str | Column) -> Column:
    return F.coalesce(*(F.nullif(strip(c), F.lit("")) for c in cols))


def decode_json_text(c: str | Column) -> Column:
    """Text of a base64 value whose padding may be missing, null if it isn't base64."""
    s = strip(c)
    padded = F.rpad(s, F.ceil(F.length(s) / 4).cast("int") * 4, F.lit("="))
    return F.when(padded.rlike(r"^[A-Za-z0-9+/]*={0,2}$"), F.unbase64(padded).cast("string"))


def version_parts(c: str | Column) -> Column:
    """struct<root, version> of ``name-vN``; version 1 without a suffix."""
    p = r"^(.+)-v(\d+)$"
    c = _col(c)
    return F.struct(
        F.when(c.rlike(p), F.regexp_extract(c, p, 1)).otherwise(c).alias("root"),
        F.when(c.rlike(p), F.regexp_extract(c, p, 2).cast("int")).otherwise(F.lit(1)).alias("version"),
    )


def to_bool(c: str | Column, default: bool = False) -> Column:
    s = F.lower(strip(c))
    return F.when(s.isin("1", "true", "yes", "on", "y", "t"), True).when(s.isin("0", "false", "no", "off", "n", "f"), False).otherwise(F.lit(default))


def to_int(c: str | Column, default: int | None = None) -> Column:
    return F.coalesce(strip(c).try_cast("int"), F.lit(default).cast("int"))


def to_double(c: str | Column, default: float | None = None) -> Column:
    return F.coalesce(strip(c).try_cast("double"), F.lit(default).cast("double"))


def iso_time(c: str | Column) -> Column:
    """UTC time as ISO-8601 with milliseconds (the session's zone must be UTC)."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def retain_until(c: str | Column, days: int) -> Column:
    return _col(c) + F.make_dt_interval(F.lit(days))


def string_map(c: str | Column) -> Column:
    """A map with its values as text."""
    return F.transform_values(_col(c), lambda _, v: v.cast("string"))


def patched(base: Column, patch: Column) -> Column:
    """``base`` with the patch's non-null values in place of its own."""
    patch = F.map_filter(F.coalesce(patch, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    rest = F.map_filter(F.coalesce(base, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(rest, patch)


def anchored_text(text: Column, segments: Column) -> Column:
    """The stretches of ``text`` that segments (startIndex null: 0, endIndex exclusive) point at, joined."""
    return F.array_join(F.transform(segments, lambda s: F.substring(text, F.coalesce(s.startIndex.cast("int"), F.lit(0)) + 1, s.endIndex.cast("int") - F.coalesce(s.startIndex.cast("int"), F.lit(0)))), "")


def shifted_anchors(segments: Column, by: Column) -> Column:
    """Segments moved by an offset."""
    return F.transform(segments, lambda s: F.struct((F.coalesce(s.startIndex.cast("int"), F.lit(0)) + by).alias("startIndex"), (s.endIndex.cast("int") + by).alias("endIndex")))
