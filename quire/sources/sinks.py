"""Writers: write-once records, canonical JSON, dead letters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch
from quire.functions.redaction import mask_text


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON with sorted keys at every level and without blanks; null fields are left out."""
    names = sorted(columns or df.columns)
    return F.to_json(F.struct(*(_sorted(df[f"`{n}`"], df.schema[n].dataType).alias(n) for n in names)))


def _sorted(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _sorted(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(c)))
    return c


class Conflict(ValueError):
    """A record of a known key came with other content."""


def write_once(df: DataFrame, path: str, keys: list[str], on_conflict: str = "error") -> int:
    """Append the records whose keys aren't stored yet; gives their number.

    A replay of the same content does nothing.  Other content under a known key
    raises :class:`Conflict` (or is dropped with ``on_conflict="keep"``) before
    anything is written.  Content is compared by a hash over all columns, so
    stamps that differ between replays should be left out.  Two contents for one
    key within ``df`` conflict as well.
    """
    spark = df.sparkSession
    body = [c for c in df.columns if c not in keys]
    hashed = df.withColumn("_hash", F.sha2(canonical_json(df, body) if body else F.lit(""), 256))
    batch = hashed.groupBy(*keys).agg(F.min_by(F.struct(*body, "_hash"), "_hash").alias("r"), F.count_distinct("_hash").alias("n"))
    batch = scratch.stage(batch.select(*keys, *(F.col(f"r.{c}").alias(c) for c in body), F.col("r._hash").alias("_hash"), "n"), "write-once")
    if not scratch.exists(spark, path):
        fresh, clash = batch, batch.filter("n > 1")
    else:
        known = spark.read.parquet(path).select(*keys, F.col("_hash").alias("_known"))
        clash = batch.join(known, keys, "left").filter("n > 1 or _known <> _hash")
        fresh = batch.join(known, keys, "left_anti")
    if on_conflict == "error" and (bad := clash.select(*keys).first()):
        raise Conflict(f"other content is stored under {tuple(bad)}")
    fresh = fresh.drop("n")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def latest_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key."""
    body = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*body), F.struct(*order)).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in body))


def encode_messages(df: DataFrame, event_type: str) -> DataFrame:
    """Rows as messages: value (canonical JSON) and attributes (event_type and the row's metadata)."""
    attributes = F.create_map(F.lit("event_type"), F.lit(event_type))
    if "metadata" in df.columns:
        meta = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (k != "event_type"))
        attributes = F.map_concat(attributes, meta)
    return df.select(canonical_json(df).alias("value"), attributes.alias("attributes"))


def dead_letters(bad: DataFrame, value: str, reason: str, stage: str) -> DataFrame:
    """Rejected messages for a dead-letter sink, with identifiers masked."""
    return bad.select(mask_text(value).alias("value"), F.col(reason).alias("error_type"), F.lit(stage).alias("stage"))


def through(df: DataFrame, call: Callable[[str], str], text: str, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: what an external callable makes of each text; ``partitions`` bounds how many run at once.

    An error of the callable gives null and its type in ``out_error``.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), T.StructField(f"{out}_error", T.StringType())])

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            made, failed = [], []
            for t in batch[text]:
                try:
                    made.append(None if t is None else call(t))
                    failed.append(None)
                except Exception as e:  # the row is reported, the job goes on
                    made.append(None)
                    failed.append(type(e).__name__)
            batch[out], batch[f"{out}_error"] = made, failed
            yield batch

    rows = df.repartition(partitions) if partitions else df
    return rows.mapInPandas(run, schema)


def manifest(parts: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One JSON manifest a key with its parts in order."""
    return parts.groupBy(key).agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("artifacts"), F.count(F.lit(1)).alias("count"))).alias("manifest"))


def minimal_pdf(text: str) -> bytes:
    """A plain PDF of one page with the text's lines (Latin-1; what doesn't fit the page is cut)."""
    safe = [line.encode("latin-1", "replace").decode("latin-1").replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for line in text.split("\n")][:54]
    stream = ("BT /F1 10 Tf 50 780 Td 14 TL " + " ".join(f"({line}) Tj T*" for line in safe) + " ET").encode("latin-1")
    bodies = [
        b"<< /Type /Catalog /Pages 2 0 R >>",
        b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 842] /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>",
        b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream),
        b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    ]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, at))
