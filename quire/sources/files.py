"""Documents and messages read from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.keys import decode_json_text, first_non_blank

DOCUMENT_SCHEMA = "text string, metadata struct<patient_info:string,facility:string,billing:string,legal_notes:string>, pages array<struct<page_number:int,text:string>>"
CHUNK_MESSAGE_SCHEMA = "job_id string, chunk_id string, trace_id string, text string, page_range array<int>, shard_id string, source_event_id string, total_pages int, created_at timestamp, metadata map<string,string>"
RESULT_MESSAGE_SCHEMA = "job_id string, chunk_id string, trace_id string, summary_text string, section_index int, total_sections int, tokens_used int, aggregate boolean, created_at timestamp, metadata map<string,string>"


def newest_files(spark: SparkSession, path: str, pattern: str = "*.pdf", limit: int = 10) -> DataFrame:
    """Path, modification time and length of the newest files (100 at most; of equal times by path); contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    return files.orderBy(F.desc("modificationTime"), "path").limit(max(0, min(limit, 100)))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """Files that begin like a PDF: path, length, digests and content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.filter(F.substring("content", 1, 5) == F.expr("X'255044462D'")).select("path", "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents, one a file, bare or below ``document``; text from the pages where it is missing."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.json").withColumn("source_path", F.col("_metadata.file_path"))
    wrapped = F.from_json("value", f"document struct<{_struct_fields()}>")
    bare = F.from_json("value", DOCUMENT_SCHEMA)
    doc = raw.select("source_path", F.coalesce(wrapped["document"], bare).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.coalesce("d.pages", F.array().cast("array<struct<page_number:int,text:string>>"))), lambda p: F.coalesce(p.text, F.lit(""))), "\n")
    return doc.select("source_path", F.coalesce(F.nullif("d.text", F.lit("")), F.nullif(joined, F.lit(""))).alias("text"), "d.metadata", "d.pages")


def _struct_fields() -> str:
    return "text:string,metadata:struct<patient_info:string,facility:string,billing:string,legal_notes:string>,pages:array<struct<page_number:int,text:string>>"


def concatenated(documents: DataFrame, prefix: Column) -> DataFrame:
    """Documents below one prefix as one: prefix, text (joined by newlines in path order), shards."""
    rows = documents.select(prefix.alias("prefix"), "source_path", "text")
    return rows.groupBy("prefix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("source_path", "text"))), lambda s: s.text), "\n").alias("text"), F.count(F.lit(1)).alias("shards"))


def read_id_list(spark: SparkSession, path: str, form: str = r"^[A-Za-z0-9_-]{3,}$") -> DataFrame:
    """One id a line; blank lines and what follows ``#`` don't count; ids of another form are left out."""
    ids = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("id"))
    return ids.filter(F.col("id").rlike(form)).distinct()


_OBJECT = "struct<bucket:string,bucketId:string,name:string,objectId:string,object_name:string,generation:string,size:string,md5Hash:string,md5_hash:string>"


def intake_objects(raw: DataFrame, value: str = "value") -> DataFrame:
    """bucket, object_name, generation, size, md5_hash, envelope of intake events in any of their envelopes.

    Known envelopes: ``object``, ``data``, ``message`` with base64 data, flat.
    Of alias fields the first non-blank counts; events without bucket or name
    have nulls there.
    """
    outer = F.from_json(value, f"object {_OBJECT}, data {_OBJECT}, message struct<data:string,attributes:map<string,string>>")
    inner = F.from_json(decode_json_text(outer["message"]["data"]), "bucket string, bucketId string, name string, objectId string, object_name string, generation string, size string, md5Hash string, md5_hash string")
    attrs = outer["message"]["attributes"]
    flat = F.from_json(value, "bucket string, bucketId string, name string, objectId string, object_name string, generation string, size string, md5Hash string, md5_hash string")
    o = F.coalesce(outer["object"], outer["data"], inner, flat)
    kind = F.when(outer["object"].isNotNull(), "object").when(outer["data"].isNotNull(), "data").when(outer["message"].isNotNull(), "message").otherwise("flat")
    null = F.lit(None).cast("string")
    at = lambda k: F.coalesce(attrs[k], null)
    return raw.select(
        first_non_blank(o["bucket"], o["bucketId"], at("bucketId")).alias("bucket"),
        first_non_blank(o["name"], o["object_name"], o["objectId"], at("objectId")).alias("object_name"),
        first_non_blank(o["generation"], at("objectGeneration")).alias("generation"),
        o["size"].try_cast("bigint").alias("size"),
        first_non_blank(o["md5Hash"], o["md5_hash"]).alias("md5_hash"),
        kind.alias("envelope"),
    )


def decode_messages(raw: DataFrame, schema: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Good and bad messages: the parsed rows, and the rest with the reason."""
    parsed = raw.select(value, F.from_json(value, schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull() | F.col("m.job_id").isNull()
    reason = F.when(F.col("m").isNull() | F.col("m._corrupt").isNotNull(), "unreadable").otherwise("no job_id")
    return parsed.filter(~F.coalesce(bad, F.lit(True))).select("m.*").drop("_corrupt"), parsed.filter(F.coalesce(bad, F.lit(True))).select(value, reason.alias("reason"))
