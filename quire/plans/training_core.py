"""Queries of the two general training-data problems: deliveries and drifting schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.deliveries import collapse_deliveries, repeated_messages
from quire.operators.schema_drift import schema_changes, unify_records
from quire.scratch import table

_KEYS, _ORDER = ["job_id", "chunk_id"], ["received_at", "delivery_id"]
_TABLES = ("ocr_chunks", "summary_requests")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        repeated_messages(table(spark, sf_dir, t), _KEYS, _ORDER, batch="batch_id").select(F.lit(t).alias("record_table"), "job_id", "chunk_id")
        for t in _TABLES
    ]
    return parts[0].unionByName(parts[1])


def p2_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one row of each chunk message, its first delivery."""
    return collapse_deliveries(table(spark, sf_dir, "ocr_chunks"), _KEYS, _ORDER, ["delivery_id", "batch_id", "text"], batch="batch_id").select(
        "delivery_id", "batch_id", "job_id", "chunk_id", "text", "copies"
    )


def p2_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one row of each request message, its first delivery."""
    return collapse_deliveries(table(spark, sf_dir, "summary_requests"), _KEYS, _ORDER, ["delivery_id", "batch_id", "text", "section_index"], batch="batch_id").select(
        "delivery_id", "batch_id", "job_id", "chunk_id", "text", "section_index", "copies"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "contract_lines"))


def p3_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All contract and flat-summary records in one table of constant columns."""
    return unify_records(table(spark, sf_dir, "contract_lines"))


QUERIES = {f.__name__: f for f in (p2_found, p2_messages, p2_requests, p3_found, p3_table)}

_KEY_SQL = r"lower(regexp_replace({0}, '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g'))"
_J, _C = _KEY_SQL.format("job_id"), f"nullif({_KEY_SQL.format('chunk_id')}, '')"


def _messages_sql(name: str, columns: str) -> str:
    return f"""
        with k as (select *, {_J} as j, {_C} as c from {name}),
        n as (select *, row_number() over (partition by j, c order by received_at, delivery_id) as rn,
                     count(*) over (partition by j, c) as m from k where c is not null)
        select delivery_id, batch_id, j as job_id, c as chunk_id, {columns}, m as copies from n where rn = 1
        union all
        select delivery_id, batch_id, j, c, {columns}, 1 from k where c is null"""


ORACLE_SQL = {
    "p2_found": " union all ".join(
        f"select '{t}' as record_table, j as job_id, c as chunk_id from (select {_J} as j, {_C} as c from {t}) where c is not null group by j, c having count(*) > 1"
        for t in _TABLES
    ),
    "p2_messages": _messages_sql("ocr_chunks", "text"),
    "p2_requests": _messages_sql("summary_requests", "text, section_index"),
}
