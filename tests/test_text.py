import re

import pytest
from pyspark.sql import functions as F

from quire.functions import keys as K
from quire.functions import redaction as R
from quire.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f("v").alias("r")).first().r


@pytest.mark.parametrize("f", [X.clean_text, X.clean_paragraphs, X.clean_page, X.strip_noise, X.clean_scan, X.prune_admin, X.rewrite_keywords, X.strip_noise_lines, X.strip_headings, X.strip, X.line_key, R.mask_text])
def test_null_empty_and_long(spark, f):
    assert one(spark, None, f) is None
    assert one(spark, "", f) == ""
    assert one(spark, "word " * 20_000, f) is not None


def test_masking(spark):
    text = "call 555-123-4567 or mail jane@host.org, id 123-45-6789, acct 12345678, 12-3456789"
    assert one(spark, text, R.mask_text) == "call [REDACTED] or mail [REDACTED], id [REDACTED], acct [REDACTED], [REDACTED]"
    df = spark.createDataFrame([({"a": "x 123-45-6789"}, ["a@b.co", None], (1, "n 123456789"))], "m map<string,string>, l array<string>, s struct<a:int,b:string>")
    r = R.mask_frame(df).first()
    assert r.m == {"a": "x [REDACTED]"} and r.l == ["[REDACTED]", None] and r.s.b == "n [REDACTED]" and r.s.a == 1
    assert R.mask_frame(df, ["m"]).first().l == ["a@b.co", None]


def test_fingerprint_and_diagnostics(spark):
    df = spark.createDataFrame([("a", None, "abcdefghijkl", {"error": "boom", "id": "x-1", "note": "free text here"})], "a string, b string, c string, d map<string,string>")
    r = df.select(R.fingerprint("a", "b").alias("f"), R.fingerprint("b").alias("n"), R.mask_id("c").alias("m"), R.safe_diagnostics("d").alias("d")).first()
    assert re.fullmatch("[0-9a-f]{12}", r.f) and r.n is None and r.m == "abcd***ijkl" and r.d == {"id": "x-1", "note": "[redacted]"}


def test_cleaning(spark):
    assert one(spark, "Fax: 12\nReal line\n\n\n\nBilling due\nPage 3 of 4\nNext", X.strip_noise) == "Real line\n\nNext"
    assert one(spark, "a  b\nc\n\n\n d ", X.clean_paragraphs) == "a b c\n\nd"
    assert one(spark, "Reason for visit: back pain -", X.prune_admin) == "back pain"
    assert one(spark, "I understand that this is so", X.prune_admin) == ""
    assert one(spark, "n/a and none", X.rewrite_keywords) == "not provided and not noted"
    assert one(spark, "Keep me\nCall the office immediately\nBP 120/80 pulse 72 temp 98\n--\n\n\nAnd me\n", X.strip_noise_lines) == "Keep me\n\nAnd me"
    assert one(spark, "Plan:\nrest\n- Next:\nend", X.strip_headings) == "rest\nend"
    assert one(spark, "none noted", X.is_placeholder) is True and one(spark, "none of it", X.is_placeholder) is False


def test_noise_lines(spark):
    for line, want in [("", True), ("=====", True), ("12 34", True), ("ab 1", False), ("risk of injection", True), ("The plan is rest", False), ("call 911 now", True)]:
        assert one(spark, line, X.is_noise_line) is want, line


def test_tokens_and_sentences(spark):
    assert one(spark, "One. Two!  Three", X.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "abcdefgh", X.tokens_floor) == 2 and one(spark, "", X.tokens_floor) == 0 and one(spark, "abcde", X.tokens_ceil) == 2
    assert one(spark, "The patient's pain 12", X.content_tokens) == ["patient's", "pain"]
    assert one(spark, "HR 72, BP: 120/80 and temp 98.6", X.vitals_sentence) == "Vitals: BP 120/80 mmHg, HR 72 bpm, Temp 98.6°F"
    assert one(spark, "seen 05/06/2024", X.vitals_sentence) is None
    assert one(spark, "Neck pain and lumbar disc", X.complaint_labels) == ["Lumbar discopathy", "Neck pain"]
    r = spark.createDataFrame([(["a", "b"], ["b", "c"], [])], "a array<string>, b array<string>, e array<string>").select(X.jaccard(F.col("a"), F.col("b")).alias("j"), X.jaccard(F.col("a"), F.col("e")).alias("z"), X.bullets(F.col("e"), "none").alias("f")).first()
    assert r.j == pytest.approx(1 / 3) and r.z == 0.0 and r.f == "- none"


def test_keys(spark):
    df = spark.createDataFrame([("b", "o", None, "AB+/cd==", "gs://bk/a/b.pdf", "105445aa7843bc8bf206b12000100000/1;o=1", "report-v3", "eyJhIjogMX0")], "b string, o string, g string, h string, u string, t string, n string, j string")
    r = df.select(
        K.dedupe_key(F.col("b"), F.col("o"), F.col("g"), F.col("h")).alias("k"), K.split_uri("u").alias("u"), K.trace_parts("t").alias("t"), K.version_parts("n").alias("v"), K.decode_json_text("j").alias("j"), K.to_int("n", 7).alias("i"), K.to_bool("n").alias("x"), K.first_non_blank("g", "b").alias("f"),
    ).first()
    assert r.k == "b/o@nogeneration#abcd" and (r.u.bucket, r.u.path) == ("bk", "a/b.pdf") and r.t.span_id == "1" and (r.v.root, r.v.version) == ("report", 3) and r.j == '{"a": 1}' and r.i == 7 and r.x is False and r.f == "b"
    m = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": None})], "x map<string,string>, y map<string,string>").select(K.patched(F.col("x"), F.col("y")).alias("m")).first().m
    assert m == {"a": "1", "b": "3"}
    s = spark.createDataFrame([("hello world", [(None, 5), (6, 11)])], "t string, s array<struct<startIndex:int,endIndex:int>>").select(K.anchored_text(F.col("t"), F.col("s")).alias("r"), K.shifted_anchors(F.col("s"), F.lit(3)).alias("q")).first()
    assert s.r == "helloworld" and s.q[0].startIndex == 3 and s.q[1].endIndex == 14
