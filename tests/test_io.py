import base64
import json

import pytest

from quire.sources import files, sinks


def test_envelopes(spark):
    obj = {"bucket": "b", "name": "o.pdf", "generation": "7", "size": "12", "md5Hash": "h"}
    inner = base64.b64encode(json.dumps(obj).encode()).decode().rstrip("=")
    raw = [json.dumps({"object": obj}), json.dumps({"data": {**obj, "bucket": " "}}), json.dumps(obj), json.dumps({"message": {"data": inner, "attributes": {"bucketId": "b2"}}}), json.dumps({"message": {"data": None, "attributes": {"bucketId": "b2", "objectId": "x"}}}), "broken", None]
    got = [tuple(r) for r in files.intake_objects(spark.createDataFrame([(v,) for v in raw], "value string")).collect()]
    assert [(g[0], g[1], g[5]) for g in got] == [("b", "o.pdf", "object"), (None, "o.pdf", "data"), ("b", "o.pdf", "flat"), ("b", "o.pdf", "message"), ("b2", "x", "message"), (None, None, "flat"), (None, None, "flat")]
    assert got[0][2:5] == ("7", 12, "h")


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document": {"text": "", "pages": [{"page_number": 2, "text": "two"}, {"page_number": 1, "text": "one"}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"text": "whole", "metadata": {"facility": "f"}}))
    docs = files.read_documents(spark, str(tmp_path))
    assert sorted(r.text for r in docs.collect()) == ["one\ntwo", "whole"]
    from pyspark.sql import functions as F

    assert files.concatenated(docs, F.lit("p")).first().text == "one\ntwo\nwhole"


def test_pdfs_and_lists(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(sinks.minimal_pdf("Hello (there)\nline"))
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "ids.txt").write_text("abc-1 # note\n\n# all\nx\nabc-1\n")
    assert files.newest_files(spark, str(tmp_path)).count() == 2 and files.newest_files(spark, str(tmp_path), limit=1).count() == 1
    assert [r.path.rsplit("/", 1)[1] for r in files.read_pdfs(spark, str(tmp_path)).collect()] == ["a.pdf"]
    assert [r.id for r in files.read_id_list(spark, str(tmp_path / "ids.txt")).collect()] == ["abc-1"]
    body = sinks.minimal_pdf("x")
    assert body.startswith(b"%PDF-") and body.rstrip().endswith(b"%%EOF") and int(body.rsplit(b"startxref\n", 1)[1].split()[0]) == body.index(b"xref\n0")


def test_messages_split(spark):
    raw = spark.createDataFrame([('{"job_id": "j", "text": "t", "page_range": [1, 2]}',), ("{bad",), ('{"text": "x 123-45-6789"}',), (None,)], "value string")
    good, bad = files.decode_messages(raw, files.CHUNK_MESSAGE_SCHEMA)
    assert [(r.job_id, r.page_range) for r in good.collect()] == [("j", [1, 2])]
    assert sorted(r.reason for r in bad.collect()) == ["no job_id", "unreadable", "unreadable"]
    dead = sinks.dead_letters(bad, "value", "reason", "intake").collect()
    assert any("[REDACTED]" in (r.value or "") for r in dead)


def test_canonical_json(spark):
    df = spark.createDataFrame([(1, {"b": "2", "a": "1"}, (3, None))], "z int, m map<string,string>, s struct<y:int,x:string>")
    assert df.select(sinks.canonical_json(df).alias("j")).first().j == '{"m":{"a":"1","b":"2"},"s":{"y":3},"z":1}'
    enc = sinks.encode_messages(spark.createDataFrame([("j", {"k": "v"})], "job_id string, metadata map<string,string>"), "chunk").first()
    assert enc.attributes == {"event_type": "chunk", "k": "v"}


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("j", "c1", "x"), ("j", "c2", None)], "job string, chunk string, t string")
    assert sinks.write_once(a, path, ["job", "chunk"]) == 2
    assert sinks.write_once(a, path, ["job", "chunk"]) == 0
    with pytest.raises(sinks.Conflict):
        sinks.write_once(spark.createDataFrame([("j", "c1", "other"), ("j", "c3", "n")], a.schema), path, ["job", "chunk"])
    assert spark.read.parquet(path).count() == 2
    assert sinks.write_once(spark.createDataFrame([("j", "c1", "other"), ("j", "c3", "n")], a.schema), path, ["job", "chunk"], "keep") == 1


def test_latest_and_callable(spark):
    df = spark.createDataFrame([("j", 1, "a"), ("j", 2, "b"), ("k", 1, None)], "k string, o int, t string")
    assert {(r.k, r.t) for r in sinks.latest_wins(df, ["k"], ["o"]).collect()} == {("j", "b"), ("k", None)}

    def call(t):
        if t == "b":
            raise KeyError(t)
        return t.upper()

    got = {(r.k, r.o): (r.out, r.out_error) for r in sinks.through(df, call, "t", "out", partitions=2).collect()}
    assert got == {("j", 1): ("A", None), ("j", 2): (None, "KeyError"), ("k", 1): (None, None)}
    m = sinks.manifest(df, "k", "o", ["t"]).filter("k = 'j'").first().manifest
    assert json.loads(m) == {"artifacts": [{"o": 1, "t": "a"}, {"o": 2, "t": "b"}], "count": 2}
