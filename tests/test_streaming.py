import json
import time

from pyspark.sql import functions as F

from quire.streaming import jobs as S

SCHEMA = "job_id string, section_index int, total_sections int, summary_text string, ts timestamp, chunk_id string"


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(90)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def write(path, *batches):
    path.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        (path / f"{time.time_ns()}-{i}.json").write_text("\n".join(json.dumps(r) for r in rows))
        time.sleep(0.02)


def row(job, i, n, text, hour=0, chunk=None):
    return {"job_id": job, "section_index": i, "total_sections": n, "summary_text": text, "ts": f"2025-01-01T{hour:02}:00:00Z", "chunk_id": chunk}


def test_first_deliveries_and_states(spark, tmp_path):
    write(tmp_path / "in", [row("a", 1, 2, "x", 1, "C1"), row("A ", 1, 2, "x", 2, "c1 "), row("a", 2, 2, "y", 3, "c2")])
    stream = S.poll_files(spark, str(tmp_path / "in"), SCHEMA)
    assert len(run(S.first_deliveries(stream, ["job_id", "chunk_id"], "ts"), "first")) == 2
    got = run(S.latest_states(S.poll_files(spark, str(tmp_path / "in"), SCHEMA), "job_id", "ts", ["summary_text"]), "states", "update")
    assert {(r.job_id, r.summary_text, r.events) for r in got} == {("a", "y", 2), ("A ", "x", 1)}


def test_windows_equal_batch(spark, tmp_path):
    write(tmp_path / "in", [row("a", 1, 2, "x", h) for h in (1, 1, 2)], [row("b", 1, 1, "y", h) for h in (2, 9, 20)])
    stream = S.poll_files(spark, str(tmp_path / "in"), SCHEMA)
    got = run(S.windowed_counts(stream, "ts", ["job_id"], "1 hour"), "windows", "update")
    last = {}
    for r in got:
        last[r.window_start, r.job_id] = max(r.n, last.get((r.window_start, r.job_id), 0))
    batch = spark.read.schema(SCHEMA).json(str(tmp_path / "in")).groupBy(F.window("ts", "1 hour").start.alias("w"), "job_id").count().collect()
    assert last == {(r.w, r.job_id): r["count"] for r in batch}
    assert run(S.rate_stream(S.poll_files(spark, str(tmp_path / "in"), SCHEMA), "ts", F.col("job_id") == "a", F.col("job_id") == "b", "1 hour"), "rates", "update")
    assert run(S.sessions(S.poll_files(spark, str(tmp_path / "in"), SCHEMA), "job_id", "ts", "90 minutes"), "sess", "append") is not None


def test_completion(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", S.ROCKSDB)
    try:
        write(tmp_path / "in", [row("a", 2, 2, "two"), row("b", 1, 2, "only"), row("a", 1, 2, "one"), row("a", 1, 2, "one"), row(None, 1, 1, "x")])
        got = run(S.completed_jobs(S.poll_files(spark, str(tmp_path / "in"), SCHEMA)), "done")
        assert [(r.job_id, r.received, r.merged, r.reason) for r in got] == [("a", 2, "one\ntwo", "complete")]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_dead_letters(spark, tmp_path):
    write(tmp_path / "in", [row("a", 1, 1, "fine"), row(None, 1, 1, "id 123-45-6789")])
    good, bad = [], []
    f = S.split_batches(lambda d, _: good.extend(d.collect()), lambda d, _: bad.extend(d.collect()), F.col("job_id").isNull(), F.lit("no job"), "summary_text", "s")
    q = S.poll_files(spark, str(tmp_path / "in"), SCHEMA).writeStream.foreachBatch(f).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.job_id for r in good] == ["a"] and [(r.value, r.error_type) for r in bad] == [("id [REDACTED]", "no job")]
