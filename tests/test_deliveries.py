from datetime import datetime, timedelta

import pytest

from quire.operators.deliveries import MessageStore, collapse_deliveries, message_key, repeated_messages

T0 = datetime(2025, 1, 1)
SCHEMA = "delivery_id long, job_id string, chunk_id string, text string, received_at timestamp, metadata map<string,string>, _row string, copies int"


def rows(*items):
    return [(i, j, c, t, T0 + timedelta(hours=h), {"a": "b"}, "x", 9) for i, j, c, t, h in items]


@pytest.fixture
def messages(spark):
    return spark.createDataFrame(
        rows(
            (1, "job-1", "chunk-1", "first", 1), (2, " JOB-1\t", "Chunk-1 ", "again", 0), (3, "job-1", "chunk-2", None, 2), (4, "job-2", "chunk-1", "", 3),
            (5, "job-1", None, "a", 1), (6, "job-1", "  ", "a", 1), (7, "job-2", "chunk-1", "", 3), (8, None, "chunk-9", "n", 1), (9, None, "chunk-9", "n", 1),
        ),
        SCHEMA,
    )


@pytest.mark.parametrize("runs", [1, 3])
def test_one_row_a_message(spark, messages, runs):
    out = collapse_deliveries(messages, ["job_id", "chunk_id"], ["received_at", "delivery_id"], ["delivery_id", "text", "metadata"], batch_runs=runs)
    got = {(r.job_id, r.chunk_id, r.delivery_id): (r.copies, r.text) for r in out.collect()}
    assert got == {
        ("job-1", "chunk-1", 2): (2, "again"), ("job-1", "chunk-2", 3): (1, None), ("job-2", "chunk-1", 4): (2, ""), (None, "chunk-9", 8): (2, "n"),
        ("job-1", None, 5): (1, "a"), ("job-1", None, 6): (1, "a"),
    }


def test_repeated(spark, messages):
    out = repeated_messages(messages, ["job_id", "chunk_id"], ["received_at", "delivery_id"]).collect()
    assert {(r.job_id, r.chunk_id, r.copies) for r in out} == {("job-1", "chunk-1", 2), ("job-2", "chunk-1", 2), (None, "chunk-9", 2)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert collapse_deliveries(none, ["job_id", "chunk_id"], ["received_at", "delivery_id"]).count() == 0
    assert repeated_messages(none, ["job_id", "chunk_id"], ["received_at", "delivery_id"]).count() == 0


def test_hot_key_and_long_text(spark):
    df = spark.range(3000).selectExpr("id as delivery_id", "'j' as job_id", "if(id % 3 = 0, 'hot', cast(id as string)) as chunk_id", "repeat('x', 5000) as text", "timestamp'2025-01-01' as received_at")
    out = collapse_deliveries(df, ["job_id", "chunk_id"], ["received_at", "delivery_id"], ["delivery_id", "text"])
    hot = out.filter("chunk_id = 'hot'").collect()
    assert out.count() == 2001 and len(hot) == 1 and hot[0].delivery_id == 0 and hot[0].copies == 1000 and len(hot[0].text) == 5000


def test_store_is_idempotent_and_compacts(spark, messages):
    keyed = messages.filter("trim(chunk_id) <> '' and job_id is not null")
    keyed = keyed.withColumns({k: message_key(k) for k in ("job_id", "chunk_id")})
    store = MessageStore(spark, ["job_id", "chunk_id"], ["received_at", "delivery_id"], ["delivery_id"], buckets=3)
    store.upsert(keyed.filter("delivery_id < 3"), "a")
    store.upsert(keyed.filter("delivery_id >= 3"), "b")
    store.upsert(keyed.filter("delivery_id >= 3"), "b")
    before = sorted(map(tuple, store.read().collect()))
    assert len(before) == 3
    plan = store.read().filter("job_id = 'job-1' and chunk_id = 'chunk-1'")
    assert plan.count() == 1
    store.compact()
    assert sorted(map(tuple, store.read().collect())) == before and len(set(store.runs.values())) == 1
    store.upsert(keyed, "b")
    assert sorted(map(tuple, store.read().collect())) == before
    store.upsert(keyed.filter("delivery_id = 7"), "c")
    store.compact()
    assert {r.copies for r in store.read().filter("job_id = 'job-2'").collect()} == {3}
    store.close()


def test_store_after_a_restart(spark, messages, tmp_path):
    keyed = messages.filter("trim(chunk_id) <> ''").withColumns({k: message_key(k) for k in ("job_id", "chunk_id")})
    args = (["job_id", "chunk_id"], ["received_at", "delivery_id"], ["delivery_id"], f"file://{tmp_path}/store", 3)
    first = MessageStore(spark, *args)
    first.upsert(keyed.filter("delivery_id < 3"), "a")
    first.close()
    second = MessageStore(spark, *args)
    second.upsert(keyed.filter("delivery_id < 3"), "a")
    second.upsert(keyed.filter("delivery_id >= 3"), "b")
    want = sorted((str(r.job_id), r.chunk_id, r.delivery_id, r.copies) for r in second.read().collect())
    assert want == [("None", "chunk-9", 8, 2), ("job-1", "chunk-1", 2, 2), ("job-1", "chunk-2", 3, 1), ("job-2", "chunk-1", 4, 2)]
    stale = MessageStore(spark, *args)
    second.compact()
    with pytest.raises(Exception, match="(?i)exist"):  # another writer was first
        stale.upsert(keyed, "c")
    third = MessageStore(spark, *args)
    assert sorted((str(r.job_id), r.chunk_id, r.delivery_id, r.copies) for r in third.read().collect()) == want and set(third.runs) == {"a", "b"}
    with pytest.raises(ValueError):
        MessageStore(spark, ["job_id"], *args[1:])
    for s in (second, stale, third):
        s.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("messages_")]


def test_merge_neither_shuffles_nor_sorts(spark, messages, tmp_path):
    keyed = messages.filter("trim(chunk_id) <> '' and job_id is not null").withColumns({k: message_key(k) for k in ("job_id", "chunk_id")})
    store = MessageStore(spark, ["job_id", "chunk_id"], ["received_at", "delivery_id"], ["delivery_id"], buckets=3)
    for i in range(2):
        store.upsert(keyed.filter(f"delivery_id % 2 = {i}"), f"run-{i}")
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    store.close()
