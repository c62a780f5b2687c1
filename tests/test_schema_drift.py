import itertools
import json
import random

import pytest

from quire.operators.schema_drift import assign, compare, name_likeness, read_object, schema_changes, unify_records, unreadable_lines

SCHEMA = "line_id long, feed string, file_no int, payload string, path string"


def lines(spark, files):
    out, n = [], itertools.count()
    for feed, file_no, records in files:
        out += [(next(n), feed, file_no, r if isinstance(r, str) else json.dumps(r), "clash") for r in records]
    return spark.createDataFrame(out, SCHEMA)


def changes(df):
    return {(r.feed, r.file_no, r.change_kind, r.old_path, r.new_path) for r in schema_changes(df).collect()}


def record(key, **fields):
    return {"record_key": key, **fields}


def test_kinds_of_change(spark):
    one = [record("a", name="n1", size=1, tags=["x"], sub=[{"k": "v1", "w": 1}], gone=True), record("b", name="n2", size=2, tags=["y"], sub=[{"k": "v2", "w": 2}], gone=False)]
    two = [record("b", title="n2", size="2", tags=["y"], parts=[{"key": "v2", "w": 2}], extra=None), record("c", title="n3", size="3", tags=["z"], parts=[{"key": "v3", "w": 3, "new": 1}])]
    df = lines(spark, [("f", 1, one), ("f", 4, [*two, "{broken", two[0]])])
    assert changes(df) == {
        ("f", 4, "renamed", "name", "title"),
        ("f", 4, "retyped", "size", "size"),
        ("f", 4, "renamed", "sub", "parts"),
        ("f", 4, "renamed", "sub[].k", "parts[].key"),
        ("f", 4, "added", "", "parts[].new"),
        ("f", 4, "removed", "gone", ""),
    }
    assert unreadable_lines(df).count() == 1


def test_new_values_are_no_rename(spark):
    df = lines(spark, [("f", 1, [record("a", x="1"), record("b", x="2")]), ("f", 2, [record("b", y="other"), record("c", y="3")])])
    assert changes(df) == {("f", 2, "removed", "x", ""), ("f", 2, "added", "", "y")}


def test_feeds_are_apart_and_order_is_by_number(spark):
    df = lines(spark, [("g", 10, [record("a", x=1, y=1)]), ("g", 9, [record("a", x=1)]), ("h", 10, [record("a", z=1)])])
    assert changes(df) == {("g", 10, "added", "", "y")}


def test_empty_null_and_unreadable(spark):
    assert changes(spark.createDataFrame([], SCHEMA)) == set()
    df = lines(spark, [("f", 1, ["nope", "[1]", ""]), (None, 1, [record("a", x=1)]), ("f", 2, [record("a", x=None)])])
    assert changes(df) == set()
    assert unify_records(df.filter("feed is not null")).count() == 1
    assert read_object(None) is None and read_object("3") is None


def test_unified_table_keeps_first_names(spark):
    long = "x" * 50_000
    df = lines(
        spark,
        [
            ("flat", 1, [{"record_key": "a", "Patient Information": "p1", "schema_version": "1", "page_total": 3}]),
            ("flat", 2, [{"record_key": "a", "person": "p1", "schema_version": "1", "page_total": "3"}, {"record_key": "b", "person": long, "schema_version": ["2"]}]),
            ("flat", 3, [{"record_key": "b", "who": long, "schema_version": ["2"], "note": {"b": 1, "a": 2}}]),
        ],
    )
    got = {(r.file_no, r.record_key): r for r in unify_records(df).collect()}
    assert [got[k].patient_information for k in sorted(got)] == ["p1", "p1", long, long]
    assert got[3, "b"].schema_version == "2" and got[3, "b"].extra["note"] == '{"a": 2, "b": 1}'
    assert got[1, "a"].extra["page_total"] == got[2, "a"].extra["page_total"] == "3"


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        score = [[rng.choice((0.0, rng.random())) for _ in range(m)] for _ in range(n)]
        best = max(sum(score[i][p[i]] for i in range(n) if p[i] < m) for p in itertools.permutations(range(max(n, m)), n))
        got = assign(score)
        assert sum(score[i][j] for i, j in enumerate(got) if j >= 0) == pytest.approx(best)
        assert len({j for j in got if j >= 0}) == sum(j >= 0 for j in got)


def test_names_break_ties():
    same = {0: 1, 1: 2}
    old = {"first_name": {"kind": "string", "sketch": same}, "last_name": {"kind": "string", "sketch": same}}
    new = {"LastName": {"kind": "string", "sketch": same}, "FirstName": {"kind": "string", "sketch": same}}
    assert set(compare(old, new)) == {("renamed", "first_name", "FirstName"), ("renamed", "last_name", "LastName")}
    assert name_likeness("Legal / Notes", "legal_notes") == 1.0


def test_hot_file_is_spread(spark):
    df = spark.range(20_000).selectExpr("id as line_id", "'f' as feed", "cast(if(id < 15000, 1, 2) as int) as file_no", "concat('{\"record_key\": \"', id % 15000, '\", \"', if(id < 15000, 'v', 'value'), '\": ', id % 15000, '}') as payload")
    assert changes(df) == {("f", 2, "renamed", "v", "value")}


def test_like_flags_are_no_rename(spark):
    keys = [f"k{i}" for i in range(60)]
    one = [record(k, smoker=True, code="a" if i % 2 else "b", kept=i) for i, k in enumerate(keys)]
    two = [record(k, insured=i >= 3, label="a" if i % 2 else "b", kept=i) for i, k in enumerate(keys)]
    assert changes(lines(spark, [("f", 1, one), ("f", 2, [*two, *two[:5]])])) == {("f", 2, "removed", "smoker", ""), ("f", 2, "added", "", "insured"), ("f", 2, "renamed", "code", "label")}
