import pytest

from quire.llm.mixture import DEFAULT_TOKENIZER, count_tokens, draw_mixture, plan_budgets, source_key


def test_spellings(spark):
    df = spark.createDataFrame([("Intake Scan",), ("intake-scan ",), ("INTAKE_SCAN",), ("",), (None,), (" - ",)], "s string")
    assert [r.k for r in df.select(source_key("s").alias("k")).collect()] == ["intake_scan"] * 3 + [None] * 3


def docs(spark, spec):
    rows = [(n * 10_000 + i, s, t) for n, (s, k, t) in enumerate(spec) for i in range(k)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_and_caps(spark):
    d = docs(spark, [("Big", 3000, 10), ("small", 100, 10), ("mid", 500, 7), ("other", 50, 9), (None, 5, 5)])
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 4), ("mid", 0.29, 2), ("none", 0.01, 3)], TARGETS)
    sel, rep = draw_mixture(d, t)
    got = {r.source: r for r in rep.collect()}
    for s, share in (("big", 0.5), ("small", 0.2), ("mid", 0.29)):
        assert got[s].actual_share == pytest.approx(share / 0.99, abs=0.005)
        assert got[s].copies_max <= got[s].max_repeats
    assert got["none"].is_short and got["none"].tokens_selected == 0 and "other" not in got
    rows = sel.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small", "mid"}
    assert sorted(map(tuple, draw_mixture(d, t)[0].collect())) == sorted(map(tuple, rows))  # the draw is repeatable


def test_given_size_and_short_sources(spark):
    d = docs(spark, [("a", 1000, 10), ("b", 10, 10)])
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2)], TARGETS)
    got = {r.source: r for r in draw_mixture(d, t, total_tokens=5000)[1].collect()}
    assert got["b"].tokens_selected == 200 and got["b"].is_short and got["a"].tokens_selected == 4800


def test_hot_source_is_binned(spark):
    d = docs(spark, [("hot", 20_000, 3), ("b", 5000, 3)])
    sel, rep = draw_mixture(d, spark.createDataFrame([("hot", 0.5, 1), ("b", 0.5, 2)], TARGETS))
    got = {r.source: r.actual_share for r in rep.collect()}
    assert got["hot"] == pytest.approx(0.5, abs=0.001)


def test_empty_and_ties(spark):
    t = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    none = docs(spark, [("a", 1, 1)]).limit(0)
    sel, rep = draw_mixture(none, t)
    assert sel.count() == 0 and rep.first().actual_share is None
    same = spark.createDataFrame([(7, "a", 5)] * 4 + [(8, "a", None), (9, "a", 0)], "doc_id long, source string, tokens long")
    assert draw_mixture(same, t)[1].first().tokens_selected == 40


def test_plan_keeps_proportions():
    facts = [{"source": s, "share": sh, "cap": c, "available": a, "documents": 1} for s, sh, c, a in (("a", 0.6, 1, 100), ("b", 0.3, 1, 1000), ("c", 0.1, 1, 1000))]
    b = {p["source"]: p["budget"] for p in plan_budgets(facts)}
    assert b["a"] == pytest.approx(100, rel=0.02) and b["b"] / b["c"] == pytest.approx(3)
    assert all(p["budget"] <= p["available"] * p["cap"] for p in plan_budgets(facts, 10**9))


def test_tokens(spark):
    import os

    if not os.path.exists(DEFAULT_TOKENIZER):
        pytest.skip("no tokenizer here")
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (4, "a b " * 50_000)], "id long, text string")
    got = {r.id: r.tokens for r in count_tokens(df, "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] >= 100_000
