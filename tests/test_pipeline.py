import random

import pytest
from pyspark.sql import functions as F

from quire.functions import mentions as N
from quire.operators import evidence, pipeline


def test_mentions(spark):
    df = spark.createDataFrame(
        [("Dr. Maria Ortega", "Ibuprofen 200 mg daily", "Electronically signed\nJohn Smith, MD\nfiller words\nDr. Ann Lee"), ("Provider at office", "follow up appointment 5 mg", ""), (None, None, None), ("X" * 200, "word " * 30 + "5 mg", "plain text here")], "p string, m string, s string"
    )
    rows = df.select(N.is_provider_name("p").alias("p"), N.is_medication_line("m").alias("m"), N.signature_names("s").alias("s")).collect()
    assert [(r.p, r.m) for r in rows] == [(True, True), (False, False), (None, None), (False, False)]
    assert any("Smith" in n and n.endswith("M.D.") for n in rows[0].s) and any(n.startswith("Dr.") and "Ann Lee" in n for n in rows[0].s) and rows[1].s == [] and rows[3].s == []


def test_errors_and_fragments(spark):
    df = spark.createDataFrame([(503, "x", "Traceback (most recent call last):\n  File \"a.py\", line 1\n    secret()\nValueError: secret text", ["one goes", "on here.", "Next", "one"], ["Yes.", "The pain is back.", "No"])], "s int, m string, t string, f array<string>, c array<string>")
    r = df.select(
        N.is_retryable(F.col("s"), F.col("m")).alias("a"), N.is_retryable(F.lit(None).cast("int"), F.lit("page limit, internal")).alias("b"), N.safe_trace("t").alias("t"), N.merged_fragments(F.col("f")).alias("f"), N.joined_short_sentences(F.col("c")).alias("c"),
        N.recognition_route(F.lit(10), F.lit(5)).alias("r"), N.bounded("m", 5).alias("x"), N.prompt(F.lit(None).cast("string"), F.lit(50)).alias("p"),
    ).first()
    assert r.a and not r.b and "secret text" not in r.t and r.t.endswith("ValueError") and r.f == ["one goes on here.", "Next one"] and r.c == ["Yes The pain is back. No"] and r.r == "sync" and r.x == "x" and "50 words" in r.p


DOCS = [
    (1, "Reason for visit: follow up.\nThe patient reports knee pain after a fall. The plan is rest and a review in two weeks. Takes ibuprofen 200 mg daily. BP 120/80, pulse 70.\nElectronically signed\nJohn Smith, MD", "c"),
    (2, "", "c"), (3, None, "c"), (4, "Diagnoses:\nknee pain\n" + "The patient walks well and sleeps well at night. " * 400, "c"),
]


def test_summaries(spark):
    df = spark.createDataFrame(DOCS, "id int, text string, overview string")
    got = {r.id: r for r in pipeline.summarise(df, "id", "text", mask=True).collect()}
    assert set(got) == {1, 4} and got[4].chunks > 1 and got[1].chunks == 1
    assert "- The plan is rest and a review in two weeks." in got[1].summary and "BP 120/80" in got[1].vitals and 1 <= len(got[4].details) <= 12
    assert [s.slug for s in got[1].sections][:2] == ["provider_seen", "reason_for_visit"]
    routes = {r.id: r.strategy for r in pipeline.routed(df, "id", "text").collect()}
    assert set(routes) == {1, 4}


def test_contracts(spark):
    df = spark.createDataFrame(DOCS, "id int, text string, extra string").filter("text <> ''")
    src = spark.createDataFrame([(4, 1, 3, "mild knee pain today"), (1, 1, 1, None)], "id int, source_no int, page int, text string")
    got = {r.id: r for r in pipeline.contract(df, src, "id", "text").collect()}
    assert got[4].claims[0].statement == "knee pain" and got[4].claims[0].page == 3 and got[4].notice is None
    assert got[1].claims is None and got[1].notice == "evidence_unavailable" and got[1].sections[0].slug == "summary"


def test_contract_of_every_summary(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(1, "a", "Diagnoses:\nknee pain\nback pain"), (2, "a", "Diagnoses:\nhip pain"), (3, "b", "Plan is rest."), (4, "b", None), (5, None, "Walks well.")]
    spark.createDataFrame(rows, "summary_id long, job_id string, medical_summary string").write.parquet(f"{tmp_path}/test_summaries.parquet")
    spans = [(7, "a", 1, "mild knee pain"), (8, "a", 2, "hip pain today"), (9, "c", 3, "rest")]
    spark.createDataFrame(spans, "span_key long, job_id string, page int, text_snippet string").write.parquet(f"{tmp_path}/evidence_spans.parquet")
    got = {r.summary_id: r for r in entry.queries()["summary_contracts"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 5] and {i: r.job_id for i, r in got.items()} == {1: "a", 2: "a", 3: "b", 5: None}
    assert [(c.statement, c.page, c.claim_no) for c in got[1].claims] == [("knee pain", 1, 1), ("back pain", 1, 2)]
    assert [(c.statement, c.page, c.claim_no) for c in got[2].claims] == [("hip pain", 2, 1)]
    assert got[3].claims is None and got[3].notice == "evidence_unavailable" and got[5].notice == "evidence_unavailable" and got[1].notice is None


@pytest.mark.parametrize("exact", [False, True])
def test_shared_sources_as_own_sources(spark, monkeypatch, exact):
    monkeypatch.setattr(evidence, "BLOCK", 5)
    rng = random.Random(8)
    word = lambda: rng.choice(("Pain", "knee", "the", "hip-joint", "İm", "don't", "a", "5", "rest", "…", "walks"))
    text = lambda n: " ".join(word() for _ in range(rng.randint(1, n)))
    docs = [(i, "xyz"[i % 3], s, f"s{s}", "T", "\n".join(text(5) for _ in range(3)), "mcc") for i in range(25) for s in (1, 2)]
    long = " ".join(f"w{i}" for i in range(25))
    docs.append((99, "x", 1, "s1", "T", long + " z", "mcc"))
    sections = spark.createDataFrame(docs, "id int, job string, ordinal int, slug string, title string, content string, kind string")
    sources = spark.createDataFrame([("xyz"[i % 3], i, i, rng.choice((None, "", text(9), text(9), text(9), long))) for i in range(60)], "job string, source_no long, page int, text string")
    own = sections.select("id", "job").distinct().join(sources, "job").drop("job")
    want = evidence.claims(evidence.statements(sections.drop("job"), ["id"]), own, ["id"], prefer_exact=exact)
    got = evidence.claims(evidence.statements(sections, ["id", "job"]), sources, ["id"], prefer_exact=exact, by=["job"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and got.count() > 100
