import itertools
import random

import pytest

from quire.llm.pii import SemiMarkov, _marginals, default_model, redact, redact_pii, segments, training_sentences


@pytest.fixture(scope="module")
def model():
    return default_model()


def test_held_out_sentences(model):
    hit = wrong = missed = 0
    for text, gold in training_sentences(600, seed=123):
        found, want = set(model.decode(text)), set(gold)
        hit, wrong, missed = hit + len(found & want), wrong + len(found - want), missed + len(want - found)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.95


def test_redaction(model):
    text = "Patient Maria Ortega, born 02/03/1970, MRN 6295338.\nCall (219) 555-0199 or mail maria.o@inbox.example. Lives at 474 Harbor Ave., Osmark 94933. Device serial 21A-4995 was checked at Alder Ridge Clinic on 05/06/2024."
    clean, kinds = redact(text, model)
    assert kinds == ["address", "email", "id_number", "name", "phone"]
    assert "02/03/1970" in clean and "21A-4995" in clean and "Alder Ridge Clinic" in clean and "05/06/2024" in clean
    for secret in ("Ortega", "6295338", "555-0199", "inbox", "Harbor"):
        assert secret not in clean


@pytest.mark.parametrize(
    "text, names",
    [
        ("The form was completed by Maria de la Cruz Hernandez y Gonzalez.", ["Maria", "Cruz", "Hernandez", "Gonzalez"]),
        ("Emergency contact is Pieter van der Walstenberg.", ["Pieter", "Walstenberg"]),
        ("Home address is 474 Upper Brandelworth View Avenue, Apt 17, Hawthornequist 94933-1200. Patient Juan Carlos Luis Fernandorth Ortegalez was seen.", ["474", "Hawthornequist", "Juan", "Ortegalez"]),
        ("PATIENT: MARIA ORTEGASON. EMERGENCY CONTACT IS PETER DALBERG (SISTER).", ["ORTEGASON", "DALBERG"]),
    ],
)
def test_long_names_and_capitals(model, text, names):
    clean, _ = redact(text, model)
    assert not [n for n in names if n in clean], clean


@pytest.mark.parametrize("text", ["Specimen 8720-24 was received in good condition.", "Accession 4492572001 was closed after the study.", "Infusion pump 635-13-5592 passed its yearly check.", "ICD-10 J45.9 and CPT 99213.", "Score on the Corvane scale was 48.", "09/17/2024 04:51", "a1b2c3d4e5f6 0f1e2d3c4b5a69788796a5b4c3d2e1f0"])
def test_other_numbers_stay(model, text):
    assert redact(text, model) == (text, [])


def brute(found, scores):
    best, z, count = 0.0, 0.0, [0.0] * len(found)
    import math

    for n in range(len(found) + 1):
        for combo in itertools.combinations(range(len(found)), n):
            spans = sorted((found[i][1], found[i][0]) for i in combo)
            if all(a[1] <= b[0] for a, b in zip(spans, spans[1:])):
                s = sum(scores[i] for i in combo)
                best, z = max(best, s), z + math.exp(s)
                for i in combo:
                    count[i] += math.exp(s)
    return best, [c / z for c in count]


def test_dynamic_programming_against_brute_force():
    rng = random.Random(4)
    for _ in range(80):
        found = sorted({(lo + rng.randint(1, 6), lo, rng.choice("ab")) for lo in (rng.randrange(12) for _ in range(rng.randint(1, 7)))})
        scores = [rng.uniform(-2, 3) for _ in found]
        best, marginals = brute(found, scores)
        assert _marginals(found, scores) == pytest.approx(marginals, abs=1e-9)
        table = {(lo, hi, k): s for (hi, lo, k), s in zip(found, scores)}
        m = SemiMarkov({})
        m.score = lambda text, lo, hi, kind, t=table: t[lo, hi, kind]
        import quire.llm.pii as pii

        keep, pii.segments = pii.segments, lambda text, t=table: list(t)
        try:
            chosen = m.decode("x" * 30)
        finally:
            pii.segments = keep
        assert sum(table[c] for c in chosen) == pytest.approx(best)
        assert all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:]))


def test_edges(spark, model):
    long = "No change in the routine. " * 4000 + "Emergency contact is Maria Ortega (sister)."
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, " \n", "z"), (4, long, "z"), (5, "plain", "z"), (5, "plain", "z")], "id long, t string, clean_text string")
    got = sorted((r.id, r.pii_types, r.clean_text[-30:]) for r in redact_pii(df.select("id", "t"), "t", ["id"], model).collect())
    assert got == [(4, ["name"], "ncy contact is [NAME] (sister)."[-30:]), (5, [], "plain"), (5, [], "plain")]
    assert redact_pii(df.select("id", "t").limit(0), "t", ["id"], model).count() == 0
    assert segments("") == [] and model.decode("A" * 500) == []
    assert redact("JONAS LASK\n" * 3, model)[0] is not None


@pytest.mark.parametrize(
    "text, name",
    [
        ("Lives at 474 Ninth Orchard St, Elverton. Patient Tomas Quelsley, born 03/16/2001.", "Tomas Quelsley"),
        ("Referred by Rosa Tannery, MD.\nOld Mill Lane Family Practice. Osmark. Patient Maria J. Tarroarro was seen.", "Maria J. Tarroarro"),
        ("PATIENT MARIA ORTEGA, BORN IN OSMARK, WAS SEEN TODAY.", "MARIA ORTEGA"),
    ],
)
def test_names_in_long_runs(model, text, name):
    lo = text.index(name)
    assert (lo, lo + len(name), "name") in segments(text)
    assert name not in redact(text, model)[0]


def test_runs_of_any_length(model):
    words = [f"W{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(3000)]
    text = " ".join(words)
    found = {text[lo:hi] for lo, hi, kind in segments(text) if kind == "name"}
    assert all(f"{a} {b}" in found for a, b in zip(words, words[1:]))
