import random

import numpy as np
import pytest

from quire.llm.residue import FIELD_NAMES, ResidueModel, best_runs, fields_of, passages, score_residue, trusted, units

CLEAN = [
    "The patient reports knee pain for two weeks.", "Scripts for the tablet are required every month.", "Left side {larger} than the right [sic], lesion <5 mm.", "Units [7] of saline were given.",
    "The surgical template was measured at 40 mm.", "Blood pressure was 120/80 mmHg.", "CPT 99213, balance 42.00", "A medication error was reported and corrected.", "None recorded", "The patient uses a browser magnifier.",
    "The page was not found in the archive box.", "Follow-up in 6 weeks.", "Gait is steady and heel walking is possible.",
]


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    latin = [" ".join(rng.choices(["sapien", "dolor", "magna", "mattis", "tempor", "ipsum", "nulla", "libero", "ornare", "vitae", "fusce", "porta", "velum"], k=9)) for _ in range(60)]
    return ResidueModel.fit([(p, 800) for p in CLEAN] + [("Please enable JavaScript to open the portal.", 3)] + [(p, 1) for p in latin])


@pytest.mark.parametrize("text", ["Patient {{ visit_date }} was seen.", "Amount due: [INSERT INSURER HERE]", "${amount_due}", "__DOB__", "%(reason)s", "<% facility %>", "Please enable JavaScript to view this report.", "502 Bad Gateway", "Lorem ipsum dolor sit amet", "Your text goes here.", "CPT 97160, balance 47.00 Amount due: {{amount_due}}"])
def test_residue_is_found(model, text):
    assert max(model.score(p) for p in passages(text)) >= 0


@pytest.mark.parametrize("text", CLEAN)
def test_ordinary_text_is_not(model, text):
    assert max(model.score(p) for p in passages(text)) < 0


def test_every_notation_and_name(model):
    missed = [f for name in FIELD_NAMES for f in (f"{{{{{name}}}}}", f"[[{name}]]", f"<<{name}>>", f"@@{name}@@") if model.score(f) < 0]
    assert not missed


def test_em_learns_unseen_filler_from_company(model):
    assert "velum" not in " ".join(trusted()) and model.score("velum velum velum velum velum") >= 0


def test_parts():
    odds = np.array([-1.5, 3, 4.5, -4.5, 6, 0])  # two thirds count, from -3 to 8
    runs = best_runs(odds, np.array([0, 1, 2, 3, 4, 0, 4, 0, 4]), np.ones(9, int), np.array([5, 0, 1, 1, 0, 2, 0]))
    assert runs.tolist() == [6, 0, 0, 4, 0, 4, 0] and best_runs(odds, np.array([], int), np.array([], int), np.zeros(2, int)).tolist() == [0, 0]
    assert units("") == [] and passages("") == []


def test_operator(spark, model):
    long = "The patient reports knee pain. " * 3000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (4, "The wound is clean.\nPlease enable JavaScript to view this report.", "x"), (5, long, "x"), (6, "Lorem ipsum dolor sit amet", "x"), (6, "Lorem ipsum dolor sit amet", "x")], "id long, content string, text string")
    values = fields_of(df, "t", "id", ["content"])
    got = [(r.record_id, r.is_residue, r.clean_text) for r in score_residue(values, model).collect()]
    assert sorted(got, key=str) == sorted([(4, True, "The wound is clean."), (5, False, long), (6, True, None), (6, True, None)], key=str)
    assert score_residue(values.limit(0)).count() == 0
