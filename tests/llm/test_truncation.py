import random

import pytest

from quire.llm.truncation import FEATURES, _slot, examples, examples_of, features, fit, score_truncation, truncation_rates

PARTS = ["The patient reports pain in the {} for {} weeks.", "Blood pressure was {} over {} today.", "The {} will be repeated in {} days unless it settles earlier.", "Follow-up in {} weeks to review the {} and daily exercise.", "The wound on the {} measures {} mm and the edges are clean."]
CLOSERS = ["", "", "", "\n\nEnd of note", "\n\nRef. 1234-56", "\n\n- rest\n- daily exercise", "\n\nElectronically signed\nJane Doe, MD"]


def note(rng):
    body = " ".join(rng.choice(PARTS).format(rng.choice(("left knee", "right heel", "neck", "lower back")), rng.randrange(2, 90)) for _ in range(rng.randint(4, 12)))
    return body + rng.choice(CLOSERS)


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(1)
    return fit(*examples([note(rng) for _ in range(800)]))


def test_held_out_cuts(weights):
    rng = random.Random(99)
    xs, ys = examples([note(rng) for _ in range(200)], seed=3)
    right = [(sum(weights[f] for f in x) > 0) == bool(y) for x, y in zip(xs, ys)]
    assert sum(right) / len(right) > 0.95


def test_length_at_a_limit_says_something():
    rng = random.Random(4)
    made = [examples_of(note(rng) + " " + note(rng), rng, [(300, 64.0), (200, 20.0)]) for _ in range(400)]
    w = fit([x for xs, _ in made for x in xs], [y for _, ys in made for y in ys])
    tail = "The patient reports pain in the left knee for 5 weeks"
    assert w[features(tail, False, 64.0)].sum() > w[features(tail, False)].sum() + 1
    assert w[features(tail + ".", False, 64.0)].sum() < 0


def test_marks_and_ends(weights):
    score = lambda t: float(weights[features(t, True)].sum())
    assert score("The patient reports pain in the left kn") > 0 > score("Blood pressure was 12 over 80 today")
    assert score("Blood pressure was 12 over 80 today.\n\nRef. 9999-11") < 0 < score("The wound on the neck meas…")
    assert features("", True) and features("…", True)


def test_operator(spark):
    rng = random.Random(5)
    rows = [(i, note(rng), "src") for i in range(400)]
    cut = [(1000 + i, (note(rng) * 2)[:500], "Cut-Off") for i in range(60)]
    cut = [r for r in cut if not r[1].rstrip().endswith((".", "note", "exercise", "MD"))]
    odd = [(2000, None, "src"), (2001, "", "src"), (2002, " \n", None), (2003, note(rng) * 500, None), (2004, "Fine.", None), (2004, "Fine.", None)]
    df = spark.createDataFrame(rows + cut + odd, "doc_id long, text string, source string").selectExpr("*", "1 as score")
    got = {r.doc_id: r for r in score_truncation(df).collect()}
    assert not {2000, 2001, 2002} & set(got) and not got[2004].truncated
    found = {i for i, r in got.items() if r.truncated}
    want = {r[0] for r in cut}
    assert len(found & want) / len(want) > 0.95 and len(found - want) < 8
    rates = {r.source: r for r in truncation_rates(score_truncation(df)).collect()}
    assert rates["cut_off"].share > 0.9 and rates["src"].share < 0.05
    assert score_truncation(df.limit(0)).count() == 0


def test_untrained_model():
    assert fit([], [])[_slot("mark")] > 0 and len(fit([], [])) == FEATURES
