from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm.splitting import page_starts, split_oversized, split_text

TEXT = st.lists(st.sampled_from(["word ", "Sentence ends. ", "\n", "\n\n", "\f", "x" * 90, "é́", "- item\n", ", "]), max_size=700).map("".join)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_round_trip_limits_and_overlap(text):
    pieces = split_text(text, 400, (20, 40))
    assert "".join(text[body:end] for _, body, end in pieces) == text
    for i, (lo, body, hi) in enumerate(pieces):
        assert hi - lo <= 400
        assert body - lo == 0 if i == 0 else 20 <= body - lo <= 40
        assert i == 0 or body == pieces[i - 1][2]


def test_cuts_at_boundaries():
    text = ("A sentence of some words. " * 12 + "\n\n") * 40
    for lo, body, hi in split_text(text)[1:]:
        assert text[body - 2 : body] == "\n\n"
        assert text[lo - 1] in " \n"


def test_no_boundaries():
    pieces = split_text("x" * 10_001)
    assert max(h - l for l, _, h in pieces) <= 4000 and all(100 <= b - l <= 200 for l, b, _ in pieces[1:])


def test_pages():
    assert page_starts("a\fbb\fc", 3, 5) == [0, 2, 5] and page_starts("a\n\nb", 1, 2) == [0, 3] and page_starts("abc", 1, 2) is None and page_starts("abc", 4, 4) == [0] and page_starts("a", None, 2) is None


def test_operator(spark):
    pages = "\f".join(["word " * 300] * 6)
    df = spark.createDataFrame([(1, None, None, "c"), (2, "", None, "c"), (3, "x" * 4000, None, "c"), (4, pages, (3, 8), "c"), (5, "y" * 4001, (1, 9), "c"), (5, "y" * 4001, (1, 9), "c"), (6, "a b. " * 60_000, (7, 7), "c")], "id long, text string, pr struct<start:int,end:int>, piece string")
    out = split_oversized(df, "id", "text", "pr").collect()
    assert {r.id for r in out} == {4, 5, 6} and max(len(r.piece) for r in out) <= 4000
    four = sorted((r for r in out if r.id == 4), key=lambda r: r.piece_no)
    assert four[0].first_page == 3 and four[-1].last_page == 8 and all(a.last_page in (b.first_page, b.first_page - 1) for a, b in zip(four, four[1:]))
    assert {(r.first_page, r.last_page) for r in out if r.id == 5} == {(None, None)} and {(r.first_page, r.last_page) for r in out if r.id == 6} == {(7, 7)}
    assert "".join(r.piece[r.body_char - r.start_char :] for r in sorted((r for r in out if r.id == 6), key=lambda r: r.piece_no)) == "a b. " * 60_000
    assert split_oversized(df.limit(0), "id", "text").count() == 0
