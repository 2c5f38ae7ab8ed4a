import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.llm.pieces import EDGE, split_oversized, split_text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n!?x𝛼é", max_size=600), st.integers(5, 80), st.integers(0, 30))
def test_pieces_cover_the_text_within_the_limit(text, limit, overlap):
    text = text.strip(EDGE)
    spans = split_text(text, limit, overlap)
    assert [s[1] for s in spans] == [0, *[s[2] for s in spans[:-1]]] and spans[-1][2] == len(text)
    for k, (start, core, end) in enumerate(spans):
        assert len(text[start:end].rstrip(EDGE)) <= limit
        assert start <= core and (k == 0) <= (start == 0)
        if k:
            assert start >= spans[k - 1][1]


def test_cuts_fall_on_the_strongest_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    spans = split_text(text, 40, 0)
    assert [text[a:b].strip() for _, a, b in spans] == ["One two three. Four five six.", "Seven eight nine. Ten eleven."]


def test_overlap_is_about_as_long_as_wanted():
    text = " ".join(f"word{k:03}" for k in range(200))
    spans = split_text(text, 200, 40)
    assert all(20 <= core - start <= 60 for start, core, _ in spans[1:])


def test_a_word_longer_than_the_limit():
    assert all(b - a <= 10 for _, a, b in split_text("x" * 35, 10, 0))


def test_long_text():
    text = "A sentence of some words. " * 20_000
    assert len(split_text(text.strip(), 1000, 80)) > 500


def test_no_limit():
    with pytest.raises(ValueError):
        split_text("abc", 0, 0)


def test_operator(spark):
    limits = spark.createDataFrame([(0, "A", 20, 5), (5, "O", 10, 2)], "section_category int, section_name string, max_chars int, overlap_chars int")
    rows = [
        (1, " \n" + "a" * 20 + "\t", 0, "T", "P"), (2, "b b b b b b b b", None, "T", None), (3, "c c c c c c c c", 9, None, "P"), (4, None, 0, "T", "P"), (5, "", 0, "T", "P"),
        (6, "d" * 10, 5, "T", "P"), (6, "e e e e e e", 5, "T", "P"), (None, "f f f f f f f", 5, "T", "P"),
    ]
    chunks = spark.createDataFrame(rows, "id long, chunk_text string, section_category int, section_title string, parent_section string").selectExpr("*", "1 as _text", "2 as piece", "3 as max_chars")
    got = split_oversized(chunks, limits).collect()
    assert sorted({r.id for r in got if r.id}) == [2, 3, 6]
    assert any(r.id is None for r in got)
    two = sorted((r.piece, r.piece_text) for r in got if r.id == 2)
    assert all(len(t) <= 10 for _, t in two) and {r.pieces for r in got if r.id == 2} == {len(two)}
    assert {(r.section_title, r.parent_section) for r in got if r.id == 3} == {(None, "P")}
    assert split_oversized(chunks.limit(0), limits).count() == 0
    assert split_oversized(chunks, limits.limit(0)).count() == 0
