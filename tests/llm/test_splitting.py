import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import splitting as sp


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\r\t#。é🙂", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    pieces = sp.split_text(text, limit, overlap)
    assert "".join(text[a:b] for a, b, _ in pieces) == text
    assert all(b - a + r <= limit and r <= overlap for a, b, r in pieces)
    assert all(x[1] == y[0] for x, y in zip(pieces, pieces[1:])) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    assert (len(pieces) > 1) == (len(text) > limit)


def test_cuts_at_paragraphs():
    text = "one two three.\n\n" * 30
    pieces = sp.split_text(text, 100, 20)
    assert all(text[:b].endswith("\n\n") for _, b, _ in pieces)


def test_long_run_and_bad_limits():
    assert all(b - a + r <= 100 for a, b, r in sp.split_text("x" * 100_000, 100, 30))
    with pytest.raises(ValueError):
        sp.split_text("x", 10, 10)


def test_items(spark):
    big = "line of text\n" * 300
    e = spark.createDataFrame([(1, big, "k0"), (1, big, "k0"), (2, "short", "x"), (3, None, None), (4, "", ""), (5, "é" * 3001, "y")], "id long, content string, piece string")
    m = spark.createDataFrame([(1, 1, None, None), (1, 1, None, None), (2, 1, 5, 9), (3, 1, 1, 10_000), (4, 9, 1, 2), (5, 1, 9, 5), (None, None, None, None)], "id long, file_id long, start_line int, end_line int")
    c = spark.createDataFrame([(1, big), (1, big), (2, None), (None, "x")], "file_id long, content string")
    got = {(r.item_kind, r.item_id) for r in sp.oversized(e, m, c).collect()}
    assert got == {("embedding", 1), ("embedding", 5), ("module", 1), ("module", 3)}
    rows = sp.pieces(e, m, c).filter("item_kind = 'embedding' and item_id = 1").orderBy("piece_no").collect()
    assert "".join(r.piece[r.overlap :] for r in rows) == big and max(len(r.piece) for r in rows) <= 3000
    texts = {r.item_id: r.text for r in sp.module_texts(m, c).collect()}
    assert texts[2] == "\n".join(["line of text"] * 5) and texts[5] == ""


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, content string")
    m = spark.createDataFrame([], "id long, file_id long, start_line int, end_line int")
    c = spark.createDataFrame([], "file_id long, content string")
    assert sp.oversized(e, m, c).count() == 0 and sp.pieces(e, m, c).count() == 0


def test_a_paragraph_that_fits_is_not_cut():
    first, second = "a" * 40 + ". " + "b" * 263 + "\n\n", "word " * 563 + "\n\n"
    text = first + second + "end. " * 200
    assert 2700 < len(second) < 3000
    pieces = sp.split_text(text)
    assert [b for _, b, _ in pieces][:2] == [len(first), len(first + second)] and all(b - a + r <= 3000 for a, b, r in pieces)
    assert pieces[1][2] <= 3000 - len(second)
