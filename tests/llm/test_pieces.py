"""Problem 6: exact round trip and limits for any text, kinds of cut by hand."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import packing, pieces


def check(text, limit, overlap):
    out = pieces.split_text(text, limit, overlap)
    assert "".join(text[s + lead : e] for s, e, lead, _ in out) == text
    assert all(e - s <= limit for s, e, *_ in out)
    for (s0, e0, *_), (s, e, lead, _) in zip(out, out[1:], strict=False):
        assert s + lead == e0 and 0 <= lead <= overlap and s > s0 and e > e0
    return out


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("ab .\n\r!\t "), max_size=400), st.integers(11, 60), st.integers(0, 10))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


@pytest.mark.parametrize(
    "text, cut",
    [("a" * 60 + "\n\n" + "b" * 90, "blank_line"), ("a" * 60 + "\n" + "b" * 90, "line_end"), ("a" * 60 + ". " + "b" * 90, "sentence_end"), ("a" * 60 + " " + "b" * 90, "space"), ("a" * 300, "hard"),
     ("a" * 60 + "\r\n\r\n" + "b" * 90, "blank_line")],
)
def test_best_boundary(text, cut):
    assert check(text, 100, 20)[0][3] == cut


def test_overlap_starts_at_a_word():
    text = " ".join(["word"] * 100)
    out = check(text, 100, 22)
    assert all(text[s - 1] == " " and 15 <= lead <= 22 for s, _, lead, _ in out[1:])


@settings(deadline=None, max_examples=150)
@given(st.text(st.sampled_from("aaaaaaaaab \n."), max_size=300), st.integers(11, 40), st.integers(0, 10))
def test_hard_cuts_only_in_long_stretches(text, limit, overlap):
    if len(text) > limit:
        longest = max(map(len, text.split()), default=0)
        assert any(cut == "hard" for *_, cut in check(text, limit, overlap)) == (longest > limit)


@settings(deadline=None, max_examples=80)
@given(st.text(st.sampled_from("ab .\n\t "), max_size=200), st.integers(4, 20), st.integers(0, 3), st.randoms())
def test_limit_by_weights(text, limit, overlap, rng):
    weights = np.array([rng.choice([0, 1, 1, 2]) for _ in text], dtype=np.int64)
    out = pieces.split_text(text, limit, overlap, weights=weights)
    assert "".join(text[s + lead : e] for s, e, lead, _ in out) == text
    assert all(weights[s:e].sum() <= limit for s, e, *_ in out) and all(weights[s : s + lead].sum() <= overlap for s, _, lead, _ in out)


def test_overlap_gives_way_to_heavy_characters():
    weights = np.array([2, 1] * 9)
    out = pieces.split_text("a" * 18, 4, 3, weights=weights)
    assert all(weights[s:e].sum() <= 4 for s, e, *_ in out) and "".join("a" * (e - s - lead) for s, e, lead, _ in out) == "a" * 18
    heavy = np.array([1, 9, 1, 1, 1, 1])
    assert any(e - s == 1 and heavy[s] == 9 for s, e, *_ in pieces.split_text("a" * 6, 4, 3, weights=heavy))


def test_limit_in_tokens():
    text = "The guest asks for a late check-out. " * 80
    weigh = pieces.token_weights(packing.TOKENIZER)
    out = pieces.split_text(text, 64, 8, weights=weigh(text))
    assert len(out) > 8 and all(weigh(text)[s:e].sum() <= 64 for s, e, *_ in out) and {cut for *_, cut in out[:-1]} == {"sentence_end"}


def test_operator(spark):
    rows = [(1, "short", "x"), (2, None, "x"), (3, "", "x"), (4, "a" * 50, "x"), (5, "word " * 20, "x"), (5, "word " * 20, "x"), (6, "x" * 40, "x"), (7, "y" * 2_000_00, "x")]
    df = spark.createDataFrame(rows, "row_no long, text string, kind string")
    got = pieces.split_pieces({"t": df, "u": df.where("row_no < 4")}, {"t": 40, "u": 4}, overlap=3).cache()
    found = sorted((r.table_name, r.row_no, r.kind) for r in pieces.oversized(got).collect())
    assert found == [("t", 4, "forced"), ("t", 5, "boundary"), ("t", 5, "boundary"), ("t", 7, "forced"), ("u", 1, "forced")]
    assert {r.row_no for r in got.where("table_name = 't'").collect()} == {1, 3, 4, 5, 6, 7}
    assert got.where("length(piece) > 40").count() == 0


def test_empty(spark):
    assert pieces.split_pieces({"t": spark.createDataFrame([], "row_no long, text string")}, {"t": 40}, overlap=3).count() == 0
