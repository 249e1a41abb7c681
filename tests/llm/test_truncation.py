"""Problem 2: endings by hand, near-copies by alignment, and awkward input."""

from __future__ import annotations

import random

import pytest

from skarn.llm import truncation
from skarn.llm.endings import COMPLETE, CUT, DOUBT, ending, is_copy, stands_for_nothing

SCHEMA = "table_name string, row_key long, source string, path string, question string, text string, clash string"


@pytest.mark.parametrize(
    "text, path, state",
    [
        ("A whole sentence.", None, COMPLETE), ("Really?", None, COMPLETE), ("It ends in the mid", None, CUT), ("It goes on ...", None, CUT), ("so that the…", None, CUT),
        ('{"a": "b"\n... (truncated)', None, CUT), ("...", None, COMPLETE), ("N/A", None, COMPLETE), ("", None, COMPLETE), (None, None, COMPLETE), ("Yes", None, COMPLETE),
        ("Call `POST /rsv/v1/hou", None, CUT), ("GET /rsv/v1/houses/{houseKey}", "/rsv/v1/houses/{houseKey}", COMPLETE), ("x\nGET /rsv/v1/hou", "/rsv/v1/houses", CUT),
        ("GET /rsv/v1/houses", None, DOUBT), ("x\nBody:\n{\"a\": 1", None, CUT), ("x\nSample request body:\n{\"a\": [1, 2]}", None, COMPLETE), ("x\nSample request body:", None, CUT),
        ("x\nQuery parameters: a=HELD, b=NET", None, DOUBT), ("x\nQuery parameters: a=HELD, b", None, CUT), ("1. Do this.\n2.", None, CUT), ('It says "SHARED"', None, DOUBT),
        ("The charge is 470.", None, DOUBT), ("x" * 5000 + ".", None, COMPLETE),
    ],
)
def test_ending(text, path, state):
    assert ending(text, path)[0] == state


@pytest.mark.parametrize("text", [None, "", " \n", "​", "-", "--", "...", "n/a", "None", '""', "{}", "[no response]", "<empty>", "(none)"])
def test_stand_ins(text):
    assert stands_for_nothing(text)


@pytest.mark.parametrize("text", ["No.", "Yes.", "Twice.", "none of the rooms is free", "GET /x", "empty room"])
def test_short_answers_are_answers(text):
    assert not stands_for_nothing(text)


def test_copies():
    q = "Which call lets the cashier change the arrival date of a stay?"
    assert is_copy("which call lets the cashier change the arrival date of a stay", q) and not is_copy(q + " Use the stay call and then save the page before noon.", q)


def test_near_copies_and_terminality(spark):
    base = " ".join(f"word{n}" for n in range(60))
    calls = [("t", 100 + n, "s", None, None, "Use `GET /a/v1/stays/{stayKey}/notes` and go on with the next one now.") for n in range(40)]
    rows = calls + [
        ("t", 1, "s", None, None, "GET /a/v1/stays/{stayKey}"), ("t", 2, "s", None, None, "Send GET /a/v1/stays/{stayKey}/notes and more."),
        ("t", 3, "s", None, None, base + " wor"), ("t", 4, "s", None, None, base + " word60."), ("t", 5, "s", None, None, "GET /a/v1/stays/{stayKey}/notes"),
        ("t", 6, "s", None, None, "GET /a/v1/stays/{stayKey}/not"), ("t", 7, "s", None, None, None), ("t", 8, None, None, None, ""), ("t", 3, "s", None, None, base + " wor"),
        (None, None, None, None, None, None), ("t", 9, "s", None, "What is the date of arrival now", "what is the date of arrival now"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {}
    for r in truncation.cut_texts(df.where("table_name IS NOT NULL")).collect():
        got.setdefault(r.row_key, []).append((r.cut, r.found_by))
    assert got[3] == [(True, "alignment")] * 2 and got[6] == [(True, "ending")]
    assert all(got[k] == [(False, None)] for k in (2, 4, 5, 7, 8, 9))


def test_cut_copies_of_any_depth_are_found(spark):
    """Word-for-word copies cut at 90 to 10 per cent, of originals of one house style; near-copies that lost a tenth."""
    rng = random.Random(3)
    style = [f"style{n}" for n in range(10)]
    rows, want = [], {}
    for n in range(80):
        words = style[: n % 11] + [f"v{rng.randrange(400)}" for _ in range(60)]
        rows.append(("t", n, "s", None, None, " ".join(words) + "."))
        for k, share in enumerate((0.9, 0.7, 0.5, 0.3, 0.2)):
            cut = " ".join(words)[: int(len(" ".join(words)) * share)]
            rows.append(("t", 1000 * (k + 1) + n, "s", None, None, cut.rstrip() + rng.choice(["", " ...", "…"])))
            want[1000 * (k + 1) + n] = len(cut.split()) > truncation.STEP
        near = [w if rng.random() > 0.01 else "other" for w in words]
        rows.append(("t", 9000 + n, "s", None, None, " ".join(near[: int(len(near) * 0.95)])))
    found = {r.row_key: r.found_by for r in truncation.cut_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert all(found[k] == "alignment" for k, long_enough in want.items() if long_enough)
    assert all(found[n] is None for n in range(80))
    near = [found[9000 + n] == "alignment" for n in range(80)]
    assert sum(near) >= 0.9 * len(near)


def test_every_longer_near_copy_is_aligned(spark):
    """A copy of an original that is not the longest of its bands, under another first word."""
    common = [f"word{n}" for n in range(90)]
    rows = [("t", n, "s", None, None, " ".join([f"first{n}"] + common + [f"long{n}x{k}" for k in range(8)]) + ".") for n in range(40)]
    rows += [("t", 100 + n, "s", None, None, " ".join([f"other{n}"] + common + [f"own{n}x{k}" for k in range(6)]) + ".") for n in range(5)]
    rows += [("t", 200 + n, "s", None, None, " ".join([f"changed{n}"] + common + [f"own{n}x{k}" for k in range(4)])) for n in range(5)]
    got = {r.row_key: r.found_by for r in truncation.cut_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert all(got[200 + n] == "alignment" for n in range(5)) and not any(got[k] for k in got if k < 200)


def test_words_that_close_lines_do_not_cut(spark):
    rows = [("t", n, "s", None, None, f"Front desk checklist\nDo step {n} and the rest.") for n in range(20)]
    rows += [("t", 100, "s", None, None, "Night audit checklist"), ("t", 101, "s", None, None, "Do step seven and the")]
    got = {r.row_key: r.cut for r in truncation.cut_texts(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got[101] and not got[100]


def test_ends_early():
    words = [f"w{n}" for n in range(40)]
    whole = " ".join(words)
    assert truncation.ends_early(" ".join(words[:35]) + " w3", whole) and truncation.ends_early(" ".join(words[:36]) + " ...", whole)
    assert not truncation.ends_early(whole, whole) and not truncation.ends_early(" ".join(words[::-1][:35]), whole)


def test_signatures_find_near_copies():
    words = [f"w{n}" for n in range(100)]
    a, b, c, d = truncation.signatures([words, words[:92], [f"x{n}" for n in range(100)], ["short"]], truncation._WordHashes())
    assert sum(x == y for x, y in zip(a, b, strict=True)) >= 1 and not set(a) & set(c) and d is None


def test_empty_table(spark):
    assert truncation.cut_texts(spark.createDataFrame([], SCHEMA)).count() == 0
