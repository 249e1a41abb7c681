"""Problem 4: held-out accuracy on synthetic defects, and hand-made pairs no training text resembles."""

from __future__ import annotations

import re
import sys
import unicodedata

import duckdb
import numpy as np
import pytest

from skarn.llm import chars, defects, endings
from skarn.llm.endings import is_copy
from skarn.llm.language import CODE, language_words

EVAL = "/root/testdata/sf0.01/eval_results.parquet"
Q = "Which call lets the cashier change the arrival date of the stay at Hotel North?"


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"SELECT question, generated_answer FROM '{EVAL}' WHERE question IS NOT NULL AND generated_answer IS NOT NULL ORDER BY result_id").fetchall()


@pytest.fixture(scope="module")
def model(rows):
    return defects.train(rows[:2000])


def label(model, question, answer):
    flat, sizes, dense, _ = defects.Features(model.profiles, model.trade)([question], [answer])
    n = model.labels(model.scores(flat, sizes, dense), np.array([bool(question)]))[0]
    return defects.LABELS[n] if n >= 0 else None


@pytest.mark.parametrize(
    "question, answer, defect",
    [
        (Q, None, "empty"), (None, "n/a", "empty"), (Q, "​", "empty"), (Q, "Q: " + Q + "\nA:", "copied_question"), (Q, Q.lower().replace("cashier", "cahsier"), "copied_question"),
        (Q, Q + "\n" + Q, "copied_question"),
        (Q, "I'm sorry, but I can't help with that request. Please contact your support desk.", "refusal"), (None, "I must decline to answer this.", "refusal"),
        (Q, "I'm going to pass on this one.", "refusal"), (Q, "I would sooner not get into that, sorry.", "refusal"),
        (Q, "I am sorry for the confusion above: the right call is `GET /rsv/v1/stays`, sent by the cashier.", None), (Q, "Yes.", None),
        (Q, "You cannot change the date while the card was merged before; open a window first, then call `PUT /rsv/v1/stays`.", None),
        (Q, "Der Fehler bedeutet, dass der Tag bereits abgeschlossen ist; bitte warten Sie bis zum Morgen und öffnen Sie dann die Kasse.", "other_language"),
        (Q, "Nejprve otevřete nastavení a uložte stránku, potom zkontrolujte účet hosta před příjezdem a vytiskněte fakturu znovu.", "other_language"),
        (Q, "Сначала откройте настройки и сохраните страницу, затем проверьте счет гостя.", "other_language"),
        (Q, "まず設定を開いてページを保存し、次にお客様の請求書を確認してください。", "other_language"),
        (Q, 'Use the stay call. The printed note reads "Bitte informieren Sie die Hausdame, bevor Sie die Gruppe freigeben." and the porter signs it.', None),
        (Q, "Open the stay and set the date of arri", "truncated"), (Q, Q + " Use the stay call of the interface and then save the page for the guests before noon today.", None),
    ],
)
def test_label(model, question, answer, defect):
    assert label(model, question, answer) == defect


def test_held_out_accuracy(model, rows):
    q, a, y = defects.synthetic(rows[2000:], seed=99)
    flat, sizes, dense, _ = defects.Features(model.profiles, model.trade)(q, a)
    got = model.labels(model.scores(flat, sizes, dense), np.array([bool(x) for x in q]))
    want = np.where(y.sum(axis=1) > 0, y.argmax(axis=1), -1)
    recall = {name: (got[want == k] == k).mean() for k, name in enumerate(defects.LABELS)}
    precision = {name: (want[got == k] == k).mean() for k, name in enumerate(defects.LABELS)}
    print(recall, precision)
    assert min(recall.values()) > 0.97 and np.mean(list(recall.values())) > 0.985, recall
    assert min(precision.values()) > 0.97, precision
    assert (got[want == -1] >= 0).mean() < 0.01


def test_copies():
    assert is_copy(Q, Q) and is_copy(f"{Q} {Q} {Q}", Q) and not is_copy(Q + " Use the stay call of the interface and then save the page.", Q) and not is_copy("", Q)


def test_awkward_rows(spark):
    rows = [(n, Q, "Use the stay call of the interface and set the date in the field of the form; then save the page.", "x") for n in range(60)]
    rows += [(100, None, None, "x"), (101, Q, "", "x"), (102, Q, "Use the stay call of the interface and set the date in the field of the form; " * 3000, "x"), (103, Q, "I must decline to answer this.", "x"), (103, Q, "I must decline to answer this.", "x")]
    df = spark.createDataFrame(rows, "result_id long, question string, generated_answer string, defect string")
    got = sorted((r.result_id, r.defect) for r in defects.defective_pairs(df).collect())
    assert got == [(100, "empty"), (101, "empty"), (102, "truncated"), (103, "refusal"), (103, "refusal")]


def test_thresholds_from_counts():
    rng = np.random.default_rng(2)
    steps = np.arange(-40, 60)
    own, other = (rng.poisson(np.exp(-((steps - at) / 12.0) ** 2) * n) for at, n in ((25, 30), (-10, 300)))
    want = defects.threshold(np.repeat(steps, own) * defects.STEP, np.repeat(steps, other) * defects.STEP)
    kept = own + other > 0
    assert np.isclose(defects.counted_threshold(steps[kept], own[kept], other[kept])[0], want)


def test_every_row_counts(spark):
    """Words of the trade come from all rows that are fitted, whatever the size of a chunk."""
    answers = [f"Use the stay call {'abcdefghijklmnopqrstuvwxyz'[n // 16] * 5} of the interface and set the date in the form." for n in range(400)]
    df = spark.createDataFrame([(n, Q, a) for n, a in enumerate(answers)], "result_id long, question string, answer string")
    model = defects.fitted(df, chunk_rows=20)
    assert {c * 5 for c in "abcdefghijklmnopqrstuvwxy"} <= model.trade and np.abs(model.dense).sum() > 0


def test_each_text_is_read_once(rows):
    """A text that stands in several examples, or is made and then read, has its ending settled once."""
    pairs, calls = [(q, a + " Then page 7.") for q, a in rows[-100:]], 0

    def count(frame, event, _):
        nonlocal calls
        calls += event == "call" and frame.f_code is endings.ending.__code__

    sys.setprofile(count)
    try:
        q, a, _ = defects.synthetic(pairs)
        defects.Features(defects.Profiles([]), frozenset())(q, a)
    finally:
        sys.setprofile(None)
    assert 0 < calls <= len({*a} | {a for _, a in pairs}) + 100  # and the cut texts that look whole


def test_texts_as_by_expression():
    """Tables give the words and letters that the regular expressions of their definition give."""
    every = [chr(c) for c in range(0x11000) if not 0xD800 <= c < 0xE000] + [chr(0x1D5A0), chr(0x20000), chr(0xE0101)]
    texts = ["".join(every[k::97]) for k in range(97)] + [f"a{c}b 1{c}" for c in every[:0x3000]] + ["", " ", "x", "\n/v1 `a"]
    for t in texts:
        plain = t if t.isascii() else unicodedata.normalize("NFC", t.translate(str.maketrans(chars.REPLACEMENTS)))
        assert chars.plain(t) == plain and chars.words(t) == re.findall(r"[^\W_]+", plain.lower())
        assert language_words(t) == re.findall(r"[^\W\d_]+", CODE.sub(" ", t).lower())
        assert defects._spelled(t) == re.sub(r"[\W\d_]+", " ", CODE.sub(" ", t).lower())


@pytest.mark.parametrize("text", [c + "." + t for c in defects.CORES for t in ("", " I DON'T KNOW.", " Désolé", " I wouldn’t be able to say", " I ſay I decline to anſwer", " nothİng")])
def test_declines_as_by_expression(text):
    for t in (text, text.upper(), text.lower()):
        assert defects._declines(t) == (defects.DECLINES.search(t) is not None)


@pytest.mark.parametrize("text", ["Q: a", "q: b\nA:", "x answer: ", "A:\n", "> Frage: x", "one: two", "a : a :", ""])
def test_labels_as_by_expression(text):
    assert defects._unlabelled(text) == defects.LABEL.sub("", text)


def test_empty_table(spark):
    df = spark.createDataFrame([], "result_id long, question string, generated_answer string")
    assert defects.defective_pairs(df).count() == 0
