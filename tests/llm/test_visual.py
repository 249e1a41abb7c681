"""Problem 9: the embedded SQL against plain Python, and pairs against all pairs."""

from __future__ import annotations

import random

from skarn.llm import visual
from skarn.llm.chars import REPLACEMENTS, plain

SCHEMA = "doc_id long, text string, look string, raw string"
TEXTS = [
    "Hotel", "Ноtel", "Ｈｏｔｅｌ", "Ho​tel", "Ho­tel", "hotel", "Hôtel", "Hôtel", "Но̂tel", "a b", "a b", "a b", "a  b", "m²", "m2", "½", "1/2",
    "x\r\ny", "x\ny", "x\ry", "co‑op", "co-op", "co–op", "", "​", "Спасибо", "ⅰⅼ", "il", "it's", "Key", "Key", "日本", "naïve", "naïve",
]


def frame(spark, texts):
    return spark.createDataFrame([(n, t, "x", "y") for n, t in enumerate(texts)], SCHEMA)


def want(text):
    return plain(text).replace("\r\n", "\n").replace("\r", "\n")


def test_sql_equals_python(spark):
    texts = TEXTS + ["".join(random.Random(n).sample(list(REPLACEMENTS) + list("abc é"), 30)) for n in range(40)] + ["é" * 50_000]
    got = {r.doc_id: r for r in visual.canonical_text(frame(spark, texts + [None]), "doc_id", "text").collect()}
    for n, t in enumerate(texts):
        assert (got[n].canonical_text, got[n].changed) == (want(t), want(t) != t)
    assert got[len(texts)].canonical_text is None


def test_pairs(spark):
    texts = TEXTS * 2 + ["Ho‌tel"] * 30 + ["Hotel"] * 30 + [None, None]
    for block_rows in (2_000, 7):
        got = [(r.doc_id_a, r.doc_id_b) for r in visual.visual_pairs(visual.visual_digests(frame(spark, texts), "doc_id", "text"), block_rows).collect()]
        expected = {
            (a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if None not in (texts[a], texts[b]) and texts[a] != texts[b] and want(texts[a]) == want(texts[b])
        }
        assert len(got) == len(set(got)) and set(got) == expected


def test_visible_differences_stay():
    for a, b in (("Hotel", "hotel"), ("Hôtel", "Hotel"), ("m²", "m2"), ("½", "1/2"), ("a b", "a  b"), ("co-op", "co–op"), ("1", "l")):
        assert plain(a) != plain(b)


def test_empty(spark):
    assert visual.visual_pairs(visual.visual_digests(frame(spark, []), "doc_id", "text")).count() == 0
