"""Problem 8: planted passages, whole, in part, changed, re-ordered and disguised."""

from __future__ import annotations

import random

from skarn.llm import leakage

ITEM = [f"{a}{n}" for n, a in enumerate(["alpha", "beta", "gamma", "delta", "omega"] * 12)]
OTHER = [f"other{n}" for n in range(400)]


def scan(spark, docs, items=((1, " ".join(ITEM)),), **options):
    d = spark.createDataFrame([(n, t, "x") for n, t in enumerate(docs)], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.matched_words, r.changed_words) for r in leakage.leaked_items(d, i, **options).collect()}


def around(words, seed=1):
    rng = random.Random(seed)
    return " ".join(rng.sample(OTHER, 60) + words + rng.sample(OTHER, 60))


def test_passages(spark):
    changed = [("changed" if n % 9 == 4 else w) for n, w in enumerate(ITEM)]
    shuffled = ITEM[:]
    random.Random(2).shuffle(shuffled)
    hyphen = around(ITEM[5:40]).replace("gamma12", "gam-\nma12").replace("beta21", "**beta21**")
    docs = [
        around(ITEM), around(ITEM[10:30]), around(ITEM[10:29]), around(changed), around(shuffled), around(ITEM[:12]), " ".join(ITEM).upper().replace(" ", ", "),
        hyphen, around(ITEM[:30]).replace("alpha", "аlрhа"), None, "", around(ITEM[:15] + ["put", "in"] + ITEM[15:30]), "> " + "\n> ".join(ITEM), " ".join(OTHER) * 50,
    ]
    got = scan(spark, docs)
    assert {d for d, _ in got} == {0, 1, 3, 6, 7, 8, 11, 12}
    assert got[0, 1] == (60, 0) and got[1, 1] == (20, 0) and got[3, 1][1] > 0


def test_changes_close_together(spark):
    def changed(*places):
        return around([("changed" if n in places else w) for n, w in enumerate(ITEM)])

    got = scan(spark, [changed(10, 12), changed(10, 11, 12), changed(47, 49), changed(10, 12, 30, 31, 32), changed(8, 9, 10, 11, 12, 13, 14, 15, 16)])
    assert got == {(0, 1): (60, 2), (1, 1): (60, 3), (2, 1): (60, 2), (3, 1): (60, 5), (4, 1): (43, 0)}
    short = [("changed" if 3 <= n <= 5 else w) for n, w in enumerate(ITEM[:20])]
    assert scan(spark, [around(short)]) == {(0, 1): (20, 3)}


def test_changed_too_much(spark):
    every_fourth = [("changed" if n % 4 == 2 else w) for n, w in enumerate(ITEM)]
    assert scan(spark, [around(every_fourth)]) == {}


def test_short_and_awkward_items(spark):
    items = [(1, "one two three"), (2, None), (3, ""), (4, " ".join(ITEM[:9])), (1, "one two three"), (None, "x y z")]
    got = scan(spark, ["and one two THREE go", " ".join(ITEM[:9]) + " more", "one two", "one two three one two three"], items)
    assert set(got) == {(0, 1), (3, 1), (1, 4)}


def test_blocks_give_the_same(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(30))) for n in range(9)]
    docs = [around(items[n][1].split(" ")[:25], n) for n in range(9)] * 2
    assert scan(spark, docs, items, block_items=2) == scan(spark, docs, items) and len(scan(spark, docs, items)) == 18


def test_hits_that_cannot_suffice_are_walked_one_way(monkeypatch):
    calls = []
    extend = leakage._extend
    monkeypatch.setattr(leakage, "_extend", lambda *args: calls.append(1) or extend(*args))
    index = leakage.Index([(1, " ".join(ITEM))])
    _, item = index.items[0]
    text = leakage.Stream(OTHER[:30] + ITEM[:7] + OTHER[30:60])
    assert leakage.overlap(item, text, 30, 0, least=20)[0] == 0 and len(calls) == 1
    text = leakage.Stream(OTHER[:30] + ITEM[5:40] + OTHER[30:60])
    assert leakage.overlap(item, text, 30, 5, least=20)[:2] == (35, 0) and len(calls) == 3


def test_empty(spark):
    assert scan(spark, [], [(1, "x")]) == {} and scan(spark, ["x"], [(2, None)]) == {}
