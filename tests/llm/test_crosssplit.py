"""Problem 5: against all pairs compared word by word, and awkward input."""

from __future__ import annotations

import random

import numpy as np

from skarn.llm import crosssplit
from skarn.llm.chars import words

SCHEMA = "id string, split string, question string, expected_answer string, class string, q string"


def brute(rows):
    out = set()
    for a in rows:
        for b in rows:
            if a[1] == "train" and b[1] in ("dev", "test") and all((a[2], a[3], b[2], b[3])):
                x, y = [(words(r[2]), words(r[3])) for r in (a, b)]
                if all((*x, *y)) and min(crosssplit.same_words(x[0], y[0]), crosssplit.same_words(x[1], y[1])) >= crosssplit.SAME_WORDS:
                    out.add((a[0], b[0]))
    return out


def test_equals_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{n}" for n in range(400)]
    rows = []
    for n in range(120):
        q, a = rng.sample(vocabulary, 25), rng.sample(vocabulary, 25)
        rows.append((f"t{n:03}", "train", " ".join(q), " ".join(a)))
        if n % 3 == 0:
            q2 = [w if rng.random() > 0.05 else w + "x" for w in q]
            a2 = a if n % 2 else [w for w in a if rng.random() > 0.05]
            rows.append((f"e{n:03}", rng.choice(["dev", "test"]), " ".join(q2).upper(), ", ".join(a2)))
        if n % 10 == 0:
            rows.append((f"q{n:03}", "dev", " ".join(q), " ".join(rng.sample(vocabulary, 25))))
            rows.append((f"s{n:03}", "train", " ".join(q), " ".join(a)))
            rows.append((f"o{n:03}", "other", " ".join(q), " ".join(a)))
    rows += [("n1", "train", None, "x"), ("n2", "dev", None, "x"), ("n3", None, "q", "a"), (None, "dev", "q", "a"), ("n4", "dev", "!!", "??"), ("n5", "train", "!!", "??")]
    rows += [("short1", "train", "yes please", "no"), ("short2", "test", "Yes, please!", "No."), ("hot", "train", "same q here", "same a here")]
    rows += [(f"c{n}", "dev", "Same q here", "same a here") for n in range(40)] + [("long1", "train", "w " * 30000, "z " * 30000), ("long2", "dev", "w " * 30000, "z " * 30000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = [(r.train_id, r.eval_id) for r in crosssplit.cross_split_overlaps(df, shard_records=20, block_records=30).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows)
    report = crosssplit.overlap_report(crosssplit.cross_split_overlaps(df), df.withColumn("source", df.split)).collect()
    assert sum(r.pairs for r in report) == len(got)


def test_coverage_merges_intervals():
    assert crosssplit.coverage("abcde", 3, {"abc", "bcd"}) == 0.8 and crosssplit.coverage("abcde", 3, set()) == 0 and crosssplit.passages("ab", 2) == ["ab"]


def changed(rng, text, share, kind):
    """The words of ``text`` in order, with as many spread-out changes as leave the share of equal words."""
    out, n = list(text), len(text)
    most = n - -int(-share * n // 1)
    at = sorted(rng.sample(range(n), most)) if kind == "random" else [int((k + 0.5) * n / max(1, most)) for k in range(most)]
    for k in reversed(at):
        if kind == "left out":
            del out[k]
        else:
            out[k] = f"new{rng.random()}"
    if kind == "put in":
        out = list(text)
        for k in range(int(n / share) - n):
            out.insert(int((k + 1) * len(out) / (int(n / share) - n + 1)), f"new{rng.random()}")
    return out


def test_no_pair_of_the_criterion_is_lost():
    """Spread-out changes down to the least share of equal words, in texts of every length, in one house style."""
    rng = random.Random(9)
    vocabulary = [f"w{n}" for n in range(3000)]
    phrase = rng.sample(vocabulary, 12)
    records, asked = [], []
    for n in range(1, 90):
        for kind in ("random", "even", "left out", "put in"):
            q, a = (phrase + rng.sample(vocabulary, n))[-n - 6 :] if n > 10 else rng.sample(vocabulary, n), rng.sample(vocabulary, max(1, 90 - n))
            records.append((" ".join(q), " ".join(a)))
            asked.append(tuple(" ".join(changed(rng, t, crosssplit.SAME_WORDS, kind)) for t in (q, a)))
    shard = crosssplit.Shard(records)
    for n, (q, a) in enumerate(asked):
        same = [crosssplit.same_words(x.split(), y.split()) for x, y in zip((q, a), records[n], strict=True)]
        if min(same) >= crosssplit.SAME_WORDS:
            assert n in [m for m, *_ in shard.matches(q, a)], (n, records[n], q, a)
    fourth = " ".join(f"k{n}" if n % 4 else "x" for n in range(40)), " ".join(f"v{n}" if n % 4 else "y" for n in range(40))
    whole = " ".join(f"k{n}" for n in range(40)), " ".join(f"v{n}" for n in range(40))
    assert crosssplit.Shard([whole]).matches(*fourth)


def test_sketches_lose_no_pair():
    """Every pair of the criterion, words in any order, is among the near sketches; of the others few are."""
    rng = random.Random(4)
    vocabulary = [f"w{n}" for n in range(2000)]
    train, evaluation = [], []
    for n in [1, 2, 3, 4, 7, 18, 25, 40, 50, 200] * 6:
        pair = [[rng.choice(vocabulary) for _ in range(n)] for _ in range(2)]
        other = [changed(rng, t, crosssplit.SAME_WORDS, rng.choice(["random", "left out", "put in"])) for t in pair]
        for t in other:
            rng.shuffle(t)
        train.append(pair)
        evaluation.append(other)
    bits = crosssplit._Bits()
    columns = [np.array([(*crosssplit.sketch(q, bits), *crosssplit.sketch(a, bits)) for q, a in side]) for side in (train, evaluation)]
    near = {(n, m) for n, rows in crosssplit.near_sketches(*columns) for m in rows.tolist()}
    texts = [[tuple(" ".join(t) for t in pair) for pair in side] for side in (train, evaluation)]
    want = {(n, m) for n, x in enumerate(texts[0]) for m, y in enumerate(texts[1]) if crosssplit.alike_pair(x, y, crosssplit.SAME_WORDS)}
    assert want <= near and len(want) >= 40 and len(near) < 400


def test_words_in_another_order_are_equal(spark):
    """As in the SQL, which compares bags of words."""
    rng = random.Random(6)
    q, a = [f"k{n}" for n in range(30)], [f"v{n}" for n in range(30)]
    rows = [("a", "train", " ".join(q), " ".join(a))] + [(f"b{n}", "dev", " ".join(rng.sample(q, 30)), " ".join(rng.sample(a, 30))) for n in range(3)]
    got = crosssplit.cross_split_overlaps(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert {(r.train_id, r.eval_id) for r in got} == brute(rows) == {("a", f"b{n}") for n in range(3)}


def test_empty(spark):
    assert crosssplit.cross_split_overlaps(spark.createDataFrame([], SCHEMA)).count() == 0
