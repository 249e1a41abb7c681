"""Problem 1: needs, availability, balance, and awkward input."""

from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import balanced

SCHEMA = "id string, module string, category string, difficulty string, extra int"
TARGETS = "module string, category string, difficulty string, target_per_10000 int, min_rows int"


def draw(spark, rows, targets, **options):
    r = spark.createDataFrame(rows, SCHEMA)
    report = balanced.targets_report(r, spark.createDataFrame(targets, TARGETS))
    sample = balanced.balanced_sample(r, report, **options)
    return sample, {x.difficulty: x for x in balanced.sample_report(sample, report).collect()}


def test_sample_meets_targets_across_blocks(spark):
    rows = [(f"i{n}", ("Front Office", "front_office", " FRONT-OFFICE ")[n % 3], "api", ("easy", "hard", "rare")[0 if n < 700 else 1 if n < 990 else 2], n) for n in range(1000)]
    targets = [("front_office", "api", "easy", 5000, 1), ("front_office", "api", "hard", 4000, 1), ("front_office", "api", "rare", 1000, 12), ("front_office", "api", "none", 0, 1)]
    sample, report = draw(spark, rows, targets, block_rows=40, fan_in=3)
    got = {k: (r.needed, r.available, r.drawn, r.residual, r.met) for k, r in report.items()}
    assert got == {"easy": (100, 700, 100, 0, True), "hard": (80, 290, 80, 0, True), "rare": (20, 10, 10, -10, False), "none": (1, 0, 0, -1, False)}
    ids = [r.id for r in sample.collect()]
    assert len(ids) == len(set(ids)) == 190
    again, _ = draw(spark, rows, targets, block_rows=40, fan_in=3)
    assert sorted(r.id for r in again.collect()) == sorted(ids)


def test_nulls_count_towards_n_only(spark):
    rows = [(f"i{n}", None if n % 2 else "m", "c", "d", n) for n in range(50)] + [(None, "m", "c", "d", 0)] * 5
    _, report = draw(spark, rows, [("m", "c", "d", 10000, 1)])
    assert (report["d"].needed, report["d"].available, report["d"].drawn) == (11, 30, 11)


def test_repeated_rows_count_each(spark):
    _, report = draw(spark, [("same", "m", "c", "d", 1)] * 20, [("m", "c", "d", 10000, 20)])
    assert (report["d"].available, report["d"].drawn) == (20, 20)


def test_empty_population(spark):
    sample, report = draw(spark, [], [("m", "c", "d", 10000, 2)])
    assert sample.count() == 0 and (report["d"].needed, report["d"].met) == (2, False)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.integers(0, 3), st.floats(0.02, 0.98), st.floats(0.001, 0.999)), max_size=40))
def test_flight_keeps_every_stratum_total(items):
    stratum = np.array([i[0] for i in items], dtype=object)
    p, u = np.array([i[1] for i in items]), np.array([i[2] for i in items])
    out = balanced.flight(p, stratum, u)
    for s in set(stratum.tolist()):
        inside = stratum == s
        assert abs(out[inside].sum() - p[inside].sum()) < 1e-6
        assert ((out[inside] > 1e-9) & (out[inside] < 1 - 1e-9)).sum() <= 1


def test_landing_rounds_everything_and_stays_close():
    p = np.array([0.5, 0.5, 0.3, 0.7, 0.2])
    x = np.array([[1, 1, 0, 0, 0], [0, 0, 1, 1, 0], [0, 0, 0, 0, 1.0]])
    out = balanced.landing(p, x, np.array([0.1, 0.6, 0.3, 0.8, 0.5]))
    assert set(out.tolist()) <= {0.0, 1.0} and out[:2].sum() == 1 and out[2:4].sum() == 1
