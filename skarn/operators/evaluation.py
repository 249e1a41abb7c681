"""Statistics of scored results. Rank statistics and tests are aggregations; p-values are expressions on their one row."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scored(df: DataFrame) -> DataFrame:
    """Rows with a judgement: null and -1 are not."""
    return df.where(F.coalesce("score", F.lit(-1)) > 0)


def histogram(df: DataFrame, group: str) -> DataFrame:
    counts = [F.count_if(F.col("score") == s).alias(f"s{s}") for s in range(1, 6)]
    return scored(df).groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), *counts)


def breakdown(df: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """Mean and n by (by, field) for each field, one pass: (by, field, value, n, mean_score)."""
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return scored(df).select(by, "score", pair).groupBy(by, "p.field", "p.value").agg(
        F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score")
    )


def latency(df: DataFrame, group: str, chars: str) -> DataFrame:
    """Exact percentiles (linear interpolation), and milliseconds a character as a ratio of sums."""
    l = F.col("latency_seconds")  # noqa: E741
    return df.where(l.isNotNull() & (l >= 0)).groupBy(group).agg(
        F.count("*").alias("n"),
        F.round(F.avg(l), 6).alias("mean_s"),
        F.round(F.expr("percentile(latency_seconds, 0.5)"), 6).alias("p50_s"),
        F.round(F.expr("percentile(latency_seconds, 0.9)"), 6).alias("p90_s"),
        F.round(F.expr("percentile(latency_seconds, 0.95)"), 6).alias("p95_s"),
        F.round(F.max(l), 6).alias("max_s"),
        F.round(F.expr(f"percentile({chars}, 0.5)"), 6).alias("median_chars"),
        F.round(F.try_divide(1000 * F.sum(l), F.sum(F.col(chars))), 6).alias("ms_per_char"),
    )


def config_table(df: DataFrame, group: str) -> DataFrame:
    """One report row a configuration: n, failed, mean, share usable (4 or more), share wrong (2 or less), latency."""
    ok = F.coalesce("score", F.lit(-1)) > 0
    share = lambda c: F.round(F.try_divide(100.0 * F.count_if(ok & c), F.count_if(ok)), 6)
    return df.groupBy(group).agg(
        F.count_if(ok).alias("n"),
        F.count_if(F.col("score") == -1).alias("n_failed"),
        F.round(F.avg(F.when(ok, F.col("score"))), 6).alias("mean_score"),
        share(F.col("score") >= 4).alias("usable_pct"),
        share(F.col("score") <= 2).alias("wrong_pct"),
        F.round(F.expr("percentile(latency_seconds, 0.5) FILTER (WHERE latency_seconds >= 0)"), 6).alias("median_latency_s"),
        F.round(F.expr("percentile(latency_seconds, 0.95) FILTER (WHERE latency_seconds >= 0)"), 6).alias("p95_latency_s"),
        F.round(F.expr("percentile(length(coalesce(generated_answer, '')), 0.5)"), 6).alias("median_chars"),
    )


def config_report(df: DataFrame, scores: DataFrame, rates: DataFrame, group: str = "config") -> DataFrame:
    """The report row of :func:`config_table` with the interval of the mean of ``scores`` (:func:`task_scores`) and the share
    of invalid paths of ``rates``."""
    interval = bootstrap(scores, group, "score").select(group, "ci_low", "ci_high")
    paths = rates.select(group, "bad_paths", "total_paths", "bad_path_pct")
    return config_table(df, group).join(interval, group, "left").join(paths, group, "left")


def task_scores(df: DataFrame, task: str = "task_id", config: str = "config") -> DataFrame:
    """One score a task and configuration: the mean of its judged rows."""
    return scored(df).groupBy(F.col(task).alias("task"), F.col(config).alias("config")).agg(F.avg("score").alias("score"))


def paired(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tasks that both configurations of a pair answered: (label_a, label_b, task, a, b, diff). ``pairs`` is a stated list."""
    named = F.broadcast(pairs.select("label_a", "label_b"))  # the planned comparisons, some rows
    a = scores.select("task", F.col("config").alias("label_a"), F.col("score").alias("a")).join(named, "label_a")
    b = scores.select("task", F.col("config").alias("label_b"), F.col("score").alias("b"))
    return a.join(b, ["task", "label_b"]).withColumn("diff", F.col("b") - F.col("a"))


def paired_summary(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("label_a", "label_b").agg(
        F.count("*").alias("n"),
        F.round(F.avg("a"), 6).alias("mean_a"),
        F.round(F.avg("b"), 6).alias("mean_b"),
        F.round(F.avg("diff"), 6).alias("delta"),
        F.count_if(F.col("diff") > 0).alias("wins"),
        F.count_if(F.col("diff") < 0).alias("losses"),
        F.count_if(F.col("diff") == 0).alias("ties"),
    )


def average_rank(partition: list[str], order):
    """Rank with ties averaged."""
    w = Window.partitionBy(*partition).orderBy(order)
    return w, lambda tie: F.rank().over(w) + (F.count("*").over(Window.partitionBy(*partition, tie)) - 1) / F.lit(2.0)


def signed_ranks(diffs: DataFrame) -> DataFrame:
    """Wilcoxon signed-rank statistic by pair, zeros dropped, ties averaged: n, W+, W-, T, tie term, z.

    Ranks come from a histogram of |diff|, one row a distinct value, so a comparison is never one window over its tasks.
    """
    nonzero = diffs.where("diff <> 0").withColumn("size", F.round(F.abs("diff"), 9))
    values = nonzero.groupBy("label_a", "label_b", "size").agg(
        F.count("*").cast("double").alias("c"), F.count_if(F.col("diff") > 0).cast("double").alias("up"), F.count_if(F.col("diff") < 0).cast("double").alias("down")
    )
    before = F.sum("c").over(Window.partitionBy("label_a", "label_b").orderBy("size")) - F.col("c")
    ranked = values.withColumn("rank", before + (F.col("c") + 1) / 2)
    sums = ranked.groupBy("label_a", "label_b").agg(
        F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * F.col("down")).alias("w_minus"),
        F.sum(F.col("c") ** 3 - F.col("c")).alias("tie"),
    )
    n, t = F.col("n"), F.least("w_plus", "w_minus")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie") / 48)
    z = F.try_divide(t - n * (n + 1) / 4, spread)
    return sums.select(
        "label_a", "label_b", n.cast("long").alias("n"), F.round("w_plus", 6).alias("w_plus"), F.round("w_minus", 6).alias("w_minus"), F.round(z, 6).alias("z"),
        F.round(normal_two_sided(z), 6).alias("p"),
    )


#: Intervals of the numerical integrals; with Simpson's rule good for more than the six places reported.
STEPS = 400


def _simpson(f, upper: Column) -> Column:
    """Integral of ``f`` from 0 to ``upper``."""
    h = upper / STEPS
    weight = lambda i: F.when((i == 0) | (i == STEPS), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    points = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: weight(i) * f(i * h))
    return F.aggregate(points, F.lit(0.0), lambda s, x: s + x) * h / 3


def normal_two_sided(z: Column) -> Column:
    """P(|Z| > |z|) of a standard normal."""
    inside = _simpson(lambda x: F.exp(-x * x / 2), F.least(F.abs(z), F.lit(10.0)))
    return F.when(z.isNotNull(), F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(2 * math.pi) * inside))


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X > x) of a chi-square with an integer number of degrees of freedom."""
    half = x / 2
    even = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), (df / 2).cast("int"))), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
                       lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * half / k).alias("t")))["s"]
    odd = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), ((df - 1) / 2).cast("int"))), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")),
                      lambda a, k: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * x / (2 * k + 1)).alias("t")))["s"]
    tail = normal_two_sided(F.sqrt(x)) + F.when(df == 1, 0.0).otherwise(F.sqrt(2 * x / math.pi) * F.exp(-half) * odd)
    return F.when(x <= 0, 1.0).when(df % 2 == 0, F.exp(-half) * even).otherwise(F.least(F.lit(1.0), tail))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation of n pairs by the t distribution; the angle of t is integrated."""
    nu = (n - 2).cast("double")
    root = F.sqrt(nu)
    f = lambda u: F.pow(F.greatest(F.lit(0.0), F.cos(u / root)), nu - 1)
    most = F.least(root * (math.pi / 2), F.lit(12.0))
    reach = F.least(root * F.atan(F.abs(r) / F.sqrt(1 - r * r)), most)
    return F.when(n > 2, F.when(F.abs(r) >= 1, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - _simpson(f, reach) / _simpson(f, most))))


def friedman(scores: DataFrame) -> DataFrame:
    """Mean rank of each configuration over the tasks that all answered, place, and the chi-square statistic."""
    every = scores.select("task").distinct().withColumn("category", F.lit("ALL"))
    return friedman_by(scores, every, least=1).drop("category")


def friedman_by(scores: DataFrame, categories: DataFrame, least: int = 3) -> DataFrame:
    """Friedman ranks for each category of ``categories`` (task, category, distinct), over the tasks that every
    configuration of ``scores`` answered. Categories with fewer than ``least`` such tasks are left out."""
    k = scores.select("config").distinct().agg(F.count("*").alias("k"))
    complete = scores.groupBy("task").agg(F.count("*").alias("have")).crossJoin(F.broadcast(k)).where("have = k").select("task", "k")  # k: one row
    full = scores.join(complete, "task")
    _, rank = average_rank(["task"], F.desc("score"))
    ranked = full.withColumn("rank", rank("score")).join(categories, "task")
    sums = ranked.groupBy("category", "config").agg(F.sum("rank").alias("r"), F.count("*").alias("n"), F.first("k").alias("k")).where(F.col("n") >= least)
    ties = ranked.groupBy("category", "task", "score").agg(F.count("*").alias("t")).groupBy("category").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("tie"))
    every = Window.partitionBy("category")  # one row a configuration
    n, kk = F.col("n").cast("double"), F.col("k").cast("double")
    raw = 12 / (n * kk * (kk + 1)) * F.sum(F.col("r") ** 2).over(every) - 3 * n * (kk + 1)
    correction = 1 - F.try_divide(F.col("tie"), n * kk * (kk**2 - 1))
    chi = F.try_divide(raw, correction)
    return sums.join(ties, "category").select(
        "category",
        "config",
        F.round(F.col("r") / n, 6).alias("mean_rank"),
        F.row_number().over(every.orderBy(F.round(F.col("r") / n, 6), "config")).alias("place"),
        F.col("n").alias("tasks"),
        F.round(chi, 6).alias("chi_square"),
        F.round(chi_square_tail(chi, (F.col("k") - 1).cast("int")), 6).alias("p"),
    )


REPLICATES = 10_000
#: Replicates drawn by one call, each call with a generator of its own, so a group is not one task.
REPLICATE_BLOCK = 500
#: Counts held at once while a block is drawn.
DRAWN_COUNTS = 1_000_000


def resampled_means(df: DataFrame, group: str, value: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Means of resamples with replacement of each group's values: (group, rep, m).

    How often a resample of n values holds each distinct value is one multinomial draw over the group's histogram, so
    the cost goes by distinct values, not by rows. A block's generator is seeded by a digest of seed, group and block.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("c"))
    blocks = -(-replicates // REPLICATE_BLOCK)

    def draw(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
        name, block = key
        rng = np.random.default_rng(int(hashlib.md5(f"{seed}|{name}|{block}".encode()).hexdigest(), 16))
        hist = hist.sort_values("v")
        v, c = hist["v"].to_numpy(), hist["c"].to_numpy()
        n, first = int(c.sum()), int(block) * REPLICATE_BLOCK
        size = min(REPLICATE_BLOCK, replicates - first)
        step = max(1, DRAWN_COUNTS // len(v))
        m = np.concatenate([rng.multinomial(n, c / n, size=min(step, size - k)) @ v / n for k in range(0, size, step)])
        return pd.DataFrame({group: [name] * size, "rep": np.arange(first, first + size), "m": m})

    dealt = counts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    kind = df.schema[group].dataType.simpleString()
    return dealt.groupBy(group, "block").applyInPandas(draw, f"`{group}` {kind}, rep int, m double")


def _interval(n: DataFrame, means: DataFrame, group: str) -> DataFrame:
    ends = means.groupBy(group).agg(F.expr("percentile(m, 0.025)").alias("lo"), F.expr("percentile(m, 0.975)").alias("hi"))
    return n.join(ends, group).select(group, "n", F.round("mean", 6).alias("mean"), F.round("lo", 6).alias("ci_low"), F.round("hi", 6).alias("ci_high"))


def bootstrap(df: DataFrame, group: str, value: str, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Mean and percentile interval by group from resampling with replacement."""
    n = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(value).cast("double")).alias("mean"))
    return _interval(n, resampled_means(df, group, value, replicates, seed), group)


def agreement(pairs: DataFrame) -> DataFrame:
    """(human, judge) -> n, exact and within-one agreement, mean bias (judge - human)."""
    gap = F.col("judge") - F.col("human")
    return pairs.agg(
        F.count("*").alias("n"),
        F.round(F.avg((gap == 0).cast("double")), 6).alias("exact"),
        F.round(F.avg((F.abs(gap) <= 1).cast("double")), 6).alias("within1"),
        F.round(F.avg(gap.cast("double")), 6).alias("mean_bias"),
    )


def kappa(pairs: DataFrame) -> DataFrame:
    """Cohen's kappa with linear and quadratic weights; weights use the place of a label among the labels seen."""
    cells = pairs.groupBy("human", "judge").agg(F.count("*").cast("double").alias("o"))
    labels = cells.select(F.col("human").alias("l")).union(cells.select("judge")).distinct()
    placed = labels.withColumn("i", F.row_number().over(Window.orderBy("l")))  # one row a score level
    rows = cells.groupBy("human").agg(F.sum("o").alias("rn"))
    columns = cells.groupBy("judge").agg(F.sum("o").alias("cn"))
    h, j = placed.select(F.col("l").alias("human"), F.col("i").alias("hi")), placed.select(F.col("l").alias("judge"), F.col("i").alias("ji"))
    grid = rows.crossJoin(columns).join(cells, ["human", "judge"], "left").join(h, "human").join(j, "judge")  # score levels squared
    total = F.sum(F.coalesce("o", F.lit(0.0)))
    expected = F.col("rn") * F.col("cn")
    out = []
    for name, weight in (("kappa_linear", F.abs(F.col("hi") - F.col("ji"))), ("kappa_quadratic", (F.col("hi") - F.col("ji")) ** 2)):
        seen = F.sum(weight * F.coalesce("o", F.lit(0.0)))
        out.append(F.round(1 - F.try_divide(seen.cast("double"), F.sum(weight * expected).cast("double") / total), 6).alias(name))
    return grid.agg(*out)


def spearman(pairs: DataFrame) -> DataFrame:
    """Rank correlation of (x, y), ties averaged; ranks come from histograms of the values."""

    def ranks(c: str) -> DataFrame:
        hist = pairs.groupBy(c).agg(F.count("*").alias("n"))
        upto = F.sum("n").over(Window.orderBy(c))  # one row a distinct value
        return hist.select(c, (upto - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"rank_{c}"))

    both = pairs.join(ranks("x"), "x").join(ranks("y"), "y")
    found = both.agg(F.count("*").alias("n"), F.corr("rank_x", "rank_y").alias("r"))
    return found.select("n", F.round("r", 6).alias("rho"), F.round(correlation_p(F.col("r"), F.col("n")), 6).alias("p"))
