"""Problem 1: a sample matching target category proportions.

Method: the cube method. Every row of a stratum has the same inclusion probability (rows needed / rows available), so
the balancing equations are one indicator a stratum. Flight phases run per block of rows: a move along the null space of
the indicators in the block rounds at least one probability to 0 or 1 and keeps every equation. At most one row a
stratum is left unresolved in a block; those rows merge upward, sixteen blocks into one, until one block is left. The
landing phase rounds what remains there, dropping the equations one by one. Residual imbalance is reported by stratum.

No group grows with the data: a block holds ``block_rows`` rows at most on average, an upper block sixteen times the
number of strata. Random numbers are digests of the row id and a seed, so a lost task repeats its result.

Defined results. Rows with a null label count towards n only. Labels are compared without regard to case, surrounding
white space, and whether words are joined by space, hyphen or underscore. Repeated rows and ids count each. A target
with fewer rows than needed takes all of them. An empty population has n = 0: needs are the minima, all unmet if above 0.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.plans.shared import materialize

LABELS = ("module", "category", "difficulty")
#: One row in this many is drawn.
DIVISOR = 5
BLOCK_ROWS = 50_000
FAN_IN = 16
EPSILON = 1e-9


def canonical_label(label: str | Column) -> Column:
    """One spelling of a label: lower case, trimmed, words joined by underscores."""
    column = F.col(label) if isinstance(label, str) else label
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^\s+|\s+$", "")), r"[\s_\-]+", "_")


def targets_report(rows: DataFrame, targets: DataFrame, labels: Sequence[str] = LABELS, divisor: int = DIVISOR) -> DataFrame:
    """Targets with ``needed`` and ``available`` rows: (labels, target_per_10000, min_rows, needed, available, drawn)."""
    keys = [f"_k{i}" for i in range(len(labels))]
    counted = (
        rows.select(*[canonical_label(c).alias(k) for c, k in zip(labels, keys, strict=True)])
        .groupBy(*keys)
        .agg(F.count("*").alias("_n"))
    )
    total = counted.agg(F.floor(F.coalesce(F.sum("_n"), F.lit(0)) / divisor).cast("long").alias("_draw"))
    wanted = targets.select(*labels, "target_per_10000", "min_rows", *[canonical_label(c).alias(k) for c, k in zip(labels, keys, strict=True)])
    share = F.col("target_per_10000").cast("long") * F.col("_draw")
    return (
        wanted.join(counted, keys, "left")
        .crossJoin(F.broadcast(total))  # one row
        .select(
            *labels,
            "target_per_10000",
            "min_rows",
            F.greatest(F.col("min_rows").cast("long"), F.expr("(target_per_10000 * _draw + 9999) div 10000")).alias("needed"),
            F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias("available"),
            (share / 10000.0).alias("exact_share"),
        )
        .withColumn("target_rows", F.least("needed", "available"))
    )


def _null_move(x: np.ndarray) -> np.ndarray | None:
    """A vector of the null space of the balancing equations ``x`` (variables by rows), or None."""
    if x.shape[1] == 0:
        return None
    _, s, v = np.linalg.svd(x, full_matrices=True)
    rank = int((s > 1e-10).sum())
    return v[-1] if rank < x.shape[1] else None


def flight(p: np.ndarray, stratum: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Cube flight on stratum indicators: until no null-space move is left, at most one row a stratum is unresolved.

    The indicators are disjoint, so the null space of the open rows is spanned by differences of two rows of one
    stratum; the moves are taken along these, first open row against the next, in the order given. ``draw`` has one
    uniform number a row, which picks the direction of the move that ends at that row.
    """
    p = p.astype(float).copy()
    held: dict[object, int] = {}
    for k in range(len(p)):
        if not EPSILON < p[k] < 1 - EPSILON:
            p[k] = round(p[k])
            continue
        other = held.get(stratum[k])
        if other is None:
            held[stratum[k]] = k
            continue
        a, b = p[other], p[k]
        up, down = min(1 - a, b), min(a, 1 - b)  # longest steps along (+1, -1) and (-1, +1)
        step = up if draw[k] < down / (up + down) else -down
        p[other], p[k] = a + step, b - step
        held.pop(stratum[k])
        for row in (other, k):
            if EPSILON < p[row] < 1 - EPSILON:
                held[stratum[k]] = row
            else:
                p[row] = round(p[row])
    return p


def landing(p: np.ndarray, x: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Resolve the last rows: flight by null-space moves, dropping the last equation whenever none is left."""
    p = p.astype(float).copy()
    equations = x.shape[0]
    step_no = 0
    while True:
        open_rows = np.nonzero((p > EPSILON) & (p < 1 - EPSILON))[0]
        if not len(open_rows):
            return np.round(p)
        move = _null_move(x[:equations, open_rows]) if equations else np.eye(len(open_rows))[0]
        if move is None:
            equations -= 1
            continue
        q = p[open_rows]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(move > 0, (1 - q) / move, np.where(move < 0, -q / move, np.inf)))
            down = np.min(np.where(move > 0, q / move, np.where(move < 0, (q - 1) / move, np.inf)))
        u = draw[open_rows[step_no % len(open_rows)]]
        q = q + (up if u < down / (up + down) else -down) * move
        p[open_rows] = np.where(q < EPSILON, 0.0, np.where(q > 1 - EPSILON, 1.0, q))
        step_no += 1


def _uniform(seed: int) -> Column:
    """A number in (0, 1) fixed by the row and the seed."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("row")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def _block_flight(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["stratum", "draw", "row"], kind="stable").reset_index(drop=True)
    group["p"] = flight(group["p"].to_numpy(), group["stratum"].to_numpy(), group["draw"].to_numpy())
    return group[group["p"] > EPSILON]


def _land(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["stratum", "draw", "row"], kind="stable").reset_index(drop=True)
    p = flight(group["p"].to_numpy(), group["stratum"].to_numpy(), group["draw"].to_numpy())
    still = np.nonzero((p > EPSILON) & (p < 1 - EPSILON))[0]
    if len(still):
        strata = sorted(set(group["stratum"].to_numpy()[still]))
        x = np.array([[1.0 if s == t else 0.0 for s in group["stratum"].to_numpy()[still]] for t in strata])
        p[still] = landing(p[still], x, group["draw"].to_numpy()[still])
    group["p"] = p
    return group[group["p"] > EPSILON]


def balanced_sample(
    rows: DataFrame,
    report: DataFrame,
    id_col: str = "id",
    labels: Sequence[str] = LABELS,
    seed: int = 42,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Rows drawn so that each stratum of ``report`` has its ``target_rows``: (id, official labels).

    ``report`` (see :func:`targets_report`) has one row a target and is small by its nature; it is joined by its labels.
    """
    keys = [f"_k{i}" for i in range(len(labels))]
    strata = report.select(
        *[canonical_label(c).alias(k) for c, k in zip(labels, keys, strict=True)],
        F.concat_ws("|", *labels).alias("stratum"),
        F.when(F.col("available") > 0, F.col("target_rows") / F.col("available")).otherwise(F.lit(0.0)).alias("p"),
    )
    # rows of one id and stratum share a digest; they are drawn row by row all the same
    digest = F.xxhash64(F.col(id_col), *[F.col(c) for c in labels])
    numbered = rows.select(F.col(id_col).alias("id"), *[canonical_label(c).alias(k) for c, k in zip(labels, keys, strict=True)], digest.alias("row"))
    open_rows = (
        numbered.join(strata, keys)
        .select("id", "stratum", "row", "p")
        .withColumn("draw", _uniform(seed))
    )
    schema = "id string, stratum string, row long, p double, draw double, block long"
    blocks = max(1, -(-open_rows.count() // block_rows))
    level = open_rows.select(
        F.col("id").cast("string"), "stratum", "row", "p", "draw", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).alias("block")
    )
    chosen = None
    while True:
        last = blocks == 1
        done = materialize(level.groupBy("block").applyInPandas(_land if last else _block_flight, schema), "p1")
        resolved = done.where(F.col("p") > 1 - EPSILON)
        chosen = resolved if chosen is None else chosen.unionByName(resolved)
        if last:
            break
        blocks = -(-blocks // fan_in)
        level = done.where(F.col("p") <= 1 - EPSILON).withColumn("block", F.floor(F.col("block") / fan_in).cast("long"))
    parts = F.split("stratum", r"\|")
    return chosen.select("id", *[parts[i].alias(c) for i, c in enumerate(labels)])


def sample_report(sample: DataFrame, report: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Residual imbalance by target: rows drawn against rows needed, and whether the target could be met."""
    drawn = sample.groupBy(*labels).agg(F.count("*").alias("drawn"))
    return report.join(drawn, list(labels), "left").select(
        *labels,
        "target_per_10000",
        "min_rows",
        "needed",
        "available",
        F.coalesce(F.col("drawn"), F.lit(0)).cast("long").alias("drawn"),
        (F.coalesce(F.col("drawn"), F.lit(0)) - F.col("needed")).cast("long").alias("residual"),
        (F.coalesce(F.col("drawn"), F.lit(0)) >= F.col("needed")).alias("met"),
    )


def margin_report(by_target: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Residual imbalance of each single label: (label, value, needed, drawn, residual), from :func:`sample_report`.

    The strata refine the labels, so a sample balanced on the strata is balanced on every label.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in labels])).alias("l")
    sums = by_target.select(each, "needed", "drawn").groupBy("l.label", "l.value").agg(F.sum("needed").alias("needed"), F.sum("drawn").alias("drawn"))
    return sums.withColumn("residual", F.col("drawn") - F.col("needed"))
