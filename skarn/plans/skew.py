"""Joins that survive one key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot above this many rows; at most ``rows / HOT_ROWS`` keys can be, so the hot list stays small.
HOT_ROWS = 50_000
#: Rows of a hot key that one salt should hold.
SALT_ROWS = 25_000


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    spread: str | None = None,
    hot_rows: int = HOT_ROWS,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Equi-join on ``key`` where ``left`` may have hot keys and ``right`` has few rows per key.

    The rows of each left key are counted (partial aggregation, so a hot key costs one row per task). Rows of a hot
    key get a salt from the hash of ``spread`` (default: all left columns), and only the right rows of hot keys are
    repeated for every salt. Cold keys keep salt 0, so nothing is repeated for them. ``how``: inner, left, left_semi.
    Null keys never match; with ``left`` they are kept.
    """
    hot = left.groupBy(key).count().where(F.col("count") > hot_rows).select(
        key, F.ceil(F.col("count") / salt_rows).cast("int").alias("_salts")
    )
    chosen = F.xxhash64(*[F.col(c) for c in ([spread] if spread else left.columns)])
    salted_left = (
        left.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(F.pmod(chosen, F.col("_salts")).cast("int")))
        .drop("_salts")
    )
    salted_right = (
        right.join(F.broadcast(hot), key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return salted_left.join(salted_right, [key, "_salt"], how).drop("_salt")
