"""Corpus building: union of chunk sources, id de-duplication, metadata projection, statistics, index sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skarn.functions.text import default_text
from skarn.plans.shared import materialize
from skarn.plans.skew import salted_join

METADATA = ("module", "doc_type", "source_file", "section", "method", "path")


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """UNION ALL in the given order; ``source_no`` keeps that order, missing columns are null."""
    out = None
    for n, (name, df) in enumerate(sources.items()):
        tagged = df.withColumns({"source_no": F.lit(n), "source_name": F.lit(name)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def metadata(df: DataFrame) -> list[Column]:
    """The metadata columns; a missing file falls back to the spec's name, a missing section to the operation id."""
    have = set(df.columns)
    col = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(""))
    return [
        default_text(F.col("module")).alias("module") if "module" in have else F.lit("").alias("module"),
        col("doc_type").alias("doc_type"),
        col("source_file", "spec_name").alias("source_file"),
        col("section", "operation_id").alias("section"),
        col("method").alias("method"),
        col("path").alias("path"),
    ]


def dedup_ids(df: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """The second and later rows of an id get ``id_position``: the position among all rows, from 0.

    The global position is the row's number in its range plus the rows of the ranges before, so no task holds all rows.
    """
    numbered = global_position(df, order)
    first = numbered.groupBy(id_col).agg(F.min("position").alias("_first"))
    joined = salted_join(numbered, first, id_col, "left", "position")
    repeat = F.col("position") > F.col("_first")
    return joined.withColumn("unique_id", F.when(repeat, F.concat_ws("_", F.col(id_col), F.col("position").cast("string"))).otherwise(F.col(id_col))).drop("_first")


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """A running number from 0 in the order of ``order`` (together unique), without a single-partition sort."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = materialize(ranged.withColumn("_mono", F.monotonically_increasing_id()), "position")  # the numbers must not be drawn twice
    part, at = F.shiftright("_mono", 33), F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = local.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    return local.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + at).drop("_part", "_before", "_mono")


def first_by_key(df: DataFrame, key: Column, order: list[str], keep: Column) -> DataFrame:
    """The first row of each key, then the filter: an invalid first row hides later ones of its key."""
    first = df.withColumn("_key", key).groupBy("_key").agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_r"))
    return first.select("_r.*").where(keep)


def length_stats(df: DataFrame, group: str, text: str = "text") -> DataFrame:
    """Count, smallest, upper median, largest and floored mean length by group, exact, from a histogram of lengths.

    The upper median is the element at count div 2; the histogram has one row a length, whatever the number of rows.
    """
    histogram = df.where(F.col(text).isNotNull()).groupBy(group, F.length(text).alias("n")).agg(F.count("*").alias("c"))
    order = Window.partitionBy(group).orderBy("n")
    total = Window.partitionBy(group)
    at = histogram.withColumns({"upto": F.sum("c").over(order), "total": F.sum("c").over(total)})
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n")))
    return at.groupBy(group).agg(
        F.sum("c").alias("rows"),
        F.min("n").alias("min_chars"),
        middle.alias("median_chars"),
        F.max("n").alias("max_chars"),
        F.floor(F.sum(F.col("n") * F.col("c")) / F.sum("c")).cast("long").alias("mean_chars"),
    )


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column alone, in one pass: (field, value, rows)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    return df.select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("rows"))


def write_index(df: DataFrame, path: str, embedder: str = "hash") -> DataFrame:
    """Vector table of (doc_id, text): embedded, written as a whole like a collection that is dropped and made again, and
    read back for searches."""
    from skarn.operators.retrieval import INDEX, index_texts

    index_texts(df, embedder).write.mode("overwrite").parquet(path)
    return read_index(df.sparkSession, path, INDEX)


def read_index(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
