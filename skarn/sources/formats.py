"""File sources and sinks: JSON lines with a stated schema, CSV with multi-line fields, whole texts, globs."""

from __future__ import annotations

import logging
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = logging.getLogger(__name__)
CHUNK = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "module", "doc_type", "source_file", "section", "method", "path", "text")])
TASK = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "module", "category", "difficulty", "question", "expected_answer", "evaluation_criteria")]
    + [T.StructField("required_operations", T.ArrayType(T.StringType())), T.StructField("source", T.StringType())]
)


def existing(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The patterns that match anything; absent sources are skipped with a message, as a missing result file is."""
    out = []
    for pattern in patterns:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if found is not None and len(found):
            out.append(pattern)
        else:
            LOG.warning("no source at %s, skipped", pattern)
    return out


def read_registry(spark: SparkSession, registry: list[tuple[str, str, str]]) -> DataFrame:
    """Whole texts of a stated list of (path, module, doc_type): (source_file, text, module, doc_type)."""
    out = None
    for path, module, doc_type in registry:
        if existing(spark, [path]):
            rows = read_whole(spark, path).withColumns({"module": F.lit(module), "doc_type": F.lit(doc_type)})
            out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "source_file string, text string, module string, doc_type string") if out is None else out


def read_jsonl(spark: SparkSession, patterns: list[str], schema: T.StructType) -> DataFrame:
    paths = existing(spark, patterns)
    return spark.read.schema(schema).json(paths) if paths else spark.createDataFrame([], schema)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, multi-line quoted fields, doubled quotes; all strings."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def read_whole(spark: SparkSession, pattern: str) -> DataFrame:
    """(source_file, text), one row a file."""
    return spark.read.option("wholetext", True).text(pattern).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source_file"), F.col("value").alias("text"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def append_by_config(df: DataFrame, path: str) -> None:
    """Each configuration's rows in a folder of their own, so a failed one loses no other."""
    df.write.mode("append").partitionBy("config").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def markdown_table(df: DataFrame, order: list[str]) -> str:
    """A report table (one row a configuration) as Markdown."""
    rows = df.orderBy(*order).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return "\n".join([head] + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows])


def review_sheet(df: DataFrame, path: str, reviewer: tuple[str, ...] = ("verdict", "notes")) -> None:
    """CSV with blank columns for a reviewer to fill."""
    write_csv(df.select("*", *[F.lit("").alias(c) for c in reviewer]), path)


def write_summary(df: DataFrame, path: str) -> None:
    """A report of some rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def int_cell(cell: Column) -> Column:
    """The whole number of a CSV cell, also where it is written as a decimal; null where it is blank or no number."""
    return F.trim(cell).try_cast("double").cast("int")


def stamped(prefix: str, suffix: str, at: datetime | None = None) -> str:
    """A file name with the time of its run."""
    return f"{prefix}_{(at or datetime.now()):%Y%m%d_%H%M%S}{suffix}"
