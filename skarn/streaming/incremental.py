"""Incremental ingest: new chunk files re-index as they arrive, judged results are never judged twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skarn.sources.formats import existing


def index_stream(spark: SparkSession, folder: str, schema: T.StructType, index: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append to ``index`` the chunks of new files whose id it does not hold; within a batch the first row of an id wins."""

    def write(batch: DataFrame, _: int) -> None:
        columns = batch.columns
        fresh = batch.groupBy("id").agg(F.min_by(F.struct(*columns), F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in columns])).alias("r")).select("r.*")
        if existing(spark, [index]):
            known = spark.read.schema(schema).parquet(index).select("id")
            fresh = fresh.join(known, "id", "left_anti")
        fresh.write.mode("append").parquet(index)

    source = spark.readStream.schema(schema).json(folder)
    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def unjudged(results: DataFrame, judged: DataFrame, keys: tuple[str, ...] = ("task_id", "config")) -> DataFrame:
    """Rows still to be judged, so scoring can be resumed after a failure."""
    return results.join(judged.where(F.coalesce("score", F.lit(-1)) > 0).select(*keys).distinct(), list(keys), "left_anti")
