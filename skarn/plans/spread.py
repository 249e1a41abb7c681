"""Enough tasks for work that is heavy for its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the scan has fewer splits than there are cores; a larger scan stays as it is.

    A table of one row group is one task however many cores wait. Dealing it out moves at most a split a core.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores)
