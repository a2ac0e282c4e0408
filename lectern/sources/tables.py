"""Tables between the steps of a job: they end lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the folder that all machines share: spark.checkpoint.dir, or on one machine one of our own."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='lectern-')}"
    path = f"{folder.rstrip('/')}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal an input of fewer files than cores anew, so that one small file is not one task; a larger one stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def placed(df: DataFrame, by: str, order: list[Column], name: str) -> DataFrame:
    """Adds name: the place of each row, from 1, among those of its `by` in that order, whatever the size of a group.

    Rows are sorted by ranges and written, so that no task gets a whole group; only counts of ranges are added up.
    """
    rows = staged(df.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    runs = rows.groupBy(F.col(by).alias("_by"), F.shiftright("_at", 33).alias("_range")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_by", "_range", (F.coalesce(before, F.lit(0)) + 1 - F.col("_from")).alias("_more"))
    met = rows.join(runs, F.col(by).eqNullSafe(F.col("_by")) & (F.shiftright("_at", 33) == F.col("_range")))
    return met.select(*df.columns, (F.col("_at") + F.col("_more")).cast("int").alias(name))
