"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.session import save, shuffle_partitions


def with_rank(df: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """Adds the row number (from 1) in the given order, which should be total. Rows are range-partitioned and sorted;
    the counts of the partitions before, one number a partition, are added to the place inside the partition."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = save(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}), "ranked")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_place").alias("_first")).orderBy("_part").collect()
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["_part"], before - r["_first"] + 1))
        before += r["n"]
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _shift long")
    return placed.join(F.broadcast(shift), "_part").withColumn(name, F.col("_place") + F.col("_shift")).drop("_part", "_place", "_shift")
