"""Dense ordered ids (K6) without a one-partition sort.

Rows are range-partitioned and sorted on a unique order key, stamped with
partition id and position, and materialised once (reliable checkpoint in
the shared ``spark.checkpoint.dir``) so the stamps stay stable if a task is
re-run. Per-partition counts (one row per partition, so their size is
bounded by the partition count) give the offsets, joined back by broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import Keep, checkpointed, ensure_checkpoint_dir


def dense_ids(df: DataFrame, order_cols: list[str], id_col: str, start: int = 1,
              num_partitions: int | None = None, keep: Keep = checkpointed) -> DataFrame:
    """Add ``id_col`` = start, start+1, ... following ``order_cols`` (which
    must be unique per row). ``keep`` materialises the stamped rows."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stamped = keep(df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
                   .withColumn("_pid", F.spark_partition_id())
                   .withColumn("_mid", F.monotonically_increasing_id()), f"numbered-{id_col}")
    counts = stamped.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (stamped.join(F.broadcast(offsets.select("_pid", "_off", "_m0")), "_pid")
            .withColumn(id_col, (F.col("_off") + F.col("_mid") - F.col("_m0") + F.lit(start)).cast("long"))
            .drop("_pid", "_mid", "_m0", "_off"))
