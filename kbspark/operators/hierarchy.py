"""Heading hierarchy (K8) and completion progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.session import ensure_checkpoint_dir

ROOT_ID = 1  # heading id of ROOT, whose path is empty

def ancestor_pairs(headings: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, depth >= 1) by equi-join on path prefixes
    (a heading's path is a proper prefix of its descendants' paths).
    Rows = sum of heading depths; no recursion, no pairs beyond the tree.
    Every heading descends from ROOT: those rows need no join on the empty
    path, which would bring all headings to one key."""
    below = headings.where(F.size("path") > 0)
    root = below.select(F.lit(ROOT_ID).cast("long").alias("ancestor_id"), F.col("heading_id").alias("descendant_id"),
                        F.size("path").alias("depth"))
    pref = below.where(F.size("path") > 1).select(F.col("heading_id").alias("descendant_id"), "path",
                                                  F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("k"))
    pref = pref.select("descendant_id", F.slice("path", 1, F.col("k")).alias("apath"),
                       (F.size("path") - F.col("k")).alias("depth"))
    anc = headings.select(F.col("heading_id").alias("ancestor_id"), F.col("path").alias("apath"))
    return pref.join(anc, "apath").select("ancestor_id", "descendant_id", "depth").unionByName(root)


def hierarchy(headings: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """K8: for each heading id (all, or those in ``ids``): itself (index 0),
    its descendants (index +depth) and ancestors (index -depth)."""
    pairs = ancestor_pairs(headings)
    down = pairs.select(F.col("ancestor_id").alias("heading_id"), F.col("descendant_id").alias("related_id"),
                        F.col("depth").alias("idx"))
    up = pairs.select(F.col("descendant_id").alias("heading_id"), F.col("ancestor_id").alias("related_id"),
                      (-F.col("depth")).alias("idx"))
    self_ = headings.select("heading_id", F.col("heading_id").alias("related_id"), F.lit(0).alias("idx"))
    out = down.unionByName(up).unionByName(self_)
    if ids is not None:
        out = out.join(ids.select("heading_id"), "heading_id", "left_semi")
    return out.select("heading_id", "related_id", F.col("idx").cast("int").alias("idx"))


# ---------------------------------------------------------------------------
# FIXED VALUE: weight of the previous average rate in the progress estimate.
# ---------------------------------------------------------------------------
SMOOTHING = 0.05


def progress(log: DataFrame, job_col: str = "job", ts_col: str = "ts", order_col: str | None = None) -> DataFrame:
    """K14 over a completion log (one row per completed item of a job):
    n-th completion -> percent done and estimated seconds left.

    rate = 0.05 * previous average rate + 0.95 * current average rate, both
    measured from the job's first timestamp; the first row has previous
    rate 0; a zero elapsed time gives a NULL estimate instead of failing.

    A job may hold a large share of the log, so it is never placed in one
    task: rows are range-partitioned on (job, ts), ranked inside each
    (partition, job), and shifted by the row counts of the job's earlier
    partitions, taken from a summary with one row per (partition, job).
    """
    keys = [job_col, ts_col] + ([order_col] if order_col else [])
    nparts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the range bounds are sampled: the stamps are materialised, so that ranks
    # and offsets see the same partitions whatever the plan reuses
    ensure_checkpoint_dir(log.sparkSession)
    ranged = (log.select(*dict.fromkeys(keys)).repartitionByRange(nparts, *keys)
              .withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True))
    local = Window.partitionBy("_pid", job_col).orderBy(*keys)
    rows = ranged.withColumn("_k", F.row_number().over(local)).withColumn("_prev", F.lag(ts_col).over(local))
    job_parts = Window.partitionBy(job_col).orderBy("_pid")
    job_all = Window.partitionBy(job_col)
    summary = (rows.groupBy("_pid", job_col)
               .agg(F.count(F.lit(1)).alias("_c"), F.max(ts_col).alias("_last"), F.min(ts_col).alias("_first"))
               .withColumn("_off", F.coalesce(F.sum("_c").over(
                   job_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("_prev_last", F.lag("_last").over(job_parts))
               .withColumn("total", F.sum("_c").over(job_all))
               .withColumn("start", F.min("_first").over(job_all))
               .select("_pid", job_col, "_off", "_prev_last", "total", "start"))
    df = (rows.join(summary, ["_pid", job_col])
          .withColumn("n", F.col("_off") + F.col("_k"))
          .withColumn("prev_ts", F.coalesce("_prev", "_prev_last", "start")))
    secs = lambda a, b: (F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))) / 1e6
    p_delta, c_delta = secs("prev_ts", "start"), secs(ts_col, "start")
    p_rate = F.when(F.col("n") == 1, F.lit(0.0)).when(p_delta > 0, (F.col("n") - 1) / p_delta)
    c_rate = F.when(c_delta > 0, F.col("n") / c_delta)
    rate = F.lit(SMOOTHING) * p_rate + F.lit(1 - SMOOTHING) * c_rate
    percent = F.round((F.col("n") * 100).cast("decimal(38,10)") / F.col("total").cast("decimal(38,10)"), 2)
    eta = F.when(rate > 0, F.floor((F.col("total") - F.col("n")) / rate))
    return df.select(job_col, F.col("n").cast("int").alias("n"), F.col("total").cast("long").alias("total"),
                     percent.cast("double").alias("percent"), eta.cast("long").alias("eta"))
