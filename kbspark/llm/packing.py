"""5. Packing into optimal length buckets.

Lengths (words) go into one global histogram; dynamic programming over it
chooses the bucket boundaries that minimise padding; inside each bucket,
batches are cut so that batch rows times bucket length stay in the budget.

Defined results: null and empty texts have length 0 and are packed too; equal
rows get places of their own; a document longer than the budget is a batch of
its own; an empty table gives an empty result; other columns are not read by
the query and are kept, untouched, by ``pack``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C

BUCKETS = 16
TOKEN_BUDGET = 32_768
EXACT_LENGTHS = 1_024  # longer lengths share bins,
PER_OCTAVE = 64        # so many for each doubling: the histogram is bounded
PARTS = 512            # hash parts that a bucket is ranked in


def length_bin(length):
    """Bin of a length: the length itself, or a step of the log scale."""
    over = F.floor(F.log2(length / F.lit(EXACT_LENGTHS)) * PER_OCTAVE).cast("long")
    return F.when(length < EXACT_LENGTHS, length).otherwise(F.lit(EXACT_LENGTHS) + over)


def boundaries(top: np.ndarray, n: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Bucket lengths of least total padding: bins (ascending, with largest
    length ``top`` and ``n`` rows) are cut into at most ``buckets`` runs, each
    padded to its last bin's top. O(buckets * bins^2), vectorised by bin."""
    m = len(top)
    if not m:
        return []
    cum = np.concatenate([[0], np.cumsum(n)]).astype(np.float64)
    top = top.astype(np.float64)
    cost = top * cum[1:]  # one bucket over bins 0..j; the lengths' own sum is constant
    choice = []
    for _ in range(1, min(buckets, m)):
        new, pick = np.empty(m), np.zeros(m, np.int64)
        for j in range(m):
            # the last bucket starts at bin i + 1, the rest ends at i; or there is no rest
            v = cost[:j] + top[j] * (cum[j + 1] - cum[1:j + 1])
            i = int(np.argmin(v)) if j else -1
            new[j], pick[j] = (v[i], i) if j and v[i] < cost[j] else (cost[j], -2)
        choice.append(pick)
        cost = new
    ends, j, k = [], m - 1, len(choice)
    while j >= 0:
        ends.append(int(top[j]))
        while k and choice[k - 1][j] == -2:  # fewer buckets do as well
            k -= 1
        if not k:
            break
        j, k = int(choice[k - 1][j]), k - 1
    return ends[::-1]


def pack(rows: DataFrame, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """From rows (doc_id, length, ...): adds bucket, bucket_length, batch and
    batch_row. One aggregation gives the histogram and the sizes of the hash
    parts that buckets are ranked in: a row's place is the rows of the earlier
    parts plus its place in the part, so that no task sorts a whole bucket."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "length"), F.lit(PARTS)).cast("int"))
    cells = C.written(rows.groupBy(length_bin(F.col("length")).alias("_bin"), "_part")
                      .agg(F.max("length").alias("top"), F.count(F.lit(1)).alias("n")), "lengths")
    hist = cells.groupBy("_bin").agg(F.max("top").alias("top"), F.sum("n").alias("n")).collect()  # a few thousand bins
    hist.sort(key=lambda r: r["_bin"])
    ends = boundaries(np.array([r["top"] for r in hist], np.int64), np.array([r["n"] for r in hist], np.int64), buckets) or [0]

    def bucket_of(length):
        out = F.lit(len(ends) - 1)
        for i, end in reversed(list(enumerate(ends[:-1]))):
            out = F.when(length <= end, F.lit(i)).otherwise(out)
        return out

    parts = cells.groupBy(bucket_of(F.col("top")).alias("bucket"), "_part").agg(F.sum("n").alias("_n"))  # a bin is in one bucket
    offs = parts.select("bucket", "_part", C.running_offset(["bucket"], "_part", "_n").alias("_off"))
    place = F.row_number().over(Window.partitionBy("bucket", "_part").orderBy("doc_id", "length"))
    rows = (rows.withColumn("bucket", bucket_of(F.col("length"))).withColumn("_rn", place)
            .join(F.broadcast(offs), ["bucket", "_part"]))  # buckets * PARTS rows at most
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), F.col("bucket_length"))))
    at = F.col("_off") + F.col("_rn") - 1
    return (rows.withColumn("bucket_length", F.array(*[F.lit(e).cast("long") for e in ends])[F.col("bucket")])
            .withColumn("batch", F.floor(at / room).cast("long"))
            .withColumn("batch_row", (at - F.floor(at / room) * room).cast("int")).drop("_part", "_off", "_rn"))


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, with length, bucket, bucket_length, batch
    and batch_row; a column of the input with such a name gives way."""
    rows = docs.select("doc_id", C.word_count(F.col("text")).alias("length"), F.struct("*").alias("_row"))
    made = ["length", "bucket", "bucket_length", "batch", "batch_row"]
    return pack(rows, **options).select(*[F.col("_row")[c].alias(c) for c in docs.columns if c not in made], *made)


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, length, bucket, bucket_length, batch (within the
    bucket), batch_row and padding."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", C.word_count(F.col("text")).alias("length"))
    out = pack(docs).withColumn("padding", F.col("bucket_length") - F.col("length"))
    return out.select("doc_id", "length", "bucket", "bucket_length", "batch", "batch_row", "padding")
