"""3. Sharding by fixed virtual slots (native).

Records are hashed into SLOTS virtual slots, bytes are summed per slot, and a
slot-to-shard map is stored as a version in the shared folder. Moving data
means editing the map (``grow``), never rehashing records.

The law of the query is `bytes`: slots go to shards largest first, each to the
least loaded shard, so that shard sizes are near equal.

Defined results: null text has 8 bytes and checksum 0, as empty text; null ids
hash as such; equal rows share a slot; an empty table still gets a full map;
other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.session import ensure_checkpoint_dir

SLOTS = 4096
SHARDS = 24
SEED = 7
RECORD_BYTES = 8  # counted besides the text
MAP_SCHEMA = "vslot int, bytes long, n_rows long, shard int"


def records(docs: DataFrame, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each document."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    return docs.select(
        "doc_id", (C.utf8_size(F.col("text")) + F.lit(RECORD_BYTES)).alias("size"), crc.alias("text_crc32"),
    ).withColumn("vslot", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text_crc32"), F.lit(slots)).cast("int"))


def slot_map(spark: SparkSession, recs: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """MAP_SCHEMA rows for all slots. The slots, a fixed number, are folded in
    one row: each in turn, largest first, goes to the least loaded shard."""
    sums = recs.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n_rows"))
    full = spark.range(slots).select(F.col("id").cast("int").alias("vslot")).join(sums, "vslot", "left").na.fill(0)
    one = full.agg(F.collect_list(F.struct("bytes", "vslot", "n_rows")).alias("s"))
    folded = one.select(F.expr(f"""
        aggregate(
          reverse(array_sort(s)),
          named_struct('loads', array_repeat(0L, {shards}),
                       'out', cast(array() as array<struct<vslot:int,bytes:bigint,n_rows:bigint,shard:int>>)),
          (acc, x) -> named_struct(
            'loads', transform(acc.loads, (l, i) ->
                if(i = array_position(acc.loads, array_min(acc.loads)) - 1, l + x.bytes, l)),
            'out', array_append(acc.out, named_struct(
                'vslot', x.vslot, 'bytes', x.bytes, 'n_rows', x.n_rows,
                'shard', cast(array_position(acc.loads, array_min(acc.loads)) - 1 as int)))),
          acc -> acc.out)""").alias("m"))
    return folded.select(F.inline("m"))


def new_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/slot-map-{uuid.uuid4().hex}"


def store(m: DataFrame, root: str, version: int) -> None:
    """Versions are written once and never changed."""
    m.coalesce(1).write.parquet(f"{root}/version={version}")


def load(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema(MAP_SCHEMA).parquet(f"{root}/version={version}")


def grow(m: DataFrame, shards: int) -> DataFrame:
    """The map for one more shard: each old shard hands over slots while it
    stays at or above the new mean; no slot moves between old shards."""
    w = Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0)
    means = m.groupBy("shard").agg(F.sum("bytes").alias("_load"))
    total = m.agg((F.sum("bytes") / F.lit(shards + 1)).alias("_mean"))
    step = m.join(F.broadcast(means), "shard").withColumn("_mean", F.lit(total.first()[0] or 0.0))
    gone = F.sum("bytes").over(w) <= F.col("_load") - F.col("_mean")
    return step.select("vslot", "bytes", "n_rows", F.when(gone, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def assign(recs: DataFrame, m: DataFrame) -> DataFrame:
    """Records with their shard and their place in it (gapless from 0): the
    rows of the shard's earlier slots, then the place within the slot."""
    offs = F.broadcast(m.select("vslot", "shard", C.running_offset(["shard"], "vslot", "n_rows").alias("_off")))
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    return (recs.withColumn("_rn", place).join(offs, "vslot")
            .withColumn("slot", F.col("_off") + F.col("_rn").cast("long") - 1).drop("_off", "_rn"))


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op3 over all documents (law `bytes`); `slot` is the row's
    place in its shard; adds vslot, the virtual slot."""
    recs = records(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    root = new_root(spark)
    store(slot_map(spark, recs), root, 1)
    out = assign(recs, load(spark, root, 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "vslot")
