"""1. Mixing sources to target weights.

Tokens (words) are summed per source, targets follow from the weights, the
repetition rate of a source is target / size, and each document is emitted
floor(rate) times plus once more with the probability of the fraction, drawn
from a seeded hash.

Defined results: null text and text without a word count 0 and are emitted by
the rate of their source like any other; the null source is a source of its
own, last in order; a source of 0 words has target and rate 0; equal rows get
equal draws; an empty table gives an empty mix; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.operators.ids import dense_ids

WEIGHTS = (5.0, 2.0, 1.0)  # by order of the source, repeating
MAX_RATE = 3.0
SEED = 20_240_601


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS,
                   max_rate: float = MAX_RATE) -> tuple[DataFrame, int]:
    """From rows (source, size): one row per source (source, _key,
    source_size, target) and their number. The level that shares out all
    tokens is raised until no further target passes max_rate sizes; each round
    is one aggregation of the per-source table."""
    per = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("_null", F.col("source").isNull()))
    per = dense_ids(per, ["_null", "source"], "_ord", start=0)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("_w", F.element_at(cycle, (F.col("_ord") % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * F.lit(max_rate)).select(
        C.text_key(F.col("source")).alias("_key"), "source_size", "_w", "_cap").checkpoint()
    level, capped = 0.0, -1
    while True:
        at_cap = F.col("_cap") <= F.col("_w") * F.lit(level)
        r = per.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(at_cap, 1)).alias("capped"),
                    F.sum("source_size").alias("total"), F.sum(F.when(at_cap, F.col("_cap"))).alias("cap"),
                    F.sum(F.when(~at_cap, F.col("_w"))).alias("w")).first()
        if r["n"] == 0 or not r["w"] or r["capped"] == capped:
            break
        capped, level = r["capped"], (r["total"] - (r["cap"] or 0.0)) / r["w"]
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level))
    return per.select("_key", "source_size", target.alias("target")), r["n"]


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE,
        seed: int = SEED, extra: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, source, ``extra`` columns, size,
    source_size, target, rate, copies, taken."""
    size = C.word_count(F.col("text"))
    rows = docs.select("doc_id", "source", size.alias("size"),
                       C.unit_draw(seed, F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.col("text"))).alias("_u"),
                       *extra)
    targets, n = source_targets(docs.select("source", size.alias("size")), weights, max_rate)
    out = C.join_lookup(rows.withColumn("_key", C.text_key(F.col("source"))), targets, "_key", n,
                        F.struct("doc_id", "_u"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(max_rate))).otherwise(0.0)
    copies = F.floor("rate") + (F.col("_u") < F.col("rate") - F.floor("rate")).cast("long")
    return (out.withColumn("rate", rate).withColumn("copies", copies.cast("long"))
            .withColumn("taken", F.col("size") * F.col("copies")).drop("_key", "_u"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document's row as often as it is taken."""
    packed = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))
    mixed = mix(packed, extra=["_row"], **options).where("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("_row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op1 over all documents; adds source, rate and copies."""
    out = mix(C.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")

