"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.session import ensure_checkpoint_dir

#: A word: a run of code points other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"

#: A lookup table of at most this many rows (counted first) may be broadcast.
BROADCAST_ROWS = 50_000

#: A key that holds over 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE
#: keys are, and a table with one row for each may be broadcast.
HOT_SHARE = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder: it cuts the
    lineage, and a lost executor takes none of it along."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list]]:
    """The first two columns (an id and a text) of a task's rows, as lists,
    about ``most`` bytes of text at a time."""
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            t = t.as_py()
            ids.append(i)
            texts.append(t)
            size += len(t or "") + 16
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(key: Column) -> Column:
    """A never-null join key for a nullable string column."""
    return F.coalesce(F.concat(F.lit("="), key), F.lit(""))


def unit_draw(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) that the seed and the columns decide."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def join_lookup(left: DataFrame, right: DataFrame, key: str, n_right: int, salt_by: Column,
                salts: int = 64) -> DataFrame:
    """Inner join on ``key``, unique in ``right`` (``n_right`` rows): broadcast
    when the count allows it, else each right row goes to ``salts`` places so
    that a hot key's left rows are spread over as many tasks."""
    if n_right <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key)
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return (left.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
            .join(spread, [key, "_salt"]).drop("_salt"))


def join_hot(left: DataFrame, right: DataFrame, key: str, value: str, count: str, total: int,
             salt_by: Column) -> DataFrame:
    """``left`` plus the struct column ``value`` of ``right`` for the same
    ``key`` (unique in ``right``, whose ``count`` is the key's rows in left).
    The at most HOT_SHARE hot keys are looked up by broadcast; their left rows
    then take a random key into the shuffle join that serves all others."""
    hot = (right.where(F.col(count) * HOT_SHARE > total)
           .select(F.col(key), F.col(value).alias("_hot")))
    cold = right.where(F.col(count) * HOT_SHARE <= total).select(
        F.struct(F.lit(0).alias("_r"), F.col(key)).alias("_k"), F.col(value).alias("_cold"))
    step = left.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(
        F.lit(1) + F.pmod(F.xxhash64(salt_by), F.lit(1 << 20)).cast("int"))
    step = step.withColumn("_k", F.struct(spread.alias("_r"), F.col(key)))
    return (step.join(cold, "_k", "left")
            .withColumn(value, F.coalesce("_hot", "_cold")).drop("_hot", "_cold", "_k"))


def running_offset(group: list[str], order: str, n: str) -> Column:
    """Rows of the group's earlier parts, over a table with a row per part."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long")


def text_sha(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``decided`` (a table of doc_id,
    text_sha256 and kept, a row for each row of docs) keeps. Of rows equal in
    both, one stays: the first by its columns as JSON."""
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_sha") == F.col("text_sha256"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text_sha(F.col("text")).alias("_sha"), F.struct("*").alias("_row"))
    kept = rows.join(decided.where("kept").select("doc_id", "text_sha256"), same, "left_semi")
    equal = (decided.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
             .select("doc_id", "text_sha256").checkpoint())
    if equal.isEmpty():
        return kept.select("_row.*")
    once = (kept.join(equal, same, "left_semi").groupBy("_id", "_sha")
            .agg(F.min_by("_row", F.to_json("_row")).alias("_row")))
    return kept.join(equal, same, "left_anti").select("_row").unionAll(once.select("_row")).select("_row.*")
