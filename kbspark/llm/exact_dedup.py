"""9. Exact dedup by content-defined chunk recipes.

Texts are cut where a rolling window of their bytes decides, so equal passages
give equal chunks wherever they stand. Every distinct chunk moves once, to be
verified against all others with its identifier; a text then is its recipe,
the ordered list of verified identifiers, and only recipes are compared.

Defined results: null counts as empty text, whose recipe is the empty list;
among equal texts the largest doc_id stays, null ids rank lowest, and of equal
rows exactly one stays; an empty table gives an empty result; ``keep`` passes
other columns through and breaks ties of (doc_id, text) by their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C

MIN_CHUNK = 512
MEAN_BITS = 11  # a boundary every 2 KB or so behind the minimum
MAX_CHUNK = 8_192
ID_BYTES = 16
SEEN = 20_000  # recent chunks of a task, by identifier and SHA-256, that are not sent again
YIELD_BYTES = 4_000_000  # chunks handed to Spark at a time
WINDOW = np.uint64(0x9E3779B97F4A7C15)  # odd multiplier of the 8-byte window


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of ``text``."""
    n = len(text)
    if n <= MIN_CHUNK:
        return [n] if n else []
    raw = np.frombuffer(text, np.uint8)
    view = np.lib.stride_tricks.as_strided(raw[:8].view("<u8"), (n - 7,), (1,))
    marks = np.flatnonzero((view * WINDOW) >> np.uint64(64 - MEAN_BITS) == 0) + 8
    ends, at = [], 0
    while n - at > MIN_CHUNK:
        k = int(np.searchsorted(marks, at + MIN_CHUNK))
        at = min(int(marks[k]) if k < len(marks) else n, at + MAX_CHUNK, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks_of(text: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    for end in cuts(text):
        chunk = text[at:end]
        yield hashlib.blake2b(chunk, digest_size=ID_BYTES).digest(), chunk
        at = end


def recipes(docs: DataFrame, id_bytes: int = ID_BYTES, texts: bool = False) -> DataFrame:
    """One row per document: doc_id, recipe, text_sha256 (and text_utf8)."""
    fields = [("doc_id", pa.int64()), ("recipe", pa.binary()), ("text_sha256", pa.string())]
    schema = pa.schema(fields + [("text_utf8", pa.binary())] * texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            recs, shas = [], []
            for x in b.column(1):
                text = x.as_py() or b""
                recs.append(b"".join(i[:id_bytes] for i, _ in chunks_of(text)))
                shas.append(hashlib.sha256(text).hexdigest())
            cols = [b.column(0), pa.array(recs, pa.binary()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [b.column(1)] * texts, schema=schema)

    src = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, recipe binary, text_sha256 string" + ", text_utf8 binary" * texts)


def chunks(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """chunk_id and chunk, without those that the same task met lately: skipped
    only if the identifier and a second, independent hash agree."""
    schema = pa.schema([("chunk_id", pa.binary()), ("chunk", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[bytes, bytes]] = set()
        for b in batches:
            ids, parts, size = [], [], 0
            for x in b.column(0):
                for i, chunk in chunks_of(x.as_py() or b""):
                    both = i[:id_bytes], hashlib.sha256(chunk).digest()
                    if both in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(both)
                    ids.append(i[:id_bytes])
                    parts.append(chunk)
                    size += len(chunk)
                if size > YIELD_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], schema=schema)
                    ids, parts, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(parts, pa.binary())], schema=schema)

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "chunk_id binary, chunk binary")


def clashes(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """Identifiers that stand for more than one chunk: every distinct chunk is
    moved once and compared in full with those of its identifier."""
    distinct = chunks(docs, id_bytes).groupBy("chunk_id", "chunk").agg(F.lit(1))
    return distinct.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("chunk_id")


def verified_recipes(docs: DataFrame, id_bytes: int = ID_BYTES) -> DataFrame:
    """_uid, doc_id, recipe and text_sha256, as a table. A text with an
    identifier that proved ambiguous is compared by its bytes instead."""
    recs = C.written(recipes(docs, id_bytes).withColumn("_uid", F.monotonically_increasing_id()), "recipes")
    bad = clashes(docs, id_bytes).checkpoint()
    if bad.isEmpty():
        return recs
    steps = F.sequence(F.lit(1), F.length("recipe"), F.lit(id_bytes))
    parts = F.when(F.length("recipe") > 0, F.transform(steps, lambda i: F.substring("recipe", i, F.lit(id_bytes))))
    doubtful = (recs.select("recipe").distinct().withColumn("chunk_id", F.explode(parts))
                .join(bad, "chunk_id", "left_semi").select("recipe").distinct().checkpoint())
    full = recipes(docs, id_bytes, texts=True).join(doubtful, "recipe", "left_semi")
    full = full.select("doc_id", F.concat(F.lit("text:").cast("binary"), "text_utf8").alias("recipe"), "text_sha256")
    sure = recs.join(doubtful, "recipe", "left_anti").select("doc_id", "recipe", "text_sha256")
    return C.written(sure.unionByName(full).withColumn("_uid", F.monotonically_increasing_id()), "recipes")


def decide(recs: DataFrame) -> DataFrame:
    """Adds keep_id, group_size and kept to verified recipes."""
    groups = recs.groupBy("recipe").agg(F.max(F.struct("doc_id", "_uid")).alias("_top"), F.count(F.lit(1)).alias("_n"))
    groups = groups.select("recipe", F.struct("_top", "_n").alias("_g"), "_n")
    out = C.join_hot(recs, groups, "recipe", "_g", "_n", recs.count(), F.col("_uid"))
    return out.select("doc_id", F.col("_g._top.doc_id").alias("keep_id"), F.col("_g._n").alias("group_size"),
                      (F.col("_uid") == F.col("_g._top._uid")).alias("kept"), "text_sha256")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns."""
    return C.keep_rows(docs, C.written(decide(verified_recipes(docs)), "exact-kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op9 over all documents."""
    return decide(verified_recipes(C.table(spark, sf_dir, "documents").select("doc_id", "text")))


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
