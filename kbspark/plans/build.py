"""Reusable plans: the KB of the driver tables and what is read from it.

Nothing is remembered in the session: the KB is a published version in a
catalog under the shared checkpoint folder, and shared intermediates are
written tables beside it. Both are found again, by any session, as long as the
files they were made from and the code stay as they are.
"""

from __future__ import annotations

import functools
import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.operators import kb as K
from kbspark.operators import pages as P
from kbspark.operators import retrieval as R
from kbspark.session import scratch_table_dir
from kbspark.sources import tables as S
from kbspark.sources.tables import read_table


@functools.cache
def _made_by() -> str:
    """Digest of the code that stored tables are made by."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    told = hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for name in sorted(os.listdir(os.path.join(root, part))):
            if name.endswith(".py"):
                with open(os.path.join(root, part, name), "rb") as f:
                    told.update(f.read())
    return told.hexdigest()


def _key(spark: SparkSession, sf_dir: str, what: str, *tables: str) -> str:
    """Names what is made from the tables of a folder, by the folder, the
    state of their files and the code, so that after a change it is made anew."""
    states = []
    for name in tables:
        files = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).select("_metadata.*")
        at = F.struct("file_modification_time", "file_path", "file_size")
        row = files.agg(F.count(F.lit(1)).alias("n"), F.max(at).cast("string").alias("last")).first()
        states.append((name, row["n"], row["last"]))
    told = hashlib.sha256(repr((_made_by(), sf_dir, *states)).encode()).hexdigest()[:24]
    return f"{what}-{told}"


def saved(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table under ``root``, made and written if it is not there. It is
    complete before its pointer file names it; the first pointer counts."""
    at, fs = S._file_system(spark, f"{root}/{name}.at")
    if not fs.exists(at):
        path = f"{root}/{name}-{uuid.uuid4().hex[:8]}"
        df = make()
        df.write.parquet(path)
        S.put_if_absent(spark, f"{root}/{name}.at", path)
    stream = fs.open(at)
    try:
        path = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return spark.read.parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])


def kb_catalog(spark: SparkSession, sf_dir: str) -> S.Catalog:
    return S.Catalog(spark, scratch_table_dir(spark, _key(spark, sf_dir, "kb", "documents")))


def kb_from_documents(spark: SparkSession, sf_dir: str) -> K.KB:
    """Entry A on the ``documents`` table: the published version, which is
    built and published first if there is none."""
    catalog = kb_catalog(spark, sf_dir)
    live = catalog.snapshot() or K.upsert(catalog, P.kb_input_from_documents(documents(spark, sf_dir)), only_on=0)
    return K.stored(live)


def upserted_catalog(spark: SparkSession, sf_dir: str) -> S.Catalog:
    """A KB that got the documents in two batches, even ids first: the second
    one is an upsert into the published first."""
    catalog = S.Catalog(spark, scratch_table_dir(spark, _key(spark, sf_dir, "kb-upserted", "documents")))
    docs = documents(spark, sf_dir)
    odd = F.coalesce(F.col("doc_id") % 2 != 0, F.lit(True))
    for number, batch in enumerate((docs.where(~odd), docs.where(odd))):
        if catalog.number() == number:
            K.upsert(catalog, P.kb_input_from_documents(batch), only_on=number)
    return catalog


def question_id():
    """q_id of a conversation turn: both numbers, so no two turns share one."""
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("q_id")


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions = user turns of ``conversations``."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.where(F.col("role") == "user").select(
        question_id(), F.col("text").alias("question"))


def _answers_root(spark: SparkSession, sf_dir: str) -> str:
    return scratch_table_dir(spark, _key(spark, sf_dir, "answers", "documents", "conversations"))


def retrieval(spark: SparkSession, sf_dir: str) -> R.Retrieval:
    """Q1-Q8 intermediates for all user questions, each a written table."""
    root = _answers_root(spark, sf_dir)
    return R.retrieve(user_questions(spark, sf_dir), lambda: kb_from_documents(spark, sf_dir),
                      keep=lambda make, name: saved(spark, root, name, make))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry B for all user questions against the documents KB, a written table."""
    return saved(spark, _answers_root(spark, sf_dir), "answers", lambda: R.answer(
        None, kb_from_documents(spark, sf_dir), retrieval=retrieval(spark, sf_dir)))
