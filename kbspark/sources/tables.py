"""Sources and sinks (S1-S10): driver tables, word lists, KB catalog.

Driver tables are read with the schema of their files, KB tables with an
explicit one. Writes go to folders (parquet). A KB version is a list of
segments, folders that are written in full and then never changed; publishing
it creates the next numbered pointer file, which fails if that number is
there, so that two publishers cannot tie and readers, also of other sessions,
never see a half-built KB.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from kbspark.sources import wordlists as W

DRIVER_SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
               "o_orderdate timestamp_ntz, o_orderpriority string"),
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                 "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                 "l_linestatus string, l_shipdate timestamp_ntz"),
}

KB_SCHEMAS = {
    "headings": "heading_id long, heading string, parent_id long, path array<string>",
    "sentences": "sentence_id long, sentence string, dependencies array<string>, heading_id long",
    "entities": "entity_id long, entity string",
    "normalizations": "sentence_id long, entity_id long",
    "frame_index": "frame string, sentence_id long",
    "heading_info": "heading_id long, first_sentence_id long, last_sentence_id long, heading string",
    "frame_cache": "key string, frames array<string>",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Scan of a driver table (columns pruned at the scan when ``columns``
    is given)."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    return df


def count_rows(df: DataFrame) -> DataFrame:
    """S2."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def append(df: DataFrame, path: str) -> None:
    """S3."""
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """S4."""
    df.write.mode("overwrite").parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing table reads as an empty one."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jvm_path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def word_list_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Header-less CSV word list, cells trimmed."""
    return (spark.read.schema(schema).option("header", "false")
            .option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").csv(path))


def acronyms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(W.ACRONYMS, "term string, acronym string")


def entity_forced(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in W.ENTITY_FORCED], "entity string")


def entity_stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(e,) for e in W.ENTITY_STOPWORDS], "entity string")


def stopwords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in W.STOPWORDS], "word string")


def lexical_units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(W.LEXICAL_UNITS, "unit string, frame string")


def lemmas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, p, l) for (f, p), l in W.LEMMAS.items()], "form string, pos string, lemma string")


def lexicon(spark: SparkSession) -> DataFrame:
    from kbspark.functions.text import wordnet_class
    rows = [(f, t) for f, t in W.LEXICON_TAGS.items()]
    df = spark.createDataFrame(rows, "form string, tag string").withColumn("pos", wordnet_class(F.col("tag")))
    return df.join(lemmas(spark), ["form", "pos"], "left").select("form", "pos", "tag", F.coalesce("lemma", "form").alias("lemma"))


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file with all its content at once; False if one of that
    name is there. A finished file is moved to the name without overwriting
    (on a local disk, linked: its rename would overwrite)."""
    jvm = spark.sparkContext._jvm
    at, fs = _file_system(spark, path)
    fs.mkdirs(at.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(at.getParent(), f"_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = [jvm.java.io.File(x.toUri().getPath()).toPath() for x in (at, draft)]
            jvm.java.nio.file.Files.createLink(*local)
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            how = spark.sparkContext._gateway.new_array(kind, 1)
            how[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), fs.getConf()).rename(draft, at, how)
        return True
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(draft, False)


@dataclass(frozen=True)
class Snapshot:
    """A published version: what a reader that holds it sees never changes."""
    spark: SparkSession
    number: int
    version: str
    segments: tuple[str, ...]

    def table(self, name: str) -> DataFrame:
        """A table over all segments. A heading's sentences may lie in several:
        ``heading_info`` has one row for each and the rows are merged."""
        df = self.spark.read.schema(KB_SCHEMAS[name]).parquet(*[f"{s}/{name}" for s in self.segments])
        if name != "heading_info" or len(self.segments) == 1:
            return df
        return df.groupBy("heading_id").agg(F.min("first_sentence_id").alias("first_sentence_id"),
                                            F.max("last_sentence_id").alias("last_sentence_id"), F.first("heading").alias("heading"))


class Catalog:
    """KB tables under a root folder, versioned. ``publish`` makes a
    fully written version the live one; the highest number counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def version_dir(self, version: str) -> str:
        return f"{self.root}/v={version}"

    def create(self, version: str) -> None:
        """Empty tables with explicit schemas plus the ROOT heading."""
        for name, schema in KB_SCHEMAS.items():
            df = self.spark.createDataFrame([], schema)
            if name == "headings":
                df = self.spark.createDataFrame([(1, "ROOT", None, [])], schema)
            df.write.mode("overwrite").parquet(f"{self.version_dir(version)}/{name}")

    def write(self, version: str, tables: dict[str, DataFrame]) -> None:
        """Tables of a version, with the columns of KB_SCHEMAS in their order."""
        for name, df in tables.items():
            cols = [f.name for f in self.spark.createDataFrame([], KB_SCHEMAS[name]).schema]
            df.select(*cols).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.version_dir(version)}/{name}")

    def drop(self, version: str) -> None:
        """A version back to empty tables (ids restart at ROOT)."""
        self.create(version)

    def read(self, version: str, name: str) -> DataFrame:
        return read_or_empty(self.spark, f"{self.version_dir(version)}/{name}", KB_SCHEMAS[name])

    def publish(self, version: str, base: Snapshot | None = None, expect: int | None = None) -> int | None:
        """One pointer file switches all tables at once. The version's own
        folder comes behind the segments of ``base``. Returns the number it
        got. With ``expect``, it must follow that number (0: be the first);
        None if another publisher was faster."""
        segments = [*(base.segments if base else ()), self.version_dir(version)]
        while True:
            number = (self.number() if expect is None else expect) + 1
            if put_if_absent(self.spark, f"{self.root}/live/{number:012d}", json.dumps({"version": version, "segments": segments})):
                return number
            if expect is not None:
                return None

    def number(self) -> int:
        """The number published last; 0 before the first."""
        at, fs = _file_system(self.spark, f"{self.root}/live")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return max([int(n) for n in names if n.isdigit()], default=0)

    def snapshot(self, number: int | None = None) -> Snapshot | None:
        """The live version, or the one of a number, for a reader to hold."""
        number = number or self.number()
        if not number:
            return None
        at, fs = _file_system(self.spark, f"{self.root}/live/{number:012d}")
        stream = fs.open(at)
        try:
            told = json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Snapshot(self.spark, number, told["version"], tuple(told["segments"]))

    def live(self) -> str | None:
        """The version published last, or None."""
        now = self.snapshot()
        return now and now.version

    def live_table(self, name: str) -> DataFrame:
        """A table of the live version; empty before the first publish."""
        now = self.snapshot()
        return now.table(name) if now else self.spark.createDataFrame([], KB_SCHEMAS[name])
