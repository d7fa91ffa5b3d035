"""11. Ranked lexical search with norm buckets.

A document is the vector of its terms' impacts, an item that of its terms with
repeats; the score is their product, weighted by term. Both take the square
root of the weight, so that the product of the two lengths bounds the score.

Vectors are ordered by length and read in buckets. A first pass adds up each
item's heaviest terms over all documents: the tenth best sum is a score that
ten documents reach, so what cannot reach it is out. In the second pass a
bucket is skipped for an item if Cauchy-Schwarz keeps its longest vector below
the item's threshold; inside a bucket, exact products on the item's heaviest
coordinates plus Cauchy-Schwarz on all others bound each document; what
survives is scored in 64-bit integers. Thresholds rise as a task finds better
ones. Float bounds give way by ``SLACK``, so nothing is lost to rounding.

Items are taken in blocks of bounded text size: the terms of a block are the
coordinates, documents without any of them are left out of its vectors (their
score is 0), but count in N and L.

Defined results: rows with equal item_id and text are one item, different
texts under one item_id (or a null one) are items each; null or empty item
texts find nothing; null texts have no term; equal documents are ranked each;
null doc_ids rank last among equals; no documents or no items give an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C

TOP = 10
BLOCK_BYTES = 4_000_000   # of item text at once (one longer text is a block)
BUCKET = 2_048            # documents
SCAN_BYTES = 4_000_000
FOCUS_SHARE = 0.7         # of an item's squared length on its focus coordinates,
FOCUS = 12                # so many at most
SLACK = 1e-9

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCANNED = "doc_id long, n long, terms binary, tf binary, _task int, _place long, docs long, tokens long, df_terms array<int>, df array<long>"
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """UTF-8 terms; bytes lower-case A-Z alone."""
    return TERM.findall(text.encode().lower()) if text else []


# ---- vectors --------------------------------------------------------------

def scanned(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """SCANNED rows: a document that has terms of the block, and one row for
    each task with its documents, tokens and document counts of those terms."""
    shared = docs.sparkSession.sparkContext.broadcast(number)  # terms of at most BLOCK_BYTES of text
    names = [x.split()[0] for x in SCANNED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = shared.value, TaskContext.get().partitionId()
        other, place, n_docs, n_tokens = len(number), 0, 0, 0
        df = np.zeros(other, np.int64)
        for ids, texts in C.text_batches(batches, SCAN_BYTES):
            rows = []
            for i, t in zip(ids, texts):
                found = terms_of(t)
                n_docs, n_tokens = n_docs + bool(found), n_tokens + len(found)
                at = np.fromiter(map(number.get, found, repeat(other)), np.int64, len(found))
                at, tf = np.unique(at[at < other], return_counts=True)
                if len(at):
                    df[at] += 1
                    place += 1
                    rows.append((i, len(found), at.astype("<i4").tobytes(), tf.astype("<i4").tobytes(), task, place, *[None] * 4))
            yield batch(rows)
        some = np.flatnonzero(df)
        yield batch([(*[None] * 6, n_docs, n_tokens, some, df[some])])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: int, n_docs: int, n_tokens: int) -> np.ndarray:
    m = 25 + (75 * n * n_docs) // n_tokens
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def vectors(rows: DataFrame, weight: np.ndarray, n_docs: int, n_tokens: int) -> DataFrame:
    """Documents by falling length: doc_id, norm, terms, impacts."""
    shared = rows.sparkSession.sparkContext.broadcast(weight.astype(float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for b in batches:
            norm, out = [], []
            for n, at, tf in zip(b.column("n").to_pylist(), b.column("terms"), b.column("tf")):
                x = impacts(np.frombuffer(tf.as_py(), "<i4"), n, n_docs, n_tokens)
                w = weight[np.frombuffer(at.as_py(), "<i4")]
                norm.append(math.sqrt((w * x.astype(float) ** 2).sum()))
                out.append(x.astype("<i4").tobytes())  # below a million
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(norm, pa.float64()), b.column("terms"), pa.array(out, pa.binary()), b.column("_task"), b.column("_place")],
                names=["doc_id", "norm", "terms", "impacts", "_task", "_place"])

    made = rows.mapInArrow(run, "doc_id long, norm double, terms binary, impacts binary, _task int, _place long")
    # ties in length are dealt by a hash of the row's own place: copies do not meet in one task
    by = [F.col("norm").desc(), F.xxhash64("_task", "_place")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("doc_id", "norm", "terms", "impacts")


class Bucket:
    """Up to BUCKET documents in columns by term."""

    def __init__(self, b: pa.RecordBatch):
        self.ids, self.norm = b.column("doc_id").to_pylist(), b.column("norm").to_numpy()
        at = [x.as_py() for x in b.column("terms")]
        term = np.frombuffer(b"".join(at), "<i4")
        value = np.frombuffer(b"".join(x.as_py() for x in b.column("impacts")), "<i4")
        doc = np.repeat(np.arange(len(at)), [len(x) // 4 for x in at])
        order = np.argsort(term, kind="stable")
        self.doc, self.value = doc[order], value[order].astype(np.int64)
        names, first = np.unique(term[order], return_index=True)
        ends = np.append(first[1:], len(term))
        self.column = dict(zip(names.tolist(), zip(first.tolist(), ends.tolist())))

    def sums(self, coordinates: list[tuple[int, int]]) -> np.ndarray:
        """Exact products with (term, factor) pairs, of all documents."""
        out = np.zeros(len(self.ids), np.int64)
        for term, factor in coordinates:
            u, v = self.column.get(term, (0, 0))
            out[self.doc[u:v]] += factor * self.value[u:v]
        return out

    def squares(self, coordinates: list[tuple[int, int]], weight: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ids))
        for term, _ in coordinates:
            u, v = self.column.get(term, (0, 0))
            out[self.doc[u:v]] += weight[term] * self.value[u:v].astype(float) ** 2
        return out


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
    for b in batches:
        for k in range(0, b.num_rows, BUCKET):
            yield Bucket(b.slice(k, BUCKET))


class Item:
    """An item's coordinates (term, weight times repeats), heaviest first."""

    def __init__(self, terms: Counter, weight: np.ndarray):
        part = {t: float(weight[t]) * k * k for t, k in terms.items()}  # squared coordinates
        order = sorted(part, key=lambda t: (-part[t], t))
        self.all = [(t, int(weight[t]) * terms[t]) for t in order]
        total, most = 0.0, sum(part.values())
        for k, t in enumerate(order[:FOCUS], 1):
            total += part[t]
            if total >= FOCUS_SHARE * most:
                break
        cut = k if order else 0
        self.focus, self.rest = self.all[:cut], self.all[cut:]
        self.norm, self.rest_norm = math.sqrt(most), math.sqrt(sum(part[t] for t in order[cut:]))


def seeds(batches: Iterator[pa.RecordBatch], items: list[Item]) -> list[np.ndarray]:
    """The best sums over each item's focus coordinates; the score is no less."""
    best = [np.zeros(0, np.int64)] * len(items)
    for b in buckets(batches):
        for q, item in enumerate(items):
            got = b.sums(item.focus)
            best[q] = np.sort(np.concatenate([best[q], got[got > 0]]))[-TOP:]
    return best


def search(batches: Iterator[pa.RecordBatch], items: list[Item], least: np.ndarray, weight: np.ndarray) -> tuple[list[list[tuple[int, int | None]]], np.ndarray]:
    """Each item's best (score, doc_id) of a task, and how many documents stood
    in all, in buckets not skipped, and were scored."""
    best: list[list[tuple[int, int | None]]] = [[] for _ in items]
    least, met = least.astype(np.int64).copy(), np.zeros(3, np.int64)
    norms = np.array([x.norm for x in items])
    for b in buckets(batches):
        met[0] += len(b.ids) * len(items)
        for q in np.flatnonzero(norms * b.norm.max(initial=0) * (1 + SLACK) >= least):
            item = items[q]
            if not item.all:
                continue
            met[1] += len(b.ids)
            part = b.sums(item.focus)
            beyond = np.sqrt(np.maximum(b.norm ** 2 * (1 + SLACK) - b.squares(item.focus, weight), 0.0))
            some = np.flatnonzero((part + item.rest_norm * beyond) * (1 + SLACK) + 1 >= least[q])
            if not len(some):
                continue
            met[2] += len(some)
            score = (part + b.sums(item.rest))[some]
            some, score = some[score >= least[q]], score[score >= least[q]]
            if len(some):
                found = best[q] + [(int(s), b.ids[d]) for s, d in zip(score, some)]
                best[q] = sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:TOP]
                if len(best[q]) == TOP:
                    least[q] = max(least[q], best[q][-1][0])
    return best, met


# ---- Spark jobs -----------------------------------------------------------

def ranked(docs: DataFrame, rows: list[tuple[int | None, list[bytes]]]) -> DataFrame:
    """RESULT rows of one block of items."""
    number = {t: k for k, t in enumerate(sorted({t for _, terms in rows for t in terms}))}
    found = C.written(scanned(docs, number), "search-terms", compression="zstd")
    told = found.where("docs is not null")
    totals = told.agg(F.sum("docs").alias("n"), F.sum("tokens").alias("l")).first()
    n_docs, n_tokens = totals["n"] or 0, totals["l"] or 0
    df = (told.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy(F.col("x.df_terms").alias("term"))
          .agg(F.sum("x.df").alias("df")).collect())  # the block's terms
    weight = np.zeros(len(number), np.int64)
    for r in df:
        weight[r["term"]] = term_weight(n_docs, r["df"])
    items = [Item(Counter(number[t] for t in terms), weight) for _, terms in rows]
    vecs = C.written(vectors(found.where("terms is not null"), weight, n_docs, n_tokens), "search-vectors", compression="zstd")
    ids, weights = [i for i, _ in rows], weight.astype(float)  # they go along with the functions that use them

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = seeds(batches, items)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]), pa.int32()),
                                          pa.array(np.concatenate(got), pa.int64())], names=["item", "score"])

    top = Window.partitionBy("item").orderBy(F.col("score").desc())
    tenth = (vecs.mapInArrow(seed, "item int, score long").withColumn("rank", F.row_number().over(top)).where(f"rank <= {TOP}")
             .groupBy("item").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n")).where(f"n = {TOP}"))
    least = np.ones(len(items), np.int64)
    for r in tenth.collect():  # a row for each item of the block
        least[r["item"]] = r["score"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, _ = search(batches, items, least, weights)
        out = [(q, ids[q], d, s) for q, x in enumerate(best) for s, d in x]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), pa.int64(), pa.int64()])],
                                         names=["item", "item_id", "doc_id", "score"])

    by = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (vecs.mapInArrow(find, "item int, item_id long, doc_id long, score long")
            .withColumn("rank", F.row_number().over(by)).where(f"rank <= {TOP}").select("item_id", "rank", "doc_id", "score"))


def rank(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The TOP documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    items = C.written(items.select(F.col("item_id").cast("long"), "text").distinct(), "search-items")
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    blocks = math.ceil(size / BLOCK_BYTES)
    out = spark.createDataFrame([], RESULT)
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()  # about BLOCK_BYTES
        rows = [(r["item_id"], terms_of(r["text"])) for r in block]
        rows = [(i, t) for i, t in rows if t]
        if rows:
            found = ranked(docs, rows)
            out = found if blocks == 1 else out.unionAll(C.written(found, "search-found"))
    return out


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op11: all benchmark items against all documents."""
    return rank(C.table(spark, sf_dir, "documents").select("doc_id", "text"),
                C.table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT d, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
tf AS (SELECT d, term, count(*)::BIGINT AS tf FROM (SELECT d, unnest(terms) AS term FROM docs) GROUP BY d, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), totals),
items AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
asked AS (SELECT i, term, count(*)::BIGINT AS k FROM (SELECT i, unnest(terms) AS term FROM items) GROUP BY i, term),
scores AS (
  SELECT i, d, sum(k * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN docs USING (d), totals
  GROUP BY i, d),
ranked AS (
  SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST)::INTEGER AS rank
  FROM scores JOIN docs USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (i) WHERE rank <= 10
"""
