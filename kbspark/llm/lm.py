"""7. LM scoring by deleted interpolation.

A bigram model: maximum-likelihood estimates of the bigram, the word and the
uniform distribution are mixed by weights that depend on the context's
frequency bucket. The weights are learned by expectation-maximisation on the
counts of a held-out fold of the training rows (against estimates of the other
folds); the estimates of the final model then take all training rows.

All n-grams of the corpus are counted. Documents are dealt into batches; a
batch sends the keys of its distinct n-grams with its own counts to the key's
bucket, as packed arrays, and gets the corpus counts back in the same order.
The number of batches and buckets grows with the input, no table of counts is
ever gathered in one place. Words are keyed by 64 bits of XXH64, bigrams by the
bucket's bits and BIGRAM_BITS more.

Defined results: null and empty texts consist of the end token; null ids belong
to no training fold's remainder 1 and so count as training rows; equal rows all
count; without training rows the model is uniform; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C

FOLDS = 5
HELD_OUT, EM_FOLD = 1, 0        # remainders: scored only; held out for the weights
BATCH_BYTES = 8_000_000         # of text in a batch
BIGRAM_BITS = 40
EM_ROUNDS = 40
CONTEXT_BUCKETS = 24            # 0: unseen, then one for each doubling
STEPS = 4                       # steps per doubling of the held-out histogram
DEFAULT_WEIGHTS = (0.3, 0.5, 0.2)  # of a bucket without held-out counts
END, START = b" end", b" start"    # no word has a blank
MULT1, MULT2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

EVENTS = "kind int, doc_id long, held_out boolean, n long, c1 binary, c2 binary"
MESSAGE = "bucket int, batch int, k1 binary, r1 binary, h1 binary, k2 binary, r2 binary, h2 binary"
ANSWER = "batch int, bucket int, r1 binary, a1 binary, r2 binary, a2 binary"


# ---- packed arrays --------------------------------------------------------

def packed(x: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, first bytes first
    (so that like bytes stand together), compressed, behind that width."""
    most = int(x.max(initial=0))
    size = next(w for w in range(1, 9) if most < 1 << 8 * w)
    raw = x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :size].T.tobytes()
    return bytes([size]) + zstandard.ZstdCompressor(level=1).compress(raw)


def unpacked(raw: bytes) -> np.ndarray:
    part = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros(part.shape[1], np.uint64)
    for k, plane in enumerate(part):
        out |= plane.astype(np.uint64) << np.uint64(8 * k)
    return out


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending keys as their steps."""
    return packed(np.diff(x, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def planes(x: np.ndarray) -> bytes:
    """As packed, left to the file format to compress: for short arrays."""
    most = int(x.max(initial=0))
    size = next(w for w in range(1, 9) if most < 1 << 8 * w)
    return bytes([size]) + x.astype("<u8").view(np.uint8).reshape(len(x), 8)[:, :size].T.tobytes()


def unplaned(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).astype(np.float64)
    return part.T @ 256.0 ** np.arange(raw[0])


def counts(raw: bytes) -> np.ndarray:
    return unpacked(raw).astype(np.float64)  # exact below 2**53


# ---- a batch of documents -------------------------------------------------

def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of bigrams from those of their words."""
    x = a * MULT1 ^ (b << np.uint64(31) | b >> np.uint64(33))
    x ^= x >> np.uint64(32)
    x *= MULT2
    x ^= x >> np.uint64(29)
    x *= MULT1
    return x ^ x >> np.uint64(32)


class Batch:
    """Distinct words and bigrams of some texts, in key order."""

    def __init__(self, texts: list[bytes | None], bits: int):
        number: dict[bytes, int] = {END: 0, START: 1}
        docs = []
        for t in texts:
            words = (t or b"").lower().split()
            for w in set(words).difference(number):
                number[w] = len(number)
            docs.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
        keys = np.fromiter((xxhash.xxh64_intdigest(w) for w in number), np.uint64, len(number))
        v = len(number)
        self.lengths = np.array([len(d) + 1 for d in docs], np.int64)
        ends = np.cumsum(self.lengths)
        total = int(ends[-1]) if len(ends) else 0
        token = np.zeros(total, np.int64)  # END where no word is put
        inner = np.ones(total, bool)
        inner[ends - 1] = False
        token[inner] = np.concatenate(docs) if docs else []
        before = np.ones(total, np.int64)  # START
        before[1:][inner[:-1]] = token[:-1][inner[:-1]]
        self.doc = np.repeat(np.arange(len(docs)), self.lengths)
        order = np.argsort(keys)
        rank = np.empty(v, np.int64)
        rank[order] = np.arange(v)
        self.words, self.token, self.start = keys[order], rank[token], rank[1]
        code, at = np.unique(before * v + token, return_inverse=True)
        pair = mixed(keys[code // v], keys[code % v])
        pair = (pair >> np.uint64(64 - bits - BIGRAM_BITS)) if bits + BIGRAM_BITS < 64 else pair
        self.pairs, pair_at = np.unique(pair, return_inverse=True)
        self.bigram = pair_at[at]
        self.shift1, self.shift2 = np.uint64(64 - bits), np.uint64(min(BIGRAM_BITS, 64 - bits))

    def counts(self, doc_on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each word and bigram occurs in the documents marked; the
        start symbol counts once for each."""
        on = doc_on[self.doc]
        c1 = np.bincount(self.token[on], minlength=len(self.words))
        c1[self.start] = doc_on.sum()
        return c1, np.bincount(self.bigram[on], minlength=len(self.pairs))

    def messages(self, fold: np.ndarray, bits: int) -> Iterator[tuple]:
        kept = self.counts((fold != HELD_OUT) & (fold != EM_FOLD))
        held = self.counts(fold == EM_FOLD)
        b = np.arange(1, 1 << bits, dtype=np.uint64)
        at1 = [0, *np.searchsorted(self.words, b << self.shift1).tolist(), len(self.words)]
        at2 = [0, *np.searchsorted(self.pairs, b << self.shift2).tolist(), len(self.pairs)]
        for k in range(1 << bits):
            u, p = slice(at1[k], at1[k + 1]), slice(at2[k], at2[k + 1])
            if u.start < u.stop or p.start < p.stop:
                # keys without the bits that the bucket tells
                yield (k, packed_keys(self.words[u] - (np.uint64(k) << self.shift1)), packed(kept[0][u]), packed(held[0][u]),
                       packed_keys(self.pairs[p] - (np.uint64(k) << self.shift2)), packed(kept[1][p]), packed(held[1][p]))


# ---- Spark jobs -----------------------------------------------------------

def fold_of(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(FOLDS - 1)).cast("int")


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    batch = F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text"))), F.lit(parts)).cast("int")
    return docs.select(batch.alias("batch"), F.col("doc_id").cast("long"), fold_of(F.col("doc_id")).alias("fold"),
                       F.col("text").cast("binary").alias("text")).repartition(parts, "batch")


def corpus_counts(batches: DataFrame, bits: int) -> DataFrame:
    """ANSWER rows: for each batch and bucket the corpus counts of its keys,
    of the folds that train the weights' estimates (r) and of all (a); and as
    batch -1, the bucket's part of the totals."""
    start = xxhash.xxh64_intdigest(START)
    start_bucket, start_key = start >> (64 - bits), np.uint64(start & ((1 << 64 - bits) - 1))

    def ask(t: pa.Table) -> pa.Table:
        b = Batch(t.column("text").to_pylist(), bits)
        rows = list(b.messages(t.column("fold").to_numpy(), bits))
        bucket, *cols = zip(*rows)
        batch = [t.column("batch")[0].as_py()] * len(rows)
        return pa.Table.from_arrays([pa.array(bucket, pa.int32()), pa.array(batch, pa.int32()),
                                     *(pa.array(c, pa.binary()) for c in cols)], names=names(MESSAGE))

    def tell(t: pa.Table) -> pa.Table:
        out = []
        for k in "12":
            keys = [unpacked_keys(x.as_py()) for x in t.column("k" + k)]
            cut = np.cumsum([len(x) for x in keys])[:-1]
            uniq, at = np.unique(np.concatenate(keys), return_inverse=True)
            del keys
            r, h = (np.bincount(at, np.concatenate([counts(x.as_py()) for x in t.column(c + k)]), len(uniq)) for c in "rh")
            if k == "1":
                own = (uniq != start_key) | (t.column("bucket")[0].as_py() != start_bucket)
                totals = [(r + h)[own].sum(), (r + h > 0)[own].sum(), r[own].sum(), (r > 0)[own].sum()]
            out += [[packed(x) for x in np.split(c[at], cut)] for c in (r, r + h)]
        extra = [np.array(totals, np.int64).tobytes(), b"", b"", b""]
        batch, bucket = (t.column(c).to_pylist() for c in ("batch", "bucket"))
        return pa.Table.from_arrays([pa.array(batch + [-1], pa.int32()), pa.array(bucket + bucket[:1], pa.int32()),
                                     *(pa.array(c + [x], pa.binary()) for c, x in zip(out, extra))], names=names(ANSWER))

    asked = batches.groupBy("batch").applyInArrow(ask, MESSAGE)
    return asked.repartition(1 << bits, "bucket").groupBy("bucket").applyInArrow(tell, ANSWER)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def frequency_bucket(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), CONTEXT_BUCKETS - 1), 0)


def steps(x: np.ndarray) -> np.ndarray:
    """1 + the nearest step of a number from 1 on, 0 for 0; below 256."""
    return np.where(x > 0, np.minimum(1 + np.rint(STEPS * np.log2(np.maximum(x, 1))).astype(np.int64), 255), 0)


def step_values(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, 2.0 ** ((q - 1) / STEPS), 0.0)


def context_counts(c1: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Counts of each token's context from those of the tokens: a context is
    the word before; the start symbol is as frequent as the end token."""
    before = np.empty_like(c1)
    before[1:] = c1[:-1]
    ends = np.cumsum(lengths)
    before[np.concatenate([[0], ends[:-1]])] = c1[ends - 1]
    return before


def events(batches: DataFrame, answers: DataFrame, bits: int) -> DataFrame:
    """EVENTS rows. kind 0: a document with the counts of its tokens and of
    its bigrams. kind 1: a cell of the held-out histogram (doc_id) and its
    tokens. kind 2: a total (doc_id: which)."""
    types = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]

    def table(*cols) -> pa.Table:
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names(EVENTS))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # the totals
            parts = [np.frombuffer(x, np.int64) for x in right.column("r1").to_pylist()]
            none = [None] * 4
            return table([2] * 4, range(4), none, np.sum(parts, axis=0), none, none)
        b = Batch(left.column("text").to_pylist(), bits)
        right = right.sort_by("bucket")
        r1, a1, r2, a2 = (np.concatenate([counts(x.as_py()) for x in right.column(c)]) for c in ("r1", "a1", "r2", "a2"))
        fold = left.column("fold").to_numpy()
        code = n = np.zeros(0, np.int64)
        on = (fold == EM_FOLD)[b.doc]
        if on.any():
            c1 = r1[b.token]
            ch = context_counts(c1, b.lengths)[on]
            c1, c2 = c1[on], r2[b.bigram][on]
            inverse = np.divide(ch, c2, out=np.zeros_like(ch), where=c2 > 0)
            code, n = np.unique((frequency_bucket(ch) * 256 + steps(inverse)) * 256 + steps(c1), return_counts=True)
        cut = np.cumsum(b.lengths)[:-1]
        none = [None] * len(code)
        return table([0] * len(fold) + [1] * len(code), left.column("doc_id").to_pylist() + code.tolist(),
                     (fold == HELD_OUT).tolist() + none, b.lengths.tolist() + n.tolist(),
                     [planes(x) for x in np.split(a1[b.token], cut)] + none,
                     [planes(x) for x in np.split(a2[b.bigram], cut)] + none)

    return batches.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(join, EVENTS)


# ---- the mixture ----------------------------------------------------------

def learn_weights(cells: dict[int, int], n: int, v: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """CONTEXT_BUCKETS x (bigram, word, uniform) by expectation-maximisation
    on the held-out histogram."""
    weights = np.tile(DEFAULT_WEIGHTS, (CONTEXT_BUCKETS, 1))
    if not cells or not n:
        return weights
    code = np.array(sorted(cells))
    count = np.array([cells[c] for c in sorted(cells)], float)
    inverse = step_values(code // 256 % 256)
    p = np.stack([np.divide(1.0, inverse, out=np.zeros_like(inverse), where=inverse > 0),
                  step_values(code % 256) / n, np.full(len(code), 1.0 / (v + 1))], axis=1)
    bucket = code // 65_536
    for b in np.unique(bucket):
        q, k, w = p[bucket == b], count[bucket == b], np.array(DEFAULT_WEIGHTS)
        for _ in range(rounds):
            share = q * w
            share /= share.sum(1, keepdims=True)
            w = (share * k[:, None]).sum(0) / k.sum()
        # a share of one token is left to each, so that no probability is 0
        weights[b] = (w * k.sum() + 1 / 3) / (k.sum() + 1)
    return weights


def log_scores(c1: np.ndarray, c2: np.ndarray, n: int, v: int, weights: np.ndarray) -> tuple[int, float, float]:
    """n_known, base score and score of a document's tokens."""
    ch = context_counts(c1, np.array([len(c1)]))
    w = weights[frequency_bucket(ch)]
    p = w[:, 0] * np.divide(c2, ch, out=np.zeros_like(c2), where=ch > 0) + w[:, 1] * (c1 / n if n else 0) + w[:, 2] / (v + 1)
    base = np.log10((c1 + 0.5) / (n + 0.5 * (v + 1)))
    return int((c1 > 0).sum()), float(base.sum()), float(np.log10(p).sum())


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score
    of every document."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BATCH_BYTES))
    bits = max(3, math.ceil(math.log2(parts)))
    batches = dealt(docs, parts)
    found = C.written(events(batches, corpus_counts(batches, bits), bits), "lm-events", compression="zstd")
    sums = found.where("kind > 0").groupBy("kind", "doc_id").agg(F.sum("n").alias("n")).collect()  # histogram cells
    totals = {r["doc_id"]: r["n"] for r in sums if r["kind"] == 2}
    n, v, n_r, v_r = (int(totals.get(k, 0)) for k in range(4))
    weights = learn_weights({r["doc_id"]: r["n"] for r in sums if r["kind"] == 1}, n_r, v_r)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x, y in zip(b.column(3), b.column(4)):
                rows.append(log_scores(unplaned(x.as_py()), unplaned(y.as_py()), n, v, weights))
            known, base, own = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(known, pa.int64()), pa.array([n] * len(rows), pa.int64()),
                 pa.array(base, pa.float64()), pa.array(own, pa.float64())],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    src = found.where("kind = 0").select("doc_id", "held_out", F.col("n").alias("n_tokens"), "c1", "c2")
    return src.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op7 over all documents."""
    return score(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
