"""2. SimHash near-dedup with a generalised pigeonhole search.

Fingerprints are 64 weighted-majority bits of XXH64 over 3-word shingles.
Bits are grouped into eight blocks of correlated bits and the blocks into
partitions. Any two fingerprints at distance <= d have, for every allocation
of thresholds t_i >= -1 with sum(t_i) = d - m + 1, a partition i in which they
differ by at most t_i bits. Per fingerprint, dynamic programming picks the
allocation with the least estimated candidates; it is then probed for and the
candidates are verified. Links become components by alternating stars.

Signatures shared by more than BIG fingerprints are not paired up: all
fingerprints that meet one are linked through the words at distance <= d / 2
around them (two words within d share one), which is as exact.

Defined results: null, empty and blank texts have fingerprint zero and link
like any other; fewer than 3 words are one shingle; equal rows share their
fingerprint, so their component; null ids are never a component's id unless
it has no other; an empty table gives an empty result; ``keep`` passes other
columns through.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
BITS, BLOCKS, BLOCK_BITS = 64, 8, 8
PARTITION_COUNTS = (2, 3, 4)  # tried; the cheapest by estimate is taken
PROBE_COST = 1.0  # of one probe, in candidates
BIG = 64          # fingerprints of a signature that are paired up
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# ---- fingerprints ---------------------------------------------------------

def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8 (A-Z lower-cased) as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = xxhash.xxh64_digest(joined, seed)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1:].tolist())])
    lanes = np.frombuffer(hashes, np.uint8).reshape(-1, 8)  # big-endian: lane 7 has bits 0-7
    n, out = len(lanes), 0
    for lane in range(8):
        ones = np.bincount(lanes[:, 7 - lane], minlength=256) @ BYTE_BITS
        out |= int(np.packbits(2 * ones > n, bitorder="little")[0]) << (8 * lane)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_sha256 of every
    document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, shas = np.zeros(b.num_rows, np.uint64), []
            for i, x in enumerate(b.column(1)):
                text = x.as_py() or b""
                fps[i] = fingerprint(text, width)
                shas.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64), pa.int64()), pa.array(shas, pa.string())],
                                             ["doc_id", "fp", "text_sha256"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("t"))
    return src.mapInArrow(run, "doc_id long, fp long, text_sha256 string")


# ---- bit statistics and the search plan -----------------------------------

def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, per_batch, cells: int) -> np.ndarray:
    """Sum over all fingerprints of per_batch's counts, a vector of ``cells``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for b in batches:
            total += per_batch(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["cell", "n"])

    out = np.zeros(cells, np.int64)
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def bit_pairs(fps: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints both bits are set."""
    def count(x: np.ndarray) -> np.ndarray:
        total = np.zeros((BITS, BITS))
        for k in range(0, len(x), 1 << 16):
            m = _bits(x[k:k + (1 << 16)]).astype(np.float32)
            total += m.T @ m
        return total.round().astype(np.int64).ravel()
    return _summed(fps, count, BITS * BITS).reshape(BITS, BITS)


def group_bits(pairs: np.ndarray, n: int) -> list[list[int]]:
    """Eight blocks of eight bits, grown greedily by absolute correlation,
    ordered so that correlated blocks are neighbours too."""
    if n < 2:
        return [list(range(k, k + BLOCK_BITS)) for k in range(0, BITS, BLOCK_BITS)]
    p = np.diag(pairs) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((pairs / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, blocks = set(range(BITS)), []
    while free:
        rest = sorted(free)
        block = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        free.remove(block[0])
        while len(block) < BLOCK_BITS:
            b = max(sorted(free), key=lambda c: (corr[c, block].sum(), -c))
            block.append(b)
            free.remove(b)
        blocks.append(block)
    order, left = [blocks[0]], blocks[1:]
    while left:
        nxt = max(left, key=lambda b: corr[np.ix_(order[-1], b)].sum())
        order.append(nxt)
        left.remove(nxt)
    return order


def block_values(fps: np.ndarray, blocks: list[list[int]]) -> np.ndarray:
    """n x 8: each block's bits as a byte."""
    m = _bits(fps)
    return np.stack([np.packbits(m[:, b], axis=1, bitorder="little")[:, 0] for b in blocks], axis=1)


def block_histograms(fps: DataFrame, blocks: list[list[int]]) -> np.ndarray:
    def count(x: np.ndarray) -> np.ndarray:
        v = block_values(x, blocks)
        return np.concatenate([np.bincount(v[:, k], minlength=256) for k in range(BLOCKS)])
    return _summed(fps, count, BLOCKS * 256).reshape(BLOCKS, 256)


def distance_shares(hist: np.ndarray, n: int, upto: int) -> np.ndarray:
    """block x value x distance: the share of all fingerprints whose value of
    the block differs from this value in so many bits."""
    value = np.arange(256)
    apart = BYTE_BITS.sum(1)[value[:, None] ^ value[None, :]]
    return np.stack([(hist / max(n, 1)) @ (apart == d) for d in range(upto + 1)], axis=2)


def estimates(values: np.ndarray, shares: np.ndarray, parts: list[list[int]], n: int) -> np.ndarray:
    """fingerprint x partition x (t + 1): estimated fingerprints within t of
    this one's partition, blocks taken as independent of one another."""
    upto = shares.shape[2] - 1
    out = np.zeros((len(values), len(parts), upto + 2))
    for i, part in enumerate(parts):
        dist = np.zeros((len(values), upto + 1))
        dist[:, 0] = 1
        for b in part:
            s = shares[b][values[:, b]]
            dist = np.stack([sum(dist[:, k] * s[:, d - k] for k in range(d + 1)) for d in range(upto + 1)], axis=1)
        out[:, i, 1:] = np.cumsum(dist, axis=1) * n
    return out


def allocate(cost: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Per fingerprint the thresholds (-1, 0, ...) of least cost that sum up to
    ``total``, by dynamic programming over partitions; and that cost."""
    n, m, k = cost.shape
    size = total + m + 1  # sums shifted by the partitions so far
    best = np.full((n, size), np.inf)
    best[:, 0] = 0
    picks = []
    for i in range(m):
        new, pick = np.full((n, size), np.inf), np.zeros((n, size), np.int8)
        for t in range(min(k, size)):
            v = best[:, :size - t] + cost[:, i, t][:, None]
            less = v < new[:, t:]
            new[:, t:] = np.where(less, v, new[:, t:])
            pick[:, t:] = np.where(less, t, pick[:, t:])
        best = new
        picks.append(pick)
    at = np.full(n, total + m)
    out = np.zeros((n, m), np.int64)
    for i in reversed(range(m)):
        out[:, i] = picks[i][np.arange(n), at] - 1
        at = at - (out[:, i] + 1)
    return out, best[:, total + m]


def partitions(m: int) -> list[list[int]]:
    return [x.tolist() for x in np.array_split(np.arange(BLOCKS), m)]


def probes_of(width: int, t: int) -> list[int]:
    """Masks over ``width`` bits with at most t bits set."""
    return [sum(1 << b for b in c) for d in range(t + 1) for c in itertools.combinations(range(width), d)]


class Plan:
    """What the search needs to know, all of fixed size."""

    def __init__(self, blocks, hist, n, max_distance):
        self.blocks, self.n, self.d = blocks, n, max_distance
        self.shares = distance_shares(hist, n, max_distance)
        rng, costs = np.random.default_rng(0), {}
        weights = (hist + (n == 0)) / (hist + (n == 0)).sum(1, keepdims=True)
        drawn = np.stack([rng.choice(256, 2_000, p=w) for w in weights], axis=1)  # as the values occur
        for m in PARTITION_COUNTS:
            costs[m] = self.allocation(drawn.astype(np.uint8), partitions(m))[1].mean()
        self.parts = partitions(min(costs, key=lambda m: (costs[m], m)))

    def allocation(self, values, parts):
        est = estimates(values, self.shares, parts, self.n)
        for i, part in enumerate(parts):
            for t in range(est.shape[2] - 1):
                est[:, i, t + 1] += PROBE_COST * len(probes_of(len(part) * BLOCK_BITS, t))
        return allocate(est, self.d - len(parts) + 1)

    def signatures(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """The index rows (part and value of every partition) and, as three
        arrays (row, part, value), the probes of the allocations."""
        values = block_values(fps, self.blocks)
        full = np.stack([sum(values[:, b].astype(np.int64) << (BLOCK_BITS * k) for k, b in enumerate(part))
                         for part in self.parts], axis=1)
        chosen, _ = self.allocation(values, self.parts)
        row, part_, sig = [], [], []
        for i, part in enumerate(self.parts):
            for t in range(self.d + 1):
                at = np.flatnonzero(chosen[:, i] == t)
                if len(at):
                    masks = np.array(probes_of(len(part) * BLOCK_BITS, t), np.int64)
                    row.append(np.repeat(at, len(masks)))
                    part_.append(np.full(len(at) * len(masks), i, np.int64))
                    sig.append((full[at, i][:, None] ^ masks[None, :]).ravel())
        empty = [np.zeros(0, np.int64)]
        return full, chosen, [np.concatenate(x or empty) for x in (row, part_, sig)]


def make_plan(distinct: DataFrame, n: int, max_distance: int) -> Plan:
    blocks = group_bits(bit_pairs(distinct), n)
    return Plan(blocks, block_histograms(distinct, blocks), n, max_distance)


# ---- links ----------------------------------------------------------------

def _rows(distinct: DataFrame, plan: Plan, index: bool) -> DataFrame:
    """part, sig, fp: of the index or of the probes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in range(0, len(all_), 4_096):
                x = all_[k:k + 4_096]
                full, _, (row, part, sig) = plan.signatures(x)
                if index:
                    m = full.shape[1]
                    row, part, sig = np.repeat(np.arange(len(x)), m), np.tile(np.arange(m), len(x)), full.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(sig, pa.int64()),
                                                  pa.array(x[row], pa.int64())], ["part", "sig", "fp"])
    return distinct.select("fp").mapInArrow(run, "part int, sig long, fp long")


def _around(fps: DataFrame, radius: int) -> DataFrame:
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in probes_of(BITS, radius)]
    flips = fps.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
    return flips.select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("hub"))


def through_hubs(fps: DataFrame, distance: int) -> DataFrame:
    """Links of all fingerprints within the distance: two are, just if a word
    (hub) has one within half the distance and the other within the rest. All
    around a hub are linked to the smallest of its nearer ones."""
    near, rest = distance // 2, distance - distance // 2
    least = _around(fps, near).groupBy("hub").agg(F.min("fp").alias("b"))
    found = _around(fps, rest).join(least, "hub").where("fp <> b")
    return found.select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b")).distinct()


def links(distinct: DataFrame, plan: Plan, big: int = BIG) -> DataFrame:
    """Pairs a > b of fingerprints that connect all those within the distance."""
    index, probes = _rows(distinct, plan, True), _rows(distinct, plan, False)
    heavy = (index.groupBy("part", "sig").agg(F.count(F.lit(1)).alias("n")).where(f"n > {big}")
             .select("part", "sig").checkpoint())
    at = ["part", "sig"]
    some = not heavy.isEmpty()
    few = index.join(heavy, at, "left_anti") if some else index
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= plan.d
    found = (probes.select(*at, F.col("fp").alias("a")).join(few.select(*at, F.col("fp").alias("b")), at)
             .where("a <> b").where(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if not some:
        return found
    crowd = (index.join(heavy, at, "left_semi").select("fp")
             .unionAll(probes.join(heavy, at, "left_semi").select("fp")).distinct())
    return found.unionAll(through_hubs(crowd, plan.d))


# ---- components -----------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """From links a > b: (a, root), the smallest number reachable, for every a
    that has a smaller one. Alternating large and small stars, each round
    checkpointed, until a round changes nothing."""
    last = None
    edges = edges.checkpoint()
    while True:
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            return edges.select("a", F.col("b").alias("root"))
        last = state
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        edges = small.checkpoint()


def cluster(docs: DataFrame, width: int = SHINGLE, max_distance: int = MAX_DISTANCE, big: int = BIG) -> DataFrame:
    """doc_id, fp, text_sha256, component_id and kept of every document. Of a
    component the smallest doc_id is kept; of rows with that id, the one with
    the smallest text_sha256."""
    rows = C.written(fingerprints(docs, width), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_sha256")
    per = rows.groupBy("fp").agg(F.min(row).alias("first"), F.count(F.lit(1)).alias("n")).checkpoint()
    total = per.agg(F.count(F.lit(1)), F.sum("n")).first()
    plan = make_plan(per, total[0], max_distance)
    comp = components(links(per, plan, big)).withColumnRenamed("a", "fp")
    linked = per.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp")).checkpoint()
    least = linked.groupBy("root").agg(F.min("first").alias("_c"))
    of = linked.join(least, "root").select("fp", "_c", "n")
    out = C.join_hot(rows, of, "fp", "_c", "n", total[1] or 0, F.struct("doc_id", "text_sha256"))
    kept = F.col("doc_id").eqNullSafe(F.col("_c.doc_id")) & (F.col("text_sha256") == F.col("_c.text_sha256"))
    return out.select("doc_id", "fp", "text_sha256", F.col("_c.doc_id").alias("component_id"), kept.alias("kept"))


def keep(docs: DataFrame, **options) -> DataFrame:
    """One document of each component, all columns."""
    return C.keep_rows(docs, C.written(cluster(docs, **options), "near-kept"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op2 over all documents."""
    out = cluster(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
