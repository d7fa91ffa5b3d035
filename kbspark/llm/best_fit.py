"""13. Best-fit packing by non-negative least squares.

Documents are pieces of at most ``SEQUENCE`` tokens; a pattern is one, two or
three lengths that fill a sequence to the last token. Repeat counts of all
patterns over the lengths that occur are fitted to the histogram of lengths by
non-negative least squares, rounded, and clipped to the pieces there are; a
little less than the fit may leave a better mix, so some shares of it are
tried. What the patterns leave over is packed by best fit, longest first, on the histogram
(bins of equal contents are one entry with a count), so the fit costs the same
at every corpus size. Each length's pieces are then numbered and take their
places in the plan by that number, wherever they lie.

Defined results: null and empty texts are one piece of the closing id 0; equal
rows are packed each; a piece of full length is a sequence of its own; rows
with a null id are packed like others; an empty table gives an empty result;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.llm import tokens

SEQUENCE = 2_048
CLOSING = b"\0\0\0\0"   # id 0 behind every document
PARTS = 512             # hash parts that a length's pieces are numbered in
ROUNDS = 300            # of the least-squares descent at most
GAIN = 1e-5             # it ends when a round's share of the error is below
SHARES = (1.0, 0.99, 0.95, 0.85, 0.7)  # of the fitted counts: the one that needs fewest sequences is taken
BATCH_BYTES = 4_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, _task int, _place long"


# ---- the plan, on the histogram -------------------------------------------

def patterns(lengths: np.ndarray, full: int = SEQUENCE) -> np.ndarray:
    """All ways to fill a sequence exactly with up to three of the lengths, as
    rows of ascending lengths, 0 where there are fewer."""
    there = np.zeros(full + 1, bool)
    there[lengths] = True
    out = [np.array([[0, 0, full]])] if there[full] else []
    two = lengths[2 * lengths <= full]
    two = two[there[full - two]]
    out.append(np.stack([np.zeros_like(two), two, full - two], axis=1))
    for a in lengths[3 * lengths <= full]:
        b = lengths[(lengths >= a) & (2 * lengths <= full - a)]
        b = b[there[full - a - b]]
        out.append(np.stack([np.full_like(b, a), b, full - a - b], axis=1))
    found = np.concatenate(out)
    return found[(found != full).all(axis=1) | (found[:, 0] + found[:, 1] == 0)]


def fitted(rows: np.ndarray, hist: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns that minimise the squared error of
    the histogram, an error weighing as its length. Each round takes exact
    steps along the patterns that gain most, no two of which share a length;
    few patterns carry the fit, so rounding loses little."""
    full = len(hist) - 1
    weight = np.arange(full + 1, dtype=float)
    hot = np.zeros((len(rows), 3))
    same_01, same_12 = rows[:, 0] == rows[:, 1], rows[:, 1] == rows[:, 2]
    for k in range(3):  # times that the length occurs in its pattern
        hot[:, k] = (rows == rows[:, k:k + 1]).sum(axis=1)
    norm = (weight[rows] * hot).sum(axis=1)  # sum over distinct lengths of weight * times^2
    x, left = np.zeros(len(rows)), hist.astype(float).copy()
    left[0] = 0
    error = (weight * left ** 2).sum()
    for _ in range(rounds):
        step = np.maximum((weight * left)[rows].sum(axis=1) / norm, -x)
        gain = step ** 2 * norm
        top = np.argpartition(-gain, min(4 * full, len(gain) - 1))[:4 * full] if len(gain) else gain
        used = np.zeros(full + 1, bool)
        for p in top[np.argsort(-gain[top], kind="stable")]:
            own = rows[p]
            if gain[p] <= 0:
                break
            if not used[own].any():
                x[p] += step[p]
                np.subtract.at(left, own, step[p])
                used[own] = True
                used[0] = False
        left[0] = 0
        now = (weight * left ** 2).sum()
        if error - now <= GAIN * error:
            break
        error = now
    return x


def rounded(rows: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Whole repeat counts, the largest first, of what is left of each length;
    takes them off ``left``."""
    out = []
    for p in np.argsort(-x, kind="stable"):
        if x[p] < 0.5:
            break
        own = {int(n): int((rows[p] == n).sum()) for n in set(rows[p].tolist()) if n}
        times = min([int(x[p] + 0.5), *(int(left[n]) // k for n, k in own.items())])
        if times:
            for n, k in own.items():
                left[n] -= times * k
            out.append((times, sorted(own.items(), reverse=True)))
    return out


def best_fit(left: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit, longest first: a piece goes where the least room is left.
    Sequences of equal contents are one entry: (how many, [(length, times)])."""
    full = len(left) - 1
    by_room: list[list[tuple[int, list]]] = [[] for _ in range(full + 1)]
    some = np.zeros(full + 1, bool)

    def put(n: int, room: int, what: list) -> None:
        if n:
            by_room[room].append((n, what))
            some[room] = True

    for length in range(full, 0, -1):
        pieces = int(left[length])
        while pieces:
            room = length + int(np.argmax(some[length:]))
            if some[room]:
                n, what = by_room[room].pop()
                some[room] = bool(by_room[room])
            else:
                room, n, what = full, pieces, []
            each = room // length
            whole = min(n, pieces // each)
            put(whole, room - each * length, [*what, (length, each)])
            pieces -= whole * each
            if whole < n and pieces:
                put(1, room - pieces * length, [*what, (length, pieces)])
                whole, pieces = whole + 1, 0
            if what:
                put(n - whole, room, what)
    return [entry for entries in by_room for entry in entries]


def plan(hist: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, pieces in each)]), over all pieces."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    rows = patterns(np.flatnonzero(left), len(hist) - 1)
    if not len(rows):
        return best_fit(left)
    x, best = fitted(rows, left), None
    for share in SHARES:
        rest = left.copy()
        made = rounded(rows, share * x, rest) + best_fit(rest)
        if best is None or sum(n for n, _ in made) < sum(n for n, _ in best):
            best = made
    return best


def places(made: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first number, pieces in each, first sequence, offset), in
    order of length and number: pieces of a length take their places by it."""
    out, first, sequence = [], {}, 0
    for times, what in made:
        offset = 0
        for length, each in what:
            out.append((length, first.get(length, 0), each, sequence, offset))
            first[length] = first.get(length, 0) + times * each
            offset += length * each
        sequence += times
    table = np.array(out, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))]


# ---- Spark jobs -----------------------------------------------------------

def pieces(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE, full: int = SEQUENCE) -> DataFrame:
    """PIECES rows of doc_id and text: only documents longer than a sequence
    are cut, the first piece takes what full ones leave."""

    kept = docs.sparkSession.sparkContext.broadcast({})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.one_of_worker(kept, lambda: tokens.IdBytes(tokenizer))
        task, place = TaskContext.get().partitionId(), 0
        for ids, texts in C.text_batches(batches, BATCH_BYTES):
            rows = []
            for i, raw in zip(ids, encode([t or "" for t in texts])):
                raw += CLOSING
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % full + 1, n + 1, full)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((i, k, a, b - a, zlib.crc32(raw[4 * a:4 * b]), task, place + len(rows)))
            place += len(rows)
            cols = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def placed(rows: DataFrame, full: int = SEQUENCE) -> DataFrame:
    """PIECES rows, a written table, with sequence_id and offset."""
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("_task", "_place"), F.lit(PARTS)).cast("int"))
    cells = C.written(rows.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "pack-cells")
    hist = np.zeros(full + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect():  # a row for each length of at most ``full``
        hist[r["length"]] = r["n"]
    table = places(plan(hist))
    # sorted by (length, first number); at most some thousand entries of at most 63 lengths each, whatever the corpus
    step = np.int64(max(1, hist.max() + 1))
    shared = rows.sparkSession.sparkContext.broadcast((table[:, 0] * step + table[:, 1], table))
    offs = cells.select("length", "_part", C.running_offset(["length"], "_part", "_n").alias("_off"))
    place = F.row_number().over(Window.partitionBy("length", "_part").orderBy("_task", "_place"))
    numbered = (rows.withColumn("_rn", place).join(offs, ["length", "_part"])
                .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_off") + F.col("_rn") - 1).alias("_no")))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, table = shared.value
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("_no").to_numpy()
            row = table[np.searchsorted(keys, length * step + number, side="right") - 1] if len(number) else np.zeros((0, 5), np.int64)
            at = number - row[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(row[:, 3] + at // np.maximum(row[:, 2], 1)), pa.array(row[:, 4] + at % np.maximum(row[:, 2], 1) * length)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str = tokens.BYTE_BPE, full: int = SEQUENCE) -> DataFrame:
    return placed(C.written(pieces(docs, tokenizer, full), "pack-pieces"), full)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces with their sequence and offset; contract of op13."""
    return pack(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
