"""6. Quality rules by compression bands.

A text's zstandard ratio (compressed / raw bytes) must lie between limits for
its length, and at most a fifth of its full fixed-size chunks may lie outside
the chunk limits: below them text repeats itself, above them it does not
compress (encoded or random data). Letters outside ASCII take several bytes, of
which the first says little in an alphabet and each much in a script of many
signs, so both limits give way with the share of such bytes.

Defined results: null and empty texts have no words and fail the base rule;
equal texts get equal rows; an empty table gives an empty result; ``keep``
passes other columns through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C

#: (bytes below, least ratio, largest ratio): short texts compress less. A
#: small margin outside what clean prose measured: the invented prose of sf0.1
#: (four languages) above, licence texts and manuals, which compress better, below.
BANDS = (
    (512, 0.40, 0.79),
    (724, 0.40, 0.72),
    (1_024, 0.37, 0.68),
    (1_448, 0.35, 0.64),
    (2_048, 0.33, 0.59),
    (2_896, 0.34, 0.56),
    (4_096, 0.34, 0.525),
    (8_192, 0.33, 0.495),
    (16_384, 0.31, 0.465),
    (32_768, 0.30, 0.47),
    (None, 0.27, 0.455),
)
CHUNK = 2_048
CHUNK_LIMITS = (0.34, 0.58)  # clean prose: 0.36-0.57
BAD_PART = 5                 # one bad chunk in so many is let pass
#: Of the share of continuation bytes, by which the limits give way; clean prose
#: of 32 languages and scripts measured: 0.02-0.10 in Latin ones, 0.4 in Greek
#: and Cyrillic, 0.5 in Korean, Japanese and Chinese.
LOWER, HIGHER, HIGHER_MOST = 0.12, 0.85, 0.14
LEVEL = 3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SPACES = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long")


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    number = {w: i for i, w in enumerate(set(words))}
    v = len(number)
    if v == len(words):
        return 0
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    if v > 2_000_000:  # the product below would overflow
        _, pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)
        window = pair * v + ids[2:]
    else:
        window = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    order = np.argsort(window, kind="stable")
    sorted_ = window[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k:k + n] |= twice
    return int(inside.sum())


def measure(text: bytes, squeeze) -> tuple:
    """The values of FIELDS for one text in UTF-8."""
    words = text.split()
    n_words = len(words)
    word_chars = len(text.translate(None, SPACES + CONTINUATION))
    n_symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    n_repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    size = len(text)
    ratio = len(squeeze(text)) / size if size else None
    chunks = size // CHUNK
    share = (size - len(text.translate(None, CONTINUATION))) / size if size else 0.0
    lower, higher = LOWER * share, min(HIGHER * share, HIGHER_MOST)
    low, high = CHUNK_LIMITS[0] - lower, CHUNK_LIMITS[1] + higher
    bad = sum(not low <= len(squeeze(text[k * CHUNK:(k + 1) * CHUNK])) / CHUNK <= high for k in range(chunks))
    kept = False
    if not failed:
        _, low, high = next(b for b in BANDS if b[0] is None or size < b[0])
        kept = low - lower <= ratio <= high + higher and BAD_PART * bad <= chunks
    return (n_words, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, kept, ratio, bad, chunks)


def scores(docs: DataFrame) -> DataFrame:
    """doc_id and FIELDS of every document."""
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] + [pa.int64()] * 2
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            rows = [measure(x.as_py() or b"", squeeze) for x in b.column(1)]
            cols = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", *names])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return src.mapInArrow(run, f"doc_id long, {FIELDS}")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, all columns, row by row (no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        for b in batches:
            texts = b.column(b.schema.get_field_index("text"))
            mask = [measure((x.as_py() or "").encode(), squeeze)[6] for x in texts]
            yield b.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op6 over all documents; adds ratio, bad_chunks, n_chunks."""
    return scores(C.table(spark, sf_dir, "documents"))
