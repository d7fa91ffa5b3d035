"""12. Cross-tokenizer alignment by token spans.

Every text, behind a blank, is encoded by a byte-level vocabulary (A) and by a
sentence-piece vocabulary (B). Character offsets of A's tokens and spans of
B's pieces are coarse cuts; tokens that end within a character, byte-fallback
pieces and the added blank are refined by their decoded bytes from the last
coarse cut on. Where tokens of both end, a group ends; all A-B pairs of a
group are links, and a pair's count is the number of documents that hold it.

A batch of documents sends its distinct pairs with its document counts, so the
rows sent are in proportion to the input; pairs are summed by a shuffle, and
the sums go back to the batches that asked. A group of a third of a text costs
its distinct ids, not its links.

Defined results: texts that are null, empty or not given back byte by byte by
both vocabularies have no tokens: zeros and an empty digest; equal rows are
documents each; null ids are kept; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kbspark.llm import common as C
from kbspark.llm import tokens
from kbspark.llm.lm import packed, unpacked

BATCH_BYTES = 3_000_000  # of text in a batch
REMEMBERED = 400_000     # chunks of a worker
TEXTS_AT_ONCE = 200      # of a batch, in the arrays that link them
AT_ONCE = 8_000          # chunks analysed together
BLOCK = 500              # chunks encoded in one text
ONE = np.int64(1).tobytes()
PIECE_BITS = 32          # a pair's code: A's id, then so many bits of B's
BLANK = "▁"
FENCE = "\n"
SPANNING = re.compile(rf"\S[ \n\t]|[{tokens.LETTERS}][.,]|{FENCE}")
SPAN = attrgetter("id", "begin", "end")
FALLBACK = re.compile(r"<0x([0-9A-F]{2})>")

PARTS = ("batch long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string,"
         " at binary, times binary, pairs array<long>, docs array<long>")
RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def byte_alphabet() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable
    ones stand for themselves, the rest are numbered from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def flat(rows: Iterable[Iterable[tuple]], width: int = 2) -> np.ndarray:
    return np.fromiter(chain.from_iterable(chain.from_iterable(rows)), np.int64).reshape(-1, width)


def exact_ends(coarse: np.ndarray, sure: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Byte ends of tokens: the coarse cut where it is sure, else the last sure
    one and the decoded bytes since. Position 0 is a sure cut."""
    total = np.concatenate([[0], np.cumsum(size)])
    coarse = np.concatenate([[0], coarse])
    last = np.maximum.accumulate(np.where(np.concatenate([[True], sure]), np.arange(len(coarse)), 0))
    return (coarse[last] + total - total[last])[1:]


class Aligner:
    """Groups and links of texts by their chunks."""

    def __init__(self, path_a: str = tokens.BYTE_BPE, path_b: str = tokens.PIECE_BPE, memo: tokens.Memo | None = None):
        tokens.single_threaded()
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        signs = byte_alphabet()
        size_a, size_b = self.a.get_vocab_size(), self.b.get_piece_size()
        special = set(self.a.get_added_tokens_decoder())
        self.bytes_a = [b"" if i in special else bytes(map(signs.__getitem__, self.a.id_to_token(i))) for i in range(size_a)]
        pieces = [self.b.id_to_piece(i) for i in range(size_b)]
        self.bytes_b = [bytes([int(m[1], 16)]) if (m := FALLBACK.fullmatch(p)) else p.replace(BLANK, " ").encode() for p in pieces]
        #: chunks may be cut off only if no piece spans a cut, and stand alone behind FENCE, that no piece has
        self.whole = any(SPANNING.search(p.replace(BLANK, " ")) for p in pieces)
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        most = max(size_a, size_b)
        self.said = {s: np.array([f"{i}{s}" for i in range(most)], object) for s in ",|;\n"}
        self.memo = memo or tokens.Memo()

    def cut(self, text: str) -> list[str]:
        return [text] if self.whole else tokens.chunks(text)

    def spans(self, texts: list[str]) -> tuple:
        """Ids and exact byte ends (over the texts laid end to end) by A and by
        B, and which texts both give back."""
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        base = np.cumsum(sizes) - sizes
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        byte_at = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))])
        chars = np.array([len(t) for t in texts], np.int64)
        found = self.a.encode_batch(texts, add_special_tokens=False)
        ids_a = [e.ids for e in found]
        n_a = np.array([len(x) for x in ids_a], np.int64)
        ids_a = np.fromiter(chain.from_iterable(ids_a), np.int64, n_a.sum())
        off = flat(e.offsets for e in found) + np.repeat(np.cumsum(chars) - chars, n_a)[:, None]
        sure = np.append(off[1:, 0] >= off[:-1, 1], True)  # the next token has no part of the character
        end_a = exact_ends(byte_at[off[:, 1]], sure, self.len_a[ids_a])
        # B adds a blank: the text's own first one stands aside, or the added one and the fence go
        protos = self.b.encode([t[1:] for t in texts] if self.whole else [FENCE + t for t in texts], return_type="proto", num_threads=1)
        aside = 0 if self.whole else 2
        pieces = [list(x.pieces) for x in protos]
        n_b = np.array([len(x) - aside for x in pieces], np.int64)
        rows = flat((map(SPAN, x[aside:]) for x in pieces), 3)
        ids_b, shift = rows[:, 0], 1 if self.whole else -len(FENCE)
        end_b = exact_ends(rows[:, 2] + np.repeat(base + shift, n_b), rows[:, 2] > rows[:, 1], self.len_b[ids_b])
        raw = joined.encode()
        good = np.ones(len(texts), bool)
        for ids, n, table in ((ids_a, n_a, self.bytes_a), (ids_b, n_b, self.bytes_b)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw:
                at = np.concatenate([[0], np.cumsum(n)])
                for k, t in enumerate(texts):
                    good[k] &= b"".join(map(table.__getitem__, ids[at[k]:at[k + 1]].tolist())) == t.encode()
        return ids_a, end_a, ids_b, end_b, good

    def analysed(self, parts: list[str]) -> dict[str, tuple | None]:
        """Of each chunk (n_a, n_b, groups, links, digest text, pair codes,
        times that each is linked); None if it is not given back. Chunks that
        begin with white space and do not end with it are encoded many in a
        text, as all that stand in one are."""
        free = [c for c in parts if not self.whole and c[0] in " \n\t" and not c[-1].isspace()]
        blocks = [free[k:k + BLOCK] for k in range(0, len(free), BLOCK)]
        alone = parts if self.whole else set(parts).difference(free)
        out: dict[str, tuple | None] = {}
        while blocks or alone:
            blocks, alone = blocks + [[c] for c in alone], []
            found = self.spans(["".join(b) for b in blocks])
            good = found[-1]
            if good.all():
                return out | self.groups([c for b in blocks for c in b], *found[:-1])
            out.update((b[0], None) for b, x in zip(blocks, good) if len(b) == 1 and not x)
            alone = [c for b, x in zip(blocks, good) if len(b) > 1 and not x for c in b]
            blocks = [b for b, x in zip(blocks, good) if x]
        return out

    def groups(self, parts: list[str], ids_a: np.ndarray, end_a: np.ndarray, ids_b: np.ndarray, end_b: np.ndarray) -> dict[str, tuple]:
        """From the tokens of chunks laid end to end."""
        ends = np.cumsum([len(c.encode()) for c in parts])
        n_a = np.bincount(np.searchsorted(ends, end_a), minlength=len(parts))
        n_b = np.bincount(np.searchsorted(ends, end_b), minlength=len(parts))
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        text_of = np.searchsorted(ends, cuts)
        n_groups = np.bincount(text_of, minlength=len(parts))
        n_links = np.bincount(text_of, in_a * in_b, minlength=len(parts)).astype(np.int64)
        # digest: A's ids of a group, then B's, each with the sign behind it
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        out = np.empty(len(ids_a) + len(ids_b), object)
        last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
        out[np.arange(len(ids_a)) + before_b[group_a]] = np.where(last_a, self.said["|"][ids_a], self.said[","][ids_a])
        ending = last_b & (ends[np.searchsorted(ends, end_b)] == end_b)
        out[np.arange(len(ids_b)) + (before_a + in_a)[group_b]] = np.where(
            ending, self.said["\n"][ids_b], np.where(last_b, self.said[";"][ids_b], self.said[","][ids_b]))
        digest = "".join(out.tolist()).split("\n")
        # distinct ids of a group with their number, then pairs of those
        wide = np.int64(1) << PIECE_BITS
        key_a, times_a = np.unique(group_a * wide + ids_a, return_counts=True)
        key_b, times_b = np.unique(group_b * wide + ids_b, return_counts=True)
        own_b = np.bincount(key_b // wide, minlength=len(cuts))
        many = own_b[key_a // wide]
        left = np.repeat(np.arange(len(key_a)), many)
        right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + (np.cumsum(own_b) - own_b)[key_a[left] // wide]
        code = (key_a[left] % wide) * wide + key_b[right] % wide
        times = times_a[left] * times_b[right]
        at = np.concatenate([[0], np.cumsum(np.bincount(text_of[key_a[left] // wide], minlength=len(parts)))]).tolist()
        raw, one = code.tobytes(), (np.add.reduceat(times != 1, at[:-1]) == 0).tolist()  # every chunk has links
        return {c: (*x, raw[8 * i:8 * j], b"" if plain else times[i:j].tobytes())
                for c, plain, *x, i, j in zip(parts, one, n_a.tolist(), n_b.tolist(), n_groups.tolist(), n_links.tolist(), digest, at, at[1:])}

    def __call__(self, texts: list[str | None]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each text (n_a, n_b, groups, links, digest); the distinct pairs of
        all, and of each text's pairs: the text, the pair's place, the links."""
        cut = [self.cut(" " + t) if t else [] for t in texts]
        need = set().union(*cut)
        new = self.memo.missing(need)
        known = self.memo.young
        for k in range(0, len(new), AT_ONCE):
            known.update(self.analysed(new[k:k + AT_ONCE]))
        number = {c: k for k, c in enumerate(need)}
        found = [known[c] for c in number]
        bad = {c for c, x in zip(number, found) if x is None}
        cut = [[] if bad and not bad.isdisjoint(c) else c for c in cut]  # a chunk that is not given back spoils its text
        none = (0, 0, 0, 0, "", b"", b"")
        cols = list(zip(*[x or none for x in found])) or [[]] * 7
        said, plain = cols[4], np.array(cols[:4], np.int64).reshape(4, -1)
        code = np.frombuffer(b"".join(cols[5]), np.int64)
        times = np.frombuffer(b"".join(t or ONE * (len(c) // 8) for c, t in zip(*cols[5:])), np.int64)
        many = np.array([len(x) // 8 for x in cols[5]], np.int64)
        pairs, place = np.unique(code, return_inverse=True)
        first = np.cumsum(many) - many
        heads, out = [], []
        for k in range(0, len(cut), TEXTS_AT_ONCE):
            idx = [np.fromiter(map(number.__getitem__, c), np.int64, len(c)) for c in cut[k:k + TEXTS_AT_ONCE]]
            heads += [(*plain[:, x].sum(axis=1).tolist(), ";".join(map(said.__getitem__, x.tolist()))) for x in idx]
            doc = np.repeat(np.arange(k, k + len(idx)), [len(x) for x in idx])
            width = np.int64(max(1, len(number)))
            held, n = np.unique(doc * width + np.concatenate(idx), return_counts=True)  # chunks of each text
            chunk = held % width
            row = np.repeat(np.arange(len(held)), many[chunk])
            src = np.arange(len(row)) + np.repeat(first[chunk] - np.cumsum(many[chunk]) + many[chunk], many[chunk])
            wide = np.int64(max(1, len(pairs)))
            key = (held // width)[row] * wide + place[src]
            order = np.argsort(key)
            key, value = key[order], (n[row] * times[src])[order]
            at = np.flatnonzero(np.diff(key, prepend=-1))
            out.append((key[at] // wide, key[at] % wide, np.add.reduceat(value, at) if len(at) else value))
        doc, at, links = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        return heads, pairs, doc, at, links


# ---- Spark jobs -----------------------------------------------------------

def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """PARTS rows of doc_id and text: a row for each document, whose pairs are
    places in its batch's list, and one row for each batch with that list and
    in how many of its documents each pair is."""
    kept = docs.sparkSession.sparkContext.broadcast({})
    names = [x.split()[0] for x in PARTS.split(",")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = tokens.one_of_worker(kept, lambda: Aligner(path_a, path_b, tokens.Memo(REMEMBERED)))
        task = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(C.text_batches(batches, BATCH_BYTES)):
            heads, pairs, doc, at, links = align(texts)
            batch = (task << 32) + k
            cuts = np.searchsorted(doc, np.arange(len(ids) + 1)).tolist()
            rows = [(batch, i, *h[:4], hashlib.sha256(h[4].encode()).hexdigest() if h[0] else "",
                     packed(np.diff(at[u:v], prepend=0)), packed(links[u:v]), None, None)
                    for i, h, u, v in zip(ids, heads, cuts, cuts[1:])]
            rows.append((batch, *[None] * 8, pairs, np.bincount(at, minlength=len(pairs))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PARTS)


def counted(parts: DataFrame) -> DataFrame:
    """For each pair of each batch: its place there, its documents, and whether
    that is the most of any pair with its A id."""
    asked = parts.where("pairs is not null").select("batch", F.posexplode(F.arrays_zip("pairs", "docs")).alias("at", "x"))
    asked = asked.select("batch", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))
    sums = asked.groupBy("pair").agg(F.sum("docs").alias("n"))
    sums = sums.withColumn("a", F.shiftright("pair", PIECE_BITS))
    best = sums.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A's vocabulary at most
    sums = sums.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("is_best"))
    return asked.select("batch", "at", "pair").join(sums, "pair").select(F.col("batch").alias("to"), "at", "n", "is_best")


def answered(parts: DataFrame) -> DataFrame:
    names = [x.split()[0] for x in RESULT.split(", ")]

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.column("at").to_numpy().argsort()
        n, best = right.column("n").to_numpy()[order], right.column("is_best").to_numpy()[order]
        total, top = [], []
        for at, links in zip(left.column("at"), left.column("times")):
            at, links = np.cumsum(unpacked(at.as_py())).astype(np.int64), unpacked(links.as_py()).astype(np.int64)
            total.append(int((n[at] * links).sum()))
            top.append(int(links[best[at]].sum()))
        kept = [left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*kept, pa.array(top, pa.int64()), pa.array(total, pa.int64()), left.column("groups_sha256")], names=names)

    docs = parts.where("at is not null").select("batch", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times")
    return docs.groupBy("batch").cogroup(counted(parts).groupBy("to")).applyInArrow(join, RESULT)


def align(docs: DataFrame, path_a: str = tokens.BYTE_BPE, path_b: str = tokens.PIECE_BPE) -> DataFrame:
    return answered(C.written(aligned(docs, path_a, path_b), "aligned", compression="zstd"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op12 over all documents."""
    return align(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
