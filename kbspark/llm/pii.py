"""10. Personal data by candidate gradient boosting.

High-recall generators propose overlapping spans of four kinds; boosted trees
over format and context features score them; per kind a threshold calibrated
for precision selects those that are added to the base spans, which always
stay. The trees learn from the candidates of all documents, equal ones counted,
level by level from sums over the executors' rows: right are the base spans, as they
stand and loosened (sign dropped, at and dot spelled out, other separators);
wrong are candidates that fail the check of their kind or stand behind an
anti-cue, and loosened base spans made to do so. Other candidates have no label
and count neither in the fit nor in the calibration. Generated lines with spans
of every kind are learned from beside them, so that the trees know all
kinds whatever the corpus holds, and they alone decide what is added.

Defined results: null and empty texts have no spans; equal texts have equal
spans; of a kind without a threshold that is precise enough nothing is added;
an empty table gives an empty result; ``redact`` passes other columns through.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone")
LONGEST = 1_024             # a feature above counts as this in training
BLOCK_ROWS = 20_000         # different candidates that a task learns from, about
SCALE = 2**20               # steps of a gradient, in which sums are exact
STEPS = 10_000              # of a probability, in which thresholds are found
GENERATED = 600             # lines
PRECISION = 0.98            # that a threshold must reach on the calibration part
TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 3, 0.3, 32, 20
CONTEXT = 32                # characters before a span that are searched for cues

DIGIT = re.compile("[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits does
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

AT = re.compile(r"@|[\[(]\s?at\s?[\])]|\sat\s", re.I)
DOT = re.compile(r"\.|[\[(]\s?dot\s?[\])]|\sdot\s", re.I)
LOOSE = {
    # a dot with a space on one side only ends a sentence
    "email": re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}(?:\s?(?:@|[\[(]\s?at\s?[\])])\s?|\sat\s(?=[\w-]{1,63}\sdot\s))[\w-]{1,63}"
                        r"(?:(?:\.|\s\.\s|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)[\w-]{1,63}){1,8}", re.I),
    "ip": re.compile(r"(?<![\w.:])(?:[0-9]{1,3}(?:\s?[.,]\s?[0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})(?![\w:])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ ./_-]{0,2}[0-9]){11,18}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])\(?[0-9]{1,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,4}\)?){1,4}(?![0-9A-Za-z])"),
}
CUES = re.compile(r"\b(tel|phone|call|fax|mobile|e-?mail|mail|contact|card|visa|payment|ip|host|address|server)\b", re.I)
ANTI_CUES = re.compile(r"\b(version|license|licence|order|invoice|isbn|page|chapter|section|id|no|number|token|password|key|hash)\b", re.I)
DATE = re.compile(r"(?:19|20)[0-9]{2}([./-])[0-9]{1,2}\1[0-9]{1,2}(?![0-9])|[0-9]{1,2}([./-])[0-9]{1,2}\2(?:19|20)?[0-9]{2}(?![0-9])")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = (2 * int(c) for c in digits[-2::-2])
    return (sum(map(int, odd)) + sum(x - 9 * (x > 9) for x in even)) % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in address.split("."))


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email rule, linear in the text: each ends a run of local
    characters with the address's sign, so it starts where the run does."""
    free, at = 0, text.find("@")
    while at >= 0:
        end = at + 1
        if m := DOMAIN.match(text, at):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                free = end = m.end()
        at = text.find("@", end)


def base_spans(text: str) -> list[Span]:
    """Accepted base spans by kind, then start."""
    out: list[Span] = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = digits_of(m[0])
            if 13 <= len(d) <= 19 and luhn(d):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def proposals(text: str, taken: list[Span]) -> list[Span]:
    """Loose candidates of all kinds, overlapping one another but no base span."""
    found: list[Span] = []
    numbers = DIGIT.search(text) is not None
    for k, kind in enumerate(KINDS):
        if numbers if k else AT.search(text):
            found += [(k, *m.span()) for m in LOOSE[kind].finditer(text)]
    if not found or not taken:
        return found
    starts = sorted((a, b) for _, a, b in taken)
    lows = [a for a, _ in starts]
    highs = np.maximum.accumulate([b for _, b in starts])
    keep = []
    for s in found:
        i = int(np.searchsorted(lows, s[2]))  # base spans that begin before the end
        if not i or highs[i - 1] <= s[1]:
            keep.append(s)
    return keep


def passes(kind: int, s: str) -> bool:
    """Whether a candidate can be what its kind says."""
    d = digits_of(s)
    if kind == 0:
        labels = [x.strip() for x in DOT.split(AT.split(s, maxsplit=1)[-1])]
        return all(x and x[0] != "-" != x[-1] for x in labels) and re.fullmatch("[A-Za-z]{2,24}", labels[-1]) is not None
    if kind == 1:
        return s.count(":") == 7 if ":" in s else "," not in s and small_parts("".join(s.split()))
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and not DATE.match(s) and not LOOSE["ip"].fullmatch(s)


def cues(text: str, a: int) -> tuple[int, int]:
    """Cues and anti-cues before a place."""
    before = text[max(0, a - CONTEXT):a]
    return len(CUES.findall(before)), len(ANTI_CUES.findall(before))


def is_wrong(text: str, span: Span) -> bool:
    """Evidence against a candidate that does not come from the base rules."""
    kind, a, b = span
    cue, anti = cues(text, a)
    if not passes(kind, text[a:b]) or anti > 0 and not cue:
        return True
    return kind == 3 and not cue and text[a:b].isdigit()  # a bare number


def loosened(kind: int, s: str, k: int) -> str:
    """The k-th of the forms in which a base span is also written."""
    if kind == 0:
        local, host = s.split("@", 1)
        at, dot = ((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", " . "), ("(at)", "."))[k % 6]
        return local + at + host.replace(".", dot)
    if kind == 1:
        parts = [int(x) for x in s.split(".")]
        if k % 4 == 3:
            return ":".join(f"{x * 251 + i * 4099 & 0xFFFF:x}" for i, x in enumerate(parts * 2))
        return (" . ", ". ", " .")[k % 4].join(map(str, parts))
    if kind == 2:
        return (".", "/", "_", "  ")[k % 4].join(re.findall("[0-9]{1,4}", digits_of(s)))
    bare = s.lstrip("+")
    if k % 4 == 0:
        return bare
    if k % 4 == 1:
        return "00" + bare
    groups = re.findall("[0-9]+", bare)
    if k % 4 == 2 and len(digits_of("".join(groups[1:]))) >= 9:  # country code left out
        return bare[bare.index(groups[0]) + len(groups[0]):].lstrip(" .-")
    return ".- "[k % 3].join(groups)


def spoiled(kind: int, s: str, k: int) -> str:
    """A loosened form made to fail the check of its kind."""
    if kind == 0:
        return s + str(k % 10)
    at = max(i for i, c in enumerate(s) if "0" <= c <= "9") if kind != 1 or ":" not in s else 0
    if kind == 1:
        return s[:s.rindex(":")] if ":" in s else re.sub("[0-9]+$", str(256 + k % 744), s)
    if kind == 2:
        return s[:at] + str((int(s[at]) + 1 + k % 9) % 10) + s[at + 1:]
    return s


def variants(text: str, span: Span, k: int) -> Iterator[tuple[int, list[float]]]:
    """Labels and features of a base span's loosened form, the k-th, in its
    place in the text, and of that form spoiled or behind an anti-cue, if they
    are candidates there."""
    kind, a, b = span
    before, after = text[max(0, a - CONTEXT):a], text[b:b + CONTEXT]
    form = loosened(kind, text[a:b], k)
    anti = ("version ", "order ", "invoice no ", "page ", "license key ")[k % 5]
    for y, head, s in ((1, before, form), (0, anti if kind == 3 or k % 3 == 0 else before,
                                           form if kind == 3 or k % 3 == 0 else spoiled(kind, form, k))):
        whole = head + s + after
        for c in proposals(whole, base_spans(whole)):
            if c[0] == kind and (c[1], c[2]) == (len(head), len(head) + len(s)) and (y == 1 or is_wrong(whole, c)):
                yield y, features(whole, c)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    kind, a, b = span
    s = text[a:b]
    d = digits_of(s)
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    before, after = text[max(0, a - CONTEXT):a], text[b:b + 1]
    cue, anti = cues(text, a)

    def kind_of(c: str) -> int:
        return 0 if not c or c.isspace() else 3 if c.isdigit() else 2 if c.isalpha() else 1

    tail = re.split(r"[.\])]", s)[-1]
    return [kind, len(s), len(d), sum(c.isalpha() for c in s), s.count(" "), s.count("."), s.count("-"),
            s.count("(") + s.count("["), s.count("/") + s.count(",") + s.count("_"), len(groups), groups[0], max(groups), groups[-1],
            len(set(d)), float(12 <= len(d) <= 19 and luhn(d)), float(s.count(".") == 3 and all(g < 4 for g in groups)),
            kind_of(before[-1:]), kind_of(after), cue, anti,
            len(tail) if kind == 0 else 0, float(len(d) in (10, 11, 12)), float(passes(kind, s))]


# ---- boosted trees --------------------------------------------------------

Block = tuple[np.ndarray, np.ndarray, np.ndarray]  # bins by feature, labels and numbers of equal rows


def edges_of(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Limits of the bins of a feature with these values, in order: the
    quantiles of all rows."""
    ends = np.cumsum(counts)
    at = np.linspace(0, 1, BINS) * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, f(at), side="right")] for f in (np.floor, np.ceil))
    return np.unique(low + (high - low) * (at - np.floor(at)))


def binned_rows(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)], axis=1).astype(np.uint8)


def nodes(tree: list, binned: np.ndarray) -> np.ndarray:
    """The place in a tree, whose limits are bins, that each row comes to."""
    f, limit, left, right = (np.array([n[i] for n in tree], int) for i in range(4))
    inner = f >= 0
    left, right = (np.where(inner, x, np.arange(len(tree))) for x in (left, right))
    at, rows = np.zeros(len(binned), int), np.arange(len(binned))
    for _ in range(DEPTH):
        at = np.where(binned[rows, f[at]] <= limit[at], left[at], right[at])
    return at


def histogram(block: Block, start: float, trees: list, places: list[int], width: int) -> np.ndarray:
    """Sums of gradient, curvature and count by place of the last tree, feature
    and bin; whole numbers, so that the order of adding does not matter."""
    binned, y, n = block
    score = np.full(len(y), start)
    for tree in trees[:-1]:
        score += np.array([node[4] for node in tree])[nodes(tree, binned)]
    p = 1 / (1 + np.exp(-score))
    slot = np.full(len(trees[-1]), -1)
    slot[places] = np.arange(len(places))
    at = slot[nodes(trees[-1], binned)]
    rows = at >= 0
    out = np.zeros((3, len(places), binned.shape[1], width), np.int64)
    for i, v in enumerate((n * (y - p) * SCALE, n * p * (1 - p) * SCALE, n)):
        v = np.rint(v[rows])  # whole: sums in doubles are exact
        for f in range(binned.shape[1]):
            cell = at[rows] * width + binned[rows, f]
            out[i, :, f] = np.bincount(cell, v, len(places) * width).reshape(len(places), width)
    return out


class Boosted:
    """Gradient boosting of small regression trees on the logistic loss. Each
    level of a tree is one pass over the rows, which may lie in many blocks."""

    def __init__(self):
        self.start, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        """Of rows at hand."""
        edges = [edges_of(*np.unique(c, return_counts=True)) for c in x.T]
        block = binned_rows(x, edges), y, np.ones(len(y))
        return self.boost(edges, float(y.mean()), lambda *asked: histogram(block, *asked))

    def boost(self, edges: list[np.ndarray], share: float, sums: Callable[..., np.ndarray]) -> "Boosted":
        """``sums`` adds up the ``histogram`` of all rows."""
        self.start, width = float(np.log(share / (1 - share))), max(len(e) for e in edges) + 1
        grown: list = []
        for _ in range(TREES):
            grown.append([(-1, 0, 0, 0, 0.0)])
            places = [0]
            for _ in range(DEPTH):
                if places:
                    places = self._level(grown[-1], places, edges, sums(self.start, grown, places, width))
        self.trees = [[(f, float(edges[f][k]) if f >= 0 else 0.0, left, right, value) for f, k, left, right, value in tree] for tree in grown]
        return self

    def _level(self, tree: list, places: list[int], edges: list[np.ndarray], sums: np.ndarray) -> list[int]:
        """Splits the places where that gains; returns those that may be split on."""
        below = []
        for slot, place in enumerate(places):
            g, h, n = sums[0, slot] / SCALE, sums[1, slot] / SCALE, sums[2, slot]
            whole = [v[0].sum() for v in (g, h, n)]
            best, cut = 1e-6, None
            if whole[2] >= 2 * MIN_LEAF:
                for f, e in enumerate(edges):
                    gs, hs, ns = (np.cumsum(v[f])[:len(e)] for v in (g, h, n))
                    ok = (ns >= MIN_LEAF) & (whole[2] - ns >= MIN_LEAF)
                    gain = np.where(ok, gs ** 2 / (hs + 1) + (whole[0] - gs) ** 2 / (whole[1] - hs + 1) - whole[0] ** 2 / (whole[1] + 1), 0)
                    k = int(np.argmax(gain)) if len(gain) else 0
                    if len(gain) and gain[k] > best:
                        best, cut = gain[k], (f, k, gs[k], hs[k])
            if cut is None:
                tree[place] = (-1, 0, 0, 0, RATE * float(whole[0] / (whole[1] + 1)))
                continue
            f, k, left_g, left_h = cut
            at = len(tree)
            tree[place] = (f, k, at, at + 1, 0.0)
            for sg, sh in ((left_g, left_h), (whole[0] - left_g, whole[1] - left_h)):
                tree.append((-1, 0, 0, 0, RATE * float(sg / (sh + 1))))
            below += [at, at + 1]
        return below

    def __call__(self, x: list[float]) -> float:
        total = self.start
        for tree in self.trees:
            f, limit, left, right, value = tree[0]
            while f >= 0:
                f, limit, left, right, value = tree[left if x[f] <= limit else right]
            total += value
        return float(1 / (1 + np.exp(-total)))


def calibrated(p: np.ndarray, y: np.ndarray, precision: float = PRECISION, n: np.ndarray | None = None) -> float:
    """The least threshold of at least a half from which on the precision is
    reached; above 1 if there is none. ``n``: how many rows each stands for."""
    n = np.ones(len(y)) if n is None else n
    order = np.argsort(-p, kind="stable")
    right = np.cumsum((y * n)[order]) / np.cumsum(n[order])
    last = np.append(p[order][1:] != p[order][:-1], True) if len(p) else np.zeros(0, bool)
    good = np.flatnonzero((right >= precision) & last & (p[order] >= 0.5))
    return float(p[order][good[-1]]) if len(good) else 2.0


Labelled = tuple[int, int, int, list[float]]  # hash, label, whether a proposal can look so, features


def labelled_spans(text: str, u: float) -> Iterator[Labelled]:
    """The candidates of a text that have a label; ``u`` is the text's hash."""
    base = base_spans(text)
    found = [(s, 0, 1, 0, features(text, s)) for s in proposals(text, base) if is_wrong(text, s)]
    for s in base:
        found.append((s, 1, 0, 0, features(text, s)))
        k = hash((round(u * 2**40), s)) % 60
        for j in range(2):
            found += [(s, y, 1, 1 + j, x) for y, x in variants(text, s, k + j)]
    for s, y, can, j, x in found:
        yield hash((round(u * 2**40), s, y, j)) % 2**61, y, can, x  # numbers only: alike in every process


def generated(lines: int = GENERATED) -> Iterator[str]:
    """Lines of made-up words and numbers around a span, of the kinds in turn,
    a third of them behind a cue."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8)))
    number = lambda n: "".join(rng.choices("0123456789", k=n))
    cue = {"email": "mail", "ip": "host", "card": "card", "phone": "call"}
    for k in range(lines):
        kind = KINDS[k % 4]
        if kind == "email":
            span = f"{word()}{rng.choice('._-')}{word()}@{word()}.{rng.choice(['com', 'org', 'net', 'de'])}"
        elif kind == "ip":
            span = ".".join(str(rng.randrange(256)) for _ in range(4))
        elif kind == "card":
            body = number(15)
            digits = next(body + c for c in "0123456789" if luhn(body + c))
            span = rng.choice(["", " ", "-"]).join(re.findall("....", digits))
        else:
            span = f"+{rng.randint(1, 99)} {number(3)} {number(3)} {number(rng.randint(3, 5))}"
        other = rng.choice([number(rng.randint(1, 15)), f"{rng.randint(1900, 2099)}-{rng.randint(1, 12)}-{rng.randint(1, 28)}",
                            f"{rng.randrange(99)}.{rng.randrange(99)}", f"{rng.randrange(9)},{number(3)},{number(3)}", word()])
        head = [word() for _ in range(rng.randint(1, 6))] + [cue[kind]] * (rng.random() < 1 / 3)
        yield " ".join([other, *head, span, *(word() for _ in range(rng.randint(0, 5)))])


def as_row(u: int, y: int, loose: int, x: list[float]) -> tuple[int, int, bool, list[int]]:
    """Label, whether a proposal can look so, whether it calibrates (a third by
    hash) and features, which are whole numbers."""
    return y, loose, u % 3 == 2, [min(int(v), LONGEST) for v in x]


def labelled(docs: DataFrame) -> DataFrame:
    """The candidates of all documents and of the generated lines that have a
    label, equal ones as one row with their number ``n``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [as_row(*r) for u, text in zip(b.column(0).to_pylist(), b.column(1)) for r in labelled_spans(text.as_py() or "", u)]
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int16())])],
                                             ["y", "loose", "part", "x"])

    schema = "y int, loose int, part boolean, x array<short>"
    src = docs.select(C.unit_draw(5, F.col("doc_id"), F.xxhash64("text")).alias("u"), F.col("text").cast("string"))
    lines = [as_row(*r) for k, line in enumerate(generated()) for r in labelled_spans(line, k / 2**40)]
    return (src.mapInArrow(run, schema).unionByName(docs.sparkSession.createDataFrame(lines, schema))
            .groupBy("y", "loose", "part", "x").agg(F.count(F.lit(1)).alias("n")))


def train(docs: DataFrame) -> tuple[Boosted, list[float]]:
    """The trees, fitted on two thirds of the labelled candidates of all
    documents, and the threshold of each kind, calibrated on what proposals can
    look like of the rest, in steps of 1 / ``STEPS``. The rows stay in blocks
    on the executors; sums by node, feature and bin come to the driver."""
    ensure_checkpoint_dir(docs.sparkSession)
    rows = labelled(docs).checkpoint(eager=True)
    fit = rows.where(~F.col("part"))
    seen = fit.select("n", F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.sum("n").alias("n")).collect()  # by a bounded number of values
    width = 1 + max(r["f"] for r in seen)
    values = [sorted((r["v"], r["n"]) for r in seen if r["f"] == f) for f in range(width)]
    edges = [edges_of(*(np.array(c, float) for c in zip(*v))) for v in values]
    told = fit.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).first()
    parts = -(-told["rows"] // BLOCK_ROWS)

    def block(rows: Iterator) -> Iterator[Block]:
        cols = list(zip(*rows))
        if cols:
            yield binned_rows(np.array(cols[2], float), edges), np.array(cols[0], float), np.array(cols[1], float)

    blocks = fit.select("y", "n", "x").repartition(parts).rdd.mapPartitions(block).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = Boosted().boost(edges, told["y"] / told["n"], lambda *asked: blocks.map(
            lambda b: histogram(b, *asked)).treeReduce(np.add))
    finally:
        blocks.unpersist()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v[0] for v in x], pa.int32()),
                                              pa.array([int(model(v) * STEPS) for v in x], pa.int32())], ["y", "n", "kind", "step"])

    rest = (rows.where("part and loose = 1").select("y", "n", "x").mapInArrow(scored, "y int, n long, kind int, step int")
            .groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("y")).collect())
    limits = []
    for k in range(len(KINDS)):
        step, n, y = (np.array([r[c] for r in rest if r["kind"] == k], float) for c in ("step", "n", "y"))
        limits.append(calibrated(step / STEPS, y / np.maximum(n, 1), n=n))
    return model, limits


def added(text: str, base: list[Span], model: Boosted, limits: list[float]) -> list[Span]:
    """The proposals that reach their kind's threshold, best first, that overlap
    none taken before."""
    scored = []
    for s in proposals(text, base):
        p = model(features(text, s))
        if p >= limits[s[0]]:
            scored.append((-p, s[1], s[2], s[0]))
    out: list[Span] = []
    starts: list[int] = []
    ends: list[int] = []  # of the taken spans, in page order
    for _, a, b, k in sorted(scored):
        i = bisect.bisect_left(starts, b)  # taken spans before this one's end
        if not i or ends[i - 1] <= a:
            starts.insert(i, a)
            ends.insert(i, b)
            out.append((k, a, b))
    return out


def digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def detect(docs: DataFrame, model: Boosted, limits: list[float]) -> DataFrame:
    """doc_id, the counts of base spans, base_sha256 and spans."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, shas, spans = np.zeros((len(KINDS), b.num_rows), np.int64), [], []
            for i, text in enumerate(b.column(1)):
                text = text.as_py() or ""
                base = base_spans(text)
                for s in base:
                    n[s[0], i] += 1
                shas.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest(base + added(text, base, model, limits)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in n), pa.array(shas, pa.string()),
                                              pa.array(spans, pa.string())],
                                             ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents, all columns, with every span replaced by [KIND]."""
    model, limits = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(b.schema.get_field_index("text")):
                text = x.as_py()
                if text:
                    base = base_spans(text)
                    free = len(text)
                    for k, s, e in sorted(base + added(text, base, model, limits), key=lambda v: (-v[2], v[1])):
                        if e <= free:  # of overlapping spans the one that ends last
                            text, free = f"{text[:s]}[{KINDS[k].upper()}]{text[e:]}", s
                out.append(text)
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(out, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of op10 over all documents."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(docs, *train(docs))
