"""4. Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.
A word's likelihood is the sum over all its segmentations into pieces (forward
algorithm); a text's is the product over its words, which are runs of letters,
lower-cased. The probabilities are fitted by expectation-maximisation over
all segmentations (forward-backward) of a bounded sample of labelled rows.

Defined results: null texts and texts without a letter are `und` with score 0;
with no labelled training row every text is; ties go to the first language in
code point order; equal texts get equal predictions; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kbspark.llm import common as C

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 400      # bound of the labelled sample, per language
ROUNDS = 4            # of expectation-maximisation
SMOOTHING = 0.01      # added to each expected piece count
LOG_UNKNOWN = math.log(1e-7)  # of a character outside the vocabulary
RESCALED = 24         # letters after which the sums of a run are scaled anew
CACHE = 300_000       # tokens whose likelihood a task remembers
GROUP = 256           # documents looked up together
SCALE = 1e3           # of a character's likelihood: 1e-9 to 1e3 each, so RESCALED of them stay in range
CHAR_BITS = 21       # of a code point
MARK = "▁"       # begins a word in the vocabulary
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """The vocabulary's text pieces, lower-cased, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted({sp.id_to_piece(i).lower() for i in kept})


def runs(token: str) -> list[str]:
    """Letter runs of a token, marked as words."""
    token = token.lower()
    return [MARK + token] if token.isalpha() else [MARK + run for run in LETTERS.findall(token)]


class Lattice:
    """All segmentations of words over the vocabulary."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        self.length = np.array([len(p) for p in pieces] + [1, 0])
        step: dict[int, int] = {}  # node and character to the next node of the trie
        ends = [-1]                # of each node: the piece that ends there
        for i, p in enumerate(pieces):
            node = 0
            for c in p:
                node = step.setdefault(node << CHAR_BITS | ord(c), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = i
        keys = sorted(step)
        self.keys = np.array(keys + [np.iinfo(np.int64).max])  # the last one is met by no search
        self.nodes = np.array([step[k] for k in keys] + [0])
        self.ends = np.array(ends, np.int32)

    def edges(self, words: list[str]) -> np.ndarray:
        """words x start x length of equally long words: piece numbers, -1
        for none, -2 for a single character outside the vocabulary."""
        n = len(words[0])
        depth = min(n, self.longest)
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out = np.full((len(words) * n, depth), -1, np.int32)
        cell = np.arange(len(chars))  # where pieces may begin, all walked at once
        room, node = n - cell % n, np.zeros(len(chars), np.int64)
        for m in range(depth):
            on = np.flatnonzero(room > m)
            key = node[on] << CHAR_BITS | chars[cell[on] + m]
            at = np.searchsorted(self.keys, key)
            hit = self.keys[at] == key
            on, node = on[hit], self.nodes[at[hit]]
            cell, room = cell[on], room[on]
            out[cell, m] = self.ends[node]
        out = out.reshape(len(words), n, depth)
        single = out[:, :, 0]
        single[single == -1] = -2
        return out

    @staticmethod
    def forward(ids: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """words x (n + 1) x languages log sums; logp has two rows more than
        pieces, for -2 and for -1 (minus infinity)."""
        k, n, depth = ids.shape
        alpha = np.full((k, n + 1, logp.shape[1]), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, n + 1):
            for m in range(1, min(j, depth) + 1):
                p = ids[:, j - m, m - 1]
                at = np.flatnonzero(p != -1)
                if len(at):
                    alpha[at, j] = np.logaddexp(alpha[at, j], alpha[at, j - m] + logp[p[at]])
        return alpha

    def likelihoods(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log likelihoods of words. Sums run in plain numbers: SCALE for each
        character keeps them in range, and every RESCALED characters what is
        summed so far is divided by the sum there, whose logarithm is kept."""
        p = np.exp(logp) * SCALE ** self.length[:, None].astype(float)
        out = np.zeros((len(words), logp.shape[1]))
        for at in by_length(words):
            ids = self.edges([words[i] for i in at])
            k, n, depth = ids.shape
            alpha = np.zeros((n + 1, k, logp.shape[1]))
            alpha[0] = 1
            kept = np.zeros((k, logp.shape[1]))
            for i in range(n):
                if i and i % RESCALED == 0:  # sums from before reach depth - 1 positions on
                    here = alpha[i].copy()
                    alpha[i:i + depth] /= here
                    kept += np.log(here)
                for m in range(1, min(depth, n - i) + 1):
                    on = np.flatnonzero(ids[:, i, m - 1] != -1)
                    if len(on):
                        alpha[i + m, on] += alpha[i, on] * p[ids[on, i, m - 1]]
            out[at] = np.log(alpha[n]) + kept - n * math.log(SCALE)
        return out

    def expected(self, words: list[str], weight: np.ndarray, logp: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected piece counts of words (one language, ``logp`` of
        one column) times weight to ``total``."""
        for at in by_length(words):
            ids = self.edges([words[i] for i in at])
            k, n, depth = ids.shape
            alpha = self.forward(ids, logp)[:, :, 0]
            beta = np.full((k, n + 1), -np.inf)
            beta[:, n] = 0
            for i in range(n - 1, -1, -1):
                for m in range(1, min(depth, n - i) + 1):
                    p = ids[:, i, m - 1]
                    on = np.flatnonzero(p != -1)
                    if len(on):
                        step = logp[p[on], 0] + beta[on, i + m]
                        beta[on, i] = np.logaddexp(beta[on, i], step)
                        known = on[p[on] >= 0]
                        if len(known):
                            q = p[known]
                            share = np.exp(alpha[known, i] + logp[q, 0] + beta[known, i + m] - alpha[known, n])
                            np.add.at(total, q, share * weight[at][known])


def by_length(words: list[str], most: int = 20_000) -> Iterator[np.ndarray]:
    """Positions of equally long words, a bounded number at a time."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        step = max(1, most // int(n))
        for k in range(0, len(at), step):
            yield at[k:k + step]


def log_table(counts: np.ndarray) -> np.ndarray:
    """Piece log probabilities of every language, and the two rows behind."""
    p = np.log(counts + SMOOTHING) - np.log((counts + SMOOTHING).sum(0))
    extra = np.array([[LOG_UNKNOWN], [-np.inf]]).repeat(counts.shape[1], 1)
    return np.concatenate([p, extra])


def sample(docs: DataFrame, per_lang: int = TRAIN_DOCS) -> DataFrame:
    """lang and text of at most ``per_lang`` labelled training rows of each
    language, those with the lowest hash."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return rows.select("lang", "text")
    # the threshold leaves about twice the bound to be ranked
    rate = F.create_map(*[x for k, v in n.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * per_lang / v)))])[F.col("lang")]
    rows = rows.withColumn("_u", C.unit_draw(11, F.col("doc_id"), F.xxhash64("text"))).where(F.col("_u") < rate)
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_u", "doc_id")))
    return ranked.where(F.col("_r") <= per_lang).select("lang", "text")


def held_out(doc_id) -> object:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, pieces: list[str], per_lang: int = TRAIN_DOCS,
          rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages and the log table."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for token, k in Counter(text.split()).items():
                    for w in runs(token):
                        n[lang, w] += k
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in n], pa.string()), pa.array([x[1] for x in n], pa.string()),
                                              pa.array(list(n.values()), pa.int64())], ["lang", "word", "n"])

    words = (sample(docs, per_lang).mapInArrow(count, "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")).checkpoint())
    langs = sorted(r[0] for r in words.select("lang").distinct().collect())
    counts = np.ones((len(pieces), len(langs)))
    for _ in range(rounds if langs else 0):
        model = spark.sparkContext.broadcast((pieces, log_table(counts)))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, table = model.value
            lattice, total = Lattice(known), np.zeros((len(langs), len(known)))
            for b in batches:
                lang, word, n = (b.column(k).to_pylist() for k in range(3))
                for k, name in enumerate(langs):
                    own = [i for i, x in enumerate(lang) if x == name]
                    if own:
                        lattice.expected([word[i] for i in own], np.array([n[i] for i in own], float), table[:, k:k + 1], total[k])
            k, p = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(p, pa.int64()), pa.array(total[k, p])], ["k", "p", "n"])

        got = words.mapInArrow(expect, "k long, p long, n double").groupBy("k", "p").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros((len(pieces), len(langs)))
        for r in got:  # languages * vocabulary at most
            counts[r["p"], r["k"]] = r["n"]
    return langs, log_table(counts)


class Scorer:
    """Likelihoods of whole texts, with those of tokens remembered."""

    def __init__(self, lattice: Lattice, table: np.ndarray, langs: list[str]):
        self.lattice, self.table, self.langs = lattice, table, langs
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.known: dict[str, np.ndarray] = {}  # words, shared by tokens that differ in case and marks
        self.log = np.zeros((1_024, len(self.langs)))
        self.letters = np.zeros(1_024, bool)

    def learn(self, tokens: Iterable[str]) -> None:
        tokens = list(tokens)
        parts = [runs(t) for t in tokens]
        words = list({w for p in parts for w in p}.difference(self.known))
        if words:
            self.known.update(zip(words, self.lattice.likelihoods(words, self.table)))
        start = len(self.row)
        while start + len(tokens) > len(self.log):
            self.log = np.concatenate([self.log, np.zeros_like(self.log)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        for i, (t, p) in enumerate(zip(tokens, parts), start):
            self.row[t] = i
            self.letters[i] = bool(p)
            if len(p) == 1:
                self.log[i] = self.known[p[0]]
            elif p:
                self.log[i] = sum(self.known[w] for w in p)
            else:
                self.log[i] = 0

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        split = [t.split() if t else [] for t in texts]
        if len(self.row) > CACHE:
            self.forget()
        new = set().union(*split).difference(self.row)
        if new:
            self.learn(sorted(new))
        for tokens in split:
            at = np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))
            if not self.langs or not self.letters[at].any():
                yield "und", 0.0
                continue
            log = self.log[at].sum(0)
            best = int(np.argmax(log))
            yield self.langs[best], float(1 / np.exp(log - log[best]).sum())


def predict(spark: SparkSession, docs: DataFrame, langs: list[str], table: np.ndarray, pieces: list[str]) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = spark.sparkContext.broadcast((pieces, table, langs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, log, names = model.value
        score = Scorer(Lattice(known), log, names)
        for b in batches:
            found: list[tuple[str, float]] = []
            for k in range(0, b.num_rows, GROUP):
                found += score(b.column(2).slice(k, GROUP).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    src = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string"))
    return src.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Contract of op4 over all documents."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = load_pieces(vocabulary)
    langs, log = train(spark, docs, pieces)
    return predict(spark, docs, langs, log, pieces)
