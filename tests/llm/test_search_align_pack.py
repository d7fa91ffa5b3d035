"""Lexical search, cross-tokenizer alignment and best-fit packing against
brute force."""

from __future__ import annotations

import collections
import functools
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kbspark.llm import alignment, best_fit, lexical, tokens

DOCS = "doc_id long, text string"
SIGNS = " \n\t\r\u0085　'.,!?<|>ab1zEñéß漢字🦙日"
ODD = ["", " ", "\n", "a", "a. b, c\n\nd", "x" * 3_000, "日本語" * 400, "tab\tand  two", "end \n ", "<|endoftext|>",
       "a <|endoftext|> b", "1,000.50!?", "é.ñ,ü", "'s it's", "🦙🦙🦙 llama", "word ." * 50]


def random_text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# ---- tokens ---------------------------------------------------------------

@pytest.fixture(scope="module")
def id_bytes():
    return shared_id_bytes()


def plain_ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@functools.cache
def shared_id_bytes():
    return tokens.IdBytes()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=SIGNS, max_size=60))
def test_chunks_keep_the_ids(text):
    made = shared_id_bytes()
    assert "".join(tokens.chunks(text)) == text
    assert np.frombuffer(made([text])[0], "<u4").tolist() == plain_ids(made.tokenizer, text)


def test_odd_texts_keep_the_ids(id_bytes):
    for text, raw in zip(ODD, id_bytes(ODD)):
        assert np.frombuffer(raw, "<u4").tolist() == plain_ids(id_bytes.tokenizer, text)


def test_ranks_merge_as_the_tokenizer_does():
    """Merging the bytes of every token by lower ranks alone ends with the two
    parts of its merge in the tokenizer: so both libraries merge alike."""
    with open(tokens.BYTE_BPE, encoding="utf-8") as f:
        model = json.load(f)["model"]
    signs = alignment.byte_alphabet()
    raw = lambda s: bytes(map(signs.__getitem__, s))
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ranks = tokens.rank_encoding(tokens.RANK_FILE)._mergeable_ranks
    assert {raw(t): i for t, i in model["vocab"].items() if t != "<|endoftext|>"} == ranks
    assert [ranks[raw(a) + raw(b)] for a, b in merges] == sorted(ranks[raw(a) + raw(b)] for a, b in merges)
    for a, b in merges:
        whole = raw(a) + raw(b)
        parts = [whole[k:k + 1] for k in range(len(whole))]
        while len(parts) > 2:
            rank, k = min((ranks.get(x + y, math.inf), k) for k, (x, y) in enumerate(zip(parts, parts[1:])))
            assert rank < ranks[whole]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        assert parts == [raw(a), raw(b)]


def test_memo_forgets_the_unused():
    memo = tokens.Memo(4)
    for k in range(10):
        for c in memo.missing({f"{k}", "kept"}):
            memo.young[c] = k
    assert memo.young["kept"] == 0 and len(memo.young) + len(memo.old) <= 6


# ---- 11: search -----------------------------------------------------------

def brute_search(docs, items):
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    cut = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, collections.Counter(cut(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    big_n, big_l = len(held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        found = []
        for i, c in held:
            n = sum(c.values())
            m = 100 - 75 + (75 * n * big_n) // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in cut(text) if t in c)
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, k, i, s) for k, (s, i) in enumerate(found[:10], 1)]
    return sorted(out, key=str)


def search_rows(spark, docs, items):
    got = lexical.rank(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_search_equals_brute_force(spark, monkeypatch, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["Ünï", "漢字", "The", "x1"]
    docs = [(i, random_text(rng, words, rng.randint(0, 60))) for i in range(300)]
    docs += [(1_000 + k, docs[7][1]) for k in range(40)]  # a large group of equal scores
    docs += [(None, docs[3][1]), (None, None), (5, ""), (6, "!!"), (7, docs[7][1]), (9_000, random_text(rng, words, 20_000))]
    items = [(k, random_text(rng, words, rng.randint(1, 12))) for k in range(12)]
    items += [(50, docs[7][1]), (51, None), (52, ""), (53, "zzz-unknown"), (None, "The the THE"), (1, "w1 w2"), (1, "w1 w2"), (54, "w3 " * 40)]
    monkeypatch.setattr(lexical, "BUCKET", 16)
    assert search_rows(spark, docs, items) == brute_search(docs, items)


def test_search_in_blocks_and_empty_tables(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    docs = [(i, random_text(rng, words, 15)) for i in range(40)]
    items = [(k, random_text(rng, words, 4)) for k in range(9)]
    want = brute_search(docs, items)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 80)
    assert search_rows(spark, docs, items) == want
    assert search_rows(spark, [], items) == [] and search_rows(spark, docs, []) == []
    assert search_rows(spark, [(1, None), (2, "..")], items) == []


def test_search_skips_what_cannot_reach_the_top(monkeypatch):
    """The bounds leave few documents to score, and the result stays."""
    rng = random.Random(9)
    words = range(200)
    monkeypatch.setattr(lexical, "BUCKET", 64)
    weight = np.full(len(words), 5_000)
    rows = []
    for i in range(4_000):
        at = np.array(sorted(rng.sample(range(len(words)), 20)))
        value = np.array([rng.randint(1, 900_000) // (1 + i // 40) + 1 for _ in at])
        rows.append((i, float(np.sqrt((weight[at] * value.astype(float) ** 2).sum())), at.astype("<i4").tobytes(), value.astype("<i4").tobytes()))
    rows.sort(key=lambda r: -r[1])
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "norm", "terms", "impacts"])
    items = [lexical.Item(collections.Counter(rng.sample(range(len(words)), 6)), weight) for _ in range(5)]
    least = np.array([x[0] if len(x) == lexical.TOP else 1 for x in lexical.seeds(iter([batch]), items)])
    best, (stood, read, scored) = lexical.search(iter([batch]), items, least, weight.astype(float))
    assert scored < read < stood / 2 and scored < stood / 10
    for item, got in zip(items, best):
        factor = dict(item.all)
        want = sorted(((sum(factor.get(t, 0) * int(v) for t, v in zip(np.frombuffer(r[2], "<i4").tolist(), np.frombuffer(r[3], "<i4"))), r[0]) for r in rows),
                      key=lambda x: (-x[0], x[1]))[:10]
        assert got == [x for x in want if x[0] > 0]


# ---- 12: alignment --------------------------------------------------------

@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner()


def brute_groups(aligner, text):
    if not text:
        return None
    ids = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    parts = [[t[i] for i in x] for t, x in zip((aligner.bytes_a, aligner.bytes_b), ids)]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
    out, start = [], 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        out.append([[i for i, e in zip(x, own) if start < e <= end] for x, own in zip(ids, ends)])
        start = end
    return out


def brute_align(aligner, docs):
    groups = [brute_groups(aligner, t) for _, t in docs]
    links = [collections.Counter((a, b) for x, y in g or [] for a in x for b in y) for g in groups]
    count = collections.Counter(p for x in links for p in x)
    best = collections.Counter()
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for (i, _), g, x in zip(docs, groups, links):
        told = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or [])
        out.append((i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), sum(x.values()),
                    sum(n for p, n in x.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in x.items()),
                    hashlib.sha256(told.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("batch_bytes", [300, 1 << 20])
def test_alignment_equals_brute_force(spark, aligner, monkeypatch, batch_bytes):
    rng = random.Random(3)
    words = ["the", "Straße", "naïve", "token", "12.5", "e.g.", "don't", "漢字", "🦙", "{\r\n}", "x_y", "llama,", "…"]
    docs = [(i, random_text(rng, words, rng.randint(1, 30))) for i in range(60)]
    docs += [(100 + k, t) for k, t in enumerate(ODD)] + [(200, "literal ▁ sign"), (201, "▁"), (202, None), (None, "no id"), (3, docs[3][1])]
    docs += [(300 + k, "".join(rng.choices(SIGNS + "▁", k=40))) for k in range(80)]
    monkeypatch.setattr(alignment, "BATCH_BYTES", batch_bytes)
    got = alignment.align(spark.createDataFrame(docs, DOCS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == brute_align(aligner, docs)


def test_alignment_without_cuts_and_in_small_blocks(aligner, monkeypatch):
    rng = random.Random(8)
    texts = [t for t in ODD if t] + ["".join(rng.choices(SIGNS + "▁", k=50)) for _ in range(200)]


    def told(found):
        heads, pairs, text, at, links = found
        return heads, list(zip(text.tolist(), pairs[at].tolist(), links.tolist()))

    want = told(aligner(texts))
    other = alignment.Aligner()
    other.whole = True  # as for a vocabulary whose pieces span cuts
    assert told(other(texts)) == want
    monkeypatch.setattr(alignment, "BLOCK", 3)
    monkeypatch.setattr(alignment, "AT_ONCE", 7)
    monkeypatch.setattr(alignment, "TEXTS_AT_ONCE", 3)
    assert told(alignment.Aligner(memo=tokens.Memo(10))(texts)) == want


def test_characters_and_fallback_bytes_are_refined(aligner):
    ids_a, end_a, ids_b, end_b, good = aligner.spans([" 🦙x"])
    assert good.all() and end_a.tolist()[-1] == end_b.tolist()[-1] == 6
    assert end_b.tolist() == np.cumsum(aligner.len_b[ids_b]).tolist() and end_a.tolist() == np.cumsum(aligner.len_a[ids_a]).tolist()
    assert len(ids_b) > 4  # a blank, four bytes, a letter


def test_alignment_of_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], DOCS)).collect() == []


# ---- 13: packing ----------------------------------------------------------

def check_places(rows, full):
    """No overlap, no gap, no sequence over ``full``; the number of them."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= full
    return len(by)


def test_pack_pieces_and_places(spark, id_bytes):
    rng = random.Random(4)
    words = ["alpha", "beta,", "漢字", "gamma.", "\n", "🦙"]
    docs = [(i, random_text(rng, words, rng.choice([1, 3, 30, 300, 900]))) for i in range(150)]
    docs += [(900 + k, t) for k, t in enumerate(ODD)] + [(None, None), (None, None), (4, docs[4][1]), (5, "word " * 9_000)]
    full = 256
    got = best_fit.pack(spark.createDataFrame(docs, DOCS).repartition(3), full=full).collect()
    want = []
    for i, t in docs:
        ids = plain_ids(id_bytes.tokenizer, t or "") + [0]
        first = len(ids) % full or full
        cuts = [0, *range(first, len(ids) + 1, full)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    total = sum(r.length for r in got)
    assert check_places(got, full) <= math.ceil(total / full) + 2


def test_pack_one_length_and_empty(spark):
    assert best_fit.pack(spark.createDataFrame([], DOCS)).collect() == []
    got = best_fit.pack(spark.createDataFrame([(1, "same text")] * 500, DOCS).repartition(4), full=8).collect()
    assert len(got) == 500 and check_places(got, 8) == 500 // (8 // got[0].length)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_uses_every_piece_once_and_fits(lengths):
    hist = np.bincount(np.array(lengths, np.int64), minlength=41)[:41].astype(np.int64)
    made, used = best_fit.plan(hist), np.zeros(41, np.int64)
    for times, what in made:
        assert sum(n * k for n, k in what) <= 40
        for n, k in what:
            used[n] += times * k
    assert (used == hist).all()
    # first fit decreasing never needs more than 11/9 of the least, plus one
    assert sum(t for t, _ in made) <= 11 / 9 * max(1, math.ceil((hist * np.arange(41)).sum() / 40), int(hist[21:].sum())) + 4


def test_least_squares_reach_the_optimum():
    """Against plain projected gradient steps, run long, on a small case."""
    rng = np.random.default_rng(2)
    hist = np.concatenate([[0], rng.integers(0, 30, 24)]).astype(float)
    rows = best_fit.patterns(np.flatnonzero(hist), 24)
    assert (rows.sum(axis=1) == 24).all() and len({tuple(r) for r in rows.tolist()}) == len(rows)
    a = np.zeros((25, len(rows)))
    for k, r in enumerate(rows):
        for n in r[r > 0]:
            a[n, k] += 1
    w = np.arange(25.0)
    error = lambda x: (w * (hist - a @ x) ** 2).sum()
    x, step = np.zeros(len(rows)), 1 / np.linalg.norm((a.T * w) @ a, 2)
    for _ in range(20_000):
        x = np.maximum(0, x + step * (a.T @ (w * (hist - a @ x))))
    assert error(best_fit.fitted(rows, hist)) <= error(x) + 0.02 * error(np.zeros(len(rows)))


def test_all_patterns_are_enumerated():
    lengths = np.array([3, 4, 5, 6, 10])
    want = {tuple(sorted(p)) for n in (1, 2, 3) for p in itertools.combinations_with_replacement(lengths.tolist(), n) if sum(p) == 10}
    got = {tuple(int(n) for n in r if n) for r in best_fit.patterns(lengths, 10)}
    assert got == want == {(10,), (4, 6), (5, 5), (3, 3, 4)}
