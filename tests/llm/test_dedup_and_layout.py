"""Mixing, SimHash, sharding, packing and exact dedup against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kbspark.llm import common as C
from kbspark.llm import exact_dedup, mixing, packing, sharding, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None) for i, t, s in rows], SCHEMA)


def words_of(text):
    return (text or "").encode().lower().split()


ODD = [(1, None, "a"), (2, "", "b"), (3, "  \n\t ", None), (4, "one", "a"), (4, "one", "a"), (None, "no id here", "b"),
       (None, "no id here", "b"), (7, "Ünïcode ﬀ 漢字 😀 words", "c"), (8, "x " * 30_000, "a"), (9, "y" * 100_000, "b")]


# ---- mixing ---------------------------------------------------------------

def water_fill(sizes: dict, weights=(5, 2, 1), cap=3.0):
    """Targets by repeated resharing, one source after another."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = {s: cap * sizes[s] for s in open_ if share[s] >= cap * sizes[s]}
        if not over:
            return {**share, **capped}
        capped.update(over)


def test_mix_targets_and_draws(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join("w" * 3 for _ in range(rnd.randrange(1, 60))), f"s{min(i % 7, 4)}" if i % 11 else None) for i in range(6_000)]
    rows += [(10_000 + i, "tiny", "aa") for i in range(3)]
    got = mixing.mix(documents(spark, rows)).collect()
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = water_fill(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.size == len(dict((i, t) for i, t, _ in rows[r.doc_id:r.doc_id + 1] or rows[-3:]).popitem()[1].split())
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert math.floor(r.rate) <= r.copies <= math.ceil(r.rate) and r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s, n in sizes.items():
        assert taken[s] == pytest.approx(want[s], rel=0.12)
    again = mixing.mix(documents(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_emits_copies_and_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("size", F.lit("mine")).withColumn("copies", F.lit(1.5))
    mixed = mixing.mix(documents(spark, ODD)).collect()
    assert len(mixed) == len(ODD)
    want = collections.Counter()
    for r in mixed:
        want[r.doc_id] += r.copies
    out = mixing.emit(docs)
    assert out.columns == docs.columns
    assert collections.Counter(r.doc_id for r in out.collect()) == +want
    assert mixing.emit(documents(spark, ODD).limit(0)).count() == 0


# ---- SimHash --------------------------------------------------------------

def plain_fingerprint(text):
    w = words_of(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, distance):
    """Smallest reachable position for each position, by trying all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(values)), 2):
        if (values[i] ^ values[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one TWO", "a b c", "a a a a a a", "Ä ö x y\x0bz", "the cat sat " * 50])
def test_fingerprint_follows_its_definition(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def near_copies(rnd, n):
    rows = []
    base = [f"w{rnd.randrange(400)}" for _ in range(120)]
    for i in range(n):
        w = base.copy()
        if rnd.random() < 0.3:
            w = [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(0, 90))]
        elif rnd.random() < 0.8:
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(50)}"
        rows.append((i * 3 % n, " ".join(w), "s"))
    return rows


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("big", [64, 2])
def test_simhash_components_match_all_pairs(spark, big):
    rows = near_copies(random.Random(3), 350)
    got = simhash.cluster(documents(spark, rows), big=big).collect()
    by_id = sorted(rows)
    want = plain_components([plain_fingerprint(t) for _, t, _ in by_id], 2)
    assert [(r.doc_id, r.component_id) for r in sorted(got, key=lambda r: r.doc_id)] == [(by_id[i][0], by_id[w][0]) for i, w in enumerate(want)]
    assert sum(r.kept for r in got) == len(set(want))


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_are_complete_for_planted_fingerprints(spark, distance):
    rnd = random.Random(distance)
    values = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        values.add(x)
        for _ in range(rnd.randrange(6)):
            y = x
            for b in rnd.sample(range(64), rnd.randrange(1, distance + 2)):
                y ^= 1 << b
            values.add(y)
    values = sorted(values, key=signed)
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    plan = simhash.make_plan(fps, len(values), distance)
    want = plain_components(values, distance)
    for big in (64, 0):  # 0: everything goes through hubs
        comp = {r.a: r.root for r in simhash.components(simhash.links(fps, plan, big)).collect()}
        assert [comp.get(signed(v), signed(v)) for v in values] == [signed(values[w]) for w in want]


@pytest.mark.parametrize("m", simhash.PARTITION_COUNTS)
def test_allocations_keep_the_pigeonhole_sum(m):
    rng = np.random.default_rng(0)
    hist = rng.integers(0, 50, (8, 256))
    plan = simhash.Plan([list(range(k, k + 8)) for k in range(0, 64, 8)], hist, 1_000, 2)
    chosen, cost = plan.allocation(rng.integers(0, 256, (200, 8)).astype(np.uint8), simhash.partitions(m))
    assert (chosen.sum(1) == 2 - m + 1).all() and (chosen >= -1).all() and np.isfinite(cost).all()


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1_000, 900)], "a long, b long")
    got = {r.a: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1_000: 900}


def test_simhash_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("fp", F.lit("mine")).withColumn("kept", F.lit(False))
    got = simhash.cluster(docs).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[1].fp == by[2].fp == by[3].fp == 0 and by[3].component_id == 1
    out = simhash.keep(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, i) for i in (1, 4, 7, 8, 9)] + [(True, 0)]
    assert simhash.cluster(docs.limit(0)).count() == 0


# ---- sharding -------------------------------------------------------------

def test_shards_are_whole_balanced_and_gapless(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.op3_shard(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    loads, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r.slot)
    assert set(loads) == set(range(24))
    assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in got)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_map_versions_grow_only_into_the_new_shard(spark):
    docs = documents(spark, [(i, "t" * (i % 50), "s") for i in range(5_000)])
    recs = sharding.records(docs, slots=512)
    root = sharding.new_root(spark)
    sharding.store(sharding.slot_map(spark, recs, 512, 8), root, 1)
    sharding.store(sharding.grow(sharding.load(spark, root, 1), 8), root, 2)
    old, new = ({r.vslot: r for r in sharding.load(spark, root, v).collect()} for v in (1, 2))
    assert len(old) == len(new) == 512
    assert all(new[k]["shard"] in (r["shard"], 8) for k, r in old.items())
    loads = collections.Counter()
    for r in new.values():
        loads[r["shard"]] += r["bytes"]
    assert len(loads) == 9 and max(loads.values()) < 1.15 * min(loads.values())


def test_sharding_odd_rows(spark):
    recs = sharding.records(documents(spark, ODD).withColumn("shard", F.lit(1)), slots=64)
    out = sharding.assign(recs, sharding.slot_map(spark, recs, 64, 4)).collect()
    assert len(out) == len(ODD)
    empty = sharding.records(documents(spark, ODD).limit(0), slots=64)
    m = sharding.slot_map(spark, empty, 64, 4)
    assert m.count() == 64 and sharding.assign(empty, m).count() == 0


# ---- packing --------------------------------------------------------------

def test_boundaries_are_optimal():
    rnd = random.Random(5)
    for _ in range(30):
        top = np.array(sorted(rnd.sample(range(200), rnd.randrange(1, 9))))
        n = np.array([rnd.randrange(1, 30) for _ in top])
        k = rnd.randrange(1, 5)

        def cost(ends):
            return sum(c * min(e for e in ends if e >= t) for t, c in zip(top, n))

        best = min(cost([*c, top[-1]]) for j in range(k) for c in itertools.combinations(top[:-1], j))
        got = packing.boundaries(top, n, k)
        assert len(got) <= k and got == sorted(got) and cost(got) == best


def check_packing(rows, budget):
    batches = collections.defaultdict(list)
    for r in rows:
        assert r.length <= r.bucket_length
        batches[r.bucket, r.batch].append(r)
    lengths = sorted({(r.bucket, r.bucket_length) for r in rows})
    assert [b for b, _ in lengths] == sorted({b for b, _ in lengths}) and lengths == sorted(lengths, key=lambda x: x[1])
    full = collections.Counter()
    for (bucket, _), own in batches.items():
        room = max(1, budget // max(1, own[0].bucket_length))
        assert sorted(r.batch_row for r in own) == list(range(len(own))) and len(own) <= room
        full[bucket] += len(own) < room
    assert all(n <= 1 for n in full.values())  # one batch of a bucket may be short
    for bucket in {b for b, _ in batches}:
        own = sorted(k for b, k in batches if b == bucket)
        assert own == list(range(len(own)))


def test_pack_documents(spark, sf_dir):
    rows = packing.op5_pack(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert {r.doc_id: r.length for r in rows} == {r.doc_id: len(words_of(r.text)) for r in docs}
    check_packing(rows, packing.TOKEN_BUDGET)


def test_pack_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("bucket", F.lit("mine")).withColumn("tag", F.lit("kept"))
    out = packing.pack_documents(docs, buckets=3, budget=100)
    rows = out.collect()
    assert len(rows) == len(ODD) and out.columns.count("bucket") == 1 and {r.tag for r in rows} == {"kept"}
    check_packing(rows, 100)
    assert packing.pack_documents(docs.limit(0)).count() == 0


# ---- exact dedup ----------------------------------------------------------

def plain_groups(rows):
    by = collections.defaultdict(list)
    for i, t, _ in rows:
        by[t or ""].append(i)
    return by


@pytest.mark.parametrize("id_bytes", [16, 1])  # with 1 nearly all identifiers are ambiguous
def test_exact_groups(spark, id_bytes):
    rnd = random.Random(7)
    passages = ["".join(rnd.choice("abcdefgh \n") for _ in range(rnd.randrange(1, 9_000))) for _ in range(12)]
    rows = [(i, "".join(rnd.choices(passages, k=rnd.randrange(0, 4))), "s") for i in range(300)] + [(900, None, "s"), (901, "z", "s")]
    got = exact_dedup.decide(exact_dedup.verified_recipes(documents(spark, rows), id_bytes)).collect()
    by, texts = plain_groups(rows), {i: t or "" for i, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        own = by[texts[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_chunks_of_one_identifier_in_one_task_are_compared(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunks_of", lambda text: ((b"0" * 16, text[k:k + 4]) for k in range(0, len(text), 4)))
    docs = spark.createDataFrame([(1, "aaaabbbb"), (2, "aaaacccc"), (3, "aaaa")], "doc_id long, text string").coalesce(1)
    assert sorted(bytes(r.chunk) for r in exact_dedup.chunks(docs).collect()) == [b"aaaa", b"bbbb", b"cccc"]
    assert [bytes(r.chunk_id) for r in exact_dedup.clashes(docs).collect()] == [b"0" * 16]


def test_cuts_follow_content():
    rnd = random.Random(9)
    body = bytes(rnd.randrange(32, 127) for _ in range(60_000))
    ends = exact_dedup.cuts(body)
    assert ends[-1] == len(body) and ends == sorted(set(ends))
    sizes = np.diff([0, *ends])
    assert sizes.max() <= exact_dedup.MAX_CHUNK and (sizes[:-1] > 0).all()
    chunks = {c for _, c in exact_dedup.chunks_of(body)}
    moved = [c for _, c in exact_dedup.chunks_of(b"prefix" + body)]
    assert sum(c in chunks for c in moved) >= len(moved) - 3
    assert exact_dedup.cuts(b"") == [] and exact_dedup.cuts(b"x") == [1]


def test_exact_odd_rows(spark):
    docs = documents(spark, ODD).withColumn("kept", F.lit("mine")).withColumn("recipe", F.lit(3))
    got = exact_dedup.decide(exact_dedup.verified_recipes(docs)).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == len(plain_groups(ODD))
    out = exact_dedup.keep(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["2", "3", "4", "None", "7", "8", "9"])
    assert exact_dedup.keep(docs.limit(0)).count() == 0


def test_hot_key_join_keeps_every_row(spark):
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 4_000).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.struct((F.col("k") * 2).alias("x")))
    out = C.join_hot(left, right, "k", "v", "n", 20_000, F.col("id"))
    assert out.count() == 20_000 and out.where("v.x <> k * 2 OR v IS NULL").count() == 0
    salted = C.join_lookup(left, right, "k", 10**9, F.col("id"))
    assert salted.count() == 20_000
