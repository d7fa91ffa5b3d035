"""Published versions, upserts, linear sections, heading parts, phrase search,
candidate blocking, entity similarity and the streams, against plain Python."""

from __future__ import annotations

import itertools
import os
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.functions import fuzzy as Z
from kbspark.operators import graph as GR
from kbspark.operators import kb as K
from kbspark.operators import markdown as M
from kbspark.operators import pages as P
from kbspark.operators import retrieval as R
from kbspark.session import scratch_table_dir
from kbspark.sources import tables as S
from kbspark.streaming import streams as ST

DOCS = "doc_id long, text string, lang string, source string"


def folder(spark, name):
    return scratch_table_dir(spark, f"{name}-{os.getpid()}-{time.time_ns()}")


def kb_input(spark, rows):
    return P.kb_input_from_documents(spark.createDataFrame(rows, DOCS))


# ---- S6-S8 ------------------------------------------------------------------

def test_a_number_is_taken_once(spark):
    root = folder(spark, "catalog")
    ours, theirs = S.Catalog(spark, root), S.Catalog(spark.newSession(), root)
    ours.create("a")
    theirs.create("b")
    assert ours.publish("a", expect=0) == 1 and theirs.publish("b", expect=0) is None
    assert theirs.publish("b") == 2 and ours.live() == "b"
    held = ours.snapshot(1)
    assert held.version == "a" and [r.heading for r in held.table("headings").collect()] == ["ROOT"]
    assert not S.put_if_absent(spark, f"{root}/live/{1:012d}", "other") and ours.snapshot(1).version == "a"


DOC_ROWS = [
    (1, "Apache Storm counts words. The storm cluster restarts quickly.\n# Setup\nInstall the package first. Read the manual.", "en", "a"),
    (2, "Apache Storm counts words. The storm cluster restarts quickly.\n# Usage\nStart the server now.", "en", "a"),
    (3, "Apache Storm counts words. A new sentence about the cluster.\n# Setup\nInstall the package first. Then go on.", "en", "a"),
    (4, "Completely other words stand here. They fill a page.", "de", "b"), (5, None, "de", "b"), (6, "", "en", "a"),
]


def rows_of(snapshot):
    kb = K.stored(snapshot)
    path = {r.heading_id: tuple(r.path) for r in kb.headings.collect()}
    sentence = {r.sentence_id: (r.sentence, path[r.heading_id]) for r in kb.sentences.collect()}
    entity = {r.entity_id: r.entity for r in kb.entities.collect()}
    return (path, sentence, entity, sorted((sentence[r.sentence_id], entity[r.entity_id]) for r in kb.normalizations.collect()),
            sorted((r.frame, sentence[r.sentence_id]) for r in kb.frame_index.collect()),
            {path[r.heading_id]: (r.first_sentence_id, r.last_sentence_id) for r in kb.heading_info.collect()})


def test_upsert_keeps_ids_and_adds_what_is_new(spark):
    one, two = S.Catalog(spark, folder(spark, "kb")), S.Catalog(spark, folder(spark, "kb"))
    K.upsert(two, kb_input(spark, DOC_ROWS))
    whole = rows_of(two.snapshot())
    K.upsert(one, kb_input(spark, DOC_ROWS[:2]))
    before = rows_of(one.snapshot())
    K.upsert(one, kb_input(spark, DOC_ROWS[2:]))
    after = rows_of(one.snapshot())
    for old, new in zip(before[:3], after[:3]):
        assert all(new[i] == v for i, v in old.items()) and len(set(map(str, new.values()))) == len(new)
        assert sorted(new) == list(range(1, len(new) + 1))
    assert all(set(map(str, a.values())) == set(map(str, b.values())) for a, b in zip(after[:3], whole[:3]))
    assert after[3:5] == whole[3:5]
    for path, (first, last) in after[5].items():
        ids = [i for i, (_, p) in after[1].items() if p == path]
        assert (first, last) == (min(ids), max(ids))
    parents = {r.heading_id: r.parent_id for r in K.stored(one.snapshot()).headings.collect()}
    assert all(after[0][parents[i]] == p[:-1] for i, p in after[0].items() if i != 1)
    K.upsert(one, kb_input(spark, DOC_ROWS))
    again = rows_of(one.snapshot())
    assert again == after and one.number() == 3
    assert rows_of(one.snapshot(1)) == before


def test_upsert_after_a_faster_publisher(spark, monkeypatch):
    """The loser numbers its rows again behind the winner's."""
    cat = S.Catalog(spark, folder(spark, "race"))
    write, raced = S.Catalog.write, []

    def slow(self, version, tables):
        if not raced:
            raced.append(version)
            K.upsert(S.Catalog(spark, cat.root), kb_input(spark, DOC_ROWS[3:4]))
        write(self, version, tables)

    monkeypatch.setattr(S.Catalog, "write", slow)
    K.upsert(cat, kb_input(spark, DOC_ROWS[:1]))
    path, sentence, *_ = rows_of(cat.snapshot())
    assert cat.number() == 2 and sorted(sentence) == list(range(1, len(sentence) + 1)) and len(set(path.values())) == len(path)
    assert K.upsert(cat, kb_input(spark, DOC_ROWS), only_on=0).number == 2


def test_one_heading_is_read_by_its_id(spark):
    cat = S.Catalog(spark, folder(spark, "point"))
    live = K.upsert(cat, kb_input(spark, DOC_ROWS))
    plan = live.table("sentences").where("heading_id = 4")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(heading_id,4)" in plan


# ---- M3, K10 ----------------------------------------------------------------

def plain_sections(lines, page, product, truncate):
    levels, out, sec = [None] * 7, [], 0
    out.append((0, list(levels), []))
    for line in lines:
        n = len(line) - len(line.lstrip("#"))
        if n and line[n:n + 1] == " ":
            if n <= 7:
                levels[n - 1] = line[n + 1:].strip()
            if truncate:
                levels[n:] = [None] * (7 - min(n, 7))
            sec += 1
            out.append((sec, list(levels), []))
        else:
            out[-1][2].append(line)
    return [(s, [product, *page[:-1], *[x for k, x in enumerate([v[0] or page[-1], *v[1:]]) if x is not None]], t) for s, v, t in out if t]


@pytest.mark.parametrize("truncate", [False, True])
def test_sections_equal_a_plain_scan(spark, truncate):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        lines = ["#" * rng.randint(1, 9) + f" head {k}" if rng.random() < 0.5 else f"line {k}" for k in range(rng.randint(0, 25))]
        rows.append((str(i), i, "prod", ["crumb", "page"], lines))
    df = spark.createDataFrame(rows, "doc_id string, doc_order long, product string, heading array<string>, content array<string>")
    got = {i: [] for i, *_ in rows}
    for r in M.sections(df, truncate).orderBy("section_idx").collect():
        got[r.doc_id].append((r.section_idx, r.path, r.lines))
    for i, _, product, page, lines in rows:
        assert got[i] == plain_sections(lines, page, product, truncate)


def test_a_document_of_many_headings_takes_seconds(spark):
    lines = [f"# head {k // 10}" if k % 10 == 0 else f"line {k}" for k in range(100_000)]
    df = spark.createDataFrame([("1", 1, "p", ["page"], lines)], "doc_id string, doc_order long, product string, heading array<string>, content array<string>")
    start = time.time()
    assert M.sections(df).agg(F.count("*"), F.sum(F.size("lines"))).first()[:] == (10_000, 90_000)
    assert time.time() - start < 40


def test_heading_text_in_parts(spark):
    rows = [(i, f"word{i}__NN", 2 if i % 3 else 3) for i in range(1, 200)]
    sentences = spark.createDataFrame(rows, "sentence_id long, sentence string, heading_id long").repartition(4)
    headings = spark.createDataFrame([(2, "two"), (3, "three"), (4, "none")], "heading_id long, heading string")
    got = {}
    for r in K.heading_parts(sentences, headings, headings, size=10).orderBy("heading_id", "part").collect():
        got.setdefault(r.heading_id, []).append(r.content)
    for h in (2, 3):
        want = [f"word{i}." for i, _, x in rows if x == h]
        assert got[h] == [" ".join(want[k:k + 10]) for k in range(0, len(want), 10)]
    assert 4 not in got


# ---- D3 ---------------------------------------------------------------------

@pytest.mark.parametrize("at_once", [500_000, 7])
def test_forced_phrases_of_any_length(spark, at_once):
    rng = random.Random(6)
    words = ["a", "b", "c", "d."]
    sentences = [(i, " ".join(f"{rng.choice(words)}__NN" for _ in range(rng.randint(0, 12)))) for i in range(80)]
    phrases = sorted({" ".join(rng.choices("abcd", k=rng.randint(1, 6))) for _ in range(40)} | {"", "a  b"})
    got = GR.forced_entities(spark.createDataFrame(sentences, "sentence_id long, sentence string"),
                             spark.createDataFrame([(p,) for p in phrases] + [(None,)], "entity string"), at_once)
    want = set()
    for i, s in sentences:
        ws = [t.split("__")[0].strip(".") for t in s.split()]
        runs = {" ".join(ws[x:y]) for x in range(len(ws)) for y in range(x + 1, len(ws) + 1)}
        want |= {(i, p) for p in phrases if p in runs}
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows) == sorted(want)


# ---- Q2, Q3 -----------------------------------------------------------------

def weighted(source, target):
    row = [j * Z.INSERT_COST for j in range(len(target) + 1)]
    for ch in source:
        new = [row[0] + Z.DELETE_COST]
        for j, t in enumerate(target, 1):
            new.append(min(row[j] + Z.DELETE_COST, new[-1] + Z.INSERT_COST, row[j - 1] + (0 if ch == t else Z.SUBSTITUTE_COST)))
        row = new
    return row[-1]


def edited(rng, s):
    for _ in range(rng.randint(0, 4)):
        k = rng.randint(0, len(s))
        s = rng.choice([s[:k] + s[k + 1:], s[:k] + rng.choice("abcxyz ") + s[k:], s[:k] + rng.choice("abc") + s[k + 1:]])
    return s


@pytest.mark.parametrize("best", [None, 3])
def test_candidates_equal_all_pairs(spark, best):
    """Every pair within the bound is found by some key, at its distance."""
    rng = random.Random(17)
    entities = sorted({"".join(rng.choices("abcde fgh", k=rng.randint(1, 44))).strip() or "x" for _ in range(150)}
                      | {"".join(p) for n in (1, 2, 3) for p in itertools.product("abz", repeat=n)} | {"é" * 51, "ñandú", "straße"})
    grams = sorted({edited(rng, rng.choice(entities))[:50] for _ in range(250)} | {"a", "ab", "nandu", "q" * 60, ""})
    got = R.entity_candidates(spark.createDataFrame([(g,) for g in grams], "gram string"),
                              spark.createDataFrame(list(enumerate(entities)), "entity_id long, entity string"), best)
    want = set()
    for g in grams:
        if not 1 <= len(g) <= 50:
            continue
        found = [(len(e), weighted(e, g), e) for e in entities if len(g) <= len(e) <= 50
                 and (e.startswith(g) or e.endswith(g) or weighted(e, g) < 5)]
        want |= {(g, e, n, c) for n, c, e in (sorted(found)[:best] if best else found)}
    df = R.top_candidates(got) if best else got
    assert {(r.gram, r.entity, r.elen, r.dist) for r in df.collect()} == want


def test_shifts_cover_all_edits():
    """Each way to spend a cost below 5 leaves shifts that are looked up."""
    for d, t in enumerate(R.MAX_UNIT_EDITS):
        for ins, dele, sub in itertools.product(range(3), range(5), range(3)):
            if dele - ins == d and 2 * ins + dele + 2 * sub < 5:
                assert ins + dele + sub <= t and ins + dele + 2 * sub <= R.MAX_PARITIES[d]
                for order in set(itertools.permutations([1] * ins + [-1] * dele)):
                    sums = [0, *itertools.accumulate(order)]
                    for i in range(len(sums)):
                        assert sums[i] in R.single_shifts(d)
                        assert all((sums[i], sums[j]) in R.pair_shifts(d) for j in range(i, len(sums)))


# ---- Q10a -------------------------------------------------------------------

def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        new = [0]
        for j, t in enumerate(b, 1):
            new.append(row[j - 1] + 1 if ch == t else max(row[j], new[-1]))
        row = new
    return row[-1]


def set_ratio(a, b):
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0
    i = " ".join(sorted(ta & tb))
    c1, c2 = (f"{i} {' '.join(sorted(t - (ta & tb)))}".strip() for t in (ta, tb))
    one = lambda x, y: round(100 * 2 * lcs(x, y) / (len(x) + len(y))) if x and y else 0
    return max(one(i, c1), one(i, c2), one(c1, c2))


def test_similar_entities_equal_all_pairs(spark):
    rng = random.Random(23)
    words = ["server", "servers", "sever", "api", "apis", "manager", "manger", "key", "x", "deployment", "deploy"]
    left = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)} | {"", "--"})
    right = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)} | {"serverx managers"})
    pairs = list(itertools.product(left, right))
    got = R.similar_entities(spark.createDataFrame(pairs, "h_entity string, q_entity string"))
    clean = lambda s: s.replace("-", " ")
    want = {(a, b, r) for a, b in pairs if (r := set_ratio(clean(a), clean(b))) >= R.FUZZ_ACCEPT}
    assert {(r.h_entity, r.q_entity, r.r) for r in got.collect()} == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=2, max_size=8), st.integers(0, 7), st.integers(0, 7)), min_size=1, max_size=30))
def test_one_moved(spark, cases):
    pairs = []
    for s, i, j in cases:
        t = s[:i % len(s)] + s[i % len(s) + 1:]
        t = t[:j % (len(t) + 1)] + "c" + t[j % (len(t) + 1):]
        pairs += [(s, t), (s, "".join(reversed(s)))]
    pairs = [(a, b) for a, b in pairs if a != b]
    if pairs:
        df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", R.one_moved(F.col("a"), F.col("b")).alias("m"))
        for r in df.collect():
            assert r.m == (lcs(r.a, r.b) >= len(r.a) - 1), r


# ---- ST1, ST3 ---------------------------------------------------------------

def test_page_stream_goes_on_after_a_restart_and_forgets(spark):
    src, base = folder(spark, "pages"), folder(spark, "sink")
    schema = "page_id long, url string, html string, ts timestamp"

    def add(rows):
        df = spark.createDataFrame(rows, "page_id long, url string, ts string").select(
            "page_id", "url", F.lit("").alias("html"), F.to_timestamp("ts").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(src)

    def run():
        pages = spark.readStream.schema(schema).parquet(src).withColumn("canonical_id", F.substring_index("url", "?", 1))
        out = ST.run_to_table(spark, ST.first_seen(pages, "ts", "1 hour"), "t", base=base)
        return sorted(r.page_id for r in out.collect())

    add([(1, "u?x", "2024-01-01 00:00:00"), (2, "u?y", "2024-01-01 00:10:00"), (3, "v", "2024-01-01 00:20:00")])
    assert run() in ([1, 3], [2, 3])
    first = run()
    add([(4, "u", "2024-01-01 00:30:00"), (5, "w", "2024-01-01 09:00:00")])
    assert run() == first + [5]
    add([(6, "z", "2024-01-01 01:00:00"), (7, "v", "2024-01-01 12:00:00")])  # 6 is later than the watermark allows
    assert run() == first + [5, 7]


def test_question_stream_reads_what_is_published_meanwhile(spark):
    sf, base = folder(spark, "sf"), folder(spark, "answers")
    cat = S.Catalog(spark, folder(spark, "kb"))
    K.upsert(cat, kb_input(spark, DOC_ROWS[3:4]))
    turn = "conv_id long, turn long, role string, text string"
    ask = lambda n: spark.createDataFrame([(n, 1, "user", "Where is Apache Storm?")], turn).coalesce(1).write.mode("append").parquet(f"{sf}/conversations.parquet")
    ask(1)
    got = {r.q_id: r.heading for r in run_answers(spark, sf, cat, base)}
    assert got == {"1-1": None}
    K.upsert(cat, kb_input(spark, DOC_ROWS[:3]))
    ask(2)
    got = [(r.q_id, r.heading is not None) for r in run_answers(spark, sf, cat, base)]
    assert ("1-1", False) in got and ("2-1", True) in got and ("1-1", True) not in got


def run_answers(spark, sf, cat, base):
    return ST.answer_question_stream(spark, sf, cat, base).collect()


# ---- a user's words ---------------------------------------------------------

def test_words_of_a_user_reach_build_and_questions(spark):
    words = K.Words(spark.createDataFrame([("zorp", "JJ"), ("Flies", "VBZ"), ("flies", "XX")], "form string, tag string"),
                    spark.createDataFrame([("geese", "n", "goose"), ("geese", "n", "goosey"), ("geese", "v", "no"), ("flies", "v", "fly")], "form string, pos string, lemma string"),
                    spark.createDataFrame([("fly.v", "Motion")], "unit string, frame string"))
    rows = [(1, "Zorp geese. The goat flies away.", "en", "a")]
    kb = K.kb_rows(kb_input(spark, rows), words=words)
    assert {"zorp goose"} <= {r.entity for r in kb.entities.collect()}
    told = {r.sentence_id: r.sentence for r in kb.sentences.collect()}
    assert told[1].startswith("Zorp__JJ geese.__") and "flies__VBZ" in told[2]  # the smallest tag of a form listed twice
    assert ("Motion", 2) in {(r.frame, r.sentence_id) for r in kb.frame_index.collect()}
    asked = R.analyse_questions(spark.createDataFrame([("q", "Zorp geese. Who flies"), ("n", None)], "q_id string, question string"), words=words)
    got = {r.sent_idx: r for r in asked.collect()}
    assert "zorp goose" in got[0].q_entities and "Motion" in got[1].q_frames
    assert K.build_kb(kb_input(spark, rows), words=K.Words()).entities.count() == K.build_kb(kb_input(spark, rows)).entities.count()
