"""Rules with hand values or a plain-Python statement: page rendering, links,
segments of long sentences, progress, lexicon tables, published versions."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from kbspark.functions import frames as FR
from kbspark.functions import tagging as G
from kbspark.functions import text as T
from kbspark.operators import hierarchy as HI
from kbspark.operators import html_markdown as H
from kbspark.operators import pages as P
from kbspark.operators import retrieval as R
from kbspark.session import scratch_table_dir
from kbspark.sources import tables as S

TOKS = "array<struct<token:string,pos:string>>"


# ---- C3-C7 ----------------------------------------------------------------

def content(inner, **kw):
    return H.page_item(f"<title>t</title><div class='wiki-content'>{inner}</div>", **kw)["content"]


@pytest.mark.parametrize("inner, want", [
    ("<p>one</p><p>two", "one\ntwo\n"),
    ("<h2> Head</h2>x", " ## Head\nx"),
    ("a<strong> b </strong>c", "a **b** c"),
    ("<ul><li>x<li>y</ul>", "+ x\n+ y\n"),
    ("<a href='/p/q'>go</a> <a href='#x'>in</a> <a href=''>no</a> <a href='http://h/'> h</a>", "[go](http://s/p/q) in no  [h](http://h/)"),
    ("<pre>code</pre>k", "k"),
    ("<table><tr><th>h</th></tr><tr><td>v</td></tr></table>k", "k"),
    ("<table><tr><td>v<td>w</table>k", "v\nw\nk"),
    ("<table><tr><td class='highlight-grey  confluenceTd'>v</td></tr></table>k", "k"),
    ("<div class='x code panel y'>gone</div><p class='expand-container'>too</p>k", "k"),
    ("a<!-- note -->b<script>var s;</script>", "a note bvar s;"),
    ("café — naïve&amp;", "cafe  naive&"),
    ("<b>" * 2_000 + "deep", "deep"),
    ("<h>x</h><br>y", "x\ny"),
])
def test_page_rendering_rules(inner, want):
    assert content(inner, site="http://s") == want


def test_page_fields():
    page = ("<html><title>My <b>T</title><ol id=breadcrumbs><li class=first>Home</li><li id=ellipsis>..</li><li><a> A </a></li>"
            "<li>B</li></ol><h1 class='x with-breadcrumbs'> one <i>two</i></h1><h1>no</h1><div class='wiki-content'><p>c</p></div>"
            "<div class='wiki-content'>second</div>")
    item = H.page_item(page)
    assert item == {"title": "My ", "hierarchy": ["A", "B"], "heading": "one two", "content": "c\n"}
    assert H.page_item("<p>nothing") is None and H.page_item(None) is None


@pytest.mark.parametrize("href, want", [
    ("page2", "http://h/a/b/page2"), ("../x", "http://h/a/x"), ("../../../x", "http://h/x"), ("?p=2", "http://h/a/b/c?p=2"),
    ("#top", "http://h/a/b/c?q=1#top"), ("", "http://h/a/b/c?q=1"), ("/r", "http://h/r"), ("//o/r", "http://o/r"),
    ("https://z/", "https://z/"), ("mailto:a@b", None), ("./y?z=/../w", "http://h/a/b/y?z=/../w"), ("..", "http://h/a/"),
])
def test_links_resolve(spark, href, want):
    df = spark.createDataFrame([(href,)], "href string")
    assert df.select(P.resolved(F.col("href"), F.lit("http://h/a/b/c?q=1#f"))).first()[0] == want


def test_links_of_any_spelling(spark):
    html = "<A HREF=x1>1</A><a class='k' href = \"x2\">2</a><a data-href='no' href='x3'>3</a><abbr href='no'>"
    pages = spark.createDataFrame([(1, "http://h/d/", html)], "page_id long, url string, html string")
    assert sorted(r.link_id for r in P.out_links(pages).collect()) == ["http://h/d/x1", "http://h/d/x2", "http://h/d/x3"]


def test_title_and_h1_keep_nested_text(spark):
    html = "<TITLE> a &amp; b</TITLE><h1>x <b>y</b> z</h1><h1></h1><h1>w"
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert tuple(P.title_and_h1(pages).first())[1:] == ("a &amp; b", "x y z  w")


# ---- T1 on questions ------------------------------------------------------

def test_question_lines_are_kept(spark):
    q = spark.createDataFrame([(1, "first line without a mark\nsecond one. Third one\n\nlast")], "q_id long, question string")
    rows = R.analyse_questions(q).orderBy("sent_idx").collect()
    assert [r.text for r in rows] == ["first line without a mark", "second one.", "Third one", "last"]


# ---- E2, T12 --------------------------------------------------------------

TAGS = ["NN", "NNS", "FW", "JJ", "JJR", "RB", "VBN", "VBD", "CC", "CC", "DT", "CD", "IN"]


def plain_segments(tags):
    """The grammar by Python regexes with groups, over span letters."""
    one = "".join("N" if t.startswith("NN") or t == "FW" else {"JJ": "J", "JJR": "K", "RB": "R", "CC": "C", "DT": "D", "CD": "#"}.get(
        t, "V" if t.startswith("VB") else "x") for t in tags)
    one = re.sub("KV|RJ", "aa", one).replace("J", "a")
    one = re.sub("(?<=a)C(?=a)", "c", one)
    items, at = [], 0
    for m in re.finditer("(?:a[ac]*)?N+", one):
        items += [(i, 1, one[i].upper() if one[i] in "cCD#" else "o") for i in range(at, m.start())] + [(m.start(), len(m[0]), "E")]
        at = m.end()
    items += [(i, 1, one[i].upper() if one[i] in "cCD#" else "o") for i in range(at, len(one))]
    code, out, at = "".join(c for _, _, c in items), [], 0

    def add(label, part):
        if part:
            out.append((label, part[0][0] + 1, sum(n for _, n, _ in part)))

    for m in re.finditer("D?C?(?:C#)*E(?:C?E)*", code):
        add("VP", items[at:m.start()])
        add("NP", items[m.start():m.end()])
        at = m.end()
    add("VP", items[at:])
    return out


def test_segments_match_the_grammar(spark):
    rnd = random.Random(4)
    seqs = [[rnd.choice(TAGS) for _ in range(rnd.randrange(1, 14))] for _ in range(3_000)]
    df = spark.createDataFrame([(i, [(f"w{k}", t) for k, t in enumerate(s)]) for i, s in enumerate(seqs)], f"i long, toks {TOKS}")
    got = {r.i: [(g.label, g.start, g.len) for g in r.g] for r in df.select("i", G.np_vp_segments(F.col("toks")).alias("g")).collect()}
    assert all(got[i] == plain_segments(s) for i, s in enumerate(seqs))


@pytest.mark.parametrize("tags", [["JJ", "NN"], ["CC", "CD"], ["NN", "CC"], ["DT"]])
def test_long_sentences_do_not_exhaust_the_stack(spark, tags):
    toks = [(f"w{k}", tags[k % len(tags)]) for k in range(20_000)]
    df = spark.createDataFrame([(toks,)], f"toks {TOKS}")
    r = df.select(G.np_vp_segments(F.col("toks")).alias("g"), G.sentence_template(F.col("toks")).alias("t")).first()
    assert sum(g.len for g in r.g) == 20_000 and r.t


def test_template_merges_neighbours(spark):
    toks = [("The", "DT"), ("gateway", "NN"), ("and", "CC"), ("server", "NN"), ("send", "VBP"), ("big", "JJ"), ("files", "NNS")]
    df = spark.createDataFrame([(toks,)], f"toks {TOKS}")
    assert df.select(G.sentence_template(F.col("toks"))).first()[0] == "The ENTITY and ENTITY send ENTITY."


# ---- T4 with a table ------------------------------------------------------

def test_lexicon_table_of_any_size(spark):
    lexicon = spark.range(100_000).select(F.concat(F.lit("word"), F.col("id")).alias("form"), F.lit("VBX").alias("tag"))
    lexicon = lexicon.unionAll(spark.createDataFrame([("Run", "VB"), ("run", "ZZ"), ("-LRB-", "NN")], "form string, tag string"))
    df = spark.createDataFrame([(1, "word7 (run) unknowning -LRB- Word99999, 42"), (2, ""), (3, "run run")], "row_id long, s string")
    out = G.tag_with_table(df.withColumn("t", T.tokens(F.col("s"))), "t", lexicon)
    got = {r.row_id: [(x.token, x.pos) for x in r.toks] for r in out.collect()}
    assert got == {1: [("word7", "VBX"), ("(run)", "VB"), ("unknowning", "VBG"), ("-LRB-", "-LRB-"), ("Word99999,", "VBX"), ("42", "CD")],
                   2: [], 3: [("run", "VB"), ("run", "VB")]}


# ---- F3-F6 with tables ----------------------------------------------------

SENTENCES = [(1, [("Servers", "NNS"), ("ran", "VBD"), ("quickly", "RB")]), (2, [("the", "DT"), ("with", "IN"), ("Zzyx", "FW")]),
             (3, []), (4, [("ran", "VBD"), ("ran", "VBD"), ("server", "NN")])]
UNITS = [("server room.n", "Buildings"), ("run.v", "Moving"), ("run.v", "Operating"), ("nothing", "Ignored")]
USER_LEMMAS = [("ran", "v", "run"), ("servers", "n", "server")]


def frame_rows(spark, **memo):
    df = spark.createDataFrame(SENTENCES, f"row_id long, toks {TOKS}")
    units = spark.createDataFrame(UNITS, "unit string, frame string")
    lemmas = spark.createDataFrame(USER_LEMMAS, "form string, pos string, lemma string").unionAll(
        spark.range(100_000).selectExpr("concat('form', id)", "'n'", "'x'"))
    got = FR.frames_with_tables(df, "toks", units, lemmas, **memo)
    return sorted((r.row_id, r.frame) for r in got.collect()), FR.word_keys(df, "toks", lemmas)[1], units


def test_units_and_lemmas_as_tables(spark):
    got, keys, units = frame_rows(spark)
    assert [x for x in got if x[1] != "zzyx"] == [
        (1, "Buildings"), (1, "Moving"), (1, "Operating"), (4, "Buildings"), (4, "Moving"), (4, "Operating")]
    assert {r.key for r in keys.collect()} >= {"server__n", "run__v"}


def test_frame_memo_is_saved_and_looked_up_first(spark):
    path = scratch_table_dir(spark, f"frame_memo_{os.getpid()}")
    schema = S.KB_SCHEMAS["frame_cache"]
    assert S.read_or_empty(spark, path, schema).isEmpty()
    plain, keys, units = frame_rows(spark, memo=S.read_or_empty(spark, path, schema))
    assert plain == frame_rows(spark)[0]
    S.replace(FR.frame_memo(keys, units), path)
    memo = S.read_or_empty(spark, path, schema)
    by = {r.key: r.frames for r in memo.collect()}
    assert by["run__v"] == ["Moving", "Operating"] and [] in by.values() and len(by) == keys.select("key").distinct().count()
    # known keys keep what the memo says, whatever the units are now
    none = units.limit(0)
    assert FR.frame_memo(keys, none, memo).count() == len(by)
    assert {r.key: r.frames for r in FR.frame_memo(keys, none, memo).collect()} == by


# ---- K14, K8 --------------------------------------------------------------

def test_progress_without_exchange_reuse(spark):
    rows = [(i, "hot" if i % 4 else "cold", f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}") for i in range(3_000)]
    log = spark.createDataFrame(rows, "id long, job string, s string").select("id", "job", F.to_timestamp("s").alias("ts"))
    by = {}
    for i, job, s in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        by.setdefault(job, []).append(int(s[14:16]) * 60 + int(s[17:]))
    want = {}
    for job, ts in by.items():
        for n, t in enumerate(ts, 1):
            before = ts[n - 2] - ts[0] if n > 1 else 0
            now = t - ts[0]
            rate = None
            if now > 0 and (n == 1 or before > 0):
                rate = 0.05 * ((n - 1) / before if n > 1 else 0) + 0.95 * n / now
            want[job, n] = int((len(ts) - n) // rate) if rate else None
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.exchange.reuse")}
    try:
        spark.conf.set("spark.sql.exchange.reuse", "false")
        for parts in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = HI.progress(log, order_col="id").collect()
            assert len(got) == len(rows)
            assert {(r.job, r.n): r.eta for r in got} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# ---- S6-S8 ----------------------------------------------------------------

def test_publish_switches_all_tables_at_once(spark):
    cat = S.Catalog(spark, scratch_table_dir(spark, f"catalog_{os.getpid()}"))
    assert cat.live() is None and cat.live_table("entities").count() == 0
    cat.create("1")
    cat.publish("1")
    assert [r.heading for r in cat.live_table("headings").collect()] == ["ROOT"]
    cat.create("2")
    cat.write("2", {"entities": spark.createDataFrame([(7, "x")], "entity_id long, entity string")})
    assert cat.live() == "1" and cat.live_table("entities").count() == 0
    cat.publish("2")
    other = S.Catalog(spark.newSession(), cat.root)  # a session that knows only the folder
    assert other.live() == "2" and [tuple(r) for r in other.live_table("entities").collect()] == [(7, "x")]
    cat.drop("2")
    assert other.live_table("entities").count() == 0


def test_build_memo_follows_its_files(spark):
    from kbspark.plans import build as B
    root = scratch_table_dir(spark, f"memo_{os.getpid()}")
    keys = []
    for text in ("one", "one", "two"):
        S.replace(spark.createDataFrame([(1, text)], "doc_id long, text string"), f"{root}/documents.parquet")
        keys.append(B._key(spark, root, "kb", "documents"))
        assert B._key(spark, root, "kb", "documents") == keys[-1]
    assert len(set(keys)) == 3
