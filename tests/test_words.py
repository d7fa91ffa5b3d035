"""Token-level forms of the tagger and of entities against the Column rules,
and what the question queries make."""

from __future__ import annotations

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from kbspark.functions import frames as FR  # noqa: E402
from kbspark.functions import tagging as G  # noqa: E402
from kbspark.functions import text as T  # noqa: E402
from kbspark.functions import words as W  # noqa: E402
from kbspark.functions.analysis import analysed_texts  # noqa: E402
from kbspark.operators import retrieval as R  # noqa: E402

PARTS = ("-LRB- -RRB- the Tables classes is running etc. i.e. e.g. http://a.b <b {x a:12 Es Flies us stories big bigger quickly "
         "and 3.5 12ab __ a__b a_ ... , ; X Aies AES of. (this) very best y.z C++ -- a|b don't 0x x0 000 10 etc \x1c \x0b é").split(" ")


def rows(n: int) -> list[tuple]:
    r = random.Random(5)
    made = [" ".join(r.choice([*PARTS, "x" * 26]) for _ in range(r.randint(0, 14))) for _ in range(n)]
    made += ["".join(r.choice("aeiosngtd AES  .,:;!?()<>/_#12 39\t") for _ in range(r.randint(0, 50))) for _ in range(n)]
    return [*enumerate(made), (2 * n, None), (2 * n + 1, "")]


def test_token_rules_are_the_column_rules(spark):
    df = spark.createDataFrame(rows(600), "i long, s string")
    toks = G.tag_sentence(F.col("s"))
    both = df.select("i", toks.alias("t"), T.encode_tagged(toks).alias("x"), G.sentence_entities(toks).alias("e"),
                     W.tag_sentences("s").alias("t2"), W.tagged_texts("s").alias("x2"), W.tagged_entities(W.tagged_texts("s")).alias("e2"),
                     T.decode_tagged(T.encode_tagged(toks)).alias("d"), W.decoded(W.tagged_texts("s")).alias("d2"))
    for r in both.collect():
        assert (r.t, r.x, r.e, r.d) == (r.t2, r.x2, r.e2, r.d2)


def test_rules_of_whole_sentences_are_the_column_rules(spark):
    """Entities, segments and templates straight from the sentence; a mark behind the last token is cut off early."""
    made = [x + mark for _, x in rows(250) if x for mark in ("", ".", ",", "!", "?", "..", " .")]
    made += [f"The {x}{mark}" for x in ("x" * 24, "x" * 25, "x" * 26, "a", "0", "10", "etc", "Aies", "ties", "AES", "E") for mark in ("", ".", ",", "!?", "?")]
    df = spark.createDataFrame([*enumerate(made), (-1, None), (-2, "")], "i long, s string")
    toks = G.tag_sentence(F.col("s"))
    both = df.select("s", G.sentence_entities(toks).alias("e"), G.np_vp_segments(toks).alias("g"), G.sentence_template(toks).alias("t"),
                     W.sentence_entities("s").alias("e2"), W.tagged_entities(W.tagged_texts("s")).alias("e3"),
                     W.sentence_segments("s").alias("g2"), W.sentence_templates("s").alias("t2"))
    for r in both.collect():
        assert (r.e, r.e, r.g, r.t) == (r.e2, r.e3, r.g2, r.t2), r.s


def test_frames_of_items_are_the_frames_of_sentences(spark):
    df = spark.createDataFrame([r for r in rows(300) if r[1] is not None], "row_id long, s string").withColumn("x", W.tagged_texts("s"))
    one = df.select("row_id", F.explode(FR.sentence_frames(T.decode_tagged(F.col("x")))).alias("frame")).collect()
    assert one and sorted(one) == sorted(FR.frames_by_item(df, "x").collect())


def test_analysis_needs_no_kb(spark):
    asked = spark.createDataFrame([("1", "Where is the big table kept?")], "q_id string, question string")
    made = []

    def kb():
        raise AssertionError("a KB was made")

    r = R.retrieve(asked, kb, keep=lambda make, name: (made.append(name), make())[1])
    assert r.analysed.select("q_entities").first()[0] and made == ["analysed"]
    assert r.lookups.count() > 0 and made == ["analysed", "lookups"]


def test_every_kept_table_goes_through_keep(spark):
    """So that a caller can have compressed files for all of them."""
    from kbspark.operators.kb import kb_rows
    kept = []
    docs = spark.createDataFrame([("1", 1, "p", ["h"], ["The big table is here.", "A note."])],
                                 "doc_id string, doc_order long, product string, heading array<string>, content array<string>")
    kb = kb_rows(docs, keep=lambda df, name: (kept.append(name), df.checkpoint(eager=True))[1])
    assert kb.sentences.count() == 2 and {"sections", "headings", "sentences", "item-frames"} <= set(kept) and "tagged" not in kept


def test_analysis_in_one_pass_is_tags_and_entities(spark):
    made = [*(x for _, x in rows(300) if x is not None), "é\u00e9", "The 3 x2 big-tables", "-LRB- a"]
    df = spark.createDataFrame([*enumerate(made)], "i long, s string")
    toks = G.tag_sentence(F.col("s"))
    one = df.select("i", "s", T.encode_tagged(toks).alias("x"), G.sentence_entities(toks).alias("e"), FR.sentence_frames(toks).alias("f"),
                    analysed_texts("s").alias("a")).checkpoint()
    for r in one.collect():
        assert (r.x, r.e) == (r.a.sentence, r.a.entities) and len(set(r.a["items"])) == len(r.a["items"]), r.s
    items = one.select(F.col("i").alias("row_id"), F.explode("a.items").alias("item"))
    assert sorted(FR.item_rows_frames(items).collect()) == sorted((r.i, f) for r in one.collect() for f in r.f)


def test_frames_of_a_token_by_function_are_the_column_rules(spark):
    words = [*PARTS, "was", "running", "Tables", "es", "aes", "goes", "in", "of", "A.b.", "a.b", "don't", "e-mail", "x", "12", "1a2b", "ies", "under", "Under.", "__", "a__b"]
    items = [f"{w}__{tag}" for w in words for tag in ("NN", "VBZ", "JJ", "RB", "IN", "SYM", "-LRB-", ".")] + ["bare", "a__", "__NN", ""]
    df = spark.createDataFrame([(x,) for x in items], "item string")
    for r in df.select("item", FR.sentence_frames(T.decode_tagged(F.col("item"))).alias("a"), FR.item_frames("item").alias("b")).collect():
        assert r.a == r.b, r.item


def test_tags_and_entities_are_made_once_in_a_build(spark):
    """One pass of Python over the sentences, for tags and entities; another one only over the distinct tokens, for frames."""
    from kbspark.operators.kb import kb_rows
    plans = {}
    docs = spark.createDataFrame([("1", 1, "p", ["h"], ["The big table is here.", "A note.", "A note."])],
                                 "doc_id string, doc_order long, product string, heading array<string>, content array<string>")

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df.checkpoint(eager=True)

    kb = kb_rows(docs, keep=keep)
    plans |= {name: df._jdf.queryExecution().optimizedPlan().toString() for name, df in kb.tables().items() if name != "sentences"}
    assert {name for name, plan in plans.items() if "ArrowEvalPython" in plan} == {"numbered-sentence_id", "item-frames"}
    assert sorted(r.sentence for r in kb.sentences.collect()) == ["A__DT note.__NN", "The__DT big__NN table__JJ is__VBZ here.__RB"]
    assert sorted(r.entity for r in kb.entities.collect()) == ["big", "note"]


def test_headings_are_joined_to_paths_alone(spark):
    """A heading's id reaches its lines without a join of their text, also in long sections and where a place comes twice."""
    from kbspark.operators import kb as K
    long = [f"Line {i} is here. It ends." for i in range(2 * K.CHUNK_LINES + 1)]
    secs = spark.createDataFrame(
        [("a", 1, 0, ["p"], long), ("a", 1, 0, ["q"], ["Other text is here."]), (None, None, 0, ["p"], ["No place is here.", None]),
         ("b", 2, 0, ["p", "x"], ["No heading is here."]), ("c", 3, 1, ["q"], ["Last one is here."])],
        "doc_id string, doc_order long, section_idx int, path array<string>, lines array<string>")
    headings = spark.createDataFrame([(["p"], 2), (["q"], 3)], "path array<string>, heading_id long")
    out = K.section_sentences(secs, headings)
    rows = sorted(out.collect())
    assert [(r.heading_id, r.text) for r in rows if r.heading_id == 2] == [(2, "No place is here.")] + [
        (2, x) for i in range(len(long)) for x in (f"Line {i} is here.", "It ends.")]
    assert [r.text for r in rows if r.heading_id == 3] == ["Other text is here.", "Last one is here."] and len(rows) == 2 * len(long) + 3
    plan = out._jdf.queryExecution().optimizedPlan()

    def joins(node):
        return ([node] if node.nodeName() == "Join" else []) + [j for i in range(node.children().size()) for j in joins(node.children().apply(i))]

    assert [{"line", "lines", "text"} & {j.output().apply(i).name() for i in range(j.output().size())} for j in joins(plan)] == [set()]


def test_keys_of_distinct_tokens_are_the_keys_of_sentences(spark):
    from kbspark.sources import tables as S
    df = spark.createDataFrame([r for r in rows(300) if r[1] is not None], "row_id long, s string").withColumn("x", W.tagged_texts("s"))
    items = FR.spread_items(df.select(F.explode(F.split("x", " ")).alias("item"))).select(F.col("item").alias("row_id"), T.decode_tagged(F.col("item")).alias("toks"))
    keys = [sorted(FR.word_keys(x, "toks", S.lemmas(spark))[1].distinct().collect()) for x in (df.select("row_id", T.decode_tagged(F.col("x")).alias("toks")), items)]
    assert keys[0] and keys[0] == keys[1]


def test_frame_memo_query_cuts_distinct_tokens(spark, sf_dir):
    from kbspark.plans import queries as Q
    plan = Q.f5_frame_memo(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Aggregate [item" in plan
