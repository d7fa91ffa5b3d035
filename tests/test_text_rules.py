"""Hand-computed values for the text, page and markdown rules (C, M, T)."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import one
from kbspark.functions import text as T
from kbspark.operators import html_markdown as H


def test_c1_canonical_url(spark):
    assert one(spark, T.canonical_url(F.col("u")), u="http://h/p?x=1#t") == "http://h/p"
    assert one(spark, T.canonical_url(F.col("u")), u="http://h/p#t") == "http://h/p#t"


def test_c8_sanitize(spark):
    assert one(spark, T.sanitize(F.col("s")), s="  a , b ( c )  .  ") == "a, b (c)."
    assert one(spark, T.sanitize(F.col("s")), s="x   y") == "x y"


def test_c9_clean_lines_drop_empty(spark):
    assert one(spark, T.clean_lines(F.col("s")), s="a \n\n  \nb  c") == ["a", "b c"]


def test_c7_ascii_fold():
    assert H.ascii_fold("café naïve") == "cafe naive"


def test_m1_heading_anywhere_in_line(spark):
    # "C# is" is a level-1 heading with text "is"
    assert one(spark, T.heading_level(F.col("s")), s="C# is") == 1
    assert one(spark, T.heading_text(F.col("s")), s="C# is") == "is"
    assert one(spark, T.heading_level(F.col("s")), s="### Three") == 3
    assert one(spark, T.heading_level(F.col("s")), s="plain line") == 0


def test_t1_sentence_split(spark):
    got = one(spark, T.sentences(F.col("s")), s="First one here. Second one: Third! ok")
    assert got[0] == "First one here."
    assert all(len(x) >= 4 for x in got)


def test_t3_tokens_ascii_glued_punctuation(spark):
    assert one(spark, T.tokens(F.col("s")), s="  Héllo, world.  ") == ["Hllo,", "world."]


def test_t5_t6_encode_decode_roundtrip(spark):
    toks = F.array(F.struct(F.lit("a__b").alias("token"), F.lit("NN").alias("pos")),
                   F.struct(F.lit("x").alias("token"), F.lit("VB").alias("pos")))
    enc = one(spark, T.encode_tagged(toks))
    assert enc == "a__b__NN x__VB"
    dec = one(spark, T.decode_tagged(F.lit(enc)))
    assert [(d["token"], d["pos"]) for d in dec] == [("a__b", "NN"), ("x", "VB")]


def test_t7_wordnet_class(spark):
    got = [one(spark, T.wordnet_class(F.lit(t))) for t in ["JJ", "VBN", "NNS", "RB", "DT"]]
    assert got == ["a", "v", "n", "r", ""]


def test_t8_dead_plural_rule(spark):
    # the final-s rule fires first, so the 'ies' rule never does
    assert one(spark, T.normalize_phrase(F.col("s"), lemmatize=False), s="policies") == "policie"


def test_t10_ngrams(spark):
    got = one(spark, T.ngrams_with_size(F.col("s")), s="address endpoint url")
    assert [g["gram"] for g in got] == ["address endpoint", "endpoint url", "address", "endpoint", "url"]
    assert one(spark, T.ngrams_with_size(F.col("s")), s="single") == []


def test_t11_rebuild_brackets_and_period(spark):
    toks = F.array(*[F.struct(F.lit(w).alias("token"), F.lit("X").alias("pos"))
                     for w in ["call", "-LRB-", "x", "-RRB-", "now"]])
    assert one(spark, T.rebuild_sentence(toks)) == "call (x) now."


def test_t13_important_tokens_case_sensitive(spark):
    # stop words are lower-case only, so "The" stays
    assert one(spark, T.important_tokens(F.col("s")), s="The cat and the cat") == "The cat"


def test_t16_question_trim(spark):
    assert one(spark, T.question_trim(F.col("s")), s="?.how do I deploy?,:\n") == "how do I deploy"


def test_t17_alnum_length(spark):
    assert one(spark, T.alnum_length(F.col("s")), s="a-b c_1!") == 4


def test_c12_product_key(spark):
    assert one(spark, T.product_key(F.col("u")), u="https://d/display/AM/Page") == "AM"
    assert one(spark, T.product_key(F.col("u")), u="https://d/other") is None


def _toks(pairs):
    return F.array(*[F.struct(F.lit(t).alias("token"), F.lit(p).alias("pos")) for t, p in pairs])


def test_t12_sentence_template(spark):
    from kbspark.functions import tagging as G
    cases = [
        ([("The", "DT"), ("API", "NNP"), ("gateway", "NN"), ("routes", "VBZ"), ("requests", "NNS")],
         "The ENTITY routes ENTITY."),
        # bracket tags removed, then neighbouring placeholders merged
        ([("Use", "VB"), ("the", "DT"), ("API", "NN"), ("-LRB-", "-LRB-"), ("REST", "NN"), ("-RRB-", "-RRB-")],
         "Use the ENTITY."),
        ([("Fast", "JJ"), ("and", "CC"), ("secure", "JJ"), ("tokens", "NNS"), ("expire", "VBP"), ("!", ".")],
         "ENTITY expire !"),
    ]
    for pairs, want in cases:
        assert one(spark, G.sentence_template(_toks(pairs))) == want


def test_lines_and_sentences_are_trimmed_as_by_the_pattern(spark):
    """Forms that test for a sign first, or trim without a pattern, against the plain patterns."""
    made = [a + b + c for a in ("", " ", "\t\x0b ", "\u0085", "\u00a0 ") for b in ("", "<a>", "x  y", "a. B\u2028 c", "[l](http://x) **b** + `<c`>", "*a* é  \u0085 d! E", "# h \x1c")
            for c in ("", " ", "\r\x0c", " \u2029", "\n\u0085")]
    df = spark.createDataFrame([(x,) for x in made], "s string")
    s = F.col("s")
    found = F.transform(F.regexp_extract_all(s, F.lit(T.SENTENCE_PATTERN), 0), T.py_strip)
    marked = F.regexp_replace(F.regexp_replace(s, T.MD_LINK_PATTERN, "$1"), T.MD_MARK_PATTERN, " ")
    lines = F.filter(F.transform(T.split_lines(s), T.sanitize), lambda x: x != "")
    ascii_only = T.py_strip(F.regexp_replace(s, r"[^\x00-\x7F]", ""))
    for r in df.select("s", T.sentences(s).alias("a"), F.filter(found, lambda x: F.length(x) >= T.MIN_SENT_LENGTH).alias("a2"),
                       T.strip_markdown(s).alias("b"), T.py_strip(F.regexp_replace(marked, r"\s{2,}", " ")).alias("b2"),
                       T.clean_lines(s).alias("c"), lines.alias("c2"), T.token_text(s).alias("d"), F.regexp_replace(ascii_only, r"\s+", " ").alias("d2")).collect():
        assert (r.a, r.b, r.c, r.d) == (r.a2, r.b2, r.c2, r.d2), r.s
