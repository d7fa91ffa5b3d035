"""Frames by tables over the distinct tagged tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from kbspark.functions import frames as FR
from kbspark.functions import words as W


def test_frames_of_tagged_sentences_go_over_distinct_tokens(spark):
    """all tokens of all sentences were decoded, three times over."""
    sents = [(1, "Open__VB the__DT files__NNS"), (2, "open__VB files__NNS upon__IN it__PRP"), (3, ""), (4, None), (5, "a__b__NN odd File__NN Files__NNS x"),
             (6, "Open__VB Open__VB the__DT")]
    df = spark.createDataFrame(sents, "row_id long, sentence string")
    units = spark.createDataFrame([("open.v", "Opening"), ("open up.v", "Change"), ("file.n", "Text"), ("odd", "None"), ("file.n", "Storing")], "unit string, frame string")
    lemmas = spark.createDataFrame([("files", "n", "file")], "form string, pos string, lemma string")
    for lem in (lemmas, None):
        want = FR.frames_with_tables(df.select("row_id", W.decoded("sentence").alias("toks")), "toks", units, lem)
        got = FR.tagged_frames_with_tables(df, "sentence", units, lem)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count()
    seen = []

    def keep(x, name):
        seen.append((name, x.count()))
        return x.checkpoint()

    FR.tagged_frames_with_tables(df.crossJoin(spark.range(50)).select((F.col("row_id") * 50 + F.col("id")).alias("row_id"), "sentence"),
                                 "sentence", units, lemmas, keep)
    assert max(n for _, n in seen) <= 20  # as few as there are distinct tokens
