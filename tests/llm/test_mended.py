"""Faults that were found in earlier rounds stay mended."""

from __future__ import annotations

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.llm import html_text, langid, pii

# ---- op4: no run of letters is cut -----------------------------------------

PIECES = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "c", "abc", "cab"]


def test_long_runs_are_summed_over_all_segmentations():
    rng = np.random.default_rng(3)
    table = langid.log_table(rng.integers(1, 20, (len(PIECES), 3)).astype(float))
    lattice = langid.Lattice(PIECES)
    words = ["▁" + "".join(rng.choice(list("abcz"), n)) for n in (1, 23, 24, 25, 31, 32, 33, 48, 200, 200, 1_000)]
    got = lattice.likelihoods(words, table)
    for w, row in zip(words, got):
        want = lattice.forward(lattice.edges([w]), table)[0, -1]
        assert np.allclose(row, want, rtol=1e-9)


def test_runs_are_whole():
    assert langid.runs("x" * 500) == ["▁" + "x" * 500]
    assert langid.runs("12" + "漢" * 100 + "-b") == ["▁" + "漢" * 100, "▁b"]


# ---- op8: nothing of an article is lost -------------------------------------

P = "<p>" + "Some words of an article that go on for a while, and more of them. " * 3 + "</p>"
TEXT = re.sub("<.?p>", "", P).strip()


def test_quotes_delimit_values_alone():
    page = "<body><p>First part.</p><a href=/x title=it's>more</a><p>Second part, which is here.</p><p>I don't mind, and that is all.</p></body>"
    assert html_text.main_text(page) == "First part. more Second part, which is here. I don't mind, and that is all."
    assert html_text.main_text(f"<body><p title='a>b' class = \"c>d\">{TEXT}</p></body>") == TEXT


def test_all_articles_stay():
    page = f"<body><article><h1>One</h1>{P}</article><article><h1>Two</h1>{P}</article><div>Copyright someone</div></body>"
    assert html_text.main_text(page) == f"One {TEXT} Two {TEXT}"


def test_headline_and_lead_stand_beside_the_body():
    page = f"<body><div class=top><h1>Headline</h1><p>A lead.</p></div><div class=body>{P}{P}</div><div>Imprint</div></body>"
    assert html_text.main_text(page) == f"Headline A lead. {TEXT} {TEXT}"


def test_density_decides_without_the_tag(spark, sf_dir):
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect():
        plain = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", r.html)
        assert html_text.main_text(plain) == html_text.main_text(r.html)


@pytest.mark.parametrize("page", [
    "<option>x" * 100_000, "<b>" * 100_000 + "</i>x" * 100_000, "<b>" * 50_000 + "<table>x" * 50_000, "<a " * 100_000, '<a b="' * 100_000,
    "<div class=ad>" + "<b>" * 50_000 + "</i>" * 50_000, "<!--" * 100_000, "<p>x" * 100_000, "<ul><li>x" * 50_000, "<script>" * 100_000,
    '<a b="x>' * 100_000, "<div class=ad>x" * 20_000])
def test_parsing_is_linear(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 6


# ---- op10: the trees alone add spans ----------------------------------------

def test_overlaps_are_tested_in_order(monkeypatch):
    rng = random.Random(1)
    spans = [(3, a, a + rng.randint(1, 9)) for a in rng.sample(range(3_000), 1_500)]
    score = {s: rng.random() for s in spans}
    monkeypatch.setattr(pii, "proposals", lambda text, base: spans)
    monkeypatch.setattr(pii, "features", lambda text, s: s)
    got = pii.added("", [], score.__getitem__, [0.2] * 4)
    want = []
    for s in sorted(spans, key=lambda s: (-score[s], s[1], s[2])):
        if score[s] >= 0.2 and all(s[2] <= a or b <= s[1] for _, a, b in want):
            want.append(s)
    assert got == want


def test_generated_lines_hold_every_kind_and_wrong_ones():
    labels = {(int(x[0]), y) for k, line in enumerate(pii.generated()) for _, y, can, x in pii.labelled_spans(line, k / 2**40) if can}
    assert labels == {(k, y) for k in range(4) for y in (0, 1)}


def test_pii_learns_from_every_document(spark):
    """More documents than the former sample's 20,000: each one's candidates count."""
    n = 20_500
    text = F.concat(F.lit("order "), F.col("id"), F.lit(" host 10.0."), F.col("id") % 256, F.lit(".7 mail a.b@c"), F.col("id") % 7, F.lit(".org"))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = pii.labelled(docs).where("y = 1 and loose = 0").agg(F.sum("n")).first()[0]
    lines = sum(y == 1 and not loose for k, line in enumerate(pii.generated()) for _, y, loose, _ in pii.labelled_spans(line, k / 2**40))
    assert got == 2 * n + lines


def test_pii_trees_of_blocks_are_those_of_the_whole():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (3_000, 5)).astype(float)
    y = (x[:, 1] + x[:, 3] > 40).astype(float)
    whole = pii.Boosted().fit(x, y)
    edges = [pii.edges_of(*np.unique(c, return_counts=True)) for c in x.T]
    assert all(np.array_equal(e, np.unique(np.quantile(c, np.linspace(0, 1, pii.BINS)))) for e, c in zip(edges, x.T))
    blocks = [(pii.binned_rows(x[i::7], edges), y[i::7], np.ones(len(y[i::7]))) for i in range(7)]
    parts = pii.Boosted().boost(edges, float(y.mean()), lambda *asked: sum(pii.histogram(b, *asked) for b in blocks))
    assert parts.trees == whole.trees and parts.start == whole.start
    # each value once, with its number
    rows, n = np.unique(np.column_stack([y, x]), axis=0, return_counts=True)
    once = pii.Boosted().boost(edges, float(y.mean()), lambda *asked: pii.histogram((pii.binned_rows(rows[:, 1:], edges), rows[:, 0], n.astype(float)), *asked))
    assert [[t[:2] for t in tree] for tree in once.trees[:3]] == [[t[:2] for t in tree] for tree in whole.trees[:3]]
