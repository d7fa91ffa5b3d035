"""Markdown structure (M1-M4): heading paths and sections of a document.

A document row holds all its lines, so heading state is computed with
array functions inside that row: no shuffle, no window over a partition.
Per document the work is linear in its lines: the heading state is one fold
over the heading lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T

MAX_PATH_LEVEL = 7


def _line_info(content: Column) -> Column:
    """array<struct<i, lvl, txt>>: lvl = heading level (0 for content),
    txt = stripped heading text or stripped content line."""
    return F.transform(F.transform(content, lambda line: F.struct(T.heading_level(line).alias("lvl"), line.alias("line"))), lambda x, i: F.struct(
        i.alias("i"), x["lvl"].alias("lvl"),
        T.strip_markdown(F.when(x["lvl"] > 0, T.heading_text(x["line"])).otherwise(x["line"])).alias("txt")))


def _level_states(heads: Column, truncate: bool) -> Column:
    """The texts of levels 1..7 before the first heading and behind each, by
    one fold whose state is those texts."""
    none = F.array(*[F.lit(None).cast("string")] * MAX_PATH_LEVEL)

    def step(acc: Column, h: Column) -> Column:
        now = F.transform(F.element_at(acc, -1), lambda x, k: F.when(k == h["lvl"] - 1, h["txt"])
                          .when(F.lit(truncate) & (k >= h["lvl"]), F.lit(None).cast("string")).otherwise(x))
        return F.array_append(acc, now)

    return F.aggregate(heads, F.array(none), step)


def sections_column(content: Column, page_headings: Column, product: Column, truncate: bool = False) -> Column:
    """M3 + M4: array<struct<section_idx, path, lines>> of one document.

    path = [product] + page_headings[:-1] + levels 1..7 (level 1 starts as
    the last page heading). With ``truncate=False`` a deeper level keeps its
    last text after a shallower heading (the original behaviour); with
    ``truncate=True`` it is cleared. Sections without content lines are
    dropped: what lies between two headings is content, so a section is a
    slice of the lines.
    """
    n_page = F.size(page_headings)
    crumbs = F.slice(page_headings, 1, F.greatest(n_page - 1, F.lit(0)))
    page_heading = F.try_element_at(page_headings, F.lit(-1))

    def build(info: Column, heads: Column, states: Column) -> Column:
        def section(s: Column) -> Column:
            first = F.when(s == 0, F.lit(0)).otherwise(F.try_element_at(heads, F.greatest(s, F.lit(1)))["i"] + 1)
            end = F.coalesce(F.try_element_at(heads, s + 1)["i"], F.size(info))
            return F.struct(s.alias("section_idx"), F.element_at(states, s + 1).alias("levels"),
                            F.transform(F.slice(info, first + 1, end - first), lambda x: x["txt"]).alias("lines"))

        full = F.filter(F.transform(F.sequence(F.lit(0), F.size(heads)), section), lambda x: F.size(x["lines"]) > 0)

        def with_path(x: Column) -> Column:
            levels = F.transform(x["levels"], lambda t, k: F.when(k == 0, F.coalesce(t, page_heading)).otherwise(t))
            path = F.concat(F.array(product), crumbs, F.filter(levels, lambda t: t.isNotNull()))
            return F.struct(x["section_idx"].alias("section_idx"), path.alias("path"), x["lines"].alias("lines"))

        return F.transform(full, with_path)

    return T.let(_line_info(content), lambda info: T.let(
        F.filter(info, lambda x: x["lvl"] > 0), lambda heads: T.let(
            _level_states(heads, truncate), lambda states: build(info, heads, states))))


def sections(docs: DataFrame, truncate: bool = False) -> DataFrame:
    """docs(doc_id, doc_order, product, heading, content) ->
    sections(doc_id, doc_order, section_idx, path, lines). Narrow: no shuffle."""
    secs = sections_column(F.col("content"), F.col("heading"), F.col("product"), truncate)
    return (docs.select("doc_id", "doc_order", F.explode(secs).alias("s"))
            .select("doc_id", "doc_order", F.col("s.section_idx").alias("section_idx"),
                    F.col("s.path").alias("path"), F.col("s.lines").alias("lines")))


def heading_lines(docs: DataFrame) -> DataFrame:
    """M1 over a docs table: (doc_id, line_no, level, heading) of heading lines."""
    return (docs.select("doc_id", F.posexplode("content").alias("line_no", "line"))
            .where(T.heading_level(F.col("line")) > 0)
            .select("doc_id", "line_no", T.heading_level(F.col("line")).alias("level"),
                    T.strip_markdown(T.heading_text(F.col("line"))).alias("heading")))
