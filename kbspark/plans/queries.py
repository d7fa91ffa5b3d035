"""Registered queries: one per operator group of the inventory.

Each takes (spark, sf_dir) and returns a DataFrame over the driver tables
(or tables Spark derives from them). Column names match the DuckDB
oracles in ``kbspark.plans.oracles``; arrays are rendered as text so the
comparison does not depend on how a client prints arrays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.functions import frames as FR
from kbspark.functions import tagging as G
from kbspark.functions import text as T
from kbspark.functions import words as W
from kbspark.functions.fuzzy import sequence_ratio
from kbspark.operators import graph as GR
from kbspark.operators import hierarchy as HI
from kbspark.operators import markdown as M
from kbspark.operators import pages as P
from kbspark.operators import retrieval as R
from kbspark.operators.kb import spread
from kbspark.plans import build as B
from kbspark.session import Scratch, scratch_table_dir
from kbspark.sources import tables as S
from kbspark.sources.tables import read_table
from kbspark.streaming import streams as ST

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


PRODUCT_PREFIX = "/en/"  # C12 on the driver's URLs
FORCED_WORDS = 2         # D3: entities of so many words serve as forced phrases


# ----------------------------------------------------------------- S
def s1_scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", ["doc_id", "text", "lang", "source", "n_chars"])


def s2_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [S.count_rows(spark.read.parquet(f"{sf}/{t}.parquet")).select(F.lit(t).alias("table_name"), "n")
             for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ----------------------------------------------------------------- C
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages", ["page_id", "url", "html"])


def c1_canonical_url(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages", ["page_id", "url"]).select(
        "page_id", T.canonical_url(F.col("url")).alias("canonical_id"))


def c2_first_page_per_url(spark: SparkSession, sf: str) -> DataFrame:
    """C2 over all URLs that a crawl of the pages meets: each page's own and
    the targets of its links, which repeat."""
    pages = _pages(spark, sf)
    met = pages.select("page_id", "url").unionByName(P.page_links(pages).select("page_id", F.col("link_id").alias("url")))
    return P.dedupe_pages(met).select("canonical_id", "page_id")


def c3_out_links(spark: SparkSession, sf: str) -> DataFrame:
    # the crawl frontier over every host of the driver pages
    return P.out_links(_pages(spark, sf))


def c4_title_h1(spark: SparkSession, sf: str) -> DataFrame:
    return P.title_and_h1(_pages(spark, sf))


def c10_clean_items(spark: SparkSession, sf: str) -> DataFrame:
    """C2, C8-C11 on items made natively: title and h1 by C4, each text
    between tags a line of content; pages without a title go."""
    pages = _pages(spark, sf)
    lines = pages.select("page_id", "url", F.regexp_replace("html", "<[^>]*>", "\n").alias("content"))
    items = lines.join(P.title_and_h1(pages), "page_id").select(
        "page_id", "url", F.nullif("title", F.lit("")).alias("title"), F.lit(None).cast("array<string>").alias("hierarchy"),
        F.col("h1").alias("heading"), "content")
    return P.clean_items(items).select("doc_id", "page_id", "title", F.array_join("heading", " > ").alias("heading"),
                                       F.array_join("content", "\n").alias("content"))


def c12_product_key(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "pages", ["page_id", "url"]).select("page_id", T.product_key(F.col("url"), PRODUCT_PREFIX).alias("product"))


def c6_docs_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = P.docs_from_pages(_pages(spark, sf), content_tag="article", content_class=None, h1_class=None)
    return docs.select("doc_id", "title", F.array_join("heading", " > ").alias("heading"),
                       F.size("content").alias("n_lines"))


def _doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = B.documents(spark, sf)
    return d.select(F.col("doc_id"), F.posexplode(T.clean_lines(F.col("text"))).alias("line_no", "line"))


def c9_clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _doc_lines(spark, sf)


# ----------------------------------------------------------------- M
def m1_heading_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = B.documents(spark, sf).select(F.col("doc_id"), T.clean_lines(F.col("text")).alias("content"))
    return M.heading_lines(d)


def m4_sections(spark: SparkSession, sf: str) -> DataFrame:
    inp = P.kb_input_from_documents(B.documents(spark, sf))
    return M.sections(inp).select(F.col("doc_id").cast("long").alias("doc_id"), "section_idx",
                                  F.array_join("path", " > ").alias("path"), F.size("lines").alias("n_lines"))


# ----------------------------------------------------------------- T
def _sentences(spark: SparkSession, sf: str) -> DataFrame:
    return spread(_doc_lines(spark, sf), "doc_id", "line_no").select("doc_id", "line_no",
                                        F.posexplode(T.sentences(F.col("line"))).alias("sent_idx", "sentence"))


def t1_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _sentences(spark, sf)


def t4_tagged(spark: SparkSession, sf: str) -> DataFrame:
    s = _sentences(spark, sf).withColumn("toks", W.tag_sentences("sentence"))
    return s.select("doc_id", "line_no", "sent_idx", T.encode_tagged(F.col("toks")).alias("tagged"),
                    F.array_join(F.transform("toks", lambda t: T.wordnet_class(t["pos"])), ",").alias("wn"))


def e3_entities(spark: SparkSession, sf: str) -> DataFrame:
    s = _sentences(spark, sf)
    return s.select("doc_id", "line_no", "sent_idx", F.explode(W.sentence_entities("sentence")).alias("entity"))


def t8_normalize_part_names(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_partkey", "p_name"])
    return p.select("p_partkey", T.normalize_phrase(F.col("p_name"), G.default_noun_lemma_map()).alias("normalized"))


def t10_part_name_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", ["p_partkey", "p_name"])
    g = p.select("p_partkey", F.posexplode(T.ngrams_with_size(F.col("p_name"))).alias("pos", "g"))
    return g.select("p_partkey", "pos", F.col("g.gram").alias("gram"), F.col("g.n").alias("n"))


def _user_turns(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations", ["conv_id", "turn", "role", "text"])
    return c.where(F.col("role") == "user")


def t13_important_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _user_turns(spark, sf).select("conv_id", "turn", T.important_tokens(F.col("text")).alias("tokens"))


def t16_question_trim(spark: SparkSession, sf: str) -> DataFrame:
    return _user_turns(spark, sf).select("conv_id", "turn", T.question_trim(F.col("text")).alias("trimmed"))


def t17_alnum_length(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents", ["doc_id", "text"])
    return d.select("doc_id", T.alnum_length(F.col("text")).alias("alnum_len"))


def t15_question_score(spark: SparkSession, sf: str) -> DataFrame:
    s = _user_turns(spark, sf).select("conv_id", "turn", F.posexplode(
        T.line_sentences(T.question_trim(F.col("text")))).alias("sent_idx", "sentence"))
    toks = G.tag_sentence(F.col("sentence"))
    return s.select("conv_id", "turn", "sent_idx",
                    F.round(G.question_score(toks, F.col("sentence")), 9).alias("score"))


def t15_question_marks(spark: SparkSession, sf: str) -> DataFrame:
    """T15 of the user turns with their full stops as question marks: the
    driver's own questions have none inside."""
    asked = _user_turns(spark, sf).withColumn("text", F.concat(F.translate("text", ".", "?"), F.lit(" Or")))
    s = asked.select("conv_id", "turn", F.posexplode(
        T.line_sentences(T.question_trim(F.col("text")))).alias("sent_idx", "sentence"))
    toks = G.tag_sentence(F.col("sentence"))
    return s.select("conv_id", "turn", "sent_idx", F.round(G.question_score(toks, F.col("sentence")), 9).alias("score"))


# ----------------------------------------------------------------- K
def k2_headings(spark: SparkSession, sf: str) -> DataFrame:
    kb = B.kb_from_documents(spark, sf)
    return kb.headings.select("heading_id", "heading", F.coalesce("parent_id", F.lit(0)).alias("parent_id"),
                              F.array_join("path", " > ").alias("path"))


def k6_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return B.kb_from_documents(spark, sf).sentences.select("sentence_id", "heading_id", "sentence")


def k4_entities(spark: SparkSession, sf: str) -> DataFrame:
    return B.kb_from_documents(spark, sf).entities


def k5_normalizations(spark: SparkSession, sf: str) -> DataFrame:
    return B.kb_from_documents(spark, sf).normalizations


def k7_frame_index(spark: SparkSession, sf: str) -> DataFrame:
    return B.kb_from_documents(spark, sf).frame_index.select("frame", "sentence_id")


def f4_frames_by_table(spark: SparkSession, sf: str) -> DataFrame:
    """F3-F6 with units and lemmas as tables: the frame index, by joins."""
    sents = B.kb_from_documents(spark, sf).sentences.select(F.col("sentence_id").alias("row_id"), "sentence")
    work = Scratch(spark, scratch_table_dir(spark, "frames"))
    return (FR.tagged_frames_with_tables(sents, "sentence", S.lexical_units(spark), S.lemmas(spark), keep=work.keep)
            .select("frame", F.col("row_id").alias("sentence_id")))


def f5_frame_memo(spark: SparkSession, sf: str) -> DataFrame:
    """the keys of all sentences with their frames, for the next run. A key
    is one of a tagged token, and each distinct one is cut once."""
    items = B.kb_from_documents(spark, sf).sentences.select(F.explode(F.split("sentence", " ")).alias("item"))
    toks = FR.spread_items(items).select(F.col("item").alias("row_id"), T.decode_tagged(F.col("item")).alias("toks"))
    memo = FR.frame_memo(FR.word_keys(toks, "toks", S.lemmas(spark))[1], S.lexical_units(spark))
    return memo.select("key", F.array_join("frames", "|").alias("frames"))


def k9_heading_content(spark: SparkSession, sf: str) -> DataFrame:
    from kbspark.operators.kb import heading_content
    kb = B.kb_from_documents(spark, sf)
    return heading_content(kb.sentences, kb.headings)


def k10_heading_text(spark: SparkSession, sf: str) -> DataFrame:
    """K10 for every heading that an answer links to."""
    from kbspark.operators.kb import heading_text
    kb = B.kb_from_documents(spark, sf)
    linked = B.answers(spark, sf).where(F.col("heading").isNotNull()).select(
        F.substring_index("url", "/", -1).try_cast("long").alias("heading_id")).distinct()
    return heading_text(kb.sentences, kb.headings, linked)


def k12_ordered_entities(spark: SparkSession, sf: str) -> DataFrame:
    from kbspark.operators.kb import ordered_entities
    return ordered_entities(B.kb_from_documents(spark, sf).entities)


def k13_sentence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """For each heading the list (last, first, the one before the first)
    of sentence ids, in that order; the first heading's third id is missing."""
    from kbspark.operators.kb import sentences_by_ids
    kb = B.kb_from_documents(spark, sf)
    ids = kb.heading_info.select(F.col("heading_id").alias("req"), F.posexplode(F.array(
        "last_sentence_id", "first_sentence_id", F.col("first_sentence_id") - 1)).alias("pos", "sentence_id"))
    return sentences_by_ids(kb.sentences, ids).select(
        "req", "pos", "sentence_id", F.array_join(F.col("toks.token"), " ").alias("tokens"),
        F.array_join(F.col("toks.pos"), " ").alias("tags"))


def k11_sentence_count(spark: SparkSession, sf: str) -> DataFrame:
    return S.count_rows(B.kb_from_documents(spark, sf).sentences)


def k3_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """K1-K7 as upserts: all rows of a KB that got the documents in two
    batches, as (kind, id, ref, text)."""
    from kbspark.operators.kb import stored
    kb = stored(B.upserted_catalog(spark, sf).snapshot())
    zero, none = F.lit(0).cast("long"), F.lit("")
    parts = {
        "heading": kb.headings.select("heading_id", F.coalesce("parent_id", zero), F.array_join("path", " > ")),
        "sentence": kb.sentences.select("sentence_id", "heading_id", "sentence"),
        "entity": kb.entities.select("entity_id", zero, "entity"),
        "link": kb.normalizations.select("sentence_id", "entity_id", none),
        "frame": kb.frame_index.select("sentence_id", zero, "frame"),
        "first": kb.heading_info.select("heading_id", "first_sentence_id", "heading"),
        "last": kb.heading_info.select("heading_id", "last_sentence_id", "heading"),
    }
    out = None
    for kind, df in parts.items():
        df = df.toDF("id", "ref", "text").select(F.lit(kind).alias("kind"), "id", "ref", "text")
        out = df if out is None else out.unionByName(df)
    return out


def k4_by_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The KB by word tables (lexicon, lemmas and units as a user would give
    them, here the shipped ones): sentences, entities, links and frames."""
    from kbspark.operators.kb import Words, kb_rows
    words = Words(S.lexicon(spark), S.lemmas(spark), S.lexical_units(spark))
    work = Scratch(spark, scratch_table_dir(spark, "by-tables"))
    kb = kb_rows(P.kb_input_from_documents(B.documents(spark, sf)), words=words, keep=work.keep)
    zero, none = F.lit(0).cast("long"), F.lit("")
    parts = {"sentence": kb.sentences.select("sentence_id", "heading_id", "sentence"), "entity": kb.entities.select("entity_id", zero, "entity"),
             "link": kb.normalizations.select("sentence_id", "entity_id", none), "frame": kb.frame_index.select("sentence_id", zero, "frame")}
    out = None
    for kind, df in parts.items():
        df = df.toDF("id", "ref", "text").select(F.lit(kind).alias("kind"), "id", "ref", "text")
        out = df if out is None else out.unionByName(df)
    return out


def q1_by_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 by word tables."""
    from kbspark.operators.kb import Words
    an = R.analyse_questions(B.user_questions(spark, sf), words=Words(S.lexicon(spark), S.lemmas(spark), S.lexical_units(spark)))
    return an.select("q_id", "sent_idx", F.array_join("q_entities", "|").alias("entities"), F.array_join("q_frames", "|").alias("frames"))


def s8_live_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table of the live version, as a session sees them that
    knows the catalog's folder alone; the first version stays readable."""
    root = B.upserted_catalog(spark, sf).root
    live = S.Catalog(spark.newSession(), root).snapshot()
    names = ["headings", "sentences", "entities", "normalizations", "frame_index", "heading_info"]
    out = None
    for name in names:
        df = S.count_rows(live.table(name)).select(F.lit(name).alias("table_name"), F.lit(live.number).alias("number"), "n")
        out = df if out is None else out.unionByName(df)
    return out


def k15_heading_info(spark: SparkSession, sf: str) -> DataFrame:
    return B.kb_from_documents(spark, sf).heading_info.select(
        "heading_id", "heading", "first_sentence_id", "last_sentence_id")


def k8_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    return HI.hierarchy(B.kb_from_documents(spark, sf).headings)


def k14_progress(spark: SparkSession, sf: str) -> DataFrame:
    ev = read_table(spark, sf, "events", ["event_id", "ts", "event_type"])
    return HI.progress(ev.withColumnRenamed("event_type", "job"), "job", "ts", "event_id")


# ----------------------------------------------------------------- D, G
def d1_acronym_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return GR.expand_acronyms(B.kb_from_documents(spark, sf).entities, S.acronyms(spark))


def d2_entity_stoplist(spark: SparkSession, sf: str) -> DataFrame:
    return GR.drop_stop_entities(B.kb_from_documents(spark, sf).entities, S.entity_stopwords(spark))


def d3_forced_entities(spark: SparkSession, sf: str) -> DataFrame:
    """D3 with the KB's entities of two words as the forced phrases."""
    kb = B.kb_from_documents(spark, sf)
    forced = kb.entities.where(F.size(F.split("entity", " ")) == FORCED_WORDS).select("entity")
    return GR.forced_entities(kb.sentences, forced)


def g1_edges_touching_question_entities(spark: SparkSession, sf: str) -> DataFrame:
    kb = B.kb_from_documents(spark, sf)
    an = B.retrieval(spark, sf).analysed
    terms = an.select(F.explode("q_entities").alias("term"))
    return GR.edges_touching(GR.kb_edges(kb), terms)


def g2_edges_between_entity_and_heading(spark: SparkSession, sf: str) -> DataFrame:
    """G2 for pairs (question entity, heading of a ranked answer)."""
    kb = B.kb_from_documents(spark, sf)
    an = B.retrieval(spark, sf).analysed
    ans = B.answers(spark, sf).where(F.col("heading").isNotNull())
    pairs = (an.select("q_id", "sent_idx", F.explode("q_entities").alias("t1"))
             .join(ans.select("q_id", "sent_idx", F.col("heading").alias("t2")), ["q_id", "sent_idx"])
             .select("t1", "t2").distinct())
    return GR.edges_between(GR.kb_edges(kb), pairs)


# ----------------------------------------------------------------- Q
def q1_question_analysis(spark: SparkSession, sf: str) -> DataFrame:
    an = B.retrieval(spark, sf).analysed
    return an.select("q_id", "sent_idx", F.array_join("q_entities", "|").alias("entities"),
                     F.array_join("q_frames", "|").alias("frames"))


def q4_entity_candidates(spark: SparkSession, sf: str) -> DataFrame:
    top = B.retrieval(spark, sf).top
    return top.select("gram", "entity_id", "entity", F.col("elen").cast("int").alias("elen"),
                      F.col("dist").cast("int").alias("dist"))


def q8_division(spark: SparkSession, sf: str) -> DataFrame:
    return B.retrieval(spark, sf).groups.select("q_id", "sent_idx", "heading_id", "level")


def q9_frame_filter(spark: SparkSession, sf: str) -> DataFrame:
    kb = B.kb_from_documents(spark, sf)
    r = B.retrieval(spark, sf)
    return R.frame_filter(r.groups, r.hits, r.analysed, kb.frame_index).select("q_id", "sent_idx", "heading_id")


def q10_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Q10 for every heading that passes the frame filter."""
    _, scored = R.score_kept(B.retrieval(spark, sf), B.kb_from_documents(spark, sf))
    return scored.select("q_id", "sent_idx", "heading_id", F.round("score", 9).alias("score"))


def t14_question_heading_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """T14 of every question with the headings of its answers."""
    pairs = (B.answers(spark, sf).where(F.col("heading").isNotNull()).select("q_id", "heading").distinct()
             .join(B.user_questions(spark, sf), "q_id"))
    return pairs.select("q_id", "heading", F.round(sequence_ratio("question", "heading"), 9).alias("ratio"))


def q_answers(spark: SparkSession, sf: str) -> DataFrame:
    return B.answers(spark, sf)


def s10_answers_json(spark: SparkSession, sf: str) -> DataFrame:
    return R.answers_json(B.user_questions(spark, sf), B.answers(spark, sf))


def e2_np_vp_segments(spark: SparkSession, sf: str) -> DataFrame:
    seg = _sentences(spark, sf).select("doc_id", "line_no", "sent_idx", F.posexplode(W.sentence_segments("sentence")).alias("i", "g"))
    return seg.select("doc_id", "line_no", "sent_idx", "i", F.col("g.label").alias("label"),
                      F.col("g.start").alias("start"), F.col("g.len").alias("len"))


def t12_sentence_template(spark: SparkSession, sf: str) -> DataFrame:
    """T12 on every sentence of the documents table."""
    return _sentences(spark, sf).select("doc_id", "line_no", "sent_idx", W.sentence_templates("sentence").alias("template"))


def f6_question_frames(spark: SparkSession, sf: str) -> DataFrame:
    an = B.retrieval(spark, sf).analysed
    return an.select("q_id", "sent_idx", F.explode("q_frames").alias("frame"))


# ----------------------------------------------------------------- ST
def st1_dedupe_page_stream(spark: SparkSession, sf: str) -> DataFrame:
    return ST.run_to_table(spark, ST.dedupe_page_stream(spark, sf), "st1_pages")


def st2_clean_page_stream(spark: SparkSession, sf: str) -> DataFrame:
    return ST.clean_page_stream_to_table(spark, sf)


def st3_question_stream(spark: SparkSession, sf: str) -> DataFrame:
    B.kb_from_documents(spark, sf)  # published, if it was not
    return ST.answer_question_stream(spark, sf, B.kb_catalog(spark, sf))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "s1_scan_documents": s1_scan_documents,
    "s2_row_counts": s2_row_counts,
    "c1_canonical_url": c1_canonical_url,
    "c2_first_page_per_url": c2_first_page_per_url,
    "c3_out_links": c3_out_links,
    "c4_title_h1": c4_title_h1,
    "c10_clean_items": c10_clean_items,
    "c12_product_key": c12_product_key,
    "c9_clean_lines": c9_clean_lines,
    "c6_docs_from_pages": c6_docs_from_pages,
    "m1_heading_lines": m1_heading_lines,
    "m4_sections": m4_sections,
    "t1_sentences": t1_sentences,
    "t4_tagged": t4_tagged,
    "t8_normalize_part_names": t8_normalize_part_names,
    "t10_part_name_ngrams": t10_part_name_ngrams,
    "t13_important_tokens": t13_important_tokens,
    "t15_question_score": t15_question_score,
    "t15_question_marks": t15_question_marks,
    "t16_question_trim": t16_question_trim,
    "t17_alnum_length": t17_alnum_length,
    "e2_np_vp_segments": e2_np_vp_segments,
    "t12_sentence_template": t12_sentence_template,
    "e3_entities": e3_entities,
    "k2_headings": k2_headings,
    "k4_entities": k4_entities,
    "k5_normalizations": k5_normalizations,
    "k6_sentences": k6_sentences,
    "k7_frame_index": k7_frame_index,
    "f4_frames_by_table": f4_frames_by_table,
    "f5_frame_memo": f5_frame_memo,
    "k8_hierarchy": k8_hierarchy,
    "k9_heading_content": k9_heading_content,
    "k10_heading_text": k10_heading_text,
    "k12_ordered_entities": k12_ordered_entities,
    "k13_sentence_lookup": k13_sentence_lookup,
    "k11_sentence_count": k11_sentence_count,
    "k14_progress": k14_progress,
    "k15_heading_info": k15_heading_info,
    "k3_upsert": k3_upsert,
    "k4_by_tables": k4_by_tables,
    "q1_by_tables": q1_by_tables,
    "s8_live_counts": s8_live_counts,
    "d1_acronym_expansion": d1_acronym_expansion,
    "d2_entity_stoplist": d2_entity_stoplist,
    "d3_forced_entities": d3_forced_entities,
    "f6_question_frames": f6_question_frames,
    "g1_edges_touching_question_entities": g1_edges_touching_question_entities,
    "g2_edges_between_entity_and_heading": g2_edges_between_entity_and_heading,
    "q1_question_analysis": q1_question_analysis,
    "q4_entity_candidates": q4_entity_candidates,
    "q8_division": q8_division,
    "q9_frame_filter": q9_frame_filter,
    "q10_scores": q10_scores,
    "t14_question_heading_ratio": t14_question_heading_ratio,
    "q_answers": q_answers,
    "s10_answers_json": s10_answers_json,
    "st1_dedupe_page_stream": st1_dedupe_page_stream,
    "st2_clean_page_stream": st2_clean_page_stream,
    "st3_question_stream": st3_question_stream,
}
