"""KB build and upsert (K1-K7, K9-K15): relational tables from tagged sentences.

``kb_rows`` gives the rows that documents add to a KB: whatever the KB holds
by its natural key (a heading's path, a sentence under its heading, an entity)
keeps its id, the rest is numbered on from the largest id. Of the stored
sentences only those under headings that the new documents touch are read for
that. A build is the same over no KB.

Shuffles: heading prefixes (distinct by path), section -> heading id join (paths
alone), lines by ranges of the text order, sentence de-duplication by (text, heading),
one range sort for dense sentence ids and one by heading, entity first
appearance, entity id join, and the frame index. Sections, sentences, tagging
and entities are narrow, row-local work; frames are made once for each distinct
tagged token.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kbspark.functions import frames as FR
from kbspark.functions import tagging as G
from kbspark.functions import text as T
from kbspark.functions import words as W
from kbspark.functions.analysis import analysed_texts
from kbspark.operators.ids import dense_ids
from kbspark.operators.markdown import sections
from kbspark.session import Keep, Scratch, checkpointed
from kbspark.sources.tables import Catalog, Snapshot

ROOT_ID = 1
ROOT_NAME = "ROOT"


@dataclass
class KB:
    headings: DataFrame        # heading_id, heading, parent_id, path
    sentences: DataFrame       # sentence_id, sentence, dependencies, heading_id
    entities: DataFrame        # entity_id, entity
    normalizations: DataFrame  # sentence_id, entity_id
    frame_index: DataFrame     # frame, sentence_id
    heading_info: DataFrame    # heading_id, heading, first_sentence_id, last_sentence_id

    def tables(self) -> dict[str, DataFrame]:
        return {"headings": self.headings, "sentences": self.sentences, "entities": self.entities,
                "normalizations": self.normalizations, "frame_index": self.frame_index,
                "heading_info": self.heading_info}


#: Lines of a section that are dealt together.
CHUNK_LINES = 256


def section_sentences(secs: DataFrame, headings: DataFrame) -> DataFrame:
    """M4 + T2: (occ, heading_id, text), one row per sentence of sections
    (doc_id, doc_order, section_idx, path, lines) whose path is one of
    ``headings`` (path, heading_id); ``occ`` rises in text order. Lines are
    dealt out by ranges of that order before the work on their text: a document
    or a file that is read by one task does not keep it there. Only paths are
    joined to the headings: each ``CHUNK_LINES`` lines of a section get their
    heading's id by a row of their own that is dealt to the same task."""
    place = ["doc_order", "doc_id", "section_idx", "told", "chunk"]  # a place may come twice, with other paths
    secs = secs.withColumn("told", F.substring(F.unhex(F.sha2(F.to_json(F.struct("path")), 256)), 1, 16))
    chunk = F.floor(F.col("line_no") / CHUNK_LINES).cast("int").alias("chunk")
    lines = (secs.select("doc_order", "doc_id", "section_idx", "told", F.posexplode("lines").alias("line_no", "line"))
             .select("doc_order", "doc_id", "section_idx", "told", chunk, "line_no", "line", F.lit(None).cast("long").alias("heading_id")))
    last = F.floor((F.size("lines") - 1) / CHUNK_LINES).cast("int")
    heads = (secs.where(F.size("lines") > 0).select("doc_order", "doc_id", "section_idx", "path", "told", last.alias("last"))
             .join(headings.select("path", "heading_id"), "path")
             .select("doc_order", "doc_id", "section_idx", "told", F.explode(F.sequence(F.lit(0), "last")).alias("chunk"),
                     F.lit(-1).alias("line_no"), F.lit(None).cast("string").alias("line"), "heading_id"))
    parts = int(secs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.unionByName(heads).repartitionByRange(parts, *place)
    of = Window.partitionBy(*place).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = dealt.withColumn("heading_id", F.max("heading_id").over(of)).where("line IS NOT NULL AND heading_id IS NOT NULL")
    return known.select("heading_id", F.explode(T.sentences(F.col("line"))).alias("text")).select(
        F.monotonically_increasing_id().alias("occ"), "heading_id", "text")


def spread(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by keys over ``parts`` tasks, by default the session's
    shuffle partitions; their number is not lowered by size, as the work that
    follows is long and the rows are short."""
    return df.repartition(parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@dataclass(frozen=True)
class Words:
    """A user's word tables of any size: lexicon (form, tag), lemmas (form, pos,
    lemma) and lexical units (unit, frame). They are joined to the distinct
    words of the input; the shipped lists stand for those that are None."""
    lexicon: DataFrame | None = None
    lemmas: DataFrame | None = None
    units: DataFrame | None = None


def tag(df: DataFrame, text_col: str = "text", tag_map=None, words: Words | None = None, keys: list[str] | None = None,
        keep: Keep = checkpointed) -> DataFrame:
    """T3/T4 + T5 + E3 on a sentence table. With ``words`` the columns ``keys``
    must name a row."""
    words = words or Words()
    row = F.struct(*keys) if keys else None
    if words.lexicon is not None:
        cut = df.withColumn("row_id", row).withColumn("toks", T.tokens(F.col(text_col)))
        out = G.tag_with_table(cut, "toks", words.lexicon, keep=keep).drop("row_id")
    else:
        out = df.withColumn("toks", tagged_tokens(F.col(text_col), tag_map))
    out = out.withColumn("sentence", T.encode_tagged(F.col("toks")))
    if words.lemmas is None:
        return out.withColumn("entities", W.tagged_entities("sentence"))
    out = out.withColumn("row_id", row)
    found = (G.entities_with_table(out, "toks", words.lemmas).groupBy("row_id")
             .agg(F.array_sort(F.collect_list("entity")).alias("entities")))  # of one sentence
    none = F.array().cast("array<string>")
    return out.join(found, "row_id", "left").withColumn("entities", F.coalesce("entities", none)).drop("row_id")


def tagged_tokens(text: Column, tag_map=None) -> Column:
    """T3 + T4: by the shipped words, or by a map of forms to tags."""
    return W.tag_sentences(text) if tag_map is None else G.tag_sentence(text, tag_map)


def next_id(df: DataFrame | None, column: str, first: int = 1) -> int:
    top = df.agg(F.max(column)).first()[0] if df is not None else None
    return first if top is None else top + 1


def new_headings(secs: DataFrame, base: KB | None = None, keep: Keep = checkpointed) -> DataFrame:
    """K1/K2: every path prefix of a section is a heading under its parent
    prefix (also for sections without sentences); ids in first-appearance
    order (ROOT = 1, parents before children). A path of the base is no new
    heading, but may be the parent of one."""
    secs = secs.select("doc_order", "doc_id", "section_idx", "path")
    prefixes = secs.select("doc_order", "doc_id", "section_idx", "path",
                           F.explode(F.sequence(F.lit(1), F.size("path"))).alias("k"))
    prefixes = prefixes.select(F.slice("path", 1, F.col("k")).alias("hpath"), "k",
                               F.struct("doc_order", "doc_id", "section_idx").alias("o"))
    first = prefixes.groupBy("hpath").agg(F.min("o").alias("o"), F.first("k").alias("k"))
    first = first.select("hpath", "k", F.col("o.doc_order").alias("o1"), F.col("o.doc_id").alias("o2"),
                         F.col("o.section_idx").alias("o3"))
    if base is not None:
        first = first.join(base.headings.select(F.col("path").alias("hpath")), "hpath", "left_anti")
    ided = dense_ids(first, ["o1", "o2", "o3", "k"], "heading_id", start=next_id(base and base.headings, "heading_id", ROOT_ID + 1), keep=keep)
    parents = ided.select(F.col("hpath").alias("ppath"), F.col("heading_id").alias("parent_id"))
    if base is not None:
        parents = parents.unionByName(base.headings.where(F.col("heading_id") != ROOT_ID).select(
            F.col("path").alias("ppath"), F.col("heading_id").alias("parent_id")))
    with_parent = (ided.withColumn("ppath", F.slice("hpath", 1, F.col("k") - 1))
                   .join(parents, "ppath", "left")
                   .select("heading_id", F.try_element_at("hpath", F.lit(-1)).alias("heading"),
                           F.coalesce("parent_id", F.lit(ROOT_ID)).cast("long").alias("parent_id"),
                           F.col("hpath").alias("path")))
    if base is not None:
        return with_parent
    root = secs.sparkSession.createDataFrame([(ROOT_ID, ROOT_NAME, None, [])],
                                              "heading_id long, heading string, parent_id long, path array<string>")
    return root.unionByName(with_parent)


def new_sentences(sents: DataFrame, base: KB | None = None, keep: Keep = checkpointed) -> DataFrame:
    """K3/K6: (sentence_id, heading_id, text), one row per (sentence, heading),
    first occurrence wins; dense ids in text order. ``text`` is the tokens
    joined by blanks: it decides the tagged sentence and is decided by it, and
    it is half as long, so the tags come when the rows are numbered."""
    firsts = (sents.withColumn("text", T.token_text(F.col("text"))).groupBy("text", "heading_id")
              .agg(F.min("occ").alias("occ")))
    if base is not None:
        touched = firsts.select("heading_id").distinct()
        held = base.sentences.join(touched, "heading_id", "left_semi").select(
            T.token_text(F.array_join(W.decoded("sentence")["token"], " ")).alias("text"), "heading_id")
        firsts = firsts.join(held, ["text", "heading_id"], "left_anti")
    ided = dense_ids(firsts, ["occ"], "sentence_id", start=next_id(base and base.sentences, "sentence_id"), keep=keep)
    return ided.drop("occ")


def analysed(rows: DataFrame) -> DataFrame:
    """T4 + T5, E3 and the tokens with frames by the shipped words, in place of ``text``."""
    return rows.withColumn("a", analysed_texts("text")).select(*[c for c in rows.columns if c != "text"], "a.*")


def tagged_sentences(rows: DataFrame, tag_map=None, words: Words | None = None, keep: Keep = checkpointed) -> DataFrame:
    """The sentences table of numbered rows, in order of their heading, so that
    the sentences of one heading are read from few row groups."""
    by = ["heading_id", "sentence_id"]
    if "sentence" in rows.columns:  # analysed
        dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    elif words is not None and words.lexicon is not None:
        cut = rows.withColumn("row_id", F.col("sentence_id")).withColumn("toks", T.tokens(F.col("text")))
        tagged = G.tag_with_table(cut, "toks", words.lexicon, keep=keep).select(
            "sentence_id", "heading_id", T.encode_tagged(F.col("toks")).alias("sentence"))
        dealt = keep(tagged, "tagged").repartitionByRange(*by).sortWithinPartitions(*by)
    else:
        dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(
            "sentence", W.tagged_texts("text") if tag_map is None else T.encode_tagged(G.tag_sentence(F.col("text"), tag_map)))
    return dealt.select("sentence_id", "sentence", F.array().cast("array<string>").alias("dependencies"), "heading_id")


def sentence_links(sentences: DataFrame, words: Words | None = None) -> DataFrame:
    """Distinct (sentence_id, entity)."""
    if "entities" in sentences.columns:  # analysed
        return sentences.select("sentence_id", F.explode("entities").alias("entity"))
    if words is None or words.lemmas is None:
        return sentences.select("sentence_id", F.explode(W.tagged_entities("sentence")).alias("entity"))
    rows = sentences.select(F.col("sentence_id").alias("row_id"), W.decoded("sentence").alias("toks"))
    return G.entities_with_table(rows, "toks", words.lemmas).select(F.col("row_id").alias("sentence_id"), "entity")


def new_entities(links: DataFrame, base: KB | None = None, keep: Keep = checkpointed) -> tuple[DataFrame, DataFrame]:
    """K4/K5: entities in first-appearance order and the links (distinct
    sentence_id, entity) by ids."""
    first = links.groupBy("entity").agg(F.min("sentence_id").alias("first_sid"))
    if base is not None:
        first = first.join(base.entities.select("entity"), "entity", "left_anti")
    start = next_id(base and base.entities, "entity_id")
    entities = dense_ids(first, ["first_sid", "entity"], "entity_id", start=start, keep=keep).select("entity_id", "entity")
    known = entities if base is None else entities.unionByName(base.entities.select("entity_id", "entity"))
    return entities, links.join(known, "entity").select("sentence_id", "entity_id")


def build_frame_index(sentences: DataFrame, frame_map=None, words: Words | None = None, keep: Keep = checkpointed) -> DataFrame:
    """F1-F6 + K7: inverted index (frame, sentence_id), one row per pair.

    Kept exploded on purpose: a frame present in a third of all sentences
    would otherwise become one unbounded array in one row.
    """
    if words is not None and words.units is not None:
        rows = sentences.select(F.col("sentence_id").alias("row_id"), "sentence")
        found = FR.tagged_frames_with_tables(rows, "sentence", words.units, words.lemmas, keep=keep)
    elif "items" in sentences.columns and frame_map is None:  # analysed
        found = FR.item_rows_frames(sentences.select(F.col("sentence_id").alias("row_id"), F.explode("items").alias("item")), keep=keep)
    else:
        rows = sentences.select(F.col("sentence_id").alias("row_id"), "sentence")
        found = FR.frames_by_item(rows, "sentence", frame_map, keep)
    return found.select("frame", F.col("row_id").alias("sentence_id"))


def heading_info(sentences: DataFrame, headings: DataFrame) -> DataFrame:
    """K15 for all headings with sentences: text, min and max sentence id."""
    agg = sentences.groupBy("heading_id").agg(F.min("sentence_id").alias("first_sentence_id"),
                                              F.max("sentence_id").alias("last_sentence_id"))
    return agg.join(headings.select("heading_id", "heading"), "heading_id")


def kb_rows(kb_input: DataFrame, base: KB | None = None, truncate: bool = False, tag_map=None, frame_map=None,
            words: Words | None = None, keep: Keep = checkpointed) -> KB:
    """Entry A: docs -> the rows they add to ``base`` (all rows without one).
    Sections, sentences and the numbered tables are read several times and
    materialised once, by ``keep``. ``heading_info`` has the new sentences' part.
    By the shipped words, tags, entities and the tokens with frames are made in
    one pass, when the sentences are numbered, and kept with them."""
    words = words or Words()
    shipped = tag_map is None and words.lexicon is None and words.lemmas is None
    secs = keep(sections(kb_input, truncate), "sections")
    headings = keep(new_headings(secs, base, keep), "headings")
    known = headings if base is None else headings.unionByName(base.headings.select(*headings.columns))
    paths = known.where(F.col("heading_id") != ROOT_ID).select("path", "heading_id")
    numbered = new_sentences(section_sentences(secs, paths), base,
                             (lambda df, name: keep(analysed(df), name)) if shipped else keep)
    sentences = keep(tagged_sentences(numbered, tag_map, words, keep), "sentences")
    made = numbered if shipped and frame_map is None and words.units is None else sentences
    entities, norms = new_entities(sentence_links(numbered if shipped else sentences, words), base, keep)
    return KB(headings, sentences, entities, norms, build_frame_index(made, frame_map, words, keep), heading_info(sentences, known))


def build_kb(kb_input: DataFrame, **options) -> KB:
    """A whole KB that is not stored: its tables are materialised once."""
    kb = kb_rows(kb_input, **options)
    return KB(**{name: df.checkpoint(eager=True) for name, df in kb.tables().items()})


def stored(snapshot: Snapshot) -> KB:
    """The KB of a published version."""
    return KB(**{f.name: snapshot.table(f.name) for f in fields(KB)})


def upsert(catalog: Catalog, kb_input: DataFrame, only_on: int | None = None, **options) -> Snapshot:
    """Adds documents to the live KB of a catalog as a new version. The new
    rows are numbered against one version; if another publisher was faster,
    they are made again against that one. With ``only_on``, nothing is added
    unless that is the live number (0: none), and the live version returned."""
    while True:
        live = catalog.snapshot()
        number = live.number if live else 0
        if only_on is not None and number != only_on:
            return live
        work = Scratch(catalog.spark, catalog.root)
        version = f"{number + 1}-{uuid.uuid4().hex[:8]}"

        def keep(df: DataFrame, name: str) -> DataFrame:
            if name != "sentences":
                return work.keep(df, name)
            catalog.write(version, {name: df})  # where it belongs, once
            return catalog.read(version, name)

        rows = kb_rows(kb_input, stored(live) if live else None, keep=keep, **options)
        catalog.write(version, {name: df for name, df in rows.tables().items() if name != "sentences"})
        work.clear()
        got = catalog.publish(version, live, expect=number)
        if got is not None:
            return catalog.snapshot(got)


# ------------------------------------------------------------- read helpers
def heading_content(sentences: DataFrame, headings: DataFrame, heading_ids: DataFrame | None = None) -> DataFrame:
    """K9 (exploded, ordered by sentence id within heading): headings without
    sentences are absent. With ``heading_ids`` only those headings."""
    s = sentences if heading_ids is None else sentences.join(heading_ids.select("heading_id"), "heading_id",
                                                             "left_semi")
    return s.join(headings.select("heading_id", "heading"), "heading_id").select(
        "heading_id", "heading", "sentence_id", "sentence")


#: Sentences of a heading that K10 joins into one part.
PART_SENTENCES = 4_096


def heading_parts(sentences: DataFrame, headings: DataFrame, heading_ids: DataFrame, size: int = PART_SENTENCES) -> DataFrame:
    """K10 for headings of any length: (heading_id, heading, part, content),
    decoded and rebuilt sentences joined by blanks in id order, ``size`` of
    them a part; the parts in order, joined by blanks, are the heading's text.
    A heading's sentences are dealt over range partitions, counted there and
    numbered on, so no task or row holds them all."""
    rows = heading_content(sentences, headings, heading_ids).select(
        "heading_id", "heading", "sentence_id", T.rebuild_sentence(W.decoded("sentence")).alias("s"))
    n = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (rows.repartitionByRange(n, "heading_id", "sentence_id").withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    counts = ranged.groupBy("heading_id", "_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("heading_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("heading_id", "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    place = F.row_number().over(Window.partitionBy("heading_id", "_pid").orderBy("sentence_id"))
    numbered = (ranged.withColumn("_k", place).join(offsets, ["heading_id", "_pid"])
                .withColumn("part", F.floor((F.col("_off") + F.col("_k") - 1) / size).cast("long")))
    return (numbered.groupBy("heading_id", "heading", "part")
            .agg(F.array_sort(F.collect_list(F.struct("sentence_id", "s"))).alias("ss"))  # ``size`` at most
            .select("heading_id", "heading", "part", F.array_join(F.transform("ss", lambda x: x["s"]), " ").alias("content")))


def heading_text(sentences: DataFrame, headings: DataFrame, heading_ids: DataFrame) -> DataFrame:
    """K10 as one text a heading, for headings whose text fits a row."""
    parts = heading_parts(sentences, headings, heading_ids)
    return parts.groupBy("heading_id", "heading").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), " ").alias("content"))


def ordered_entities(entities: DataFrame) -> DataFrame:
    """All entities with their place (from 1) in text order."""
    return dense_ids(entities, ["entity"], "pos").select("pos", "entity_id", "entity")


def sentences_by_ids(sentences: DataFrame, ids: DataFrame) -> DataFrame:
    """K13 point lookup: ids(req, pos, sentence_id); missing ids skipped;
    request order kept through ``pos``."""
    return ids.join(sentences.select("sentence_id", "sentence"), "sentence_id").select(
        "req", "pos", "sentence_id", W.decoded("sentence").alias("toks"))
