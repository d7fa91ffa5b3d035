"""Semantic frames of tagged sentences (F1-F6) as Column expressions.

Lexical-unit lookup (F4) uses precomputed unit keys: for a unit name
``w1 w2 ... wk.cls`` every contiguous run of its words is a key with class
= first letter of ``cls`` (the same hits as the original unanchored regex
search). The keys of the shipped table are a fixed small map literal; units
and lemmas of a user, tables of any size, go through ``frames_with_tables``,
which joins the distinct words of the input to them once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from kbspark.functions import text as T
from kbspark.functions.tagging import default_lemma
from kbspark.functions.words import TEXT, pattern
from kbspark.session import Keep, checkpointed
from kbspark.sources.wordlists import LEMMAS, LEXICAL_UNITS, STOPWORDS


def unit_keys(unit: str) -> list[str]:
    """Keys ``words__cls`` of one lexical-unit name."""
    name = unit.lower()
    if "." not in name:
        return []
    words_part, cls = name.rsplit(".", 1)
    if not cls:
        return []
    words = words_part.split()
    keys = []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            keys.append(" ".join(words[i:j]) + "__" + cls[0])
    return keys


def shipped_frames() -> dict[str, list[str]]:
    """key -> sorted distinct frames, for the shipped lexical units."""
    acc: dict[str, set] = defaultdict(set)
    for unit, frame in LEXICAL_UNITS:
        for k in unit_keys(unit):
            acc[k].add(frame)
    return {k: sorted(v) for k, v in sorted(acc.items())}


def default_frames(key: Column) -> Column:
    """Shipped frames of a key: most keys have none, which a hash set tells;
    only the others are looked up in the map literal."""
    items = shipped_frames()
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in items]), F.array(*[F.array(*[F.lit(f) for f in v]) for v in items.values()]))
    return F.when(key.isin(*items), F.try_element_at(m, key))


def unit_key_table(units: DataFrame) -> DataFrame:
    """(unit, frame) -> (key, frame): every contiguous word run of the unit
    name before its last '.', with the class letter after it."""
    name = F.lower(F.col("unit"))
    words_part = F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1)
    cls = F.substring(F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2), 1, 1)
    words = F.filter(F.split(words_part, r"\s+"), lambda w: w != "")
    n = F.size(words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.transform(
        F.sequence(i, F.greatest(n, i)), lambda j: F.array_join(F.slice(words, i, j - i + 1), " "))))
    return (units.where(name.contains(".") & (cls != "") & (n > 0))
            .select(F.explode(runs).alias("w"), cls.alias("cls"), "frame")
            .select(F.concat("w", F.lit("__"), "cls").alias("key"), "frame").distinct())


def frame_tokens(toks: Column) -> Column:
    """tokens eligible for frames (lower-cased, length >= 2, not a stop word)
    as array<struct<word, wn>>."""
    cand = F.transform(toks, lambda t: F.struct(F.lower(t["token"]).alias("word"),
                                                T.wordnet_class(t["pos"]).alias("wn")))
    return F.filter(cand, lambda c: (F.length(c["word"]) >= 2) & ~c["word"].isin(*STOPWORDS))


def frame_key(word: Column, wn: Column, lemma_map: Column | None = None) -> Column:
    """``word__class`` lookup key of a token with a WordNet class."""
    form = F.concat(word, F.lit("__"), wn)
    return lemma_key(word, wn, F.coalesce(default_lemma(form) if lemma_map is None else F.try_element_at(lemma_map, form), word))


def lemma_key(word: Column, wn: Column, lemma: Column) -> Column:
    """F3 once the lemma is known; a stop word is no lemma."""
    use = F.when(lemma.isin(*STOPWORDS), word).otherwise(lemma)
    norm = F.replace(T.normalize_phrase(use, lemmatize=False, ignore_num=True), F.lit("."), F.lit(""))
    return F.concat(norm, F.lit("__"), wn)


def classless_frame(word: Column) -> Column:
    """a token without WordNet class is its own frame (letters only)."""
    norm = T.normalize_phrase(word, lemmatize=False, ignore_num=True)
    return F.when(F.length(norm) > 1, norm)


def sentence_frames(toks: Column, frame_map: Column | None = None, lemma_map: Column | None = None) -> Column:
    """sorted set of frames of a tagged sentence (F2 union F4)."""
    cands = frame_tokens(toks)
    own = F.filter(F.transform(F.filter(cands, lambda c: c["wn"] == ""), lambda c: classless_frame(c["word"])),
                   lambda x: x.isNotNull())
    keys = F.transform(F.filter(cands, lambda c: c["wn"] != ""), lambda c: frame_key(c["word"], c["wn"], lemma_map))
    found = F.transform(keys, lambda k: default_frames(k) if frame_map is None else F.try_element_at(frame_map, k))
    return F.array_sort(F.array_distinct(F.concat(own, F.flatten(F.filter(found, lambda x: x.isNotNull())))))


def frame_rules() -> Callable[[str], list[str]]:
    """``sentence_frames`` of one tagged token, by the shipped units and lemmas,
    once more as a function."""
    letters, final_s, final_ies = pattern(r"[^A-Za-z.\s]"), pattern(r"(?<=[A-Ze])s$"), pattern(r"(?<=[A-Za-z])ies$")
    blanks, last = pattern(r"\s+"), pattern(r"(?<=\s)(\w+)$")
    classes, units, stop = {"J": "a", "V": "v", "N": "n", "R": "r"}, shipped_frames(), frozenset(STOPWORDS)

    def normal(t: str) -> str:
        if t.endswith("s"):
            t = final_ies.sub("y", final_s.sub("", t))
        if t.isascii() and t.isalpha():
            return t.lower()
        t = blanks.sub(" ", letters.sub(" ", t)).strip(" ").lower()
        return t if last.search(t) else blanks.sub("", t)

    def of(item: str) -> list[str]:
        token, mark, pos = item.rpartition("__")
        word, wn = (token if mark else item).lower(), classes.get(pos[:1], "") if mark else ""
        if len(word) < 2 or word in stop:
            return []
        if not wn:
            own = normal(word)
            return [own] if len(own) > 1 else []
        lemma = LEMMAS.get((word, wn), word)
        return units.get(f"{normal(word if lemma in stop else lemma).replace('.', '')}__{wn}", [])

    return of


@F.arrow_udf(Ty.ArrayType(TEXT))
def item_frames(items: pa.Array) -> pa.Array:
    """F6 of tagged tokens (T5), by the shipped units and lemmas."""
    of = frame_rules()
    return pa.array([of(x) for x in items.to_pylist()], pa.list_(pa.string()))


def frames_by_item(df: DataFrame, tagged_col: str, frame_map: Column | None = None, keep: Keep = checkpointed) -> DataFrame:
    """F6 of tagged sentences (T5 texts) with a unique, never null ``row_id``:
    distinct (row_id, frame). A frame comes from one tagged token, so the rules
    go over the distinct ones and only those that have a frame are joined."""
    return item_rows_frames(df.select("row_id", F.explode(F.split(tagged_col, " ")).alias("item")), frame_map, keep)


def item_rows_frames(items: DataFrame, frame_map: Column | None = None, keep: Keep = checkpointed) -> DataFrame:
    """F6 of the tagged tokens (row_id, item) of sentences, once or more each."""
    frames = item_frames("item") if frame_map is None else sentence_frames(T.decode_tagged(F.col("item")), frame_map)
    of = keep(spread_items(items).select("item", F.explode(frames).alias("frame")), "item-frames")
    return items.join(of, "item").select("row_id", "frame").distinct()


def spread_items(items: DataFrame) -> DataFrame:
    """The distinct items, dealt over all tasks: the rules on an item take long."""
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return items.select("item").distinct().repartition(parts, "item")


def frame_memo(keys: DataFrame, units: DataFrame, memo: DataFrame | None = None) -> DataFrame:
    """(key, frames) for the distinct keys of ``keys`` and all of ``memo``.
    Only keys that the memo lacks are looked up; a key without a frame is
    remembered with an empty list. The result is meant to be saved and to be
    the next run's memo."""
    new = keys.select("key").where("key IS NOT NULL").distinct()
    if memo is not None:
        new = new.join(memo.select("key"), "key", "left_anti")
    found = new.join(unit_key_table(units), "key", "left").groupBy("key").agg(
        F.array_sort(F.collect_set("frame")).alias("frames"))  # the frames of one key: as many as units name it
    return found if memo is None else memo.select("key", "frames").unionByName(found)


def word_keys(df: DataFrame, toks_col: str, lemmas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """From rows (row_id, tokens): the eligible words of each row (row_id,
    word, wn), and the F4 key of every distinct word that has a
    WordNet class (word, wn, key), by a table of lemmas (form, pos, lemma) of
    any size or the shipped one. A form listed twice takes its smallest lemma."""
    # row by row and not inside an array, where Spark compiles nothing
    words = (df.select("row_id", F.explode(F.array_distinct(toks_col)).alias("t"))
             .select("row_id", F.lower("t.token").alias("word"), T.wordnet_class(F.col("t.pos")).alias("wn"))
             .where((F.length("word") >= 2) & ~F.col("word").isin(*STOPWORDS)))
    forms = words.where("wn <> ''").select("word", "wn").distinct()
    if lemmas is None:
        return words, forms.withColumn("key", frame_key(F.col("word"), F.col("wn")))
    lem = lemmas.groupBy(F.lower("form").alias("word"), F.col("pos").alias("wn")).agg(F.min("lemma").alias("lemma"))
    key = lemma_key(F.col("word"), F.col("wn"), F.coalesce("lemma", "word"))
    return words, forms.join(lem, ["word", "wn"], "left").withColumn("key", key).drop("lemma")


def frames_with_tables(df: DataFrame, toks_col: str, units: DataFrame, lemmas: DataFrame | None = None,
                       memo: DataFrame | None = None, keep: Keep = checkpointed) -> DataFrame:
    """F6 by joins, for tables of any size: distinct (row_id, frame) of rows
    with a unique, never null ``row_id``. Words join their frames in one
    equi-join, whose hot words are split by the adaptive skew join; few words
    that have a frame are sent to the rows, as ``keep`` tells their size."""
    words, forms = word_keys(df, toks_col, lemmas)
    of = keep(forms.join(frame_memo(forms, units, memo), "key")
              .select("word", "wn", F.explode("frames").alias("frame")), "word-frames")
    own = words.where("wn = ''").select("row_id", classless_frame(F.col("word")).alias("frame")).where("frame IS NOT NULL")
    return words.join(of, ["word", "wn"]).select("row_id", "frame").unionByName(own).distinct()


def tagged_frames_with_tables(df: DataFrame, tagged_col: str, units: DataFrame, lemmas: DataFrame | None = None,
                              keep: Keep = checkpointed) -> DataFrame:
    """``frames_with_tables`` of tagged sentences (T5 texts). A frame comes from
    one tagged token, so the words and their joins go over the distinct ones."""
    items = df.select("row_id", F.explode(F.array_distinct(F.split(tagged_col, " "))).alias("item"))
    toks = spread_items(items).select(F.col("item").alias("row_id"), T.decode_tagged(F.col("item")).alias("toks"))
    found = frames_with_tables(toks, "toks", units, lemmas, keep=keep)
    of = keep(found.select(F.col("row_id").alias("item"), "frame"), "item-frames")
    return items.join(of, "item").select("row_id", "frame").distinct()
