"""Part-of-speech tagging (T4) and noun-phrase chunking (E1-E3) as Columns.

The tagger maps a token to a Treebank tag through a lexicon, then through
shape and suffix rules. The shipped default lexicon is a map literal of a
fixed few hundred forms; a user's lexicon is a table of any size, joined to
the distinct forms by ``tag_with_table``.

Chunking follows the staged grammar
  CA = JJR VB* | RB? JJ ;  AJ = CA (CC? CA)* ;  EN = AJ? (NN*|FW)+
by mapping each token to one letter and running three same-length
rewrites plus one span regex on that code string.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.session import Keep, checkpointed
from kbspark.sources.wordlists import LEMMAS, LEXICON_TAGS

BRACKET_TAGS = ["-LRB-", "-RRB-", "-LSB-", "-RSB-", "-LCB-", "-RCB-"]
# ---------------------------------------------------------------------------
# FIXED VALUES: shape / suffix rules of the default tagger, in order.
# (pattern on the lower-cased bare token, minimum length, tag)
# ---------------------------------------------------------------------------
SUFFIX_RULES = [
    ("ing$", 5, "VBG"),
    ("ed$", 4, "VBN"),
    ("ly$", 4, "RB"),
    ("est$", 5, "JJS"),
    ("(ous|ful|ive|able|ible|ical|less|ish)$", 5, "JJ"),
]
PLURAL_RULE = ("s$", "(ss|us|is)$", 4, "NNS")
NUMBER_PATTERN = "^[0-9][0-9.,:/-]*$"


def _map_literal(d: dict[str, str]) -> Column:
    items = sorted(d.items())
    return F.map_from_arrays(F.array(*[F.lit(k) for k, _ in items]), F.array(*[F.lit(v) for _, v in items]))


def _looked_up(d: dict[str, str], key: Column) -> Column:
    """A shipped value, or NULL. Most keys have none, which a hash set tells;
    only the others are looked up in the map literal."""
    return F.when(key.isin(*sorted(d)), F.try_element_at(_map_literal(d), key))


def default_tag(form: Column) -> Column:
    return _looked_up(LEXICON_TAGS, form)


def default_noun_lemma_map() -> Column:
    return _map_literal({f: l for (f, p), l in LEMMAS.items() if p == "n"})


def default_lemma(form: Column) -> Column:
    """Lemma of (form '__' class) for every WordNet class."""
    return _looked_up({f"{f}__{p}": l for (f, p), l in LEMMAS.items()}, form)


#: Of the characters that tokens consist of (T3), those that are no letter or digit.
MARKS = "".join(c for c in map(chr, range(128)) if not c.isalnum())


def bare_key(tok: Column) -> Column:
    return F.lower(F.btrim(tok, F.lit(MARKS)))


def rule_tag(tok: Column, idx: Column, key: Column | None = None) -> Column:
    """Tag of a token that is no bracket tag and not in the lexicon; ``key`` is
    its bare form."""
    key = bare_key(tok) if key is None else key
    e = (F.when(key == "", F.when(tok.rlike(r"^[.!?]+$"), ".").when(tok == ",", ",")
               .when(tok.rlike(r"^[:;]+$"), ":").otherwise("SYM"))
         .when(key.rlike("[0-9]"), F.when(key.rlike(NUMBER_PATTERN), "CD").otherwise("NN"))
         .when((idx > 0) & F.substring(tok, 1, 1).between("A", "Z"), "NNP"))
    for pat, min_len, tag in SUFFIX_RULES:
        e = e.when((F.length(key) >= min_len) & _ends(key, pat), tag)
    pat, not_pat, min_len, tag = PLURAL_RULE
    e = e.when((F.length(key) >= min_len) & _ends(key, pat) & ~_ends(key, not_pat), tag)
    return e.otherwise("NN")


def _ends(key: Column, pattern: str) -> Column:
    """A pattern of endings, ``x$`` or ``(x|y)$``, without a regex."""
    found = [key.endswith(x) for x in pattern.strip("()$").split("|")]
    return reduce(Column.__or__, found)


def tag_tokens(toks: Column, tag_map: Column | None = None) -> Column:
    """T4: array<string> tokens -> array<struct<token, pos>>."""
    def lexicon(form: Column) -> Column:
        return default_tag(form) if tag_map is None else F.try_element_at(tag_map, form)

    def one(x: Column, idx: Column) -> Column:
        tok, key = x["tok"], x["key"]
        tag = F.when(tok.isin(*BRACKET_TAGS), tok).otherwise(
            F.coalesce(lexicon(F.lower(tok)), lexicon(key), rule_tag(tok, idx, key)))
        return F.struct(tok.alias("token"), tag.alias("pos"))

    return F.transform(F.transform(toks, lambda t: F.struct(t.alias("tok"), bare_key(t).alias("key"))), one)


def tag_sentence(sentence: Column, tag_map: Column | None = None) -> Column:
    """T3 + T4."""
    return tag_tokens(T.tokens(sentence), tag_map)


def tag_with_table(df: DataFrame, toks_col: str, lexicon: DataFrame, out_col: str = "toks", keep: Keep = checkpointed) -> DataFrame:
    """T4 with a lexicon table (form, tag) of any size: the distinct forms of
    the input are joined to it once, tokens get their tag from the forms found.
    A form listed twice takes its smallest tag. ``df`` needs a unique, never
    null ``row_id``; rows keep their columns. They are dealt by it first, so that
    with few forms, which ``keep`` tells the size of, no token moves alone."""
    df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row_id")
    lex = lexicon.groupBy(F.lower("form").alias("form")).agg(F.min("tag").alias("tag"))
    each = df.select("row_id", F.posexplode(toks_col).alias("i", "tok"))
    keyed = each.withColumn("low", F.lower("tok")).withColumn("bare", bare_key(F.col("tok")))
    forms = keep(keyed.select(F.explode(F.array("low", "bare")).alias("form")).distinct().join(lex, "form"), "forms")
    got = (keyed.join(forms.select(F.col("form").alias("low"), F.col("tag").alias("t1")), "low", "left")
           .join(forms.select(F.col("form").alias("bare"), F.col("tag").alias("t2")), "bare", "left"))
    tag = F.when(F.col("tok").isin(*BRACKET_TAGS), F.col("tok")).otherwise(
        F.coalesce("t1", "t2", rule_tag(F.col("tok"), F.col("i"))))
    tagged = got.groupBy("row_id").agg(F.array_sort(F.collect_list(
        F.struct("i", F.col("tok").alias("token"), tag.alias("pos")))).alias("_t"))
    pairs = F.transform("_t", lambda x: F.struct(x["token"].alias("token"), x["pos"].alias("pos")))
    none = F.array().cast("array<struct<token:string,pos:string>>")
    return (df.join(tagged, "row_id", "left").withColumn(out_col, F.coalesce(pairs, none)).drop("_t"))


# ------------------------------------------------------------------ chunking
def chunk_code(toks: Column) -> Column:
    """One letter per token: N noun/FW, J JJ, K JJR, R RB, C CC, V VB*, D DT,
    # CD, x other."""
    def code(t: Column) -> Column:
        p = t["pos"]
        return (F.when(p.startswith("NN") | (p == "FW"), "N").when(p == "JJ", "J").when(p == "JJR", "K")
                .when(p == "RB", "R").when(p == "CC", "C").when(p.startswith("VB"), "V")
                .when(p == "DT", "D").when(p == "CD", "#").otherwise("x"))
    return F.array_join(F.transform(toks, code), "")


def entity_code(toks: Column) -> Column:
    """Code string after the CA and AJ stages: 'a' adjective part, 'c' a
    conjunction inside an adjective group, 'N' noun."""
    c = F.regexp_replace(chunk_code(toks), "KV|RJ", "aa")
    c = F.translate(c, "J", "a")
    return F.regexp_replace(c, "(?<=a)C(?=a)", "c")


def entity_spans(toks: Column) -> Column:
    """EN spans as array<struct<start:int (1-based), len:int>>."""
    pieces = F.split(F.regexp_replace(entity_code(toks), "(a[ac]*)?N+", "|$0|"), r"\|", -1)
    init = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("idx"),
                    F.array().cast("array<struct<start:int,len:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["pos"] + 1).cast("int").alias("start"), F.length(p).cast("int").alias("len"))
        return F.struct((acc["pos"] + F.length(p)).alias("pos"), (acc["idx"] + 1).alias("idx"),
                        F.when(acc["idx"] % 2 == 1, F.array_append(acc["out"], span)).otherwise(acc["out"])
                        .alias("out"))

    return F.aggregate(pieces, init, step, lambda acc: acc["out"])


def entity_leaves(toks: Column) -> Column:
    """Token lists of the EN spans, in sentence order."""
    return F.transform(entity_spans(toks),
                       lambda sp: F.transform(F.slice(toks, sp["start"], sp["len"]), lambda t: t["token"]))


def sentence_entities(toks: Column, noun_lemmas: Column | None = None) -> Column:
    """Set of normalised entities of a tagged sentence (sorted, distinct)."""
    lm = noun_lemmas if noun_lemmas is not None else default_noun_lemma_map()
    phrases = T.let(toks, lambda tk: F.flatten(F.transform(entity_leaves(tk), T.valid_entities)))
    found = F.transform(phrases, lambda e: T.normalize_phrase(e, lm))
    return F.array_sort(F.array_distinct(F.filter(found, lambda e: e != "")))


def entities_with_table(df: DataFrame, toks_col: str, lemmas: DataFrame) -> DataFrame:
    """E3 with a lemma table (form, pos, lemma) of any size: distinct (row_id,
    entity). The distinct phrases of the input are normalised once, with one
    join to the noun lemmas. A form listed twice takes its smallest lemma."""
    nouns = (lemmas.where("pos = 'n'").groupBy(F.lower("form").alias("form")).agg(F.min("lemma").alias("lemma")))
    found = df.select("row_id", F.explode(F.flatten(F.transform(entity_leaves(F.col(toks_col)), T.valid_entities))).alias("phrase"))
    forms = (found.select("phrase").distinct().withColumn("t", T.phrase_form(F.col("phrase")))
             .withColumn("right", T.rightmost(F.col("t")))
             .withColumn("form", F.when(F.col("right") == "", F.col("t")).otherwise(F.col("right"))).join(nouns, "form", "left"))
    lemma = F.coalesce("lemma", "form")  # of whichever of the two is used
    entity = T.lemmatised(F.col("t"), F.col("right"), lemma, lemma)
    of = forms.select("phrase", entity.alias("entity")).where("entity <> ''")
    return found.join(of, "phrase").select("row_id", "entity").distinct()


def _matches(code: Column, pattern: str, offset: Column | None = None) -> Column:
    """Pieces of a code string as array<struct<hit, start (1-based), len>>: the
    pattern's matches and what lies between, in order."""
    pieces = F.split(F.regexp_replace(code, pattern, "|$0|"), r"\|", -1)
    first = F.lit(1) if offset is None else offset
    init = F.struct(first.cast("int").alias("pos"), F.lit(0).alias("idx"),
                    F.array().cast("array<struct<hit:boolean,start:int,len:int>>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        piece = F.struct((acc["idx"] % 2 == 1).alias("hit"), acc["pos"].alias("start"), F.length(p).alias("len"))
        return F.struct((acc["pos"] + F.length(p)).cast("int").alias("pos"), (acc["idx"] + 1).alias("idx"),
                        F.when(F.length(p) > 0, F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, init, step, lambda acc: acc["out"])


def phrase_code(toks: Column) -> Column:
    """One letter per token for the NP stage: 'E' begins an EN span and 'f'
    goes on with it, 'e' is a conjunction between two spans, 'nn' a pair of
    conjunction and number, D / C / # determiner, conjunction and number."""
    pieces = F.split(F.regexp_replace(entity_code(toks), "(a[ac]*)?N+", "|$0|"), r"\|", -1)
    spans = F.array_join(F.transform(pieces, lambda p, i: F.when(
        i % 2 == 1, F.concat(F.lit("E"), F.repeat(F.lit("f"), F.length(p) - 1))).otherwise(F.translate(p, "c", "C"))), "")
    joined = F.regexp_replace(spans, "(?<=[Ef])C(?=E)", "e")
    return F.regexp_replace(joined, "C#", "nn")


def _segments(toks: Column) -> Column:
    """E2 with each segment's code: array<struct<label, start, len, code>>."""
    return T.let(phrase_code(toks), lambda code: F.transform(
        _matches(code, "D?C?n*E[Eef]*"), lambda m: F.struct(
            F.when(m["hit"], "NP").otherwise("VP").alias("label"), m["start"].alias("start"), m["len"].alias("len"),
            F.substring(code, m["start"], m["len"]).alias("code"))))


def np_vp_segments(toks: Column) -> Column:
    """Top-level NP / VP segmentation as array<struct<label, start, len>>.

    NP = DT? CC? (CC CD)* EN (CC? EN)*, everything between NPs is VP. The
    repeated groups of the rule become single-letter loops by same-length
    rewrites of the code string (Java's regex engine recurses on groups).
    """
    return F.transform(_segments(toks), lambda s: F.struct(
        s["label"].alias("label"), s["start"].alias("start"), s["len"].alias("len")))


def question_score(toks: Column, text: Column) -> Column:
    """T15 on a flat tree (root S, then one node per tag, breadth first):
    mean over nodes of (wh + md + qmark) / 3 with sticky flags wh (a tag
    starting with W seen), md (a tag starting with M seen), qmark ('?' in
    the text). Closed form: ((n+1)*q + W + M) / (3*(n+1)), where W (M) is
    the number of nodes at or after the first W (M) tag."""
    n = F.size(toks)
    tags = F.transform(toks, lambda t: t["pos"])

    def from_first(prefix: str) -> Column:
        pos = F.array_position(F.transform(tags, lambda p: p.startswith(prefix)), True)
        return F.when(pos > 0, n - pos + 1).otherwise(F.lit(0))

    q = F.when(text.contains("?"), F.lit(1)).otherwise(F.lit(0))
    return ((n + 1) * q + from_first("W") + from_first("M")).cast("double") / (F.lit(3.0) * (n + 1))


# ---------------------------------------------------------------------------
# FIXED VALUE: entity placeholder of T12.
# ---------------------------------------------------------------------------
ENTITY_PLACEHOLDER = "ENTITY"


def sentence_template(toks: Column) -> Column:
    """Sentence with every entity replaced by ``ENTITY``.

    Per top-level NP / VP segment (E2) the phrase text has the text of each
    EN span inside it replaced (all occurrences, in span order); phrases are
    joined by blanks, bracket tags removed, runs of ``ENTITY`` merged, and a
    period added unless the text ends in ! ; : or . (NULL for no tokens).
    """
    def joined(tk: Column) -> Column:
        def words(start: Column, length: Column) -> Column:
            return F.array_join(F.transform(F.slice(tk, start, length), lambda t: t["token"]), " ")

        def phrase(seg: Column) -> Column:
            inside = F.filter(_matches(seg["code"], "Ef*", seg["start"]), lambda m: m["hit"])
            return F.aggregate(F.transform(inside, lambda sp: words(sp["start"], sp["len"])),
                               words(seg["start"], seg["len"]),
                               lambda acc, e: F.replace(acc, e, F.lit(ENTITY_PLACEHOLDER)))

        return F.array_join(F.transform(_segments(tk), phrase), " ")

    s = T.py_strip(T.let(toks, joined))
    s = T.py_strip(F.regexp_replace(s, T.BRACKET_TAG_PATTERN, " "))
    # a placeholder right behind another goes; no repeated group is needed
    s = T.py_strip(F.regexp_replace(s, rf"(?<={ENTITY_PLACEHOLDER})\s+{ENTITY_PLACEHOLDER}", ""))
    return T.let(s, lambda v: F.when(v == "", F.lit(None).cast("string")).when(v.rlike(r"[!;:.]$"), v).otherwise(
        F.concat(v, F.lit("."))))
