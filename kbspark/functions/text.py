"""Text rules as Spark Column expressions.

Every function here takes and returns ``Column`` objects, so the rules run
inside the JVM (whole-stage codegen where Spark allows, higher-order
functions otherwise) and can be used in batch and streaming plans alike.

Regex rule for everything in this module: no repeated *group* is applied to
unbounded text (Java's regex engine recurses on those); only single-class
loops such as ``[ac]*`` or ``.+?`` are used on whole lines.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kbspark.sources.wordlists import STOPWORDS

# ---------------------------------------------------------------------------
# FIXED VALUES: limits and patterns that decide results.
# ---------------------------------------------------------------------------
MIN_SENT_LENGTH = 4
MIN_LEAF_LENGTH = 2
MAX_LEAF_LENGTH = 25
MIN_ENTITY_LENGTH = 2
MAX_ENTITY_LENGTH = 100
NON_ALPHA_SHARE_LIMIT = 0.5
SENTENCE_PATTERN = r".+?(?<=[A-Za-z])[!.?;:]\s*(?=[A-Z]|$)|.+?$"
SANITIZE_SPACE_PATTERN = r"""\s+(?=[.,:)\]!'";])|(?<=[(\["'\\/])\s+"""
LINK_PATTERN = r"(http(s)?://)|(<.+?>/)|(:\d{2,})|(^[<{])"
JUNK_PATTERN = r"[ie][\s.]+[eg](?:[\s.]+|$)|etc(?:[\s.]+|$)"
PUNCT_SPLIT_PATTERN = r"\s+[.,()!?\\:]\s*|\s*[.,()!?\\:](?:\s+|\s*$)"
LINE_BREAK_PATTERN = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
HEADING_PATTERN = r"(#+)\s(.*)"
MD_LINK_PATTERN = r"\[(.+?)\]\([h/#].+?\)"
MD_MARK_PATTERN = r"\*{2,}|\+\s|`<|`>"
QUESTION_TRIM = "?.,:\n"
BRACKET_TAG_PATTERN = r"\s*-[LR][CSR]B-\s*"
PRODUCT_PATTERN = r"/display/(.+?)(?=/|$)"


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once and pass it to ``fn`` as a lambda variable.

    Spark re-evaluates an expression each time a higher-order-function
    lambda references it; binding it first keeps nested loops linear."""
    return F.try_element_at(F.transform(F.array(value), fn), F.lit(1))


def strip_line(c: Column) -> Column:
    """``py_strip`` of a text without the line ends that are beyond ASCII."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def py_strip(c: Column) -> Column:
    """Strip leading/trailing whitespace (all ``\\s``, not just blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# --------------------------------------------------------------------- C rules
def canonical_url(url: Column) -> Column:
    """URL cut at the first '?', fragment kept."""
    return F.substring_index(url, "?", 1)


def sanitize(text: Column) -> Column:
    """Blanks before closing / after opening marks removed, runs of
    blanks squeezed, trimmed; text in angle brackets wrapped in backticks."""
    return _sanitized(text, py_strip)


def _sanitized(text: Column, strip: Callable[[Column], Column]) -> Column:
    t = F.regexp_replace(text, SANITIZE_SPACE_PATTERN, "")
    t = strip(F.regexp_replace(t, r"\s{2,}", " "))
    return let(t, lambda x: F.when(x.startswith("<") & x.endswith(">"), F.concat(F.lit("`"), x, F.lit("`"))).otherwise(x))


def split_lines(text: Column) -> Column:
    """Line split with the same line-break set as Python's ``splitlines``."""
    return F.split(text, LINE_BREAK_PATTERN)


def clean_lines(content: Column) -> Column:
    """Split into lines, sanitise each, drop empty lines."""
    return F.filter(F.transform(split_lines(content), lambda line: _sanitized(line, strip_line)), lambda x: x != "")


def product_key(url: Column, prefix: str = "/display/") -> Column:
    """Product part of a documentation URL; no match gives NULL."""
    pattern = PRODUCT_PATTERN.replace("/display/", prefix)
    p = F.regexp_extract(url, pattern, 1)
    return F.when(p == "", F.lit(None).cast("string")).otherwise(p)


# --------------------------------------------------------------------- M rules
def heading_level(line: Column) -> Column:
    """M1: number of '#' of the first heading mark in the line, 0 if none."""
    return F.length(F.regexp_extract(line, HEADING_PATTERN, 1))


def heading_text(line: Column) -> Column:
    return F.regexp_extract(line, HEADING_PATTERN, 2)


def strip_markdown(text: Column) -> Column:
    """M2: links to their text, emphasis / list / code marks to blanks,
    squeeze blanks, trim."""
    def unmarked(t: Column) -> Column:
        # what the patterns look for is tested first: most lines have none of it
        t = F.when(t.contains("]("), F.regexp_replace(t, MD_LINK_PATTERN, "$1")).otherwise(t)
        return let(t, lambda x: F.when(x.contains("**") | x.contains("+") | x.contains("`"), F.regexp_replace(x, MD_MARK_PATTERN, " ")).otherwise(x))

    return py_strip(F.regexp_replace(let(text, unmarked), r"\s{2,}", " "))


# --------------------------------------------------------------------- T rules
def sentences(text: Column) -> Column:
    """Split text into sentences, trimmed, shorter than 4 chars dropped."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), 0)  # no dot matches a line end, so none beyond ASCII is found
    return F.filter(F.transform(found, strip_line), lambda s: F.length(s) >= MIN_SENT_LENGTH)


def line_sentences(text: Column) -> Column:
    """T1 line by line: a sentence does not cross a line break, and a line
    without an end mark is a sentence of its own."""
    return F.flatten(F.transform(split_lines(text), sentences))


def question_trim(q: Column) -> Column:
    """Strip '? . , : newline' at both ends."""
    return F.btrim(q, F.lit(QUESTION_TRIM))


def tokens(sentence: Column) -> Column:
    """ASCII-only, strip, split on blanks (punctuation stays glued)."""
    ascii_only = F.regexp_replace(sentence, r"[^\x00-\x7F]", "")
    return F.filter(F.split(py_strip(ascii_only), r"\s+"), lambda t: t != "")


def token_text(sentence: Column) -> Column:
    """The tokens of T3 joined by blanks."""
    ascii_only = F.when(F.octet_length(sentence) == F.length(sentence), sentence).otherwise(F.regexp_replace(sentence, r"[^\x00-\x7F]", ""))
    return F.regexp_replace(strip_line(ascii_only), r"\s+", " ")


def encode_tagged(toks: Column) -> Column:
    """T5: ``token__TAG`` joined by blanks."""
    return F.array_join(F.transform(toks, lambda t: F.concat(t["token"], F.lit("__"), t["pos"])), " ")


def decode_tagged(text: Column) -> Column:
    """Split on blanks, then each item at its *last* ``__``."""
    parts = F.filter(F.split(text, " "), lambda x: x != "")
    return F.transform(parts, lambda x: F.when(
        x.contains("__"),
        F.struct(F.substring(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, "__", -1)) - 2).alias("token"),
                 F.substring_index(x, "__", -1).alias("pos")),
    ).otherwise(F.struct(x.alias("token"), F.lit(None).cast("string").alias("pos"))))


def wordnet_class(tag: Column) -> Column:
    """Treebank tag -> WordNet class by first letter."""
    first = F.substring(tag, 1, 1)
    return (F.when(first == "J", "a").when(first == "V", "v").when(first == "N", "n")
            .when(first == "R", "r").otherwise(""))


def _lemma_of(word: Column, lemma_map: Column | None) -> Column:
    if lemma_map is None:
        return word
    return F.coalesce(F.try_element_at(lemma_map, word), word)


def normalize_phrase(text: Column, lemma_map: Column | None = None, lemmatize: bool = True,
                     ignore_num: bool = False) -> Column:
    """Drop a final 's' after an upper-case letter or 'e'; other marks to
    blanks; squeeze, trim, lower; lemmatise the rightmost word everywhere it
    occurs, or the whole text (losing its blanks) when there is no rightmost
    word preceded by a blank.

    ``lemma_map`` maps a noun form to its lemma (a map Column); forms not in
    it are their own lemma.
    """
    lm = lemma_map if lemmatize else None
    return let(phrase_form(text, ignore_num), lambda t: let(rightmost(t), lambda right: lemmatised(
        t, right, _lemma_of(t, lm), None if lm is None else _lemma_of(right, lm))))


def phrase_form(text: Column, ignore_num: bool = False) -> Column:
    """T8 before lemmas."""
    def cut(t: Column) -> Column:
        # what the patterns look for is tested first: most phrases have none of it
        t = F.when(t.endswith("s"), F.regexp_replace(t, r"(?<=[A-Ze])s$", "")).otherwise(t)
        # the "ies" -> "y" rule never fires after the rule above; kept for fidelity
        return F.when(t.endswith("ies"), F.regexp_replace(t, r"(?<=[A-Za-z])ies$", "y")).otherwise(t)

    t = F.regexp_replace(let(text, cut), r"[^A-Za-z.\s]" if ignore_num else r"[^A-Za-z0-9.\s]", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))


def rightmost(t: Column) -> Column:
    """The rightmost word behind a blank, or an empty text."""
    return F.regexp_extract(t, r"(?<=\s)(\w+)$", 1)


def lemmatised(t: Column, right: Column, whole_lemma: Column, right_lemma: Column | None) -> Column:
    """T8 once the lemmas of the whole text and of its rightmost word are known
    (None: the word stays)."""
    whole = F.regexp_replace(whole_lemma, r"\s+", "")
    replaced = t if right_lemma is None else F.regexp_replace(F.replace(t, right, right_lemma), r"\s+", " ")
    return F.when(right == "", whole).otherwise(replaced)


def valid_entities(leaves: Column) -> Column:
    """Phrase candidates from the tokens of one entity span. A token has no
    white space, and most have no sign that the patterns look for, which is
    tested first."""
    def holds(x: Column, *parts: str) -> Column:
        return reduce(Column.__or__, [x.contains(p) for p in parts])

    kept = F.filter(leaves, lambda x: ~(holds(x, ":", "<", "{") & x.rlike(LINK_PATTERN)))
    cleaned = F.transform(kept, lambda x: F.when(holds(x, ".", "etc"), py_strip(F.regexp_replace(x, JUNK_PATTERN, ""))).otherwise(x))
    cleaned = F.filter(cleaned, lambda y: (F.length(y) >= MIN_LEAF_LENGTH) & (F.length(y) <= MAX_LEAF_LENGTH))
    pieces = F.transform(F.split(F.array_join(cleaned, " "), PUNCT_SPLIT_PATTERN), F.trim)
    good = F.filter(pieces, lambda x: (x != "") & (F.length(x) >= MIN_ENTITY_LENGTH)
                    & (F.length(x) <= MAX_ENTITY_LENGTH)
                    & (F.length(F.regexp_replace(x, r"[A-Za-z.\s]+", "")) / F.length(x) < NON_ALPHA_SHARE_LIMIT))
    return F.transform(good, lambda x: F.btrim(x, F.lit(". ")))


def ngrams_with_size(phrase: Column) -> Column:
    """N-grams of sizes t-1 down to 1 as ``struct(gram, n)``; one-word
    phrases give none."""
    def body(words: Column) -> Column:
        t = F.size(words)
        return F.when(t <= 1, F.array().cast("array<struct<gram:string,n:int>>")).otherwise(
            F.flatten(F.transform(
                F.sequence(t - 1, F.lit(1), F.lit(-1)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), t - n + 1),
                    lambda i: F.struct(F.array_join(F.slice(words, i, n), " ").alias("gram"),
                                       n.cast("int").alias("n"))))))
    return let(F.filter(F.split(py_strip(phrase), r"\s+"), lambda w: w != ""), body)


def rebuild_sentence(toks: Column) -> Column:
    """Tokens joined with bracket tags turned back into brackets and a
    final period unless the text ends in ! ; : or ."""
    s = py_strip(F.array_join(F.transform(toks, lambda t: t["token"]), " "))
    r = s
    for tag, rep in (("LCB", " {"), ("RCB", "} "), ("LSB", " ["), ("RSB", "] "), ("LRB", " ("), ("RRB", ") ")):
        r = py_strip(F.regexp_replace(r, r"\s*-" + tag + r"-\s*", rep))
    s = F.when(s.rlike(BRACKET_TAG_PATTERN), r).otherwise(s)
    return F.when(s.rlike(r"[!;:.]$"), s).otherwise(F.concat(s, F.lit(".")))


def important_tokens(text: Column) -> Column:
    """Split, drop stop words (case-sensitive), distinct, sort, join."""
    words = F.filter(F.split(text, r"\s+"), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    return F.array_join(F.array_sort(F.array_distinct(words)), " ")


def alnum_length(text: Column) -> Column:
    """Number of ASCII letters and digits."""
    return F.length(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))


def fuzzy_process(text: Column) -> Column:
    """Full processing before fuzzy ratios: ASCII only, non-word chars to
    blanks, lower-case, trimmed."""
    t = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    return py_strip(F.lower(F.regexp_replace(t, r"[^A-Za-z0-9_]", " ")))
