"""The shipped tagger, noun phrases and their normal form, token by token.

The rules are those of ``tagging`` (T4, E1, E3) and ``text`` (T3, T8, T9) as
Columns; here they stand once more as functions of a token or of a phrase,
which a worker computes when it first meets one and then remembers. A sentence
costs a lookup for each of its tokens. Tests hold both forms against each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from kbspark.functions.tagging import BRACKET_TAGS, ENTITY_PLACEHOLDER, MARKS, NUMBER_PATTERN, PLURAL_RULE, SUFFIX_RULES
from kbspark.functions.text import (BRACKET_TAG_PATTERN, JUNK_PATTERN, LINK_PATTERN, MAX_ENTITY_LENGTH, MAX_LEAF_LENGTH, MIN_ENTITY_LENGTH,
                                    MIN_LEAF_LENGTH, NON_ALPHA_SHARE_LIMIT, PUNCT_SPLIT_PATTERN)
from kbspark.sources.wordlists import LEMMAS, LEXICON_TAGS

#: Entries that a worker remembers of each kind; beyond, it begins anew.
REMEMBERED = 500_000
END_MARKS = ".,!?"  # of those T9 splits at
TEXT = Ty.StringType()  # as objects: a type's text is read by a session, and there may be none yet
SEGMENT = Ty.StructType([Ty.StructField("label", TEXT), Ty.StructField("start", Ty.IntegerType()), Ty.StructField("len", Ty.IntegerType())])
TAGGED = Ty.ArrayType(Ty.StructType([Ty.StructField("token", TEXT), Ty.StructField("pos", TEXT)]))


class Remembered(dict):
    """Values of a function, computed when first asked for. Keys and values of
    text, numbers and tuples of them cost the worker's garbage collector little."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[key] = self.of(key)
        return value


def pattern(text: str):
    return re.compile(text, re.ASCII)


def tag_rules():
    """T4 of (token, whether it is the first of its sentence)."""
    def ends(pattern: str) -> tuple[str, ...]:
        return tuple(pattern.strip("()$").split("|"))

    number, digit = pattern(NUMBER_PATTERN.removesuffix("$")), pattern("[0-9]")
    endings = [(ends(pattern), least, tag) for pattern, least, tag in SUFFIX_RULES]
    plural, not_plural = ends(PLURAL_RULE[0]), ends(PLURAL_RULE[1])

    def tag(key: tuple[bytes, bool]) -> str:
        tok, first = key[0].decode(), key[1]
        low = tok.lower()
        if tok.isalpha():  # most tokens: no mark to cut off, no digit
            bare = low
            if (known := LEXICON_TAGS.get(low)) is not None:
                return known
        else:
            bare = low.strip(MARKS)
            if tok in BRACKET_TAGS:
                return tok
            if (known := LEXICON_TAGS.get(low) or LEXICON_TAGS.get(bare)) is not None:
                return known
            if not bare:
                return "." if not tok.strip(".!?") else "," if tok == "," else ":" if not tok.strip(":;") else "SYM"
            if not bare.isalpha() and digit.search(bare):
                return "CD" if number.fullmatch(bare) else "NN"
        if not first and "A" <= tok[0] <= "Z":
            return "NNP"
        for last, least, found in endings:
            if len(bare) >= least and bare.endswith(last):
                return found
        if len(bare) >= PLURAL_RULE[2] and bare.endswith(plural) and not bare.endswith(not_plural):
            return PLURAL_RULE[3]
        return "NN"

    return tag


def ascii_tokens(sentence: str) -> list[bytes]:
    """T3; bytes are split at ASCII white space alone."""
    return sentence.encode("ascii", "ignore").split()


def chunk_letter(pos: str) -> str:
    """The letter of a tag in ``tagging.chunk_code``."""
    if pos.startswith("NN") or pos == "FW":
        return "N"
    if pos.startswith("VB"):
        return "V"
    return {"JJ": "J", "JJR": "K", "RB": "R", "CC": "C", "DT": "D", "CD": "#"}.get(pos, "x")


def phrase_rules():
    """The normal forms of the entities in a span of tokens."""
    link, junk, split = pattern(LINK_PATTERN), pattern(JUNK_PATTERN), pattern(PUNCT_SPLIT_PATTERN)
    letters, final_s, final_ies = pattern(r"[A-Za-z.\s]+"), pattern(r"(?<=[A-Ze])s$"), pattern(r"(?<=[A-Za-z])ies$")
    marks, blanks, last = pattern(r"[^A-Za-z0-9.\s]"), pattern(r"\s+"), pattern(r"(?<=\s)(\w+)$")
    outer = pattern(r"^\s+|\s+$")
    lemmas = {f: lemma for (f, p), lemma in LEMMAS.items() if p == "n"}

    def plain(t: str) -> str:
        """``normal`` of letters, digits and single blanks."""
        t = (final_s.sub("", t) if t.endswith("s") else t).lower()
        at = t.rfind(" ")
        right = t[at + 1:]
        lemma = lemmas.get(right, right)
        if at < 0:
            return blanks.sub("", lemma)
        return t if lemma == right else blanks.sub(" ", t.replace(right, lemma))

    def normal(t: str) -> str:
        t = final_ies.sub("y", final_s.sub("", t))
        t = blanks.sub(" ", marks.sub(" ", t)).strip(" ").lower()
        found = last.search(t)
        if not found:
            return blanks.sub("", lemmas.get(t, t))
        return blanks.sub(" ", t.replace(found[1], lemmas.get(found[1], found[1])))

    def entities(leaves: tuple[str, ...]) -> list[str]:
        # most spans have no sign that the patterns look for, or a mark at their end, which is cut off
        text = " ".join([x for x in leaves if MIN_LEAF_LENGTH <= len(x) <= MAX_LEAF_LENGTH])
        bare, last = "".join(leaves), leaves[-1]
        if last[-1] in END_MARKS:
            bare, text = bare[:-1], text[:-1] if text.endswith(last) else text
        if bare.isalnum() and "etc" not in text and "ies" not in text[-3:]:
            x = text.strip("0")
            good = MIN_ENTITY_LENGTH <= len(x) <= MAX_ENTITY_LENGTH and (
                x.replace(" ", "").isalpha() or len(letters.sub("", x)) / len(x) < NON_ALPHA_SHARE_LIMIT)
            e = plain(x.strip(" ")) if good else ""
            return [e] if e else []
        kept = [x for x in leaves if not ((":" in x or "<" in x or "{" in x) and link.search(x))]
        kept = [outer.sub("", junk.sub("", x)) if "." in x or "etc" in x else x for x in kept]
        kept = [x for x in kept if MIN_LEAF_LENGTH <= len(x) <= MAX_LEAF_LENGTH]
        # as T9 stands as a Column: a piece loses the digits of its place at its ends
        pieces = [x.strip(str(i)) for i, x in enumerate(split.split(" ".join(kept)))]
        good = [x for x in pieces if x and MIN_ENTITY_LENGTH <= len(x) <= MAX_ENTITY_LENGTH
                and len(letters.sub("", x)) / len(x) < NON_ALPHA_SHARE_LIMIT]
        return [e for e in (normal(x.strip(". ")) for x in good) if e]

    return entities


def span_rules():
    """The EN spans (E1) of a sentence given by the letters of its tags: their
    code and places."""
    both, adjectives, joined, spans = re.compile("KV|RJ"), str.maketrans("J", "a"), re.compile("(?<=a)C(?=a)"), re.compile("(a[ac]*)?N+")

    def of(letters: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        code = joined.sub("c", both.sub("aa", letters).translate(adjectives))
        return code, tuple([m.span() for m in spans.finditer(code)])

    return of


def segment_rules():
    """E2 of a sentence given by the letters of its tags: (label, start, end,
    EN spans within)."""
    spans_of, conjunction, phrase, inside = span_rules(), re.compile("(?<=[Ef])C(?=E)"), re.compile("D?C?n*E[Eef]*"), re.compile("Ef*")

    def of(letters: str) -> tuple[tuple[str, int, int, tuple[tuple[int, int], ...]], ...]:
        code, spans = spans_of(letters)
        parts, at = [], 0
        for a, b in spans:
            parts += [code[at:a].replace("c", "C"), "E" + "f" * (b - a - 1)]
            at = b
        code = conjunction.sub("e", "".join(parts) + code[at:].replace("c", "C")).replace("C#", "nn")
        out, at = [], 0
        for a, b in [*(m.span() for m in phrase.finditer(code)), (len(code), len(code))]:
            if at < a:
                out.append(("VP", at, a, tuple([m.span() for m in inside.finditer(code, at, a)])))
            if a < b:
                out.append(("NP", a, b, tuple([m.span() for m in inside.finditer(code, a, b)])))
            at = b
        return tuple(out)

    return of


def template_rules():
    """T12 of tokens and their letters."""
    segments, blanks = Remembered(segment_rules()), " \t\n\r\x0b\x0c"
    bracket, again = pattern(BRACKET_TAG_PATTERN), pattern(rf"(?<={ENTITY_PLACEHOLDER})\s+{ENTITY_PLACEHOLDER}")

    def of(tokens: list[str], letters: str) -> str | None:
        phrases = []
        for _, a, b, inside in segments[letters]:
            phrase = " ".join(tokens[a:b])
            for x, y in inside:
                phrase = phrase.replace(" ".join(tokens[x:y]), ENTITY_PLACEHOLDER)
            phrases.append(phrase)
        s = bracket.sub(" ", " ".join(phrases).strip(blanks)).strip(blanks)
        s = again.sub("", s).strip(blanks)
        return None if not s else s if s[-1] in "!;:." else s + "."

    return of


_tags: dict = {}
_entities: dict = {}


def tag_memo() -> tuple[Remembered, Remembered]:
    """(token, tag, the letter of the tag) of a token behind the first of its
    sentence, and of a first one."""
    if "rest" not in _tags:
        rule = tag_rules()

        def tagged(first: bool):
            def of(token: bytes) -> tuple[str, str, str]:
                pos = rule((token, first))
                return token.decode(), pos, chunk_letter(pos)
            return of

        _tags.update(rest=Remembered(tagged(False)), first=Remembered(tagged(True)))
    return _tags["rest"], _tags["first"]


def cut_sentences(texts: list[str | None]) -> Iterator[list[tuple[str, str, str]] | None]:
    """T3 + T4 of each sentence."""
    rest, first = tag_memo()
    for s in texts:
        cut = ascii_tokens(s) if s is not None else None
        yield [first[cut[0]], *[rest[t] for t in cut[1:]]] if cut else cut


def entity_memo() -> tuple[Remembered, Remembered, Remembered]:
    if "of" not in _entities:
        def letter(item: str) -> tuple[str, str]:
            token, _, pos = item.rpartition("__")
            return (chunk_letter(pos), token) if _ else ("x", item)

        rule = phrase_rules()
        _entities.update(letter=Remembered(letter), spans=Remembered(span_rules()), of=Remembered(lambda phrase: tuple(rule(tuple(phrase.split(" "))))))
    return _entities["letter"], _entities["spans"], _entities["of"]


@F.arrow_udf(TAGGED)
def tag_sentences(sentences: pa.Array) -> pa.Array:
    """T3 + T4."""
    tokens, tags, ends, texts = [], [], [0], sentences.to_pylist()
    for cut in cut_sentences(texts):
        tokens += [x[0] for x in cut or ()]
        tags += [x[1] for x in cut or ()]
        ends.append(len(tokens))
    items = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(tags, pa.string())], ["token", "pos"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([s is None for s in texts], pa.bool_()))


@F.arrow_udf(TEXT)
def tagged_texts(sentences: pa.Array) -> pa.Array:
    """T3 + T4 + T5."""
    return pa.array([None if cut is None else " ".join([f"{x[0]}__{x[1]}" for x in cut])
                     for cut in cut_sentences(sentences.to_pylist())], pa.string())


@F.arrow_udf(Ty.ArrayType(TEXT))
def sentence_entities(sentences: pa.Array) -> pa.Array:
    """T3 + T4 + E1 + E3."""
    _, spans, of = entity_memo()
    out = []
    for cut in cut_sentences(sentences.to_pylist()):
        out.append(None if cut is None else sorted({e for a, b in spans["".join([x[2] for x in cut])][1] for e in of[" ".join([x[0] for x in cut[a:b]])]}))
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(Ty.ArrayType(SEGMENT))
def sentence_segments(sentences: pa.Array) -> pa.Array:
    """T3 + T4 + E2."""
    segments, ends, found, texts = Remembered(segment_rules()), [0], [], sentences.to_pylist()
    for cut in cut_sentences(texts):
        found += segments["".join([x[2] for x in cut])] if cut else ()
        ends.append(len(found))
    items = pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] + 1 for x in found], pa.int32()),
                                        pa.array([x[2] - x[1] for x in found], pa.int32())], ["label", "start", "len"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([s is None for s in texts], pa.bool_()))


@F.arrow_udf(TEXT)
def sentence_templates(sentences: pa.Array) -> pa.Array:
    """T3 + T4 + T12."""
    template = template_rules()
    return pa.array([None if cut is None else template([x[0] for x in cut], "".join([x[2] for x in cut]))
                     for cut in cut_sentences(sentences.to_pylist())], pa.string())


@F.arrow_udf(Ty.ArrayType(TEXT))
def tagged_entities(tagged: pa.Array) -> pa.Array:
    """T6 + E1 + E3 of sentences as T5 writes them."""
    letter, spans, of = entity_memo()
    out = []
    for s in tagged.to_pylist():
        if s is None:
            out.append(None)
            continue
        items = [letter[x] for x in s.split(" ") if x]
        out.append(sorted({e for a, b in spans["".join([x[0] for x in items])][1] for e in of[" ".join([x[1] for x in items[a:b]])]}))
    return pa.array(out, pa.list_(pa.string()))


@F.arrow_udf(TAGGED)
def decoded(tagged: pa.Array) -> pa.Array:
    """T6."""
    def cut(item: str) -> tuple[str, str | None]:
        token, mark, pos = item.rpartition("__")
        return (token, pos) if mark else (item, None)

    cuts, found, ends, texts = Remembered(cut), [], [0], tagged.to_pylist()
    for s in texts:
        found += [cuts[x] for x in (s or "").split(" ") if x]
        ends.append(len(found))
    items = pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["token", "pos"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, mask=pa.array([s is None for s in texts], pa.bool_()))
