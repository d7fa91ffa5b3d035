"""Tags, entities and the tokens with frames of a sentence, in one pass.

The rules are those of ``words`` and ``frames``; a worker computes them when it
first meets a token or a phrase and then remembers.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from kbspark.functions.frames import frame_rules
from kbspark.functions.words import TEXT, Remembered, ascii_tokens, entity_memo, tag_memo

LIST = Ty.ArrayType(TEXT)
ANALYSED = Ty.StructType([Ty.StructField("sentence", TEXT), Ty.StructField("entities", LIST), Ty.StructField("items", LIST)])
_analysed: dict = {}


def _analysis_memo() -> tuple[Remembered, Remembered]:
    """(token, letter of its tag, ``token__TAG``, whether that has a frame) of a
    token behind the first of its sentence, and of a first one."""
    if "rest" not in _analysed:
        frames = frame_rules()

        def of(tags: Remembered):
            def analysed(token: bytes) -> tuple[str, str, str, bool]:
                text, pos, letter = tags.of(token)
                item = f"{text}__{pos}"
                return text, letter, item, bool(frames(item))
            return analysed

        rest, first = tag_memo()
        _analysed.update(rest=Remembered(of(rest)), first=Remembered(of(first)))
    return _analysed["rest"], _analysed["first"]


@F.arrow_udf(ANALYSED)
def analysed_texts(sentences: pa.Array) -> pa.Array:
    """T3 + T4 + T5 and E1 + E3 of sentences that are not null, and their
    distinct tagged tokens that have a frame (F1-F4)."""
    rest, first = _analysis_memo()
    _, spans, of = entity_memo()
    tagged, entities, items, entity_ends, item_ends = [], [], [], [0], [0]
    for s in sentences.to_pylist():
        tokens = ascii_tokens(s)
        cut = [first[tokens[0]], *[rest[t] for t in tokens[1:]]] if tokens else []
        tagged.append(" ".join([x[2] for x in cut]))
        entities += sorted({e for a, b in spans["".join([x[1] for x in cut])][1] for e in of[" ".join([x[0] for x in cut[a:b]])]})
        items += {x[2] for x in cut if x[3]}
        entity_ends.append(len(entities))
        item_ends.append(len(items))

    def lists(ends: list[int], values: list[str]) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.string()))

    return pa.StructArray.from_arrays([pa.array(tagged, pa.string()), lists(entity_ends, entities), lists(item_ends, items)],
                                      ["sentence", "entities", "items"])
