"""Token ids of whole texts by public tokenizers.

A text is cut into chunks where neither of the two tokenizer kinds can join
what stands on both sides: before a blank, tab or line end that follows another
character than white space, and between a Latin letter and a full stop or comma. The byte-level pattern
starts a new word there, and no piece of the sentence-piece vocabulary spans
such a place (checked when it is loaded). So the ids of a text are those of
its chunks in order, and every distinct chunk is encoded once while it is
remembered; nothing is cut from any text.

``RANK_FILE`` names a tiktoken file of the same vocabulary. Texts of Latin
characters are encoded whole by its ranks: each merge of the tokenizer is the
one that merging its bytes by ranks ends with (a test goes through them all),
so both give the same ids, three times as fast. The character classes of the
two libraries could differ elsewhere, and special tokens exist in the tokenizer
alone, so of all other texts the chunks that hold such go to the tokenizer.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import tiktoken
from pyspark import Broadcast
from tokenizers import Tokenizer

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"

#: White space at a text's end belongs to its last chunk.
CHUNK = re.compile(rf"\s*(?:[{LETTERS}]+(?=[., \n\t])|\S+(?:[^\S \n\t]\s*\S+)*)(?:\s+\Z)?")

LATIN = re.compile(r"[\x00-ɏ]*")
SPECIAL = "<|"  # begins every special token

#: So many chunks are remembered, the lately used ones first.
REMEMBERED = 500_000

AT_ONCE = 20_000


def chunks(text: str) -> list[str]:
    return CHUNK.findall(text) or [text] * bool(text)


class Memo:
    """Values of chunks: when the young half is full, it becomes the old one
    and what is used again moves over."""

    def __init__(self, most: int = REMEMBERED):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def missing(self, need: set[str]) -> list[str]:
        """What has to be put in; everything else of ``need`` is young now."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        new = need.difference(self.young)
        for c in new.intersection(self.old):
            self.young[c] = self.old[c]
        return list(new.difference(self.young))


def one_of_worker(kept: Broadcast, make: Callable[[], object]):
    """What ``make`` gives, made once in a worker: ``kept`` is a broadcast
    empty dictionary, which the tasks of a worker share."""
    if not kept.value:
        kept.value["it"] = make()
    return kept.value["it"]


def single_threaded() -> None:
    """A task has one core; the tokenizers library would use all."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def rank_encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class IdBytes:
    """Ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str = BYTE_BPE, rank_file: str | None = RANK_FILE, memo: Memo | None = None):
        single_threaded()
        self.tokenizer = Tokenizer.from_file(path)
        self.ranks = rank_encoding(rank_file) if rank_file else None
        self.memo = memo or Memo()

    def ids(self, new: list[str]) -> list[list[int]]:
        latin = [self.plain(c) for c in new]
        rest = self.tokenizer.encode_batch_fast([c for c, x in zip(new, latin) if not x], add_special_tokens=False)
        rest = iter(rest)
        return [self.ranks.encode_ordinary(c) if x else next(rest).ids for c, x in zip(new, latin)]

    def plain(self, text: str) -> bool:
        return self.ranks is not None and SPECIAL not in text and LATIN.fullmatch(text) is not None

    def __call__(self, texts: list[str]) -> list[bytes]:
        rest = iter(self.by_chunks([t for t in texts if not self.plain(t)]))
        return [self.ranks.encode_to_numpy(t).astype("<u4").tobytes() if self.plain(t) else next(rest) for t in texts]

    def by_chunks(self, texts: list[str]) -> list[bytes]:
        cut = [chunks(t) for t in texts]
        new = self.memo.missing(set().union(*cut))
        known = self.memo.young
        for k in range(0, len(new), AT_ONCE):
            part = new[k:k + AT_ONCE]
            ids = self.ids(part)
            raw = np.array([i for x in ids for i in x], "<u4").tobytes()
            at = 0
            for chunk, x in zip(part, ids):
                known[chunk] = raw[at:at + 4 * len(x)]
                at += 4 * len(x)
        return [b"".join(map(known.__getitem__, c)) for c in cut]
