"""Byte-level BPE encoding and decoding by a tokenization automaton.

encode_texts: null is the empty text; an empty text has no ids and decodes to the empty text; special-token strings
inside a text become their ids, as the library does. Rows are independent, so ties, repeats and hot keys need no
care; memory follows SLICE texts. Only the id and the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from itertools import chain

import regex
from pyspark.sql import DataFrame

from .automaton import MergeAutomaton
from .common import Memo, over_texts

#: The library's pattern for byte-level splitting (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: For texts of ASCII alone the same pattern reads so.
SPLIT_ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        spelled = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if all(c in letters for c in t)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        size = max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1
        self.automaton = MergeAutomaton(size, [vocab[c] for c in letters if c in vocab], merges, spelled)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.arcs = [spelled.get(i, b"") for i in range(size)]
        for text, i in self.special.items():
            self.arcs[i] = text.encode()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.split, self.split_ascii = regex.compile(SPLIT).findall, re.compile(SPLIT_ASCII).findall
        self.words = Memo(lambda w: tuple(self.automaton.path(w.encode())))

    def encode(self, text: str) -> list[int]:
        word, out = self.words.__getitem__, []
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out += chain.from_iterable(map(word, (self.split_ascii if part.isascii() else self.split)(part)))
        return out

    def decode(self, ids: list[int]) -> str:
        """The arcs' labels, one after the other."""
        return b"".join(map(self.arcs.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def loaded(path: str) -> ByteBPE:
    """Compiled once in each Python worker."""
    return ByteBPE(path)


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """(id, ids array<int>[, decoded string]): the token ids of every whole text, and the text that they decode to."""

    def make():
        bpe = loaded(path)

        def one(text):
            ids = bpe.encode(text or "")
            return (ids, bpe.decode(ids)) if decoded else (ids,)

        return one

    return over_texts(df, id_col, text_col, "ids array<int>" + ", decoded string" * decoded, ["ids", "decoded"][: 1 + decoded], make)


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded string); null ids decode to the empty text."""

    def make():
        bpe = loaded(path)
        return lambda ids: (bpe.decode(ids or []),)

    return over_texts(df, id_col, ids_col, "decoded string", ["decoded"], make)
