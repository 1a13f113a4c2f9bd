"""Subword tokenizers for models: WordPiece and byte-pair merges, as Arrow-batched functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_WORD = 100
#: Pieces that byte-pair merging works inside of.
PRE_SPLIT = regex.compile(r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def basic_words(text: str) -> list[str]:
    """Lower-case words without accents and control characters, marks of punctuation by themselves."""
    clean = "".join(" " if c.isspace() else c for c in text if c.isspace() or unicodedata.category(c) not in ("Cc", "Cf", "Co") and c != "�")
    plain = "".join(c for c in unicodedata.normalize("NFD", clean.lower()) if unicodedata.category(c) != "Mn")
    return regex.findall(r"[\p{P}\p{S}]|[^\s\p{P}\p{S}]+", plain)


def wordpieces(text: str | None, vocabulary: dict[str, int], unknown: str = "[UNK]", ends: bool = True) -> list[int]:
    """Numbers of the longest pieces from the left; a word with a part that no piece fits is unknown as a whole."""
    out = [vocabulary["[CLS]"]] if ends else []
    for word in basic_words(text or ""):
        pieces, at = [], 0
        while at < len(word) and len(word) <= LONGEST_WORD:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            pieces.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        out += pieces if at == len(word) else [vocabulary[unknown]]
    return out + ([vocabulary["[SEP]"]] if ends else [])


def pair_pieces(a: str, b: str, vocabulary: dict[str, int], limit: int = 512) -> tuple[list[int], list[int]]:
    """Numbers and segment marks of two texts for a pair scorer, the second cut to what fits."""
    first = wordpieces(a, vocabulary)[: limit - 1]
    second = wordpieces(b, vocabulary, ends=False)[: limit - len(first) - 1] + [vocabulary["[SEP]"]]
    return first + second, [0] * len(first) + [1] * len(second)


def merge_pairs(piece: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    """The piece's characters, the pair of best rank merged until none has a rank."""
    parts = list(piece)
    while len(parts) > 1:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get((parts[i], parts[i + 1]), 1 << 30))
        if (parts[at], parts[at + 1]) not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _batched(f: Callable, kind: str):
    """A function of one value as a column function in Arrow batches."""

    def run(s):
        return s.map(f)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def wordpiece_column(text: Column, vocabulary: dict[str, int]) -> Column:
    return _batched(lambda t: wordpieces(t, vocabulary), "array<int>")(text)


def bpe_column(text: Column, ranks: dict[tuple[str, str], int]) -> Column:
    return _batched(lambda t: [p for piece in PRE_SPLIT.findall(t or "") for p in merge_pairs(piece, ranks)], "array<string>")(text)


def char_vocabulary(words: list[str]) -> dict[str, int]:
    """A small vocabulary: the special marks, single characters and the given words, each also as a following piece."""
    chars = [chr(c) for c in range(33, 127)]
    names = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", *chars, *(f"##{c}" for c in chars), *words, *(f"##{w}" for w in words)]
    return {n: i for i, n in enumerate(dict.fromkeys(names))}
