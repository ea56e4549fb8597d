"""Encoding of texts with a byte-level BPE vocabulary in time linear in the text.

A text is cut by the vocabulary's pattern; each piece's bytes are mapped to
Latin-1 so that an Aho-Corasick automaton of all tokens reports every token
that occurs in it. The encoding is the one sequence of tokens that covers the
piece and whose adjacent tokens are compatible (the exact merges of the two
tokens' joined bytes give back these two tokens). It is found by taking the
longest token at each place and going back to a shorter one, or to the place
before, where a token doesn't go with the one before it; places that led
nowhere are remembered, so that no place is tried twice.

The vocabulary's file is read once on the driver and broadcast; its size is
checked, and it doesn't grow with the corpus.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scratch import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 64 << 20

# fixed value: the public pattern that cuts texts into pieces before byte_bpe_50k's merges
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    def __init__(self, vocabulary: bytes):
        import ahocorasick
        import regex

        self.ranks = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.tokens = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens.add_word(token, len(token))
        self.tokens.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.compatible = lru_cache(1 << 20)(self._compatible)
        self.piece_ids = lru_cache(1 << 17)(self._piece_ids)

    def _merged(self, piece: str) -> list[str]:
        """The merges as defined: the pair with the lowest rank first."""
        parts = list(piece)
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        return self._merged(left + right) == [left, right]

    def _piece_ids(self, piece: str) -> tuple[int, ...]:
        if piece in self.ranks:
            return (self.ranks[piece],)
        lengths: list[list[int]] = [[] for _ in piece]  # of the tokens that start here, longest last
        for end, n in self.tokens.iter(piece):
            lengths[end - n + 1].append(n)
        for options in lengths:
            options.sort()
        dead = bytearray(len(piece) + 1)
        starts, tried, at = [0], [len(lengths[0])], 0
        chosen: list[str] = []
        while at < len(piece):
            options, k = lengths[at], tried[-1] - 1
            while k >= 0:
                token = piece[at : at + options[k]]
                if not dead[at + options[k]] and (not chosen or self.compatible(chosen[-1], token)):
                    break
                k -= 1
            tried[-1] = k
            if k >= 0:
                chosen.append(token)
                at += len(token)
                starts.append(at)
                tried.append(len(lengths[at]) if at < len(piece) else 0)
            else:
                dead[at] = 1
                starts.pop(), tried.pop(), chosen.pop()
                at = starts[-1]
        return tuple(self.ranks[t] for t in chosen)

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(text or ""):
            data = piece.encode("utf-8", "replace").decode("latin-1")
            # a piece without spaces for a whole page is rare and isn't worth a place in memory
            ids.extend(self.piece_ids(data) if len(data) <= 64 else self._piece_ids(data))
        return ids


@lru_cache(4)
def _encoder(vocabulary: bytes) -> Encoder:
    """One per Python worker, not one per task."""
    return Encoder(vocabulary)


def vocabulary_bytes(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes and can't be broadcast")
    with open(path, "rb") as f:
        return f.read()


def encode_texts(docs: DataFrame, id_column: str, text_column: str, vocabulary: str = VOCABULARY, *kept: str) -> DataFrame:
    """(``id_column``, ``kept``..., ids array<int>): the token ids of each row's text, without special tokens.

    Null and empty texts have an empty list. Special tokens' strings in a text
    are ordinary text. Every row gives one row, repeats too; other columns than
    those kept are ignored. Works row by row, so it shuffles nothing, whatever the skew.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(vocabulary))

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(shared.value)
        for s in texts:
            yield pd.Series([encoder.encode(t) for t in s], dtype=object)

    return spread(docs.select(id_column, *kept, text_column)).select(id_column, *kept, F.pandas_udf(batches, "array<int>")(F.col(text_column)).alias("ids"))


def token_counts(docs: DataFrame, text_column: str, group: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``group``, documents, tokens, empty): totals of ``encode_texts`` by a column of the same rows; only lengths are shuffled."""
    named = docs.select(F.col(group).alias("__group"), F.col(text_column).alias("__text"))
    sizes = encode_texts(named, "__group", "__text", vocabulary).select(F.col("__group").alias(group), F.size("ids").alias("__size"))
    return sizes.groupBy(group).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("__size").cast("bigint")).alias("tokens"), F.sum((F.col("__size") == 0).cast("bigint")).alias("empty"))
