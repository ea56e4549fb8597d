"""Evaluation texts leaking into training text: Wu-Manber search over words.

Every run of ``span`` consecutive words of an item is a pattern. A scan looks
at the last two words of a window of ``span`` words: the shift table says how
far the window can move without skipping a pattern; where it says nothing, the
bucket of patterns that end in these two words is compared directly.

Words are runs of letters and digits, in lower case. Patterns are cut from the
items on the executors and split by hash into blocks of bounded size; each
block makes one pass over the documents, so a set of items of any size is
searched with bounded memory, and an ordinary set in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.scratch import Scratch, spread

SPAN = 12
BLOCK_PATTERNS = 200_000  # patterns a task holds at a time, about 100 MB

_WORDS = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return [w.lower() for w in _WORDS.findall(text or "")]


def item_passages(items: DataFrame, id_column: str, text_column: str, span: int = SPAN) -> DataFrame:
    """(item, passage): every run of ``span`` words of each item; items with fewer words have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, " ".join(w[k : k + span])) for i, t in zip(batch["item"], batch["text"]) for w in [words(t)] for k in range(len(w) - span + 1)]
            yield pd.DataFrame(rows, columns=["item", "passage"])

    texts = items.select(F.col(id_column).cast("bigint").alias("item"), F.col(text_column).alias("text")).dropna()
    return texts.mapInPandas(cut, "item bigint, passage string").distinct()


class Search:
    """Wu-Manber tables of patterns that all have ``span`` words."""

    def __init__(self, patterns: Sequence[str], span: int):
        self.span = span
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], list[tuple[list[str], str]]] = {}
        for p in patterns:
            w = p.split(" ")
            for end in range(1, span):
                block = (w[end - 1], w[end])
                self.shift[block] = min(self.shift.get(block, span), span - 1 - end)
            self.bucket.setdefault((w[-2], w[-1]), []).append((w, p))

    def find(self, text: list[str]) -> set[str]:
        found, span, far = set(), self.span, self.span - 1
        shift, at = self.shift, self.span - 1
        while at < len(text):
            step = shift.get((text[at - 1], text[at]), far)
            if not step:
                start = at - span + 1
                for w, p in self.bucket[(text[at - 1], text[at])]:
                    if text[start] == w[0] and text[start : at + 1] == w:
                        found.add(p)
                step = 1
            at += step
        return found


@lru_cache(1)
def _search(patterns: tuple[str, ...], span: int) -> Search:
    """One per Python worker and block, not one per task."""
    return Search(patterns, span)


def leaked_passages(docs: DataFrame, doc_id: str, doc_text: str, passages: DataFrame, span: int = SPAN, block_patterns: int = BLOCK_PATTERNS) -> DataFrame:
    """(doc, passage): the distinct passages that occur in each document."""
    spark = docs.sparkSession
    distinct = passages.select("passage").distinct()
    blocks = max(1, -(-distinct.count() // block_patterns))
    kind = docs.schema[doc_id].dataType
    texts = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(doc_text).alias("text")).filter("text IS NOT NULL")  # as text, so that pandas keeps nulls and large numbers
    texts, out = spread(texts), None
    for b in range(blocks):
        part = distinct if blocks == 1 else distinct.filter(F.pmod(F.xxhash64("passage"), F.lit(blocks)) == b)
        patterns = spark.sparkContext.broadcast(tuple(r[0] for r in part.collect()))  # at most about block_patterns rows

        def scan(batches: Iterator[pd.DataFrame], patterns=patterns) -> Iterator[pd.DataFrame]:
            search = _search(patterns.value, span)
            for batch in batches:
                rows = [(d, p) for d, t in zip(batch["doc"], batch["text"]) for p in search.find(words(t))]
                yield pd.DataFrame(rows, columns=["doc", "passage"])

        found = texts.mapInPandas(scan, "doc string, passage string").select(F.col("doc").cast(kind).alias("doc"), "passage")
        out = found if out is None else out.unionByName(found)
    return out


def leaks(docs: DataFrame, doc_id: str, doc_text: str, items: DataFrame, item_id: str, item_text: str, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, passages): documents that hold at least ``span`` consecutive words of an item.

    A passage that several items share counts for each of them. Null or empty
    texts and items with fewer than ``span`` words give nothing; repeated rows
    of either table change nothing; the number of shared passages is given.
    """
    passages = Scratch(docs.sparkSession, "leaks").save(item_passages(items, item_id, item_text, span))  # counted, collected in blocks and joined
    found = leaked_passages(docs, doc_id, doc_text, passages, span)
    return found.join(passages, "passage").groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).agg(F.countDistinct("passage").alias("passages"))
