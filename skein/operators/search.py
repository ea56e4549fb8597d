"""Ranked search over node names and paths.

Terms are words, ``prefix*`` or phrases of several words; all of ``every``,
one of ``some`` and none of ``never`` must match. Tokens are runs of letters
and digits in lower case without diacritics (``anadir`` finds ``añadir``). Rank is bm25 (k1 1.2, b 0.75, both columns alike),
the more negative the better. One pass counts what the rank needs, a second
scores and keeps the top rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


# letters of Latin script that are a plain letter with marks, by the decompositions of Unicode
_MARKED = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
_PLAIN = {c: d[0] for c, d in _MARKED.items() if len(d) > 1 and d[0].isascii()}


def folded(text: Column) -> Column:
    """Lower case, without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), "".join(_PLAIN), "".join(_PLAIN.values())), r"\p{M}+", "")


def _fold(term: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", term.lower()) if not unicodedata.combining(c))


def tokens(text: Column) -> Column:
    return F.filter(F.split(folded(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def postings(nodes: DataFrame) -> DataFrame:
    """(token, id, column, pos): the inverted index of the current nodes."""
    parts = [nodes.select("id", F.lit(c).alias("column"), F.posexplode(tokens(F.col(c))).alias("pos", "token")) for c in ("name", "file_path")]
    return parts[0].unionByName(parts[1]).select("token", "id", "column", "pos")


def _hits(term: str, columns: Sequence[str]) -> Column:
    """How often the term occurs."""
    words = [w for w in "".join(c if c.isalnum() or c == "*" else " " for c in _fold(term)).split() if w != "*"]
    if not words:
        raise ValueError(f"a term without letters or digits: {term!r}")
    prefix = words[-1].endswith("*")
    words[-1] = words[-1].rstrip("*")
    out = None
    for c in columns:
        if len(words) == 1:
            n = F.size(F.filter(c, lambda t: t.startswith(words[0]) if prefix else t == words[0]))
        else:
            phrase, k = F.array(*map(F.lit, words)), len(words)
            at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(c) - k + 1))
            if prefix:
                same = lambda i: (F.slice(F.col(c), i, k - 1) == F.slice(phrase, 1, k - 1)) & F.coalesce(F.get(F.col(c), i + k - 2).startswith(words[-1]), F.lit(False))
            else:
                same = lambda i: F.slice(F.col(c), i, k) == phrase
            n = F.size(F.filter(at, same))
        out = n if out is None else out + n
    return out


def search(nodes: DataFrame, every: Sequence[str] = (), some: Sequence[str] = (), never: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """(id, kind, name, file_path, rank) of the ``limit`` best rows, ties by id; no terms, or a term without letters, is an error."""
    terms = [*every, *some]
    if not terms:
        raise ValueError("a search needs a term")
    rows = nodes.select("id", "kind", "name", "file_path", tokens(F.col("name")).alias("name_tokens"), tokens(F.col("file_path")).alias("path_tokens"))
    columns = ("name_tokens", "path_tokens")
    counted = rows.select("id", "kind", "name", "file_path", (F.size(columns[0]) + F.size(columns[1])).alias("length"), *(_hits(t, columns).alias(f"f{i}") for i, t in enumerate(terms)), *(_hits(t, columns).alias(f"x{i}") for i, t in enumerate(never)))
    size = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *(F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"n{i}") for i in range(len(terms)))).first()
    if not size["n"]:
        return nodes.select("id", "kind", "name", "file_path", F.lit(0.0).alias("rank")).limit(0)
    wanted = F.lit(True)
    for i in range(len(every)):
        wanted = wanted & (F.col(f"f{i}") > 0)
    if some:
        wanted = wanted & F.greatest(F.lit(0), *(F.col(f"f{i}") for i in range(len(every), len(terms)))).__gt__(0)
    for i in range(len(never)):
        wanted = wanted & (F.col(f"x{i}") == 0)
    rank = F.lit(0.0)
    for i in range(len(terms)):
        n = size[f"n{i}"]
        idf = F.greatest(F.log((F.lit(size["n"]) - n + 0.5) / (F.lit(n) + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"f{i}").cast("double")
        rank = rank - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / size["mean"]))
    return counted.filter(wanted).select("id", "kind", "name", "file_path", rank.alias("rank")).orderBy("rank", "id").limit(limit)
