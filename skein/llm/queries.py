"""Queries of the text and code problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import documented, encode, handwritten, leaks, quality, syntax
from skein.scratch import Scratch
from skein.sources.tables import table


def p2_files(spark: SparkSession, d: str) -> DataFrame:
    """Files that need edits to parse, with the least number of edits, the first line and the likely reason."""
    return syntax.repaired(table(spark, d, "files", "rel_path", "content"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The files that the chart parser rejects; the costs of p2_files have no say in it."""
    return syntax.rejected(table(spark, d, "files", "rel_path", "content"))


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Failing files per repository and language."""
    return syntax.failure_rates(p2_files(spark, d), table(spark, d, "files", "rel_path", "content"))


def _documented(spark: SparkSession, d: str, code: bool) -> DataFrame:
    nodes = table(spark, d, "nodes", "id", "kind", "name", "file_path", "line_start", "line_end", "metadata_json", "semantic_json")
    return documented.documented(nodes, table(spark, d, "files", "rel_path", "content"), code)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions that the assignment gave what their record states."""
    return _documented(spark, d, False).filter("source = 'record'").select("id")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Code and description of every function that has both."""
    return _documented(spark, d, True).filter("code IS NOT NULL AND trim(code) <> ''")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that nobody wrote by hand, without those that don't parse (only the files found are parsed)."""
    files = table(spark, d, "files", "rel_path", "content")
    judged = handwritten.judged(files, table(spark, d, "package_files", "content"))
    found = Scratch(spark, "found").save(judged.filter("found").select("rel_path").distinct())
    broken = syntax.rejected(files.join(found, "rel_path", "left_semi"))
    return found.join(broken, "rel_path", "left_anti")


def p6_validation(spark: SparkSession, d: str) -> DataFrame:
    """What the classifier finds and the rules label, in the repositories used for fitting and in those held out, with each group of features left out in turn."""
    return handwritten.validation(table(spark, d, "files", "rel_path", "content"), table(spark, d, "package_files", "content"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_texts(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per source."""
    return encode.token_counts(table(spark, d, "documents", "text", "source"), "text", "source")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "bench_items", "item_id", "question"), "item_id", "question")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Per suite and item, the number of documents that leak it (items that don't leak have 0)."""
    counts = _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return table(spark, d, "bench_items", "item_id", "suite").distinct().join(counts, "item_id", "left").select("suite", "item_id", F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"))


def p9_quality(spark: SparkSession, d: str) -> DataFrame:
    """Every document with text: its statistics, its distance from prose and what contributes most to it."""
    return quality.document_quality(table(spark, d, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_quality(spark, d).filter("NOT prose").select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_files, p2_rates, p4_found, p4_pairs, p6_found, p6_validation, p7_ids, p7_token_counts, p8_found, p8_items, p9_quality, p9_found)}

_LEAKS = r"""
WITH w AS (SELECT item_id AS id, list_transform(regexp_extract_all(question, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM bench_items),
p AS (SELECT DISTINCT id, array_to_string(w[k : k + 11], ' ') AS passage FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS k FROM w)),
dw AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
dp AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 11], ' ') AS passage FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw)),
f AS (SELECT DISTINCT doc_id, id AS item_id FROM dp JOIN p USING (passage))
"""
ORACLES = {
    "p8_found": _LEAKS + "SELECT doc_id, item_id FROM f",
    "p8_items": _LEAKS + "SELECT suite, b.item_id, count(f.doc_id) AS documents FROM (SELECT DISTINCT suite, item_id FROM bench_items) b LEFT JOIN f ON f.item_id = b.item_id GROUP BY 1, 2",
}
