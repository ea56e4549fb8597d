"""Semantic enrichment: prompts, a pluggable provider called on executors, parsing of its replies, and the join back."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import json_object
from skein.operators.search import tokens

REPLY = "purpose string, summary string, responsibility array<string>, business_capability array<string>, design_pattern array<string>, risks array<struct<severity:string,category:string,description:string>>"
SEVERITIES = ("low", "medium", "high", "critical")
SNIPPET_BYTES = 2000  # fixed value: longest snippet in a prompt


def no_provider(prompt: str) -> str:
    return "{}"


def prompts(nodes: DataFrame, snippets: DataFrame) -> DataFrame:
    """(id, prompt): what is known of a node, line by line, and its file's code (cut at 2000 bytes, on a character).

    Lines whose value isn't known are left out. ``snippets`` has file_path and content.
    """
    field = lambda k: F.get_json_object("metadata_json", f"$.{k}")
    params = F.from_json(field("parameters"), "array<struct<name:string,type:string>>")
    shown = F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.coalesce(F.concat(F.lit(": "), p["type"]), F.lit("")))), ", ")
    kind = F.when(F.col("kind").isin("function", "method", "class"), F.initcap("kind")).otherwise("Symbol")
    # bytes of a character that the cut splits are invalid and come off
    cut = F.regexp_replace(F.expr(f"make_valid_utf8(cast(substring(encode(content, 'UTF-8'), 1, {SNIPPET_BYTES}) AS string))"), "\ufffd+$", "")
    snippet = F.when(F.octet_length("content") > SNIPPET_BYTES, F.concat(cut, F.lit("..."))).otherwise(F.col("content"))
    lines = [
        F.concat(F.lit("Decorators: "), F.array_join(F.from_json(field("decorators"), "array<string>"), ", ")),
        F.concat(F.lit("Decorator: "), field("decorator")),
        F.when(field("async") == "true", "Async: true"),
        F.concat(kind, F.lit(": "), F.col("name")),
        F.concat(F.lit("Parameters: "), shown),
        F.concat(F.lit("Returns: "), field("return_type")),
        F.concat(F.lit("Docstring: "), F.get_json_object(json_object(F.col("semantic_json")), "$.purpose")),
        F.concat(F.lit("File: "), F.col("file_path"), F.lit(":"), F.coalesce(F.col("line_start").cast("string"), F.lit("0"))),
        F.concat(F.lit("```\n"), snippet, F.lit("\n```")),
    ]
    return nodes.join(snippets.select("file_path", "content"), "file_path", "left").select("id", F.concat_ws("\n", *lines).alias("prompt"))


def parse_reply(reply: str | F.Column) -> F.Column:
    """Struct of REPLY: the Markdown fence is taken off, missing arrays are empty, unknown severities low; null for what isn't a JSON object."""
    column = F.col(reply) if isinstance(reply, str) else reply
    bare = F.regexp_replace(F.trim(F.regexp_replace(column, r"\s+$", "")), r"^\s*```[a-zA-Z]*\s*|\s*```$", "")
    p = F.from_json(bare, REPLY)
    none = F.array().cast("array<string>")
    risks = F.transform(F.coalesce(p["risks"], F.array().cast("array<struct<severity:string,category:string,description:string>>")), lambda r: F.struct(F.when(F.lower(r["severity"]).isin(*SEVERITIES), F.lower(r["severity"])).otherwise("low").alias("severity"), r["category"].alias("category"), r["description"].alias("description")))
    parsed = F.struct(p["purpose"].alias("purpose"), p["summary"].alias("summary"), *(F.coalesce(p[c], none).alias(c) for c in ("responsibility", "business_capability", "design_pattern")), risks.alias("risks"))
    return F.when(json_object(bare).isNotNull() & p.isNotNull(), parsed)


def candidates(nodes: DataFrame) -> DataFrame:
    """Functions, methods and classes whose record has no summary, with ``signature``, the last part of their key."""
    summary = F.get_json_object(json_object(F.col("semantic_json")), "$.summary")
    return nodes.filter("kind IN ('function', 'method', 'class')").filter(F.coalesce(F.trim(summary), F.lit("")) == "").withColumn("signature", F.element_at(F.split("id", "::"), -1))


def cache_size(nodes: DataFrame) -> DataFrame:
    """One row: n, the answers that ``enrich`` keeps, one for each name and signature of the candidates."""
    return candidates(nodes).select("name", "signature").distinct().agg(F.count(F.lit(1)).alias("n"))


def records(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the struct ``semantic`` of their record; those without a readable record are left out."""
    return nodes.withColumn("semantic", parse_reply("semantic_json")).filter("semantic IS NOT NULL")


def by_purpose(nodes: DataFrame, words: Sequence[str]) -> DataFrame:
    """Nodes whose recorded purpose holds all of the words."""
    said = tokens(F.col("semantic.purpose"))
    wanted = F.lit(True)
    for w in words:
        wanted = wanted & F.arrays_overlap(said, tokens(F.lit(w)))
    return records(nodes).filter(wanted).drop("semantic")


def by_tag(nodes: DataFrame, tag: str) -> DataFrame:
    """Nodes whose record has the tag as a responsibility, business capability or design pattern."""
    s = F.col("semantic")
    return records(nodes).filter(F.array_contains(s["responsibility"], tag) | F.array_contains(s["business_capability"], tag) | F.array_contains(s["design_pattern"], tag)).drop("semantic")


def by_risk(nodes: DataFrame, least: str = "low") -> DataFrame:
    """Nodes whose record has a risk of at least this severity."""
    severe = SEVERITIES[SEVERITIES.index(least) :]
    return records(nodes).filter(F.exists("semantic.risks", lambda r: r["severity"].isin(*severe))).drop("semantic")


def enrich(nodes: DataFrame, snippets: DataFrame, provider: Callable[[str], str] = no_provider) -> DataFrame:
    """(id, semantic_json) of the candidates for which the provider gave a reply that parses.

    The provider is asked once for each (name, signature) and its answer joined
    to all nodes that share it; a call that fails gives no row.
    """
    open_nodes = candidates(nodes)
    asked = open_nodes.groupBy("name", "signature").agg(F.min("id").alias("id"))
    texts = prompts(open_nodes, snippets).join(asked, "id").select("name", "signature", "prompt")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            replies = []
            for prompt in batch["prompt"]:
                try:
                    replies.append(provider(prompt))
                except Exception:  # a failed call is skipped, as its node stays a candidate
                    replies.append(None)
            yield batch.drop(columns="prompt").assign(reply=replies)

    answers = texts.mapInPandas(ask, "name string, signature string, reply string").select("name", "signature", F.to_json(parse_reply("reply")).alias("semantic_json")).dropna()
    return open_nodes.select("id", "name", "signature").join(answers, ["name", "signature"]).select("id", "semantic_json")
