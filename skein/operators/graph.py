"""Questions about the code graph.

Walks go over calls by name: a call points to every node whose name is its
``target_name``. Results of callers and callees are multisets (a node comes
once for each call), as each round adds what it finds; names are expanded once.
``nodes`` has one row per id and ``edges`` one per key (see ``store.latest``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import file_of, target_name
from skein.scratch import Scratch

SHOWN = ("id", "kind", "name", "file_path", "line_start")


def calls(edges: DataFrame) -> DataFrame:
    """(source_id, target_name) of calls that have both."""
    return edges.filter("kind = 'calls'").select("source_id", target_name(F.col("metadata_json")).alias("target_name")).dropna()


def _names(nodes: DataFrame, edges: DataFrame, name: str, depth: int, up: bool) -> DataFrame:
    """(name): names within fewer than ``depth`` calls of ``name``, itself included."""
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession, "walk")
    seen = spark.createDataFrame([(name,)], "name string")
    links = calls(edges).join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").select("source_name", "target_name").distinct()
    links = scratch.save(links)
    here, there = ("target_name", "source_name") if up else ("source_name", "target_name")
    fresh = seen
    for _ in range(depth - 1):
        # a broadcast isn't asked for: the frontier grows with the data, and Spark sees its size as a written table
        step = links.join(fresh.withColumnRenamed("name", here), here).select(F.col(there).alias("name")).distinct()
        fresh = scratch.save(step.join(seen, "name", "left_anti"))
        if fresh.isEmpty():
            break
        seen = scratch.save(seen.unionByName(fresh))
    return seen


def callers(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """Nodes that call ``name`` within ``depth`` calls, once per call. An unknown name can have callers; depth 0 has none."""
    called = calls(edges)
    if depth <= 1:
        found = called.filter(F.col("target_name") == (name if depth == 1 else None))
    else:
        found = called.join(_names(nodes, edges, name, depth, True).withColumnRenamed("name", "target_name"), "target_name")
    return found.join(nodes.withColumnRenamed("id", "source_id"), "source_id").select(F.col("source_id").alias("id"), *SHOWN[1:])


def callees(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """Nodes that ``name`` calls within ``depth`` calls, once per call and node of the called name."""
    sources = nodes.select(F.col("id").alias("source_id"), "name")
    sources = (sources.filter(F.col("name") == (name if depth == 1 else None)) if depth <= 1 else sources.join(_names(nodes, edges, name, depth, False), "name")).select("source_id")
    # calls are counted per name before they meet all nodes of that name
    called = calls(edges).join(sources, "source_id").groupBy(F.col("target_name").alias("name")).agg(F.count(F.lit(1)).alias("times"))
    return nodes.join(called, "name").select(*SHOWN, F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__i")).drop("__i")


def dependencies(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    return callees(nodes, edges, name, 1)


def dependents(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    return callers(nodes, edges, name, 1)


def neighbors(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 1) -> DataFrame:
    """Callers and callees, each id once."""
    return callers(nodes, edges, name, depth).unionByName(callees(nodes, edges, name, depth)).distinct()


def imports_of_file(edges: DataFrame, file: str) -> DataFrame:
    """Import edges whose source begins with ``file::``, without regard to ASCII case; ``%`` and ``_`` in ``file`` are wildcards."""
    pattern = file.replace("\\", "\\\\") + "::%"
    return edges.filter("kind = 'imports'").filter(F.col("source_id").ilike(pattern)).select("source_id", "target_id", "kind", "metadata_json")


def imported_by(edges: DataFrame, imports: DataFrame, file: str) -> DataFrame:
    """(file): files that import ``file``, from ``resolve.import_files``."""
    return imports.filter(F.col("imported") == file).select("file")


def find_keys(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(F.col("name") == name).select("id")


def list_nodes(nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """All nodes (of a kind) by file, name and id."""
    return (nodes.filter(F.col("kind") == kind) if kind else nodes).orderBy("file_path", "name", "id")


def list_edges(edges: DataFrame, kind: str | None = None) -> DataFrame:
    return (edges.filter(F.col("kind") == kind) if kind else edges).orderBy("source_id", "target_id", "kind")


def contained(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes that nodes called ``name`` contain directly, once per link."""
    sources = nodes.filter(F.col("name") == name).select(F.col("id").alias("source_id"))
    links = edges.filter("kind = 'contains'").join(sources, "source_id").select(F.col("target_id").alias("id"))
    return nodes.join(links, "id").select(*SHOWN)


def count_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "kind")


def totals(nodes: DataFrame, edges: DataFrame, version: int = 1) -> DataFrame:
    """One row: total_nodes, total_edges, ir_version."""
    parts = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_nodes"), F.coalesce(F.sum("e"), F.lit(0)).cast("bigint").alias("total_edges"), F.lit(version).cast("bigint").alias("ir_version"))


def result_count(found: DataFrame) -> DataFrame:
    """One row: n, the size of a result, and distinct_ids."""
    return found.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("distinct_ids"))


def import_names(edges: DataFrame) -> DataFrame:
    """(file, n, names): how many imports each file has, and their names in order, joined by commas."""
    rows = edges.filter("kind = 'imports'").select(file_of(F.col("source_id")).alias("file"), F.get(F.split("target_id", "::"), F.lit(2)).alias("name"))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"))


def call_path(nodes: DataFrame, edges: DataFrame, start: str, goal: str, most: int = 10) -> list[str]:
    """Names on a shortest call path from ``start`` to ``goal`` of at most ``most`` calls (the smallest names where several are as short); [] if none.

    Each round is a join; only the path's names reach the driver.
    """
    spark, scratch = nodes.sparkSession, Scratch(nodes.sparkSession, "path")
    if start == goal:
        return [start]
    links = scratch.save(calls(edges).join(nodes.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").select("source_name", "target_name").distinct())
    levels = [spark.createDataFrame([(start, "")], "name string, before string")]
    seen = levels[0].select("name")
    for depth in range(most):
        step = links.join(levels[-1].select(F.col("name").alias("source_name")), "source_name").groupBy(F.col("target_name").alias("name")).agg(F.min("source_name").alias("before"))
        fresh = scratch.save(step.join(seen, "name", "left_anti"))
        levels.append(fresh)
        if fresh.isEmpty():
            return []
        if not fresh.filter(F.col("name") == goal).isEmpty():
            path = [goal]
            for level in reversed(levels[1:]):
                path.append(level.filter(F.col("name") == path[-1]).first()["before"])
            return path[::-1]
        seen = scratch.save(seen.unionByName(fresh.select("name")))
    return []


def as_text(nodes: DataFrame) -> DataFrame:
    """(line): ``  [kind] name @ file:line``."""
    return nodes.select(F.format_string("  [%s] %s @ %s:%s", "kind", "name", "file_path", F.coalesce(F.col("line_start").cast("string"), F.lit("0"))).alias("line"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("json"))
