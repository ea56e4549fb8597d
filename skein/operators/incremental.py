"""Full and incremental builds: changed files are found by content hash, extracted, resolved and put in."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import extract as X
from skein.operators.resolve import resolve_calls
from skein.operators.store import Store
from skein.scratch import Scratch
from skein.sources.repository import scan


def changes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(rel_path, change) for every path of ``current``: new, changed or same, by ``content_hash``; paths of ``previous`` alone are gone.

    Both have one row per path. A null hash (content that wasn't read) differs from every hash but null.
    """
    both = current.select("rel_path", F.col("content_hash").alias("now"), F.lit(True).alias("here")).join(previous.select("rel_path", F.col("content_hash").alias("then"), F.lit(True).alias("there")), "rel_path", "full")
    change = F.when(F.col("there").isNull(), "new").when(F.col("here").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("then")), "same").otherwise("changed")
    return both.select("rel_path", change.alias("change"))


def build(spark: SparkSession, root: str, folder: str, force: bool = False, prune: bool = False, all_names: bool = False) -> DataFrame:
    """Build the repository at ``root`` into the store in ``folder``; gives one row of statistics.

    Without ``force`` and with a store from before, only new and changed files
    are extracted, and calls are resolved among them; rows of files that
    changed or went stay, unless ``prune``, which removes them and resolves
    against all nodes. Counts of nodes and edges are those extracted; stored
    rows are fewer, as keys repeat. A file that can't be read or parsed is a
    diagnostic; those of files that are read again replace what was said before.
    Everything becomes current in one commit.
    """
    began = time.time()
    store, scratch = Store(spark, folder), Scratch(spark, "build")
    files = scratch.save(scan(spark, root))
    before = None if force else store.table("hashes")
    told = changes(files, before) if before is not None else None
    todo = files if told is None else files.join(told.filter("change IN ('new', 'changed')"), "rel_path", "left_semi")
    rows = scratch.save(X.extract(todo, all_names))
    nodes, edges = X.nodes(rows), X.edges(rows)
    known, gone = nodes, None
    if prune and told is not None:
        gone = scratch.save(told.filter("change IN ('changed', 'gone')").select("rel_path"))
        keep = store.table("nodes").join(gone.withColumnRenamed("rel_path", "file_path"), "file_path", "left_anti")
        known = keep.withColumn("ord", F.coalesce("line_start", F.lit(0))).select(*nodes.columns).unionByName(nodes)
    resolved = scratch.save(resolve_calls(edges, known))
    told_off = store.table("diagnostics")
    # of every file that was read again, what was said about it goes
    mended = todo.select("rel_path") if told_off is not None else None
    store.persist(nodes, resolved.drop("rel_path", "resolved"), files.select("rel_path", "content_hash"), X.diagnostics(rows), gone, mended)
    stats = build_stats(files, rows, resolved).withColumn("duration_ms", F.lit(int((time.time() - began) * 1000)).cast("bigint"))
    stats = spark.createDataFrame(stats.collect(), stats.schema)  # one row
    scratch.clear()
    return stats


def build_stats(files: DataFrame, rows: DataFrame, resolved: DataFrame) -> DataFrame:
    """One row: files_scanned, files_parsed, files_failed, files_skipped, total_nodes, total_edges, calls_resolved."""
    seen = rows.groupBy("rel_path").agg(F.max((F.col("what") == "diagnostic").cast("int")).alias("failed"), F.sum((F.col("what") == "node").cast("bigint")).alias("nodes"), F.sum((F.col("what") == "edge").cast("bigint")).alias("edges"))
    stats = files.select("rel_path").join(seen, "rel_path", "left").agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.count(F.when(F.col("failed") == 0, 1)).alias("files_parsed"),
        F.count(F.when(F.col("failed") == 1, 1)).alias("files_failed"),
        F.count(F.when(F.col("failed").isNull(), 1)).alias("files_skipped"),
        F.coalesce(F.sum("nodes"), F.lit(0)).alias("total_nodes"),
        F.coalesce(F.sum("edges"), F.lit(0)).alias("total_edges"),
    )
    # two rows of totals side by side
    return stats.withColumn("k", F.lit(1)).join(resolved.agg(F.count(F.when(F.col("resolved"), 1)).alias("calls_resolved")).withColumn("k", F.lit(1)), "k").drop("k")
