"""Parent-child links to full hierarchies by tree contraction.

Contraction repeats two steps on the table of links (child, parent, w), where
w counts the original links that a row stands for:

rake      every leaf is recorded under its parent and removed;
compress  a node with exactly one child, whose hash is larger than its
          parent's and its child's, is recorded under that child and spliced
          out: the child's row then leads to the node's parent.

Both need only equi-joins on the (unique) child and a count per parent that is
aggregated before the shuffle, so a parent with a third of all rows is no
burden. Rounds grow with the logarithm of the depth and the number of nodes,
and each round's tables shrink. What never ends is a loop: compression turns it
into a node that is its own parent, whose w is the loop's length.

After a round in which raking alone took half of the links, compression can be
left for the next one (``always`` compresses in every round; the results are
the same).

Expansion runs the records backwards, where children of the few parents with
most links meet these parents by a broadcast of at most 200 rows: a raked node gets root and depth from
its parent, a spliced node from its child, and a node lies on a loop exactly
if it was spliced over a child that does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.skew import hot_values
from skein.scratch import Scratch

MAX_ROUNDS = 200  # log-many are needed; a safeguard against input that changes between reads


def parent_links(pairs: DataFrame, child: str, parent: str) -> DataFrame:
    """(child, parent), one row per child: nulls dropped, repeats merged; of several parents the smallest counts."""
    return pairs.select(F.col(child).alias("child"), F.col(parent).alias("parent")).dropna().groupBy("child").agg(F.min("parent").alias("parent"))


def _rank(c: str, round_no: int) -> Column:
    return F.xxhash64(F.col(c), F.lit(round_no))


def _children(links: DataFrame, first: bool) -> DataFrame:
    """(node, n, first): how many links lead to each parent, and one of them."""
    extra = [F.min(F.struct("child", "w", *(["seg"] if "seg" in links.columns else []))).alias("first")] if first else []
    return links.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), *extra)


class Contraction:
    """One run; the records of each round are written tables."""

    def __init__(self, links: DataFrame, paths: bool, always: bool = False):
        self.always = always
        self.scratch = Scratch(links.sparkSession, "hierarchy")
        self.paths = paths
        self.records: list[DataFrame] = []
        self.loops: list[DataFrame] = []
        extra = [F.array().cast("array<string>").alias("seg")] if paths else []
        self.base = self.scratch.save(links.select("child", "parent", F.lit(1).cast("bigint").alias("w"), *extra))
        # splicing gives no parent more children than it had at first, so these are the hot ones of every round
        self.hot = hot_values(self.base.select("parent"), "parent", 0.005)

    def _split_loops(self, links: DataFrame) -> DataFrame:
        """Take finished loops (a node that is its own parent) out of the links."""
        own = links.filter("child = parent")
        self.loops.append(own.select(F.col("child").alias("id")))
        return links.filter("child <> parent")

    def _record(self, rows: DataFrame, anchor: str, delta: Column, spliced: bool) -> None:
        extra = [F.col("seg") if "seg" in rows.columns and not spliced else F.array().cast("array<string>").alias("seg")] if self.paths else []
        self.records.append(rows.select(F.col("child").alias("id"), F.col(anchor).alias("anchor"), delta.alias("delta"), F.lit(spliced).alias("spliced"), *extra))

    def contract(self) -> None:
        links, size = self._split_loops(self.base), self.base.count()
        for round_no in range(MAX_ROUNDS):
            raked = self.scratch.save(links.join(_children(links, False), F.col("child") == F.col("node"), "left").drop("node"))
            leaves = raked.filter("n IS NULL")
            self._record(leaves, "parent", F.col("w"), False)
            inner = raked.filter("n IS NOT NULL").drop("n")
            before, size = size, inner.count()
            if not size:
                return
            if size * 2 <= before and not self.always:  # raking alone shrinks the tree fast enough
                links = inner
                continue
            known = self.scratch.save(inner.join(_children(inner, True).filter("n = 1"), F.col("child") == F.col("node"), "left").drop("node", "n"))
            chosen = known.filter(
                F.col("first").isNotNull() & (_rank("child", round_no) > _rank("parent", round_no)) & (_rank("child", round_no) > F.xxhash64(F.col("first.child"), F.lit(round_no)))
            ).withColumn("below", F.col("first.child"))
            self._record(chosen, "below", -F.col("first.w"), True)
            moved = chosen.select(
                F.col("below").alias("node"),
                F.col("parent").alias("to"),
                F.col("w").alias("more"),
                *([F.concat("seg", F.array("child")).alias("before")] if self.paths else []),
            ).unionByName(
                chosen.select(F.col("child").alias("node"), F.lit(None).cast("string").alias("to"), F.lit(-1).cast("bigint").alias("more"), *([F.array().cast("array<string>").alias("before")] if self.paths else []))
            )
            rest = known.drop("first").join(moved, F.col("child") == F.col("node"), "left").filter("more IS NULL OR more >= 0")
            rest = rest.select(
                "child",
                F.coalesce("to", "parent").alias("parent"),
                (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"),
                *([F.concat(F.coalesce("before", F.array().cast("array<string>")), "seg").alias("seg")] if self.paths else []),
            )
            links = self._split_loops(self.scratch.save(rest))
            size = links.count()
            if not size:
                return
        raise RuntimeError("the links did not contract; were they read differently from round to round?")

    def expand(self) -> DataFrame:
        spark = self.scratch.spark
        scratch = Scratch(spark, "hierarchy")
        roots = self.base.select(F.col("parent").alias("id")).distinct().join(self.base.select(F.col("child").alias("id")), "id", "left_anti")
        start = roots.select("id", F.col("id").alias("root"), F.lit(False).alias("on_loop"), F.lit(False).alias("under_loop"))
        for own in self.loops:
            start = start.unionByName(own.select("id", F.col("id").alias("root"), F.lit(True).alias("on_loop"), F.lit(False).alias("under_loop")))
        start = start.withColumn("depth", F.lit(0).cast("bigint"))
        if self.paths:
            start = start.withColumn("path", F.array("id"))
        schema, tables = start.schema, [scratch.write(start)]
        for records in reversed(self.records):
            done = spark.read.schema(schema).parquet(*tables)
            done = done.withColumnRenamed("id", "anchor")
            if self.hot:
                hot = F.col("anchor").isin(self.hot)
                found = records.filter(~hot).join(done.filter(~hot), "anchor").unionByName(records.filter(hot).join(F.broadcast(done.filter(hot)), "anchor"))
            else:
                found = records.join(done, "anchor")
            new = found.select(
                "id",
                "root",
                (F.col("on_loop") & F.col("spliced")).alias("on_loop"),
                F.when(F.col("spliced"), F.col("under_loop")).otherwise(F.col("on_loop") | F.col("under_loop")).alias("under_loop"),
                (F.col("depth") + F.col("delta")).alias("depth"),
                *([F.when(F.col("spliced"), F.slice("path", F.lit(1), F.greatest(F.lit(0), F.size("path") + F.col("delta")).cast("int"))).otherwise(F.concat("path", "seg", F.array("id"))).alias("path")] if self.paths else []),
            )
            tables.append(scratch.write(new))
        self.scratch.clear()  # what is read from here on are the tables of the expansion
        return spark.read.schema(schema).parquet(*tables)


def hierarchy(pairs: DataFrame, child: str, parent: str, paths: bool = False, always: bool = False) -> DataFrame:
    """(id, root_id, depth, state[, path]) for every id of either column.

    state ``tree``: depth counts the links below the root (a root has 0), path
    runs from the root to the id. ``loop``: the id lies on a loop; root_id is
    the loop's smallest id and depth -1. ``below_loop``: an ancestor lies on a
    loop; root_id is the smallest id of that loop, depth -1. Both have a null
    path. Rows with a null end are skipped, repeated links count once, of
    several parents the smallest is kept, an empty table gives no rows. All
    other columns are ignored.
    """
    run = Contraction(parent_links(pairs, child, parent), paths, always)
    run.contract()
    found = run.expand()
    on = found.filter("on_loop").groupBy("root").agg(F.min("id").alias("smallest"))
    looped = found.filter("on_loop OR under_loop").join(on, "root").select(
        "id",
        F.col("smallest").alias("root_id"),
        F.lit(-1).cast("bigint").alias("depth"),
        F.when(F.col("on_loop"), "loop").otherwise("below_loop").alias("state"),
        *([F.lit(None).cast("array<string>").alias("path")] if paths else []),
    )
    return found.filter("NOT on_loop AND NOT under_loop").select("id", F.col("root").alias("root_id"), "depth", F.lit("tree").alias("state"), *(["path"] if paths else [])).unionByName(looped)


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, id, distance): every pair of a node and one of its descendants, from ``hierarchy(paths=True)``.

    The rows are the sum of all depths, as many as there are such pairs; ids
    on or below loops have none.
    """
    rows = tree.filter("state = 'tree' AND depth > 0")
    return rows.select(F.posexplode("path").alias("pos", "ancestor_id"), "id", "depth").filter("pos < depth").select("ancestor_id", "id", (F.col("depth") - F.col("pos")).cast("bigint").alias("distance"))


def deep_or_looped(pairs: DataFrame, child: str, parent: str, least: int = 12) -> DataFrame:
    """(id, root_id, depth): ids on loops (depth -1) and ids ``least`` or more links below their root."""
    return hierarchy(pairs, child, parent).filter(f"state = 'loop' OR state = 'tree' AND depth >= {int(least)}").select("id", "root_id", "depth")
