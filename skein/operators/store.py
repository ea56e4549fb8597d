"""Keyed node, edge and meta tables: last writer wins.

A table is split by the file that its rows belong to into BUCKETS parts. A
batch rewrites the buckets that it touches and no others, and a numbered
pointer file that names the part of every bucket makes all tables of a batch
current at once. Pointer and tables are on any file system that Hadoop knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IR_VERSION = 1
NODE_KEY, EDGE_KEY = ["id"], ["source_id", "target_id", "kind"]
BUCKETS = 64


class Spec(NamedTuple):
    key: list[str]
    file: str  # SQL expression of the file that a row belongs to


TABLES = {
    "nodes": Spec(NODE_KEY, "substring_index(id, '::', 1)"),
    "edges": Spec(EDGE_KEY, "substring_index(source_id, '::', 1)"),
    "hashes": Spec(["rel_path"], "rel_path"),
    "diagnostics": Spec(["file_path", "line", "message"], "file_path"),
    "meta": Spec(["key"], "''"),
}


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the greatest by ``order`` (nulls lowest); rows with a null key are dropped.

    An aggregate of one struct per key: it combines before the shuffle, so a
    key with a third of all rows sends one row from each task, where a window
    would sort them all in one. Ties of the order are broken by all columns.
    """
    others = [c for c in df.columns if c not in key]
    first = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked = df.dropna(subset=list(key)).groupBy(*key).agg(F.max(F.struct(*(c.alias(f"__o{i}") for i, c in enumerate(first)), *others)).alias("__top"))
    return ranked.select(*key, *(F.col(f"__top.{c}").alias(c) for c in others)).select(*df.columns)


def upsert(old: DataFrame | None, new: DataFrame, key: Sequence[str], order: Sequence[str] = ("ord",)) -> DataFrame:
    """``old`` with the rows of ``new`` put in: per key the row of ``new`` if there is one (its greatest by ``order``), else that of ``old``."""
    fresh = latest(new, key, order).drop("ord")
    if old is None:
        return fresh
    return old.join(fresh.select(*key), list(key), "left_anti").unionByName(fresh, allowMissingColumns=True)


class Store:
    """Tables nodes, edges, hashes, diagnostics and meta below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[8:]) for n in names if n.startswith("CURRENT-"))

    def version(self) -> dict[str, dict]:
        """Per table its schema and the folder of each bucket; empty before the first commit."""
        numbers = self._numbers()
        if not numbers:
            return {}
        stream = self._fs.open(self._path(f"{self.folder}/CURRENT-{numbers[-1]:09d}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def table(self, name: str, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The table (only the given buckets of it); None before its first commit."""
        found = self.version().get(name)
        if found is None:
            return None
        schema = StructType.fromJson(found["schema"])
        paths = [f"{self.folder}/{path}" for b, path in found["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def put(self, gone: DataFrame | None = None, mended: DataFrame | None = None, **batches: DataFrame) -> None:
        """Upsert a batch into each of the given tables, in one commit.

        Rows of the files in ``gone`` (rel_path) are taken out of nodes, edges,
        hashes and diagnostics first, those of the files in ``mended`` out of
        diagnostics. Of equal keys within a batch the greatest ``ord`` counts.
        """
        before = self.version()
        after = dict(before)
        for name, spec in TABLES.items():
            new = batches.get(name)
            bucket = F.expr(f"cast(pmod(xxhash64({spec.file}), {BUCKETS}) AS int)")
            out = [d.select("rel_path") for d in (gone, mended if name == "diagnostics" else None) if d is not None and name in before and name != "meta"]
            gone_here = out[0].unionByName(out[1]) if len(out) == 2 else out[0] if out else None
            if new is None and gone_here is None:
                continue
            touched = set()
            if new is not None:
                touched |= {r[0] for r in new.select(bucket).distinct().collect()}  # at most BUCKETS
            if gone_here is not None:
                touched |= {r[0] for r in gone_here.select(F.expr(f"cast(pmod(xxhash64(rel_path), {BUCKETS}) AS int)")).distinct().collect()}
            old = self.table(name, sorted(touched)) if name in before else None
            if gone_here is not None:
                old = old.withColumn("__file", F.expr(spec.file)).join(gone_here.select(F.col("rel_path").alias("__file")).distinct(), "__file", "left_anti").drop("__file")
            rows = upsert(old, new, spec.key) if new is not None else old
            path = f"{name}-{uuid.uuid4().hex}"
            # rebalance: one writer per bucket, and several for a bucket that is too large for one
            rows.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{path}")
            written = {s.getPath().getName()[7:] for s in self._fs.listStatus(self._path(f"{self.folder}/{path}")) if s.getPath().getName().startswith("bucket=")}
            parts = {b: p for b, p in before.get(name, {"parts": {}})["parts"].items() if int(b) not in touched}
            after[name] = {"schema": json.loads(rows.schema.json()), "parts": parts | {b: f"{path}/bucket={b}" for b in written}}
        self._publish(after)

    def _publish(self, version: dict[str, dict]) -> None:
        """Make a version current: its pointer is written aside and renamed, which fails if another writer was first."""
        number = (self._numbers() or [0])[-1] + 1
        aside = self._path(f"{self.folder}/next-{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        self._io.write(json.dumps(version), stream, "UTF-8")
        stream.close()
        if not self._fs.rename(aside, self._path(f"{self.folder}/CURRENT-{number:09d}")):
            raise RuntimeError(f"another writer has committed version {number} of {self.folder}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the last ``keep`` versions names."""
        numbers = self._numbers()
        kept: set[str] = set()
        for n in numbers[-keep:]:
            stream = self._fs.open(self._path(f"{self.folder}/CURRENT-{n:09d}"))
            kept |= {p.split("/")[0] for t in json.loads(self._io.toString(stream, "UTF-8")).values() for p in t["parts"].values()}
            stream.close()
        old = {f"CURRENT-{n:09d}" for n in numbers[:-keep]}
        for s in self._fs.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name in old or name.split("-")[0] in TABLES and name not in kept:
                self._fs.delete(s.getPath(), True)

    def persist(self, nodes: DataFrame, edges: DataFrame, hashes: DataFrame | None = None, diagnostics: DataFrame | None = None, gone: DataFrame | None = None, mended: DataFrame | None = None) -> None:
        """Upsert a batch of nodes and edges (each with ``ord``), what else is given, and the batch's size in meta, in one commit.

        Rows of the files ``gone`` are taken out of all tables, those of
        ``mended`` (both with rel_path) out of diagnostics.
        """
        sizes = {"ir_version": IR_VERSION, "total_nodes": nodes.count(), "total_edges": edges.count()}
        more = {"hashes": hashes, "diagnostics": diagnostics}
        self.put(gone, mended, nodes=nodes, edges=edges, meta=self._meta(sizes), **{k: v.withColumn("ord", F.lit(0)) for k, v in more.items() if v is not None})

    def _meta(self, values: dict) -> DataFrame:
        return self.spark.createDataFrame([(k, str(v), 0) for k, v in values.items()], "key string, value string, ord int")

    def set_meta(self, key: str, value: str) -> None:
        self.put(meta=self._meta({key: value}))

    def get_meta(self, key: str) -> str | None:
        meta = self.table("meta")
        row = meta.filter(F.col("key") == key).first() if meta is not None else None
        return row["value"] if row else None
