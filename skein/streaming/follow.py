"""Following a folder of file snapshots: each micro-batch is extracted and put into the store, as an incremental build does."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators import extract as X
from skein.operators.resolve import resolve_calls
from skein.operators.store import Store, latest
from skein.scratch import Scratch

FILES = "rel_path string, language string, content string, content_hash string, scanned_at timestamp"


def put_batch(batch: DataFrame, store: Store) -> None:
    """The latest snapshot of each path whose hash isn't the stored one is extracted and upserted; replays change nothing.

    Only the buckets of these paths are read and written again.
    """
    scratch = Scratch(batch.sparkSession, "follow")
    current = latest(batch, ["rel_path"], ["scanned_at", "content_hash"])
    known = store.table("hashes")
    if known is not None:
        current = current.join(known.select("rel_path", "content_hash"), ["rel_path", "content_hash"], "left_anti")
    current = scratch.save(current)
    rows = scratch.save(X.extract(current))
    nodes = X.nodes(rows)
    if not rows.isEmpty():
        store.persist(nodes, resolve_calls(X.edges(rows), nodes).drop("rel_path", "resolved"), current.select("rel_path", "content_hash"), X.diagnostics(rows), mended=current.select("rel_path"))
    scratch.clear()


def follow(spark: SparkSession, incoming: str, folder: str, checkpoint: str) -> StreamingQuery:
    """Start a query over Parquet snapshots of files (FILES) that arrive in ``incoming``."""
    store = Store(spark, folder)
    stream = spark.readStream.schema(FILES).parquet(incoming).filter(F.col("rel_path").isNotNull())
    return stream.writeStream.foreachBatch(lambda batch, _: put_batch(batch, store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
