"""References to records that do not exist, with composite keys and partial nulls.

References are grouped by their null mask (which of the key columns are null);
each mask is joined with the keys on its non-null columns only, under declared
match semantics as of the SQL standard:

``simple``   a reference with any null column is satisfied and never reported;
``full``     all null is satisfied, some null is reported as ``mixed``;
``partial``  the non-null columns must occur together in some key; all null is satisfied.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from skein.operators.skew import hot_keys

MATCHES = ("simple", "full", "partial")


def _masked(refs: DataFrame, ref_columns: Sequence[str], nulls: tuple[bool, ...]) -> DataFrame:
    keep = F.lit(True)
    for c, null in zip(ref_columns, nulls):
        keep = keep & (F.col(c).isNull() if null else F.col(c).isNotNull())
    return refs.filter(keep)


def orphans(
    refs: DataFrame,
    keys: DataFrame,
    ref_columns: Sequence[str],
    key_columns: Sequence[str],
    match: str = "simple",
    at: str | None = None,
    since: str | None = None,
    until: str | None = None,
    hot_share: float = 0.005,
) -> DataFrame:
    """The rows of ``refs`` that refer to nothing, with ``state`` and ``null_mask``.

    state: ``missing`` if no key matches; ``mixed`` under ``full`` with some
    nulls; with ``at`` (a column of refs), ``late`` if the earliest ``since``
    of the key is after it, else ``deleted`` if the earliest ``until`` isn't
    after it. A null ``at`` can only be missing. null_mask has one character
    for each key column, ``-`` where it is null and ``x`` where it isn't.
    Key rows with null key columns match nothing in those columns. Repeated
    references stay repeated; repeated keys count once (earliest times).
    All other columns of ``refs`` pass through; keys' names can't clash as
    they are renamed.

    References to a few hot keys, of any number of columns, are joined with a
    broadcast of those keys (at most 1/``hot_share`` rows), so no task gets all
    rows of a hot key; the rest are joined by shuffle.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {', '.join(MATCHES)}")
    taken = {c.lower() for c in refs.columns}
    names = [f"__key{i}" for i in range(len(key_columns))]
    times = [(since, "__since"), (until, "__until")]
    side = keys.select(*(F.col(k).alias(n) for k, n in zip(key_columns, names)), *(F.col(c).alias(n) for c, n in times if c))
    assert not taken & set(names)
    parts = []
    for nulls in product((False, True), repeat=len(ref_columns)):
        if all(nulls) or any(nulls) and match == "simple":
            continue
        mask = F.lit("".join("-" if n else "x" for n in nulls)).alias("null_mask")
        rows = _masked(refs, ref_columns, nulls)
        if any(nulls) and match == "full":
            parts.append(rows.select("*", F.lit("mixed").alias("state"), mask))
            continue
        on = [(r, n) for r, n, null in zip(ref_columns, names, nulls) if not null]
        present = side.filter(" AND ".join(f"{n} IS NOT NULL" for _, n in on)).groupBy(*(n for _, n in on)).agg(F.lit(True).alias("__there"), *(F.min(n).alias(n) for c, n in times if c))
        parts += [p.select(*refs.columns, _state(at, since, until).alias("state"), mask) for p in _joined(rows, present, on, hot_share)]
    if not parts:
        return refs.limit(0).select("*", F.lit("").alias("state"), F.lit("").alias("null_mask"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("state").isNotNull())


def _joined(rows: DataFrame, present: DataFrame, on: list[tuple[str, str]], hot_share: float) -> list[DataFrame]:
    cond = F.lit(True)
    for r, n in on:
        cond = cond & (F.col(r) == F.col(n))
    columns = [r for r, _ in on]
    hot = hot_keys(rows, columns, hot_share)
    if not hot:
        return [rows.join(present, cond, "left")]
    named = rows.sparkSession.createDataFrame(hot, StructType([StructField(f"__hot{i}", rows.schema[r].dataType) for i, r in enumerate(columns)]))
    these = F.lit(True)
    for i, r in enumerate(columns):
        these = these & (F.col(r) == F.col(f"__hot{i}"))
    few = F.broadcast(named)  # at most 1/hot_share rows
    known = F.lit(True)
    for i, (_, n) in enumerate(on):
        known = known & (F.col(n) == F.col(f"__hot{i}"))
    return [
        rows.join(few, these, "left_semi").join(F.broadcast(present.join(few, known, "left_semi")), cond, "left"),
        rows.join(few, these, "left_anti").join(present, cond, "left"),
    ]


def _state(at: str | None, since: str | None, until: str | None) -> Column:
    state = F.when(F.col("__there").isNull(), "missing")
    if at and since:
        state = state.when(F.col("__since") > F.col(at), "late")
    if at and until:
        state = state.when(F.col("__until") <= F.col(at), "deleted")
    return state


def edge_orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_id, target_id, kind, state, seen_at): edge keys whose target wasn't there at the edge's ``seen_at``.

    Edges with a null end are no keys. Unresolved names count like any other
    target; each key comes once, as all its rows have the same ``seen_at``
    (should they differ, the earliest decides).
    """
    refs = edges.select("source_id", "target_id", "kind", "seen_at").filter("source_id IS NOT NULL")
    found = orphans(refs, nodes.select("id", "seen_at", "deleted_at"), ["target_id"], ["id"], "simple", "seen_at", "seen_at", "deleted_at")
    return found.groupBy("source_id", "target_id", "kind").agg(F.min(F.struct("seen_at", "state")).alias("s")).select("source_id", "target_id", "kind", "s.state", "s.seen_at")


def orphan_report(found: DataFrame, table: str, kind: str = "kind", at: str = "seen_at") -> DataFrame:
    """(table_name, kind, month, state, n): counts of orphans per kind and month of ``at`` (null month where it is null)."""
    return found.groupBy(F.lit(table).alias("table_name"), F.col(kind).alias("kind"), F.date_format(at, "yyyy-MM").alias("month"), "state").agg(F.count(F.lit(1)).alias("n"))
