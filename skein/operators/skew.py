"""Results per key where a few keys hold most rows: eager aggregation through joins.

Both inputs of a join are first aggregated by the join key (partial aggregation
runs before the shuffle, so a key that holds a third of all rows leaves each
task as one row), the compact states are joined, and what the full join would
have given is worked out from the states: counts multiply, sums of one side are
multiplied by the count of the other. No task ever holds the rows of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_state(df: DataFrame, key: str | Column, prefix: str, sums: Sequence[str] = (), other: str | None = None) -> DataFrame:
    """One row (id, ``<prefix>_rows``, ``<prefix>_sum_<c>``..., ``<prefix>_others``) for each key.

    Null keys keep a state of their own with id null. Sums skip nulls and are
    null for a key without any value. With ``other``, distinct non-null values
    of that column are counted by a first aggregation on (key, other), whose
    keys are spread evenly, instead of a distinct aggregate on the hot key.
    """
    key = F.col(key) if isinstance(key, str) else key
    parts = [F.count(F.lit(1)).alias(f"{prefix}_rows"), *(F.sum(F.col(c)).alias(f"{prefix}_sum_{c}") for c in sums)]
    if other is None:
        return df.groupBy(key.alias("id")).agg(*parts)
    pairs = df.groupBy(key.alias("id"), F.col(other).alias("__other")).agg(*parts)
    return pairs.groupBy("id").agg(
        F.sum(f"{prefix}_rows").alias(f"{prefix}_rows"),
        *(F.sum(f"{prefix}_sum_{c}").alias(f"{prefix}_sum_{c}") for c in sums),
        F.count("__other").alias(f"{prefix}_others"),
    )


def join_states(left: DataFrame, right: DataFrame, how: str = "full") -> DataFrame:
    """Join two outputs of ``key_state`` on id; a key without rows on one side has 0 there.

    Both sides are already partitioned by id, so that the join adds no shuffle.
    The states of null keys stay apart, one from each side, as null joins nothing.
    """
    joined = left.join(right, "id", how)
    counts = [c for c in joined.columns if c.endswith(("_rows", "_others"))]
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in counts})


def eager_join_aggregate(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_sums: Sequence[str] = (), right_sums: Sequence[str] = ()) -> DataFrame:
    """Per key, the aggregates of ``left JOIN right ON left_key = right_key`` without making the join's rows.

    Columns: id, rows (of the join), ``left_sum_<c>`` and ``right_sum_<c>``
    (over the join's rows). Keys that are null or stand on one side only give
    no row, as in an inner join. Empty inputs give an empty result.
    """
    l_state = key_state(left.filter(F.col(left_key).isNotNull()), left_key, "l", left_sums)
    r_state = key_state(right.filter(F.col(right_key).isNotNull()), right_key, "r", right_sums)
    joined = l_state.join(r_state, "id")
    return joined.select(
        "id",
        (F.col("l_rows") * F.col("r_rows")).alias("rows"),
        *((F.col(f"l_sum_{c}") * F.col("r_rows")).alias(f"left_sum_{c}") for c in left_sums),
        *((F.col(f"r_sum_{c}") * F.col("l_rows")).alias(f"right_sum_{c}") for c in right_sums),
    )


def fan_states(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(id, out_rows, in_rows[, out_others, in_others]): what stands at each id of either end.

    Every stored row counts; a row with one null end counts at its other end.
    The states of null ends are kept as rows with a null id (their counts are
    needed for totals). With ``distinct``, rows are first aggregated to the
    distinct pairs of ends, whose keys are spread evenly, and both sides are
    rolled up from these pairs in one more aggregation.
    """
    if not distinct:
        return join_states(key_state(edges.select("source_id"), "source_id", "out"), key_state(edges.select("target_id"), "target_id", "in"))
    pairs = edges.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    other = lambda c: F.col(c).isNotNull().cast("bigint")
    ends = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("source_id").alias("id"), F.col("n").alias("out_rows"), zero.alias("in_rows"), other("target_id").alias("out_others"), zero.alias("in_others")),
                F.struct(F.col("target_id").alias("id"), zero.alias("out_rows"), F.col("n").alias("in_rows"), zero.alias("out_others"), other("source_id").alias("in_others")),
            )
        )
    )
    # an id without rows on a side has 0 there; null ends have a row of their own, as in the join of states
    return ends.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("out_rows", "in_rows", "out_others", "in_others")))


def hot_ids(edges: DataFrame, share: float = 0.02) -> DataFrame:
    """(side, id): ids that hold at least ``share`` of all stored rows in one column.

    An id can be hot on both sides and then has two rows. Null is no id. An
    empty table has none.
    """
    total = edges.count()  # from the Parquet footers; one number
    per_id = fan_states(edges).filter(F.col("id").isNotNull())
    least = F.lit(share) * F.lit(total)
    sides = per_id.select("id", F.inline(F.array(F.struct(F.lit("source_id").alias("side"), F.col("out_rows").alias("n")), F.struct(F.lit("target_id").alias("side"), F.col("in_rows").alias("n")))))
    # a share that floating point puts a hair above the whole number must not drop a tie
    return sides.filter((F.col("n") > 0) & (F.col("n") >= least - 1e-6)).select("side", "id")


def hot_keys(df: DataFrame, columns: Sequence[str], share: float = 0.005) -> list[tuple]:
    """Keys (without nulls) that hold at least ``share`` of the rows: at most 1/share of them, so safe to hold on the driver."""
    counts = df.dropna(subset=list(columns)).groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    total = df.count()
    return [tuple(r)[:-1] for r in counts.filter(F.col("__n") >= F.lit(max(1.0, share * total))).collect()] if total else []


def hot_values(df: DataFrame, column: str, share: float = 0.005) -> list[str]:
    """``hot_keys`` of one column."""
    return [k for (k,) in hot_keys(df, [column], share)]
