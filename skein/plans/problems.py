"""Queries of the general data-processing problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import hierarchy as H
from skein.operators import references as R
from skein.operators import skew as S
from skein.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return S.hot_ids(table(spark, d, "edges", "source_id", "target_id"), 0.02)


def p1_fan(spark: SparkSession, d: str) -> DataFrame:
    """Fan-in and fan-out of every id, in rows and in distinct partners, and the two-link walks through it."""
    fan = S.fan_states(table(spark, d, "edges", "source_id", "target_id"), distinct=True).filter("id IS NOT NULL")
    return fan.select("id", "out_rows", "in_rows", "out_others", "in_others", (F.col("in_rows") * F.col("out_rows")).alias("walks"))


def p1_kind_walks(spark: SparkSession, d: str) -> DataFrame:
    """Rolled up by kind: rows of edges joined with edges of the same kind on target = source, never made one by one."""
    edges = table(spark, d, "edges", "source_id", "target_id", "kind")
    into = edges.filter("target_id IS NOT NULL").groupBy(F.col("target_id").alias("id"), "kind").agg(F.count(F.lit(1)).alias("n"))
    out = edges.filter("source_id IS NOT NULL").groupBy(F.col("source_id").alias("id"), F.col("kind").alias("next_kind")).agg(F.count(F.lit(1)).alias("m"))
    return into.join(out, "id").groupBy("kind", "next_kind").agg(F.sum(F.col("n") * F.col("m")).alias("walks"), F.count(F.lit(1)).alias("ids"))


def _contains(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edges", "source_id", "target_id", "kind").filter("kind = 'contains'")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return H.deep_or_looped(_contains(spark, d), "target_id", "source_id", 12)


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every id with its state, root, depth and full path."""
    tree = H.hierarchy(_contains(spark, d), "target_id", "source_id", paths=True)
    return tree.select("id", "state", "root_id", "depth", F.array_join("path", " > ").alias("path"))


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of an id and a descendant of it, with their distance."""
    return H.descendants(H.hierarchy(_contains(spark, d), "target_id", "source_id", paths=True))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _edge_orphans(spark, d).select("source_id", "target_id", "kind", "state")


def _edge_orphans(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges", "source_id", "target_id", "kind", "seen_at")
    return R.edge_orphans(edges, table(spark, d, "nodes", "id", "seen_at", "deleted_at"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of every declared reference per table, kind and month: edges to nodes, nodes to files, diagnostics and files to builds and files."""
    nodes = table(spark, d, "nodes", "id", "kind", "file_path", "seen_at").distinct()
    no_file = R.orphans(nodes, table(spark, d, "files", "rel_path"), ["file_path"], ["rel_path"])
    files = table(spark, d, "files", "rel_path", "language", "repo", "build_id", "scanned_at").distinct()
    no_build = R.orphans(files, table(spark, d, "builds", "repo", "build_id"), ["repo", "build_id"], ["repo", "build_id"], "partial")
    reports = [R.orphan_report(_edge_orphans(spark, d), "edges"), R.orphan_report(no_file, "nodes"), R.orphan_report(no_build, "files", "language", "scanned_at"), R.orphan_report(p5_diagnostics(spark, d), "diagnostics", "severity", "logged_at")]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def p5_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics whose (file, build) isn't wholly known (match full): no row of files has it, or one of the two is null."""
    refs = table(spark, d, "diagnostics", "file_path", "build_id", "line", "message", "severity", "logged_at").distinct()
    return R.orphans(refs, table(spark, d, "files", "rel_path", "build_id"), ["file_path", "build_id"], ["rel_path", "build_id"], "full")


def _symbols(match: str):
    """Edges that name a symbol (file, module path, name) that no node is; names that weren't resolved have no module path."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        def parts(df: DataFrame, column: str, prefix: str) -> DataFrame:
            key = F.split(column, "::")
            blank = lambda c: F.when(c != "", c)
            return df.withColumns({f"{prefix}_file": blank(F.get(key, F.lit(0))), f"{prefix}_module": blank(F.get(key, F.lit(1))), f"{prefix}_name": blank(F.get(key, F.lit(2)))})

        refs = parts(table(spark, d, "edges", "source_id", "target_id", "kind").distinct(), "target_id", "to")
        keys = parts(table(spark, d, "nodes", "id"), "id", "own")
        names = ("file", "module", "name")
        return R.orphans(refs, keys, [f"to_{x}" for x in names], [f"own_{x}" for x in names], match).select("source_id", "target_id", "kind", "state", "null_mask")

    return run


QUERIES = {f.__name__: f for f in (p1_found, p1_fan, p1_kind_walks, p3_found, p3_paths, p3_descendants, p5_found, p5_report, p5_diagnostics)} | {f"p5_symbols_{m}": _symbols(m) for m in R.MATCHES}

_CHAIN = """
WITH RECURSIVE pairs AS (SELECT target_id AS child, min(source_id) AS parent FROM edges WHERE kind = 'contains' AND source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1),
ids AS (SELECT child AS id FROM pairs UNION SELECT parent FROM pairs),
tops AS (SELECT id FROM ids WHERE id NOT IN (SELECT child FROM pairs)),
tree(id, root_id, depth, path) AS (SELECT id, id, 0::BIGINT, id FROM tops UNION ALL SELECT p.child, t.root_id, t.depth + 1, t.path || ' > ' || p.child FROM tree t JOIN pairs p ON p.parent = t.id),
rest AS (SELECT * FROM pairs WHERE child NOT IN (SELECT id FROM tree)),
up(id, cur, steps) AS (SELECT child, parent, 1::BIGINT FROM rest UNION ALL SELECT u.id, r.parent, u.steps + 1 FROM up u JOIN rest r ON r.child = u.cur WHERE u.steps < (SELECT count(*) FROM rest)),
loops AS (SELECT id, least(id, min(cur)) AS root_id FROM up WHERE id IN (SELECT u.id FROM up u WHERE u.cur = u.id) GROUP BY id)
"""
_ORPHANS = """
WITH k AS (SELECT source_id, target_id, kind, min(seen_at) AS seen_at FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL GROUP BY 1, 2, 3),
n AS (SELECT id, min(seen_at) AS since, min(deleted_at) AS until FROM nodes GROUP BY 1),
o AS (SELECT k.*, CASE WHEN n.id IS NULL THEN 'missing' WHEN n.since > k.seen_at THEN 'late' WHEN n.until <= k.seen_at THEN 'deleted' END AS state FROM k LEFT JOIN n ON n.id = k.target_id)
"""

ORACLES = {
    "p1_found": """SELECT 'source_id' AS side, source_id AS id FROM edges WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)
UNION ALL SELECT 'target_id', target_id FROM edges WHERE target_id IS NOT NULL GROUP BY target_id HAVING count(*) >= 0.02 * (SELECT count(*) FROM edges)""",
    "p1_fan": """WITH o AS (SELECT source_id AS id, count(*) AS r, count(DISTINCT target_id) AS d FROM edges WHERE source_id IS NOT NULL GROUP BY 1),
i AS (SELECT target_id AS id, count(*) AS r, count(DISTINCT source_id) AS d FROM edges WHERE target_id IS NOT NULL GROUP BY 1)
SELECT id, coalesce(o.r, 0) AS out_rows, coalesce(i.r, 0) AS in_rows, coalesce(o.d, 0) AS out_others, coalesce(i.d, 0) AS in_others, coalesce(o.r, 0) * coalesce(i.r, 0) AS walks FROM o FULL JOIN i USING (id)""",
    "p1_kind_walks": "SELECT a.kind, b.kind AS next_kind, count(*) AS walks, count(DISTINCT a.target_id) AS ids FROM edges a JOIN edges b ON a.target_id = b.source_id GROUP BY 1, 2",
    "p3_found": _CHAIN + "SELECT id, root_id, depth FROM tree WHERE depth >= 12 UNION ALL SELECT id, root_id, -1 FROM loops",
    "p3_paths": _CHAIN
    + """SELECT id, 'tree' AS state, root_id, depth, path FROM tree UNION ALL SELECT id, 'loop', root_id, -1, NULL FROM loops
UNION ALL SELECT DISTINCT u.id, 'below_loop', l.root_id, -1, NULL FROM up u JOIN loops l ON l.id = u.cur WHERE u.id NOT IN (SELECT id FROM loops)""",
    "p3_descendants": _CHAIN
    + ", pairs2(ancestor_id, id, distance) AS (SELECT parent, child, 1::BIGINT FROM pairs WHERE child IN (SELECT id FROM tree) UNION ALL SELECT a.ancestor_id, p.child, a.distance + 1 FROM pairs2 a JOIN pairs p ON p.parent = a.id) SELECT * FROM pairs2",
    "p5_found": _ORPHANS + "SELECT source_id, target_id, kind, state FROM o WHERE state IS NOT NULL",
    "p5_report": _ORPHANS
    + """, d AS (SELECT DISTINCT file_path, build_id, line, message, severity, logged_at FROM diagnostics),
r AS (SELECT 'edges' AS table_name, kind, seen_at AS happened, state FROM o WHERE state IS NOT NULL
UNION ALL SELECT 'nodes', kind, seen_at, 'missing' FROM (SELECT DISTINCT id, kind, file_path, seen_at FROM nodes) x WHERE file_path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.rel_path = x.file_path)
UNION ALL SELECT 'files', language, scanned_at, 'missing' FROM (SELECT DISTINCT rel_path, language, repo, build_id, scanned_at FROM files) x WHERE (repo IS NOT NULL OR build_id IS NOT NULL) AND NOT EXISTS (SELECT 1 FROM builds b WHERE (x.repo IS NULL OR b.repo = x.repo) AND (x.build_id IS NULL OR b.build_id = x.build_id))
UNION ALL SELECT 'diagnostics', severity, logged_at, 'mixed' FROM d WHERE (file_path IS NULL) <> (build_id IS NULL)
UNION ALL SELECT 'diagnostics', severity, logged_at, 'missing' FROM d WHERE file_path IS NOT NULL AND build_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.rel_path = d.file_path AND f.build_id = d.build_id))
SELECT table_name, kind, strftime(happened, '%Y-%m') AS month, state, count(*) AS n FROM r GROUP BY ALL""",
    "p5_diagnostics": """WITH r AS (SELECT DISTINCT file_path, build_id, line, message, severity, logged_at FROM diagnostics)
SELECT *, CASE WHEN file_path IS NULL OR build_id IS NULL THEN 'mixed' ELSE 'missing' END AS state, (CASE WHEN file_path IS NULL THEN '-' ELSE 'x' END) || (CASE WHEN build_id IS NULL THEN '-' ELSE 'x' END) AS null_mask FROM r
WHERE (file_path IS NULL) <> (build_id IS NULL) OR file_path IS NOT NULL AND build_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM files f WHERE f.rel_path = r.file_path AND f.build_id = r.build_id)""",
}

_PARTS = "nullif(split_part({0}, '::', 1), '') AS f, nullif(split_part({0}, '::', 2), '') AS m, nullif(split_part({0}, '::', 3), '') AS n"
_SYMBOLS = f"""WITH e AS (SELECT *, (CASE WHEN f IS NULL THEN '-' ELSE 'x' END) || (CASE WHEN m IS NULL THEN '-' ELSE 'x' END) || (CASE WHEN n IS NULL THEN '-' ELSE 'x' END) AS null_mask
FROM (SELECT DISTINCT source_id, target_id, kind, {_PARTS.format('target_id')} FROM edges)), k AS (SELECT DISTINCT {_PARTS.format('id')} FROM nodes),
h AS (SELECT e.*, EXISTS (SELECT 1 FROM k WHERE k.f = e.f AND k.m = e.m AND k.n = e.n) AS whole, EXISTS (SELECT 1 FROM k WHERE k.f = e.f AND k.n = e.n) AS named, EXISTS (SELECT 1 FROM k WHERE k.f = e.f) AS filed FROM e)
SELECT source_id, target_id, kind, state, null_mask FROM (SELECT *, CASE {{}} END AS state FROM h) WHERE state IS NOT NULL"""
# targets have a file and a name, so that the masks are xxx and x-x (and --- for a null target)
ORACLES |= {
    "p5_symbols_simple": _SYMBOLS.format("WHEN null_mask = 'xxx' AND NOT whole THEN 'missing'"),
    "p5_symbols_partial": _SYMBOLS.format("WHEN null_mask = 'xxx' AND NOT whole OR null_mask = 'x-x' AND NOT named THEN 'missing'"),
    "p5_symbols_full": _SYMBOLS.format("WHEN null_mask = 'xxx' AND NOT whole THEN 'missing' WHEN null_mask NOT IN ('xxx', '---') THEN 'mixed'"),
}
