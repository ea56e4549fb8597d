"""Queries of the code-graph engine over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import ids
from skein.operators import extract as X
from skein.operators import graph as G
from skein.operators import incremental as I
from skein.operators import resolve as C
from skein.operators import search as S
from skein.operators import semantic as M
from skein.operators.store import EDGE_KEY, NODE_KEY, latest
from skein.scratch import Scratch, spread
from skein.sources.tables import table

CUTOFF = "2024-03-01 00:00:00"


def now_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The store's nodes: of the rows of an id the last that was seen."""
    columns = ("id", "kind", "name", "file_path", "line_start", "line_end", "visibility", "metadata_json", "semantic_json", "seen_at", "ingested_at")
    return latest(table(spark, d, "nodes", *columns), NODE_KEY, ["seen_at", "ingested_at"])


def now_edges(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "edges", "source_id", "target_id", "kind", "metadata_json", "seen_at", "ingested_at"), EDGE_KEY, ["seen_at", "ingested_at"])


def now_files(spark: SparkSession, d: str) -> DataFrame:
    return latest(table(spark, d, "files", "rel_path", "content_hash", "scanned_at", "ingested_at"), ["rel_path"], ["scanned_at", "ingested_at"])


def e2_nodes_upsert(spark, d):
    return now_nodes(spark, d).select("id", "kind", "name", "file_path", F.col("line_start").cast("string").alias("line_start"), F.col("line_end").cast("string").alias("line_end"), "visibility", "metadata_json")


def e3_edges_upsert(spark, d):
    return now_edges(spark, d).select("source_id", "target_id", "kind", "metadata_json")


def a3_languages(spark, d):
    paths = table(spark, d, "files", "path").distinct()
    return paths.groupBy(ids.language(F.col("path")).alias("language")).agg(F.count(F.lit(1)).alias("n")).filter("language IS NOT NULL")


def a6_id_parts(spark, d):
    key = ids.parse_key(F.col("id"))
    return table(spark, d, "nodes", "id").dropna().distinct().select("id", key["file_path"].alias("file_path"), F.array_join(key["module_path"], ".").alias("module_path"), key["name"].alias("name"), key["signature_hash"].alias("signature_hash"), ids.display(F.col("id")).alias("shown"))


def a6_decoded_nodes(spark, d):
    """Distinct stored nodes as they are read back."""
    return ids.decoded_nodes(table(spark, d, "nodes", "id", "kind", "name", "file_path", "visibility", "metadata_json", "semantic_json").distinct())


def a6_decoded_edges(spark, d):
    return ids.decoded_edges(table(spark, d, "edges", "source_id", "target_id", "kind", "metadata_json").distinct())


def g3_result_count(spark, d):
    return G.result_count(G.callers(now_nodes(spark, d), now_edges(spark, d), "open_span", 1))


def g3_import_names(spark, d):
    return G.import_names(now_edges(spark, d))


def h2_folded_words(spark, d):
    """How many documents hold each of the common words, without regard to case and diacritics."""
    words = table(spark, d, "common_words", "word").select(S.folded(F.col("word")).alias("word")).dropna().distinct()
    held = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(S.tokens(F.col("text")))).alias("word"))
    return held.join(words, "word").groupBy("word").agg(F.countDistinct("doc_id").alias("documents"))


def i8_cache_size(spark, d):
    return M.cache_size(now_nodes(spark, d))


def m_by_risk(spark, d):
    return M.by_risk(now_nodes(spark, d), "high").select("id", "name")


def m_by_purpose(spark, d):
    return M.by_purpose(now_nodes(spark, d), ["Liefert", "zuruck"]).select("id", "name")


def a7_find_keys(spark, d):
    return G.find_keys(now_nodes(spark, d), "open_span")


def b18_module_paths(spark, d):
    return table(spark, d, "files", "rel_path").distinct().select("rel_path", F.array_join(ids.module_path(F.col("rel_path")), ".").alias("module_path"))


def _extracted(spark, d):
    files = table(spark, d, "files", "rel_path", "content").dropDuplicates(["rel_path"])
    return X.extract(spread(files.withColumn("language", ids.language(F.col("rel_path")))))


def b2_extract_nodes(spark, d):
    return X.nodes(_extracted(spark, d))


def b10_extract_edges(spark, d):
    return X.edges(_extracted(spark, d))


def d7_extract_diagnostics(spark, d):
    return X.diagnostics(_extracted(spark, d))


def _ordered(spark, d):
    nodes = now_nodes(spark, d).withColumn("ord", F.col("line_start"))
    return nodes, now_edges(spark, d).withColumn("ord", F.unix_micros(F.col("seen_at").cast("timestamp"))).drop("seen_at", "ingested_at")


def c4_import_files(spark, d):
    nodes, edges = _ordered(spark, d)
    return C.import_files(edges, C.file_paths(nodes), many=True)


def c6_resolved_calls(spark, d):
    nodes, edges = _ordered(spark, d)
    out = C.resolve_calls(edges, nodes, many=True).filter("kind = 'calls'")
    return out.groupBy("source_id", "target_id", ids.target_name(F.col("metadata_json")).alias("target_name"), "resolved").agg(F.count(F.lit(1)).alias("n"))


def d4_changes(spark, d):
    before = latest(table(spark, d, "files", "rel_path", "content_hash", "scanned_at", "ingested_at").filter(F.col("scanned_at") < F.lit(CUTOFF).cast("timestamp")), ["rel_path"], ["scanned_at", "ingested_at"])
    return I.changes(now_files(spark, d), before)


def d6_build_report(spark, d):
    """Per repository: builds, files of the last build as reported, and files that are stored now."""
    builds = latest(table(spark, d, "builds"), ["build_id"], ["started_at"])
    reported = builds.groupBy("repo").agg(F.count(F.lit(1)).alias("builds"), F.max(F.struct("started_at", "build_id", "files_scanned")).alias("last"))
    stored = now_files(spark, d).groupBy(F.substring_index("rel_path", "/", 1).alias("repo")).agg(F.count(F.lit(1)).alias("stored"))
    return reported.join(stored, "repo", "left").select("repo", "builds", F.col("last.files_scanned").cast("string").alias("reported"), F.coalesce("stored", F.lit(0).cast("bigint")).alias("stored"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", "kind", "name", "file_path")


def _walk(how, name, depth):
    def run(spark, d):
        nodes, edges = now_nodes(spark, d), now_edges(spark, d)
        if depth > 1 or how is G.neighbors:  # several joins read the current state, which a store would hold: it is worked out once
            scratch = Scratch(spark, "current")
            nodes, edges = scratch.save(nodes.select(*G.SHOWN)), scratch.save(edges.filter("kind = 'calls'").select(*EDGE_KEY, "metadata_json"))
        return _shown(how(nodes, edges, name, depth))

    return run


def f3_imports_of_file(spark, d):
    return G.imports_of_file(now_edges(spark, d), "%/TEST_%.py").select("source_id", "target_id", "metadata_json")


def f4_dependencies(spark, d):
    return _shown(G.dependencies(now_nodes(spark, d), now_edges(spark, d), "touch_all"))


def f5_dependents(spark, d):
    return _shown(G.dependents(now_nodes(spark, d), now_edges(spark, d), "open_span"))


def f7_list_nodes(spark, d):
    return G.list_nodes(now_nodes(spark, d), "class").select("id", "name", "file_path")


def g1_count_nodes(spark, d):
    return G.count_nodes(now_nodes(spark, d))


def g2_totals(spark, d):
    return G.totals(now_nodes(spark, d), now_edges(spark, d))


def e6_text_lines(spark, d):
    return G.as_text(now_nodes(spark, d).filter("kind = 'trait'"))


def h1_token_counts(spark, d):
    """How many nodes hold each token, and how often."""
    return S.postings(now_nodes(spark, d)).groupBy("token").agg(F.count(F.lit(1)).alias("times"), F.countDistinct("id").alias("nodes"))


def _search(**terms):
    def run(spark, d):
        return S.search(now_nodes(spark, d), **terms).select("id", F.round("rank", 9).alias("rank"))

    return run


def i4_prompts(spark, d):
    snippets = table(spark, d, "files", "rel_path", "content").dropDuplicates(["rel_path"]).withColumnRenamed("rel_path", "file_path")
    return M.prompts(now_nodes(spark, d).filter("kind IN ('function', 'method', 'class')"), snippets)


def i6_candidates(spark, d):
    return M.candidates(now_nodes(spark, d)).select("id", "name", "signature")


def i7_parsed_replies(spark, d):
    """The records' JSON read as replies of a provider."""
    parsed = table(spark, d, "nodes", "id", "semantic_json").dropna().distinct().select("id", M.parse_reply("semantic_json").alias("s"))
    return parsed.filter("s IS NOT NULL").select("id", "s.purpose", "s.summary", F.size("s.risks").alias("risks"))


def m_contained(spark, d):
    return _shown(G.contained(now_nodes(spark, d), now_edges(spark, d), "src"))


def m_edges_of_kind(spark, d):
    return G.list_edges(now_edges(spark, d), "inherits").select("source_id", "target_id")


_FUNCTIONS = (e2_nodes_upsert, e3_edges_upsert, a3_languages, a6_id_parts, a6_decoded_nodes, a6_decoded_edges, g3_result_count, g3_import_names, h2_folded_words, i8_cache_size, m_by_risk, m_by_purpose, a7_find_keys, b18_module_paths, b2_extract_nodes, b10_extract_edges, d7_extract_diagnostics, c4_import_files, c6_resolved_calls, d4_changes, d6_build_report, f3_imports_of_file, f4_dependencies, f5_dependents, f7_list_nodes, g1_count_nodes, g2_totals, e6_text_lines, h1_token_counts, i4_prompts, i6_candidates, i7_parsed_replies, m_contained, m_edges_of_kind)
QUERIES = {f.__name__: f for f in _FUNCTIONS} | {
    "f1_callers_1": _walk(G.callers, "wrap_fault", 1),
    "f1_callers_2": _walk(G.callers, "lookup_setting", 2),
    "f2_callees_1": _walk(G.callees, "touch_all", 1),
    "f2_callees_2": _walk(G.callees, "warm_everything", 2),
    "f2_callees_3": _walk(G.callees, "touch_all", 3),
    "f6_neighbors": _walk(G.neighbors, "open_span", 1),
    "h3_search_all": _search(every=["sensor", "py"]),
    "h3_search_some_never": _search(some=["sensor", "ledger*"], never=["test"]),
    "h3_search_phrase": _search(every=["emit count*"]),
}


def _now(name: str, key: str, order: str, columns: str) -> str:
    tail = ", ".join(f"{c} DESC NULLS LAST" for c in (order + ", " + columns).split(", "))
    return f"{name}_now AS (SELECT * FROM {name} WHERE {' AND '.join(k + ' IS NOT NULL' for k in key.split(', '))} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {tail}) = 1)"


_NODES = _now("nodes", "id", "seen_at, ingested_at", "kind, name, file_path, line_start, line_end, visibility, metadata_json, semantic_json")
_EDGES = _now("edges", "source_id, target_id, kind", "seen_at, ingested_at", "metadata_json")
_FILES = _now("files", "rel_path", "scanned_at, ingested_at", "content_hash")
_IMPORTS = """w AS (SELECT split_part(source_id, '::', 1) AS file, split_part(target_id, '::', 3) AS name, epoch_us(seen_at) AS ord, coalesce(json_extract_string(metadata_json, '$.import_module'), split_part(target_id, '::', 3)) AS m FROM edges_now WHERE kind = 'imports'),
f AS (SELECT DISTINCT file_path FROM nodes_now WHERE kind = 'file'),
x AS (SELECT file, name, ord, m, r, split_part(file, '/', 1) || '/' || CASE r WHEN 0 THEN m || '.py' WHEN 1 THEN replace(m, '.', '/') || '.py' ELSE replace(m, '.', '/') || '/__init__.py' END AS imported FROM w, (VALUES (0), (1), (2)) t(r)),
y AS (SELECT file, name, ord, arg_min(imported, r) AS imported FROM x JOIN f ON f.file_path = x.imported GROUP BY file, name, ord),
i AS (SELECT file, imported FROM y QUALIFY row_number() OVER (PARTITION BY file, name ORDER BY ord DESC NULLS LAST, imported DESC) = 1)"""
_GRAPH = f"WITH RECURSIVE {_NODES}, {_EDGES}, calls AS (SELECT source_id, json_extract_string(metadata_json, '$.target_name') AS target_name FROM edges_now WHERE kind = 'calls' AND json_extract_string(metadata_json, '$.target_name') IS NOT NULL), links AS (SELECT DISTINCT n.name AS source_name, c.target_name FROM calls c JOIN nodes_now n ON n.id = c.source_id)"
_SHOWN = "n.id, n.kind, n.name, n.file_path"


def _callers(name: str, depth: int) -> str:
    return f"{_GRAPH}, r(name, lvl) AS (SELECT '{name}', 1 UNION SELECT l.source_name, r.lvl + 1 FROM r JOIN links l ON l.target_name = r.name WHERE r.lvl < {depth}) SELECT {_SHOWN} FROM calls c JOIN (SELECT DISTINCT name FROM r) x ON x.name = c.target_name JOIN nodes_now n ON n.id = c.source_id"


def _callees(name: str, depth: int) -> str:
    return f"{_GRAPH}, r(name, lvl) AS (SELECT '{name}', 1 UNION SELECT l.target_name, r.lvl + 1 FROM r JOIN links l ON l.source_name = r.name WHERE r.lvl < {depth}) SELECT {_SHOWN} FROM calls c JOIN nodes_now s ON s.id = c.source_id JOIN (SELECT DISTINCT name FROM r) x ON x.name = s.name JOIN nodes_now n ON n.name = c.target_name"


_TOKENS = "list_filter(regexp_split_to_array(lower(strip_accents(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_DOCS = f"WITH {_NODES}, t AS (SELECT id, {_TOKENS.format('name')} AS a, {_TOKENS.format('file_path')} AS b FROM nodes_now)"


def _ranked(counts: dict[str, str], where: str) -> str:
    """``counts``: name of each term's count and its SQL over the token lists a and b."""
    fs = ", ".join(f"{sql} AS {f}" for f, sql in counts.items())
    ns = ", ".join(f"count(*) FILTER (WHERE {f} > 0) AS n{f}" for f in counts)
    score = " ".join(f"- greatest(ln((n - n{f} + 0.5) / (n{f} + 0.5)), 1e-6) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * length / mean))" for f in counts)
    return f"{_DOCS}, c AS (SELECT id, len(a) + len(b) AS length, {fs}, a, b FROM t), z AS (SELECT count(*) AS n, avg(length) AS mean, {ns} FROM c) SELECT id, round(rank, 9) AS rank FROM (SELECT id, 0.0 {score} AS rank FROM c, z WHERE {where} ORDER BY rank, id LIMIT 50)"


def _count(test: str) -> str:
    return f"len(list_filter(a, lambda x: {test})) + len(list_filter(b, lambda x: {test}))"


def _pairs(first: str, second: str) -> str:
    one = "len(list_filter(range(1, len({0})), lambda i: {0}[i] = '" + first + "' AND starts_with({0}[i + 1], '" + second + "')))"
    return one.format("a") + " + " + one.format("b")


_OBJECT = "CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' THEN {0} END"
_READ = _OBJECT.format("semantic_json")
_KEY = "len(string_split({0}, '::')) >= 4 AND regexp_full_match(array_to_string(string_split({0}, '::')[4:], '::'), '[0-9a-fA-F]{{1,16}}')"
_OPEN = f"o AS (SELECT *, string_split(id, '::')[-1] AS signature FROM (SELECT *, {_READ} AS record FROM nodes_now) WHERE kind IN ('function', 'method', 'class') AND coalesce(trim(json_extract_string(record, '$.summary')), '') = '')"
_FENCED = r"regexp_replace(regexp_replace(semantic_json, '\s+$', ''), '^\s*```[a-zA-Z]*\s*|\s*```$', '', 'g')"
_RECORDS = f"r AS (SELECT *, {_READ} AS record FROM nodes_now), z AS (SELECT * FROM r WHERE record IS NOT NULL)"
_PROMPTS = f"""WITH {_NODES}, s AS (SELECT rel_path, any_value(content) AS content FROM files GROUP BY 1),
c AS (SELECT rel_path, CASE WHEN strlen(content) > 2000 THEN left(content, (SELECT max(k) FROM range(0, 2001) t(k) WHERE strlen(left(content, k)) <= 2000)) || '...' ELSE content END AS snippet FROM s),
n AS (SELECT nodes_now.*, {_OBJECT.format("metadata_json")} AS m, {_READ} AS record, snippet FROM nodes_now LEFT JOIN c ON c.rel_path = nodes_now.file_path WHERE kind IN ('function', 'method', 'class'))
SELECT id, concat_ws(chr(10), 'Decorators: ' || array_to_string(from_json(json_extract(m, '$.decorators'), '["VARCHAR"]'), ', '), 'Decorator: ' || json_extract_string(m, '$.decorator'), CASE WHEN json_extract_string(m, '$.async') = 'true' THEN 'Async: true' END,
upper(kind[1]) || kind[2:] || ': ' || name,
'Parameters: ' || array_to_string(list_transform(from_json(json_extract(m, '$.parameters'), '[{{"name":"VARCHAR","type":"VARCHAR"}}]'), lambda p: p.name || coalesce(': ' || p.type, '')), ', '), 'Returns: ' || json_extract_string(m, '$.return_type'),
'Docstring: ' || json_extract_string(record, '$.purpose'), 'File: ' || file_path || ':' || coalesce(line_start, 0), '```' || chr(10) || snippet || chr(10) || '```') AS prompt FROM n"""

ORACLES = {
    "a6_decoded_nodes": f"""SELECT CASE WHEN {_KEY.format('id')} THEN id ELSE concat_ws('::', file_path, '', name, repeat('0', 16)) END AS id,
CASE WHEN kind IN ('file', 'module', 'function', 'method', 'class', 'struct', 'enum', 'enum_variant', 'trait', 'trait_impl', 'interface', 'type_alias', 'constant', 'static', 'variable') THEN kind ELSE 'function' END AS kind, name, file_path,
CASE WHEN visibility IN ('private', 'protected') THEN visibility ELSE 'public' END AS visibility, coalesce({_OBJECT.format("metadata_json")}, '{{}}') AS metadata_json, {_READ} AS semantic_json
FROM (SELECT DISTINCT id, kind, name, file_path, visibility, metadata_json, semantic_json FROM nodes)""",
    "a6_decoded_edges": f"""SELECT CASE WHEN source_id IS NULL OR {_KEY.format('source_id')} THEN source_id ELSE 'unknown::::' || source_id || '::' || repeat('0', 16) END AS source_id,
CASE WHEN target_id IS NULL OR {_KEY.format('target_id')} THEN target_id ELSE 'unknown::::' || target_id || '::' || repeat('0', 16) END AS target_id,
CASE WHEN kind IN ('calls', 'imports', 'contains', 'inherits', 'instantiates', 'references', 'depends_on') THEN kind ELSE 'calls' END AS kind, coalesce({_OBJECT.format("metadata_json")}, '{{}}') AS metadata_json
FROM (SELECT DISTINCT source_id, target_id, kind, metadata_json FROM edges)""",
    "g3_result_count": f"SELECT count(*) AS n, count(DISTINCT id) AS distinct_ids FROM ({_callers('open_span', 1)})",
    "g3_import_names": f"WITH {_EDGES} SELECT split_part(source_id, '::', 1) AS file, count(*) AS n, string_agg(split_part(target_id, '::', 3), ', ' ORDER BY split_part(target_id, '::', 3)) AS names FROM edges_now WHERE kind = 'imports' GROUP BY 1",
    "h2_folded_words": f"WITH c AS (SELECT DISTINCT lower(strip_accents(word)) AS word FROM common_words WHERE word IS NOT NULL), t AS (SELECT doc_id, unnest({_TOKENS.format('text')}) AS word FROM documents) SELECT word, count(DISTINCT doc_id) AS documents FROM t JOIN c USING (word) GROUP BY 1",
    "i4_prompts": _PROMPTS,
    "i6_candidates": f"WITH {_NODES}, {_OPEN} SELECT id, name, signature FROM o",
    "i7_parsed_replies": f"""WITH b AS (SELECT id, {_FENCED} AS bare FROM (SELECT DISTINCT id, semantic_json FROM nodes WHERE id IS NOT NULL AND semantic_json IS NOT NULL)), v AS (SELECT id, {_OBJECT.format("bare")} AS r FROM b)
SELECT id, json_extract_string(r, '$.purpose') AS purpose, json_extract_string(r, '$.summary') AS summary, coalesce(json_array_length(r, '$.risks'), 0)::INT AS risks FROM v WHERE r IS NOT NULL""",
    "i8_cache_size": f"WITH {_NODES}, {_OPEN} SELECT count(*) AS n FROM (SELECT DISTINCT name, signature FROM o)",
    "m_by_risk": f"WITH {_NODES}, {_RECORDS} SELECT id, name FROM z WHERE len(list_filter(from_json(json_extract(record, '$.risks'), '[{{\"severity\":\"VARCHAR\"}}]'), lambda x: lower(x.severity) IN ('high', 'critical'))) > 0",
    "m_by_purpose": f"WITH {_NODES}, {_RECORDS} SELECT id, name FROM (SELECT *, {_TOKENS.format("json_extract_string(record, '$.purpose')")} AS w FROM z) WHERE list_contains(w, 'liefert') AND list_contains(w, 'zuruck')",
    "e2_nodes_upsert": f"WITH {_NODES} SELECT id, kind, name, file_path, line_start::VARCHAR AS line_start, line_end::VARCHAR AS line_end, visibility, metadata_json FROM nodes_now",
    "e3_edges_upsert": f"WITH {_EDGES} SELECT source_id, target_id, kind, metadata_json FROM edges_now",
    "a3_languages": "SELECT language, count(*) AS n FROM (SELECT DISTINCT path, CASE WHEN regexp_matches(path, '[.](py|pyi|pyx)$') THEN 'python' WHEN regexp_matches(path, '[.]rs$') THEN 'rust' END AS language FROM files) WHERE language IS NOT NULL GROUP BY 1",
    "a6_id_parts": """SELECT id, file_path, module_path, name, hash AS signature_hash, file_path || '::' || (CASE WHEN module_path = '' THEN '' ELSE module_path || '::' END) || name AS shown
FROM (SELECT DISTINCT id, split_part(id, '::', 1) AS file_path, split_part(id, '::', 2) AS module_path, split_part(id, '::', 3) AS name, split_part(id, '::', 4) AS hash FROM nodes WHERE id IS NOT NULL)""",
    "a7_find_keys": f"WITH {_NODES} SELECT id FROM nodes_now WHERE name = 'open_span'",
    "b18_module_paths": """SELECT DISTINCT rel_path, array_to_string(list_filter(string_split(regexp_replace(rel_path, '[.](py[ix]?|rs)$', ''), '/'), lambda x: CASE WHEN rel_path LIKE '%.rs' THEN x NOT IN ('mod', 'lib') ELSE x <> '__init__' END), '.') AS module_path FROM files""",
    "c4_import_files": f"""WITH {_NODES}, {_EDGES}, {_IMPORTS} SELECT DISTINCT file, imported FROM i""",
    "c6_resolved_calls": f"""WITH {_NODES}, {_EDGES}, {_IMPORTS},
c AS (SELECT source_id, target_id, json_extract_string(metadata_json, '$.target_name') AS raw, split_part(source_id, '::', 1) AS caller FROM edges_now WHERE kind = 'calls'),
s AS (SELECT name, file_path, id, line_start FROM nodes_now WHERE kind IN ('function', 'method', 'class', 'module')),
v AS (SELECT DISTINCT caller, raw, v, CASE v WHEN 0 THEN raw ELSE string_split(raw, '.')[-1] END AS name FROM c, (VALUES (0), (1)) t(v) WHERE raw IS NOT NULL),
h AS (SELECT caller, raw, 2 * v AS rank, name, NULL AS file, NULL AS line, NULL AS id FROM v WHERE EXISTS (SELECT 1 FROM s WHERE s.name = v.name AND s.file_path = v.caller)
UNION ALL SELECT caller, raw, 2 * v + 1, v.name, s.file_path, s.line_start, s.id FROM v JOIN (SELECT DISTINCT file, imported FROM i) m ON m.file = v.caller AND m.imported <> v.caller JOIN s ON s.name = v.name AND s.file_path = m.imported),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY caller, raw ORDER BY rank, file NULLS FIRST, line NULLS FIRST, id) = 1)
SELECT source_id, coalesce(b.id, target_id) AS target_id, CASE WHEN b.caller IS NOT NULL THEN b.name ELSE c.raw END AS target_name, b.id IS NOT NULL AS resolved, count(*) AS n FROM c LEFT JOIN b ON b.caller = c.caller AND b.raw = c.raw GROUP BY ALL""",
    "d4_changes": f"""WITH {_FILES}, old AS (SELECT * FROM files WHERE rel_path IS NOT NULL AND scanned_at < TIMESTAMP '{CUTOFF}' QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY scanned_at DESC NULLS LAST, ingested_at DESC NULLS LAST, content_hash DESC NULLS LAST) = 1)
SELECT coalesce(f.rel_path, o.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'new' WHEN f.rel_path IS NULL THEN 'gone' WHEN f.content_hash IS NOT DISTINCT FROM o.content_hash THEN 'same' ELSE 'changed' END AS change FROM files_now f FULL JOIN old o ON o.rel_path = f.rel_path""",
    "d6_build_report": f"""WITH {_FILES}, b AS (SELECT * FROM builds WHERE build_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY build_id ORDER BY started_at DESC NULLS LAST, repo DESC NULLS LAST, files_scanned DESC NULLS LAST) = 1),
l AS (SELECT repo, files_scanned FROM b QUALIFY row_number() OVER (PARTITION BY repo ORDER BY started_at DESC NULLS LAST, build_id DESC) = 1), s AS (SELECT split_part(rel_path, '/', 1) AS repo, count(*) AS n FROM files_now GROUP BY 1)
SELECT repo, count(*) AS builds, max(l.files_scanned)::VARCHAR AS reported, coalesce(any_value(s.n), 0) AS stored FROM b JOIN l USING (repo) LEFT JOIN s USING (repo) GROUP BY repo""",
    "f1_callers_1": _callers("wrap_fault", 1),
    "f1_callers_2": _callers("lookup_setting", 2),
    "f2_callees_1": _callees("touch_all", 1),
    "f2_callees_2": _callees("warm_everything", 2),
    "f2_callees_3": _callees("touch_all", 3),
    "f3_imports_of_file": f"WITH {_EDGES} SELECT source_id, target_id, metadata_json FROM edges_now WHERE kind = 'imports' AND source_id ILIKE '%/TEST_%.py::%'",
    "f4_dependencies": _callees("touch_all", 1),
    "f5_dependents": _callers("open_span", 1),
    "f6_neighbors": f"SELECT DISTINCT * FROM ({_callers('open_span', 1)}) UNION SELECT DISTINCT * FROM ({_callees('open_span', 1)})",
    "f7_list_nodes": f"WITH {_NODES} SELECT id, name, file_path FROM nodes_now WHERE kind = 'class'",
    "g1_count_nodes": f"WITH {_NODES} SELECT kind, count(*) AS n FROM nodes_now GROUP BY 1",
    "g2_totals": f"WITH {_NODES}, {_EDGES} SELECT (SELECT count(*) FROM nodes_now) AS total_nodes, (SELECT count(*) FROM edges_now) AS total_edges, 1::BIGINT AS ir_version",
    "e6_text_lines": f"WITH {_NODES} SELECT '  [' || kind || '] ' || name || ' @ ' || file_path || ':' || coalesce(line_start, 0) AS line FROM nodes_now WHERE kind = 'trait'",
    "h1_token_counts": f"{_DOCS}, p AS (SELECT id, unnest(list_concat(a, b)) AS token FROM t) SELECT token, count(*) AS times, count(DISTINCT id) AS nodes FROM p GROUP BY 1",
    "h3_search_all": _ranked({"f0": _count("x = 'sensor'"), "f1": _count("x = 'py'")}, "f0 > 0 AND f1 > 0"),
    "h3_search_some_never": _ranked({"f0": _count("x = 'sensor'"), "f1": _count("starts_with(x, 'ledger')")}, "f0 + f1 > 0 AND " + _count("x = 'test'") + " = 0"),
    "h3_search_phrase": _ranked({"f0": _pairs("emit", "count")}, "f0 > 0"),
    "m_contained": f"WITH {_NODES}, {_EDGES} SELECT {_SHOWN} FROM edges_now e JOIN nodes_now s ON s.id = e.source_id AND s.name = 'src' JOIN nodes_now n ON n.id = e.target_id WHERE e.kind = 'contains'",
    "m_edges_of_kind": f"WITH {_EDGES} SELECT source_id, target_id FROM edges_now WHERE kind = 'inherits'",
}
