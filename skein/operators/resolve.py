"""Cross-file resolution of calls as equi-joins.

For each call the written name and its last segment are tried in this order: a
symbol of that name in the caller's file (only ``target_name`` is set), then
the first symbol of that name, in node order, in another file that the
caller's file imports under any name (target and ``target_name`` are set, and
the call counts as resolved).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.ids import file_of, target_name

SYMBOLS = ("function", "method", "class", "module")


def symbol_index(nodes: DataFrame) -> DataFrame:
    """(name, file, id, ord) of what calls can mean; nodes need ``ord``, their place within the file."""
    return nodes.filter(F.col("kind").isin(*SYMBOLS)).select("name", F.col("file_path").alias("file"), "id", "ord")


def file_paths(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'file'").select(F.col("file_path").alias("file")).distinct()


def import_files(edges: DataFrame, files: DataFrame, many: bool = False) -> DataFrame:
    """(file, imported): which known files each file imports.

    A module name means ``name.py``, else its dots as folders, else the
    package's ``__init__.py``, below the root that was scanned. Of several
    imports of one name in a file the last that is a known file counts.
    Relative imports never resolve. With ``many`` the root holds one folder
    for each repository, and names are looked up in the importing file's own.
    """
    name = F.split(F.col("target_id"), "::")[2]
    module = F.coalesce(F.get_json_object("metadata_json", "$.import_module"), name)
    folder = F.replace(module, F.lit("."), F.lit("/"))
    file = file_of(F.col("source_id"))
    root = F.concat(F.substring_index(file, "/", 1), F.lit("/")) if many else F.lit("")
    wanted = edges.filter("kind = 'imports' AND source_id IS NOT NULL AND target_id IS NOT NULL").select(
        file.alias("file"), name.alias("name"), "ord", F.posexplode(F.array(F.concat(root, module, F.lit(".py")), F.concat(root, folder, F.lit(".py")), F.concat(root, folder, F.lit("/__init__.py")))).alias("rank", "imported")
    )
    hits = wanted.join(files.withColumnRenamed("file", "imported"), "imported")
    last = hits.groupBy("file", "name", "ord").agg(F.min_by("imported", "rank").alias("imported")).groupBy("file", "name").agg(F.max(F.struct("ord", "imported")).getField("imported").alias("imported"))
    return last.select("file", "imported").distinct()


def resolve_calls(edges: DataFrame, nodes: DataFrame, many: bool = False) -> DataFrame:
    """``edges`` with target_id and metadata_json of calls rewritten, and ``resolved``, true where another file was found.

    edges need ``ord``. Rows of other kinds, with a null source or without a
    target name stay as they are and meet no join; nothing is dropped or
    repeated. ``many`` as in ``import_files``.
    """
    symbols = symbol_index(nodes)
    imports = import_files(edges, file_paths(nodes), many)
    calls = edges.filter("kind = 'calls' AND source_id IS NOT NULL").select("source_id", target_name(F.col("metadata_json")).alias("raw")).dropna().distinct()
    calls = calls.select(file_of(F.col("source_id")).alias("caller"), "raw").distinct()
    tried = calls.select("caller", "raw", F.posexplode(F.array("raw", F.substring_index("raw", ".", -1))).alias("v", "name"))
    here = tried.join(symbols.select("name", F.col("file").alias("caller")).distinct(), ["name", "caller"], "left_semi").select("caller", "raw", (F.col("v") * 2).alias("rank"), F.struct(F.lit("").alias("file"), F.lit(0).alias("ord"), F.lit(None).cast("string").alias("id")).alias("hit"), "name")
    # join the imported files first: a name that many files define isn't multiplied by all callers
    reach = tried.join(imports.withColumnRenamed("file", "caller"), "caller").filter("imported <> caller")
    there = reach.join(symbols.withColumnRenamed("file", "imported"), ["name", "imported"]).select("caller", "raw", (F.col("v") * 2 + 1).alias("rank"), F.struct(F.col("imported").alias("file"), F.col("ord").cast("int").alias("ord"), "id").alias("hit"), "name")
    best = here.unionByName(there).groupBy("caller", "raw").agg(F.min(F.struct("rank", "hit", "name")).alias("best"))
    keyed = edges.withColumns({"caller": F.when(F.col("kind") == "calls", file_of(F.col("source_id"))), "raw": F.when(F.col("kind") == "calls", target_name(F.col("metadata_json")))})
    open_calls = "caller IS NOT NULL AND raw IS NOT NULL"
    out = keyed.filter(open_calls).join(best, ["caller", "raw"], "left")
    found = F.col("best.hit.id").isNotNull()
    columns = [c for c in edges.columns if c not in ("target_id", "metadata_json")]
    done = out.select(
        *columns,
        F.when(found, F.col("best.hit.id")).otherwise(F.col("target_id")).alias("target_id"),
        F.when(F.col("best").isNotNull(), F.to_json(F.struct(F.col("best.name").alias("target_name")))).otherwise(F.col("metadata_json")).alias("metadata_json"),
        F.coalesce(found, F.lit(False)).alias("resolved"),
    )
    return done.unionByName(keyed.filter(f"NOT ({open_calls})").select(*columns, "target_id", "metadata_json", F.lit(False).alias("resolved")))
