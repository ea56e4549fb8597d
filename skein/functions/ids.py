"""Keys of symbols as Column functions: ``file::module.path::name::16 hex digits``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_HASH = "0" * 16
# fixed values: kinds of nodes and edges
NODE_KINDS = "file module function method class struct enum enum_variant trait trait_impl interface type_alias constant static variable".split()
EDGE_KINDS = "calls imports contains inherits instantiates references depends_on".split()


def to_key(file_path: Column, module_path: Column, name: Column, signature_hash: Column) -> Column:
    """The key of a symbol; ``module_path`` is an array of names."""
    return F.concat_ws("::", file_path, F.array_join(module_path, "."), name, signature_hash)


def parse_key(key: Column) -> Column:
    """struct(file_path, module_path, name, signature_hash); null for a key without four parts or without a hexadecimal hash."""
    part = F.split(key, "::", 4)
    valid = (F.size(part) == 4) & part[3].rlike("^[0-9a-fA-F]{1,16}$")
    parsed = F.struct(
        part[0].alias("file_path"),
        F.filter(F.split(part[1], "[.]"), lambda x: x != "").alias("module_path"),
        part[2].alias("name"),
        F.lpad(F.lower(part[3]), 16, "0").alias("signature_hash"),
    )
    return F.when(valid, parsed)


def display(key: Column) -> Column:
    """The key without its hash, and without an empty module path."""
    p = parse_key(key)
    return F.when(F.size(p["module_path"]) == 0, F.concat_ws("::", p["file_path"], p["name"])).otherwise(F.concat_ws("::", p["file_path"], F.array_join(p["module_path"], "."), p["name"]))


def file_of(key: Column) -> Column:
    return F.substring_index(key, "::", 1)


def module_path(rel_path: Column) -> Column:
    """Module path of a file: its folders and stem without ``__init__`` (Python), ``mod`` and ``lib`` (Rust)."""
    parts = F.split(F.regexp_replace(F.translate(rel_path, "\\", "/"), "[.](py[ix]?|rs)$", ""), "/")
    rust = rel_path.endswith(".rs")
    return F.when(rust, F.filter(parts, lambda x: ~x.isin("mod", "lib"))).otherwise(F.filter(parts, lambda x: x != "__init__"))


def target_name(metadata_json: Column) -> Column:
    return F.get_json_object(metadata_json, "$.target_name")


def signature_hash(*parts: Column) -> Column:
    """A stable 64-bit hash as 16 hex digits."""
    return F.lpad(F.lower(F.hex(F.xxhash64(*parts))), 16, "0")


def language(path: Column) -> Column:
    """python or rust by the extension (case-sensitive), else null."""
    ext = F.regexp_extract(path, r"[.]([^./\\]+)$", 1)
    return F.when(ext.isin("py", "pyi", "pyx"), "python").when(ext == "rs", "rust")


def json_object(text: Column) -> Column:
    """``text`` where it is a JSON object, else null."""
    return F.when(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), text)


def decoded_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` as they are read back: what can't be decoded has a fallback.

    An id that is no key stands for (file_path, no module, name, no hash), an
    unknown kind for function, an unknown visibility for public; metadata that
    is no JSON object is ``{}``, and such a semantic record is null.
    """
    c = F.col
    return nodes.withColumns(
        {
            "id": F.when(parse_key(c("id")).isNotNull(), c("id")).otherwise(to_key(c("file_path"), F.array().cast("array<string>"), c("name"), F.lit(NO_HASH))),
            "kind": F.when(c("kind").isin(NODE_KINDS), c("kind")).otherwise("function"),
            "visibility": F.when(c("visibility").isin("private", "protected"), c("visibility")).otherwise("public"),
            "metadata_json": F.coalesce(json_object(c("metadata_json")), F.lit("{}")),
            "semantic_json": json_object(c("semantic_json")),
        }
    )


def decoded_edges(edges: DataFrame) -> DataFrame:
    """``edges`` as they are read back: an end that is no key is a name in the file ``unknown``, an unknown kind stands for calls, bad metadata for ``{}``."""
    end = lambda k: F.when(parse_key(F.col(k)).isNotNull() | F.col(k).isNull(), F.col(k)).otherwise(to_key(F.lit("unknown"), F.array().cast("array<string>"), F.col(k), F.lit(NO_HASH)))
    return edges.withColumns({"source_id": end("source_id"), "target_id": end("target_id"), "kind": F.when(F.col("kind").isin(EDGE_KINDS), F.col("kind")).otherwise("calls"), "metadata_json": F.coalesce(json_object(F.col("metadata_json")), F.lit("{}"))})
