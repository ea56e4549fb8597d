"""The engine as an object and a command line: build a store from a repository and ask it."""

from __future__ import annotations

import argparse
import glob
import os

from pyspark.sql import DataFrame, SparkSession

from skein.operators import graph, search, semantic
from skein.operators.incremental import build
from skein.operators.store import IR_VERSION, Store
from skein.sources.repository import scan


class Engine:
    def __init__(self, spark: SparkSession, folder: str):
        self.store = Store(spark, folder)

    @property
    def nodes(self) -> DataFrame:
        return self._table("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._table("edges")

    def _table(self, name: str) -> DataFrame:
        df = self.store.table(name)
        if df is None:
            raise FileNotFoundError(f"{self.store.folder} holds no build yet")
        return df

    def callers(self, name: str, depth: int = 1) -> DataFrame:
        return graph.callers(self.nodes, self.edges, name, depth)

    def callees(self, name: str, depth: int = 1) -> DataFrame:
        return graph.callees(self.nodes, self.edges, name, depth)

    def dependencies(self, name: str) -> DataFrame:
        return graph.dependencies(self.nodes, self.edges, name)

    def dependents(self, name: str) -> DataFrame:
        return graph.dependents(self.nodes, self.edges, name)

    def neighbors(self, name: str, depth: int = 1) -> DataFrame:
        return graph.neighbors(self.nodes, self.edges, name, depth)

    def imports_of_file(self, file: str) -> DataFrame:
        return graph.imports_of_file(self.edges, file)

    def list_nodes(self, kind: str | None = None) -> DataFrame:
        return graph.list_nodes(self.nodes, kind)

    def count_nodes(self) -> DataFrame:
        return graph.count_nodes(self.nodes)

    def search(self, *terms: str, some: tuple[str, ...] = (), never: tuple[str, ...] = ()) -> DataFrame:
        return search.search(self.nodes, terms, some, never)

    def by_purpose(self, *words: str) -> DataFrame:
        return semantic.by_purpose(self.nodes, words)

    def by_tag(self, tag: str) -> DataFrame:
        return semantic.by_tag(self.nodes, tag)

    def by_risk(self, least: str = "low") -> DataFrame:
        return semantic.by_risk(self.nodes, least)

    def status(self) -> DataFrame:
        return graph.totals(self.nodes, self.edges, IR_VERSION)


def _folder(path: str) -> str:
    """A store's folder, or that of a repository's store."""
    return path if glob.glob(os.path.join(path, "CURRENT-*")) else os.path.join(path, ".skein")


def main(argv: list[str] | None = None) -> None:
    from skein.session import local_session

    p = argparse.ArgumentParser(prog="skein")
    sub = p.add_subparsers(dest="command", required=True)
    for command in ("scan", "build", "status"):
        c = sub.add_parser(command)
        c.add_argument("path", nargs="?", default=".")
        if command == "build":
            c.add_argument("--store")
            c.add_argument("--force", action="store_true")
            c.add_argument("--prune", action="store_true")
    q = sub.add_parser("query")
    q.add_argument("what", choices=["callers", "callees", "dependencies", "dependents", "neighbors", "imports", "list-nodes", "search"])
    q.add_argument("term", nargs="*")
    q.add_argument("-d", "--depth", type=int, default=1)
    q.add_argument("--store", default=".")
    q.add_argument("--json", action="store_true")
    a = p.parse_args(argv)
    spark = local_session()
    if a.command == "scan":
        scan(spark, a.path).select("rel_path", "language").show(1000, False)
    elif a.command == "build":
        build(spark, a.path, a.store or os.path.join(a.path, ".skein"), a.force, a.prune).show(truncate=False)
    elif a.command == "status":
        e = Engine(spark, _folder(a.path))
        e.status().show(truncate=False)
        e.count_nodes().show(100, False)
    else:
        e = Engine(spark, _folder(a.store))
        if a.what == "search":
            found = e.search(*a.term)
        elif a.what == "list-nodes":
            found = e.list_nodes(*a.term[:1])
        elif a.what == "imports":
            found = e.imports_of_file(a.term[0])
        elif a.what in ("dependencies", "dependents"):
            found = getattr(e, a.what)(a.term[0])
        else:
            found = getattr(e, a.what)(a.term[0], a.depth)
        lines = graph.as_json(found) if a.json or a.what in ("imports", "search") else graph.as_text(found)
        for row in lines.toLocalIterator():
            print(row[0])


if __name__ == "__main__":
    main()
