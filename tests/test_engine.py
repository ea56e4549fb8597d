import json

import pytest

from skein.api import Engine
from skein.functions import ids
from skein.operators import extract as X
from skein.operators import graph as G
from skein.operators import search as S
from skein.operators import semantic as M
from skein.operators.incremental import build
from skein.operators.resolve import import_files, resolve_calls
from skein.operators.store import Store, latest, upsert
from skein.scratch import Scratch, sweep
from skein.sources.repository import _glob, scan
from skein.streaming.follow import FILES, follow
from pyspark.sql import functions as F

PROJECT = {
    "app.py": '"""Entry."""\nfrom shop.cart import Cart, total\nimport tools, os\n\n\ndef main(argv: list, retries=3) -> int:\n    """Run it.\n\n    More.\n    """\n    cart = Cart()\n    cart.add(1)\n    print(tools.helper(cart))\n    return 0\n',
    "tools.py": "LIMIT = 3\n\n\ndef helper(x):\n    def inner(y):\n        return helper(y)\n    return inner(x)\n\n\nasync def fetch(): pass\n",
    "shop/__init__.py": "from .cart import Cart\n",
    "shop/cart.py": "import dataclasses\n\n\nclass Base:\n    pass\n\n\n@dataclasses.dataclass\nclass Cart(Base):\n    \"\"\"Holds items.\"\"\"\n    size: int = 0\n\n    @staticmethod\n    def make(): return Cart()\n\n    @property\n    @app.route('/')\n    def full(self): return self.size > 1\n\n    def add(self, n, *rest, k: int = 1):\n        self.size = n\n        total(self)\n\n\ndef total(cart):\n    return len(cart)\n",
    "src/lib.rs": 'use std::fmt;\n\n/// Draws.\npub trait Draw { fn draw(&self); }\npub struct Circle { r: u32 }\nenum Kind { A, B }\nmod inner { fn hidden() {} }\n\nimpl Draw for Circle {\n    fn draw(&self) { helper("fn no() {"); self.r.pow(2); println!("x"); }\n}\n\npub fn helper(s: &str) -> u32 { std::cmp::max(1, 2) }\n',
    "broken.py": "import os\n\nX = 1\n\ndef f(:\n    pass\n",
    "bad.py": b"\xff\xfe",
    ".hidden.py": "x = 1\n",
    "node_modules/x.py": "x = 1\n",
    "notes.txt": "no",
}


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    (root / ".git").mkdir()
    (root / ".gitignore").write_text("node_modules/\n")
    for path, text in PROJECT.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text) if isinstance(text, bytes) else p.write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, project, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("store"))
    stats = build(spark, str(project), folder).first()
    return Engine(spark, folder), stats, folder


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_scan_keeps_init_files_and_honours_ignores(spark, project):
    rows = {r["rel_path"]: r for r in scan(spark, str(project)).collect()}
    assert set(rows) == {"app.py", "tools.py", "shop/__init__.py", "shop/cart.py", "src/lib.rs", "broken.py", "bad.py"}
    assert rows["bad.py"]["content"] is None and "Unicode" in rows["bad.py"]["error"]
    assert rows["src/lib.rs"]["language"] == "rust" and len(rows["app.py"]["content_hash"]) == 64


def test_python_extraction(engine):
    e = engine[0]
    nodes = {(r["file_path"], r["name"], r["kind"]): r for r in e.nodes.collect()}
    main = nodes["app.py", "main", "function"]
    meta = json.loads(main["metadata_json"])
    assert meta == {"parameters": [{"name": "argv", "type": "list"}, {"name": "retries", "has_default": "true"}], "return_type": "int"}
    assert json.loads(main["semantic_json"]) == {"purpose": "Run it."} and (main["line_start"], main["line_end"], main["col_start"]) == (6, 14, 0)
    assert main["id"].startswith("app.py::app::main::") and not main["id"].endswith(ids.NO_HASH)
    assert nodes["app.py", "app.py", "file"]["line_end"] == 15 and nodes["app.py", "cart", "variable"]["visibility"] == "private"
    assert json.loads(nodes["shop/cart.py", "make", "method"]["metadata_json"])["decorator"] == "staticmethod"
    full = json.loads(nodes["shop/cart.py", "full", "method"]["metadata_json"])
    assert full["property"] is True and full["decorators"] == ["app.route"]
    assert json.loads(nodes["shop/cart.py", "add", "method"]["metadata_json"])["parameters"] == [{"name": "n"}]
    assert json.loads(nodes["shop/cart.py", "size", "variable"]["metadata_json"]) == {"class_attribute": True}
    assert nodes["shop/cart.py", "self.size", "variable"]["id"].startswith("shop/cart.py::shop.cart.Cart::self.size::")
    assert json.loads(nodes["tools.py", "fetch", "function"]["metadata_json"]) == {"async": True}
    edges = {(r["source_id"].split("::")[2], r["target_id"].split("::")[2], r["kind"]) for r in e.edges.collect()}
    assert ("Cart", "Base", "inherits") in edges and ("helper", "inner", "contains") in edges and ("app.py", "tools", "imports") in edges
    assert ("app.py", "Cart", "imports") in edges and ("app.py", "total", "imports") not in edges


def test_rust_extraction(engine):
    found = {(r["name"], r["kind"]) for r in engine[0].nodes.filter("file_path = 'src/lib.rs'").collect()}
    assert found == {("src/lib.rs", "file"), ("Draw", "trait"), ("Circle", "struct"), ("Kind", "enum"), ("inner", "module"), ("impl Circle", "trait_impl"), ("draw", "method"), ("helper", "function")}
    edges = {(r["source_id"].split("::")[2], r["target_id"].split("::", 2)[2], r["kind"]) for r in engine[0].edges.filter("source_id LIKE 'src/lib.rs%'").collect()}
    calls = {(s, t.rsplit("::", 1)[0]) for s, t, k in edges if k == "calls"}
    assert calls == {("draw", "helper"), ("draw", "self.r.pow"), ("helper", "std::cmp::max")}
    assert any(k == "imports" and t.startswith("std::fmt::") for _, t, k in edges)


def test_failures_are_diagnostics(engine):
    e, stats, _ = engine
    assert (stats["files_scanned"], stats["files_failed"], stats["files_skipped"]) == (7, 2, 0)
    assert {r["file_path"] for r in e.store.table("diagnostics").collect()} == {"broken.py", "bad.py"}
    assert names(e.nodes.filter("file_path = 'broken.py' AND kind <> 'file'")) == ["X"]
    assert stats["total_edges"] > e.edges.count() and e.store.get_meta("ir_version") == "1"


def test_resolution_and_walks(engine):
    e = engine[0]
    calls = {(r["source_id"].split("::")[2], json.loads(r["metadata_json"])["target_name"]): r["target_id"] for r in e.edges.filter("kind = 'calls' AND source_id LIKE 'app.py%'").collect()}
    assert calls["main", "Cart"].startswith("shop/cart.py::shop.cart::Cart") and calls["main", "add"].startswith("shop/cart.py::shop.cart.Cart::add")
    assert calls["main", "helper"].startswith("tools.py::tools::helper") and calls["main", "print"].startswith("app.py::::print")
    assert names(e.callers("print")) == ["main"] and names(e.callers("total", 1)) == ["add"] and names(e.callers("total", 2)) == ["add", "main"]
    assert e.callers("main", 0).count() == 0 and names(e.callers("helper")) == ["draw", "helper", "inner", "main"]
    assert names(e.callees("main", 1)) == ["Cart", "add", "helper", "helper"] and names(e.callees("add", 1)) == ["total"]
    assert names(e.neighbors("total")) == ["add"] and names(e.dependents("add")) == ["main"] and names(e.dependencies("add")) == ["total"]
    assert e.imports_of_file("APP.PY").count() == 3 and e.imports_of_file("shop/__init__.py").count() == 1
    assert names(e.list_nodes("class")) == ["Base", "Cart"] and G.call_path(e.nodes, e.edges, "main", "total") == ["main", "add", "total"]
    assert G.call_path(e.nodes, e.edges, "total", "main") == []
    assert e.status().first()["total_nodes"] == e.nodes.count()
    assert "  [class] Cart @ shop/cart.py:9" in {r[0] for r in G.as_text(e.list_nodes("class")).collect()}


def test_search(engine):
    e = engine[0]
    assert {r["name"] for r in e.search("cart", "py", never=("app",)).collect()} >= {"Cart", "add", "total"}
    assert {r["name"] for r in e.search("hel*").collect()} == {"helper"}
    assert {r["name"] for r in e.search("shop cart", never=("py",)).collect()} == set()
    assert e.search("self size").first()["name"] == "self.size" and e.search("zzz").count() == 0
    ranks = [r["rank"] for r in e.search("cart").collect()]
    assert ranks == sorted(ranks) and len(ranks) <= 50
    for bad in ((), ("...",)):
        with pytest.raises(ValueError):
            e.search(*bad)


def test_incremental_build(spark, project, engine, tmp_path):
    folder = str(tmp_path / "s")
    build(spark, str(project), folder)
    same = build(spark, str(project), folder).first()
    assert (same["files_skipped"], same["total_nodes"]) == (7, 0)
    tools = project / "tools.py"
    old = tools.read_text()
    try:
        tools.write_text(old.replace("def fetch", "def grab"))
        kept = build(spark, str(project), folder).first()
        nodes = Engine(spark, folder).nodes
        assert kept["files_skipped"] == 6 and {"fetch", "grab"} <= set(names(nodes))
        tools.write_text(old.replace("def fetch", "def take"))
        build(spark, str(project), folder, prune=True)
        assert not {"fetch", "grab"} & set(names(Engine(spark, folder).nodes)) and "take" in names(Engine(spark, folder).nodes)
    finally:
        tools.write_text(old)


def test_latest_and_upsert(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), ("b", 1, "p"), ("b", 1, "q"), (None, 9, "n")], "id string, at int, v string")
    assert {(r["id"], r["v"]) for r in latest(df, ["id"], ["at"]).collect()} == {("a", "y"), ("b", "q")}
    old = spark.createDataFrame([("a", "old"), ("c", "kept")], "id string, v string")
    new = spark.createDataFrame([("a", "first", 0), ("a", "last", 1)], "id string, v string, ord int")
    once = upsert(old, new, ["id"])
    assert {tuple(r) for r in once.collect()} == {("a", "last"), ("c", "kept")} == {tuple(r) for r in upsert(once, new, ["id"]).collect()}


def test_resolver_is_independent_of_partitions(spark, project):
    rows = X.extract(scan(spark, str(project)))
    nodes, edges = X.nodes(rows), X.edges(rows)
    one = {tuple(r) for r in resolve_calls(edges, nodes).collect()}
    assert one == {tuple(r) for r in resolve_calls(edges.repartition(7), nodes.repartition(5)).collect()}
    assert resolve_calls(edges, nodes).count() == edges.count()


def test_id_codec(spark):
    keys = [("src/m.py::pkg.mod::f::000000000000abcd",), ("m.py::::f::1",), ("bad",), ("a::b::c::xyz",), (None,)]
    df = spark.createDataFrame(keys, "k string").select("k", ids.parse_key(F.col("k")).alias("p"), ids.display(F.col("k")).alias("d"))
    got = {r["k"]: (r["p"] and tuple(r["p"]), r["d"]) for r in df.collect()}
    assert got["src/m.py::pkg.mod::f::000000000000abcd"] == (("src/m.py", ["pkg", "mod"], "f", "000000000000abcd"), "src/m.py::pkg.mod::f")
    assert got["m.py::::f::1"] == (("m.py", [], "f", "0" * 15 + "1"), "m.py::f") and got["bad"][0] is None and got["a::b::c::xyz"][0] is None
    back = df.filter("p IS NOT NULL").select(ids.to_key(F.col("p.file_path"), F.col("p.module_path"), F.col("p.name"), F.col("p.signature_hash")).alias("k"))
    assert "src/m.py::pkg.mod::f::000000000000abcd" in {r["k"] for r in back.collect()}


def test_semantic(spark, engine):
    e = engine[0]
    snippets = spark.createDataFrame([("app.py", "é" * 1500), ("tools.py", "code")], "file_path string, content string")
    prompts = {r["id"].split("::")[2]: r["prompt"] for r in M.prompts(e.nodes, snippets).collect()}
    lines = prompts["main"].split("\n")
    assert lines[:5] == ["Function: main", "Parameters: argv: list, retries", "Returns: int", "Docstring: Run it.", "File: app.py:6"] and lines[6] == "é" * 1000 + "..."
    replies = spark.createDataFrame([('```json\n{"purpose": "p", "risks": [{"severity": "odd", "category": "c", "description": "d"}]}\n```',), ('{"summary": "s"}',), ("no json",), ("{",), (None,)], "r string")
    got = [r["s"] and r["s"].asDict(True) for r in replies.select(M.parse_reply("r").alias("s")).collect()]
    assert got[0]["purpose"] == "p" and got[0]["risks"] == [{"severity": "low", "category": "c", "description": "d"}] and got[0]["responsibility"] == []
    assert got[1]["summary"] == "s" and got[2:] == [None, None, None]

    def provider(prompt):
        if "inner" in prompt:
            raise RuntimeError
        return json.dumps({"purpose": "x", "summary": prompt.split("\n")[0]})

    done = {r["id"].split("::")[2]: json.loads(r["semantic_json"])["summary"] for r in M.enrich(e.nodes.filter("file_path = 'tools.py'"), snippets, provider).collect()}
    assert done == {"helper": "Function: helper", "fetch": "Async: true"}


def test_stream_puts_snapshots_into_the_store(spark, tmp_path):
    from datetime import datetime

    rows = [("a.py", "python", "def f(): g()\n", "h1", datetime(2024, 1, 1)), ("a.py", "python", "def f2(): pass\n", "h2", datetime(2024, 1, 2)), ("b.py", "python", None, None, None)]
    spark.createDataFrame(rows, FILES).write.parquet(str(tmp_path / "in"))
    args = (str(tmp_path / "in"), str(tmp_path / "store"), str(tmp_path / "cp"))
    follow(spark, *args).awaitTermination()
    assert names(Engine(spark, args[1]).nodes.filter("kind = 'function'")) == ["f2"]
    follow(spark, *args).awaitTermination()
    assert Engine(spark, args[1]).nodes.count() == 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "rel_path string, language string, content string")
    rows = X.extract(none)
    assert rows.count() == 0 and resolve_calls(X.edges(rows), X.nodes(rows)).count() == 0
    nodes = X.nodes(rows)
    assert G.callers(nodes, X.edges(rows), "x", 2).count() == 0 and S.search(nodes, ["x"]).count() == 0
    assert G.totals(nodes, X.edges(rows)).first()["total_nodes"] == 0


def test_statements_around_errors_are_kept():
    def names(text):
        return [(r["name"], r["place"][0]) for r in X.Python("a.py", text, False).run().rows if r["what"] == "node"][1:]

    rest = "".join(f"def f{i}():\n    return g()\n" for i in range(60))
    got = names("import a\n<<<<<<< HEAD\nX = 1\n=======\nX = 2\n>>>>>>> b\n" + rest)
    assert got == [("X", 3), ("X", 5)] + [(f"f{i}", 7 + 2 * i) for i in range(60)]
    assert names("a b\n" + rest)[-1] == ("f59", 120)
    assert names("class K:\n    def m(self):\n        x = = 1\n    def n(self:\n        pass\n    def o(self): pass\ny = 1\n") == [("K", 1), ("m", 2), ("o", 6), ("y", 7)]
    assert names("a b\ns = '''\ndef no(): pass\n'''\n@d\ndef yes(): pass\n") == [("s", 2), ("yes", 6)]
    assert names("def a(): pass\nx = [1, 2\ndef b(): pass\n") == [("a", 1), ("b", 3)]
    assert names("x = '\0'\ndef f(): pass\n") == [("f", 2)]
    assert names("x = " + "(" * 300 + ")" * 300 + "\ny = 1\n") == [("y", 2)]
    assert names("<p>\n") == names("? ?") == []


TWO = {
    "alpha.py": "LIMIT = 2\n\n\ndef twice(x):\n    return x + x\n\n\ndef run(x):\n    y = twice(x)\n    return other(y)\n",
    "beta.py": "from alpha import twice, run\n\n\nclass Box:\n    size = 0\n\n    def put(self, x):\n        self.last = run(x)\n        self.put(x)\n        return len(x)\n",
}


def test_counts_and_resolution_of_a_small_project(spark, tmp_path):
    """Counts worked out by hand: locals are linked twice, a name is looked up in every file that is imported under any name."""
    for path, text in TWO.items():
        (tmp_path / path).write_text(text)
    stats = build(spark, str(tmp_path), str(tmp_path / "store")).first()
    e = Engine(spark, str(tmp_path / "store"))
    assert (stats["total_nodes"], stats["total_edges"], e.nodes.count(), e.edges.count(), stats["calls_resolved"]) == (10, 16, 10, 14, 1)
    kinds = {r["kind"]: r["n"] for r in e.count_nodes().collect()}
    assert kinds == {"variable": 4, "function": 2, "file": 2, "class": 1, "method": 1}
    assert {r["kind"]: r["count"] for r in e.edges.groupBy("kind").count().collect()} == {"contains": 8, "calls": 5, "imports": 1}
    calls = {(r["source_id"].split("::")[2], json.loads(r["metadata_json"])["target_name"], "::".join(r["target_id"].split("::")[:3])) for r in e.edges.filter("kind = 'calls'").collect()}
    assert calls == {("run", "twice", "alpha.py::::twice"), ("run", "other", "alpha.py::::other"), ("put", "run", "alpha.py::alpha::run"), ("put", "put", "beta.py::::self.put"), ("put", "len", "beta.py::::len")}
    assert names(e.callers("twice", 2)) == ["put", "run"] and names(e.callees("put", 2)) == ["put", "run", "twice"]
    assert [(r["file"], r["n"], r["names"]) for r in G.import_names(e.edges).collect()] == [("beta.py", 1, "twice")]
    assert tuple(G.result_count(e.callers("twice", 2)).first()) == (2, 2)


@pytest.mark.parametrize(
    "text, kinds, edges",
    [
        ("def hello(): print('world')\n", [("hello", "function")], [("hello", "print", "calls")]),
        ("class Foo:\n    def bar(self): baz()\n", [("Foo", "class"), ("bar", "method")], [("bar", "baz", "calls")]),
        ("class Child(Parent): pass\n", [("Child", "class")], [("Child", "Parent", "inherits")]),
        ("A = True\nB: str = '1.0'\n", [("A", "variable"), ("B", "variable")], []),
        ("import os, sys, json\n", [], [("a.py", x, "imports") for x in ("os", "sys", "json")]),
        ("from collections import defaultdict\n", [], [("a.py", "defaultdict", "imports")]),
        ("def outer():\n    def inner(): pass\n", [("outer", "function"), ("inner", "function")], [("outer", "inner", "contains")]),
        ("class Outer:\n    class Inner: pass\n", [("Outer", "class"), ("Inner", "class")], [("Outer", "Inner", "contains")]),
    ],
)
def test_python_units(text, kinds, edges):
    rows = X.Python("a.py", text, False).run().rows
    assert sorted((r["name"], r["kind"]) for r in rows if r["what"] == "node" and r["kind"] != "file") == sorted(kinds)
    got = {(r["source_id"].split("::")[2], r["target_id"].split("::")[2], r["kind"]) for r in rows if r["what"] == "edge"}
    assert set(edges) <= got


def test_imports_below_each_repository(spark):
    """In a workspace of repositories names are looked up below the importing file's own folder; relative imports never resolve."""
    edges = spark.createDataFrame(
        [("r1/main.py::main::main.py::0", "r1/main.py::::lib::0", "imports", "{}", 0), ("r1/main.py::main::main.py::0", "r1/main.py::::f::0", "imports", '{"import_module": "pkg.mod"}', 1), ("r1/main.py::main::main.py::0", "r1/main.py::::g::0", "imports", '{"import_module": ".lib"}', 2), ("r1/main.py::main::main.py::0", "r1/main.py::::pkg::0", "imports", None, 3), (None, "x", "imports", None, 4),
         ("r1/main.py::main::go::0", "r1/main.py::::lib.call::0", "calls", '{"target_name": "lib.call"}', 5), ("r1/main.py::main::go::0", "r1/main.py::::call::0", "calls", None, 6), (None, "r1/main.py::::call::0", "calls", '{"target_name": "call"}', 7)],
        "source_id string, target_id string, kind string, metadata_json string, ord int",
    )
    nodes = spark.createDataFrame([(f"{p}::::{n}::0", k, n, p, 1) for p, n, k in [("r1/lib.py", "f", "file"), ("r2/lib.py", "f", "file"), ("r1/pkg/mod.py", "f", "file"), ("r1/pkg/__init__.py", "f", "file"), ("r1/main.py", "f", "file"), ("r2/lib.py", "call", "function"), ("r1/lib.py", "call", "function")]], "id string, kind string, name string, file_path string, ord int")
    files = nodes.filter("kind = 'file'").select(F.col("file_path").alias("file"))
    assert {tuple(r) for r in import_files(edges, files, many=True).collect()} == {("r1/main.py", "r1/lib.py"), ("r1/main.py", "r1/pkg/mod.py"), ("r1/main.py", "r1/pkg/__init__.py")}
    assert import_files(edges, files).count() == 0
    done = resolve_calls(edges, nodes, many=True).collect()
    assert len(done) == edges.count() and [r["target_id"] for r in done if r["resolved"]] == ["r1/lib.py::::call::0"]
    assert not [r for r in resolve_calls(edges, nodes).collect() if r["resolved"]]


def test_diagnostics_of_mended_files_go(spark, tmp_path):
    src, folder = tmp_path / "p", str(tmp_path / "s")
    src.mkdir()
    (src / "a.py").write_text("def f(:\n")
    (src / "b.py").write_text("x = = 1\n")
    build(spark, str(src), folder)
    told = lambda: sorted(r["file_path"] for r in Store(spark, folder).table("diagnostics").collect())
    assert told() == ["a.py", "b.py"]
    (src / "a.py").write_text("def f(): pass\n")
    build(spark, str(src), folder)
    assert told() == ["b.py"]  # b.py wasn't read again and keeps its entry
    (src / "b.py").unlink()
    (src / "c.py").write_text("y = (\n")
    build(spark, str(src), folder, prune=True)
    assert told() == ["c.py"] and names(Engine(spark, folder).nodes.filter("kind = 'function'")) == ["f"]


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    schema = "id string, kind string, name string, ord int"
    store.put(nodes=spark.createDataFrame([(f"f{i}.py::::n::0", "function", "n", 0) for i in range(200)], schema))
    before = store.version()["nodes"]["parts"]
    store.put(nodes=spark.createDataFrame([("f7.py::::n::0", "class", "m", 0), ("f7.py::::n::0", "class", "last", 1), (None, "x", "x", 0)], schema))
    after = store.version()["nodes"]["parts"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert 1 <= len(changed) <= 2 and store.table("nodes").count() == 200  # the null key's bucket is looked at, its row dropped
    assert store.table("nodes").filter("name = 'last'").count() == 1
    store.set_meta("a", "1")
    store.vacuum(1)
    assert store.table("nodes").count() == 200 and store.get_meta("a") == "1" and store.get_meta("b") is None
    assert Store(spark, str(tmp_path / "none")).table("nodes") is None


def test_decode_fallbacks(spark):
    nodes = spark.createDataFrame([("bad", "odd", "n", "a.py", "hidden", "[1]", "{"), ("a.py::m::n::00ff", "enum", "n", "a.py", "private", '{"x": 1}', '{"purpose": "p"}'), (None, None, "n", "a.py", None, None, None)], "id string, kind string, name string, file_path string, visibility string, metadata_json string, semantic_json string")
    got = [tuple(r) for r in ids.decoded_nodes(nodes).collect()]
    assert got[0] == ("a.py::::n::" + "0" * 16, "function", "n", "a.py", "public", "{}", None)
    assert got[1] == ("a.py::m::n::00ff", "enum", "n", "a.py", "private", '{"x": 1}', '{"purpose": "p"}') and got[2][:2] == ("a.py::::n::" + "0" * 16, "function")
    edges = spark.createDataFrame([("name", "a.py::::f::0", "odd", "x"), (None, "b", "imports", '{"k": 2}')], "source_id string, target_id string, kind string, metadata_json string")
    assert [tuple(r) for r in ids.decoded_edges(edges).collect()] == [("unknown::::name::" + "0" * 16, "a.py::::f::0", "calls", "{}"), (None, "unknown::::b::" + "0" * 16, "imports", '{"k": 2}')]


def test_search_folds_diacritics_and_records_are_found(spark):
    nodes = spark.createDataFrame([("1", "function", "a\u00f1adir_\u00c9l\u00e8ve", "src/\u00fcber.py", '{"purpose": "Liefert den Topf zur\u00fcck", "design_pattern": ["pool"], "risks": [{"severity": "High", "category": "c", "description": "d"}]}'), ("2", "function", "an\u0303adir", "b.py", '{"purpose": null}'), ("3", "class", "other", "c.py", "{bad")], "id string, kind string, name string, file_path string, semantic_json string")
    found = lambda *t: sorted(r["id"] for r in S.search(nodes, t).collect())
    assert found("anadir") == found("A\u00d1ADIR") == ["1", "2"] and found("eleve", "uber") == ["1"] and found("anad*") == ["1", "2"]
    assert [r["id"] for r in M.by_purpose(nodes, ["zuruck", "topf"]).collect()] == ["1"] and M.by_purpose(nodes, ["none"]).count() == 0
    assert [r["id"] for r in M.by_tag(nodes, "pool").collect()] == [r["id"] for r in M.by_risk(nodes, "high").collect()] == ["1"] and M.by_risk(nodes, "critical").count() == 0


def test_old_intermediate_tables_are_swept(spark):
    scratch = Scratch(spark, "old")
    table = scratch.save(spark.range(3))
    sweep(spark)
    assert table.count() == 3
    sweep(spark, hours=-1)
    with pytest.raises(Exception):
        spark.read.parquet(scratch.base + "/0001").count()


def test_ignore_patterns():
    same = lambda p, *paths: [bool(_glob(p).fullmatch(x)) for x in paths]
    assert same("*.py", "a.py", "b/a.py") == [True, False] and same("doc/*.py", "doc/a.py", "doc/x/a.py") == [True, False]
    assert same("**/gen", "gen", "a/b/gen", "again") == [True, True, False] and same("a/**/b", "a/b", "a/x/y/b") == [True, True]
    assert same("x/**", "x/y/z", "x") == [True, False] and same("[!a]?.rs", "bc.rs", "ac.rs", "b/.rs") == [True, False, False] and same("a+(b).py", "a+(b).py") == [True]
