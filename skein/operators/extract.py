"""Source files to nodes and edges: a table function over files, one file to many rows.

Kept from the code-graph model: the body walk sees direct children only; the
module id at which top-level links start has no node; a function contains all
that is nested in it and calls inside a nested function count for both; locals
of functions are variables; ``from m import a, b`` gives its first name unless
``all_names``; defaulted and annotated or starred parameters are left out.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE = "id string, kind string, name string, file_path string, line_start int, line_end int, col_start int, col_end int, visibility string, metadata_json string, semantic_json string, hash bigint"
EDGE = "source_id string, target_id string, kind string, metadata_json string"
ROW = f"what string, rel_path string, ord int, {NODE}, source_id string, target_id string, message string"
_COLUMNS = [c.strip().split(" ")[0] for c in ROW.split(",")]
NO_HASH = "0" * 16


def _key(path: str, module: list[str], name: str, sig: str = NO_HASH) -> str:
    return "::".join((path, ".".join(module), name, sig))


class Found:
    """Nodes, edges and messages of one file, in the order of the text."""

    def __init__(self, path: str):
        self.path = path
        self.rows: list[dict] = []

    def node(self, key: str, kind: str, name: str, place: tuple[int, int, int, int], meta: dict | None = None, purpose: str | None = None, private: bool = False) -> str:
        semantic = json.dumps({"purpose": purpose}, ensure_ascii=False) if purpose is not None else None
        self.rows.append({"what": "node", "id": key, "kind": kind, "name": name, "place": place, "visibility": "private" if private else "public", "metadata_json": json.dumps(meta or {}, ensure_ascii=False), "semantic_json": semantic})
        return key

    def edge(self, source: str, target: str, kind: str, **meta: str) -> None:
        self.rows.append({"what": "edge", "source_id": source, "target_id": target, "kind": kind, "metadata_json": json.dumps(meta, ensure_ascii=False)})

    def table(self) -> list[tuple]:
        out = []
        for i, r in enumerate(self.rows):
            place = r.get("place", (None,) * 4)
            full = r | {"rel_path": self.path, "ord": i, "file_path": self.path, "line_start": place[0], "line_end": place[1], "col_start": place[2], "col_end": place[3], "hash": 0}
            out.append(tuple(full.get(c) for c in _COLUMNS))
        return out


_UNPARSABLE = (SyntaxError, ValueError, RecursionError, MemoryError)
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_MARK = re.compile(r"(?:<{7}|>{7}|\|{7}|={7})(?:\s|$)")
_GOES_ON = re.compile(r"[)\]}#]|(?:elif|else|except|finally)\b")
_INCOMPLETE = 0x4000  # flag of compile(): input that ends too early is an error of its own, as codeop uses it


def _indent(line: str) -> str:
    return re.match(r"(?:[ \t]*\f)*([ \t]*)", line)[1]


def _verdict(text: str) -> str:
    """good, bad, or for text that ends too early: the quotes that are open, or more."""
    head = "if 1:\n" if _indent(text) else ""
    try:
        ast.parse(head + text)
        return "good"
    except _UNPARSABLE as e:
        message = str(e)
    try:
        compile(head + text, "", "exec", ast.PyCF_ONLY_AST | _INCOMPLETE)
    except _UNPARSABLE as e:
        if type(e).__name__ != "_IncompleteInputError":
            return "bad"
    return "quotes" if "triple-quoted" in message else "more"


def _body(lines: list[str]) -> str:
    """Text from the first line with code on."""
    at = next((i for i, x in enumerate(lines) if x.strip() and not x.lstrip().startswith("#")), len(lines))
    return "".join(lines[at:])


def _blank_lines(lines: list[str]) -> list[str]:
    return [x[len(x.rstrip("\r\n")) :] for x in lines]


def _inside(lines: list[str]) -> list[str] | None:
    """A compound statement with what doesn't parse in its bodies left out; none if it doesn't parse even so."""
    first = next((x for x in lines if x.strip()), "")
    outer, out, at, changed = _indent(first), [], 0, False
    while at < len(lines):
        head = lines[at]
        out.append(head)
        at += 1
        if not head.strip() or not re.search(r":\s*(?:#.*)?$", head):
            continue
        end = at
        while end < len(lines) and (not lines[end].strip() or len(_indent(lines[end])) > len(outer)):
            end += 1
        inner = lines[at:end]
        if any(x.strip() for x in inner):
            kept = [x for _, part in _kept(inner) for x in part]
            if not _body(kept):
                at_code = next(i for i, x in enumerate(inner) if x.strip())
                kept[at_code] = _indent(inner[at_code]) + "pass" + kept[at_code]
            changed |= kept != inner
            out += kept
            at = end
    return out if changed and _verdict(_body(out)) == "good" else None


def _kept(lines: list[str], top: bool = False) -> list[tuple[int, list[str]]]:
    """Parts (first line, lines) that cover the lines in order; what doesn't parse is blank, so that all places stay."""
    indent = "" if top else _indent(_body(lines))
    starts = [i for i, x in enumerate(lines) if x.strip() and _indent(x) == indent and not _GOES_ON.match(x.lstrip())]
    starts = ([] if starts[:1] == [0] else [0]) + starts
    bounds = [*starts, len(lines)]
    out: list[tuple[int, list[str]]] = []
    i = 0
    while i < len(starts):
        # join chunks only while the text ends too early
        j = i + 1
        verdict = _verdict(_body(lines[starts[i] : bounds[j]]))
        while verdict in ("more", "quotes") and j < len(starts):
            j += 1
            while verdict == "quotes" and j < len(starts) and not any(q in x for x in lines[bounds[j - 1] : bounds[j]] for q in ('"""', "'''")):
                j += 1
            verdict = _verdict(_body(lines[starts[i] : bounds[j]]))
        part = lines[starts[i] : bounds[j]]
        if verdict != "good":
            part = _inside(part)
        if part is None and j > i + 1:
            j = i + 1
            part = _inside(lines[starts[i] : bounds[j]])
        if part is None:
            # without its first line it may go on with the part before
            j = i + 1
            chunk = lines[starts[i] : bounds[j]]
            part = _blank_lines(chunk)
            rest = part[:1] + chunk[1:]
            if out and _body(out[-1][1]) and _body(rest):
                both = out[-1][1] + rest
                joined = both if _verdict(_body(both)) == "good" else _inside(both)
                if joined is not None:
                    out[-1] = (out[-1][0], joined)
                    i = j
                    continue
        out.append((starts[i], part))
        i = j
    return out


def mended(text: str) -> list[ast.stmt]:
    """The statements that parse of a Python text that doesn't, with their places in it.

    The text is cut at its top-level statements; chunks that only parse
    together are joined, and a compound statement with errors in its bodies
    keeps the statements there that parse. Merge marks are left out, so both
    sides stay.
    """
    lines = _LINE.findall(text)
    if any(x.startswith("<" * 7) for x in lines):
        lines = [_blank_lines([x])[0] if _MARK.match(x) else x for x in lines]
    out: list[ast.stmt] = []
    for begin, part in _kept(lines, top=True):
        if _body(part):
            deeper = bool(_indent(_body(part)))  # an indented block without a head
            tree = ast.increment_lineno(ast.parse("if 1:\n" * deeper + "".join(part)), begin - deeper)
            out += [*tree.body[0].body, *tree.body[1:]] if deeper else tree.body
    return out


class Python:
    """The walk over one Python file."""

    def __init__(self, path: str, text: str, all_names: bool):
        self.path, self.text, self.all_names = path, text, all_names
        self.found = Found(path)
        self.module = [x for x in re.sub(r"\.py[ix]?$", "", path.replace("\\", "/")).split("/") if x != "__init__"]
        self.lines = text.encode("utf-8", "replace").splitlines(keepends=True)

    def run(self) -> Found:
        self.found.node(_key(self.path, [], self.path), "file", self.path, (0, self.text.count("\n") + 1, 0, 0))
        self.body(self.parse(), _key(self.path, self.module, self.path), self.module)
        return self.found

    def parse(self) -> list[ast.stmt]:
        """The statements; of a file that doesn't parse, all that parse by themselves (see ``mended``)."""
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                return ast.parse(self.text).body
            except _UNPARSABLE as e:
                self.found.rows.append({"what": "diagnostic", "message": f"{type(e).__name__}: {e}"})
                return mended(self.text)

    def source(self, node: ast.AST) -> str:
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first][node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        return b"".join([self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]]).decode("utf-8", "replace")

    @staticmethod
    def place(node: ast.AST) -> tuple[int, int, int, int]:
        return node.lineno, node.end_lineno, node.col_offset, node.end_col_offset

    def purpose(self, body: list[ast.stmt]) -> str | None:
        first = next((s for s in body if isinstance(s, ast.Expr)), None)
        if first is None or not isinstance(first.value, ast.Constant) or not isinstance(first.value.value, str):
            return None
        return re.sub(r"^[rRuU]?(\"\"\"|'''|\"|')(.*)\1$", r"\2", self.source(first.value), flags=re.S).strip().split("\n")[0].strip()

    def decorated(self, node: ast.AST, meta: dict) -> dict:
        for d in node.decorator_list:
            name = self.source(d.func if isinstance(d, ast.Call) else d)
            if name in ("staticmethod", "classmethod"):
                meta["decorator"] = name
            elif name == "property":
                meta["property"] = True
            elif name == "abstractmethod":
                meta["abstract"] = True
            else:
                meta.setdefault("decorators", []).append(name)
        return meta

    def parameters(self, a: ast.arguments) -> list[dict[str, str]]:
        plain = [*a.posonlyargs, *a.args]
        pairs = list(zip(plain, [None] * (len(plain) - len(a.defaults)) + a.defaults)) + list(zip(a.kwonlyargs, a.kw_defaults))
        out = []
        for p, default in pairs:
            if p.arg in ("self", "cls") or p.annotation is not None and default is not None:
                continue
            out.append({"name": p.arg} | ({"type": self.source(p.annotation)} if p.annotation else {}) | ({"has_default": "true"} if default else {}))
        return out

    def body(self, statements: list[ast.stmt], parent: str, module: list[str], in_class: bool = False) -> list[str]:
        """Extracts the direct children; gives the keys of all nodes below, in order."""
        keys: list[str] = []
        for s in statements:
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef)):
                keys += self.function(s, parent, module, "method" if in_class else "function")
            elif isinstance(s, ast.ClassDef):
                keys += self.klass(s, parent, module)
            elif isinstance(s, (ast.Import, ast.ImportFrom)) and not in_class:
                self.imports(s, parent)
            elif isinstance(s, (ast.Assign, ast.AnnAssign)):
                name = self.source(s.targets[0] if isinstance(s, ast.Assign) else s.target)
                key = _key(self.path, module, name)
                self.found.edge(parent, key, "contains")
                self.found.node(key, "variable", name, self.place(s), {"class_attribute": True} if in_class else None, private=True)
                keys.append(key)
        return keys

    def function(self, s: ast.FunctionDef | ast.AsyncFunctionDef, parent: str, module: list[str], kind: str) -> list[str]:
        params, returns = self.parameters(s.args), self.source(s.returns) if s.returns else None
        signed = [s.name, *(p.get(k, "") for p in params for k in ("name", "type")), returns or ""]
        key = _key(self.path, module, s.name, hashlib.blake2b("\0".join(signed).encode("utf-8", "replace"), digest_size=8).hexdigest())
        meta: dict = {"parameters": params} if params else {}
        meta |= {"return_type": returns} if returns else {}
        meta |= {"async": True} if isinstance(s, ast.AsyncFunctionDef) else {}
        self.found.edge(parent, key, "contains")
        self.calls(s, key)
        self.found.node(key, kind, s.name, self.place(s), self.decorated(s, meta), self.purpose(s.body))
        nested = self.body(s.body, key, module)
        for k in nested:
            self.found.edge(key, k, "contains")
        return [key, *nested]

    def klass(self, s: ast.ClassDef, parent: str, module: list[str]) -> list[str]:
        key = _key(self.path, module, s.name)
        self.found.edge(parent, key, "contains")
        for base in s.bases:
            if isinstance(base, ast.Name):
                self.found.edge(key, _key(self.path, module, base.id), "inherits")
        self.found.node(key, "class", s.name, self.place(s), self.decorated(s, {}), self.purpose(s.body))
        return [key, *self.body(s.body, key, [*module, s.name], in_class=True)]

    def calls(self, s: ast.AST, key: str) -> None:
        inside = [c for part in ast.iter_child_nodes(s) if part not in s.decorator_list for c in ast.walk(part) if isinstance(c, ast.Call) and isinstance(c.func, (ast.Name, ast.Attribute))]
        for c in sorted(inside, key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset)):
            text = self.source(c.func)
            self.found.edge(key, _key(self.path, [], text), "calls", target_name=text)

    def imports(self, s: ast.Import | ast.ImportFrom, parent: str) -> None:
        if isinstance(s, ast.Import):
            for a in s.names:
                self.found.edge(parent, _key(self.path, [], a.name), "imports")
            return
        module = "." * s.level + (s.module or "")
        for a in s.names if self.all_names else s.names[:1]:
            if a.name == "*":
                self.found.edge(parent, _key(self.path, [], module), "imports")
            else:
                self.found.edge(parent, _key(self.path, [], a.name), "imports", **({"import_module": module} if module else {}))


_RUST_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|(?:b|c)?r(#*)\".*?\"\1|(?:b|c)?\"(?:[^\"\\]|\\.)*\"|b?'(?:[^'\\\n]|\\[^\n]{1,8}?)'", re.S)
_RUST_ITEM = re.compile(r"(?:pub(?:\s*\([^)]*\))?\s+)?(?:(?:default|async|const|unsafe|extern(?:\s+\"\s*\")?)\s+)*(fn|struct|enum|trait|impl|mod|use)\b\s*([^\W\d]\w*)?")
_RUST_CALL = re.compile(r"((?:[^\W\d]\w*|\))(?:\s*(?:\.|::)\s*(?:[^\W\d]\w*|<[^<>()]*>))*)\s*\(")
_RUST_WORDS = frozenset("if while match for return fn loop in let else move as mut ref impl where use pub struct enum trait mod".split())


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def rust(path: str, text: str) -> Found:
    """Top-level functions, structs, enums, traits, impls with their methods, modules and uses of a Rust file."""
    found = Found(path)
    module = [x for x in re.sub(r"\.rs$", "", path).split("/") if x not in ("mod", "lib")]
    found.node(_key(path, [], path), "file", path, (0, text.count("\n") + 1, 0, 0))
    clean = _RUST_NOISE.sub(_blank, text)
    _rust_items(found, path, text, clean, 0, len(clean), _key(path, module, path), module, None)
    return found


def _rust_end(clean: str, at: int, stop: int) -> tuple[int, int]:
    """(start of the body or -1, end) of the item that begins at ``at``."""
    depth, body = 0, -1
    for i in range(at, stop):
        c = clean[i]
        if c in "([{":
            if c == "{" and depth == 0:
                body = i
            depth += 1
        elif c in ")]}":
            depth -= 1
            if c == "}" and depth == 0:
                return body, i + 1
        elif c == ";" and depth == 0:
            return -1, i + 1
    return body, stop


def _rust_items(found: Found, path: str, text: str, clean: str, at: int, stop: int, parent: str, module: list[str], impl: str | None) -> None:
    kinds = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "mod": "module"}
    while at < stop:
        if clean[at].isspace() or clean[at] in "};":
            at += 1
            continue
        if clean[at] == "#":
            close = clean.find("]", at, stop)
            at = close + 1 if close > 0 else stop
            continue
        m = _RUST_ITEM.match(clean, at, stop)
        body, end = _rust_end(clean, at, stop)
        if m:
            place = (text.count("\n", 0, at) + 1, text.count("\n", 0, end) + 1, at - text.rfind("\n", 0, at) - 1, end - text.rfind("\n", 0, end) - 1)
            what, name = m[1], m[2]
            if what == "use" and not impl:
                found.edge(parent, _key(path, [], re.sub(r"^use ", "", text[at:end].strip()).rstrip(";").strip()), "imports")
            elif what == "impl" and not impl and body >= 0:
                head = re.sub(r"^impl\s*(?:<[^{]*?>(?=\s))?", "", " ".join(text[at:body].split())).strip()
                head = re.sub(r"\s+where\b.*$", "", head.split(" for ", 1)[-1]).strip()
                key = found.node(_key(path, module, f"impl {head}"), "trait_impl", f"impl {head}", place)
                _rust_items(found, path, text, clean, body + 1, end - 1, key, module, key)
            elif what in kinds and name and (not impl or what == "fn"):
                key = _key(path, [*module, name] if what == "mod" else module, name)
                if what == "fn" and body >= 0:
                    for c in _RUST_CALL.finditer(clean, body, end):
                        callee = text[c.start(1) : c.end(1)]
                        if not callee.startswith(")") and callee.split(".")[0].split("::")[0] not in _RUST_WORDS:
                            found.edge(key, _key(path, [], callee), "calls", target_name=callee)
                if not impl:
                    found.edge(parent, key, "contains")
                found.node(key, "method" if impl else kinds[what], name, place)
        at = max(end, at + 1)


def extract(files: DataFrame, all_names: bool = False) -> DataFrame:
    """Rows of ROW for every file: ``what`` is node, edge or diagnostic; ``ord`` is the order within the file.

    ``files`` has rel_path, language (python or rust; others are skipped) and
    content. Null content gives a diagnostic; a file that doesn't parse gives
    its file node, the nodes of all statements that parse and a diagnostic, and
    never ends the job. Empty content gives the file node.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for path, language, text in zip(batch["rel_path"], batch["language"], batch["content"]):
                if text is None:
                    found = Found(path)
                    found.rows.append({"what": "diagnostic", "message": "the content could not be read"})
                else:
                    try:
                        found = Python(path, text, all_names).run() if language == "python" else rust(path, text)
                    except Exception as e:  # one file never ends the job
                        found = Found(path)
                        found.rows.append({"what": "diagnostic", "message": f"{type(e).__name__}: {e}"})
                out += found.table()
            yield pd.DataFrame(out, columns=_COLUMNS).astype({c: "Int64" for c in ("ord", "line_start", "line_end", "col_start", "col_end", "hash")})

    return files.select("rel_path", "language", "content").filter(F.col("language").isin("python", "rust")).mapInPandas(run, ROW)


def nodes(rows: DataFrame) -> DataFrame:
    return rows.filter("what = 'node'").select(*[c.strip().split(" ")[0] for c in NODE.split(",")], "ord")


def edges(rows: DataFrame) -> DataFrame:
    return rows.filter("what = 'edge'").select("source_id", "target_id", "kind", "metadata_json", "rel_path", "ord")


def diagnostics(rows: DataFrame) -> DataFrame:
    """(file_path, line, message, severity)."""
    return rows.filter("what = 'diagnostic'").select(F.col("rel_path").alias("file_path"), F.lit(0).alias("line"), "message", F.lit("error").alias("severity"))
