"""Functions paired with their documentation.

What a function's record states and the comments of its file are candidates.
Functions and candidates of a file are matched by a bipartite assignment of
least cost: a link costs its distance in lines, less for parameter tags and
words of the name that agree, more for tags that name other parameters. A
function takes one comment and its own record (at no distance) at most; the
record is its documentation if both were matched. Implausible links and records
that say nothing beyond the name aren't offered; a comment that says nothing
still takes its function, so that no other one is put in its place.

Functions with a place in a text they have meet it file by file, so that a
group holds what one text holds; all others have their record alone and stay
where they lie, so that rows without a path or a file are no group.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.triviality import _stem, _words, informative

REACH = 6  # lines between a comment and a function, beyond decorators, attributes and the function's head
DEAREST = 7.0  # cost from which a link isn't plausible

_PARAM = re.compile(r"(?::param(?:\s+[\w\[\], ]+)?\s+|@param\s+|\\param\s+)(\w+)")
_ARGS = re.compile(r"(?m)^\s*(?:[*-]\s+)?`?(\w+)`?(?:\s*\([^)]*\))?\s*(?::| - )")
_SETTING = re.compile(r"#!|#.*coding[:=]")  # fixed value: lines for the system or the tools, no comments
_OPEN = re.compile(r"^\s*[rRuU]?(\"\"\"|''')")


def stated(semantic_json: str | None) -> str | None:
    """``purpose``, or ``summary`` where that is null or blank; None for what isn't a JSON object."""
    try:
        record = json.loads(semantic_json) if semantic_json else None
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    for field in ("purpose", "summary"):
        if isinstance(record.get(field), str) and record[field].strip():
            return record[field]
    return None


def comments(content: str, rust: bool) -> list[tuple[int, int, str, bool]]:
    """(first line, last line, text, inside) of comment blocks; inside: it stands in the body it describes (a docstring)."""
    found, lines, at = [], content.splitlines(), 0
    marks = ("///", "//!", "//") if rust else ("#",)
    while at < len(lines):
        bare, begin = lines[at].strip(), at
        if at < 2 and not rust and _SETTING.match(bare):
            at += 1
            continue
        if bare.startswith(marks):
            block = []
            while at < len(lines) and lines[at].strip().startswith(marks):
                block.append(re.sub(r"^(?:///?!?|#+!?)\s?", "", lines[at].strip()))
                at += 1
            found.append((begin + 1, at, "\n".join(block), False))
            continue
        quote = None if rust else _OPEN.match(lines[at])
        if quote or rust and bare.startswith("/*"):
            end = quote[1] if quote else "*/"
            rest = lines[at][quote.end() :] if quote else bare[2:]
            block = []
            while end not in rest and at + 1 < len(lines):
                block.append(rest)
                at += 1
                rest = lines[at]
            block.append(rest.split(end)[0])
            found.append((begin + 1, at + 1, "\n".join(x.strip(" *") for x in block).strip(), not rust))
        at += 1
    return found


def reached(lines: list[str], comment: tuple[int, int, str, bool], starts: set[int]) -> list[tuple[int, float]]:
    """(start, gap) of the functions, by their first lines, that a comment is near to.

    The gap counts the lines between the two, without decorators, attributes,
    the head of the function and, above a docstring, blank lines. Heads and
    decorators may have any number of lines.
    """
    first, last, _, inside = comment
    out, gap = [], 0
    if not inside:
        for s in range(last + 1, len(lines) + 1):
            if s in starts:
                out.append((s, float(gap)))
            gap += not lines[s - 1].strip().startswith(("@", "#["))
            if gap > REACH:
                break
        return out
    head = -1  # the gap from the nearest end of a head above
    for s in range(first - 1, 0, -1):
        bare = lines[s - 1].strip()
        if bare.endswith(":") and not bare.startswith("@"):
            head = gap
        if max(head, 0 if head >= 0 else gap) > REACH:
            break
        if s in starts and head >= 0:
            out.append((s, float(head)))
        gap += bool(bare)
    return out


def link_cost(gap: float, text: str, name: str, params: set[str]) -> float:
    tags = set(_PARAM.findall(text)) | (set(_ARGS.findall(text)) & params)
    own = {_stem(w) for w in _words(name)}
    shared = len(own & {_stem(w) for w in _words(text)}) / max(1, len(own))
    return gap + 1.0 - 2.0 * shared - 2.0 * (len(tags & params) / max(1, len(tags))) + 3.0 * len(tags - params) / max(1, len(tags))


def assign(links: dict[tuple[int, int], float], skip: float) -> dict[int, int]:
    """Function -> comment of least total cost, where leaving a function without a comment costs ``skip``.

    Connected components are solved one by one, by shortest augmenting paths.
    """
    root: dict[tuple[str, int], tuple[str, int]] = {}

    def find(x: tuple[str, int]) -> tuple[str, int]:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for f, c in links:
        root[find(("f", f))] = find(("c", c))
    parts: dict[tuple[str, int], dict[tuple[int, int], float]] = {}
    for (f, c), cost in links.items():
        parts.setdefault(find(("f", f)), {})[f, c] = cost
    chosen: dict[int, int] = {}
    for part in parts.values():
        rows, columns = sorted({f for f, _ in part}), sorted({c for _, c in part})
        if len(part) == 1:
            chosen |= {f: c for (f, c), cost in part.items() if cost < skip}
            continue
        costs = np.full((len(rows), len(columns) + len(rows)), skip)
        for i, f in enumerate(rows):
            for j, c in enumerate(columns):
                costs[i, j] = part.get((f, c), 1e6)
        chosen |= {rows[i]: columns[j] for i, j in enumerate(_least(costs)) if j < len(columns)}
    return chosen


def _least(costs: np.ndarray) -> list[int]:
    """The column of each row in the assignment of least cost; there are at least as many columns as rows."""
    n, m = costs.shape
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for i in range(n):
        reach, back, seen, row, last = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool), i, -1
        while True:
            through = costs[row] - u[row] - v + (reach[last] if last >= 0 else 0.0)
            better = ~seen & (through < reach)
            reach[better], back[better] = through[better], last
            last = int(np.argmin(np.where(seen, np.inf, reach)))
            seen[last] = True
            if owner[last] < 0:
                break
            row = owner[last]
        final = reach[last]
        for j in np.flatnonzero(seen):
            if owner[j] >= 0:
                u[owner[j]] += final - reach[j]
            v[j] -= final - reach[j]
        u[i] += final
        while last >= 0:  # turn the path round
            before = back[last]
            owner[last] = owner[before] if before >= 0 else i
            last = before
    column = [0] * n
    for j, i in enumerate(owner):
        if i >= 0:
            column[i] = j
    return column


def _parameters(metadata_json: str | None) -> set[str]:
    try:
        given = json.loads(metadata_json or "{}").get("parameters") or []
        return {p["name"] if isinstance(p, dict) else str(p) for p in given}
    except (ValueError, AttributeError, KeyError, TypeError):
        return set()


def functions(nodes: DataFrame) -> DataFrame:
    """One row per id of kind function or method: place, name, metadata and its informative stated documentation (null if none)."""
    rows = nodes.filter("kind IN ('function', 'method') AND id IS NOT NULL")

    def read(records: pd.Series, names: pd.Series) -> pd.Series:
        texts = (stated(r) for r in records)
        return pd.Series([t if informative(t, n) else None for t, n in zip(texts, names)], dtype=object)

    rows = rows.withColumn("stated", F.when(F.col("semantic_json").isNotNull(), F.pandas_udf(read, "string")("semantic_json", "name")))
    return rows.groupBy("id").agg(
        *(F.min(c).alias(c) for c in ("file_path", "name", "metadata_json", "stated")),
        F.min(F.struct("line_start", "line_end")).alias("lines"),
    )


def documented(nodes: DataFrame, files: DataFrame, code: bool = True) -> DataFrame:
    """(id, name, documentation, source, code) for every function or method with documentation that says something.

    source is ``record`` or ``comment``, by the candidate that the assignment
    gave it. code (null if not asked for) is null where the file, its content
    or the lines aren't known. An id in several rows counts once; any
    informative record will do. Functions without either get no row.
    """
    funcs = functions(nodes).select("id", "file_path", "name", "metadata_json", "stated", F.col("lines.line_start").alias("line_start"), F.col("lines.line_end").alias("line_end"))
    known = "file_path IS NOT NULL AND line_start >= 1 AND line_end >= 1"
    texts = files.filter("content IS NOT NULL AND content <> ''").groupBy("rel_path").agg(F.first("content").alias("content"))
    sizes = texts.select(F.col("rel_path").alias("file_path"), (F.length("content") - F.length(F.translate("content", "\n", "")) + 1).alias("size"))
    both = funcs.filter(known).join(sizes, "file_path", "left")
    fields = [f for f in funcs.columns if f != "file_path"]
    per_file = both.filter("line_start <= size").groupBy("file_path").agg(F.collect_list(F.struct(*fields)).alias("functions"))
    placed = per_file.join(texts, per_file["file_path"] == texts["rel_path"]).select("file_path", "functions", "content")
    alone = both.filter("size IS NULL OR line_start > size").select(*funcs.columns).unionByName(funcs.filter(f"NOT coalesce({known}, false)"))
    schema = "id string, name string, documentation string, source string, code string"
    columns = schema.replace(" string", "").split(", ")

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, given, content in zip(batch["file_path"], batch["functions"], batch["content"]):
                out += match_file(path, sorted(given, key=lambda f: f["id"]), content, code)
            yield pd.DataFrame(out, columns=columns)

    def match_alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for f in batch.to_dict("records") for row in match_file("", [f], "", False)]
            yield pd.DataFrame(out, columns=columns)

    return placed.mapInPandas(match, schema).unionByName(alone.filter("stated IS NOT NULL").mapInPandas(match_alone, schema))


def match_file(path: str, given: list[dict], content: str, code: bool) -> list[tuple]:
    """The rows of ``documented`` for functions of one file."""
    lines = content.splitlines()
    by_start: dict[int, list[int]] = {}
    for i, f in enumerate(given):
        if lines:
            by_start.setdefault(int(f["line_start"]), []).append(i)
    blocks = comments(content, path.endswith(".rs")) if lines else []
    found = [c[2] for c in blocks]
    params = [_parameters(f["metadata_json"]) for f in given]
    links = {}
    starts = set(by_start)
    for j, c in enumerate(blocks):
        for start, gap in reached(lines, c, starts):
            for i in by_start[start]:
                cost = link_cost(gap, c[2], given[i]["name"] or "", params[i])
                if cost < DEAREST:
                    links[i, j] = cost
    for i, f in enumerate(given):
        if f["stated"]:  # informative, see ``functions``
            cost = link_cost(0.0, f["stated"], f["name"] or "", params[i])
            if cost < DEAREST:
                links[len(given) + i, len(found) + i] = cost
    matched = assign(links, DEAREST)
    out = []
    for i, f in enumerate(given):
        if len(given) + i in matched:
            text, source = f["stated"], "record"
        elif i in matched and informative(found[matched[i]], f["name"]):
            text, source = found[matched[i]], "comment"
        else:
            continue
        shown = "\n".join(lines[int(f["line_start"]) - 1 : int(f["line_end"])]) if code and lines else None
        out.append((f["id"], f["name"], text, source, shown))
    return out
