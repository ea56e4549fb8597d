"""A source repository as a DataFrame of files; folders are walked and files read by the executors."""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import language

EXTENSIONS = (".py", ".pyi", ".pyx", ".rs")
READ_BYTES = 32 << 20  # text that a task holds before it hands it on


def _glob(pattern: str) -> re.Pattern:
    """A pattern in which ``*`` and ``?`` stay within a name and ``**`` stands for any folders."""
    out = ""
    for part in re.findall(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[!?\]?[^\]]*\]|\\.|.", pattern):
        known = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        if part in known:
            out += known[part]
        elif part[0] == "[" and len(part) > 2:
            out += "[" + part[1:].replace("!", "^", part[1] == "!")
        else:
            out += re.escape(part[-1])
    return re.compile(out, re.S)


class Ignore:
    """Rules of one folder's .gitignore and .ignore files; later rules win, ``!`` takes back."""

    def __init__(self, folder: str, git: bool):
        self.rules: list[tuple[re.Pattern, bool, bool, bool]] = []
        for name in (".gitignore",) * git + (".ignore",):
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    lines = f.read().splitlines()
            except (OSError, UnicodeDecodeError):
                continue
            for line in lines:
                line = line.rstrip()
                if line and not line.startswith("#"):
                    keep = line.startswith("!")
                    pattern = line[keep:]
                    self.rules.append((_glob(pattern.strip("/")), keep, pattern.endswith("/"), "/" in pattern.rstrip("/")))

    def verdict(self, rel: str, folder: bool) -> bool | None:
        found = None
        for pattern, keep, folders_only, anchored in self.rules:
            if folders_only and not folder:
                continue
            subject = rel if anchored else rel.rsplit("/", 1)[-1]
            if pattern.fullmatch(subject):
                found = not keep
        return found


def _walk(root: str, start: str, git: bool, rules: list[tuple[str, Ignore]], deep: bool) -> Iterator[tuple[str, bool]]:
    """(path relative to the root, whether it is a folder) below ``start``, without hidden and ignored ones; links aren't followed."""
    folder = os.path.join(root, start)
    rules = [*rules, (start, Ignore(folder, git))]
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        rel = f"{start}/{entry.name}" if start else entry.name
        if entry.name.startswith(".") or entry.is_symlink():
            continue
        is_folder = entry.is_dir(follow_symlinks=False)
        ignored = None
        for base, ignore in rules:
            said = ignore.verdict(rel[len(base) + 1 :] if base else rel, is_folder)
            ignored = ignored if said is None else said
        if ignored:
            continue
        if is_folder and deep:
            yield from _walk(root, rel, git, rules, True)
        elif is_folder or entry.name.endswith(EXTENSIONS):
            yield rel, is_folder


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, language, content, content_hash, error) of the Python and Rust files below ``root``.

    Hidden entries, links and what .gitignore (in a git work tree) and .ignore
    exclude are skipped. A file that isn't UTF-8 or can't be read has null
    content and an error. Folders are walked by the executors, one below the
    root to a task, which gives their paths only; the paths are then spread
    and the files read, at most READ_BYTES at a time.
    """
    root = os.path.abspath(root)
    git = os.path.isdir(os.path.join(root, ".git"))
    top = list(_walk(root, "", git, [], False))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above = [("", Ignore(root, git))]
        for batch in batches:
            for rel, is_folder in zip(batch["rel"], batch["is_folder"]):
                paths = _walk(root, rel, git, above, True) if is_folder else iter([(rel, False)])
                while some := list(itertools.islice(paths, 10_000)):
                    yield pd.DataFrame({"rel_path": [p for p, _ in some]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["rel_path", "content", "error"]
        for batch in batches:
            out, size = [], 0
            for path in batch["rel_path"]:
                try:
                    with open(os.path.join(root, path), encoding="utf-8", newline="") as f:
                        out.append((path, f.read(), None))
                except (OSError, UnicodeDecodeError) as e:
                    out.append((path, None, f"{type(e).__name__}: {e}"))
                size += len(out[-1][1] or "")
                if size > READ_BYTES:
                    yield pd.DataFrame(out, columns=columns)
                    out, size = [], 0
            yield pd.DataFrame(out, columns=columns)

    starts = spark.createDataFrame(top, "rel string, is_folder boolean").repartition(max(1, min(len(top), 1000)))
    paths = starts.mapInPandas(walk, "rel_path string")
    files = paths.repartition(spark.sparkContext.defaultParallelism * 4).mapInPandas(read, "rel_path string, content string, error string")
    return files.select(
        F.concat(F.lit(root.rstrip("/") + "/"), "rel_path").alias("path"), "rel_path", language(F.col("rel_path")).alias("language"), "content", F.sha2("content", 256).alias("content_hash"), "error"
    )
