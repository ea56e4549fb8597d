"""Source files that do not parse, by syntax repair of least cost.

1. Each file is cut into short token strings (frames) where it lies.
2. The distinct frames of the whole corpus, few next to the files, are parsed
   by a chart parser once each, however many files hold them; a file that holds
   a frame that doesn't parse needs edits.
3. These files are cut again with the line of every token and nothing merged,
   and their distinct frames are repaired by the error-correcting chart parser:
   least number of edits, and which tokens they insert, delete or replace.
4. A file's cost is the sum over its frames; where its edits lie tells
   truncation, merge conflicts and text of another language apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.chart import compile_rules
from skein.llm.frames import frames, whole_frames
from skein.llm.grammars import GRAMMARS
from skein.operators.skew import hot_values
from skein.scratch import Scratch, spread

FAR_OFF = 0.3  # lines with edits, as a share of a file's statements, from which it is text of another language

# fixed values: file extensions and their languages
LANGUAGES = {"py": "python", "pyi": "python", "pyx": "python", "rs": "rust"}

_RULES = GRAMMARS | {"br": compile_rules("Ctx : ( o1 Ctx c1 | o2 Ctx c2 | o3 Ctx c3 | o4 c4 ) *")}
_EDITS = "array<struct<op: string, at: int, token: string, end: boolean>>"


def _given(files: DataFrame) -> DataFrame:
    return files.select("rel_path", "content").filter("content IS NOT NULL").filter(F.substring_index("rel_path", ".", -1).isin(list(LANGUAGES)))


def file_frames(files: DataFrame) -> DataFrame:
    """(rel_path, frames): the distinct frames of every stored row whose extension has a grammar and whose content isn't null."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"rel_path": batch["rel_path"], "frames": [list(dict.fromkeys(f for f, _ in frames(p, t))) for p, t in zip(batch["rel_path"], batch["content"])]})

    return spread(_given(files)).mapInPandas(cut, "rel_path string, frames array<string>")


def lined_frames(files: DataFrame) -> DataFrame:
    """(rel_path, statements, tail, frames): every frame with the lines of its tokens; how many lines begin one, and the last of these."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, text in zip(batch["rel_path"], batch["content"]):
                found = whole_frames(path, text)
                begins = {lines[0] for f, lines in found if not f.startswith("br:")}
                out.append((path, len(begins), max(begins, default=0), [{"frame": f, "lines": lines} for f, lines in found]))
            yield pd.DataFrame(out, columns=["rel_path", "statements", "tail", "frames"])

    return spread(_given(files)).mapInPandas(cut, "rel_path string, statements int, tail int, frames array<struct<frame: string, lines: array<int>>>")


def _split(frame: str) -> tuple[str, str, list[str]]:
    language, rest = frame.split(":", 1)
    rule, *tokens = rest.split(" ")
    return language, rule, [t for t in tokens if t]


def parses(frame: str) -> bool:
    language, rule, tokens = _split(frame)
    return _RULES[language].parse(rule, tokens) < 0


def frame_repair(frame: str, effort: float = float("inf")) -> tuple[int, bool, list[tuple[str, int, str, bool]]]:
    """(least number of edits, whether that is exact, edits); an edit's last part tells whether it adds what is missing at the frame's end."""
    language, rule, tokens = _split(frame)
    cost, exact, edits = _RULES[language].repair(rule, tokens, effort)
    opened = language == "br" and all(t.startswith("o") for t in tokens)
    return cost, exact, [(op, at, token, opened or at >= len(tokens) - 1) for op, at, token in edits]


def wrong_frames(distinct: DataFrame) -> DataFrame:
    """(frame) of the frames (one string column) that don't parse."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[not parses(f) for f in batch["frame"]]]

    return _over_all_cores(distinct).mapInPandas(parse, "frame string")


def repaired_frames(distinct: DataFrame) -> DataFrame:
    """(frame, cost, exact, edits) of the frames that need edits."""

    def repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(f, *frame_repair(f)) for f in batch["frame"]]
            yield pd.DataFrame([(f, cost, exact, [dict(zip(("op", "at", "token", "end"), e)) for e in edits]) for f, cost, exact, edits in out if cost], columns=["frame", "cost", "exact", "edits"])

    return _over_all_cores(distinct).mapInPandas(repair, f"frame string, cost int, exact boolean, edits {_EDITS}")


def _over_all_cores(distinct: DataFrame) -> DataFrame:
    """Few, short rows that are slow to parse, in as many partitions as keep all cores busy, which AQE would merge into one."""
    return distinct.repartition(4 * distinct.sparkSession.sparkContext.defaultParallelism, "frame")


def _with(each: DataFrame, bad: DataFrame) -> DataFrame:
    """``each`` joined with ``bad`` on frame; frames that nearly every file has (at most 200) are joined by broadcast, so that none fills one task."""
    hot = hot_values(each.select("frame"), "frame", 0.005)
    if not hot:
        return each.join(bad, "frame")
    return each.filter(F.col("frame").isin(hot)).join(F.broadcast(bad.filter(F.col("frame").isin(hot))), "frame").unionByName(each.filter(~F.col("frame").isin(hot)).join(bad.filter(~F.col("frame").isin(hot)), "frame"))


def rejected(files: DataFrame) -> DataFrame:
    """(rel_path) of the files that hold a frame which doesn't parse, once each; no repair is needed to know them."""
    scratch = Scratch(files.sparkSession, "syntax")
    each = scratch.save(file_frames(files)).select("rel_path", F.explode("frames").alias("frame"))
    wrong = scratch.save(wrong_frames(each.select("frame").distinct()))
    return scratch.save(_with(each, wrong).select("rel_path").distinct())


def repaired(files: DataFrame) -> DataFrame:
    """(rel_path, language, cost, exact, edited, first_line, last_line, reason) of the files whose text needs edits to parse.

    cost is the least number of edits, summed over all frames of the file.
    exact is true: no frame's search is given up. edited counts lines with edits, first_line and last_line are the first and last of them.
    reason is told by where the edits lie and what they do: ``conflict`` if one
    takes a conflict mark out, ``other_language`` if the lines with edits are
    many next to the file's statements, ``truncated`` if all of them lie at the
    end of the last statement (anywhere in it if a bracket or text is left open
    there), else ``broken``. Null content, empty
    content and other extensions give no row; repeated rows of a path one row.
    """
    scratch = Scratch(files.sparkSession, "syntax")
    texts = files.join(rejected(files), "rel_path", "left_semi").groupBy("rel_path").agg(F.first("content", ignorenulls=True).alias("content"))
    lined = scratch.save(lined_frames(texts)).select("rel_path", "statements", "tail", F.inline("frames"))
    held = _with(lined, scratch.save(repaired_frames(lined.select("frame").distinct())))
    place = lambda e: F.coalesce(F.get("lines", e["at"]), F.element_at("lines", -1))
    late = lambda e: place(e) >= F.col("tail")
    opened = F.col("frame").rlike("^br:Ctx (o[1-4] ?)+$")
    places = F.transform("edits", place)
    per_file = held.select(
        "rel_path", "statements", "cost", "exact", F.array_min(places).alias("first"), F.array_max(places).alias("last"), F.size(F.array_distinct(places)).alias("edited"),
        (opened | F.forall("edits", lambda e: late(e) & e["end"])).alias("at_end"), (opened | F.forall("edits", late)).alias("late"), opened.alias("opened"), F.exists("edits", lambda e: (e["token"] == "mark") | (F.get(F.split(F.substring_index("frame", ":", -1), " "), e["at"] + 1) == "mark") & (e["op"] != "insert")).alias("marked"),
    ).groupBy("rel_path").agg(
        F.sum("cost").cast("bigint").alias("cost"),
        F.min("exact").alias("exact"),
        F.sum("edited").cast("bigint").alias("edited"),
        F.min("first").cast("bigint").alias("first_line"),
        F.max("last").cast("bigint").alias("last_line"),
        F.max("statements").alias("statements"),
        (F.min("at_end") | F.min("late") & F.max("opened")).alias("at_end"),
        F.max("marked").alias("marked"),
    )
    reason = F.when(F.col("marked"), "conflict").when(F.col("edited") > F.greatest(F.lit(2), F.col("statements") * FAR_OFF), "other_language").when(F.col("at_end"), "truncated").otherwise("broken")
    return per_file.select("rel_path", _language().alias("language"), "cost", "exact", "edited", "first_line", "last_line", reason.alias("reason"))


def _language():
    ext = F.substring_index("rel_path", ".", -1)
    return F.coalesce(*(F.when(ext == k, v) for k, v in LANGUAGES.items()))


def failure_rates(found: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, language, files, failed, failed_per_10000) over files with content, by the path's first folder and extension.

    Files are counted first by path and then by group, so that a repository
    with most of the rows is no burden.
    """
    paths = files.filter("content IS NOT NULL").select("rel_path").filter(F.substring_index("rel_path", ".", -1).isin(list(LANGUAGES))).distinct()
    both = paths.join(found.select("rel_path", F.lit(1).alias("failed")), "rel_path", "left")
    counted = both.groupBy(F.substring_index("rel_path", "/", 1).alias("repo"), _language().alias("language")).agg(F.count(F.lit(1)).alias("files"), F.count("failed").alias("failed"))
    return counted.withColumn("failed_per_10000", F.floor(F.col("failed") * 10000 / F.col("files")))
