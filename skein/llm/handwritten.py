"""Generated, minified, vendored and data files among source files, by a linear support-vector classifier.

The classifier decides by hashed n-grams and path components alone: byte
4-grams of the text without its opening and closing comments, byte 5-grams of
these comments with giveaway phrases and the repository's own name masked, the
folders and the pieces of the file's name, and the word 5-grams that known
package files hold too.

Rules with a plain public meaning (a giveaway phrase, a folder or file name
for generated or third-party code, most of a known package file, squeezed
lines, nothing but literals) only label the rows that it is fitted on; known
package files are further examples. They take no part in judging. Every row is
labelled: those of four fifths of the repositories are fitted on, and the
margin from which a file is found is the best one on all of the others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LinearSVCModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from skein.scratch import Scratch, spread

COPY = 0.8  # share of a file's five-word shingles in known package files from which a row's label is a copy
GROUPS = {"text": 1 << 13, "comment": 1 << 12, "path": 1 << 14, "known": 1 << 8}  # places of the hashed features of each group
SCALES = {"text": 1.0, "comment": 1.5, "path": 2.5, "known": 12.0}  # length of each group's features (known: times the share)
STARTS = dict(zip(GROUPS, np.cumsum([0, *GROUPS.values()]).tolist()))
PLACES = sum(GROUPS.values())
KNOWN_BITS = 26  # the shingles of package files are kept as a bitmap of 2 ** KNOWN_BITS bits (8 MB), however many there are
PIECE = 256  # rows whose features a task holds at a time
REG, STEPS, POSITIVE_WEIGHT = 1e-4, 30, 3.0
MARGINS = [round(-1 + 0.05 * i, 2) for i in range(41)]  # margins that are tried on the repositories held out
RULES = ("marked", "folder", "named", "copied", "squeezed", "literal")
_STORED = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"  # a sparse vector as it is stored

# fixed values: folder names for what tools made and for code of others
FOLDERS = frozenset("vendor _vendor vendored third_party thirdparty third-party 3rdparty extern external deps node_modules site-packages generated __generated__ autogen autogenerated auto_generated gen _generated".split())
# fixed values: endings of file names that tools give to what they write
_NAMED = re.compile(r"(?i)(?:_pb2(?:_grpc)?|[._-](?:gen|generated|autogen|min|bundle))\.\w+$")
# fixed values: what an opening or closing comment says about a file that nobody wrote here
_GIVEAWAY = re.compile(
    r"(?i)@generated\b|\b(?:code|file|module|source)\s+(?:was\s+|is\s+)?(?:auto(?:matically)?[- ]?)?(?:generated|produced|created)\s+(?:automatically\s+)?(?:by|from|with|using)\b"
    r"|\bauto[- ]?generated\s+(?:file|code|by|from|on)\b|\bautomatically\s+(?:generated|produced|created)\b|\b(?:generated|produced)\s+(?:automatically\s+)?by\s+[`'\"]?\w+"
    r"|\bmachine[- ](?:written|generated|made)\b|\bdo not (?:edit|modify|change)(?:\s+(?:by hand|manually|this file|directly))?\s*[.!-]*\s*$"
    r"|\b(?:copied|vendored) (?:verbatim )?from\s+\S+|\bvendored copy\b|^upstream:|^source:\s+\S+\.\w+"
)
_DENIED = re.compile(r"(?i)\b(?:written|maintained|edited) by hand\b|\bhand[- ]?written\b|\bnot (?:auto-?)?generated\b")
# possessive, so that the time is linear at any length of a line
_LITERAL = re.compile(r"""(?:[\s\[\](){},:;.+\-*/|&]|\d[\w.]*+|[bBrRuUfF]{0,2}+(?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+')|(?:True|False|None|true|false)\b)*+""")
# one name that gets bytes, a run of code characters (hex, base64) or a list, map or tuple; a text with blanks or pattern marks is no data
_ASSIGNS = re.compile(r"""(?:(?:pub(?:\([^)]*\))?\s+)?(?:static|const)\s+(?:mut\s+)?\w+\s*:\s*[^=]+=|\w+\s*(?::\s*[^='"]+)?=)\s*(?=&?\s*[\[({]|[rR]?[bB][rR]?["']|(["'])[\w+/=\\-]*+\1)""")
_OPENS = re.compile(r"""^\s*(?:(?:pub(?:\([^)]*\))?\s+)?(?:static|const)\s+(?:mut\s+)?\w+\s*:\s*[^=]+=|[\w.]+\s*(?::\s*[^=]+)?=)\s*&?[\[({]\s*$""")
_TEXTS = re.compile(r"(?ms)^\w+\s*(?::\s*\w+\s*)?=\s*[rRbBuU]{0,2}(\"\"\"|''').*?\1")


def opening(text: str) -> list[str]:
    """Lines of the comments before the first line of code, without their marks."""
    out, block = [], False
    for line in text.splitlines():
        s = line.strip()
        if block or s.startswith("/*"):
            block = "*/" not in s
            out.append(s.strip("/* "))
        elif s.startswith("#") and not s.startswith(("#[", "#![")) or s.startswith("//"):
            out.append(s.lstrip("#/! "))
        elif s:
            break
    return out


def closing(text: str) -> list[str]:
    """Lines of the comments after the last line of code, without their marks."""
    out: list[str] = []
    for line in reversed(text.splitlines()):
        s = line.strip()
        if s.startswith("#") and not s.startswith(("#[", "#![")) or s.startswith("//"):
            out.append(s.lstrip("#/! "))
        elif s:
            break
    return out[::-1]


def squeezed(text: str) -> bool:
    """Most of the text stands in very long lines of very short names."""
    bare = [re.sub(r"\"[^\"]*\"|'[^']*'", "''", x) for x in text.splitlines() if len(x) > 200]  # a long text in quotes isn't squeezed code
    names = re.findall(r"[^\W\d]\w*", " ".join(bare))
    return sum(map(len, bare)) > 0.6 * max(1, len(text.strip())) and bool(names) and sum(map(len, names)) < 3.5 * len(names)


def literal_share(text: str) -> float:
    """Share of the characters (without comments and blanks) in lines that hold nothing but literals or give one to a name, or open such a block."""
    data = total = sum(len(m[0]) for m in _TEXTS.finditer(text))
    if total:
        text = _TEXTS.sub("", text)
    for line in text.splitlines():
        s = line.strip()
        if not s or s.startswith(("#", "//")) and not s.startswith("#["):
            continue
        body = re.sub(r"\s+(?:#|//).*$", "", s)
        total += len(body)
        given = _ASSIGNS.match(body)
        if _LITERAL.fullmatch(body, given.end() if given else 0) or _OPENS.match(body):
            data += len(body)
    return data / total if total else 0.0


_WORD_BYTES = np.array([chr(i).isalnum() or i == 95 or i >= 128 for i in range(256)])
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, 0x100000001B3, np.uint64))


def marked(comments: list[str]) -> bool:
    return any(_GIVEAWAY.search(x) and not _DENIED.search(x) for x in comments)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _PRIME
    return h ^ (h >> np.uint64(29))


def shingles(text: str) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of five words."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inside = _WORD_BYTES[data]
    begin = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]])) if len(data) else np.zeros(0, np.int64)
    if len(begin) < 5:
        return np.zeros(0, np.uint64)
    letters, at = data[inside].astype(np.uint64) + np.uint64(1), np.flatnonzero(inside)
    first = np.searchsorted(at, begin)
    offset = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    words = _mixed(np.add.reduceat(letters * _POWERS[offset % len(_POWERS)], first))
    h = np.zeros(len(words) - 4, np.uint64)
    for k in range(5):
        h = h * _PRIME + words[k : len(words) - 4 + k]
    return np.unique(_mixed(h))


def grams(text: str, size: int, places: int) -> np.ndarray:
    """The place of each run of ``size`` bytes."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    if len(data) < size:
        return np.zeros(0, np.int64)
    h = np.zeros(len(data) - size + 1, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + data[k : len(data) - size + 1 + k]
    return (_mixed(h) % np.uint64(places)).astype(np.int64)


def name_parts(path: str) -> list[str]:
    """Folders below the repository and the pieces of the file's name after its first, without outer underscores."""
    _, *rest = path.split("/")
    return [x.lower().strip("_") for x in (*rest[:-1], *(re.split(r"[._-]", rest[-1])[1:] if rest else ()))]


class Known:
    """A bitmap of the shingles of known package files."""

    def __init__(self, bitmap: np.ndarray):
        self.bitmap = bitmap

    def held(self, own: np.ndarray) -> np.ndarray:
        """Those of the shingles that some package file holds."""
        at = own >> np.uint64(64 - KNOWN_BITS)
        return own[(self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]


class Looked:
    """What rules and features need of one file."""

    def __init__(self, path: str, text: str, known: Known):
        self.path = path or ""
        self.begin, self.end = opening(text), closing(text)
        lines, first, last = text.splitlines(), len(self.begin), len(self.end)
        while first and lines:
            first -= bool(lines.pop(0).strip())
        while last and lines:
            last -= bool(lines.pop().strip())
        self.text, self.body = text, "\n".join(lines)
        self.shingles = shingles(text)
        self.held = known.held(self.shingles)

    def rules(self) -> list[bool]:
        share = len(self.held) / max(1, len(self.shingles))
        folders = self.path.split("/")[1:-1]
        return [marked([*self.begin, *self.end]), any(x.lower() in FOLDERS for x in folders), bool(_NAMED.search(self.path)), share >= COPY, squeezed(self.text), literal_share(self.text) >= 0.85]

    def masked_comments(self) -> str:
        """The comments at either end without giveaway phrases, the repository's name and digits."""
        repo = self.path.split("/")[0]
        lines = (_GIVEAWAY.sub(" ", x.replace(repo, "") if repo else x) for x in (*self.begin, *self.end))
        return "\n".join(re.sub(r"\d+", "0", x.lower()) for x in lines if x.strip())

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, values) of the hashed features, the groups one after another."""
        found = {
            "text": grams(self.body, 4, GROUPS["text"]),
            "comment": grams(self.masked_comments(), 5, GROUPS["comment"]),
            "path": np.concatenate([np.zeros(0, np.int64), *(_mixed(np.array([hash_name(x)], np.uint64)) % np.uint64(GROUPS["path"]) for x in name_parts(self.path))]).astype(np.int64),
            "known": (self.held % np.uint64(GROUPS["known"])).astype(np.int64),
        }
        places, values = [], []
        for group, hashed in found.items():
            at, n = np.unique(hashed, return_counts=True)
            if group == "known":
                v = n / max(1, len(self.shingles))
            else:
                v = np.log1p(n) if group == "text" else np.ones(len(at))
                v = v / max(1e-9, float(np.linalg.norm(v)))
            places.append(at + STARTS[group])
            values.append(v * SCALES[group])
        return np.concatenate(places), np.concatenate(values)


def hash_name(name: str) -> int:
    h = 7
    for b in name.encode("utf-8", "replace"):
        h = (h * 0x100000001B3 + b) & 0xFFFFFFFFFFFFFFFF
    return h


def _given(files: DataFrame) -> DataFrame:
    return files.select("rel_path", "content").filter("rel_path IS NOT NULL AND trim(content) <> ''")


def known_bitmap(packages: DataFrame) -> np.ndarray:
    """The bitmap of the shingles of all package texts, put together on the executors (Spark's bitmaps of 32768 bits each)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = [shingles(t) >> np.uint64(64 - KNOWN_BITS) for t in batch["content"]]
            yield pd.DataFrame({"at": np.unique(np.concatenate([np.zeros(0, np.uint64), *at])).astype(np.int64) + 1})

    at = packages.select("content").dropna().mapInPandas(cut, "at bigint")
    parts = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros((1 << KNOWN_BITS - 15, 4096), np.uint8)
    for r in parts:  # at most 2048 rows of 4 KB
        out[r["bucket"] - 1] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out.ravel()


def _held_out() -> str:
    return "pmod(xxhash64(split(rel_path, '/')[0]), 5) = 0"


def featured(rows: DataFrame, bitmap) -> DataFrame:
    """(rel_path, package, features, <rules>) of every row of (rel_path, content, package): the only pass over the texts."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(bitmap.value)
        for batch in (whole.iloc[i : i + PIECE] for whole in batches for i in range(0, len(whole), PIECE)):
            out = []
            for path, text, package in zip(batch["rel_path"], batch["content"], batch["package"]):
                seen = Looked(path, text, known)
                places, values = seen.features()
                out.append((path, bool(package), (0, PLACES, places.astype(np.int32), values), *map(bool, seen.rules())))
            yield pd.DataFrame(out, columns=["rel_path", "package", "features", *RULES])

    return spread(rows).mapInPandas(look, f"rel_path string, package boolean, features {_STORED}, " + ", ".join(f"{r} boolean" for r in RULES))


def _written(rows: DataFrame) -> DataFrame:
    """The rows of ``featured``, written once; the features as vectors."""
    schema = StructType.fromDDL("rel_path string, package boolean, " + ", ".join(f"{r} boolean" for r in RULES)).add(StructField("features", VectorUDT()))
    return rows.sparkSession.read.schema(schema).parquet(Scratch(rows.sparkSession, "handwritten").write(rows))


def _labelled(rows: DataFrame) -> DataFrame:
    """(label, held_out, features) of the rows of ``_written``."""
    return rows.select(F.expr(f"double(package OR {' OR '.join(RULES)})").alias("label"), (F.expr(_held_out()) & ~F.col("package")).alias("held_out"), "features")


def fit(rows: DataFrame) -> tuple[np.ndarray, float] | None:
    """(weights, the last being the intercept; margin) of (label, held_out, features); None if a class is missing.

    Fitted on all rows that aren't held out; the margin gives the best F1 on
    all that are (0 without any labelled row there).
    """
    kept = rows.filter("NOT held_out").withColumn("weight", F.when(F.col("label") == 1, POSITIVE_WEIGHT).otherwise(1.0))
    if kept.select("label").distinct().count() < 2:
        return None
    model = LinearSVC(maxIter=STEPS, regParam=REG, standardization=False, weightCol="weight", aggregationDepth=2).fit(kept)
    weights = np.append(model.coefficients.toArray(), model.intercept)
    return weights, _margin(model.transform(rows.filter("held_out")))


def _margin(judged: DataFrame) -> float:
    """The margin of the best F1 (of equal ones the nearest to 0), 0 without labelled rows."""
    rows = judged.select(F.col("label") == 1, vector_to_array("rawPrediction")[1]).toDF("label", "score")
    tried = rows.select("label", F.explode(F.filter(F.array(*map(F.lit, MARGINS)), lambda m: F.col("score") > m)).alias("margin"))
    found = tried.groupBy("margin").agg(F.count(F.lit(1)).alias("found"), F.count(F.when(F.col("label"), 1)).alias("both")).collect()
    labelled = rows.filter("label").count()
    best = max(((2 * r["both"] / (r["found"] + labelled), -abs(r["margin"]), r["margin"]) for r in found if r["both"]), default=(0.0, 0.0, 0.0))
    return best[2]


def _raw(rows: DataFrame, weights: np.ndarray, intercept: float, out: str) -> DataFrame:
    """``rows`` with the features' product with the weights, plus the intercept, as ``out``; worked out in the JVM row by row."""
    linear = LinearSVCModel(JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LinearSVCModel", f"handwritten_{out}", Vectors.dense(weights), float(intercept)))
    judged = linear.setRawPredictionCol("raw").setPredictionCol("").transform(rows)
    return judged.withColumn(out, vector_to_array("raw")[1]).drop("raw")


def _judge(rows: DataFrame, fitted: tuple[np.ndarray, float] | None, rules: bool) -> DataFrame:
    """(rel_path, <what each group of features adds to the score>, score[, <rules>]) of the rows of ``_written``.

    No features go back to Python: batches of thousands of them, held on both
    sides, took an executor over its memory. A sum that isn't asked for isn't worked out.
    """
    rows = rows.filter("NOT package")
    if fitted is None:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in (*GROUPS, "score")})
    else:
        weights, at = fitted[0][:-1], np.arange(PLACES)
        for group, n in GROUPS.items():
            rows = _raw(rows, np.where((at >= STARTS[group]) & (at < STARTS[group] + n), weights, 0.0), 0.0, group)
        rows = _raw(rows, weights, fitted[0][-1], "score")
    return rows.select("rel_path", *GROUPS, "score", *(RULES if rules else ()))


def scored(files: DataFrame, bitmap, fitted: tuple[np.ndarray, float] | None, rules: bool = False) -> DataFrame:
    """(rel_path, <what each group of features adds to the score>, score[, <rules>]) with a given classifier.

    Without a classifier (all labels are alike) every score is null.
    """
    return _judge(_written(featured(_given(files).withColumn("package", F.lit(False)), bitmap)), fitted, rules)


def judged(files: DataFrame, packages: DataFrame, rules: bool = False) -> DataFrame:
    """(rel_path, text, comment, path, known, score, margin, found[, <rules>]) per stored row with content.

    found: the classifier's score is above the margin; the four groups and the
    intercept sum to the score. Null paths and blank contents have no row; all
    rows of a path agree. The features of every row and every package file are
    written once, fitted on and judged from there. If all labels are alike,
    nothing is found (score is null). With ``rules``, what each labelling rule says.
    """
    spark = files.sparkSession
    bitmap = spark.sparkContext.broadcast(known_bitmap(packages))
    more = packages.select(F.lit("").alias("rel_path"), "content", F.lit(True).alias("package")).filter("trim(content) <> ''").distinct()
    rows = _written(featured(_given(files).withColumn("package", F.lit(False)).unionByName(more), bitmap))
    fitted = fit(_labelled(rows))
    margin = float(fitted[1]) if fitted else 0.0
    return _judge(rows, fitted, rules).withColumns({"margin": F.lit(margin), "found": F.coalesce(F.col("score") > margin, F.lit(False))})


def validation(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(held_out, view, files, labelled, found, both) over distinct files.

    ``labelled`` counts the files that a rule labels, ``found`` those that the
    classifier finds, ``both`` both. The view ``all`` is the classifier as it
    judges; the others leave one group of features out; a rule's name as the
    view counts the files that this rule labels.
    """
    rows = judged(files, packages, rules=True).dropDuplicates(["rel_path"]).withColumn("labelled", F.expr(" OR ".join(RULES)))
    over = lambda c: F.coalesce(c > F.col("margin"), F.lit(False))
    views = [F.struct(F.lit("all").alias("view"), "labelled", F.col("found").alias("found"))]
    views += [F.struct(F.lit(f"without {g}").alias("view"), "labelled", over(F.col("score") - F.col(g)).alias("found")) for g in GROUPS]
    views += [F.when(F.col(r), F.struct(F.lit(r).alias("view"), "labelled", F.col("found").alias("found"))) for r in RULES]
    seen = rows.select(F.expr(_held_out()).alias("held_out"), F.inline(F.filter(F.array(*views), lambda v: v.isNotNull())))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return seen.groupBy("held_out", "view").agg(F.count(F.lit(1)).alias("files"), n("labelled").alias("labelled"), n("found").alias("found"), n("labelled AND found").alias("both"))
