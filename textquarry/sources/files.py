"""Folders of source files as tables."""

from __future__ import annotations

import pathlib
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.paths import LANGUAGES, detect_language

MAX_BYTES = 2 << 20
#: Left out besides what ignore files name: folders end in a slash.
IGNORED = tuple("*.svg *.css *.log *.map *.min.js *.lock .vscode/ .idea/ coverage/ .cache/ .next/ __pycache__/ build/ dist/ target/ node_modules/ venv/ .venv/ .svn/ .hg/ .git/".split())

IGNORE_FILES = (".gitignore", ".ignore")


@dataclass(frozen=True)
class Rule:
    """A line of an ignore file: a pattern of paths below the root, whether it is about folders only, whether it takes
    back what earlier rules ignore."""

    pattern: str
    folder: bool
    negated: bool


def _glob(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        part = glob[i]
        closing = glob.find("]", i + 2) if part == "[" else -1
        if glob.startswith("**/", i):
            out, i = out + "(.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "/.+", i + 3
        elif part in "*?":
            out, i = out + ("[^/]*" if part == "*" else "[^/]"), i + 1
        elif closing > 0:
            out, i = out + "[" + glob[i + 1 : closing].replace("\\", "\\\\").replace("!", "^", glob[i + 1] == "!") + "]", closing + 1
        else:
            out, i = out + re.escape(glob[i + 1] if part == "\\" and i + 1 < len(glob) else part), i + 1 + (part == "\\")
    return out


def ignore_rules(lines: Iterable[str], folder: str = "") -> list[Rule]:
    """The rules of an ignore file in a folder below the root, in order."""
    out = []
    for line in lines:
        p = re.sub(r"(?<!\\)\s+$", "", line.rstrip("\n"))
        if not p or p.startswith("#"):
            continue
        negated, p = p.startswith("!"), p.removeprefix("!")
        only, body = p.endswith("/"), p.rstrip("/")
        rooted = "/" in body
        where = "^" + (re.escape(folder) + "/" if folder else "") + ("" if rooted else "(.*/)?")
        out.append(Rule(where + _glob(body.removeprefix("/")) + "$", only, negated))
    return out


def ignored(path: Column, rules: Sequence[Rule]) -> Column:
    """Whether a path, or a folder that it is in, is ignored: of the rules that match one the last decides, and nothing
    inside an ignored folder can be taken back."""
    if not rules:
        return F.lit(False)
    parts = F.split(path, "/")
    entries = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("p"), (n < F.size(parts)).alias("dir")))

    def verdict(e: Column) -> Column:
        out = F.lit(False)
        for sign, run in groupby(rules, lambda r: (r.negated, r.folder)):  # one expression for rules of a kind in a row
            negated, folder = sign
            hit = e["p"].rlike("|".join(f"(?:{r.pattern})" for r in run))
            out = F.when(hit & e["dir"] if folder else hit, not negated).otherwise(out)
        return out

    return F.exists(entries, verdict)


def kept(path: Column, rules: Sequence[Rule] | None = None) -> Column:
    """Whether a path below the root is neither hidden nor ignored."""
    return ~path.rlike(r"(^|/)\.[^/]") & ~ignored(path, ignore_rules(IGNORED) if rules is None else rules)


def read_ignore_files(spark: SparkSession, root: str, names: Sequence[str] = IGNORE_FILES) -> list[Rule]:
    """The rules of all ignore files below the root, those of deeper folders later. Folders are listed in the driver, as
    for any scan; hidden ones and those that IGNORED names aren't entered."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    skipped = {p.rstrip("/") for p in IGNORED if p.endswith("/")}
    rules, todo = [], [""]
    while todo:
        folder = todo.pop(0)
        at = f"{root.rstrip('/')}/{folder}"
        for name in names:
            if fs.exists(path(f"{at}/{name}")):
                stream = fs.open(path(f"{at}/{name}"))
                try:
                    rules += ignore_rules(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines(), folder)
                finally:
                    stream.close()
        inside = sorted(x.getPath().getName() for x in fs.listStatus(path(at)) if x.isDirectory())
        todo += [f"{folder}/{n}".lstrip("/") for n in inside if not n.startswith(".") and n not in skipped]
    return rules


def scan(spark: SparkSession, root: str, *, ignore: list[str] | None = None, content: bool = True) -> DataFrame:
    """(file_path, language, file_size, file_mtime[, content]) of files with a known extension below the root; the path
    is relative. Sizes and times come from the listing; contents are only read if they are asked for. What IGNORED, the
    ignore files below the root and the patterns of `ignore` name is left out, later rules deciding."""
    base = root.rstrip("/")
    names = "*.{" + ",".join(sorted(LANGUAGES)) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(base)
    clean = base.split("://", 1)[-1].removeprefix("file:")
    relative = F.regexp_replace(F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", ""), "^" + re.escape(clean) + "/", "")
    columns = [relative.alias("file_path"), detect_language(relative).alias("language"), F.col("length").alias("file_size"), F.unix_millis("modificationTime").alias("file_mtime")]
    if content:
        columns.append(F.col("content"))
    return raw.select(*columns).where(kept(F.col("file_path"), [*ignore_rules(IGNORED), *read_ignore_files(spark, root), *ignore_rules(ignore or [])]))


def texts(scanned: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Scanned files with text and file_hash: up to `most` bytes, valid UTF-8, no NUL."""
    ok = scanned.where((F.col("file_size") <= most) & F.is_valid_utf8(F.col("content").cast("string")))
    done = ok.withColumn("text", F.decode("content", "UTF-8")).withColumn("file_hash", F.sha2("content", 256)).drop("content")
    return done.where(~F.col("text").contains("\x00"))


def folders(files: DataFrame, depth: int = 5, most: int = 200) -> DataFrame:
    """Distinct folders up to a depth."""
    parts = F.split("file_path", "/")
    levels = F.least(F.size(parts) - 1, F.lit(depth))
    above = F.when(levels > 0, F.transform(F.sequence(F.lit(1), levels), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    return files.select(F.explode(above).alias("folder")).distinct().orderBy("folder").limit(most)


def write_jsonl(symbols: DataFrame, path: str) -> None:
    """Symbols without their sources, one JSON object a line."""
    symbols.drop("source", "docstring").write.mode("overwrite").json(path)


#: A folder that holds one of these is a project's.
MARKERS = tuple(".git .hg .svn .project Cargo.toml Gemfile Makefile CMakeLists.txt build.gradle composer.json go.mod package.json pom.xml pyproject.toml requirements.txt setup.cfg setup.py".split())


def project_root(start: str) -> str | None:
    """The nearest folder upwards with a marker, not beyond the home folder; of local paths only."""
    at = pathlib.Path(start).resolve()
    begin = at = at.parent if at.is_file() else at
    while at != at.parent and (at != pathlib.Path.home() or at == begin):
        if any((at / m).exists() for m in MARKERS):
            return str(at)
        at = at.parent
    return None


def project_name(root: str, name: str | None = None) -> str:
    """A name given, else that of the project's folder, else of the folder itself; letters, digits, - and _ alone."""
    local = "://" not in root and pathlib.Path(root).exists()
    last = [p for p in (local and project_root(root) or root).replace("\\", "/").split("/") if p][-1:] or ["project"]
    clean = re.sub(r"[^a-zA-Z0-9_-]", "_", name or last[0])[:255]
    return clean if re.match("[a-zA-Z_]", clean) else f"_{clean}"
