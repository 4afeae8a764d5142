"""Symbols: extraction, roles, lookup, enclosing ranges, directory skeletons."""

from __future__ import annotations

import ast
import json
import re
from functools import reduce
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import paths as P
from textquarry.functions import tokens as T
from textquarry.functions.intent import LEVELS, Intent, intent
from textquarry.functions.rows import flat_map

#: Lines are counted from 1, bytes from 0; the end of a byte range is exclusive.
SYMBOLS = "file_path string, language string, name string, kind string, line_start long, line_end long, byte_start long, byte_end long, source string, signature string, docstring string, params string, return_type string, parent string, visibility string"

#: Language -> (kind, pattern) of declarations that stand on one line; the name is group 1.
LINE_RULES: dict[str, list[tuple[str, str]]] = {
    "javascript": [("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("import", r"^\s*import\b.*?(?:'|\")([^'\"]+)")],
    "rust": [("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+(\w+)"), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(\w+)\s*:"), ("type_alias", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)"), ("module", r"^\s*(?:pub\s+)?mod\s+(\w+)"), ("import", r"^\s*(?:pub\s+)?use\s+([\w:]+)")],
    "go": [("function", r"^func\s+(\w+)"), ("method", r"^func\s+\([^)]*\)\s*(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("constant", r"^const\s+(\w+)")],
    "java": [("class", r"^\s*(?:(?:public|private|protected|static|final|abstract|sealed|partial|internal)\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected|internal)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected|internal)\s+)*enum\s+(\w+)"), ("method", r"^\s+(?:(?:public|private|protected|static|final|abstract|override|virtual|async|internal)\s+)+[\w<>\[\],.? ]+\s+(\w+)\s*\([^;]*$"), ("import", r"^\s*(?:import(?:\s+static)?|using)\s+([\w.]+)\s*;")],
    "c": [("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)"), ("class", r"^\s*class\s+(\w+)"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:class\s+)?(\w+)"), ("function", r"^(?!\s*(?:if|for|while|switch|return|else)\b)[\w*&:<>,~ ]+?[\s*&](\w+)\s*\([^;]*$"), ("import", r"^\s*#include\s*[<\"]([^>\"]+)"), ("constant", r"^\s*#define\s+(\w+)")],
    "ruby": [("class", r"^\s*class\s+([\w:]+)"), ("module", r"^\s*module\s+([\w:]+)"), ("method", r"^\s*def\s+([\w.?!=]+)"), ("import", r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)")],
    "php": [("class", r"^\s*(?:abstract\s+|final\s+)?class\s+(\w+)"), ("interface", r"^\s*interface\s+(\w+)"), ("trait", r"^\s*trait\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)"), ("import", r"^\s*use\s+([\w\\]+)")],
    "bash": [("function", r"^\s*(?:function\s+)?(\w+)\s*\(\)"), ("import", r"^\s*(?:source|\.)\s+(\S+)")],
    "css": [("css_selector", r"^\s*([.#]?[\w-][^{};]*?)\s*\{")],
    "markdown": [("heading", r"^#{1,6}\s+(.*?)\s*#*\s*$")],
    "yaml": [("data_key", r"^([\w.-]+)\s*:")],
    "toml": [("heading", r"^\s*\[+([^\]]+)\]+"), ("data_key", r"^([\w.-]+)\s*=")],
    "swift": [("class", r"^\s*(?:(?:public|private|open|final|internal)\s+)*class\s+(\w+)"), ("struct", r"^\s*(?:(?:public|private|internal)\s+)*struct\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|indirect)\s+)*enum\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private)\s+)*protocol\s+(\w+)"), ("function", r"^\s*(?:(?:public|private|static|override|mutating)\s+)*func\s+(\w+)"), ("import", r"^\s*import\s+(\w+)")],
    "scala": [("class", r"^\s*(?:(?:sealed|abstract|final|case|private)\s+)*class\s+(\w+)"), ("module", r"^\s*(?:case\s+)?object\s+(\w+)"), ("trait", r"^\s*(?:sealed\s+)?trait\s+(\w+)"), ("function", r"^\s*(?:(?:override|private|protected|implicit|final)\s+)*def\s+(\w+)"), ("import", r"^\s*import\s+([\w.]+)")],
    "lua": [("function", r"^\s*(?:local\s+)?function\s+([\w.:]+)"), ("import", r"require\s*\(?\s*['\"]([^'\"]+)")],
    "elixir": [("module", r"^\s*defmodule\s+([\w.]+)"), ("function", r"^\s*defp?\s+(\w+[?!]?)"), ("import", r"^\s*(?:use|alias|require|import)\s+([\w.]+)")],
    "hcl": [("module", r"^\s*(?:resource|module|variable|output|provider|data)\s+\"([^\"]+)\"")],
    "sql": [("struct", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), ("function", r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:function|procedure)\s+([\w.\"]+)")],
    "protobuf": [("struct", r"^\s*message\s+(\w+)"), ("enum", r"^\s*enum\s+(\w+)"), ("interface", r"^\s*service\s+(\w+)"), ("method", r"^\s*rpc\s+(\w+)"), ("import", r"^\s*import\s+\"([^\"]+)\"")],
    "xml": [("html_tag", r"^\s*<([A-Za-z][\w:.-]*)")],
    "zig": [("function", r"^\s*(?:pub\s+)?fn\s+(\w+)"), ("constant", r"^\s*(?:pub\s+)?const\s+(\w+)")],
    "haskell": [("class", r"^class\s+(?:.*=>\s*)?(\w+)"), ("struct", r"^(?:data|newtype)\s+(\w+)"), ("function", r"^(\w+'?)\s*::"), ("import", r"^import\s+(?:qualified\s+)?([\w.]+)")],
    "ocaml": [("function", r"^\s*let\s+(?:rec\s+)?(\w+)"), ("module", r"^\s*module\s+(\w+)"), ("type_alias", r"^\s*type\s+(\w+)"), ("import", r"^\s*open\s+([\w.]+)")],
    "r": [("function", r"^\s*([\w.]+)\s*(?:<-|=)\s*function\b"), ("import", r"^\s*(?:library|require)\(([\w.]+)\)")],
}
LINE_RULES |= {"typescript": LINE_RULES["javascript"], "tsx": LINE_RULES["javascript"], "csharp": LINE_RULES["java"], "cpp": LINE_RULES["c"]}
_compiled = {lang: [(kind, re.compile(p)) for kind, p in rules] for lang, rules in LINE_RULES.items()}
_braces = {"javascript", "typescript", "tsx", "rust", "go", "java", "csharp", "c", "cpp", "php", "swift", "scala", "css", "protobuf", "zig", "hcl"}
CONTAINERS = ("class", "struct", "trait", "interface", "module", "enum")


def visibility_of(line: str) -> str | None:
    head = line.strip()
    for word in ("pub(crate)", "protected", "private", "public", "internal", "export", "pub"):
        if head.startswith(word):
            return word
    return None


def _python(text: str) -> list[dict]:
    lines = text.split("\n")
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x.encode()) + 1)
    out: list[dict] = []

    def span(node: ast.AST) -> dict:
        first = min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])
        end = node.end_lineno or node.lineno
        return {"line_start": node.lineno, "line_end": end, "byte_start": at[node.lineno - 1] + node.col_offset, "byte_end": at[end - 1] + (node.end_col_offset or 0), "source": "\n".join(lines[first - 1 : end])}

    def visit(body: list[ast.stmt], parent: str | None) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "function" if parent is None else "constructor" if node.name == "__init__" else "method"
                seen = "private" if node.name.startswith("_") and not node.name.startswith("__") else None
                out.append(span(node) | {"name": node.name, "kind": kind, "signature": lines[node.lineno - 1].strip(), "docstring": ast.get_docstring(node), "params": ", ".join(a.arg for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs)), "return_type": ast.unparse(node.returns) if node.returns else None, "parent": parent, "visibility": seen})
                visit(node.body, node.name)
            elif isinstance(node, ast.ClassDef):
                out.append(span(node) | {"name": node.name, "kind": "class", "signature": lines[node.lineno - 1].strip(), "docstring": ast.get_docstring(node), "parent": parent})
                visit(node.body, node.name)
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                name = node.names[0].name if isinstance(node, ast.Import) else "." * node.level + (node.module or "")
                out.append(span(node) | {"name": name, "kind": "import", "signature": lines[node.lineno - 1].strip(), "parent": parent})
            elif isinstance(node, (ast.Assign, ast.AnnAssign)) and parent is None:
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    if isinstance(target, ast.Name):
                        out.append(span(node) | {"name": target.id, "kind": "constant" if target.id.isupper() else "variable", "signature": lines[node.lineno - 1].strip()})
            elif isinstance(node, (ast.If, ast.Try, ast.With, ast.For, ast.While)):
                for inner in ("body", "orelse", "finalbody"):
                    visit(getattr(node, inner, []), parent)

    visit(ast.parse(text).body, None)
    return out


class _Html(HTMLParser):
    """Headings, titles, and elements with an id."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.text, self.open, self.found = text, [], []
        self.at = [0]
        for x in text.split("\n"):
            self.at.append(self.at[-1] + len(x) + 1)
        self.feed(text)
        self.close()

    def place(self) -> tuple[int, int]:
        line, col = self.getpos()
        return line, self.at[line - 1] + col

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name = dict(attrs).get("id")
        if tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6"):
            self.open.append((tag, *self.place(), []))
        elif name:
            line, at = self.place()
            self.found.append({"name": name, "kind": "html_tag", "line_start": line, "line_end": line, "a": at, "b": at + len(self.get_starttag_text() or ""), "signature": tag})

    def handle_data(self, data: str) -> None:
        for x in self.open:
            x[3].append(data)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                _, line, at, parts = self.open.pop(i)
                end, b = self.place()
                self.found.append({"name": " ".join("".join(parts).split()), "kind": "heading", "line_start": line, "line_end": end, "a": at, "b": b + len(tag) + 3, "signature": tag})
                break


def _html(text: str) -> list[dict]:
    out = []
    for s in _Html(text).found:
        a, b = s.pop("a"), s.pop("b")
        out.append(s | {"byte_start": len(text[:a].encode()), "byte_end": len(text[:b].encode()), "source": text[a:b]})
    return sorted(out, key=lambda s: s["byte_start"])


def _json(text: str) -> list[dict]:
    """The keys of the top object, at the first place where each stands."""
    data, out = json.loads(text), []
    at = 0
    for name in data if isinstance(data, dict) else []:
        quoted = json.dumps(name)
        i = text.find(quoted, at)
        i = i if i >= 0 else max(text.find(json.dumps(name, ensure_ascii=False), at), 0)
        line = text.count("\n", 0, i) + 1
        out.append({"name": name, "kind": "data_key", "line_start": line, "line_end": line, "byte_start": len(text[:i].encode()), "byte_end": len(text[: i + len(quoted)].encode()), "source": quoted, "signature": quoted})
    return out


def _by_lines(text: str, language: str) -> list[dict]:
    lines = text.split("\n")
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x.encode()) + 1)
    out: list[dict] = []
    for i, line in enumerate(lines):
        for kind, pattern in _compiled[language]:
            m = pattern.search(line)
            if not m:
                continue
            end = i
            if language in _braces and kind != "import":
                depth = opened = 0
                for j in range(i, len(lines)):
                    depth += lines[j].count("{") - lines[j].count("}")
                    opened = opened or "{" in lines[j]
                    if (opened and depth <= 0) or (not opened and lines[j].rstrip().endswith(";")):
                        end = j
                        break
                else:
                    end = len(lines) - 1 if opened else i
            comment = []
            for j in range(i - 1, -1, -1):
                head = lines[j].strip()
                if not head.startswith(("//", "#", "--", "*", "/*")) or language == "markdown":
                    break
                comment.insert(0, head.lstrip("/#-*! ").rstrip("*/ "))
            out.append({"name": m.group(1).strip(), "kind": kind, "line_start": i + 1, "line_end": end + 1, "byte_start": at[i], "byte_end": at[end + 1] - 1, "source": "\n".join(lines[i : end + 1]), "signature": line.strip(), "docstring": " ".join(comment).strip() or None, "visibility": visibility_of(line)})
            break
    for s in out:  # the nearest container around
        around = [p for p in out if p is not s and p["kind"] in CONTAINERS and p["byte_start"] <= s["byte_start"] and p["byte_end"] >= s["byte_end"]]
        if around:
            s["parent"] = max(around, key=lambda p: p["byte_start"])["name"]
            if s["kind"] == "function":
                s["kind"] = "method"
    return out


def parse(text: str, language: str) -> list[dict]:
    """The symbols of one file. Raises SyntaxError or ValueError where it can't be parsed."""
    if language == "python":
        return _python(text)
    if language == "html":
        return _html(text)
    if language == "json":
        return _json(text)
    return _by_lines(text, language) if language in _compiled else []


def _outermost(found: list[dict]) -> list[dict]:
    """Without symbols inside another of the same name and kind."""
    out: list[dict] = []
    last: dict[tuple, int] = {}
    for s in sorted(found, key=lambda s: (s["byte_start"], -s["byte_end"])):
        key = s["name"], s["kind"]
        if s["byte_end"] <= last.get(key, -1):
            continue
        last[key] = s["byte_end"]
        out.append(s)
    return out


def _tolerant(text: str | None, language: str | None) -> tuple[list[dict], str | None]:
    try:
        return _outermost(parse(text or "", language or "")), None
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], f"{type(e).__name__}: {e}"


def extract(files: DataFrame) -> DataFrame:
    """Symbols of files (file_path, language, text), with their roles. Files that can't be parsed give none (see errors)."""
    found = flat_map(files.select("file_path", "language", "text"), lambda path, language, text: ({"file_path": path, "language": language} | s for s in _tolerant(text, language)[0]), SYMBOLS)
    return found.withColumn("role", role())


def errors(files: DataFrame) -> DataFrame:
    """(file_path, error) of files that can't be parsed."""
    return flat_map(files.select("file_path", "language", "text"), lambda path, language, text: [{"file_path": path, "error": e} for e in [_tolerant(text, language)[1]] if e], "file_path string, error string")


def signature(source: Column) -> Column:
    return F.trim(F.substring_index(source, "\n", 1))


def visibility(line: Column) -> Column:
    head, out = F.trim(line), None
    for word in ("pub(crate)", "protected", "private", "public", "internal", "export", "pub"):
        out = (F if out is None else out).when(head.startswith(word), word)
    return out


def drop_nested(symbols: DataFrame) -> DataFrame:
    """Without symbols inside another of the same file, name and kind: a running maximum of ends, no self join."""
    order = Window.partitionBy("file_path", "name", "kind").orderBy("byte_start", F.desc("byte_end"))
    before = F.max("byte_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return symbols.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("byte_end") > F.col("_before"))).drop("_before")


DEFINITIONS = ("import", "data_key", "heading", "css_selector", "html_tag", "constant", "type_alias", "trait", "interface", "enum", "struct")
CALLABLE = ("decorator", "constructor", "method", "function")


def role(degrees: bool = False) -> Column:
    """definition, test, configuration, entrypoint, orchestration, utility or logic; the first rule that holds. With
    degrees, the columns fan_in and fan_out of the call graph speak before the names."""
    name, path = F.lower("name"), F.lower(F.regexp_replace("file_path", r"\\", "/"))
    seen = F.coalesce("visibility", F.lit(""))
    any_of = lambda parts: reduce(lambda a, b: a | b, parts)
    test = name.isin("specs", "spec", "test", "tests") | name.rlike(r"^(spec|test)[_.]|_(specs|tests|spec|test)$") | any_of([path.contains(f"/{d}/") for d in ("__tests__", "specs", "spec", "tests", "test")])
    config = name.rlike(r"^(config|setup|settings|init_config|load_config|configure)_?|_(config|settings|options|setup)$") & ~F.col("kind").isin("class") | P.file_name("file_path").isin("conftest.py", "setup.cfg", "setup.py", "settings.py", "config.go", "config.js", "config.ts", "config.rs", "config.py")
    entry = name.isin(*"bootstrap entry handler app cli execute start serve run main".split()) & F.col("parent").isNull() & (F.col("visibility").isNull() | seen.contains("pub") | seen.contains("export"))
    leads = name.rlike(r"^(orchestrate|process|handle|dispatch|coordinate|manage|execute|pipeline|workflow|run_all)(_|$)")
    helps = seen.contains("private") | seen.contains("protected") | name.rlike(r"^_(?!_)") | name.rlike("_(aux|impl|internal|util|helper)$")
    out = F.when(F.col("kind").isin(*DEFINITIONS), "definition").when(test, "test").when(config, "configuration").when(~F.col("kind").isin(*CALLABLE), "definition")
    if degrees:
        fan_in, fan_out = F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0))
        out = out.when((fan_out >= 5) & (fan_in <= 2), "orchestration").when((fan_in >= 4) & (fan_out <= 1), "utility").when((fan_in == 0) & (fan_out > 0), "entrypoint")
    return out.when(entry, "entrypoint").when(leads, "orchestration").when(helps, "utility").otherwise("logic")


def file_symbols(symbols: DataFrame, path: str, limit: int = 200) -> DataFrame:
    return symbols.where(F.col("file_path") == path).orderBy("line_start", "line_end", "name").limit(limit)


def symbol(symbols: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Symbols called [Parent.]name, whatever the case."""
    parent, _, bare = name.rpartition(".")
    cond = F.lower("name") == bare.lower()
    if parent:
        cond = cond & (F.lower("parent") == parent.lower())
    if path:
        cond = cond & (F.col("file_path") == path)
    return symbols.where(cond)


def qualified(query: str) -> tuple[str, str] | None:
    """(parent, name) of `a::b` or else `a.b`, lower case."""
    for mark in ("::", "."):
        parent, found, name = query.strip().rpartition(mark)
        if found and parent.strip() and name.strip():
            return parent.strip(), name.strip()
    return None


def lookup(symbols: DataFrame, query: str, *, intent_level: int = 2, intent_mode: bool = False, limit: int = 50) -> DataFrame:
    """Symbols by shared tokens with the query, exact and qualified names, coverage and kind, best first; ties by place."""
    low = query.lower()
    wanted = intent(query, intent_level) if intent_mode else Intent([], [], 2)
    words = list(dict.fromkeys(t for w in (*wanted.exact, *wanted.expanded) for t in T.symbol_tokens_py(w))) if intent_mode else T.symbol_tokens_py(query)
    held = T.symbol_tokens("name")
    asked = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    hits = F.size(F.array_intersect(held, asked))
    exact = F.lower("name") == low
    n = len(words)
    score = hits.cast("double") if words else F.when(F.lower("name").contains(low), 1.0).otherwise(0.0)
    score = score + F.when(exact, max(n, 1) + 2.0).otherwise(0.0)
    pair = qualified(query)
    if pair:
        mine = F.lower(F.coalesce("parent", F.lit(""))) == pair[0].lower()
        score = score + F.when(mine & (F.lower("name") == pair[1].lower()), max(n, 1) + 4.5).when(mine, 1.25).otherwise(0.0)
    if intent_mode and (wanted.exact or wanted.expanded):
        count = lambda ws: F.size(F.filter(held, lambda t: t.isin(*ws))) if ws else F.lit(0)
        e, x = count(wanted.exact), count([w for w in wanted.expanded if w not in wanted.exact])
        boost = (F.lit(1.0) + e * 0.24) * (F.lit(1.0) + x * LEVELS[wanted.level][2])
        share = F.lit(1.0) + e / max(1, len(wanted.exact)) * 0.22 + x / max(1, len(wanted.expanded)) * 0.06
        score = score * boost * share * F.when((e == 0) & (x > 0), 0.82).otherwise(1.0)
    if words:
        cover = F.when(exact, 1.0).otherwise(hits / n)
        if n > 1:
            score = score * F.when(exact, 1.0).when(cover >= 0.999, 1.16).when(cover >= 0.66, 1.0).otherwise(0.58)
        full = cover >= 0.999 if n > 1 else F.lit(False)
        part = cover < 0.999 if n > 1 else F.lit(False)
        kind = F.lower("kind")
        score = score * (
            F.when(kind.isin(*"module trait interface enum struct class".split()), F.when(exact, 1.22).when(full, 1.14).otherwise(1.06))
            .when(kind.isin(*"type_alias constructor method function".split()), F.when(exact, 1.16).when(full, 1.08).otherwise(1.03))
            .when(kind.isin(*"decorator data_key constant property variable import".split()), F.when(exact, 0.98).when(part, 0.54).otherwise(0.86))
            .otherwise(1.0)
        )
    return symbols.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "file_path", "line_start", "name").limit(limit)


def token_table(symbols: DataFrame, key: str = "symbol_id") -> DataFrame:
    return symbols.select(F.explode(T.symbol_tokens("name")).alias("token"), F.col(key))


def enclosing(points: DataFrame, ranges: DataFrame, *, file: str = "file_path", at: str = "at", key: str = "point_id") -> DataFrame:
    """The points with the smallest range of the same file that holds them (ties: the later begin, then the id).

    ranges: (file, symbol_id, byte_start, byte_end), ends inclusive. The file is an equality, so the join hashes; the
    range is its residual condition.
    """
    r = ranges.select(F.col(file).alias("_f"), "symbol_id", "byte_start", "byte_end")
    hit = points.join(r, (F.col(file) == F.col("_f")) & F.col(at).between(F.col("byte_start"), F.col("byte_end")))
    best = hit.groupBy(key).agg(F.min(F.struct((F.col("byte_end") - F.col("byte_start")).alias("span"), (-F.col("byte_start")).alias("s"), "symbol_id")).alias("b"))
    return points.join(best.select(key, F.col("b.symbol_id").alias("symbol_id")), key, "left")


def extract_stats(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Files and symbols by language, and in all (language null)."""
    f = files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))
    s = symbols.groupBy("language").agg(F.count(F.lit(1)).alias("symbols"))
    both = f.join(s, "language", "left").na.fill(0, ["symbols"])
    return both.unionByName(both.agg(F.lit(None).cast("string").alias("language"), F.sum("files").alias("files"), F.sum("symbols").alias("symbols")))


HIDDEN = ("data_key", "heading", "css_selector", "html_tag", "decorator", "variable", "import")


def skeleton(files: DataFrame, symbols: DataFrame | None = None, *, max_depth: int = 20) -> DataFrame:
    """(dir, depth, file_count, symbol_count): a roll-up over all directories above each file; '' is the root."""
    parts = F.filter(F.split(F.regexp_replace("file_path", r"\\", "/"), "/"), lambda p: p != "")
    depth = F.least(F.size(parts) - 1, F.lit(max_depth))
    above = F.transform(F.sequence(F.lit(0), depth), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("dir")))
    rows = files.select("file_path")
    if symbols is None:
        counted = rows.withColumn("n", F.lit(0).cast("long"))
    else:
        per = symbols.where(~F.col("kind").isin(*HIDDEN)).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
        counted = rows.join(per, "file_path", "left").na.fill(0, ["n"])
    return counted.select(F.explode(above).alias("a"), "n").groupBy("a.dir", "a.depth").agg(F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("symbol_count"))


def render(rows: list[tuple[str, list[str]]], collapse: int = 50) -> str:
    """Markdown tree of (path, signatures); a folder with more than `collapse` files is one line."""
    tree: dict = {}
    for path, lines in sorted(rows):
        *folders, name = path.strip("/").split("/")
        node = tree
        for f in folders:
            node = node.setdefault(f + "/", {})
        node[name] = lines
    out: list[str] = []

    def walk(node: dict, indent: str) -> None:
        items = sorted(node.items(), key=lambda x: (not x[0].endswith("/"), x[0]))
        plain = [n for n, v in items if not isinstance(v, dict)]
        for i, (name, value) in enumerate(items):
            last = i == len(items) - 1
            if not isinstance(value, dict) and len(plain) > collapse:
                if name == plain[0]:
                    out.append(f"{indent}└── … {len(plain)} files")
                continue
            out.append(f"{indent}{'└──' if last else '├──'} {name}")
            deeper = indent + ("    " if last else "│   ")
            if isinstance(value, dict):
                walk(value, deeper)
            else:
                out.extend(f"{deeper}{s}" for s in value)

    walk(tree, "")
    return "\n".join(out)
