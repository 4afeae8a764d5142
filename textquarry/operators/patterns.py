"""Structural search and rewriting of Python source by patterns with placeholders.

`$X` stands for one expression or name (the same everywhere), `$_` for any, `$$$` and `$$$X` for any number of arguments
or statements. Children after those that a pattern names are let pass.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame

from textquarry.functions.rows import flat_map

MANY, ONE = "MANY_PLACE_", "ONE_PLACE_"


def _prepared(pattern: str) -> ast.AST:
    text = re.sub(r"\$\$\$(\w*)", lambda m: MANY + m.group(1), pattern)
    text = re.sub(r"\$(\w+)", lambda m: ONE + m.group(1), text)
    body = ast.parse(text).body
    if len(body) != 1:
        raise ValueError("a pattern is one expression or statement")
    return body[0].value if isinstance(body[0], ast.Expr) else body[0]


def _place(node: object, prefix: str) -> str | None:
    if isinstance(node, ast.Expr):
        node = node.value
    if isinstance(node, ast.Starred):
        node = node.value
    name = node.id if isinstance(node, ast.Name) else node.arg if isinstance(node, ast.arg) else node if isinstance(node, str) else None
    return name[len(prefix) :] if name is not None and name.startswith(prefix) else None


def _match(p: object, n: object, found: dict[str, object]) -> bool:
    one = _place(p, ONE)
    if one is not None and not (isinstance(p, ast.Expr) and isinstance(n, ast.stmt) and not isinstance(n, ast.Expr)):
        value = n.value if isinstance(n, ast.Expr) and not isinstance(p, ast.Expr) else n
        if one == "_":
            return True
        if one in found:
            return _text(found[one]) == _text(value)
        found[one] = value
        return True
    if isinstance(p, list) and isinstance(n, list):
        return _sequence(p, n, found)
    if type(p) is not type(n):
        return False
    if isinstance(p, ast.AST):
        return all(_match(getattr(p, f, None), getattr(n, f, None), found) for f in p._fields if f not in ("ctx", "type_comment", "kind"))
    return p == n


def _sequence(p: list, n: list, found: dict[str, object]) -> bool:
    if not p:
        return True
    many = _place(p[0], MANY)
    if many is not None:
        for take in range(len(n) + 1) if p[1:] else [len(n)]:
            trial = dict(found)
            if _sequence(p[1:], n[take:], trial):
                if many:
                    if many in trial and [_text(x) for x in trial[many]] != [_text(x) for x in n[:take]]:
                        continue
                    trial[many] = n[:take]
                found.clear()
                found.update(trial)
                return True
        return False
    trial = dict(found)
    if n and _match(p[0], n[0], trial) and _sequence(p[1:], n[1:], trial):
        found.clear()
        found.update(trial)
        return True
    return False


def _text(value: object) -> str:
    if isinstance(value, list):
        return ", ".join(map(_text, value))
    return ast.unparse(value) if isinstance(value, ast.AST) else str(value)


def matches(source: str, pattern: str) -> list[dict]:
    """start and end in characters, line (from 1), text and captures of every match, in order. A text that can't be
    parsed has none."""
    wanted = _prepared(pattern)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    lines = source.splitlines(keepends=True)
    at = [0]
    for x in lines:
        at.append(at[-1] + len(x))
    place = lambda line, col: at[line - 1] + len(lines[line - 1].encode()[:col].decode())
    out = []
    for node in ast.walk(tree):
        if not hasattr(node, "lineno") or isinstance(node, ast.Expr):
            continue
        found: dict[str, object] = {}
        if _match(wanted, node, found):
            a, b = place(node.lineno, node.col_offset), place(node.end_lineno, node.end_col_offset)
            out.append({"start": a, "end": b, "line": node.lineno, "text": source[a:b], "captures": {k: _text(v) for k, v in found.items()}})
    return sorted(out, key=lambda m: (m["start"], -m["end"]))


def rewrite(source: str, pattern: str, template: str) -> tuple[str, int]:
    """The text with matches replaced, the first of overlapping ones, and how many; `$X` and `$$$X` are filled in."""
    done, last, cuts = 0, -1, []
    for m in matches(source, pattern):
        if m["start"] < last:
            continue
        new = re.sub(r"\$\$\$(\w+)|\$(\w+)", lambda g, c=m["captures"]: c.get(g.group(1) or g.group(2), g.group(0)), template)
        cuts.append((m["start"], m["end"], new))
        last = m["end"]
        done += 1
    for a, b, new in reversed(cuts):
        source = source[:a] + new + source[b:]
    return source, done


def search(files: DataFrame, pattern: str) -> DataFrame:
    """(file_path, start, end, line, text, captures) over Python files."""
    _prepared(pattern)
    found = lambda path, text: ({"file_path": path} | m | {"captures": list(m["captures"].items())} for m in matches(text or "", pattern))
    return flat_map(files.where("language = 'python'").select("file_path", "text"), found, "file_path string, start long, end long, line long, text string, captures map<string,string>")


def rewrite_files(files: DataFrame, pattern: str, template: str) -> DataFrame:
    """(file_path, text, replaced) of the files that change."""
    _prepared(pattern)

    def changed(path: str, text: str | None) -> list[dict]:
        new, n = rewrite(text or "", pattern, template)
        return [{"file_path": path, "text": new, "replaced": n}] if n else []

    return flat_map(files.where("language = 'python'").select("file_path", "text"), changed, "file_path string, text string, replaced long")
