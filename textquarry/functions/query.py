"""The query language of text search, parsed in the driver into a tree and from there into one boolean column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Term:
    keywords: list[str]
    required: bool = False
    excluded: bool = False
    exact: bool = False


@dataclass
class And:
    left: Expr
    right: Expr


@dataclass
class Or:
    left: Expr
    right: Expr


Expr = Term | And | Or


@dataclass
class Filter:
    file: str | None = None
    ext: str | None = None
    dir: str | None = None
    lang: str | None = None
    type: str | None = None  # parsed, without effect


@dataclass
class Query:
    raw: str
    expr: Expr | None = None
    filter: Filter = field(default_factory=Filter)


_token = re.compile(r'"([^"]*)"?|([()])|([+-])(?=\S)|([^\s()"]+)')


def parse(text: str) -> Query:
    """Filters file: ext: dir: lang: type:, phrases in quotes, + and -, parentheses, AND and OR from left to right with
    equal rank; words side by side mean OR (and so `a -b` is a OR NOT b). The raw text stays for scoring."""
    query = Query(text)
    tokens: list[tuple[str, str]] = []
    for m in _token.finditer(text):
        phrase, paren, sign, word = m.groups()
        if phrase is not None:
            tokens.append(("phrase", phrase))
        elif paren:
            tokens.append((paren, paren))
        elif sign:
            tokens.append(("sign", sign))
        elif word in ("AND", "OR"):
            tokens.append((word, word))
        else:
            name, colon, value = word.partition(":")
            if colon and value and name.lower() in ("file", "ext", "dir", "lang", "type"):
                setattr(query.filter, name.lower(), value)
            else:
                tokens.append(("word", word))
    at = 0

    def primary() -> Expr | None:
        nonlocal at
        sign = ""
        while at < len(tokens) and tokens[at][0] == "sign":
            sign = tokens[at][1]
            at += 1
        if at >= len(tokens):
            return None
        kind, value = tokens[at]
        if kind == "(":
            at += 1
            inner = sequence()
            if at < len(tokens) and tokens[at][0] == ")":
                at += 1
            return inner
        if kind in ("word", "phrase"):
            at += 1
            words = value.lower().split() if kind == "phrase" else [value.lower()]
            return Term(words, sign == "+", sign == "-", kind == "phrase") if words else None
        return None

    def sequence() -> Expr | None:
        nonlocal at
        left = primary()
        while at < len(tokens) and tokens[at][0] != ")":
            joined = Or
            if tokens[at][0] in ("AND", "OR"):
                joined = And if tokens[at][0] == "AND" else Or
                at += 1
            before = at
            right = primary()
            if right is not None:
                left = joined(left, right) if left is not None else right
            elif at == before:
                at += 1  # a stray operator
        return left

    found = None
    while at < len(tokens):
        part = sequence()
        found = part if found is None else (Or(found, part) if part is not None else found)
        if at < len(tokens):  # a closing parenthesis without an opening one
            at += 1
    query.expr = found
    return query


def condition(expr: Expr, lower_text: Column, strict_required: bool = False) -> Column:
    """The tree as a column over lower-case text. A required term has no further effect unless strict_required."""
    if isinstance(expr, Term):
        if expr.exact:
            found = lower_text.contains(" ".join(expr.keywords))
        else:
            found = lower_text.contains(expr.keywords[0])
            for word in expr.keywords[1:]:
                found = found | lower_text.contains(word)
        return ~found if expr.excluded else found
    left, right = condition(expr.left, lower_text, strict_required), condition(expr.right, lower_text, strict_required)
    both = left & right if isinstance(expr, And) else left | right
    if strict_required:
        for side, col in ((expr.left, left), (expr.right, right)):
            if isinstance(side, Term) and side.required:
                both = both & col
    return both


def plain(expr: Expr) -> bool:
    """Whether the tree is only ORs of plain terms: then no text needs reading before the best are chosen."""
    if isinstance(expr, Term):
        return not expr.excluded and not expr.exact
    return isinstance(expr, Or) and plain(expr.left) and plain(expr.right)


def filter_condition(f: Filter, path: Column, language: Column) -> Column:
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    out = F.lit(True)
    if f.file:
        out = out & low.contains(f.file.lower())
    if f.ext:
        out = out & low.endswith(f.ext.lower() if f.ext.startswith(".") else "." + f.ext.lower())
    if f.dir:
        out = out & low.contains(f.dir.lower().replace("\\", "/"))
    if f.lang:
        out = out & (F.lower(language) == f.lang.lower())
    return out
