"""What paths and contents say about files, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_C = str | Column

#: Extension -> language.
LANGUAGES: dict[str, str] = {
    ext: name
    for name, exts in {
        "r": "r", "ocaml": "ml mli", "haskell": "hs", "zig": "zig", "xml": "xml", "protobuf": "proto", "sql": "sql", "hcl": "tf hcl", "elixir": "ex exs",
        "lua": "lua", "scala": "scala sc", "swift": "swift", "toml": "toml", "yaml": "yml yaml", "json": "json", "markdown": "md markdown", "css": "css",
        "html": "html htm", "bash": "sh bash", "php": "php", "ruby": "rb", "csharp": "cs", "cpp": "cpp cc cxx hpp hh", "c": "c h", "java": "java",
        "go": "go", "rust": "rs", "tsx": "tsx", "typescript": "ts mts cts", "javascript": "js jsx mjs cjs", "python": "py pyi",
    }.items()
    for ext in exts.split()
}

CATEGORY_BOOSTS = {"vendor": 0.4, "generated": 0.5, "documentation": 0.65, "config": 0.7, "test": 0.6, "source": 1.0}
KIND_WEIGHTS = {"data_key": 0.6, "heading": 0.7, "css_selector": 0.8, "html_tag": 0.8, "import": 0.9, "variable": 1.0, "decorator": 1.1, "type_alias": 1.3, "property": 1.3, "constant": 1.3, "module": 1.4, "constructor": 1.5, "interface": 1.6, "enum": 1.6, "trait": 1.6, "struct": 1.8, "class": 1.8, "method": 2.0, "function": 2.0}
ROLE_BOOSTS = {"import": 0.9, "implementation": 1.1, "definition": 1.2, "orchestration": 1.5}


def _col(c: _C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def normal_path(path: _C) -> Column:
    return F.lower(F.regexp_replace(_col(path), r"\\", "/"))


def file_name(path: _C) -> Column:
    return F.substring_index(normal_path(path), "/", -1)


def table(values: dict, key: Column, otherwise) -> Column:
    """A small mapping as a literal."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key), F.lit(otherwise))


def detect_language(path: _C) -> Column:
    """By the last extension; null where it isn't known."""
    name = file_name(path)
    ext = F.when(name.contains("."), F.substring_index(name, ".", -1))
    return F.element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), ext)


def file_category(path: _C) -> Column:
    """vendor, generated, test, config, documentation or source; the first that fits."""
    p, name = normal_path(path), file_name(path)
    bare = F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)
    vendor = _any([p.contains(x) for x in (".cargo/registry/", "deps/", "external/", "third-party/", "third_party/", "node_modules/", "vendor/")])
    generated = _any([p.contains(x) for x in ("/immutable/workers/", "/immutable/nodes/", "/immutable/chunks/", "/app/immutable/", "/gen/", "generated/")] + [name.contains(x) for x in (".freezed.dart", ".g.dart", "_generated.", ".pb.rs", ".pb.go", ".auto.", ".generated.")])
    test = _any([p.contains(x) for x in ("testing/", "__test__/", "__tests__/", "specs/", "spec/", "tests/", "test/")] + [bare.startswith(x) for x in ("spec_", "test_")] + [bare.endswith(x) for x in ("_spec", ".spec", ".test", "_test")])
    known = "composer.json gemfile.lock gemfile cargo.lock package-lock.json yarn.lock poetry.lock requirements.txt rollup.config.js vite.config.ts webpack.config.js jest.config.js dockerfile cmakelists.txt makefile build.gradle pom.xml go.sum go.mod setup.cfg setup.py pyproject.toml tsconfig.json package.json cargo.toml"
    config = name.isin(*known.split()) | name.startswith(".")
    docs = _any([p.contains(x) for x in ("documentation/", "doc/", "docs/")]) | name.isin(*"authors.md authors license.txt license.md license contributing.md changelog.md readme.md".split())
    return F.when(vendor, "vendor").when(generated, "generated").when(test, "test").when(config, "config").when(docs, "documentation").otherwise("source")


def category_boost(category: _C) -> Column:
    return table(CATEGORY_BOOSTS, _col(category), 1.0)


def count_of(text: Column, parts: list[str]) -> Column:
    """How often the parts occur, each counted by itself without overlap."""
    return reduce(lambda a, b: a + b, [((F.length(text) - F.length(F.replace(text, F.lit(p)))) / len(p)).cast("long") for p in parts])


#: Words of control flow, and what may follow them.
MARKS = {"while": " (", "for": " (", "switch": " (", "match": " ", "catch": " (", "except": " :", "elif": " ", "if": " (", "else": ("{", " {", " if")}


def complexity(text: _C) -> Column:
    """Marks of control flow."""
    marks = ["??", "||", "&&", "? ", *[w + e for w, ends in MARKS.items() for e in ends]]
    return count_of(F.lower(_col(text)), marks)


def references(text: _C) -> Column:
    """Distinct words of three characters or more that begin with a letter, on lines that aren't comments."""
    lines = F.filter(F.split(_col(text), "\n"), lambda x: ~F.trim(x).rlike("^(//|#)"))
    found = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"(?<![\p{L}\p{N}_])(\p{L}[\p{L}\p{N}_]{2,})"), F.lit(1))
    return F.size(F.array_distinct(F.transform(found, F.lower)))


def content_role(text: _C) -> Column:
    """orchestration where there is much control flow among many names, else implementation."""
    return F.when((complexity(text) >= 5) & (references(text) >= 5), "orchestration").otherwise("implementation")


def file_role(kinds: _C, text: _C) -> Column:
    """By the share of imports, then of definitions among the symbol kinds, then by content."""
    k = _col(kinds)
    share = lambda names: F.size(F.filter(k, lambda x: x.isin(*names))) / F.size(k)
    return F.when(F.coalesce(F.size(k), F.lit(0)) <= 0, "implementation").when(share(["import"]) > 0.6, "import").when(share("type_alias trait interface enum struct class".split()) > 0.3, "definition").otherwise(content_role(text))


def role_boost(role: _C) -> Column:
    return table(ROLE_BOOSTS, _col(role), 1.0)


def symbol_boost(kinds: _C) -> Column:
    """Mean weight of the symbol kinds; 1 without any."""
    k = _col(kinds)
    total = F.aggregate(k, F.lit(0.0), lambda a, x: a + table(KIND_WEIGHTS, x, 1.0))
    return F.when(F.coalesce(F.size(k), F.lit(0)) <= 0, 1.0).otherwise(total / F.size(k))


def coverage_boost(text: _C, terms: list[str]) -> Column:
    """1 + 2 * (share of the terms that the text holds) ** 1.5."""
    if not terms:
        return F.lit(1.0)
    low = F.lower(_col(text))
    found = reduce(lambda a, b: a + b, [F.when(low.contains(t), 1).otherwise(0) for t in terms])
    return F.lit(1.0) + F.pow(found / F.lit(len(terms)), F.lit(1.5)) * F.lit(2.0)


def combined_boost(path: _C, kinds: _C, text: _C, terms: list[str]) -> Column:
    return symbol_boost(kinds) * category_boost(file_category(path)) * coverage_boost(text, terms)
