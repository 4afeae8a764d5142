"""The score of a retrieved point after its payload has been looked at: bonuses and factors, in a fixed order."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.functions import tokens as T

STRONG = tuple("class enum function interface method struct trait".split())
WEAK = tuple("data_key import property variable".split())
#: Words of questions about what code does.
ACTIONS = frozenset("assign assigned build cache carried carry classify collapse connect create debounce delete detect expand hydrate persist propagate refresh remove store".split())
SCOPES = frozenset("filter filters path payload prefix scope scoped startup".split())
STARTUP = frozenset("import imports qdrant startup".split())
RANKING = frozenset("bonus boost penalty rank ranking relevance rerank score scoring".split())
IMPORTING = frozenset("dependencies dependency import importer importers imports module neighbor neighbors".split())
CALLING = frozenset("call caller callers calls edge edges lookup trace tracing traversal".split())
#: What of tokens counts for questions about imports, and about calls.
IMPORT_TOKENS = IMPORTING | {"graph"}
CALL_TOKENS = (CALLING - {"traversal"}) | {"graph", "index", "types"}
PROVIDING, LOADING = frozenset("dependencies dependency provider providers".split()), frozenset("faster import lazy load loaded start".split())


@dataclass(frozen=True)
class Rule:
    """A project's own term for some of its files: adds value, or multiplies with it, where the path ends with one of
    suffixes, the symbol is one of symbols, and the question has a word of each group of needs and none of unless."""

    value: float
    suffixes: tuple[str, ...] = ()
    symbols: tuple[str, ...] = ()
    needs: tuple[frozenset[str], ...] = ()
    unless: frozenset[str] = frozenset()
    adds: bool = True


@dataclass(frozen=True)
class Point:
    """Columns of a point that the terms look at."""

    kind: Column
    name: Column
    low_name: Column
    path: Column
    role: Column
    symbol_tokens: Column
    path_tokens: Column
    base_tokens: Column
    name_tokens: Column


#: A term of one question: None where it can't matter, else a column of the point.
Term = Callable[[Point, frozenset[str]], Column | None]


TOKENS, METADATA = "_rescore_tokens", "_rescore_metadata"


def _text(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) if name in df.columns else F.lit("")


def _path(df: DataFrame) -> Column:
    return F.regexp_replace(_text(df, "file_path"), r"\\", "/")


def _tokenised(parts: list[tuple[Column, int]]) -> Column:
    """Of texts their first tokens, an array each: one expression for all."""
    rows = F.array(*[F.struct(t.alias("t"), F.lit(n).alias("n")) for t, n in parts])
    return F.transform(rows, lambda r: T.identifier_tokens(r["t"], r["n"]))


def _point(df: DataFrame) -> Point:
    tokens = [F.col(TOKENS)[i] for i in range(4)]
    return Point(F.lower(_text(df, "symbol_kind")), _text(df, "symbol_name"), F.lower(_text(df, "symbol_name")), F.lower(_path(df)), F.lower(_text(df, "role")), *tokens)


def _with_tokens(df: DataFrame) -> DataFrame:
    """df with what the terms look at more than once, computed once."""
    base = F.regexp_replace(F.substring_index(_path(df), "/", -1), r"(?<=.)\.[^.]*$", "")
    parts = [(F.concat_ws(" ", _text(df, "symbol_name"), _text(df, "signature")), 24), (F.lower(_path(df)), 12), (base, 6), (_text(df, "symbol_name"), 8)]
    return df.withColumns({TOKENS: _tokenised(parts), METADATA: metadata_tokens(df)})


def _hits(tokens: Column, words: frozenset[str]) -> Column:
    return F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in sorted(words)])))


def path_signal(p: Point, q: frozenset[str]) -> Column | None:
    """Tests, scripts and settings count less in questions of several words that don't ask for them."""
    if len(q) < 2:
        return None
    tests = p.path.rlike(r"/tests?/|^tests?/|_test\.py$|test_regressions\.py$") if not q & {"test", "tests", "testing", "regression"} else F.lit(False)
    scripts = p.path.rlike(r"(^|/)scripts/") if not q & {"script", "scripts", "benchmark", "benchmarks", "harness"} else F.lit(False)
    return F.when(tests, 0.3).when(scripts, 0.68).when(p.path.rlike(r"\.(ya?ml|json|toml|ini|cfg|lock)$"), 0.82).otherwise(1.0)


def base_name(p: Point, q: frozenset[str]) -> Column | None:
    """Two words or more in the base name."""
    hits = _hits(p.base_tokens, q)
    return F.when(hits >= 2, hits * 0.08).otherwise(0.0)


def providers(p: Point, q: frozenset[str]) -> Column | None:
    if not (q & PROVIDING and q & LOADING):
        return None
    return F.when(p.path.contains("/providers/"), F.lit(0.06) + F.when(p.path.endswith("/factory.py"), 0.03).otherwise(0.0)).otherwise(0.0)


def graph_words(p: Point, q: frozenset[str]) -> Column | None:
    """Files and symbols about imports or calls in questions about them."""
    both = F.array_union(p.path_tokens, p.name_tokens)
    out = (_hits(both, IMPORT_TOKENS) * 0.025 if q & IMPORTING else F.lit(0.0)) + (_hits(both, CALL_TOKENS) * 0.02 if q & CALLING else F.lit(0.0))
    return out if q & (IMPORTING | CALLING) else None


def role(p: Point, q: frozenset[str]) -> Column | None:
    """Only for questions about actions or scopes."""
    if not q & (ACTIONS | SCOPES):
        return None
    return F.when(p.role.isin("orchestration", "logic", "utility"), 0.04).when(p.role == "entrypoint", 0.02).when(p.role.isin("test", "configuration"), -0.04).otherwise(0.0)


def foreign_subsystem(p: Point, q: frozenset[str]) -> Column | None:
    return F.when(p.path.contains("/providers/"), 0.2).otherwise(1.0) if "parser" in q and q & STARTUP else None


def ranking_helper(p: Point, q: frozenset[str]) -> Column | None:
    return None if q & RANKING else F.when(p.low_name.contains("bonus") | p.low_name.contains("penalty"), 0.25).otherwise(1.0)


def startup_import(p: Point, q: frozenset[str]) -> Column | None:
    return F.when(p.kind == "import", 0.45).otherwise(1.0) if "parser" in q and q & STARTUP else None


def constructor(p: Point, q: frozenset[str]) -> Column | None:
    if len(q) < 2 or q & {"init", "initialize", "initialization", "constructor"}:
        return None
    return F.when(p.name == "__init__", 0.55).otherwise(1.0)


def container(p: Point, q: frozenset[str]) -> Column | None:
    """Classes of results and settings, in questions about actions."""
    return F.when(p.kind.isin("class", "struct") & p.low_name.rlike("(results?|items?|config|stats|record)$"), 0.72).otherwise(1.0) if q & ACTIONS else None


BONUSES: tuple[Term, ...] = (base_name, providers, graph_words, role)
FACTORS: tuple[Term, ...] = (foreign_subsystem, ranking_helper, startup_import, constructor, container)


def metadata_tokens(df: DataFrame) -> Column:
    """The first 48 tokens of a point: of its paths, names, kind, role, parent and signature, its keywords and the keywords
    of its description and docstring."""
    named = F.flatten(_tokenised([(_text(df, c), n) for c, n in (("file_path", 12), ("path_context", 12), ("symbol_name", 8), ("symbol_kind", 4), ("role", 4), ("parent", 8), ("signature", 12))]))
    none = F.array().cast("array<string>")
    given = F.coalesce(F.col("keywords"), none) if "keywords" in df.columns else none
    told = T.keywords(F.concat_ws("\n", _text(df, "description"), _text(df, "docstring")), 20)
    return F.slice(F.array_distinct(F.concat(named, F.flatten(F.transform(F.concat(given, told), T.variants)))), 1, 48)


def rescore(df: DataFrame, asked: Sequence[str], *, weight: float = 0.3, rules: Sequence[Rule] = ()) -> DataFrame:
    """The rows with their score after the terms. Rows: (score, symbol_name, symbol_kind, file_path, keywords and, if there are, path_context, role,
    signature, parent, description, docstring); asked: the keywords of the question.

    In this order: blend with shared keywords; a tenth of the coverage by the path's context; kind; path; BONUSES and
    rules that add; FACTORS and rules that multiply; symbol words; all words of the point; names that mean nothing.
    """
    words = frozenset(asked)
    none = F.array().cast("array<string>")
    q = F.array(*[F.lit(w) for w in dict.fromkeys(asked)]) if asked else none
    df, columns = _with_tokens(df) if asked else df.withColumn(TOKENS, F.lit(None).cast("array<array<string>>")), df.columns
    p, s = _point(df), F.col("score")
    if asked and "keywords" in df.columns:
        held = F.coalesce(F.col("keywords"), none)
        s = F.when(F.size(held) > 0, s * (1.0 - weight) + T.keyword_overlap(q, held) * weight).otherwise(s)
    if asked and "path_context" in df.columns:
        s = s + T.keyword_coverage(q, T.keywords("path_context")) * 0.1
    s = s * F.when(p.kind.isin(*STRONG), 1.12).when(p.kind.isin(*WEAK), 0.8 if len(asked) >= 2 else 1.0).otherwise(1.0)
    signal = path_signal(p, words)
    s = s if signal is None else s * signal

    def fits(rule: Rule) -> Column | None:
        if any(not words & group for group in rule.needs) or words & rule.unless:
            return None
        cond = F.lit(True)
        for column, values, how in ((p.path, rule.suffixes, Column.endswith), (p.low_name, rule.symbols, Column.__eq__)):
            if values:
                cond = cond & F.array_contains(F.array(*[how(column, F.lit(v.lower())) for v in values]), True)
        return cond

    for adds, terms in ((True, BONUSES), (False, FACTORS)):
        for term in terms if asked else ():
            found = term(p, words)
            if found is not None:
                s = s + found if adds else s * found
        for rule in rules:
            cond = fits(rule) if rule.adds == adds else None
            if cond is not None:
                s = s + F.when(cond, rule.value).otherwise(0.0) if adds else s * F.when(cond, rule.value).otherwise(1.0)
    if not asked:
        return df.withColumn("score", s).select(*columns)
    covered, several = T.keyword_coverage(q, p.symbol_tokens), len(asked) >= 2
    s = s + covered * 0.18
    if words & ACTIONS:
        s = s + _hits(p.symbol_tokens, words & ACTIONS) * 0.08
    if several:
        s = s * F.when(covered >= 0.5, 1.12).when(p.kind.isin(*WEAK), 0.7).otherwise(1.0)
    told = T.keyword_coverage(q, F.col(METADATA))
    s = s + told * 0.16
    if len(asked) >= 3:
        s = s * F.when(told >= 0.45, 1.08).otherwise(1.0)
    if several:
        plain = p.low_name.isin("main", "entry", "_start", "init") & ~F.exists(q, lambda w: p.low_name.contains(w))
        s = s * F.when(plain, 0.92).otherwise(1.0)
    return df.withColumn("score", s).select(*columns)
