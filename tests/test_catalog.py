"""Every registered query runs over the small tables and gives what its SQL gives."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from datetime import timedelta

import duckdb
import pytest

import __spark_entry__ as entry_module
from textquarry.functions import tokens as T
from textquarry.functions.intent import intent
from textquarry.operators.packing import SIGNALS, chunk_text
from textquarry.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def cost(text: str) -> int:
    return sum(-(-len(w) // 6) for w in re.findall(r"\w+|[^\w\s]", text))


def greedy(duck, rows) -> None:
    turns: dict[int, list] = {}
    for conv, turn, role, text in duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall():
        turns.setdefault(conv, []).append((-len(text), turn, role, text))
    want, mark = [], "    # ... (truncated)"
    for conv, held in turns.items():
        used = 0
        for _, turn, role, text in sorted(held):
            left = 300 - used - cost(role)
            if left < 16:
                continue
            cut = cost(text) > left
            if cut:
                lines, room = [], left - cost(mark)
                for line in text.split("\n"):
                    room -= cost(line)
                    if room < 0:
                        break
                    lines.append(line)
                text = "\n".join([*(lines or text.split("\n")[:1]), mark])
            used += cost(role) + cost(text)
            want.append((conv, turn, cost(role) + cost(text), cut))
    assert sorted(map(tuple, rows)) == sorted(want)


def sessions(duck, rows) -> None:
    day, by_user, latest = timedelta(days=1), {}, None
    for user, ts, kind in duck.execute("SELECT user_id, ts, event_type FROM events ORDER BY user_id, ts").fetchall():
        latest = max(latest or ts, ts)
        runs = by_user.setdefault(user, [])
        if runs and ts < runs[-1][1]:
            runs[-1] = (runs[-1][0], ts + day, runs[-1][2] + 1, runs[-1][3] | {kind})
        else:
            runs.append((ts, ts + day, 1, {kind}))
    found = {(u, a, b, n, ",".join(sorted(k))) for u, runs in by_user.items() for a, b, n, k in runs}
    got = {(r.user_id, r.start, r.end, r.events, r.paths) for r in rows}
    assert len(got) == len(rows) and got <= found and got >= {x for x in found if x[2] < latest - timedelta(seconds=10)}


def pages(duck) -> dict[str, str]:
    return dict(duck.execute("SELECT url, html FROM pages").fetchall())


def no_contracts(duck, rows) -> None:
    """The pages name no endpoint: tests of the operator have some."""
    call = re.compile(r"""https?://|\bapi/|/api|\b(post|get|put|delete|patch)\s*\(|\bfetch\s*\(|endpoint|operation_?name|"method":|#\[serde\(rename""", re.I)
    lines = [x for html in pages(duck).values() for x in html.split("\n") if call.search(x)]
    assert rows == [] and not any(re.search(r"""["'`](https?://|/[A-Za-z0-9_]|(?:[\w-]+/)*api/)|https?://|operation_?name|"method":|serde""", x, re.I) for x in lines)


def elements(duck, rows) -> None:
    texts = pages(duck)
    bare = lambda t: re.sub(r"[^\w]+", " ", html.unescape(re.sub("<[^>]*>", "", t)))
    assert {r.file_path for r in rows} == set(texts)
    for r in rows:
        lines = texts[r.file_path].split("\n")[r.line_start - 1 : max(r.line_start, r.line_end)]
        assert re.sub(r"[^\w]+", " ", r.name).strip() in bare("\n".join(lines)) or r.name.split()[-1] in "\n".join(lines), r


def looked_up(duck, rows) -> None:
    assert rows and all({"erreth", "heer"} & set(re.findall(r"\w+", r.name.lower())) for r in rows[:1])
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def chunks(duck, rows) -> None:
    texts = dict(duck.execute("SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt'), text FROM documents").fetchall())
    want = []
    for path, text in texts.items():
        for no, (a, b) in enumerate(chunk_text(text)):
            lines = text[a:b].removesuffix("\n").count("\n")
            want.append((path, no, a, b, 1 + text.count("\n", 0, a), 1 + text.count("\n", 0, a) + lines))
    assert sorted(map(tuple, rows)) == sorted(want)
    assert all("".join(text[a:b] for _, _, a, b, _, _ in sorted(x for x in want if x[0] == path)) == text for path, text in list(texts.items())[:20])


def signals(duck, rows) -> None:
    found, df = {}, Counter()
    split = lambda v: {x for x in re.split("[^a-z0-9]+", re.sub("(?<=[a-z0-9])(?=[A-Z])", " ", v).lower()) if x}
    for path, text in pages(duck).items():
        parts = set()
        for kind, pattern in SIGNALS.items():
            for value, n in Counter(m if isinstance(m, str) else m[0] for m in re.findall(pattern, text, re.A)).items():
                found[path, kind, value] = (text.index(value), n)
                parts |= split(value)
        df.update(parts)
    rated: dict[tuple, list] = {}
    for (path, kind, value), (at, n) in found.items():
        if split(value):
            rated.setdefault((path, kind), []).append((-round(sum(1 / df[x] for x in split(value)), 9), value, at, n))
    want = {(p, k, v, at, n) for (p, k), held in rated.items() for _, v, at, n in sorted(held)[:12]}
    assert {(r.file_path, r.kind, r.value, r.offset, r["count"]) for r in rows} == want and len(want) == len(rows)


def search(query: str, holds, terms: list[str], lang: str | None, limit: int = 10):
    """The right documents among the 4 * limit best by BM25 over contents and half that over paths."""

    def check(duck, rows) -> None:
        docs = duck.execute("SELECT concat(source, '/', lang, '/doc_', doc_id, '.txt'), lang, text FROM documents").fetchall()
        scores: Counter = Counter()
        for weight, fields in ((1.0, {p: t for p, _, t in docs}), (0.5, {p: " ".join([p, *[p.split("/")[-1]] * 4]) for p, _, t in docs})):
            counts = {p: Counter(t for w in re.findall(r"\w+", text) for t in one_word(w)) for p, text in fields.items()}
            mean = max(1, sum(c.total() for c in counts.values())) / len(counts)
            for t in terms:
                n = sum(t in c for c in counts.values())
                for p, c in counts.items():
                    if c[t]:
                        scores[p] += weight * math.log(1 + (len(counts) - n + 0.5) / (n + 0.5)) * c[t] * 2.5 / (c[t] + 1.5 * (0.5 + 0.5 * max(c.total(), 1) / mean))
        held = {p: t for p, x, t in docs if lang is None or x == lang}
        best = sorted((p for p in scores if p in held), key=lambda p: (-round(scores[p], 9), p))[: 4 * limit]
        right = [p for p in best if holds(held[p].lower())]
        assert {r.path for r in rows} <= set(right) and len(rows) == min(limit, len(right)) > 0
        assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True) and all(r.snippet in held[r.path].replace("\r", "") for r in rows)

    return check


def one_word(word: str) -> list[str]:
    if word.lower() in T.PRESERVED:
        return [word.lower()]
    return [p for p in T.split_word_py(word) if len(p.encode()) >= 2 and p not in T.PROSE_STOPS | T.CODE_STOPS]


#: What holds the queries that SQL can't express.
BRUTE = {
    "artifact_signals": signals,
    "html_symbols": elements,
    "pack_greedy": greedy,
    "protocol_search": no_contracts,
    "smart_chunks": chunks,
    "stream_debounce": sessions,
    "symbol_lookup": looked_up,
    "text_search": search('(nting OR thing) AND "of the" lang:en', lambda t: ("nting" in t or "thing" in t) and "of the" in t, T.query_tokens('(nting OR thing) AND "of the" lang:en'), "en"),
    "text_search_fast": search("", lambda t: True, T.query_tokens(" ".join(["thing nting token", *intent("thing nting token", 2).expanded])), None),
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{n}`" for n in names]).collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        BRUTE[name](duck, df.collect())
        return
    rel = duck.execute(sql)
    held = [c[0] for c in rel.description]
    assert sorted(held) == names
    at = [held.index(n) for n in names]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(entry_module.queries()) and set(entry_module.oracle_sql()) <= set(entry_module.queries())
