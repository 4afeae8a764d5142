"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textquarry.llm.common import Tables, fresh, map_arrow, maybe_in
from textquarry.llm.textvec import U64, blocks, mix, windows, words

#: A match is removed if it has LENGTH tokens, or SHARE of its item's tokens and at least FLOOR of them. A document of
#: whose tokens more than DOC_SHARE are removed goes as a whole.
LENGTH, SHARE, FLOOR, DOC_SHARE = 13, 0.6, 6, 0.8
#: Tokens of test items in one automaton (some 500 bytes each in a worker); more items make more automata and passes.
AUTOMATON_TOKENS = 200_000
#: About how many characters of test items one pass over the documents looks for (their automata take 100 MB a million);
#: more items make more passes.
PASS_CHARS = 6_000_000
FILTER_BITS = 20


@dataclass
class Automaton:
    """Generalised suffix automaton over token hashes.

    In every state: the shortest item that holds its strings; and of its proper suffixes the longest that is a match by
    share, with that item: a long match with a long item may end in a shorter one that is most of a short item.
    """

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    item: list[tuple[int, int]] = field(default_factory=lambda: [(1 << 60, -1)])
    shorter: list[tuple[int, int, int]] = field(default_factory=list)
    bigrams: np.ndarray = field(default_factory=lambda: np.zeros(1 << FILTER_BITS, bool))
    least: int = 1 << 30

    def _state(self, length: int, move: dict[int, int], link: int, item: tuple[int, int]) -> int:
        self.next.append(move), self.link.append(link), self.length.append(length), self.item.append(item)
        return len(self.next) - 1

    def add(self, tokens: list[int], item_id: int, limits: tuple[int, float, int]) -> None:
        last, mark = 0, (len(tokens), item_id)
        for token in tokens:
            last = self._extend(last, token, mark)
        if tokens:
            length, share, floor = limits
            self.least = min(self.least, length, max(floor, math.ceil(share * len(tokens))))
            hashed = np.array(tokens, U64)
            self.bigrams[(windows(hashed, 2) >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _extend(self, last: int, token: int, mark: tuple[int, int]) -> int:
        known = self.next[last].get(token)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                self.item[known] = min(self.item[known], mark)
                return known
            copy = self._copy(last, token, known)
            self.item[copy] = min(self.item[copy], mark)
            return copy
        new = self._state(self.length[last] + 1, {}, 0, mark)
        p = last
        while p != -1 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][token]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, token, q)
        return new

    def _copy(self, p: int, token: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q], self.item[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(token) == q:
            self.next[p][token] = copy
            p = self.link[p]
        return copy

    def finish(self, limits: tuple[int, float, int]) -> Automaton:
        """Gives every state the shortest item of all states whose strings end in its own, then the shorter matches."""
        _, share, floor = limits
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(order):
            self.item[self.link[s]] = min(self.item[self.link[s]], self.item[s])
        self.shorter = [(0, 0, 1)] * len(self.next)
        for s in order:
            up = self.link[s]
            n, (size, which) = self.length[up], self.item[up]
            self.shorter[s] = (n, which, size) if n >= floor and n >= share * size else self.shorter[up]
        return self

    def matches(self, tokens: Iterable[int], limits: tuple[int, float, int]) -> list[tuple[int, int, int, float]]:
        """Streams tokens; of every maximal match beyond the limits: first token, end, item, share of that item."""
        length, share, floor = limits
        move, link, depth, item, shorter = self.next, self.link, self.length, self.item, self.shorter
        state = n = 0
        out: list[tuple[int, int, int, float]] = []
        held = None
        for i, token in enumerate(tokens):
            grown = move[state].get(token)
            if grown is None:
                while state != -1 and token not in move[state]:
                    state = link[state]
                if state == -1:
                    state = n = 0
                    continue
                n = depth[state] + 1
                state = move[state][token]
            else:
                state, n = grown, n + 1
            size, which = item[state]
            long = n
            if n < length and (n < floor or n < share * size):
                long, which, size = shorter[state]
            if long:
                if held and held[0] != i + 1 - long:
                    out.append(held)
                held = (i + 1 - long, i + 1, which, long / size)
        if held:
            out.append(held)
        return out


def build(items: list[tuple[int | None, str | None]], limits: tuple[int, float, int], most: int = AUTOMATON_TOKENS) -> list[Automaton]:
    """Automata of the normalised items. Null and empty items have no tokens; of equal items the least id is named."""
    out, filled = [Automaton()], 0
    for item_id, text in sorted(items, key=lambda x: (x[0] is None, x[0])):
        tokens = words([text or ""]).hash.tolist()
        if filled and filled + len(tokens) > most:
            out.append(Automaton())
            filled = 0
        out[-1].add(tokens, -1 if item_id is None else item_id, limits)
        filled += len(tokens)
    return [a.finish(limits) for a in out]


@dataclass
class Span:
    start: int  # in characters
    end: int
    tokens: int
    item: int
    share: float  # of the item, by the match


#: A match: first token, end, item, share of the item, and where it begins and ends in characters.
Hit = tuple[int, int, int, float, int, int]


def hits(automata: list[Automaton], texts: list[str], limits: tuple[int, float, int]) -> list[tuple[list[Hit], int]]:
    """Of each text all maximal matches beyond the limits, and its number of tokens.

    The automaton only walks where consecutive token pairs all occur in items: elsewhere no match can be long enough.
    """
    out: list[tuple[list[Hit], int]] = []
    for a, b in blocks(texts):
        w = words(texts[a:b])
        found: list[list[Hit]] = [[] for _ in range(b - a)]
        pair = (windows(w.hash, 2) >> U64(64 - FILTER_BITS)).astype(np.int64)
        for automaton in automata:
            if automaton.least >= 1 << 30:
                continue
            hit = automaton.bigrams[pair] & (w.doc[1:] == w.doc[:-1]) if pair.size else np.zeros(0, bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
            begin, end = edge[::2], edge[1::2] + 1
            if automaton.least < 2:  # single tokens can count
                begin, end = w.first[:-1], w.first[1:]
            long = end - begin >= automaton.least
            for s, e in zip(begin[long].tolist(), end[long].tolist()):
                d = int(w.doc[s])
                base = int(w.first[d])
                for x, y, item, share in automaton.matches(w.hash[s:e].tolist(), limits):
                    found[d].append((s + x - base, s + y - base, item, share, int(w.start[s + x]), int(w.end[s + y - 1])))
        out += [(h, int(w.first[d + 1] - w.first[d])) for d, h in enumerate(found)]
    return out


def merge(found: list[Hit]) -> list[Span]:
    """The spans to remove, disjoint and in order: overlapping matches are one."""
    spans: list[Span] = []
    last = -1
    for s, e, item, share, begin, end in sorted(found):
        if spans and s < last:
            old = spans[-1]
            if e > last:
                old.end, old.tokens, last = end, old.tokens + e - last, e
            if (share, -item) > (old.share, -old.item):
                old.item, old.share = item, share
        else:
            spans.append(Span(begin, end, e - s, item, share))
            last = e
    return spans


class _Search:
    """Finds the spans of rows: in one pass, or in several over a written copy of the rows, whose matches meet by row."""

    def __init__(self, benchmark: DataFrame, item: str, text: str, limits: tuple[int, float, int], pass_chars: int):
        self.limits, self.kind = limits, benchmark.schema[item].dataType.simpleString()
        self.items = benchmark.select(F.col(item).alias("item"), F.col(text).alias("text"))
        chars = self.items.agg(F.sum(F.length("text"))).first()[0] or 0
        self.passes = max(1, -(-chars // pass_chars))
        whole = self.kind in ("bigint", "int", "smallint", "tinyint")
        #: ids that aren't numbers are counted in order
        self.names = None if whole else [r[0] for r in self.items.select("item").where("item IS NOT NULL").distinct().orderBy("item").collect()]

    def _automata(self, no: int):
        rows = self.items.where(F.pmod(F.xxhash64("text"), F.lit(self.passes)) == no).collect()
        place = {x: i for i, x in enumerate(self.names)} if self.names is not None else None
        built = build([(r[0] if place is None or r[0] is None else place[r[0]], r[1]) for r in rows], self.limits)
        return self.items.sparkSession.sparkContext.broadcast(built)

    @property
    def schema(self) -> str:
        return "bigint" if self.names is None else self.kind

    def rows(self, rows: DataFrame, copy: str) -> tuple[list[DataFrame], Callable[[pa.RecordBatch], list[tuple[list[Hit], int]]]]:
        """Parts of the rows with a last column `copy`, and what gives the matches of a batch of them."""
        limits = self.limits
        if self.passes == 1:
            shared = self._automata(0)
            return [rows], lambda batch: hits(shared.value, [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()], limits)
        tables = Tables(rows.sparkSession, "leaks")
        number, found = fresh([*rows.columns, copy], "row_no", "row_hits")
        kept = tables.write(rows.withColumn(number, F.monotonically_increasing_id()))
        parts = []
        for no in range(self.passes):
            shared = self._automata(no)

            def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
                flat = [(i, n, h) for i, (hs, n) in zip(batch.column(0).to_pylist(), hits(shared.value, [t or "" for t in batch.column(1).to_pylist()], limits)) for h in hs]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                columns = [pa.array([h[k] for _, _, h in flat], t) for k, t in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([pa.array([i for i, _, _ in flat], pa.int64()), pa.array([n for _, n, _ in flat], pa.int32()), *columns], ["r", "n", *"abcdef"])

            parts.append(tables.write(map_arrow(kept.select(F.col(number).alias("r"), F.col(copy).alias("t")), run, "r long, n int, a int, b int, c long, d double, e int, f int", text="t")))
        all_ = reduce(DataFrame.unionByName, parts)
        met = tables.write(all_.groupBy("r").agg(F.max("n").alias("n"), F.collect_list(F.struct(*"abcdef")).alias("h")))
        flag = F.coalesce(maybe_in(met.select("r"), F.col(number)), F.lit(False))
        columns = [F.col(f"`{c}`") for c in rows.columns]
        none = F.lit(None).cast("struct<n:int,h:array<struct<a:int,b:int,c:bigint,d:double,e:int,f:int>>>").alias(found)
        joined = kept.where(flag).join(met.select(F.col("r").alias(found + "_r"), F.struct("n", "h").alias(found)), F.col(number) == F.col(found + "_r"), "left")
        shape = lambda df, hit: df.select(*columns[:-1], hit, columns[-1])

        def read(batch: pa.RecordBatch) -> list[tuple[list[Hit], int]]:
            return [([tuple(h.values()) for h in x["h"]], x["n"]) if x else ([], 1) for x in batch.column(batch.num_columns - 2).to_pylist()]

        return [shape(kept.where(~flag), none), shape(joined, F.col(f"`{found}`"))], read


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = LENGTH, share: float = SHARE, floor: int = FLOOR, pass_chars: int = PASS_CHARS) -> DataFrame:
    """A row for each span to remove: doc_id, start, end (characters), tokens, item_id, item_share, doc_share.

    Tokens are runs of letters, marks and digits, folded in case and compatibility form. Matches of `length` tokens, or
    of `share` of an item (and `floor` tokens), count; overlapping ones are one span, named after the item of which one
    match covers most (ties: the least item_id; an item without id is -1, or null where ids aren't numbers). Null and
    empty texts and items have no spans, nor have items of fewer than `floor` tokens. Repeated rows give repeated spans;
    long texts are gone through whole. Other columns aren't read. An empty table of either kind gives no rows.
    No shuffle: the automata are broadcast. Items of more than about `pass_chars` characters are looked for in several
    passes, so that what is broadcast is bounded; their matches meet by row, with the texts of rows that have one.
    """
    search = _Search(benchmark, item, item_text, (length, share, floor), pass_chars)
    parts, read = search.rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(i, s, sum(x.tokens for x in spans) / max(1, n)) for i, (h, n) in enumerate(read(batch)) for spans in [merge(h)] for s in spans]
        at = pa.array([i for i, _, _ in rows], pa.int64())
        columns = [batch.column(0).take(at), *(pa.array([getattr(s, f) for _, s, _ in rows], pa.int32()) for f in ("start", "end", "tokens")), search_named([s.item for _, s, _ in rows]), pa.array([s.share for _, s, _ in rows], pa.float64()), pa.array([x for _, _, x in rows], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "end", "tokens", "item_id", "item_share", "doc_share"])

    names, item_kind = search.names, pa.int64() if search.names is None else to_arrow_type(benchmark.schema[item].dataType)
    search_named = lambda items: pa.array(items if names is None else [None if i < 0 else names[i] for i in items], item_kind)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, start int, end int, tokens int, item_id {search.schema}, item_share double, doc_share double"
    return reduce(DataFrame.unionByName, [map_arrow(p, run, schema) for p in parts])


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", size: str = "n_chars", length: int = LENGTH, share: float = SHARE, floor: int = FLOOR, doc_share: float = DOC_SHARE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows and columns of docs with the spans of contaminated() cut out of the text.

    A row of whose tokens more than doc_share are cut goes. If there is an integer column `size`, it is set to the new
    number of characters where a text changed. Rows without spans stay as they are, null and empty texts too; repeated
    rows are each treated alike, long texts whole. Columns may have any names. An empty table stays empty, without items
    every table stays as it is.
    """
    (copy,) = fresh(docs.columns, "text_copy")
    names = docs.columns
    at = names.index(text)
    sized = names.index(size) if size in names and docs.schema[size].dataType.simpleString() in ("int", "bigint") else None
    search = _Search(benchmark, item, item_text, (length, share, floor), pass_chars)
    parts, read = search.rows(docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(copy)), copy)
    width = len(names)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        texts = batch.column(batch.num_columns - 1).to_pylist()
        found = [(merge(h), n) for h, n in read(batch)]
        keep, changed = [], {}
        for i, (spans, n) in enumerate(found):
            if spans and sum(s.tokens for s in spans) > doc_share * n:
                continue
            keep.append(i)
            if spans:
                cuts = [0, *(x for s in spans for x in (s.start, s.end)), len(texts[i])]
                changed[i] = "".join(texts[i][p:q] for p, q in zip(cuts[::2], cuts[1::2]))
        columns = list(batch.columns[:width])
        if changed:
            columns[at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], columns[at].type)
            if sized is not None:
                columns[sized] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(columns[sized].to_pylist())], columns[sized].type)
        out = pa.RecordBatch.from_arrays(columns, names)
        return out if len(keep) == len(texts) else out.take(pa.array(keep, pa.int64()))

    return reduce(DataFrame.unionByName, [map_arrow(p, run, docs.schema, text=copy) for p in parts])
