"""Long repeated passages, found with run-compressed Burrows-Wheeler indexes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.common import Tables, content_id, map_arrow, maybe_in, small
from textquarry.llm.textvec import BASE, U64, blocks, powers, windows, words

#: Least words of a passage; words of an anchor. Every passage of LENGTH words holds an anchor chosen by its content.
LENGTH, ANCHOR = 50, 10
#: An index holds all that shares anchors with one owner document; owners with more anchors than HOT are split by anchor.
HOT = 200_000


def anchors(hashed: np.ndarray, doc: np.ndarray, length: int = LENGTH, k: int = ANCHOR, most: int = 1 << 26) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of anchors: of every `length` consecutive words of a document the k words of least hash.

    A place takes 26 bits, so more than `most` words are gone through in overlapping parts.
    """
    if hashed.size > most:
        found = [(at + s, h) for s in range(0, hashed.size - length + 1, most - length + 1) for at, h in [anchors(hashed[s : s + most], doc[s : s + most], length, k, most)]]
        places, one = np.unique(np.concatenate([at for at, _ in found]), return_index=True)
        return places, np.concatenate([h for _, h in found])[one]
    v, w = windows(hashed, k), length - k + 1
    if v.size < w:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    packed = (v & ~U64((1 << 26) - 1)) | np.arange(v.size, dtype=U64)
    pad = -packed.size % w
    grid = np.append(packed, np.full(pad, ~U64(0))).reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    n = v.size - w + 1
    least = np.minimum(right[:n], left[w - 1 : w - 1 + n])[doc[:n] == doc[length - 1 : length - 1 + n]]
    if not least.size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = (least[np.append(True, least[1:] != least[:-1])] & U64((1 << 26) - 1)).astype(np.int64)
    return at, v[at]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Suffix array of tokens whose last is unique, by prefix doubling of the suffixes not yet told apart."""
    n = tokens.size
    _, rank, sizes = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[rank]
    active, h = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1), 1
    while active.size:
        key = rank[active] * n + rank[active + h]
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        place = np.arange(active.size)
        old = rank[active]
        group = np.maximum.accumulate(np.where(np.append(True, old[1:] != old[:-1]), place, 0))
        fresh = np.append(True, key[1:] != key[:-1])
        sub = np.maximum.accumulate(np.where(fresh, place, 0))
        rank[active] = old + sub - group
        active = active[~(fresh & np.append(fresh[1:], True))]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


@dataclass
class RunIndex:
    """Run-compressed Burrows-Wheeler transform, with suffix-array samples and matches at both ends of its runs.

    head_at, head_to, head_lcp: text places of the suffixes at run heads, in text order; the suffix before each in
    suffix order; and how many tokens both share. end_*: the same of run ends and the suffixes after them. Between
    samples the neighbour moves along with the text and the common length falls by one a token.
    """

    n: int
    symbols: np.ndarray
    lengths: np.ndarray
    head_at: np.ndarray
    head_to: np.ndarray
    head_lcp: np.ndarray
    end_at: np.ndarray
    end_to: np.ndarray
    end_lcp: np.ndarray

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Streams the text: at every place the longest match with another place, and that place."""
        place = np.arange(self.n)

        def along(at: np.ndarray, to: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            s = np.searchsorted(at, place, side="right") - 1
            gone = place - at[np.maximum(s, 0)]
            return np.where(s >= 0, lcp[np.maximum(s, 0)] - gone, 0), to[np.maximum(s, 0)] + gone

        before, b = along(self.head_at, self.head_to, self.head_lcp)
        after, a = along(self.end_at, self.end_to, self.end_lcp)
        return np.maximum(before, after), np.where(before >= after, b, a)

    def alike(self, length: int) -> np.ndarray:
        """Of every place the first in suffix order of those that share `length` tokens with it."""
        place = np.arange(self.n)
        s = np.searchsorted(self.head_at, place, side="right") - 1
        gone = place - self.head_at[np.maximum(s, 0)]
        shared = np.where(s >= 0, self.head_lcp[np.maximum(s, 0)] - gone, 0) >= length
        to = np.where(shared, self.head_to[np.maximum(s, 0)] + gone, place)
        while not np.array_equal(to, to[to]):
            to = to[to]
        return to


def common_prefix(tokens: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens the suffixes at a and b share (a != b), by binary search over prefix hashes."""
    n = tokens.size
    up, down = powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.append(np.zeros(1, U64), np.cumsum((tokens.astype(U64) * U64(BASE) + U64(1)) * up[:n], dtype=U64))
        lo, hi = np.zeros(a.size, np.int64), n - np.maximum(a, b)
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = (total[a + mid] - total[a]) * down[a] == (total[b + mid] - total[b]) * down[b]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    return lo


def build(tokens: np.ndarray) -> RunIndex:
    """The index of tokens whose last is unique."""
    n = tokens.size
    order = suffix_array(tokens)
    transform = tokens[order - 1]
    transform[order == 0] = -1
    change = transform[1:] != transform[:-1]
    head, end = np.flatnonzero(np.append(True, change)), np.flatnonzero(np.append(change, True))

    def sample(p: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, beside = order[p], p + step
        real = (beside >= 0) & (beside < n)
        to = order[np.clip(beside, 0, n - 1)]
        lcp = np.zeros(p.size, np.int64)
        lcp[real] = common_prefix(tokens, at[real], to[real])
        by = np.argsort(at)
        return at[by], to[by], lcp[by]

    return RunIndex(n, transform[head], end - head + 1, *sample(head, -1), *sample(end, 1))


def _find_anchors(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, cids = batch.column(1).to_pylist(), batch.column(0).to_numpy(zero_copy_only=False)
    out = []
    base = 0
    for a, b in blocks(texts):
        w = words(texts[a:b])
        at, h = anchors(w.hash, w.doc)
        out.append((h.view(np.int64), cids[w.doc[at] + base], (at - w.first[w.doc[at]]).astype(np.int32)))
        base += b - a
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["fp", "cid", "pos"])


SEGMENT = ["piece", "cid", "id", "at", "from", "words", "gaps", "sizes"]


def _segments(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (cid, id, text, positions, pieces) -> of each text and piece the words around its anchors."""
    reach = LENGTH - ANCHOR
    rows: list[tuple] = []
    cids, ids, texts, positions, pieces = (batch.column(i).to_pylist() for i in range(5))
    for a, b in blocks(texts):
        w = words(texts[a:b])
        for d in range(b - a):
            lo, hi = int(w.first[d]), int(w.first[d + 1])
            pos, piece = np.array(positions[a + d], np.int64), np.array(pieces[a + d], np.int64)
            order = np.lexsort((pos, piece))
            pos, piece = pos[order], piece[order]
            start, stop = np.maximum(pos - reach, 0), np.minimum(pos + ANCHOR + reach, hi - lo)
            new = np.append(True, (piece[1:] != piece[:-1]) | (start[1:] > stop[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], pos.size) - 1
            for p, s, e in zip(piece[first].tolist(), start[first].tolist(), stop[last].tolist()):
                begin, end = w.start[lo + s : lo + e], w.end[lo + s : lo + e]
                rows.append((p, cids[a + d], ids[a + d], s, int(begin[0]), w.hash[lo + s : lo + e].tobytes(), (begin[1:] - end[:-1]).astype(np.int32).tobytes(), (end - begin).astype(np.int32).tobytes()))
    kinds = [pa.int64(), pa.int64(), batch.schema.field(1).type, pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    columns = list(zip(*rows)) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], SEGMENT)


def _others(group: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of each place the least rank in its group that isn't its own; -1 if there is none."""
    _, g = np.unique(group, return_inverse=True)
    none = np.iinfo(np.int64).max
    least, next_ = np.full(g.max() + 1, none), np.full(g.max() + 1, none)
    np.minimum.at(least, g, rank)
    rest = rank != least[g]
    np.minimum.at(next_, g[rest], rank[rest])
    found = np.where(rest, least[g], next_[g])
    return np.where(found == none, -1, found)


def _mark(table: pa.Table) -> pa.Table:
    """All segments of a piece -> runs of words that lie in a match of LENGTH words or more with another place."""
    seen: dict[tuple[int, int], dict] = {}
    for r in table.to_pylist():  # repeated rows give equal segments
        seen[r["cid"], r["at"]] = r
    keys = sorted(seen)
    parts = [np.frombuffer(seen[k]["words"], U64) for k in keys]
    sizes = np.array([p.size for p in parts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    n = int(sizes.sum() + sizes.size)
    owner = np.repeat(np.arange(len(keys)), sizes + 1)
    tokens = np.empty(n, np.int64)
    inside = np.ones(n, bool)
    inside[begin + sizes] = False
    _, dense = np.unique(np.concatenate(parts), return_inverse=True)
    tokens[inside] = dense + len(keys)
    tokens[~inside] = np.arange(len(keys))
    index = build(tokens)
    match, _ = index.matching_statistics()
    hits = np.flatnonzero(match >= LENGTH)
    out: list[tuple] = []
    if hits.size:
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, hits, 1)
        np.add.at(cover, hits + match[hits], -1)
        marked = np.concatenate([[0], (np.cumsum(cover[:n]) > 0).view(np.int8), [0]])
        edge = np.flatnonzero(np.diff(marked))
        ranked = sorted({(seen[k]["id"] is None, seen[k]["id"], k[0]) for k in keys}, key=lambda x: x if not x[0] else (True, 0, x[2]))
        rank = {cid: i for i, (_, _, cid) in enumerate(ranked)}
        others = _others(index.alike(LENGTH)[hits], np.array([rank[k[0]] for k in keys])[owner[hits]])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            o = int(owner[s])
            r = seen[keys[o]]
            i, j = s - int(begin[o]), e - int(begin[o])
            own = others[np.searchsorted(hits, s) : np.searchsorted(hits, e)]
            own = own[own >= 0]
            wide = np.frombuffer(r["sizes"], np.int32)
            starts = r["from"] + np.concatenate([[0], np.cumsum(wide[:-1] + np.frombuffer(r["gaps"], np.int32))])
            out.append((r["cid"], r["at"] + i, r["at"] + j, int(starts[i]), int(starts[j - 1] + wide[j - 1]), ranked[own.min()][1] if own.size else None))
    kinds = [pa.int64(), *[pa.int32()] * 4, table.schema.field("id").type]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, kinds)], names=["cid", "first", "last", "start", "end", "other"])


def _whole(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (cid, text) -> the span of all words, of texts with enough."""
    out: list[tuple] = []
    for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        w = words([t])
        if w.hash.size >= LENGTH:
            out.append((c, 0, w.hash.size, int(w.start[0]), int(w.end[-1])))
    kinds = [pa.int64(), *[pa.int32()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], ["cid", "first", "last", "start", "end"])


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every passage of LENGTH or more words that occurs elsewhere too: doc_id, start, end (characters), words, other_id
    (the least doc_id of another text that shares LENGTH words of it; its own if it only repeats within its text).

    Words are runs of letters, marks and digits, folded in case and compatibility form. A word is marked if it lies in a
    run of LENGTH words that also stands at another place, in any text, the same one included; a row is a maximal run
    of marked words, and all occurrences are marked. Rows with equal texts are whole passages of each other (other_id:
    the least doc_id, for that itself the greatest); a single document isn't its own copy though its row be repeated.
    Null and empty texts and texts of fewer words have no passages; of very long ones every word counts. A null doc_id
    stays null and isn't named as another's. Other columns aren't read. An empty table gives no rows. Texts are told
    apart by 64-bit hashes.

    How: each run of LENGTH words has an anchor, chosen by content. Words around anchors that occur twice go to the
    index of the anchor's owner, the text of least hash that holds it, so neighbouring anchors of a family of copies
    travel together. Each index is a run-compressed transform with sampled run ends; its matching statistics give marks.
    All places of a run of LENGTH words are in the index of its anchor, so that neither HOT nor the number of indexes
    tells in the result.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "repeats")
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), content_id(text).alias("cid"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    contents = tables.write(rows.groupBy("cid").agg(F.count(F.lit(1)).alias("n"), F.count("id").alias("k"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("n > 1 AND (k < n OR hi > lo)"))
    copied = small(contents.select(F.col("cid").alias("c"), "lo", "hi", "n"), 48)
    first = rows.join(copied, F.col("cid") == F.col("c"), "left").where(F.col("c").isNull() | F.col("id").eqNullSafe(F.col("lo"))).select("cid", "id", "text", (F.col("n") > 1).alias("copied"))

    found = map_arrow(first.select("cid", "text"), _find_anchors, "fp long, cid long, pos int")
    same = Window.partitionBy("fp")
    shared = found.select("*", F.count(F.lit(1)).over(same).alias("n"), F.min("cid").over(same).alias("owner")).where("n > 1").drop("n")
    shared = tables.write(shared)
    hot = tables.write(shared.groupBy("owner").count().where(F.col("count") > HOT).select(F.col("owner").alias("hot_owner")))
    pieces = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    split = shared.join(small(hot, 16), F.col("owner") == F.col("hot_owner"), "left")
    piece = F.pmod(F.when(F.col("hot_owner").isNull(), F.xxhash64("owner")).otherwise(F.xxhash64("fp")), F.lit(pieces))
    around = split.select("cid", "pos", piece.alias("piece")).groupBy("cid").agg(F.collect_list("pos").alias("positions"), F.collect_list("piece").alias("pieces"))
    placed = first.where(maybe_in(tables.write(shared.select("cid").distinct()), F.col("cid"))).select("cid", "id", "text").join(around, "cid").select("cid", "id", "text", "positions", "pieces")
    segments = map_arrow(placed, _segments, f"piece long, cid long, id {kind}, at int, from int, words binary, gaps binary, sizes binary")
    marks = segments.groupBy("piece").applyInArrow(_mark, f"cid long, first int, last int, start int, end int, other {kind}")
    by = Window.partitionBy("cid").orderBy("first", "last")
    before = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = marks.withColumn("new", F.when(before.isNull() | (F.col("first") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(by))
    merged = island.groupBy("cid", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("other").alias("other_id"))
    merged = tables.write(merged.select("cid", "start", "end", (F.col("last") - F.col("first")).alias("words"), "other_id"))

    whole = map_arrow(first.where("copied").select("cid", "text").distinct(), _whole, "cid long, first int, last int, start int, end int")
    whole = tables.write(whole.select("cid", "start", "end", F.col("last").alias("words")))
    ids = rows.select("id", "cid")
    named = merged.join(small(whole.select("cid"), 16), "cid", "left_anti")
    partial = ids.join(named, "cid").select(F.col("id").alias("doc_id"), "start", "end", "words", F.coalesce("other_id", "id").alias("other_id"))
    full = ids.join(whole.join(contents, "cid"), "cid")
    other = F.when(F.col("id").eqNullSafe(F.col("lo")), F.col("hi")).otherwise(F.col("lo"))
    return partial.unionByName(full.select(F.col("id").alias("doc_id"), "start", "end", "words", other.alias("other_id")))
