"""Near duplicates: similarity sketches by hashed bin placement, banding, exact verification, groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import Tables, content_id, fresh, map_arrow, maybe_in, release
from textquarry.llm.components import components
from textquarry.llm.textvec import U64, blocks, mix, windows, words

#: Words of a shingle; coordinates of a sketch and how many make a band; least Jaccard similarity of near duplicates.
SHINGLE, COORDINATES, BAND, THRESHOLD = 3, 160, 4, 0.5
#: About how many texts are compared with one in a task; about how many of a block are compared with each other.
FOLLOWERS, BLOCK = 2000, 500


def shingles(texts: list[str], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words of each text (of all its words if fewer), and whose they are."""
    out, owner, base = [], [], 0
    for a, b in blocks(texts):
        w = words(texts[a:b])
        n = np.diff(w.first)
        runs = windows(w.hash, k)
        whole = np.arange(runs.size) + k <= w.first[w.doc[: runs.size] + 1]
        out.append(runs[whole])
        owner.append(w.doc[: runs.size][whole] + base)
        for d in np.flatnonzero((n > 0) & (n < k)):
            out.append(windows(w.hash[w.first[d] : w.first[d + 1]], int(n[d])))
            owner.append(np.array([d + base]))
        base += b - a
    if not out:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owner)


def sketch(hashed: np.ndarray, owner: np.ndarray, n: int, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketches (n x t) of n sets given as element hashes and owners.

    Round i of the first t puts every element into a bin chosen by hash, with value i + a hashed fraction, and bins keep
    their least value; round t + b puts every element into bin b. So every bin fills, later rounds can't lower an
    earlier value, and a set is done when its bins are full: about max(size, t ln t) placements instead of size * t.
    Each coordinate agrees between two sets with probability equal to their Jaccard similarity, with concentration as
    for independent coordinates. Rows of empty sets hold the largest value.
    """
    full = U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, full, U64)
    sized = np.bincount(owner, minlength=n)
    for i in range(2 * t):
        if not hashed.size:
            break
        h = mix(hashed ^ mix(np.array([0x5851F42D4C957F2D + i], U64)))
        place = owner * t + ((h >> U64(40)) % U64(t)).astype(np.int64) if i < t else owner * t + (i - t)
        np.minimum.at(out, place, (U64(i) << U64(40)) | (h & U64((1 << 40) - 1)))
        open_ = (out.reshape(n, t) == full).any(axis=1) & (sized > 0)
        if not open_.all():
            stay = open_[owner]
            hashed, owner = hashed[stay], owner[stay]
    return out.reshape(n, t)


def bands(sketches: np.ndarray, size: int = BAND) -> np.ndarray:
    """Hash keys of every `size` consecutive coordinates, the place of the band included."""
    n, t = sketches.shape
    keys = np.zeros((n, t // size), U64)
    with np.errstate(over="ignore"):
        for j in range(size):
            keys = mix(keys * U64(31) + sketches[:, j : t // size * size : size])
        keys = mix(keys ^ mix(np.arange(t // size, dtype=U64) + U64(7)))
    return keys


def _bands_of(batch: pa.RecordBatch, parts: int) -> pa.RecordBatch:
    """Rows (cid, text) -> rows (part, bands, cids, leads): packed arrays of the bands of this batch's contents.

    A band that several contents of the batch share goes on once, with the least of them; all of them, with that least
    one as lead, are in the row of part -1, which nobody shuffles. So of a band that a third of all rows have a few rows
    a batch travel, whatever their number.
    """
    cids, at = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
    texts = [batch.column(1)[int(i)].as_py() for i in at]
    hashed, owner = shingles(texts)
    keys = bands(sketch(hashed, owner, len(texts)))
    some = np.flatnonzero(np.bincount(owner, minlength=len(texts)) > 0)
    key, who = keys[some].reshape(-1), np.repeat(cids[some], keys.shape[1])
    order = np.argsort(key, kind="stable")
    key, who = key[order], who[order]
    head = np.append(True, key[1:] != key[:-1])[: key.size]
    lead = who[np.maximum.accumulate(np.where(head, np.arange(key.size), 0))] if key.size else who
    several = ~(head & np.append(head[1:], True)[: key.size])
    rows = [(-1, key[several], who[several], lead[several])] if several.any() else []
    key, who = key[head], who[head]
    part = (key % U64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    key, who, part = key[order], who[order], part[order]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if part.size else np.zeros(0, np.int64)
    rows += [(int(part[a]), key[a:b], who[a:b], who[:0]) for a, b in zip(cuts, np.append(cuts[1:], part.size))]
    packed = [pa.array([r[i].tobytes() for r in rows], pa.binary()) for i in (1, 2, 3)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *packed], ["part", "bands", "cids", "leads"])


MEMBERS = "band long, cid long, lead long"


def _members(key: np.ndarray, who: np.ndarray, lead: np.ndarray, kind: type = pa.Table):
    return kind.from_arrays([pa.array(key.view(np.int64)), pa.array(who), pa.array(lead)], ["band", "cid", "lead"])


def _unpacked(column, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[np.frombuffer(x, kind) for x in column.to_pylist()]])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _members(_unpacked(batch.column(0), U64), _unpacked(batch.column(1), np.int64), _unpacked(batch.column(2), np.int64), pa.RecordBatch)


def _met(table: pa.Table) -> pa.Table:
    """All packed bands of a part -> members of bands that several contents share, each with the least of them."""
    key, who = _unpacked(table.column("bands"), U64), _unpacked(table.column("cids"), np.int64)
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    new = np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]))[: key.size]
    key, who = key[new], who[new]
    head = np.append(True, key[1:] != key[:-1])[: key.size]
    lead = who[np.maximum.accumulate(np.where(head, np.arange(key.size), 0))] if key.size else who
    several = ~(head & np.append(head[1:], True)[: key.size])
    return _members(key[several], who[several], lead[several])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lead, cid, text) sorted by lead, the lead's own row first -> pairs with their exact similarity."""
    lead, mine = None, np.zeros(0, U64)
    for batch in batches:
        leads, cids, texts = (batch.column(i).to_pylist() for i in range(3))
        a, b, score = [], [], []
        hashed, owner = shingles(texts)
        order = np.argsort(owner, kind="stable")
        hashed = hashed[order]
        cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
        for i, (x, c) in enumerate(zip(leads, cids)):
            own = np.unique(hashed[cuts[i] : cuts[i + 1]])
            if c == x:
                lead, mine = x, own
                continue
            if x != lead:
                raise ValueError("a pair without its first text")
            both = np.intersect1d(mine, own, assume_unique=True).size
            a.append(x), b.append(c), score.append(both / max(1, mine.size + own.size - both))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(score, pa.float64())], ["a", "b", "jaccard"])
    release()


def _crossed(threshold: float):
    """Rows (band, low, high, side, cid, root, text), sorted so, of which a band's block pair lies in one task -> similar
    pairs of contents that aren't in one group yet."""

    def compare(unit: list[tuple[int, int, int, np.ndarray]], out: list[tuple[int, int, float]]) -> None:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        sides = len({u[0] for u in unit}) > 1
        for i, (side, a, ra, x) in enumerate(unit):
            for other, b, rb, y in unit[:i]:
                if (sides and side == other) or min(x.size, y.size) < threshold * max(x.size, y.size):
                    continue
                u, v = find(ra), find(rb)
                if u == v:
                    continue
                both = np.intersect1d(x, y, assume_unique=True).size
                score = both / max(1, x.size + y.size - both)
                if score >= threshold:
                    out.append((min(a, b), max(a, b), score))
                    root[max(u, v)] = min(u, v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, name, last = [], None, None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            ids = [batch.column(i).to_pylist() for i in range(6)]
            hashed, owner = shingles(batch.column(6).to_pylist())
            order = np.argsort(owner, kind="stable")
            hashed = hashed[order]
            cuts = np.searchsorted(owner[order], np.arange(batch.num_rows + 1))
            for i, (band, low, high, side, cid, root) in enumerate(zip(*ids)):
                if (band, low, high) != name:
                    compare(unit, out)
                    unit, name, last = [], (band, low, high), None
                if cid != last:  # repeated rows
                    unit.append((side, cid, root, np.unique(hashed[cuts[i] : cuts[i + 1]])))
                    last = cid
            yield _pairs(out)
        out = []
        compare(unit, out)
        release()
        yield _pairs(out)

    def _pairs(out: list[tuple[int, int, float]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "jaccard"])

    return run


def _texts(contents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the contents wanted (a written table of cid): of several rows of one content one comes along, its
    repetitions apart. Nothing else is shuffled: a bitmap of the wanted ones thins the table out before the join."""
    held = contents.where(maybe_in(wanted, F.col("cid")))
    first = held.groupBy("cid").agg(F.min("id").alias("i")).join(wanted, "cid", "left_semi").withColumnRenamed("cid", "c")
    return held.join(first, (F.col("cid") == F.col("c")) & F.col("id").eqNullSafe(F.col("i"))).select("cid", "text")


def _star(contents: DataFrame, star: DataFrame, tables: Tables, threshold: float) -> DataFrame:
    """Pairs (a, b) of the star whose texts' shingle sets reach the threshold.

    The texts compared with one come to the task that has it; more than FOLLOWERS are spread over several that have it.
    """
    size = star.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / F.lit(FOLLOWERS)).cast("long"))
    salted = star.join(size, "a").select(F.col("a").alias("lead"), salt.alias("salt"), "b")
    both = tables.write(salted.select("lead", "salt", F.explode(F.array("lead", "b")).alias("cid")).distinct())
    texts = _texts(contents, tables.write(both.select("cid").distinct())).join(both, "cid").select("lead", "cid", "text", "salt")
    ordered = texts.repartition("lead", "salt").sortWithinPartitions("lead", "salt", F.col("cid") != F.col("lead"), "cid")
    scored = ordered.mapInArrow(_verified, "a long, b long, jaccard double")
    return tables.write(scored.where(F.col("jaccard") >= threshold).distinct())


def _mixed(contents: DataFrame, members: DataFrame, star: DataFrame, roots: DataFrame, tables: Tables, threshold: float) -> DataFrame:
    """Similar pairs of contents that share a band and are in different groups so far.

    A band is mixed if an edge of its star joins two groups. Of bands with the same members one is looked at. Its members
    are cut into blocks of about BLOCK; all pairs of blocks are compared, each in one task.
    """
    node, root = roots.select(F.col("node").alias("cid"), "root"), lambda c: F.coalesce("root", c)
    ends = star.join(node.select(F.col("cid").alias("a"), F.col("root").alias("ra")), "a", "left").join(node.select(F.col("cid").alias("b"), F.col("root").alias("rb")), "b", "left")
    bad = ends.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(F.xxhash64("a", "b").alias("edge"), "a", "b")
    bad = tables.write(bad)
    edges = members.where("cid != lead").where(maybe_in(bad.select("edge"), F.xxhash64("lead", "cid")))
    found = tables.write(edges.join(bad, (F.col("lead") == F.col("a")) & (F.col("cid") == F.col("b")), "left_semi").select("band").distinct())
    inside = tables.write(members.where(maybe_in(found, F.col("band"))).join(found, "band", "left_semi").select("band", "cid").distinct())
    signs = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(1))).alias("y"), F.min("cid").alias("lo"), F.max("cid").alias("hi")]
    once = inside.groupBy("band").agg(*signs).groupBy("n", "x", "y", "lo", "hi").agg(F.min("band").alias("band")).select("band", "n")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cid", F.lit(2)), blocks).cast("int")
    placed = inside.join(once, "band").join(node, "cid", "left").select("band", "cid", root("cid").alias("root"), own.alias("side"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    units = tables.write(placed.select("band", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "cid", "root"))
    texts = _texts(contents, tables.write(units.select("cid").distinct())).join(units, "cid").select("band", "low", "high", "side", "cid", "root", "text")
    ordered = texts.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "side", "cid")
    return tables.write(ordered.mapInArrow(_crossed(threshold), "a long, b long, jaccard double").distinct())


def content_groups(docs: DataFrame, *, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of docs (doc_id, text): the rows without text (doc_id, cid), and the groups (cid, root) of distinct contents.

    1. Sketch every text; contents that share a band share a bucket.
    2. In each bucket compare the least content with all others, exactly; join what is similar.
    3. In each bucket compare all pairs that are still in different groups, exactly; join again.
    So every candidate pair is either compared or known to be in one group: the groups are those that all candidate
    pairs would give, while a bucket of many copies costs one comparison a copy. Texts aren't shuffled but those of
    candidates, at every size of the input.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "near")
    parts = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), content_id("text").alias("cid"), "text")
    packed = tables.write(map_arrow(rows.select("cid", "text"), lambda b: _bands_of(b, parts), "part int, bands binary, cids binary, leads binary"))
    local = packed.where("part < 0").select("bands", "cids", "leads").mapInArrow(_local, MEMBERS)
    met = packed.where("part >= 0").select("part", "bands", "cids").groupBy("part").applyInArrow(_met, MEMBERS)
    members = tables.write(met.unionByName(local))
    star = tables.write(members.where("cid != lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct())
    near = _star(rows, star, tables, threshold)
    roots = components(near.select("a", "b"), tables)
    more = _mixed(rows, members, star, roots, tables, threshold)
    return rows.select("id", "cid"), components(near.select("a", "b").unionByName(more.select("a", "b")), tables)


def groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row that has a near duplicate: doc_id, group_id (least doc_id of its group), group_size, kept.

    Two texts are near duplicates if the sets of their three-word shingles have a Jaccard similarity of at least the
    threshold, or if they are equal; groups are the connected components. Candidates share a band; recall at the
    threshold itself is 1 - (1 - threshold**4)**40 = 0.92 and rises steeply above. Texts of fewer words are one shingle;
    texts without words are duplicates only of equal texts; null texts of nothing. Rows are told apart by doc_id and
    text: kept is true in one group member with the least doc_id (of several with that doc_id, all with the least text
    hash). Null doc_ids come last. Other columns aren't read. An empty table gives no rows. Contents are told apart by
    64-bit hashes in the search; similarity is computed on all shingles of the whole texts.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    ids, roots = content_groups(rows, threshold=threshold)
    member = ids.join(roots, ids["cid"] == roots["node"], "left").select(F.col("id").alias("doc_id"), "cid", F.coalesce("root", "cid").alias("root"))
    size = member.groupBy("root").agg(F.count(F.lit(1)).alias("group_size"), F.min("doc_id").alias("group_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "cid")).alias("best")).where("group_size > 1")
    kept = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("cid") == F.col("best.cid"))
    return member.join(size, "root").select("doc_id", "group_id", "group_size", kept.alias("kept"), "cid")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows and columns of docs without the near duplicates that groups() doesn't keep; of equal rows kept, one."""
    found = groups(docs, key=key, text=text, threshold=threshold)
    tables = Tables(docs.sparkSession, "kept")
    row = lambda i, c: F.xxhash64(F.col(i).cast("string"), F.col(i).isNull(), c)
    told = found.groupBy("doc_id", "cid").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1")
    told = tables.write(told.select(row("doc_id", F.col("cid")).alias("row"), F.col("doc_id").alias("told_id"), F.col("cid").alias("told_cid"), F.col("kept").alias("told_kept")))
    flag, *names = fresh(docs.columns, "told_maybe", "told_id", "told_cid", "told_kept")
    told = told.select("row", *[F.col(c).alias(n) for c, n in zip(told.columns[1:], names)])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = docs.withColumn(flag, F.coalesce(maybe_in(told.select("row"), row(f"`{key}`", content_id(docs[text]))), F.lit(False)))
    joined = marked.where(F.col(flag)).join(told.drop("row"), docs[key].eqNullSafe(F.col(names[0])) & (content_id(docs[text]) == F.col(names[1])), "left")
    single = joined.where(F.col(names[2]).isNull()).select(*columns)
    several = joined.where(F.col(names[2])).select(*columns).dropDuplicates([key, text])
    return marked.where(~F.col(flag)).select(*columns).unionByName(single).unionByName(several)
