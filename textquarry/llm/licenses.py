"""License notices by conditional compression."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass
from functools import cache, reduce

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.common import map_arrow
from textquarry.llm.license_texts import TEMPLATES

#: A block is looked at if it holds one of these; every template does.
CUES = ("licen", "copyright", "rights reserved", "public domain", "redistribut", "permission is hereby", "permission to use", "permission is granted", "eclipse public", "mozilla public")
#: How much of a template's wording may differ; of zstandard.
DIFFERENT, LEVEL = 0.2, 9
#: Blocks of more words are taken in windows that overlap by the longest wording, so that every notice lies wholly in one.
WINDOW = 1200
#: A tag that names licenses by itself.
_tag = re.compile(r"(?i)\bSPDX-License-Identifier:[ \t]*([A-Z0-9][\w.+-]*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(?[A-Z0-9][\w.+-]*\)?)*)")
TAG = "SPDX-License-Identifier: "
_cue = re.compile("|".join(r"[\W_]+".join(map(re.escape, c.split())) for c in CUES), re.IGNORECASE)
_word = re.compile(r"[^\W_]+")


@dataclass
class Template:
    license: str
    text: str
    words: list[str]
    counts: Counter[str]
    must: frozenset[str]
    compressor: zstandard.ZstdCompressor


def _compressor(raw: str | None = None) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    given = zstandard.ZstdCompressionDict(raw.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) if raw else None
    return zstandard.ZstdCompressor(dict_data=given, compression_params=params)


@cache
def templates() -> tuple[zstandard.ZstdCompressor, list[Template]]:
    made = [Template(name, text, _words(text), Counter(_words(text)), frozenset(must.split()), _compressor(text.lower() + "\n")) for name, text, must in TEMPLATES]
    return _compressor(), made


def _words(text: str) -> list[str]:
    return [w.lower() for w in _word.findall(text)]


@cache
def longest() -> int:
    """Most words that a confirmed notice can have."""
    return max(len(t.words) + int(DIFFERENT * len(t.words)) for t in templates()[1])


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of words about cues, far enough for the longest wording; where they meet they are one, cut in windows."""
    cues = [m.start() for m in _cue.finditer(text)]
    if not cues:
        return []
    marks = [m.span() for m in _word.finditer(text)]
    starts, reach = [s for s, _ in marks], longest()
    spans: list[list[int]] = []
    for at in (min(bisect_right(starts, c), len(marks)) for c in cues):
        lo, hi = max(at - 1 - reach, 0), min(at + reach, len(marks))
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = hi
        elif lo < hi:
            spans.append([lo, hi])
    step = WINDOW - reach
    parts = [(i, min(i + WINDOW, hi)) for lo, hi in spans for i in range(lo, max(hi - reach, lo + 1), step)]
    return [(marks[i][0], marks[j - 1][1]) for i, j in parts]


def rank(block: str) -> list[tuple[float, int]]:
    """All templates by how much smaller the block gets when compressed with them: reduction, number; best first."""
    plain, made = templates()
    raw = block.lower().encode()
    alone = len(plain.compress(raw))
    return sorted(((1 - len(t.compressor.compress(raw)) / alone, -i) for i, t in enumerate(made)), reverse=True)


def differences(block: list[str], t: Template) -> tuple[int, int, list[str]] | None:
    """The words of a block that differ least from a template, wherever in it: begin, end, and the differences
    (-missing, +added); none if more than DIFFERENT of the wording differs or a word that must be there is missing.

    An alignment of the whole template with any part of the block, looked for around one of the words that must be
    there; of equally good ones that with the earliest end, then the latest begin.
    """
    if not t.must <= set(block):
        return None
    size, most = len(t.words), int(DIFFERENT * len(t.words))
    seed = min(sorted(t.must), key=block.count)
    ranges: list[list[int]] = []
    for p in (i for i, w in enumerate(block) if w == seed):
        lo, hi = max(p - size - most, 0), min(p + size + most + 1, len(block))
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = hi
        else:
            ranges.append([lo, hi])
    best = None
    for lo, hi in ranges:
        if sum((t.counts - Counter(block[lo:hi])).values()) > most:  # more of its words are missing than may differ
            continue
        # of each number of template words read: how many words differ up to here, minus the begin, the differences
        column: list[tuple[int, int, tuple[str, ...]] | None] = []
        for j in range(lo, hi + 1):
            old, column = column, [(0, -j, ())]
            for i, w in enumerate(t.words):
                ways = [old[i]] if old and block[j - 1] == w and old[i] else []
                if column[i] and w not in t.must and column[i][0] < most:
                    ways.append((column[i][0] + 1, column[i][1], (*column[i][2], "-" + w)))
                if old and old[i + 1] and old[i + 1][0] < most:
                    ways.append((old[i + 1][0] + 1, old[i + 1][1], (*old[i + 1][2], "+" + block[j - 1])))
                column.append(min(ways) if ways else None)
            if column[size] and (best is None or column[size][0] < best[0]):
                best = (column[size][0], -column[size][1], j, list(column[size][2]))
    return best and best[1:]


def _confirmed(block: str, at: int) -> list[tuple[int, int, str, float, int, str]]:
    """Notices of a block that begins at `at`: the best one, then those of what is left before and after it."""
    marks = list(_word.finditer(block))
    lower = [m.group().lower() for m in marks]
    _, made = templates()
    fits = {i: fit for i, t in enumerate(made) if (fit := differences(lower, t))}
    if not fits:
        return []
    # the wording that explains most words; of equal ones the larger reduction, then the earlier template
    _, less, i = min((2 * len(fits[-i][2]) - len(made[-i].words), -reduction, -i) for reduction, i in rank(block) if -i in fits)
    other = len(fits[i][2])
    begin, end, words = fits[i]
    s, e = marks[begin].start(), marks[end - 1].end()
    found = (at + s, at + e, made[i].license, round(-less, 4), other, " ".join(words))
    return [*_confirmed(block[:s], at), found, *_confirmed(block[e:], at + e)]


def _tags(text: str) -> list[tuple[int, int, str, float, int, str]]:
    """Tags that name a license, each confirmed by being just that."""
    out = []
    for m in _tag.finditer(text) if "spdx" in text.lower() else ():
        raw = m.group().lower().encode()
        out.append((m.start(), m.end(), m.group(1), round(1 - len(_compressor(TAG.lower() + m.group(1).lower() + "\n").compress(raw)) / len(templates()[0].compress(raw)), 4), 0, ""))
    return out


def scan(text: str) -> list[tuple[int, int, str, float, int, str]]:
    """Confirmed notices in order: start, end, license, reduction, number of differing words, those words."""
    found = _tags(text) + [x for s, e in dict.fromkeys(candidate_blocks(text)) for x in _confirmed(text[s:e], s)]
    out: list[tuple[int, int, str, float, int, str]] = []
    # a wording in several windows counts once: of overlapping finds the one that explains most
    for x in sorted(set(found), key=lambda x: (-(x[1] - x[0]), x[4], x[0], -x[3], x[2])):
        at = bisect_right(out, (x[0], 1 << 62))
        if (at == 0 or out[at - 1][1] <= x[0]) and (at == len(out) or out[at][0] >= x[1]):
            out.insert(at, x)
    return out


def notices(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each confirmed notice: doc_id, start, end (characters), license, reduction, differing, differences.

    The wording of each template is aligned with blocks about cues. One is confirmed if no more than DIFFERENT of its
    words differ and none that it must have; the one with most words, less two for each that differs, wins (ties: the
    larger reduction of the block's size when compressed with the template as raw dictionary, then the earlier
    template). What is left before and after it is scanned likewise until nothing is confirmed. Tags of identifiers
    count as they are. Null and empty texts have none; repeated rows give
    repeated finds. Whole texts are searched, whatever the length of lines and paragraphs. Other columns aren't read. An
    empty table gives no rows. No shuffle; texts without a word of any cue don't leave the JVM.
    """
    some = reduce(lambda a, b: a | b, [F.lower("text").contains(max(c.split(), key=len)) for c in (*CUES, "spdx")])
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(some)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) if t for x in scan(t)]
        columns = list(zip(*found)) or [()] * 7
        types = [pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], types))], ["doc_id", "start", "end", "license", "reduction", "differing", "differences"])

    return map_arrow(rows, run, f"doc_id {kind}, start int, end int, license string, reduction double, differing int, differences string")
