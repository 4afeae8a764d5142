"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns and are worked on as arrays of code points, many documents in one array. All
tables map one code point to one code point, so a position in the folded text is a position in the source text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Documents are put together into arrays of about so many code points; a longer document is an array of its own.
BLOCK_CHARS = 200_000


@cache
def fold_table() -> np.ndarray:
    """Code point -> folded code point (compatibility form and lower case where that is a single one); 0 outside words."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for block in range(0, 0x30000, 0x1000):
        for c in range(block, block + 0x1000):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LNM":
                wide = unicodedata.normalize("NFKC", ch)
                low = (wide if len(wide) == 1 else ch).lower()
                table[c] = ord(low) if len(low) == 1 else c
    return table


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.empty(n, U64), np.empty(n, U64)
    up[0] = down[0] = 1
    done = 1
    while done < n:
        take = min(done, n - done)
        with np.errstate(over="ignore"):
            up[done : done + take] = up[:take] * U64(pow(BASE, done, 1 << 64))
            down[done : done + take] = down[:take] * U64(pow(inverse, done, 1 << 64))
        done += take
    return up, down


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n or more powers of BASE and of its inverse, modulo 2**64."""
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@dataclass
class Words:
    """The words of a block of documents, in order. doc: index in the block; start, end: code points in that document."""

    n_docs: int
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each document its first word; one entry more than documents


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, each text followed by one 0; where each text begins, and the total."""
    joined = "\0".join(texts) + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])


def words(texts: list[str]) -> Words:
    """Splits at everything but letters, marks and numbers; hashes the folded words to 64 bits."""
    points, at = code_points(texts)
    folded = fold_table()[points]
    inside = folded != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside.size and inside[0]:
        edge = np.concatenate([[0], edge])
    start, end = edge[::2], edge[1::2]
    up, down = powers(points.size + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(folded * up[: points.size], dtype=U64)])
        hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(len(texts), doc, start - at[doc], end - at[doc], hashed, first)


def windows(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words (also across documents: the caller leaves those out)."""
    if hashed.size < k:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = np.zeros(hashed.size - k + 1, U64)
        for i in range(k):
            out = (out + hashed[i : i + out.size]) * U64(BASE)
            out ^= out >> U64(29)
    return mix(out)


def blocks(texts: list[str], most: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` code points together."""
    begin = chars = 0
    for i, text in enumerate(texts):
        if chars and chars + len(text) > most:
            yield begin, i
            begin, chars = i, 0
        chars += len(text)
    if begin < len(texts):
        yield begin, len(texts)
