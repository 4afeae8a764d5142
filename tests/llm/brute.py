"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
import unicodedata
from itertools import combinations


def fold(text: str) -> list[tuple[str, int, int]]:
    """Words of letters, marks and numbers, folded as the operators do: word, start, end."""
    out, begin, word = [], None, ""
    for i, ch in enumerate(text + "\0"):
        if unicodedata.category(ch)[0] in "LNM":
            wide = unicodedata.normalize("NFKC", ch)
            low = (wide if len(wide) == 1 else ch).lower()
            if begin is None:
                begin = i
            word += low if len(low) == 1 else ch
        elif begin is not None:
            out.append((word, begin, i))
            begin, word = None, ""
    return out


def shingle_set(text: str, k: int = 3) -> set[tuple[str, ...]]:
    w = [x[0] for x in fold(text)]
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def jaccard(a: str, b: str) -> float:
    x, y = shingle_set(a), shingle_set(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def near_groups(rows: list[tuple[int | None, str | None]], threshold: float = 0.5) -> list[set[int]]:
    """Groups of row numbers of which a chain of pairs reaches the threshold, or that are equal."""
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if a is None or b is None:
            continue
        if a == b or jaccard(a, b) >= threshold:
            root[find(i)] = find(j)
    groups: dict[int, set[int]] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), set()).add(i)
    return [g for g in groups.values() if len(g) > 1]


def repeated_spans(rows: list[tuple[int, str]], length: int = 50) -> set[tuple[int, int, int, int, int]]:
    """(doc_id, start, end, words, other_id) of maximal runs of words that lie in a window of `length` words that occurs
    twice; other_id: the least other document with such a window, or the document itself."""
    places: dict[tuple, list[tuple[int, int]]] = {}
    worded = [fold(t) for _, t in rows]
    for d, w in enumerate(worded):
        for i in range(len(w) - length + 1):
            places.setdefault(tuple(x[0] for x in w[i : i + length]), []).append((d, i))
    marked = [[False] * len(w) for w in worded]
    others: list[list[int | None]] = [[None] * len(w) for w in worded]
    for found in places.values():
        if len(found) > 1:
            for d, i in found:
                marked[d][i : i + length] = [True] * length
                others[d][i] = min((rows[e][0] for e, _ in found if e != d), default=None)
    out = set()
    for d, flags in enumerate(marked):
        for m in re.finditer("1+", "".join("1" if f else "0" for f in flags)):
            named = [x for x in others[d][m.start() : m.end()] if x is not None]
            out.add((rows[d][0], worded[d][m.start()][1], worded[d][m.end() - 1][2], m.end() - m.start(), min(named, default=rows[d][0])))
    return out


def leaks(text: str, items: list[tuple[int, str]], length: int = 13, share: float = 0.6, floor: int = 6) -> list[tuple[int, int]]:
    """Spans of characters to remove: unions of maximal matches with an item that reach the limits."""
    w = fold(text)
    flags = [False] * len(w)
    words = [x[0] for x in w]
    for _, item in items:
        t = [x[0] for x in fold(item or "")]
        for i in range(len(words)):
            for j in range(len(t)):
                n = 0
                while i + n < len(words) and j + n < len(t) and words[i + n] == t[j + n]:
                    n += 1
                if n and (n >= length or (n >= floor and n >= share * len(t))):
                    flags[i : i + n] = [True] * n
    out = []
    for m in re.finditer("1+", "".join("1" if f else "0" for f in flags)):
        out.append((w[m.start()][1], w[m.end() - 1][2]))
    return out
