"""Oversized items cut into pieces under a limit by content-defined chunking.

A rolling hash over a window of WINDOW characters marks landmarks wherever its low bits vanish. A piece ends near the first
landmark after its least size, or at its greatest size if there is none: the end is moved to the best natural boundary
within reach (article, clause, line, sentence, word, in that order; of equals the nearest). As landmarks depend on the text
around them only, an edit moves the cuts next to it and the later ones fall into step again.

Consecutive pieces overlap: each piece but the first begins up to ``overlap`` characters before the end of the one before,
at the earliest boundary in that reach. The cores (pieces without their overlap) put together are the text.

Defined cases: null and empty items and items within the limit give one piece, unchanged (null: none); a stretch without
any boundary is cut at the greatest size, never between a base character and its combining marks where there is another
way; sizes count code points; repeated rows give repeated pieces; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np

from lexforge.llm import textkit as K

WINDOW = 24
TEXT_LIMIT, NAME_LIMIT, OVERLAP = 1500, 300, 150

# Natural boundaries, best first: a cut comes before the match's end.
_BOUNDARIES = (
    re.compile(r"\n(?=[#*\s]*(?:điều|chương|mục|phần|phụ lục|article|chapter|section)\s+[0-9ivxlc]+)", re.I),
    re.compile(r"\n(?=\s*(?:\d{1,3}(?:\.\d{1,3})*[.)]|[a-zđ][.)]|[-*+•])\s)", re.I),
    re.compile(r"\r\n|\n|\r| | "),
    re.compile(r"[.!?;:…]['\"”’)\]]*\s+"),
    re.compile(r"\s+"),
    re.compile(r"[^\w\s]+"),
)
_LEVELS = len(_BOUNDARIES)


def boundaries(text: str) -> np.ndarray:
    """For each place 0..len: the rank of the boundary there, _LEVELS (no boundary) to 0 (article). Both ends rank best."""
    rank = np.full(len(text) + 1, _LEVELS, dtype=np.int8)
    for level in range(_LEVELS - 1, -1, -1):
        at = [m.end() for m in _BOUNDARIES[level].finditer(text)]
        if at:
            rank[at] = level
    rank[0] = rank[-1] = 0
    return rank


def landmarks(codes: np.ndarray, every: int) -> np.ndarray:
    """Places whose preceding WINDOW characters hash to a multiple of about ``every``."""
    if len(codes) < WINDOW:
        return np.zeros(0, np.int64)
    end = np.arange(WINDOW, len(codes) + 1)
    h = K.span_hash(K.prefix_hash(codes), end - WINDOW, end)
    return end[(h % np.uint64(every)) == 0]


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core start, end) of the pieces of one text."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)]
    c = K.codes(text)
    rank, marks = boundaries(text), K.mark_chars()[c]
    greatest, least = limit - overlap, max(1, (limit - overlap) // 3)
    place = landmarks(c, max(2, (greatest - least) // 3))
    out, at, start = [], 0, 0
    while n - start > limit:
        lo, hi = at + least, min(start + limit, at + greatest)
        k = np.searchsorted(place, lo)
        goal = int(place[k]) if k < len(place) and place[k] <= hi else hi
        # the best boundary within reach of the landmark; within the whole range if there is none
        reach = max(8, (hi - lo) // 4)
        for a, b in ((max(lo, goal - reach), min(hi, goal + reach)), (lo, hi)):
            r = rank[a : b + 1]
            best = int(r.min())
            if best < _LEVELS:
                near = a + np.flatnonzero(r == best)
                end = int(near[np.abs(near - goal).argmin()])
                break
        else:
            end = hi
            while end > lo and end < n and marks[end]:
                end -= 1
            end = end if end > lo else hi
        out.append((start, at, end))
        at = end
        back = max(end - overlap, out[-1][1] + 1)
        near = np.flatnonzero(rank[back:end] < _LEVELS)
        start = back + int(near[0]) if len(near) else back
        while start < end and marks[start]:
            start += 1
    out.append((start, at, n))
    return out


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, str]]:
    """(start, core start, end, piece) of one text."""
    return [(s, c, e, text[s:e]) for s, c, e in cuts(text, limit, min(overlap, limit // 2))]
