"""Words, hashes and rolling hashes of whole batches of texts, without a Python step for each word."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

U64 = np.uint64
SEP = "\x00"  # stands between the texts of a batch; within a text it is replaced by a space
_P = U64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CODE = U64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """Which code points are letters or digits."""
    t = np.fromiter(map(str.isalnum, map(chr, range(0x110000))), dtype=bool, count=0x110000)
    t.setflags(write=False)
    return t


@lru_cache(maxsize=1)
def mark_chars() -> np.ndarray:
    """Which code points are combining marks."""
    t = np.zeros(0x110000, dtype=bool)
    for c in range(0x300, 0x20000):
        if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me"):
            t[c] = True
    t[0xE0100:0xE01F0] = True
    return t


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n."""
    up, down = np.full(n, _P, dtype=U64), np.full(n, _P_INV, dtype=U64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n - 1).bit_length())
    return _powers(size)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def join_texts(texts: list[str | None]) -> str:
    return SEP.join("" if t is None else t.replace(SEP, " ") if SEP in t else t for t in texts)


def prefix_hash(c: np.ndarray) -> np.ndarray:
    """H[i] = sum of f(c[j]) * P**j for j < i, modulo 2**64."""
    up, _ = powers(len(c) + 1)
    h = np.zeros(len(c) + 1, dtype=U64)
    np.cumsum((c.astype(U64) + U64(1)) * _CODE * up[: len(c)], out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end) of the codes behind h, the same wherever a span lies."""
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start] + (end - start).astype(U64))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word hash) of every word, in order. Words are maximal runs of letters and digits after NFC and lower-casing."""
    joined = join_texts([t and unicodedata.normalize("NFC", t) for t in texts]).lower()
    c = codes(joined)
    doc = np.cumsum(c == 0, dtype=np.int64)
    is_word = np.concatenate(([False], word_chars()[c], [False]))
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[::2], edge[1::2]
    return doc[start], span_hash(prefix_hash(c), start, end)


def shingles(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of n words: (text index, shingle hash) sorted by both, and the number of words of each text."""
    doc, s, _, n_words = shingle_counts(texts, n)
    return doc, s, n_words


def _folded_codes(texts: list[str | None]) -> np.ndarray:
    """Codes of the texts between separators, without case, marks and compatibility forms; đ is d, a final sigma a sigma."""
    joined = unicodedata.normalize("NFKD", join_texts(texts)).replace("Σ", "σ").lower().replace("đ", "d").replace("ł", "l").replace("ς", "σ")
    c = codes(joined)
    return c[~mark_chars()[c]]


def folded(texts: list[str | None]) -> list[str]:
    """Each text as its words between single blanks, without case, marks and compatibility forms; đ is d. Has a blank at either end."""
    c = _folded_codes(texts)
    word, sep = word_chars()[c], c == 0
    blank = ~word & ~sep
    out = np.where(blank, np.uint32(32), c)
    after = np.concatenate(([False], blank[:-1]))
    out = out[~(blank & after)]
    parts = out.tobytes().decode("utf-32-le", "surrogatepass").split(SEP)
    return [" " + p.strip(" ") + " " for p in parts]


def folded_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text index, word hash) of every word of the folded texts, in order."""
    c = _folded_codes(texts)
    doc = np.cumsum(c == 0, dtype=np.int64)
    is_word = np.concatenate(([False], word_chars()[c], [False]))
    edge = np.flatnonzero(is_word[1:] != is_word[:-1])
    start, end = edge[::2], edge[1::2]
    return doc[start], span_hash(prefix_hash(c), start, end)


def word_places(text: str) -> list[tuple[int, int]]:
    """Where in the original each word of folded_words() for one text begins and ends."""
    out, open_ = [], False
    words_, marks = word_chars(), mark_chars()
    for i, ch in enumerate(text):
        for x in unicodedata.normalize("NFKD", ch).lower():
            if marks[ord(x)]:
                if open_:  # a mark belongs to the letter before it
                    out[-1] = (out[-1][0], i + 1)
            elif x != SEP and words_[ord(x)]:
                out.append((i, i + 1)) if not open_ else out.__setitem__(-1, (out[-1][0], i + 1))
                open_ = True
            else:
                open_ = False
    return out


def shingle_counts(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As shingles(), with how often each run occurs in its text after the hashes."""
    doc, w = words(texts)
    n_words = np.bincount(doc, minlength=len(texts))
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64), n_words
    s = w[:m].copy()
    for k in range(1, n):
        s = mix(s * U64(0x9FB21C651E98DF25) + w[k : k + m])
    inside = doc[:m] == doc[n - 1 :]
    d, s = doc[:m][inside], s[inside]
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (d[1:] != d[:-1])))) if len(s) else np.zeros(0, np.int64)
    return d[first], s[first], np.diff(np.append(first, len(s))), n_words
