"""Evaluation texts inside a corpus: one Aho-Corasick automaton over the words of the test items.

Test items and documents are folded alike (no case, marks, punctuation, line ends, Unicode form; see textkit), and a text is the
sequence of its words' numbers. Every run of n words of an item holds a whole one of the item's blocks of (n + 1) / 2 words, so
the automaton holds these blocks, in proportion to the items' words; it scans each text once, but for texts that a hash of their runs shows to hold no block. A hit is extended in both
directions as far as item and document have the same words, and counts if that makes n. The words' places are mapped to the
original. Only items of more than BLOCK_WORDS words together take a further scan, so what is broadcast is bounded.

Defined cases: null, empty and short texts and items below n words match nothing; repeated rows give one result row;
extra columns are ignored; an empty table gives no rows. Equality of words is equality of a 64-bit hash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import textkit as K
from lexforge.llm.blocks import by_chars
from lexforge.session import ship_package

#: Words of test items behind one automaton (some 10 MB of text; about 100 bytes of memory a word).
BLOCK_WORDS = 2_000_000
_automata: dict[str, object] = {}


def _automaton(name: str, items: list[np.ndarray], size: int):
    """The automaton of the items' blocks of ``size`` words, each with (item, place); kept in the worker."""
    import ahocorasick

    if name not in _automata:
        _automata.clear()
        found: dict[tuple, list[tuple[int, int]]] = {}
        for i, w in enumerate(items):
            for p in range(0, len(w) - size + 1, size):
                found.setdefault(tuple(w[p : p + size].tolist()), []).append((i, p))
        a = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for block, where in found.items():
            a.add_word(block, where)
        a.make_automaton()
        _automata[name] = a
    return _automata[name]


def _block_hashes(numbers: np.ndarray, size: int, step: int = 1) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin every ``step`` words."""
    w = numbers.astype(np.uint64)
    m = len(w) - size + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    s = w[:m:step] + np.uint64(1)
    for k in range(1, size):
        s = K.mix(s * np.uint64(0x9FB21C651E98DF25) + w[k : k + m : step])
    return s


def _item_blocks(items: DataFrame, id_col: str, text_col: str, n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(ids, word hashes) of test items, in blocks, streamed to the driver one partition at a time."""
    ids, words, size = [], [], 0
    rows = items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").distinct()
    for r in rows.toLocalIterator():
        w = K.folded_words([r.t])[1]
        if len(w) < n:
            continue
        if size + len(w) > BLOCK_WORDS and ids:
            yield ids, words
            ids, words, size = [], [], 0
        ids.append(r.i)
        words.append(w)
        size += len(w)
    if ids:
        yield ids, words


def _common_runs(a, text: list[int], items: list[list[int]], size: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """(item, place in the item, place in the text, words) of the longest equal runs of n words or more."""
    done: dict[tuple[int, int], int] = {}
    if len(text) < size:
        return
    for end, where in a.iter(tuple(text)):
        for i, p in where:
            s = end + 1 - size
            if done.get((i, s - p), -1) > s:  # within a run that was extended before
                continue
            w, lo, hi = items[i], 0, size
            while p - lo > 0 and s - lo > 0 and w[p - lo - 1] == text[s - lo - 1]:
                lo += 1
            while p + hi < len(w) and s + hi < len(text) and w[p + hi] == text[s + hi]:
                hi += 1
            done[i, s - p] = s + hi
            if lo + hi >= n:
                yield i, p - lo, s - lo, lo + hi


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, n: int = 13) -> DataFrame:
    """(doc_id, eval_id, n_runs, char_start, char_end): items of which a document holds n consecutive words or more.

    ``n_runs`` counts different runs of n words by their places in the item, ``char_start`` and ``char_end`` span the first to the
    last of them in the original text (code points, end exclusive).
    """
    spark = docs.sparkSession
    ship_package(spark)
    schema = "doc_id long, eval_id long, n_runs long, char_start long, char_end long"
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= n))
    out, size = None, (n + 1) // 2
    for ids, hashes in _item_blocks(items, item_id, item_text, n):
        vocabulary = np.unique(np.concatenate(hashes))
        numbers = [np.searchsorted(vocabulary, w).astype(np.int32) for w in hashes]
        blocks = np.unique(np.concatenate([_block_hashes(w, size, size) for w in numbers]))
        held = spark.sparkContext.broadcast((uuid.uuid4().hex, ids, vocabulary, numbers, blocks))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            name, ids, vocabulary, numbers, blocks = held.value
            a, items_ = _automaton(name, numbers, size), [w.tolist() for w in numbers]
            for rb in batches:
                doc_ids, texts = rb.column("doc_id").to_pylist(), rb.column("text").to_pylist()
                rows = []
                for lo, hi in by_chars(texts):
                    of, w = K.folded_words(texts[lo:hi])
                    at = np.minimum(np.searchsorted(vocabulary, w), len(vocabulary) - 1)
                    at = np.where(vocabulary[at] == w, at, len(vocabulary))  # words of no item
                    edge = np.searchsorted(of, np.arange(hi - lo + 1))
                    # a text without the hash of any block has none of them: the automaton needn't see it
                    h = _block_hashes(at, size)
                    place_ = np.minimum(np.searchsorted(blocks, h), len(blocks) - 1)
                    hit = (blocks[place_] == h) & (of[: len(h)] == of[size - 1 :]) if len(h) else np.zeros(0, dtype=bool)
                    for k in np.unique(of[: len(h)][hit]).tolist():
                        spans: dict[int, list] = {}
                        for i, p, s, m in _common_runs(a, at[edge[k] : edge[k + 1]].tolist(), items_, size, n):
                            x = spans.setdefault(i, [s, s + m, set()])
                            x[0], x[1] = min(x[0], s), max(x[1], s + m)
                            x[2].update(range(p, p + m - n + 1))
                        if spans:
                            place = K.word_places(texts[lo + k])
                            rows += [(doc_ids[lo + k], ids[i], len(runs), place[s][0], place[e - 1][1]) for i, (s, e, runs) in spans.items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "eval_id", "n_runs", "char_start", "char_end"])

        part = base.mapInArrow(scan, schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out
