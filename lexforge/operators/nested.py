"""Deeply nested JSON as related flat tables, by offset and parent-index kernels over Arrow buffers.

A column of JSON texts is taken as one Arrow buffer of bytes with its row offsets. Structure is found for all rows at once
with vectorised kernels: quotes and escapes by run parity, tokens by flags, the container of every token by a depth sort,
validity by a table of allowed token neighbours. Objects and arrays come out as a table of containers with a parent index;
keys and values are sliced from the buffer by offset, and keys are propagated from parents to children by ``take``. No row is
parsed on its own. Strings that spell a list, an object or a string in turn are unescaped and go through the same kernels as rows
of the next round, with the container that holds them as their parent.

Defined cases: null, blank, cut-off and otherwise invalid texts have no containers; invalid JSON within a string is a plain
string; numbers beyond 64 bits are no ids; of repeated keys in one object the last counts; repeated rows give repeated rows, distinct in the queries; an empty
column gives no containers.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of JSON handled at once.
BATCH_BYTES = 2_000_000

_QUOTE, _BACK, _COMMA, _COLON = (ord(c) for c in '"\\,:')
_OPEN_OBJ, _CLOSE_OBJ, _OPEN_ARR, _CLOSE_ARR = (ord(c) for c in "{}[]")
# token kinds
START, OPEN_O, OPEN_A, CLOSE_O, CLOSE_A, COMMA, COLON, STRING, SCALAR = range(9)
_KIND_OF = np.zeros(256, dtype=np.int8)
for _c, _k in ((_OPEN_OBJ, OPEN_O), (_CLOSE_OBJ, CLOSE_O), (_OPEN_ARR, OPEN_A), (_CLOSE_ARR, CLOSE_A), (_COMMA, COMMA), (_COLON, COLON), (_QUOTE, STRING)):
    _KIND_OF[_c] = _k
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 13, 32]] = True
_ESCAPABLE = np.zeros(256, dtype=bool)
_ESCAPABLE[[ord(c) for c in '"\\/bfnrtu']] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_VALUE_END = (STRING, SCALAR, CLOSE_O, CLOSE_A)
_VALUE_START = (STRING, SCALAR, OPEN_O, OPEN_A)


def _allowed() -> np.ndarray:
    """[in object, previous, next]: which token may follow which; which strings are keys is told by what precedes them."""
    t = np.zeros((2, 9, 9), dtype=bool)
    for v in _VALUE_START:
        t[:, COLON, v] = True
        t[0, [OPEN_A, COMMA], v] = True
    t[0, OPEN_A, CLOSE_A] = t[1, OPEN_O, CLOSE_O] = t[1, OPEN_O, STRING] = t[1, COMMA, STRING] = True
    for v in _VALUE_END:
        t[:, v, COMMA] = True
        t[0, v, CLOSE_A] = t[1, v, CLOSE_O] = True
    t[1, STRING, COLON] = True
    t[0, COLON] = False
    return t


_ALLOWED = _allowed()


@dataclass
class Containers:
    """Objects and arrays of a batch of JSON texts, in order of their opening bracket.

    ``row`` is the text each belongs to, ``parent`` the index of the container around it (-1: none), ``is_object`` its kind and
    ``key`` the key under which an object holds it. Members are the key-value pairs of objects: ``holder`` is the container, and
    ``value`` a scalar's text (null for containers), ``quoted`` whether it was a string. Items are the scalars of arrays: ``list_of``
    is the array, ``position`` the place in it. ``place`` is the position of a container that is itself an item (-1: it isn't).
    """

    row: np.ndarray
    parent: np.ndarray
    is_object: np.ndarray
    key: pa.Array
    holder: np.ndarray
    name: pa.Array
    value: pa.Array
    quoted: np.ndarray
    place: np.ndarray
    list_of: np.ndarray
    position: np.ndarray
    item: pa.Array
    item_quoted: np.ndarray


def _strings(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[str]:
    """Slices of the buffer as text, by one gather of their bytes."""
    n = end - start
    offsets = np.zeros(len(n) + 1, dtype=np.int32)
    np.cumsum(n, out=offsets[1:])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(start, n)
    return pa.StringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buf[at])))


def _unescape(texts: pa.Array) -> pa.Array:
    """String literals without their quotes as what they mean; only those with a backslash need work."""
    has = pc.match_substring(texts, "\\").to_numpy(zero_copy_only=False)
    if not has.any():
        return texts
    i = np.flatnonzero(has)
    plain = [json.loads('"' + t + '"', strict=False).encode("utf-8", "replace").decode("utf-8") for t in texts.take(pa.array(i)).to_pylist()]
    return pc.replace_with_mask(texts, pa.array(has), pa.array(plain, pa.string()))


def _round(texts: pa.Array):
    """Structure of one batch: valid rows, containers and string values that may spell JSON."""
    texts = texts.cast(pa.large_string()).combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts.cast(pa.large_string())
    n_rows = len(texts)
    lens = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = "\n".join("" if t is None else t for t in texts.to_pylist()) if texts.null_count else None
    if raw is None:
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n_rows + 1]
        body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]] if n_rows else np.zeros(0, np.uint8)
        rows_start = off[:-1] - (off[0] if n_rows else 0) + np.arange(n_rows)
        buf = np.full(len(body) + n_rows, 10, dtype=np.uint8)  # a line end after each row
        keep = np.ones(len(buf), dtype=bool)
        keep[rows_start + lens] = False
        buf[keep] = body
    else:
        buf = np.frombuffer((raw + "\n").encode(), np.uint8)
        rows_start = np.cumsum(lens + 1) - lens - 1
    m = len(buf)
    row_of = np.repeat(np.arange(n_rows), lens + 1)
    bad = np.zeros(n_rows, dtype=bool)
    # escapes: a character is escaped if an odd run of backslashes ends before it
    back = np.flatnonzero(buf == _BACK)
    escaped = np.zeros(m + 1, dtype=bool)
    if len(back):
        first = np.ones(len(back), dtype=bool)
        first[1:] = (back[1:] != back[:-1] + 1) | (row_of[back[1:]] != row_of[back[:-1]])
        run_start = back[np.maximum.accumulate(np.where(first, np.arange(len(back)), 0))]
        odd = (back - run_start) % 2 == 0
        escaped[back[odd] + 1] = True
    quotes = np.flatnonzero((buf == _QUOTE) & ~escaped[:m])
    # quotes pair up within each row; rows with an odd number of them are cut off
    per_row = np.bincount(row_of[quotes], minlength=n_rows)
    bad |= per_row % 2 == 1
    quotes = quotes[~bad[row_of[quotes]]]
    opening, closing = quotes[::2], quotes[1::2]
    level = np.zeros(m + 1, dtype=np.int8)
    level[opening] += 1
    level[closing + 1] -= 1
    in_string = np.cumsum(level[:m], dtype=np.int8) > 0  # with both quotes
    # what strings may hold
    bad[row_of[np.flatnonzero(in_string & (buf < 32))]] = True
    e = np.flatnonzero(escaped[:m] & in_string)
    bad[row_of[e[~_ESCAPABLE[buf[e]]]]] = True
    u = e[buf[e] == ord("u")]
    for k in range(1, 5):
        at = np.minimum(u + k, m - 1)
        bad[row_of[u[~_HEX[buf[at]] | (row_of[at] != row_of[u])]]] = True
    # tokens
    outside = ~in_string & ~_SPACE[buf]
    punct = outside & (_KIND_OF[buf] > 0)
    scalar = outside & ~punct
    begins = scalar.copy()
    begins[1:] &= ~scalar[:-1]
    ends = scalar.copy()
    ends[:-1] &= ~scalar[1:]
    s_start, s_end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    flag = punct | begins
    flag[opening] = True
    tok = np.flatnonzero(flag)
    kind = np.where(begins[tok], SCALAR, _KIND_OF[buf[tok]]).astype(np.int8)
    t_row = row_of[tok]
    scalars = _strings(buf, s_start, s_end)
    if len(scalars):
        good = pc.match_substring_regex(scalars, r"^(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)$").to_numpy(zero_copy_only=False)
        bad[row_of[s_start[~good]]] = True
    # depth and the container of every token: the latest opening bracket one level up
    is_open, is_close = (kind == OPEN_O) | (kind == OPEN_A), (kind == CLOSE_O) | (kind == CLOSE_A)
    first_tok = np.ones(len(tok), dtype=bool)
    first_tok[1:] = t_row[1:] != t_row[:-1]
    depth = np.cumsum(is_open.astype(np.int64) - is_close)
    base = (depth - is_open.astype(np.int64) + is_close)[np.maximum.accumulate(np.where(first_tok, np.arange(len(tok)), 0))] if len(tok) else depth
    depth = depth - base  # after the token
    bad[t_row[depth < 0]] = True
    last_tok = np.ones(len(tok), dtype=bool)
    last_tok[:-1] = first_tok[1:]
    bad[t_row[last_tok & (depth != 0)]] = True
    live = ~bad[t_row]
    tok, kind, t_row, depth, is_open, is_close = (x[live] for x in (tok, kind, t_row, depth, is_open, is_close))
    inside = np.where(is_open, depth - 1, np.where(is_close, depth, depth))  # depth of the container around the token
    opens = np.flatnonzero(is_open)
    number = np.full(len(tok), -1)
    number[opens] = np.arange(len(opens))
    holder = np.full(len(tok), -1)  # container around each token; a closing bracket counts as within what it closes
    if len(opens):
        own_depth = np.where(is_close, depth + 1, np.where(is_open, depth - 1, depth))
        # sort by (row, depth, place): openings at depth d stand at d, before the tokens within them
        at_depth = np.where(is_open, depth, own_depth)
        order = np.lexsort((np.arange(len(tok)), at_depth, t_row))
        latest = np.maximum.accumulate(np.where(is_open[order], np.arange(len(order)), -1))
        found = np.where(latest >= 0, number[order[np.maximum(latest, 0)]], -1)
        same = (latest >= 0) & (t_row[order[np.maximum(latest, 0)]] == t_row[order]) & (at_depth[order[np.maximum(latest, 0)]] == at_depth[order])
        holder[order] = np.where(same, found, -1)
        # an opening bracket lies in the container of the level above: the latest opening of depth - 1
        q = np.lexsort((np.arange(2 * len(opens)), np.concatenate([opens, opens]), np.concatenate([depth[opens], depth[opens] - 1]), np.concatenate([t_row[opens]] * 2)))
        src = np.concatenate([np.arange(len(opens)), np.full(len(opens), -1)])[q]
        who = np.concatenate([np.full(len(opens), -1), np.arange(len(opens))])[q]
        d2, r2 = np.concatenate([depth[opens], depth[opens] - 1])[q], np.concatenate([t_row[opens]] * 2)[q]
        latest = np.maximum.accumulate(np.where(src >= 0, np.arange(len(q)), -1))
        ok = (latest >= 0) & (d2[np.maximum(latest, 0)] == d2) & (r2[np.maximum(latest, 0)] == r2)
        parent = np.full(len(opens), -1)
        asks = who >= 0
        parent[who[asks]] = np.where(ok, src[np.maximum(latest, 0)], -1)[asks]
    else:
        parent = np.zeros(0, np.int64)
    obj = kind[opens] == OPEN_O
    around = holder.copy()
    around[opens] = parent
    # grammar
    prev = np.full(len(tok), START, dtype=np.int8)
    prev[1:] = kind[:-1]
    start_of_row = np.ones(len(tok), dtype=bool)
    start_of_row[1:] = t_row[1:] != t_row[:-1]
    top = (around < 0) & ~is_close
    ctx = np.where(around >= 0, np.append(obj, False)[around], False).astype(np.int8)
    fine = _ALLOWED[ctx, prev, kind]
    # in an object a key is a string after { or , and needs a colon; a value stands after a colon
    two_back = np.full(len(tok), START, dtype=np.int8)
    two_back[2:] = kind[:-2]
    after_key = (prev == STRING) & ((two_back == OPEN_O) | (two_back == COMMA)) & (ctx == 1)
    fine &= ~(ctx == 1) | (after_key == (kind == COLON))
    fine = np.where(top, start_of_row & np.isin(kind, _VALUE_START), fine)
    fine &= ~is_close | (np.append(obj, False)[holder] == (kind == CLOSE_O))
    bad[t_row[~fine]] = True
    has = np.zeros(n_rows, dtype=bool)
    has[t_row] = True
    valid = has & ~bad
    # members of objects: key, colon, value
    key_tok = np.flatnonzero((kind == COLON) & valid[t_row]) - 1
    val_tok = key_tok + 2
    close_of = np.full(m, -1, dtype=np.int64)
    close_of[opening] = closing
    end_of = np.full(m, -1, dtype=np.int64)
    end_of[s_start] = s_end
    k_text = _unescape(_strings(buf, tok[key_tok] + 1, close_of[tok[key_tok]]))
    is_str, is_sca = kind[val_tok] == STRING, kind[val_tok] == SCALAR
    return valid, tok, kind, t_row, opens, parent, obj, around, number, buf, close_of, end_of, key_tok, val_tok, k_text, is_str, is_sca


def parse(texts: pa.Array) -> Containers:
    """Containers of all texts of a batch, strings that spell JSON included."""
    rows_of = np.arange(len(texts))  # the original row of each text of this round
    outer = np.full(len(texts), -1)  # the container that holds it
    spots = np.full(len(texts), -1)  # its position there, if that is a list
    names = pa.nulls(len(texts), pa.string())
    out, base = [], 0
    while True:  # every round strips a layer of quotes, so it ends
        valid, tok, kind, t_row, opens, parent, obj, around, number, buf, close_of, end_of, key_tok, val_tok, k_text, is_str, is_sca = _round(texts)
        use = valid[t_row[opens]]
        shift = np.cumsum(use) - 1 + base  # new number of each container that counts
        o_row = t_row[opens]
        up = np.where(parent >= 0, shift[np.maximum(parent, 0)] if len(shift) else -1, outer[o_row] if len(outer) else -1)
        # the key of a container held by an object; one held by a list within goes without
        key_index = np.full(len(tok), -1)
        key_index[val_tok] = np.arange(len(val_tok))
        ki = key_index[opens]
        outer_key = np.where(parent >= 0, -1, len(k_text) + o_row)
        keys = pa.concat_arrays([k_text.cast(pa.string()), names]).take(pa.array(np.where(ki >= 0, ki, outer_key), mask=(ki < 0) & (outer_key < 0)))
        holder = shift[np.maximum(around[key_tok], 0)] if len(shift) else np.zeros(0, np.int64)
        text = pa.nulls(len(val_tok), pa.string())
        s, c = np.flatnonzero(is_str), np.flatnonzero(is_sca)
        strings = _unescape(_strings(buf, tok[val_tok[s]] + 1, close_of[tok[val_tok[s]]])).cast(pa.string())
        scalars = _strings(buf, tok[val_tok[c]], end_of[tok[val_tok[c]]]).cast(pa.string())
        where = np.full(len(val_tok), -1)
        where[s], where[c] = np.arange(len(s)), len(s) + np.arange(len(c))
        text = pa.concat_arrays([strings, scalars]).take(pa.array(where, mask=where < 0))
        # items of lists: their positions, and the scalars among them
        val = np.flatnonzero(np.isin(kind, _VALUE_START) & valid[t_row] & (around >= 0) & ~np.append(obj, False)[around])
        position = np.full(len(tok), -1)
        position[val] = _numbers_in_row(around[val])
        place = np.where(parent >= 0, position[opens], spots[o_row] if len(spots) else -1)
        li = val[(kind[val] == STRING) | (kind[val] == SCALAR)]
        i_str = kind[li] == STRING
        s, c = np.flatnonzero(i_str), np.flatnonzero(~i_str)
        strings = _unescape(_strings(buf, tok[li[s]] + 1, close_of[tok[li[s]]])).cast(pa.string())
        scalars = _strings(buf, tok[li[c]], end_of[tok[li[c]]]).cast(pa.string())
        where = np.empty(len(li), np.int64)
        where[s], where[c] = np.arange(len(s)), len(s) + np.arange(len(c))
        items = pa.concat_arrays([strings, scalars]).take(pa.array(where))
        list_of = shift[around[li]] if len(shift) else np.zeros(0, np.int64)
        out.append((rows_of[o_row[use]], up[use], obj[use], keys.filter(pa.array(use)), holder, k_text.cast(pa.string()), text, is_str, place[use], list_of, position[li], items, i_str))
        # strings that may spell JSON: values and list items
        all_str = np.flatnonzero((kind == STRING) & valid[t_row])
        is_key = np.zeros(len(tok), dtype=bool)
        is_key[key_tok] = True
        all_str = all_str[~is_key[all_str]]
        head = buf[np.minimum(tok[all_str] + 1, len(buf) - 1)] if len(buf) else np.zeros(0, np.uint8)
        maybe = np.isin(head, [_OPEN_OBJ, _OPEN_ARR, _BACK, 9, 10, 13, 32]) & (close_of[tok[all_str]] > tok[all_str] + 2)
        all_str = all_str[maybe]
        inner = _unescape(_strings(buf, tok[all_str] + 1, close_of[tok[all_str]])).cast(pa.string())
        spells = pc.match_substring_regex(inner, r'^[ \t\r\n]*(?:[\[{]|")') if len(inner) else pa.array([], pa.bool_())
        ok = spells.to_numpy(zero_copy_only=False).astype(bool)
        base += int(use.sum())
        if not ok.any():
            break
        all_str, inner = all_str[ok], inner.filter(pa.array(ok))
        ki = key_index[all_str]
        held = around[all_str]
        top = np.where(held >= 0, shift[np.maximum(held, 0)] if len(shift) else -1, outer[t_row[all_str]])
        keys2 = pa.concat_arrays([k_text.cast(pa.string()), names]).take(pa.array(np.where(ki >= 0, ki, len(k_text) + t_row[all_str]), mask=(ki < 0) & (held >= 0)))
        spots = np.where(held >= 0, position[all_str], spots[t_row[all_str]])
        texts, rows_of, outer, names = inner, rows_of[t_row[all_str]], top, keys2
    cat = lambda i: np.concatenate([x[i] for x in out])
    arr = lambda i: pa.concat_arrays([x[i] for x in out])
    return Containers(cat(0), cat(1).astype(np.int64), cat(2), arr(3), cat(4).astype(np.int64), arr(5), arr(6), cat(7), cat(8).astype(np.int64), cat(9).astype(np.int64), cat(10), arr(11), cat(12))


def nearest_with(c: Containers, own: np.ndarray) -> np.ndarray:
    """For each container the nearest one around it for which ``own`` holds (-1: none), by repeated take of parents."""
    up = c.parent.copy()
    while True:
        skip = (up >= 0) & ~own[np.maximum(up, 0)] if len(own) else np.zeros(0, dtype=bool)
        if not skip.any():
            return up
        up[skip] = c.parent[up[skip]]


def byte_batches(texts: pa.Array, limit: int = BATCH_BYTES):
    """Ranges of rows of at most ``limit`` bytes, or one row."""
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, size = 0, 0
    for i, k in enumerate(n.tolist()):
        if i > start and size + k > limit:
            yield start, i
            start, size = i, 0
        size += k
    if start < len(n):
        yield start, len(n)


def _entities(c: Containers) -> pa.Array:
    """What each container is: the nearest key at or above it. The only key of an object says nothing if there is one above: it just wraps."""
    keyed = c.key.is_valid().to_numpy(zero_copy_only=False)
    members = np.bincount(c.holder, minlength=len(c.row)) if len(c.row) else np.zeros(0, np.int64)
    alone = keyed & (c.parent >= 0) & (members[np.maximum(c.parent, 0)] == 1) if len(c.row) else keyed
    at, own = np.arange(len(c.row)), np.full(len(c.row), -1)
    while True:
        here = at >= 0
        some = here & keyed[np.maximum(at, 0)] if len(at) else here
        own = np.where(some, at, own)
        go = here & (~keyed | alone)[np.maximum(at, 0)] if len(at) else here
        if not go.any():
            return c.key.take(pa.array(own, mask=own < 0))
        at = np.where(go, c.parent[np.maximum(at, 0)], -1)


def _numbers_in_row(row: np.ndarray) -> np.ndarray:
    """0, 1, ... within each row, in order."""
    order = np.argsort(row, kind="stable")
    first = np.searchsorted(row[order], row[order])
    out = np.empty(len(row), dtype=np.int64)
    out[order] = np.arange(len(row)) - first
    return out


def _node_ids(c: Containers, id_key: str) -> tuple[np.ndarray, np.ndarray]:
    """The number under ``id_key`` of each container, and whether it has one: any whole number of 64 bits, in quotes too."""
    hit = pc.fill_null(pc.and_(pc.equal(c.name, id_key), pc.fill_null(pc.match_substring_regex(c.value, r"^-?0*[0-9]{1,19}$"), False)), False)
    i = np.flatnonzero(hit.to_numpy(zero_copy_only=False)) if len(c.name) else np.zeros(0, np.int64)
    text = pc.replace_substring_regex(c.value.take(pa.array(i)), r"^(-?)0+([0-9])", r"\1\2")
    long_ = pc.fill_null(pc.greater(pc.binary_length(text), 18), False).to_numpy(zero_copy_only=False).astype(bool)
    fits = np.ones(len(i), dtype=bool)
    fits[long_] = [-(1 << 63) <= int(t) < 1 << 63 for t in text.filter(pa.array(long_)).to_pylist()]
    i, text = i[fits], text.filter(pa.array(fits))
    ids, own = np.zeros(len(c.row), dtype=np.int64), np.zeros(len(c.row), dtype=bool)
    ids[c.holder[i]] = text.cast(pa.int64()).to_numpy(zero_copy_only=False)
    own[c.holder[i]] = True
    return ids, own


def _item_paths(c: Containers) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """Of each item: the key of its list, the nearest object around it (-1: none), and its positions in the lists between, outermost first."""
    at, levels = c.list_of.copy(), [c.position]
    while True:  # lists within lists, up to the one that an object holds
        up = c.parent[at] if len(at) else at
        go = (up >= 0) & ~c.is_object[np.maximum(up, 0)] if len(at) else np.zeros(0, dtype=bool)
        if not go.any():
            break
        levels.append(np.where(go, c.place[at], -1))
        at = np.where(go, up, at)
    path = np.stack(levels[::-1], 1)
    offsets = np.concatenate(([0], np.cumsum((path >= 0).sum(1)))).astype(np.int32)
    return c.key.take(pa.array(at)), up, pa.ListArray.from_arrays(pa.array(offsets), pa.array(path[path >= 0].astype(np.int64)))


def flat_objects(key_col: str, fields: list[str], id_key: str = "nodeId", every: bool = False):
    """mapInArrow function: one row for each object with an id (with ``every``, for each object), with its entity, the nearest object and the nearest object with an id around it."""

    def run(batches):
        for rb in batches:
            keys = rb.column(key_col)
            for f in fields:
                texts = rb.column(f)
                for lo, hi in byte_batches(texts):
                    c = parse(texts.slice(lo, hi - lo))
                    ids, own = _node_ids(c, id_key)
                    up, ordinal, around = nearest_with(c, own), _numbers_in_row(c.row), nearest_with(c, c.is_object)
                    i = np.flatnonzero(c.is_object if every else own)
                    pick = lambda x, u: pa.array(x[np.maximum(u[i], 0)] if len(x) else np.zeros(0, np.int64), mask=u[i] < 0)
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(lo + c.row[i])), pa.array([f] * len(i), pa.string()), pa.array(ordinal[i]), pick(ordinal, around), pick(ordinal, up), pa.array(ids[i], mask=~own[i]), pick(ids, up), _entities(c).take(pa.array(i))],
                        names=[key_col, "field", "object_no", "holder_no", "parent_no", "node", "parent_node", "entity"],
                    )

    return run


def flat_members(key_col: str, fields: list[str], id_key: str = "nodeId"):
    """mapInArrow function: one row for each scalar member and each scalar item of a list, with the object that holds it and the nearest with an id."""

    def run(batches):
        for rb in batches:
            keys = rb.column(key_col)
            for f in fields:
                texts = rb.column(f)
                for lo, hi in byte_batches(texts):
                    c = parse(texts.slice(lo, hi - lo))
                    _, own = _node_ids(c, id_key)
                    up, ordinal = nearest_with(c, own), _numbers_in_row(c.row)
                    i = np.flatnonzero(~c.value.is_null().to_numpy(zero_copy_only=False))
                    n = len(i) + len(c.list_of)
                    if not n:
                        continue
                    name, held, path = _item_paths(c)
                    h = np.concatenate([c.holder[i], held])
                    at = np.where(h >= 0, np.where(own[h], h, up[h]), -1)
                    row = c.row[np.concatenate([c.holder[i], c.list_of])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array(lo + row)), pa.array([f] * n, pa.string()), pa.array(ordinal[np.maximum(at, 0)], mask=at < 0), pa.array(ordinal[np.maximum(h, 0)], mask=h < 0),
                            pa.concat_arrays([c.name.take(pa.array(i)), name]), pa.concat_arrays([pa.nulls(len(i), path.type), path]),
                            pa.concat_arrays([c.value.take(pa.array(i)), c.item]), pa.array(np.concatenate([c.quoted[i], c.item_quoted])),
                        ],
                        names=[key_col, "field", "object_no", "holder_no", "name", "item_path", "value", "quoted"],
                    )

    return run


def objects_of(df, key_col: str, fields: list[str], id_key: str = "nodeId", every: bool = False):
    """Flat table (key, field, object_no, holder_no, parent_no, node, parent_node, entity) of the objects in JSON columns of ``df``.

    holder_no is the nearest object around it, parent_no the nearest with an id. Objects without an id come out with ``every`` only, with node null.
    """
    from lexforge.session import ship_package

    ship_package(df.sparkSession)
    kind = df.schema[key_col].dataType.simpleString()
    return df.select(key_col, *fields).mapInArrow(flat_objects(key_col, fields, id_key, every), f"{key_col} {kind}, field string, object_no long, holder_no long, parent_no long, node long, parent_node long, entity string")


def members_of(df, key_col: str, fields: list[str], id_key: str = "nodeId"):
    """Flat table (key, field, object_no, holder_no, name, item_path, value, quoted) of the scalars in JSON columns of ``df``.

    Items of lists have the key of the list as their name and their positions, from 0, in item_path (one for each list within the holder); members have none.
    """
    from lexforge.session import ship_package

    ship_package(df.sparkSession)
    kind = df.schema[key_col].dataType.simpleString()
    return df.select(key_col, *fields).mapInArrow(flat_members(key_col, fields, id_key), f"{key_col} {kind}, field string, object_no long, holder_no long, name string, item_path array<bigint>, value string, quoted boolean")
