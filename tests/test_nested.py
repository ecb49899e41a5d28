"""The JSON kernels against a plain walk over parsed values."""

import json
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.operators import nested


def _spelled(v):
    while isinstance(v, str):
        try:
            w = json.loads(v, parse_constant=lambda x: 1 / 0)
        except Exception:
            return v
        if not isinstance(w, (list, dict, str)):
            return v
        v = w
    return v


def brute(texts):
    out = set()

    def walk(v, row, par):
        v = _spelled(v)
        if isinstance(v, dict):
            nid = v.get("nodeId")
            if nid is not None and not isinstance(nid, bool) and re.fullmatch(r"-?\d+", str(nid)) and -(1 << 63) <= int(nid) < 1 << 63:
                if par is not None:
                    out.add((row, par, int(nid)))
                par = int(nid)
            for x in v.values():
                walk(x, row, par)
        elif isinstance(v, list):
            for x in v:
                walk(x, row, par)

    for i, t in enumerate(texts):
        try:
            v = json.loads(t, parse_constant=lambda x: 1 / 0)
        except Exception:
            continue
        walk(v, i, None)
    return out


def fast(texts):
    a = pa.array(texts, pa.string())
    c = nested.parse(a)
    ids, own = nested._node_ids(c, "nodeId")
    up = nested.nearest_with(c, own)
    return {(int(r), int(ids[u]), int(ids[i])) for i, (r, u) in enumerate(zip(c.row, up)) if own[i] and u >= 0}


HARD = [
    '{"nodeId":1,"a":[{"nodeId":2},[{"b":{"nodeId":"3"}}]]}', "[1,2", '{"a":"\\"x"}', '{"nodeId":1,"a":"[{\\"nodeId\\": 5}]"}', '"[{\\"nodeId\\":7,\\"x\\":{\\"nodeId\\":8}}]"', None, "", " ", "nul",
    '{"a":1,}', '{"a" 1}', "{a:1}", "[1 2]", '{"nodeId":1}{"nodeId":2}', '{"a":[}]', '{"nodeId":1,"x":"{\\"nodeId\\":9"}', '{"x":"a\\q"}', '{"x":NaN}', "01", '{"nodeId":1,"k":{"nodeId":2,"nodeId":3}}',
    '{"a":{"b":1}:2}', '{"a","b":1}', '{"a":1 "b":2}', ' {"nodeId": 1, "z": [ {} , {"nodeId": 4} ] } ', '{"a":"tab\tx"}', '["a":1]', '{"a":"b":1}', '{"nodeId":1,"a":" \\"{\\\\\\"nodeId\\\\\\":4}\\" "}',
    '{"nodeId":1,"a":"\\u005b{\\"nodeId\\":2}]"}', "{}", "[]", '"x"', "[[[[[[{\"nodeId\":1}]]]]]]", "]", "}{", '{"nodeId":1,"ế":{"nodeId":2,"s":"\\ud83d\\ude00"}}',
]


def test_hand_written():
    for t in HARD:
        assert fast([t]) == brute([t]), t
    assert fast(HARD) == brute(HARD)
    assert fast([]) == set() and fast([None, None]) == set()


values = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 99) | st.text(alphabet='a"\\[{]}:, 1\n', max_size=6),
    lambda c: st.lists(c, max_size=3) | st.dictionaries(st.sampled_from(["nodeId", "a", "b", "items"]), c, max_size=3) | c.map(lambda v: json.dumps(v)),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(values, st.integers(0, 30)), max_size=4))
def test_random_and_cut_off(rows):
    texts = [json.dumps(v)[: None if cut > 8 else -cut or None] for v, cut in rows]
    assert fast(texts) == brute(texts)


def test_tables_keep_links(spark):
    df = spark.createDataFrame([(1, '{"nodeId":1,"docs":{"items":[{"nodeId":2,"x":"y","n":{"m":1}}]}}', "junk"), (1, None, None)], "row_id long, a string, junk string")
    o = nested.objects_of(df, "row_id", ["a"]).orderBy("object_no").collect()
    assert [(r.node, r.parent_node, r.entity) for r in o] == [(1, None, None), (2, 1, "docs")]
    m = {(r.name, r.value, r.quoted, r.object_no) for r in nested.members_of(df, "row_id", ["a"]).collect()}
    assert ("x", "y", True, o[1].object_no) in m and ("m", "1", False, o[1].object_no) in m
    assert o[1].parent_no == o[0].object_no
    assert nested.objects_of(df.limit(0), "row_id", ["a"]).count() == 0


def test_batches_cover_all_rows():
    a = pa.array(["x" * k for k in (1, 900, 5, 2000, 3)])
    got = list(nested.byte_batches(a, 1000))
    assert [i for lo, hi in got for i in range(lo, hi)] == list(range(5))
    assert np.all([hi > lo for lo, hi in got])


def scalars(texts):
    """(row, name, path, value) of all scalars by a plain walk."""
    out = []

    def say(v):
        return v if isinstance(v, str) else json.dumps(v)

    def walk(v, row, name, path):
        if not isinstance(v, (dict, list)):
            if name != "" or path:
                out.append((row, name or None, path or None, say(v)))
            v = _spelled(v)
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, row, k, ())
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, row, name, path + (i,))

    for i, t in enumerate(texts):
        walk(json.loads(t), i, "", ())
    return sorted(out, key=repr)


LISTS = [
    '{"nodeId":1,"tags":["x","y\\n"],"n":{"deep":[[1,2],[],[3,[true,null]]],"k":"v"}}', '["a",{"b":[1]},"[5,\\"q\\"]"]', '{"s":"[\\"p\\",{\\"t\\":[7]}]"}', "[[]]", '"[1, \\"[2]\\"]"', '{"a":[{"b":1},2]}',
]


def test_items_of_lists_are_members(spark):
    df = spark.createDataFrame(list(enumerate(LISTS)), "row_id long, a string")
    got = nested.members_of(df, "row_id", ["a"]).collect()
    assert sorted(((r.row_id, r.name, r.item_path and tuple(r.item_path), r.value) for r in got), key=repr) == scalars(LISTS)
    objects = {(r.row_id, r.object_no): r for r in nested.objects_of(df, "row_id", ["a"], every=True).collect()}
    assert all((r.row_id, r.holder_no) in objects for r in got if r.holder_no is not None)
    assert {(r.name, r.value) for r in got if r.holder_no is None} == {(None, x) for x in ("a", "[5,\"q\"]", "5", "q", "1", "[2]", "2")}
    n = next(o for (i, _), o in objects.items() if i == 0 and o.entity == "n")
    assert (n.node, n.parent_node, objects[0, n.holder_no].node) == (None, 1, 1)
    deep = next(r for r in got if r.value == "true")
    assert (deep.item_path, deep.holder_no, deep.quoted) == ([2, 1, 0], n.object_no, False)


def test_strings_within_strings_of_any_depth():
    s = '{"nodeId":2}'
    for _ in range(15):
        s = json.dumps(s)
    t = '{"nodeId":1,"a":' + s + "}"
    assert fast([t]) == brute([t]) == {(0, 1, 2)}


def test_ids_of_64_bits():
    big = (1 << 63) - 1
    texts = [json.dumps({"nodeId": 1234567890123456789, "a": [{"nodeId": big}, {"nodeId": str(-big - 1)}, {"nodeId": "0000000000000000000000000012"}, {"nodeId": big + 1}, {"nodeId": "9" * 30}]})]
    assert fast(texts) == brute(texts) == {(0, 1234567890123456789, x) for x in (big, -big - 1, 12)}


def test_json_in_strings_of_twenty_layers():
    v = {"nodeId": 2}
    for _ in range(20):
        v = json.dumps(v)
        if len(v) > 3_000_000:
            break
    text = json.dumps({"nodeId": 1, "a": v}) if len(json.dumps(v)) < 40_000_000 else None
    assert text is None or fast([text]) == {(0, 1, 2)}
