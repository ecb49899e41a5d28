"""The forest against brute force: recall, ties, copies, bad vectors."""

import numpy as np
from pyspark.sql import functions as F

from lexforge.llm import neighbors as V


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in rows], "id string, vec array<float>, vid int")


def test_pairs_and_recall(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((1500, 16))
    near = base[:200] + 0.05 * r.standard_normal((200, 16))
    x = np.concatenate([base, near, 3 * base[:20]]).astype(np.float32)
    rows = [(f"{i:05d}", v) for i, v in enumerate(x)] + [("n1", None), ("n2", []), ("n3", [0.0] * 16), ("n4", [float("nan")] * 16), ("n5", [None] * 16), ("n6", [1.0] * 15), ("00000", x[0])]
    df = table(spark, rows)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = u @ u.T
    np.fill_diagonal(sim, -1)
    top = np.argsort(-sim, axis=1)[:, :5]
    want = {tuple(sorted((rows[a][0], rows[b][0]))) for a in range(len(x)) for b in top[a] if sim[a, b] >= 0.9}
    V_pairs = {(p.id_a, p.id_b) for p in V.similar_pairs(df, "id", "vec", dim=16).collect()}
    assert len(want & V_pairs) >= 0.98 * len(want) and not V_pairs - want
    deep = V.nearest(df, "id", "vec", dim=16, probes=40, leaf_rows=100).collect()
    got = {(d.id, d.neighbor) for d in deep}
    true = {(rows[a][0], rows[b][0]) for a in range(len(x)) for b in top[a]}
    assert len(got & true) >= 0.9 * len(true)


def test_one_leaf_is_exact_with_ties_and_copies(spark):
    df = table(spark, [("c", [1, 0]), ("a", [1, 0]), ("b", [2, 0]), ("d", [0, 1]), ("e", [1, 1]), ("f", [1, 0])])
    got = {}
    for r in V.nearest(df, "id", "vec", dim=2, k=3).collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbor
    assert [got["a"][k] for k in (1, 2, 3)] == ["b", "c", "f"]
    assert [got["b"][k] for k in (1, 2, 3)] == ["a", "c", "f"]
    assert got["d"][1] == "e" and len(got) == 6


def test_empty_and_single(spark):
    df = table(spark, [("a", [1, 0])])
    assert V.nearest(df, "id", "vec", dim=2).count() == 0
    assert V.similar_pairs(df.limit(0), "id", "vec", dim=2).count() == 0


def test_many_copies_stay_linear(spark):
    df = table(spark, [(f"{i:03d}", [1, 2]) for i in range(300)] + [("z", [1, 2.01])])
    got = V.nearest(df, "id", "vec", dim=2)
    assert got.count() == 301 * 5
    assert {r.neighbor for r in got.where("id = 'z'").collect()} == {"000", "001", "002", "003", "004"}


def test_large_leaves_are_split(spark, monkeypatch):
    monkeypatch.setattr(V, "LEAF_LIMIT", 50)
    r = np.random.default_rng(3)
    x = r.standard_normal((600, 8)).astype(np.float32)
    x = np.concatenate([x, x + 0.01 * r.standard_normal(x.shape).astype(np.float32)])
    members = np.arange(len(x))
    u = V.unit_rows(x)
    got = set()
    y, rest = V.unpack(V.pack(u), 8)
    for a, b in V._rank_leaf(members, members, y, rest, members, 1, 0.9, np.random.default_rng(1)):
        got |= set(zip(a.tolist(), b.tolist()))
    assert sum((i, i + 600) in got or (i + 600, i) in got for i in range(600)) >= 580


def test_exact_neighbors(spark):
    df = table(spark, [("a", [1, 0]), ("b", [1, 0.1]), ("c", [0, 1])])
    got = V.exact_neighbors(df, "id", "vec", "id = 'a'", dim=2, k=1).collect()
    assert [(r.id, r.neighbor) for r in got] == [("a", "b")]


def test_recall_keeps_up_with_the_number_of_leaves():
    from lexforge.llm import queries_vectors as Q

    x = V.unit_rows(np.random.default_rng(4).standard_normal((16_000, 64))).astype(np.float32)
    forest = V.fit_forest(x, len(x), leaf_rows=16)
    q = np.arange(100)
    sim = x[q] @ x.T
    sim[q, q] = -2
    top = np.argsort(-sim, axis=1)[:, :5]
    held = forest.leaves(x, 0)

    def recall(probes):
        opened = forest.leaves(x[q], probes)
        return np.mean([np.isin(held[j], opened[i]).any() for i in range(len(q)) for j in top[i]])

    assert 2**forest.depth == 1024 and recall(Q.WIDE) < 0.6
    assert recall(V.probes_for(Q.WIDE, Q.SHARE, forest.depth)) >= 0.9
    assert V.probes_for(Q.WIDE, Q.SHARE, 4) == 80


def test_exact_neighbors_of_all_blocks(spark):
    x = np.random.default_rng(6).standard_normal((60, 4))
    df = table(spark, [(f"{i:02d}", v) for i, v in enumerate(x)])
    u = V.unit_rows(x.astype(np.float32))
    sim = u @ u.T
    np.fill_diagonal(sim, -2)
    got = {(r.id, r.neighbor) for r in V.exact_neighbors(df, "id", "vec", "id < '50'", 20, dim=4, k=2).collect()}
    assert got == {(f"{i:02d}", f"{j:02d}") for i in range(50) for j in np.argsort(-sim[i])[:2]}


def test_rounding_loses_no_candidate():
    r = np.random.default_rng(8)
    u = V.unit_rows(np.concatenate([r.standard_normal((300, 64)), 1 + 0.05 * r.standard_normal((100, 64))]).astype(np.float32))
    x, rest = V.unpack(V.pack(u).slice(0), 64)
    assert np.allclose(np.linalg.norm(x - u, axis=1), rest, atol=1e-5) and rest.max() < 2e-4
    sim, rows = u @ u.T, np.arange(len(u))
    np.fill_diagonal(sim, -2)
    for least in (0.0, 0.9):
        got = {(i, j) for a, b in V._rank_leaf(rows, rows, x, rest, rows, 5, least, r) for i, j in zip(a.tolist(), b.tolist())}
        want = {(i, j) for i in rows.tolist() for j in np.argsort(-sim[i])[:5].tolist() if sim[i, j] >= least}
        assert want <= got and len(got) < 7 * len(rows)


def test_an_asking_id_counts_among_copies_that_do_not_ask(spark):
    x = np.random.default_rng(9).standard_normal((40, 4))
    df = table(spark, [(f"{i:02d}", v) for i, v in enumerate(x)] + [("99", x[3])])
    for ask in ("03", "99"):
        got = {r.neighbor for r in V.nearest(df, "id", "vec", dim=4, k=3, asks=F.col("id") == ask).collect()}
        assert ({"03", "99"} - {ask}) < got and len(got) == 3


def test_edges_are_cut_before_copies_come_in(spark):
    near = [(f"n{i:02d}", [1, 2 + 0.001 * i]) for i in range(1, 40)]
    df = table(spark, near + [(f"c{i:03d}", [1, 2]) for i in range(400)])
    got = V.nearest(df, "id", "vec", dim=2)
    assert got.count() == 5 * 439 and {r.neighbor for r in got.where("id = 'n01'").collect()} == {"n02"} | {f"c{i:03d}" for i in range(4)}


def test_look_alikes_stay_linear():
    r = np.random.default_rng(12)
    u = V.unit_rows((1 + 1e-6 * r.standard_normal((2_000, 64))).astype(np.float32))
    x, rest = V.unpack(V.pack(u), 64)
    rows = np.arange(len(u))
    assert sum(len(a) for a, _ in V._rank_leaf(rows, rows, x, rest, rows, 5, 0.9, r)) == V.CLOSE * len(rows)
