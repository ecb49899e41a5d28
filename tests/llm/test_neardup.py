"""Near duplicates against brute force; signatures; edge cases."""

import random
import re
import unicodedata

import numpy as np

from lexforge.llm import neardup as N
from lexforge.llm import textkit as K

W = re.compile(r"[^\W_]+")


def shingle_set(t, n):
    w = W.findall(unicodedata.normalize("NFC", t or "").lower())
    return set(zip(*(w[i:] for i in range(n)))), len(w)


def brute(rows, n, threshold, least):
    s = {k: shingle_set(t, n) for k, t in rows}
    ids = sorted(k for k in s if s[k][1] >= least and s[k][0])
    out = set()
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = s[a][0], s[b][0]
            if len(x & y) >= threshold * len(x | y) - 1e-9:
                out.add((a, b))
    return out


def corpus(seed=3, groups=25):
    r = random.Random(seed)
    vocab = [f"từ{i}" for i in range(400)]
    out = []
    for g in range(groups):
        base = [r.choice(vocab) for _ in range(r.randint(50, 160))]
        out.append((f"g{g}_0", " ".join(base)))
        for k in range(r.randint(0, 4)):
            w = base[:]
            for _ in range(r.choice([0, 1, 3, 8, 15])):
                w[r.randrange(len(w))] = r.choice(vocab)
            text = " ".join(w)
            out.append((f"g{g}_{k + 1}", text.upper() if r.random() < 0.2 else unicodedata.normalize("NFD", text) if r.random() < 0.3 else text))
    return out


def pairs(df):
    return {(r.id_a, r.id_b) for r in df.collect()}


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "id2 string, text string, sid string, n int")
    assert pairs(N.near_pairs(df, "id2", "text", 3, 0.6, 60)) == brute(rows, 3, 0.6, 60)
    assert pairs(N.near_pairs(df, "id2", "text", 5, 0.8)) == brute(rows, 5, 0.8, 0)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(80))
    huge = " ".join(f"h{i % 5000}" for i in range(60_000))
    rows = [("a", long), ("a", long), ("b", long), ("c", None), ("d", ""), ("e", "  \n"), (None, long), ("f", huge), ("g", huge + " tail"), ("h", "short text"), ("i", "short text")]
    df = spark.createDataFrame(rows, "id string, text string")
    assert pairs(N.near_pairs(df, "id", "text", 3, 0.6, 60)) == {("a", "b"), ("f", "g")}
    assert N.near_pairs(df.limit(0), "id", "text", 3, 0.6, 60).count() == 0
    got = {r.id: (r.class_id, r.n_copies, r.n_links) for r in N.near_groups(df, "id", "text", 3, 0.6).collect()}
    assert got["a"] == ("a", 1, 0) and got["b"] == ("a", 1, 0) and got["f"][2] == 1 and got["c"][1:] == (0, 0) and None not in got


def test_edited_texts_form_groups(spark):
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join(base[: 100 - 8 * k] + [f"x{i}" for i in range(8 * k)]) for k in range(5)]  # the first and the last are far apart
    rows = [("c4", chain[0]), ("c2", chain[1]), ("c0", chain[2]), ("c3", chain[3]), ("c1", chain[4]), ("c9", chain[3]), ("z", " ".join(f"y{i}" for i in range(100))), ("n", None), ("m", None)]
    df = spark.createDataFrame(rows, "id string, text string")
    got = {r.id: (r.class_id, r.copy_id) for r in N.near_groups(df, "id", "text", 3, 0.8).collect()}
    assert ("c1", "c4") not in pairs(N.near_pairs(df, "id", "text", 3, 0.8))
    assert got == {k: ("c0", "c3" if k == "c9" else k) for k in ("c0", "c1", "c2", "c3", "c4", "c9")} | {k: (k, k) for k in ("z", "n", "m")}


def test_components_against_union_find(spark):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 20)] + [(200 + r.randrange(30), 200 + r.randrange(30)) for _ in range(20)]
    name = list(range(300))
    r.shuffle(name)
    edges = [(name[a], name[b]) for a, b in edges if a != b]
    want = {x: x for e in edges for x in e}
    for _ in want:
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    got = N.components(spark.createDataFrame(edges, "sid_a long, sid_b long")).collect()
    assert len(got) == len(want) and {g.sid: g.root for g in got} == want


def test_shortest_texts_that_count(spark):
    short = " ".join("abcdefghij"[i % 10] for i in range(60))
    df = spark.createDataFrame([("a", short), ("b", short + "."), ("c", short[:-2])], "id string, text string")
    assert pairs(N.near_pairs(df, "id", "text", 3, 0.6, 60)) == {("a", "b")}


def test_large_buckets_are_compared_in_blocks(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(f"{i:03d}", " ".join(base + [f"x{i}"])) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, text string")
    keyed = N.keyed(df, "id", "text")
    want = {tuple(sorted(p)) for p in ((a, b) for a, _ in rows for b, _ in rows if a < b)}
    links = N.near_links(keyed.select("sid", "text"), 3, 0.6, 60, block_size=8)
    assert links.count() == len(want) == 40 * 39 // 2
    assert links.select("sid_a", "sid_b").distinct().count() == len(want)


def test_large_classes_become_stars(spark):
    from lexforge.llm.blocks import expand_classes

    m = spark.createDataFrame([(f"{i:02d}", 7) for i in range(10)] + [("z", 8)], "id string, sid long")
    links = spark.createDataFrame([(7, 8)], "sid_a long, sid_b long")
    assert pairs(expand_classes(links, m, limit=5)) == {("00", f"{i:02d}") for i in range(1, 10)} | {("00", "z")}
    assert len(pairs(expand_classes(links, m))) == 45 + 10


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        both = r.integers(0, 2**63, int(400 * share), dtype=np.int64).astype(np.uint64)
        one, two = (r.integers(0, 2**63, 400 - len(both), dtype=np.int64).astype(np.uint64) for _ in range(2))
        doc = np.repeat([0, 1], 400)
        sig = N.dart_signatures(doc, np.concatenate([both, one, both, two]), None, 2, k=4000)
        true = len(both) / (len(both) + len(one) + len(two))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.04


def test_weighted_signatures():
    e = np.arange(50, dtype=np.uint64)
    w = np.linspace(0.2, 3, 50)
    v = w.copy()
    v[:25] *= 0.5
    sig = N.dart_signatures(np.repeat([0, 1], 50), np.concatenate([e, e]), np.concatenate([w, v]), 2, k=4000)
    assert abs((sig[0] == sig[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum()) < 0.05


def test_words_match_the_pattern():
    texts = ["Xin CHÀO  đường_bộ-a1\x00b", None, "", unicodedata.normalize("NFD", "Đường bộ"), "½²x …"]
    doc, _ = K.words(texts)
    for i, t in enumerate(texts):
        assert (doc == i).sum() == len(W.findall(unicodedata.normalize("NFC", (t or "").replace("\x00", " ")).lower()))
    same = K.words([texts[3]])[1]
    assert list(same) == list(K.words(["đường bộ"])[1])


def test_darts_cost_by_area_at_any_weight():
    e, low = np.arange(1000, dtype=np.uint64), np.zeros(1000, dtype=np.int64)
    made = {}
    for weight in (1e-4, 1e-3, 0.3, 1.0, 40.0):
        high = np.full(1000, max(1, int(np.ceil(1300 / (1000 * weight)))))
        made[weight] = len(N._area_darts(e, np.full(1000, weight), low, high)[0])
        area = 1000 * weight * high[0]
        assert 0.9 * area - 50 < made[weight] < 1.1 * area + 50  # darts as the area, however it is cut
    sig = [N.dart_signatures(np.repeat([0, 1], 1000), np.concatenate([e, e + np.uint64(200)]), np.full(2000, w), 2, k=2000) for w in (1e-3, 0.3, 7.5)]
    for s in sig:
        assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.05


def test_weighted_links_against_brute_force(spark):
    rows = [(a, b + " " + " ".join(b.split()[:9] * (i % 3))) for i, (a, b) in enumerate(corpus(11, 20))] + [("copy", corpus(11, 20)[0][1] + " ")]
    w = {}
    for k, t in rows:
        x = W.findall(unicodedata.normalize("NFC", t).lower())
        n = {}
        for s in zip(*(x[i:] for i in range(5))):
            n[s] = n.get(s, 0) + 1
        w[k] = {s: 1 + np.log(c) for s, c in n.items()}
    want, first = {}, {}
    for k, t in sorted(rows, reverse=True):
        first[t] = k
    for a in first.values():
        for b in first.values():
            if a < b:
                keys = w[a].keys() | w[b].keys()
                lo, hi = (sum(f(w[a].get(s, 0), w[b].get(s, 0)) for s in keys) for f in (min, max))
                if lo >= 0.8 * hi - 1e-9:
                    want[a, b] = round(lo / hi, 6)
    got = {(r.id_a, r.id_b): r.similarity for r in N.weighted_links(spark.createDataFrame(rows, "id string, text string"), "id", "text").collect()}
    assert got.keys() == want.keys() and want and all(abs(got[p] - want[p]) < 2e-6 for p in want)
