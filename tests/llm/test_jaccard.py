import collections
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import jaccard as J
from quillgraph.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute(rows, width=4, percent=85):
    sets, parent, seen = {i: shingles(t, width) for i, t in rows}, {i: i for i, _ in rows}, collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        common = collections.Counter(j for g in s for j in seen[g])
        for j, o in common.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for g in s:
            seen[g].append(i)
    return {i: (len(sets[i]), find(i)) for i in sets}


def hard(seed):
    """Near copies on both sides of the threshold, a passage that many share, exact copies, short and empty texts."""
    rng = random.Random(seed)
    words, docs = [f"w{i}" for i in range(3000)], []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(rng.choice([12, 40, 120, 300]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, max(1, len(w) // 60), max(1, len(w) // 40)])):
                i, kind = rng.randrange(len(w)), rng.random()
                if kind < 0.6:
                    w[i] = rng.choice(words)
                elif kind < 0.8:
                    del w[i]
                else:
                    w.insert(i, rng.choice(words))
            docs.append(" ".join(w))
    passage = [rng.choice(words) for _ in range(60)]
    docs += [" ".join([rng.choice(words) for _ in range(rng.randint(0, 120))] + passage + [rng.choice(words) for _ in range(rng.randint(0, 60))]) for _ in range(80)]
    docs += [docs[0]] * 20 + ["Short TEXT here", "short\ttext\x0bhere", "a", "", " \n", None, "İ ı K", "i̇ ı k"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "width", "percent"), [(0, 4, 85), (1, 5, 80)])
def test_components_are_exact(spark, seed, width, percent):
    rows = hard(seed)
    got = J.groups(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, width, percent)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in J.op9_jaccard_join(spark, sf).collect()} == brute(rows)


def test_one_of_each(spark):
    rows = hard(3)
    want = {i for i, (n, c) in brute(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def kept_by_row(rows):
    """Brute force by row: the least (null, id) of each group stays; rows without words stay."""
    texts = list(enumerate(t for _, t in rows))
    at = {k: c for k, (_, c) in brute(texts, 5, 80).items()}
    best = {}
    for k, (i, t) in enumerate(rows):
        if shingles(t, 5):
            best[at[k]] = min(best.get(at[k], (True, 1 << 62)), (i is None, i or 0))
    return sorted(((i is None, i or 0) for i, t in rows if not shingles(t, 5))), sorted(best.values())


def test_one_of_each_decides_by_row(spark):
    t, u, v = (" ".join(f"{c}{k}" for k in range(40)) for c in "tuv")
    near = t + " more"
    rows = [(0, t), (1, t), (1, u), (2, v), (None, v), (None, near), (None, "nobody has an id here at all"), (None, "Nobody has an id here at all"), (5, ""), (5, ""), (6, None), (None, " "), (7, u + " x"), (7, u + " x"), (7, v)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'c' as key", "1 as q_0", "map('a', 1) as m")
    got = J.one_of_each(docs).collect()
    empty, best = kept_by_row(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if not shingles(r.text, 5)) == empty
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got if shingles(r.text, 5)) == best
    assert {(r.doc_id, r.text) for r in got if r.doc_id in (0, 1, 2)} == {(0, t), (1, u), (2, v)} and all(r.m == {"a": 1} for r in got)


def test_hot_shingles_and_groups(spark, monkeypatch):
    """The ways of hot shingles, buckets and components give the same groups."""
    from quillgraph.llm import common
    from quillgraph.llm import components as module

    monkeypatch.setattr(J, "HOT", 3)
    monkeypatch.setattr(J, "SMALL", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(module, "LOCAL", 50)
    rows = hard(5)
    got = J.groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute(rows, 5, 80)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.floats(0, 1), st.integers(0, 10**6), st.sampled_from([80, 85]))
def test_linked_sets_meet(n, share, seed, percent):
    rng = np.random.default_rng(seed)
    x = rng.integers(1, 1 << 63, n + 200, dtype=np.uint64)
    a = np.unique(x[:n])
    # as many changes as a link allows at most, split between both sides
    d = int(share * 2 * n * (100 - percent) / (100 + percent))
    b = np.unique(np.concatenate([x[d // 2 : n], x[n : n + d - d // 2]]))
    o = len(np.intersect1d(a, b))
    if len(b) and 100 * o >= percent * (len(a) + len(b) - o):
        often = rng.integers(0, 4, J.SLOTS).astype(np.int32)
        (p, _), (q, _) = J.named(a, 1, often, 9, percent), J.named(b, 2, often, 9, percent)
        small, large = (p, q) if len(a) <= len(b) else (q, p)
        assert np.intersect1d(small[small & np.uint64(1) > 0] >> np.uint64(2), large >> np.uint64(2)).size


def test_packed_sets_keep_overlaps():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2))
    a, b = x[:400], x[100:]
    assert sum(J.overlap(p, q) for p, q in zip(J.packed(a), J.packed(b), strict=True)) == 300
    assert J.packed(np.zeros(0, np.uint64)) == [b""] * J.FRAGMENTS


@pytest.mark.parametrize(("seed", "local"), [(0, 10_000), (1, 10), (2, 10)])
def test_connected_components(spark, monkeypatch, seed, local):
    from quillgraph.llm import components as module

    monkeypatch.setattr(module, "LOCAL", local)
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 230)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


@pytest.mark.parametrize("hot", [0, 1000])
def test_attach(spark, monkeypatch, hot):
    from quillgraph.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rows = spark.createDataFrame([(1, "a")] * 50 + [(1, None)] + [(2, "b"), (3, "c"), (None, "d")], "k long, v string")
    table = spark.createDataFrame([(1, 10, None, 51), (2, 20, "x", 1), (9, 90, "y", 0)], "k long, w long, z string, q_n long")
    got = common.attach(rows, table, "k").collect()
    assert sorted((r.k, r.v or "", r.w, r.z) for r in got) == sorted([(1, "a", 10, None)] * 50 + [(1, "", 10, None), (2, "b", 20, "x")], key=str) and got[0].__fields__ == ["k", "v", "w", "z"]


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
