import random
import time

import numpy as np
import pandas as pd
import pytest

from strainshift.llm import set_join
from strainshift.llm.components import components
from strainshift.llm.set_join import jaccard_components


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def naive(rows, percent=80):
    """(doc, size, least doc of the component), rows by index."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {}
    for (d, _), r in zip(rows, root):
        least[r] = d if least.get(r) is None else least[r] if d is None else min(d, least[r])
    return sorted(((d, len(s), least[r]) for (d, _), s, r in zip(rows, sets, root)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randint(1, 4)))
    passage = [word() for _ in range(60)]
    rows, texts = [], []
    for i in range(220):
        kind = rng.random()
        if kind < 0.25 or not texts:
            words = [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 30, 90, 300]))]
        elif kind < 0.85:
            words = list(rng.choice(texts))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                at = rng.randrange(len(words))
                words[at:at + rng.randint(0, 2)] = [word()]
        else:
            words = [word() for _ in range(30)] + passage + [word() for _ in range(20)]
        texts.append(words or ["x"])
        rows.append((i, rng.choice([" ", "\t", " \n "]).join(words)))
    base = [word() for _ in range(100)]  # a chain: ends differ, neighbours are alike
    for k in range(30):
        base[k * 3] = word()
        rows.append((500 + k, " ".join(base).upper()))
    return rows + [(300, None), (301, ""), (302, " \n"), (None, rows[5][1]), (7, rows[5][1]), (303, "A b"), (304, "a B")]


@pytest.mark.parametrize("seed, options", [
    (1, {}), (2, {"boundary": 0}), (3, {"boundary": 10 ** 9}), (4, {"boundary": 40}), (1, {"chunk": 400}), (5, {"chunk": 150, "boundary": 20})])
def test_components_equal_brute_force(spark, monkeypatch, seed, options):
    monkeypatch.setattr(set_join, "FREQUENT", 6 if seed % 2 else 64)
    monkeypatch.setattr(set_join, "PACK", 3000 if seed % 2 else 1 << 21)
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, hashes string, n int").repartition(3)
    got = sorted(map(tuple, jaccard_components(df, **options).collect()), key=str)
    assert got == naive(rows)


def test_empty_and_no_links(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l"), (3, "w " * 100000)], "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard_components(df).collect())) == [(1, 2, 1), (2, 2, 2), (3, 1, 3)]
    assert jaccard_components(df.limit(0)).count() == 0


def test_components_of_graphs(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(200, 260)] + [(1, k) for k in range(2, 90)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def near_copies(rng, sets, edits, apart):
    """Sets of 120 hashes: copies of one with a few new hashes, and some of which a quarter is new."""
    base = rng.integers(1, 2 ** 63, 120, dtype=np.uint64)
    some = rng.integers(1, 2 ** 63, 2000, dtype=np.uint64)  # what is new is met again here and there
    out = []
    for i in range(sets):
        new = 30 if i % apart == 0 else rng.integers(0, edits)
        out.append(np.unique(np.r_[rng.permutation(base)[new:], rng.choice(some, new)]))
    return out


def partition(links, rows):
    root = {x: x for x in rows}
    for u, v in links:
        while root[u] != u:
            u = root[u]
        while root[v] != v:
            v = root[v]
        root[max(u, v)] = min(u, v)
    out = {}
    for x in rows:
        r = x
        while root[r] != r:
            r = root[r]
        out[x] = r
    return out


def all_links(sets, percent=80):
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    held = np.zeros((len(sets), len(values)), np.float32)
    held[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), ids] = 1
    both, n = held @ held.T, np.array([len(s) for s in sets])
    return np.argwhere(100 * both >= percent * (n[:, None] + n - both)).tolist()


def test_most_sets_of_a_large_component_are_not_compared_with_all(monkeypatch):
    sets = near_copies(np.random.default_rng(8), 3000, 12, 5)
    df = pd.DataFrame({"root": 7, "chunk": 0, "chunks": 1, "row": np.arange(3000) + 50, "n": [len(s) for s in sets], "hashes": [s.tobytes() for s in sets]})
    compared, linked = [], set_join._Block.linked
    monkeypatch.setattr(set_join._Block, "linked", lambda self, rows, percent: compared.append(np.size(rows)) or linked(self, rows, percent))
    found = set_join._verifier(80)(df)
    assert 600 <= sum(compared) < 1200
    want = {k + 50: r + 50 for k, r in partition(all_links(sets), range(3000)).items()}
    assert partition(found[["u", "v"]].to_numpy().tolist(), range(50, 3050)) == want


@pytest.mark.parametrize("sizes", [(3, 200), (90, 9), (40, 40)])
def test_intersections_by_matrix_and_by_lists(monkeypatch, sizes):
    """Random sets, of which few or many share a hash, in one block and from components known before."""
    rng = np.random.default_rng(sum(sizes))
    pool = rng.integers(1, 2 ** 63, sizes[1] * 3, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool[i % 7:i % 7 + sizes[0] + 9], sizes[0])) for i in range(sizes[1])]
    n, blobs = [len(s) + (i % 3 == 0) for i, s in enumerate(sets)], [s.tobytes() for s in sets]
    values = [set(s.tolist()) for s in sets]
    same = lambda i, j: i == j or 100 * len(values[i] & values[j]) >= 80 * (n[i] + n[j] - len(values[i] & values[j]))
    want = [[j for j in range(len(n)) if same(i, j)] for i in range(len(n))]
    for dense, cells, least in ((1 << 24, 1 << 21, 64), (50, 30, 2), (1, 400, 2)):
        monkeypatch.setattr(set_join, "DENSE", dense)
        monkeypatch.setattr(set_join, "CELLS", cells)
        monkeypatch.setattr(set_join, "HUB_LEAST", least)
        block = set_join._Block(n, blobs)
        for block.cells in {True, block.cells} if block.matrix.size else {True, False}:
            got = [x.tolist() for rows in block.batches(np.arange(len(n))) for x in block.linked(rows, 80)]
            assert got == want
        links = [(i, j) for i in range(len(n)) for j in want[i]]
        for known in (np.arange(len(n)), np.unique([partition(links[::2], range(len(n)))[i] for i in range(len(n))], return_inverse=True)[1]):
            before = [(i, int(np.flatnonzero(known == known[i])[0])) for i in range(len(n))]
            found = set_join._connect(block, known.copy(), 80)
            assert set(found) <= set(links)
            assert partition(before + found, range(len(n))) == partition(links, range(len(n)))


def test_chunks_of_a_large_component_are_compared_in_pairs(spark):
    """A fifth of the sets are too far from all for a link and too near to be told apart by a central set alone."""
    rng = np.random.default_rng(9)
    sets = near_copies(rng, 4000, 12, 4000)
    base = sets[1]
    sets += [np.unique(np.r_[base[23:], rng.choice(2 ** 40, 23 + i % 2).astype(np.uint64)]) for i in range(1500)]
    rows = [(i, len(s), len(s), s.tobytes()) for i, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "row bigint, n bigint, m bigint, hashes binary").repartition(4)
    labels = spark.range(len(rows)).selectExpr("id AS node", "0L AS root")
    began = time.monotonic()
    got = [tuple(r) for r in set_join.verified_links(frame, labels, 80, chunk=100_000).collect()]
    assert time.monotonic() - began < 60  # member by member it takes over 90 s
    assert partition(got, range(len(rows))) == partition(all_links(sets), range(len(rows)))
