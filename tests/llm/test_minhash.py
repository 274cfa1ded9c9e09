import random

import numpy as np
import pytest

from lumenloom.llm import minhash as M
from lumenloom.llm.graph import connected_components
from tests.llm.helpers import awkward, documents, words


def shingles(text):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts}
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = sorted((root(ids[a]), root(ids[b])))
                comp[s] = r
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def run(spark, pairs):
    rows = M.near_duplicates(documents(spark, pairs)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}, rows


@pytest.mark.parametrize("n", [1, 5, 130, 5000])
def test_every_coordinate_is_filled_and_estimates_the_similarity(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    s = M.sketch(a)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (s == M.sketch(a[::-1])).all()
    if n > 1000:
        b = np.r_[a[: n * 9 // 10], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s == M.sketch(b)).mean() - true) < 0.17


def test_groups_of_near_copies_match_brute_force(spark):
    rng = random.Random(3)
    pairs, i = [], 0
    for _ in range(12):
        base = words(rng, 80)
        for _ in range(rng.randint(1, 9)):
            t = list(base)
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = "".join(words(rng, 1))
            pairs.append((i, " ".join(t)))
            i += 1
    passage = " ".join(words(rng, 60))
    pairs += [(i + k, passage + " " + " ".join(words(rng, rng.randint(5, 50)))) for k in range(25)]
    rng.shuffle(pairs)
    assert run(spark, pairs)[0] == brute(pairs)


def test_awkward_rows(spark):
    got, rows = run(spark, awkward())
    expected = brute([p for p in awkward() if p[0] is not None])
    none = got.pop(None)
    assert got == expected and len(rows) == len(awkward())
    assert none == (56, None, False)


def test_empty_table(spark):
    assert run(spark, [])[1] == []


def test_chains_and_hubs_are_one_component(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 300)}


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """A hub that no member but one is linked to directly does not hide links between the others."""
    monkeypatch.setattr(M, "BLOCK", 4)
    rng = random.Random(8)
    base = words(rng, 200)
    pairs = []
    for i in range(40):
        t = list(base)
        for k in rng.sample(range(200), 9):
            t[k] = "".join(words(rng, 1)) + str(i)
        pairs.append((i, " ".join(t)))
        if i % 4 == 0:
            t[0] = "other"
            pairs.append((100 + i, " ".join(t)))
    assert run(spark, pairs)[0] == brute(pairs)


def test_an_id_with_several_texts_is_one_vertex(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    pairs = [(7, a), (5, a), (7, b), (9, b + " tail"), (7, b), (7, None), (11, ""), (11, None), (12, c), (12, " "), (3, c.upper()), (20, b.upper())]
    by_id = {}
    for i, t in pairs:
        by_id.setdefault(i, []).append(shingles(t))
    comp = {i: i for i in by_id}
    for _ in by_id:  # labels spread until they settle
        for i in by_id:
            for j in by_id:
                if any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in by_id[i] for y in by_id[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    assert comp[9] == 5 and comp[20] == 5 and comp[12] == 3 and comp[11] == 11
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, pairs)[1])
    assert got == sorted((i, len(shingles(t)), comp[i], comp[i] == i) for i, t in pairs)


def test_nothing_but_the_result_stays_on_disk(spark):
    import os

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    before = set(os.listdir(base))
    rows = M.near_duplicates(documents(spark, awkward()))
    assert len(set(os.listdir(base)) - before) == 1 and rows.count() == len(awkward())
