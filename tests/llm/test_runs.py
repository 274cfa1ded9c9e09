"""Periodic runs against brute force over all periods and places."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from lumenloom.llm import queries as Q
from lumenloom.llm import runs as R
from tests.llm.helpers import awkward, documents, words


def brute(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                s = w[i : i + length]
                if all(any(s[k] != s[k + p] for k in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept(ws, runs):
    return [x for i, x in enumerate(ws) if not any(s + q <= i < s + n for s, n, q in runs)]


def changed(i, text):
    """The words of the query's contract, from its text alone."""
    ws = (text or "").encode().split()
    n, h = len(ws), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        ws = [ws[j] if j < a else ws[a + (j - a) % p] for j in range(n)]
    return ws


@pytest.mark.parametrize("seed", range(4))
def test_runs_match_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(400):
        letters, w = rng.choice([1, 2, 2, 3, 5]), []
        for _ in range(rng.randint(1, 5)):
            root = [rng.randrange(letters + 1) for _ in range(rng.randint(1, 20))]
            whole = root * rng.randint(1, 9)
            w += whole[: rng.randint(0, len(whole))]
        if rng.random() < 0.3:
            w = (w * rng.randint(1, 6))[:300]
        assert R.runs_of(np.array(w, np.int64)) == brute(w)


def test_long_texts_of_one_word_and_of_strings_that_repeat_themselves():
    assert R.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert R.runs_of(np.tile(np.arange(1000), 40)) == [(0, 40_000, 1000)]
    inner = R.runs_of(np.tile(np.array([0] * 12 + [1]), 500))
    assert inner[:2] == [(0, 12, 1), (0, 6500, 13)] and len(inner) == 501
    a, b = [0], [0, 1]
    while len(b) < 5000:
        a, b = b, b + a
    assert R.runs_of(np.array(b)) == []


def test_awkward_rows(spark):
    rows = R.periodic_runs(documents(spark, [*awkward(), (30, "b b b b b b\tc"), (31, "b B b B b B b B")])).collect()
    assert len(rows) == len(awkward()) + 2
    by = {r.doc_id: r for r in rows}
    assert (by[4].n_words, by[4].runs, by[4].collapsed) == (0, [], "") and by[6].collapsed == ""
    assert [tuple(r) for r in by[30].runs] == [(0, 6, 1)] and by[30].collapsed == "b c"
    assert [tuple(r) for r in by[31].runs] == [(0, 8, 2)] and by[31].collapsed == "b B"
    assert by[9].n_words == 30_000


def test_empty_table(spark):
    assert R.periodic_runs(documents(spark, [])).collect() == []


def test_op11(spark, tmp_path):
    rng = random.Random(4)
    docs = {i: t for i, t in awkward() if i is not None and len(t or "") < 2000}
    docs |= {i: " ".join(words(rng, rng.randint(1, 90))) for i in range(40, 240)}
    docs |= {300: "x\ny\nx\ny\nx\ny\nx\ny\nx\ny", 301: "naïve \U0001f600 " * 7, 302: None}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.op11_runs(spark, str(tmp_path)).collect()}
    assert set(got) == set(docs) and sum(r.n_runs > 0 for r in got.values()) > 8
    for i, t in docs.items():
        ws = changed(i, t)
        runs = brute(ws)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *want)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept(ws, runs))).hexdigest()
