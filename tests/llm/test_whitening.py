"""Whitening against numpy over whole tables."""

import math

import numpy as np
import pytest

from lumenloom.llm import queries as Q
from lumenloom.llm import whitening as W

KINDS = "vec_id long, embedding array<float>, component string, n string, x string, id string"


def brute(vectors):
    """The covariance, its eigenvalues and exact deviations, by whole numbers of any size."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    once = sorted({tuple(r) for r in x})
    n, s = len(once), [sum(c) for c in zip(*once)]
    centred = np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in once])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    deviation = [sum((n * a - b) ** 2 for a, b in zip(r, s)) for r in x]
    return n, np.array([[(n * a - b) / n for a, b in zip(r, s)] for r in x]), values[::-1], vectors[:, ::-1], np.trace(cov), deviation


def check(rows, ids, vectors, k):
    n, centred, values, axes, trace, deviation = brute(vectors)
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert set(by) == set(ids) and all(sorted(v) == list(range(1, k + 1)) for v in by.values())
    for c in range(1, k + 1):
        got = np.array([by[i][c].whitened for i in ids])
        want = centred @ axes[:, c - 1] / np.sqrt(values[c - 1])
        sign = np.sign(got @ want)
        assert np.allclose(got, sign * want, atol=1e-6)
        assert {by[i][c].n for i in ids} == {n}
        assert all(math.isclose(by[i][c].explained, values[c - 1] / trace, rel_tol=1e-9) for i in ids)
    assert [by[i][1].deviation for i in ids] == deviation
    assert max(r.identity_error for r in rows) < 1e-8 and len({r.identity_error for r in rows}) == 1


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op13_on_the_given_vectors(spark, sf):
    given = [r for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    rows = Q.op13_whitening(spark, f"/root/testdata/{sf}").collect()
    check(rows, [r.vec_id for r in given], [r.embedding for r in given], min(16, len(given[0].embedding)))


def test_few_dimensions_repeats_and_what_takes_no_part(spark):
    rng = np.random.default_rng(2)
    sound = [(i, [float(c) for c in rng.normal(size=5) * [9, 5, 3, 2, 1]]) for i in range(60)]
    sound += [(100 + i, sound[0][1]) for i in range(50)]
    bad = [(200, None), (201, []), (202, [1.0, None, 2.0, 3.0, 4.0]), (203, [float("nan")] * 5), (204, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in sound + bad], KINDS)
    rows = W.whitened_embeddings(table).collect()
    f32 = [[float(np.float32(c)) for c in v] for _, v in sound]
    check(rows, [i for i, _ in sound], f32, 5)


def test_repeated_and_null_ids_are_rows_of_their_own(spark):
    table = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 1.0]), (None, [0.0, 5.0]), (None, [0.0, 5.0])], "vec_id long, embedding array<double>")
    rows = W.whitened_embeddings(table).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {3} and sum(r.vec_id is None for r in rows) == 4


def test_what_does_not_vary_has_no_whitened_value(spark):
    table = spark.createDataFrame([(i, [float(i), 7.0, 7.0]) for i in range(9)], "vec_id long, embedding array<float>")
    rows = W.whitened_embeddings(table).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and rows[0].identity_error < 1e-12
    one = W.whitened_embeddings(table.where("vec_id = 3")).collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 3


def test_empty_tables(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = W.whitened_embeddings(table)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.collect() == []
    assert W.whitened_embeddings(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect() == []


def test_entries_without_an_exact_whole_number_raise(spark):
    table = spark.createDataFrame([(1, [1e30, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        W.whitened_embeddings(table).collect()
