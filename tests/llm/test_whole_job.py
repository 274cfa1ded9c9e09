"""The corpus operators on what small and tidy tables do not show."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from lumenloom.llm import queries as Q
from lumenloom.llm import toxicity as T
from lumenloom.llm import vptree as V
from tests.llm.helpers import awkward, documents, words


@pytest.mark.parametrize("sigma", [0.0, 0.2, 0.4])
def test_all_true_neighbours_over_a_spread_of_norms(spark, tmp_path, sigma):
    """100,000 clustered vectors of 64 dimensions with lognormal norms, searched as registered."""
    rng = np.random.default_rng(3)
    n, k, every = 100_000, 20, 500
    x = rng.normal(size=(200, 64))[rng.integers(0, 200, n)] + 0.3 * rng.normal(size=(n, 64))
    x *= (np.exp(sigma * rng.normal(size=n)) / np.linalg.norm(x, axis=1))[:, None]
    x = x.astype(np.float32)
    column = pa.ListArray.from_arrays(pa.array(np.arange(0, n * 64 + 1, 64, dtype=np.int32)), pa.array(x.ravel()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": column}), tmp_path / "v.parquet", row_group_size=10_000)
    got = V.nearest(spark.read.parquet(str(tmp_path / "v.parquet")), k=k, every=every).toPandas()
    x = x.astype(float)
    score = x[::every] @ x.T
    score[np.arange(len(score)), np.arange(0, n, every)] = -np.inf
    true = np.argpartition(-score, k, axis=1)[:, :k]
    mine = got.groupby("query_id").vec_id.agg(set)
    recall = np.mean([len(mine.get(q * every, set()) & set(t.tolist())) / k for q, t in enumerate(true)])
    assert recall == 1.0


def packed(rows) -> dict:
    total, used = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
        used[r.sequence] = used.get(r.sequence, 0) + r.length
    assert all(used[r.sequence] <= r.capacity for r in rows)
    return total


def test_packing_counts_the_ids_of_token_files(spark, tmp_path):
    """The sequences' ids are those of the files, end ids among them, also of texts without spaces."""
    texts = [*awkward(), (20, "\u4e2d\u6587" * 9000), (21, " two  blanks "), (22, "na\u00efve \u4e2d\u6587 don't 12345")]
    docs = documents(spark, texts)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    true = {}
    for r in Q.op4_token_files(spark, str(tmp_path)).collect():
        true[r.doc_id] = true.get(r.doc_id, 0) + r.n_tokens
    assert true[11] > 100 and true[20] > 8192
    assert packed(Q.op7_packing(spark, str(tmp_path)).collect()) == true
    assert packed(corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()) == true


def test_long_toxic_documents_are_learned_whole(spark):
    """Insults late in the alphabet, in documents with over 20,000 characters of other distinct words."""
    rng = random.Random(5)
    common = sorted(set(words(rng, 9000)))
    assert len(" ".join(common)) > 40_000
    texts = {i: " ".join(rng.sample(common, 6000) + ["worthless"] * (i % 2)) for i in range(80)}
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, toxic int")
    machine = T.fit(documents(spark, texts), labels, held_out=None)
    new = documents(spark, {1: "abc worthless dig", 2: "abc wor-thless dig", 3: " ".join(common[:50])})
    assert {r.doc_id: r.predicted for r in T.score(new, machine).collect()} == {1: 1, 2: 1, 3: 0}
