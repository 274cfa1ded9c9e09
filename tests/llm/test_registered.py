"""The registered queries, as they are, against brute force over small written tables."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lumenloom.llm import pii
from lumenloom.llm import queries as Q
from tests.llm.helpers import awkward, words
from tests.llm.test_models import brute_counts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    docs = {i: t for i, t in awkward() if i is not None}
    docs |= {i: " ".join(words(rng, rng.randint(3, 60)) + (["wretchzux"] if i % 4 == 0 else [])) for i in range(20, 220)}
    docs |= {300: "a b c d e f g h " * 6, 301: "na\u00efve \U0001f600 mail a.b@c.de", 302: "x\ny\nx"}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(2).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in range(20, 220)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{base}/labels.parquet")
    pages = [(i, "http://h", rng.choice(["a", "b" * 50, None, "", f"own {i}"])) for i in range(40)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2).write.parquet(f"{base}/pages.parquet")
    return base, docs, pages


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op2_on_the_given_vectors(spark, sf):
    rows = {}
    for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect():
        v = np.array(r.embedding if r.embedding is not None else [], float)
        if len(v) and np.isfinite(v).all() and v.any():
            rows[r.vec_id] = v
    got = {}
    for r in Q.op2_vp_trees(spark, f"/root/testdata/{sf}").collect():
        assert math.isclose(r.score, float(rows[r.query_id] @ rows[r.vec_id]), rel_tol=1e-12, abs_tol=1e-12)
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    ids = np.array(list(rows))
    x = np.stack(list(rows.values()))
    for i in (i for i in rows if i % 20 == 0):
        s = x @ rows[i]
        best = sorted((-v, j) for v, j in zip(s[ids != i], ids[ids != i]))[:20]
        assert sorted(got[i]) == list(range(1, len(best) + 1))
        assert np.allclose([got[i][k][1] for k in sorted(got[i])], [-v for v, _ in best])
    assert set(got) == {i for i in rows if i % 20 == 0}


def test_op3(spark, folder):
    base, docs, _ = folder
    got = Q.op3_quality(spark, base).collect()
    assert {r.doc_id for r in got} == set(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and not (r.kept and r.base_failed)


def test_op4_and_op7(spark, folder, reference):
    base, docs, _ = folder
    got, at = {r.doc_id: r for r in Q.op4_token_files(spark, base).collect()}, 0
    true = {i: reference.encode_ordinary(docs[i] or "") + [0] for i in docs}
    for i in sorted(docs):
        raw = np.array(true[i], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(true[i]), zlib.crc32(raw))
        at += len(true[i])
    pieces = {}
    for r in Q.op7_packing(spark, base).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    for i, ids in true.items():
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [(r.piece, r.start, r.length) for r in mine] == [(n, s, min(8192, len(ids) - s)) for n, s in enumerate(range(0, len(ids), 8192))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in mine)


def test_op5(spark, folder):
    base, docs, _ = folder
    f = pii.Feistel(Q.DEMO_KEY)
    for r in Q.op5_pii(spark, base).collect():
        text, spans = pii.replace(docs[r.doc_id], f) if docs[r.doc_id] is not None else (None, [])
        assert (r.text, r.n_pii) == (text, len(spans))


def test_op6(spark, folder):
    base, docs, _ = folder
    got = {r.doc_id: r for r in Q.op6_toxicity(spark, base).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in range(20, 220) if got[i].held_out]) > 0.95


def test_op8(spark, folder, reference):
    base, docs, _ = folder
    for r in Q.op8_byte_bpe(spark, base).collect():
        text = docs[r.doc_id] or ""
        ids = reference.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_op9(spark, folder):
    base, _, pages = folder
    newest = {}
    for i, _, h in pages:
        newest[h or ""] = max(newest.get(h or "", i), i)
    got = {r.page_id: r for r in Q.op9_warc(spark, base).collect()}
    for i, _, h in pages:
        r, raw, to = got[i], (h or "").encode(), newest[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if to == i else ("revisit", to))
