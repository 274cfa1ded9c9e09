import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lumenloom.llm import bitpack as B
from lumenloom.llm import tokens as K
from tests.llm.helpers import awkward, documents

HOW = (K.ranks_tokenizer, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
LIB = (K.library_tokenizer, P.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_give_the_ids_of_the_whole_text(reference):
    rng = random.Random(2)
    parts = list("abcXYZ 's'll  \n\t.,;123é日本😀  \u0085\x1c​　Ω'") + ["ion", "the", " ", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "  ", "a ", " a", "<|endoftext| x", "a" * 3000]
    by_rank, by_file = K.PieceEncoder(HOW[0](*HOW[1:])), K.PieceEncoder(LIB[0](*LIB[1:]))
    for t, a, b in zip(texts, by_rank(texts), by_file(texts)):
        assert np.frombuffer(a, "<u4").tolist() == reference.encode_ordinary(t) == np.frombuffer(b, "<u4").tolist()


def test_encode_decode_and_offsets(spark, reference):
    pairs = [*awkward(), (20, "naïve 日本語 😀 end")]
    docs = documents(spark, pairs)
    out = K.decode(K.encode(docs, *HOW, offsets=True), *HOW).collect()
    assert len(out) == len(pairs)
    table = K.token_bytes(HOW[0](*HOW[1:]).get_vocab())
    for r in out:
        text = r.text or ""
        assert r.token_ids == reference.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert (r.n_words, r.kept, r.score) == ("x", "y", "z")
        if len(text) < 1000:
            at, expected = 0, []
            for t in r.token_ids:
                expected.append(len(text.encode()[:at].decode(errors="ignore")))
                at += len(table[t])
            assert r.token_starts == expected
            assert "".join(K.decode_text(table[t] for t in r.token_ids)) == text


@pytest.mark.parametrize("vocabulary", [2, 8, 257, 50_257, 100_000])
def test_packed_files_round_trip_and_random_access(tmp_path, vocabulary):
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, vocabulary, n).astype(np.uint32) for n in (0, 5, 2500, 1, 999)]
    w = B.PackedWriter(f"file:{tmp_path}", "x", vocabulary, block_ids=1000)
    for i, d in enumerate(docs):
        w.add(None if i == 2 else i, d)
    w.close()
    with B.PackedReader(w.path) as r:
        got = [x for part in r.documents(600) for x in zip(*part)]
        assert [g[0] for g in got] == [0, 1, None, 3, 4] and all((g[2] == d).all() for g, d in zip(got, docs))
        assert (r.ids(700, 2300) == np.concatenate(docs)[700:2300]).all() and len(r.ids(5, 5)) == 0
    with pytest.raises(ValueError):
        B.PackedWriter(f"file:{tmp_path}", "y", vocabulary).add(1, np.array([vocabulary], np.uint32))


def test_token_files_in_order_of_ids(spark, reference):
    pairs = awkward()
    random.Random(4).shuffle(pairs)
    m = K.write_token_files(documents(spark, pairs), *LIB, vocabulary=50_257, files=3)
    rows = sorted(K.read_token_files(m).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([i for i, _ in pairs], key=lambda i: -1 if i is None else i)
    texts, at = {}, 0
    for i, t in pairs:
        texts.setdefault(i, reference.encode_ordinary(t or "") + [0])
    for r in rows:
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == texts[r.doc_id]
        at += r.n_tokens
    assert K.read_token_files(K.write_token_files(documents(spark, []), *LIB, vocabulary=50_257)).count() == 0


@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_files_lie_where_spark_looks_for_them(spark, tmp_path, scheme):
    """With and without a scheme, the files of tasks are in the folder as Spark's own file system has it."""
    from lumenloom.llm import common, files, warc

    docs = documents(spark, [(1, "a b c"), (2, None)])
    m = K.write_token_files(docs, *LIB, vocabulary=50_257, files=2, folder=f"{scheme}{tmp_path}/t")
    assert all(r.path.startswith("file:/") for r in m.collect()) and K.read_token_files(m).count() == 2
    pages = spark.createDataFrame([(1, "http://a", "x")], "page_id long, url string, html string")
    a = warc.write_archives(pages, folder=f"{scheme}{tmp_path}/w")
    assert all(r.path.startswith("file:/") for r in a.collect()) and warc.read_archives(a).count() == 1
    assert common.shared_dir(spark).startswith("file:/")
    with pytest.raises(ValueError):
        files.open_random(f"{tmp_path}/t")


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from lumenloom.llm import common

    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        unset = N(sparkContext=N(master=master, getConf=lambda: N(get=lambda k: None)), conf=N(get=lambda k, d: None))
        with pytest.raises(ValueError):
            common.shared_dir(unset)


def test_the_number_of_files_goes_by_the_source(spark, monkeypatch):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('some words ', 100) AS text")
    known, unknown = K.source_bytes(docs.select("text")), K.source_bytes(documents(spark, [(1, "x" * 500), (2, None)]).select("text"))
    assert known > 0 and unknown in (500, *range(1, 10**6))
    monkeypatch.setattr(K, "FILE_BYTES", max(1, known // 9))
    assert K.write_token_files(docs, *LIB, vocabulary=50_257).count() >= 9


def test_columns_with_names_of_token_results(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z")], "doc_id long, text string, token_ids string, token_starts string, decoded string")
    out = K.decode(K.encode(docs, *HOW, offsets=True), *HOW).first()
    assert (bytes(out.decoded), out.token_starts, len(out.token_ids)) == (b"a b", [0, 1], 2)
    assert K.encode(docs, *HOW).first().decoded == "z"


def test_strings_of_special_tokens_are_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    texts = [f"a{x}b {x} c" for x in special] + [special[0], f" {special[0][:-1]} ", f"{special[0]}{special[0]}", f"caf\u00e9 {special[0]}\n\n  end", "plain text"]
    encoder = K.PieceEncoder(K.library_tokenizer(P.path("byte_bpe_50k.json")))
    for some in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder(some)] == [own.encode(t, add_special_tokens=False).ids for t in some]
    assert len(own.encode(special[0], add_special_tokens=False).ids) == 1
