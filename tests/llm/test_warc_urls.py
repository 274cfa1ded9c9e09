import base64
import hashlib
import random

import numpy as np
import pytest

from lumenloom.llm import urlfilter as U
from lumenloom.llm import warc as A
from lumenloom.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, html string, host string, hash string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "x") for r in rows], SCHEMA)


ROWS = [
    (1, "http://a.com/x", "same"), (2, "http://b.com", "same"), (3, None, "same"), (4, "http://c.com/é\n", None), (5, "u", ""),
    (6, "u", "own ünicode"), (7, "u", "x" * 300_000), (None, "n", "same"), (None, "n", "alone"), (-8, "neg", "neg"), (9, "neg", "neg"), (6, "u", "own ünicode"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_round_trip(spark, least):
    got = A.read_archives(A.write_archives(pages(spark, ROWS), least_bytes=least)).collect()
    newest = {}
    for i, _, h in ROWS:
        if i is not None and len((h or "").encode()) >= least:
            newest[h or ""] = max(newest.get(h or "", i), i)
    expected = []
    for i, _, h in ROWS:
        p = (h or "").encode()
        to = newest.get(h or "")
        again = to is not None and to != i
        expected.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", to if again else None, None if again else p))
    order = lambda x: repr(x)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got], key=order) == sorted(expected, key=order)


def test_archives_of_an_empty_table(spark):
    assert A.read_archives(A.write_archives(pages(spark, []))).collect() == []


def test_frames_share_the_dictionary_in_front(spark):
    rng = random.Random(0)
    rows = [(i, f"http://h{i}.com", "<html>" + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(300))) for i in range(300)]
    manifest = A.write_archives(pages(spark, rows)).collect()
    with open(manifest[0].path.removeprefix("file:"), "rb") as f:
        assert int.from_bytes(f.read(4), "little") == A.DICT_FRAME and int.from_bytes(f.read(4), "little") > 1000
    assert sum(m.n_records for m in manifest) == 300


URLS = [
    None, "", "no scheme", "http://", "http://X.COM/", "https://a.example.com/en/1", "https://www.example.com/en/1", "http://example.com/en", "http://badexample.com/en/1",
    "ftp://h.net/es/?q", "http://h.net/fr/x#y", "http://h.net/de/", "http://a.b.c.www.example.com/en/?", "http://net/es/", "http://com?x/en/", "a://b://c.com/en/", "http://user@h.net:80/es/", "http://h.NET/es/\nx",
]


def judged(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(h + p), h + p, a) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, "allow")))


def test_urls_match_the_rules_read_one_by_one(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS * 2)]
    got = U.judge_urls(pages(spark, rows), URL_RULES).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: judged(u) for i, u, _ in rows}
    assert got[0].hash == "x"
    assert U.judge_urls(pages(spark, []), URL_RULES).collect() == []
    assert {r.verdict for r in U.judge_urls(pages(spark, rows), []).collect()} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, (20_000, 2))
    table = spark.createDataFrame([tuple(map(int, k)) for k in keys], "h1 long, h2 long")
    c = U.build_cascade(spark.createDataFrame([tuple(map(int, k)) for k in keys[:700]], "h1 long, h2 long"), table)
    assert c.has(keys[:, 0].copy(), keys[:, 1].copy()).tolist() == [True] * 700 + [False] * 19_300 and len(c.levels) > 2


def test_a_filter_of_more_words_than_come_at_a_time(spark, monkeypatch):
    """Gathered in many parts, and no larger than the list asks for."""
    monkeypatch.setattr(U, "PART_WORDS", 16)
    rng = np.random.default_rng(2)
    keys = rng.integers(-(1 << 63), (1 << 63) - 1, (30_000, 2))
    table = spark.createDataFrame([tuple(map(int, k)) for k in keys], "h1 long, h2 long")
    c = U.build_cascade(spark.createDataFrame([tuple(map(int, k)) for k in keys[:500]], "h1 long, h2 long"), table)
    assert c.has(keys[:, 0].copy(), keys[:, 1].copy()).tolist() == [True] * 500 + [False] * 29_500
    assert len(c.levels[0].words) > 16 and c.n_bytes < 500 * 3 and U.build_cascade(table.limit(0), table).levels == []


def test_columns_with_names_of_the_operators_own(spark):
    rows = [(1, "http://h.net/es/", "k", "m", "b", "r", "h", "v")]
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, keys string, mark string, best string, row string, host string, verdict string"), URL_RULES).collect()
    assert [r.asDict() for r in got] == [{"page_id": 1, "url": "http://h.net/es/", "keys": "k", "mark": "m", "best": "b", "row": "r", "host": "h.net", "path": "/es/", "rule": "net/es/", "verdict": "block"}]
