import itertools
import random
import re
import zlib

import numpy as np

from lumenloom.llm import quality as Q
from lumenloom.llm import toxicity as T
from tests.llm.helpers import awkward, documents, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    ws, g = WORD.findall(text or ""), {}
    for i in range(len(ws) - 7):
        g.setdefault(tuple(ws[i : i + 8]), []).append(i)
    inside = {j for v in g.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(inside)


def corpus(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(400):
        ws = words(rng, rng.randint(25, 90))
        bad, poor = i % 5 == 0, i % 7 == 0
        if poor:
            ws = [w + rng.choice(["%%%", "###", "$$$"]) for w in ws]
        if bad:
            ws.insert(rng.randrange(len(ws)), rng.choice(["wretchzux", "klowpqst", "muggzyv"]))
        docs.append((i, " ".join(ws)))
        labels.append((i, int(not poor), int(bad)))
    return documents(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), labels


def test_counts_match_brute_force(spark):
    pairs = [*awkward(), (30, "a b c d e f g h " * 5), (31, "x\ny\nx\n\n \nx\r\nx\r"), (32, "# é* \x0b|\u00a0|")]
    got = Q.judge(documents(spark, pairs), None).collect()
    for r in got:
        assert (int(r.n_words), r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (not r.base_failed)
    assert len(got) == len(pairs) and Q.judge(documents(spark, []), None).collect() == []


def test_quality_model_tells_held_back_texts(spark):
    docs, labels, truth = corpus(spark)
    model = Q.fit(docs.where("doc_id % 2 = 0"), labels)
    got = {r.doc_id: r.kept for r in Q.judge(docs.where("doc_id % 2 = 1"), model).collect()}
    good = [got[i] == bool(q) for i, q, _ in truth if i % 2]
    assert np.mean(good) > 0.95
    assert Q.fit(docs, labels.where("quality = 1")) is None
    assert len(Q.judge(documents(spark, awkward()), model).collect()) == len(awkward())


def brute_kernel(a, b):
    def subsequences(w):
        c, out = T.codes([w], len(w))[:, 0], {}
        for i, j, k in itertools.combinations(range(len(w)), 3):
            if c[i] and c[j] and c[k]:
                u = (c[i], c[j], c[k])
                out[u] = out.get(u, 0) + T.DECAY ** (k - i + 1)
        return out

    x, y = subsequences(a), subsequences(b)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def test_kernel_matches_all_subsequences():
    ws = ["idiot", "i-d-i.ot", "aaaa", "banana", "éüß1x", "moronic"]
    assert np.allclose(T.kernel(ws, T.Columns.of(ws)), [[brute_kernel(a, b) for b in ws] for a in ws], atol=1e-5)
    assert np.allclose(T.kernel(["ab", "", "1-2"], T.Columns.of(ws)), 0)


def test_toxic_words_are_found_with_gaps_and_in_held_out_rows(spark):
    docs, labels, truth = corpus(spark)
    machine = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, machine).collect()}
    held = [i for i, _, _ in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    right = [got[i].predicted == t for i, _, t in truth if i in set(held)]
    assert len(held) > 60 and np.mean(right) > 0.97
    gaps = documents(spark, [(1, "so klow-pqst here"), (2, "a k l o w p q s t b"), (3, "muggz*yv"), (4, "fine words here"), (5, None), (6, ""), (7, "you klow pqst there"), (8, "you mug gzy v there")])
    flags = {r.doc_id: r.predicted for r in T.score(gaps, machine).collect()}
    assert flags == {1: 1, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1, 8: 1}


def test_windows_over_neighbouring_words():
    assert T.pieces("Stu pid of worth a b c") == {"stu", "pid", "of", "worth", "a", "b", "c", "stupid", "pidof", "stupidof", "ab", "bc", "abc"}
    assert T.pieces("d i e") == {"d", "i", "e", "di", "ie", "die"} and T.pieces(None) == T.pieces(" ") == set() and T.pieces("one") == {"one"}


def test_letters_of_other_alphabets_differ():
    for word in ("\u0430\u0431\u0432\u0433\u0434\u0435\u0436\u0437\u0438\u0439\u043a\u043b\u043c\u043d\u043e\u043f\u0440\u0441\u0442\u0443\u0444\u0445\u0446\u0447\u0448\u0449\u044a\u044b\u044c\u044d\u044e\u044f", "\u03b1\u03b2\u03b3\u03b4\u03b5\u03b6\u03b7\u03b8\u03b9\u03ba\u03bb\u03bc\u03bd\u03be\u03bf\u03c0\u03c1\u03c3\u03c4\u03c5\u03c6\u03c7\u03c8\u03c9", "abcxyz\u00e9\u00e8\u00fc\u00df"):
        assert len(set(T.codes([word], len(word))[:, 0])) == len(word)


def test_columns_with_names_of_results(spark):
    rows = spark.createDataFrame([(1, "some text", 0.5, 9, "q", "k")], "doc_id long, text string, score double, predicted int, quality_score string, kept string")
    scored = T.score(rows, T.Machine(np.zeros((T._CODES**3, 1), np.float32), 0.0, 1.0, 0.0))
    assert scored.first().asDict() == {"doc_id": 1, "text": "some text", "quality_score": "q", "kept": "k", "score": scored.first().score, "predicted": 1}
    judged = Q.judge(rows, None).first()
    assert (judged.score, judged.predicted, judged.quality_score, judged.kept) == (0.5, 9, None, False)


def test_models_do_not_depend_on_the_order_of_an_ids_texts(spark):
    docs, labels, _ = corpus(spark)
    twice = docs.unionByName(docs.where("doc_id % 3 = 0").withColumn("text", docs.text.substr(1, 50)))
    one, two = (T.fit(d, labels).table for d in (twice, twice.repartition(7, "text")))
    assert (one == two).all()
    assert (Q.fit(twice, labels).weights == Q.fit(twice.repartition(7, "text"), labels).weights).all()


def test_labels_of_the_held_out_fold_are_never_used(spark):
    docs, labels, _ = corpus(spark)
    other = labels.selectExpr("doc_id", "quality", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 4) = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    assert (T.fit(docs, labels).table == T.fit(docs, other).table).all()


def test_awkward_texts_have_a_score(spark):
    machine = T.Machine(np.zeros((T._CODES**3, 1), np.float32), 0.0, 1.0, 0.0)
    got = T.score(documents(spark, awkward()), machine).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert T.score(empty, T.fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []


def test_clean_texts_with_different_words_have_different_scores():
    """Also far below the threshold a score follows the words; texts without any have that of no words."""
    rng = random.Random(3)
    bags = [{"".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(12)} | ({"wretchzux"} if i % 3 == 0 else set()) for i in range(90)]
    machine = T.train(bags, np.array([int(i % 3 == 0) for i in range(90)]), np.array([i % 4 == 0 for i in range(90)]), negatives=200, landmarks=16)
    scorer = T._Scorer(machine)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(4)) for _ in range(40)]
    values = scorer.values(texts)
    assert np.allclose(values, [machine.worst(sorted(T.units(t))) for t in texts])
    low = [v for v in values if v < T.FLOOR]
    assert len(set(values)) > 30 and len(set(low)) > 0.8 * len(low) > 3
    assert scorer.values([None, "", "a b", "1 2"]) == [machine.bias] * 4
    assert np.isclose(scorer("wretchzux"), machine.worst(["wretchzux"])) and scorer("wretchzux") > max(values)
