"""The set join against brute force over all pairs, and against the SQL that is registered with it."""

import random

import duckdb
import pytest

from lumenloom.llm import oracles
from lumenloom.llm import queries as Q
from lumenloom.llm import setjoin as J
from tests.llm.helpers import awkward, documents, words


def shingles(text, k=3):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def brute(texts, percent=90):
    """doc_id -> (set sizes, component); the texts of one id are one vertex."""
    sets = {}
    for i, t in texts:
        sets.setdefault(i, []).append(shingles(t))
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and root(a) != root(b) and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                r, s = sorted((root(a), root(b)))
                comp[s] = r
    return sorted((i, len(x), root(i)) for i in sets for x in sets[i])


def run(spark, pairs, **how):
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in J.similar_sets(documents(spark, pairs), **how).collect())


def near(rng, n, size, edits, tag=""):
    """n texts of ``size`` words, each off a common one by up to ``edits`` words of its own."""
    base, out = words(rng, size), []
    for i in range(n):
        t = list(base)
        for k in rng.sample(range(size), rng.randint(0, edits)):
            t[k] = "".join(words(rng, 1)) + f"{tag}{i}"
        out.append(t)
    return out


@pytest.mark.parametrize("members", [4, 1024])
def test_groups_chains_and_passages_match_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(J, "SMALL", 3)
    monkeypatch.setattr(J, "MEMBERS", members)
    rng = random.Random(2)
    texts = [t for g in range(6) for t in near(rng, rng.randint(2, 25), rng.randint(20, 150), 6, str(g))]
    # A chain of copies of copies, whose ends are far from each other and from the middle.
    chain = words(rng, 120)
    for i in range(40):
        chain = list(chain)
        chain[rng.randrange(120)] = f"link{i}"
        texts.append(chain)
    # Families within one large group of near copies: their members are linked to each other and not to the rest.
    base = words(rng, 150)
    for f in range(8):
        family = list(base)
        for k in rng.sample(range(150), 9):
            family[k] = f"family{f}"
        for i in range(6):
            t = list(family)
            t[rng.randrange(150)] = f"own{f}{i}"
            texts.append(t)
    passage = words(rng, 60)
    texts += [passage + words(rng, rng.randint(1, 60)) for _ in range(40)]
    texts += [passage + [f"tail{i}"] for i in range(5)]
    rng.shuffle(texts)
    pairs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = brute(pairs)
    assert len({c for _, _, c in want}) > 40 and run(spark, pairs) == want


def test_the_last_level_is_exact_too(spark, monkeypatch):
    monkeypatch.setattr(J, "SMALL", 2)
    monkeypatch.setattr(J, "LEVELS", 1)
    rng = random.Random(6)
    pairs = [(i, " ".join(t)) for i, t in enumerate(near(rng, 50, 100, 5))]
    assert run(spark, pairs) == brute(pairs)


def exploded(plan):
    """Rows that the posexplodes of an executed plan made."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return exploded(plan.executedPlan())
    if "QueryStage" in plan.nodeName():
        return exploded(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if plan.nodeName() == "Generate" and "posexplode" in plan.toString().split("\n")[0] else 0
    return own + sum(exploded(plan.children().apply(i)) for i in range(plan.children().size()))


def test_only_first_places_become_rows(spark):
    rng = random.Random(8)
    base = words(rng, 80)
    # All differences hold the same 30 n-grams; one more is their own.
    ids = [(0, x, 100, [*range(30), 1000 + x]) for x in range(40)]
    with J.Scratch(spark) as tables:
        items = tables.write(spark.createDataFrame(ids, "g long, x long, n long, s array<long>").withColumn("d", J.F.size("s").cast("long")))
        reps = tables.write(
            J.set_table(documents(spark, [(i, " ".join([*base, f"own{i}"])) for i in range(40)]), "doc_id", "text", 3, 90).withColumn("rep", J.F.col("doc_id"))
        )
        counted = reps.select(J.F.size("counted")).first()[0]
        for lists, places in ((J._lists(items, 90, tables), 11), (J._first_lists(reps, 90, tables), 9)):
            rows = lists.collect()
            made = exploded(lists._jdf.queryExecution().executedPlan())
            assert made == len(rows) and 0 < len(rows) <= 40 * places
    assert counted > 9


@pytest.mark.parametrize("percent,k", [(75, 5)])
def test_other_thresholds_and_sizes(spark, percent, k):
    rng = random.Random(percent)
    pairs = [(i, " ".join(t)) for i, t in enumerate(near(rng, 30, 60, 9) + near(rng, 9, 7, 2))]
    ids = {i: shingles(t, k) for i, t in pairs}
    got = run(spark, pairs, percent=percent, shingle=k)
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                if 100 * len(ids[a] & ids[b]) >= percent * len(ids[a] | ids[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == [(i, len(ids[i]), comp[i]) for i in sorted(ids)]


def test_awkward_rows(spark):
    rng = random.Random(5)
    a, b = (" ".join(words(rng, 60)) for _ in range(2))
    more = [(21, a), (20, a), (21, b), (23, b), (21, b), (21, None), (24, ""), (24, None), (25, b.upper()), (26, "One two three"), (27, "one two THREE")]
    rows = J.similar_sets(documents(spark, [*awkward(), *more])).collect()
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id is not None)
    assert got == brute([p for p in [*awkward(), *more] if p[0] is not None])
    assert [(r.n_shingles, r.component_id) for r in rows if r.doc_id is None] == [(58, None)]


def test_empty_table(spark):
    out = J.similar_sets(documents(spark, []))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.collect() == []


def test_op12_against_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(oracles.OP12).fetchall())
    got = Q.op12_set_join(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
