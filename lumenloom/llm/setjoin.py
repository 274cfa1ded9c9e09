"""Exact Jaccard join of word n-gram sets, skipping along the relations between sets.

Index lists: the n-grams of a set have one order over all sets, rare ones
first, and a set stands in the lists of its first few alone. Within a list sets
of one size and place are a block; a block is skipped whole if the places show
that no other block of the list can hold a set similar enough.

Answers: each list has a centre, to which the others are compared on full sets.
Sets that stay in several components are not compared with each other again as
a whole: what a set differs in from its centre is an answer known already, and
two sets are as far apart as these differences are. So a list whose members are
not settled gives way to lists over the differences, which hold little, rare
ones first; and so on until all lists are settled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from lumenloom.llm.common import Scratch, materialize
from lumenloom.llm.graph import connected_components
from lumenloom.llm.minhash import _confirm, _ends, _same_id, _texts, component_rows, shingle_hashes

SHINGLE, PERCENT = 3, 90
#: N-grams are counted if their hash is a multiple of it; the others come last in the order of all.
SAMPLE = 4
#: Lists of so many whole sets are compared pair by pair once their centre has been.
SMALL = 32
#: Lists over differences with so many members and n-grams at most are compared in one task; larger ones give way to differences again.
MEMBERS, LOAD = 1024, 2_000_000
#: So often lists give way to differences; what is still unsettled then is compared pair by pair.
LEVELS = 8
_TABLE = "doc_id long, text_hash long, n_shingles long, digest binary, counted array<long>, more array<long>"


def prefix_length(n: int, percent: int) -> int:
    """Of so many n-grams of a set, whichever they are, at least one is in any set similar enough."""
    return n + (-percent * n) // 100 + 1


def set_table(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, set size, digest of the set, its counted n-grams and as many others as its prefix may need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, counted, more = [], [], [], []
            for text in batch.column(2):
                a = shingle_hashes(text.as_py(), k)
                chosen = a % np.uint64(SAMPLE) == 0
                own = a[chosen]
                n.append(len(a))
                digest.append(xxh3_128_digest(a.tobytes()) if len(a) else None)
                counted.append(own.view(np.int64))
                more.append(a[~chosen][: max(0, prefix_length(len(a), percent) - len(own))].view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(counted, longs), pa.array(more, longs)],
                names=["doc_id", "text_hash", "n_shingles", "digest", "counted", "more"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, _TABLE)


def _full_sets(docs: DataFrame, reps: DataFrame, ids: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """rep and shingles, its full set, for the reps in ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [shingle_hashes(x.as_py(), k).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rep", "shingles"])

    wanted = reps.join(ids, "rep", "left_semi").select("doc_id", "text_hash", "rep")
    # The ids grow with the corpus, so both sides are shuffled at any size.
    found = _texts(docs, id_col, text_col).join(wanted.hint("merge"), ["doc_id", "text_hash"])
    return found.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>")


def _first_places(ts: str, k: Column) -> Column:
    """Place and item of each of the first k items of an array; the others make no rows."""
    return F.posexplode(F.slice(ts, 1, F.greatest(k, F.lit(0)).cast("int")))


def _first_lists(reps: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """The index lists of whole sets: g (0), token, x, n, d (the size) and rest, how many n-grams of the set are left in its order, this one included.

    The order: counted n-grams by how many sets have them, then the others by
    their hash. Those of one set alone take places, but are in no list.
    """
    counted = F.transform("counted", lambda t: F.struct(F.lit(0).alias("late"), t.alias("token")))
    more = F.transform("more", lambda t, i: F.struct((i + 1).alias("late"), t.alias("token")))
    each = reps.select("rep", F.explode(F.concat(counted, more)).alias("t")).select("rep", "t.late", "t.token")
    often = tables.write(each.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    shared = each.join(often, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("late", "k", "token"))).alias("ts"))
    sized = shared.join(reps.select("rep", F.col("n_shingles").alias("n"), F.size("counted").alias("c")), "rep")
    sized = sized.withColumn("own", F.size(F.filter("ts", lambda t: t.late == 0)))
    most = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1
    # The table holds no more of the others than there are places left, so the first places are a prefix of ts.
    listed = sized.select(F.col("rep").alias("x"), "n", "c", "own", _first_places("ts", most - F.col("c") + F.col("own")).alias("i", "t"))
    pos = F.when(F.col("t.late") == 0, F.col("c") - F.col("own") + F.col("i")).otherwise(F.col("c") + F.col("t.late") - 1)
    return listed.select(F.lit(0).cast("long").alias("g"), F.col("t.token").alias("token"), "x", "n", F.col("n").alias("d"), (F.col("n") - pos).cast("long").alias("rest"))


def _lists(items: DataFrame, percent: int, tables: Scratch) -> DataFrame:
    """The index lists of differences within each group g, like those of whole sets.

    items: g, x, n (of the whole set), s (the difference from the group's
    centre) and d, its size. Two sets similar enough differ in n * (100 -
    percent) / percent places at most, so differences share all but that many.
    """
    each = items.select("g", "x", F.explode("s").alias("token"))
    often = tables.write(each.groupBy("g", "token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    shared = each.join(often, ["g", "token"]).groupBy("g", "x").agg(F.array_sort(F.collect_list(F.struct("k", "token"))).alias("ts"))
    sized = shared.join(items.select("g", "x", "n", "d"), ["g", "x"]).withColumn("own", F.size("ts"))
    most = F.expr(f"n * {100 - percent} div {percent}") + 1
    listed = sized.select("g", "x", "n", "d", "own", _first_places("ts", most - F.col("d") + F.col("own")).alias("i", "t"))
    pos = F.col("d") - F.col("own") + F.col("i")
    return listed.select("g", F.col("t.token").alias("token"), "x", "n", "d", (F.col("d") - pos).cast("long").alias("rest"))


def _fits(percent: int) -> Column:
    """Whether entries or blocks a and b of one list can belong to sets similar enough, by sizes and places."""
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    sizes = F.lit(percent) * F.greatest(a("n"), b("n")) <= F.lit(100) * F.least(a("n"), b("n"))
    return sizes & (F.lit(100 + percent) * (a("d") + b("d") - 2 * F.least(a("rest"), b("rest"))) <= F.lit(100 - percent) * (a("n") + b("n")))


def _size_class(n: str, percent: int) -> Column:
    """Sets similar enough are in one class or in neighbouring ones."""
    return F.floor(F.log(F.col(n)) / F.lit(max(math.log(100 / percent), 1e-3)) + F.lit(1e-9)).cast("int")


def _live(lists: DataFrame, labels: DataFrame | None, percent: int, tables: Scratch) -> DataFrame:
    """Entries, with label and the number m and the summed sizes of the entries left in their list, of blocks that another label can meet.

    A block is the entries of one list with the same sizes and place; whole
    blocks are skipped, so a list costs its blocks times the sizes near each.
    What is left and the numbers of each list are written before they are
    joined, so that AQE can split a long list.
    """
    if labels is None:
        known = lists.withColumn("label", F.col("x"))
    else:
        known = lists.join(labels.withColumnRenamed("id", "x"), "x", "left").withColumn("label", F.coalesce("component", "x")).drop("component")
    at = ["g", "token", "n", "d", "rest"]
    ends = [F.min("label").alias("lo"), F.max("label").alias("hi")]
    blocks = known.groupBy(*at).agg(*ends).withColumn("size_class", _size_class("n", percent))
    # Of the blocks of one size that with most left behind its place meets whatever any of them meets.
    best = blocks.groupBy("g", "token", "n", "d", "size_class").agg(F.max("rest").alias("rest"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    best = best.withColumn("size_class", F.explode(F.array(*[F.col("size_class") + i for i in (-1, 0, 1)])))
    one = (F.col("a.lo") == F.col("a.hi")) & (F.col("b.lo") == F.col("b.hi")) & (F.col("a.lo") == F.col("b.lo"))
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.size_class") == F.col("b.size_class"))
    met = blocks.alias("a").join(best.alias("b"), same & ~one & _fits(percent), "left_semi").select(*at)
    left = tables.write(known.join(met, at))
    held = tables.write(left.groupBy("g", "token").agg(F.count(F.lit(1)).alias("m"), F.sum("d").alias("load")))
    live = tables.write(left.join(held, ["g", "token"]))
    tables.drop(left, held)
    return live


def _to_centres(live: DataFrame, tables: Scratch) -> DataFrame:
    """g, x, n and c: each entry's set and the centre of its list, the member that shares most entries over all."""
    weight = live.groupBy("g", "x").agg(F.sum("m").alias("w"))
    weighed = live.join(weight, ["g", "x"])
    centre = weighed.groupBy("g", "token").agg(F.max(F.struct("w", (-F.col("x")).alias("less"))).alias("c")).select("g", "token", (-F.col("c.less")).alias("c"))
    centre = tables.write(centre)
    return live.join(centre, ["g", "token"]).select("g", "x", "n", "c").distinct()


def _pairs(live: DataFrame, percent: int) -> DataFrame:
    """g and pairs a, b of lists of a stated size: those with different labels that sizes and places allow."""
    same = (F.col("a.g") == F.col("b.g")) & (F.col("a.token") == F.col("b.token")) & (F.col("a.x") > F.col("b.x")) & (F.col("a.label") != F.col("b.label"))
    return live.alias("a").join(live.alias("b"), same & _fits(percent)).select("a.g", F.col("a.x").alias("a"), F.col("b.x").alias("b")).distinct()


def _links(few: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """Edges u, v that join up what is similar enough within each list, compared in one task by the differences from its centre.

    How many n-grams two differences share is a product of the list's incidence
    matrix with itself, in slices of columns; n-grams of one member share nothing.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, n, d = (pdf[c].to_numpy() for c in ("x", "n", "d"))
        number, place, count = np.unique(np.concatenate(pdf.s.to_list()), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(x)), d)
        keep = count[place] > 1
        column = (np.cumsum(count > 1) - 1)[place[keep]]
        row, both = row[keep], np.zeros((len(x), len(x)), np.float32)
        for first in range(0, int(column.max(initial=-1)) + 1, 4096):
            some = (column >= first) & (column < first + 4096)
            part = np.zeros((len(x), 4096), np.float32)
            part[row[some], column[some] - first] = 1
            both += part @ part.T
        apart = d[:, None] + d[None, :] - 2 * both.astype(np.int64)
        a, b = np.nonzero(np.triu((100 + percent) * apart <= (100 - percent) * (n[:, None] + n[None, :]), 1))
        root = np.arange(len(x))
        while len(a):  # each pair's ends take the least root of both, until none changes
            least = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, least)
            np.minimum.at(new, b, least)
            if (new == root).all():
                break
            root = new
        joined = np.flatnonzero(root != np.arange(len(x)))
        return pd.DataFrame({"u": x[joined], "v": x[root[joined]]})

    held = few.select("g", "token", "x").join(items.select("g", "x", "n", "d", "s"), ["g", "x"])
    return held.groupBy("g", "token").applyInPandas(run, "u long, v long").distinct()


def _apart(a: str, b: str) -> Column:
    return F.concat(F.array_except(a, b), F.array_except(b, a))


def _similar(d: Column, n: Column, percent: int) -> Column:
    """Whether sets of n n-grams together, d of which are in one of them alone, are similar enough."""
    return F.lit(100 + percent) * d <= F.lit(100 - percent) * n


def _differences(to: DataFrame, sets: DataFrame, on: list[str]) -> DataFrame:
    """g (the centre), x, n, s, d and the centre's size cn: how each set differs from its centre.

    to: g, x, n, c. sets: x, n and s under ``on`` (g or nothing).
    """
    centres = sets.select(*on, F.col("x").alias("c"), F.col("n").alias("cn"), F.col("s").alias("cs"))
    both = to.join(centres, [*on, "c"]).join(sets.select(*on, "x", "s"), [*on, "x"])
    found = both.select(F.col("c").alias("g"), "x", "n", _apart("s", "cs").alias("s"), "cn")
    # A set can have one centre in several groups.
    return (found.dropDuplicates(["g", "x"]) if on else found).withColumn("d", F.size("s").cast("long"))


def _relabelled(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (id, component) with each component named as the largest one that an edge leads to, if that is larger than itself.

    Of several components that hang together some may keep names of their own:
    then more is compared later than need be, and nothing less.
    """
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    of = lambda end: labels.select(F.col("id").alias(end), F.col("component").alias(f"{end}_label"))
    named = edges.join(of("u"), "u", "left").join(of("v"), "v", "left")
    ends = named.select(F.coalesce("u_label", "u").alias("a"), F.coalesce("v_label", "v").alias("b")).where("a <> b").distinct()
    both = ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = lambda end: sizes.select(F.col("component").alias(end), F.col("size").alias(f"{end}_size"))
    sized = both.join(size("a"), "a", "left").join(size("b"), "b", "left").select("a", "b", *[F.coalesce(f"{x}_size", F.lit(1)).alias(f"{x}_size") for x in ("a", "b")])
    to = sized.groupBy("a").agg(F.max(F.struct("b_size", "b")).alias("to"), F.max(F.struct("a_size", "a")).alias("own")).where("to > own")
    moved = to.select(F.col("a").alias("component"), F.col("to.b").alias("other"))
    # A component of one set has no row so far.
    known = labels.unionByName(moved.select(F.col("component").alias("id"), "component").join(labels.select("id"), "id", "left_anti"))
    return known.join(moved, "component", "left").select("id", F.coalesce("other", "component").alias("component"))


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs``.

    Two documents are linked if their sets of distinct word n-grams have at
    least ``percent`` % in common; component_id is the least id reachable by
    links. Words are runs without ASCII white space, with A-Z in lower case; a
    text of fewer than ``shingle`` words is one n-gram. No link between
    different sets is lost: lists are skipped only where sizes and places, or
    differences from a centre, exclude a link, or where both ends are in one
    component already. Equal sets are one class from the start.

    Null or blank texts have an empty set and are linked with nothing. Rows with
    a null id keep n_shingles, with component_id null. Rows that repeat an id are
    one vertex, whatever their texts. Other columns of ``docs`` are ignored. An
    empty table gives an empty result.
    """
    with Scratch(docs.sparkSession) as tables:
        return materialize(_joined(docs, id_col, text_col, percent, shingle, tables))


def _joined(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, tables: Scratch) -> DataFrame:
    write = tables.write
    table = write(set_table(docs, id_col, text_col, shingle, percent))
    some = table.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    classes = write(some.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("rep", F.monotonically_increasing_id()))
    one = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_shingles", "counted", "more")]
    reps = write(some.join(classes, ["digest", "doc_id"]).groupBy("rep").agg(*one, F.count(F.lit(1)).alias("rows")))
    repeated = not reps.where("rows > 1").isEmpty()
    lists = write(_first_lists(reps, percent, tables))
    live = _live(lists, None, percent, tables)
    sets = _full_sets(docs, reps, live.select(F.col("x").alias("rep")).distinct(), id_col, text_col, shingle)
    sets = write(sets.dropDuplicates(["rep"]) if repeated else sets)
    star = _to_centres(live, tables).where("x <> c").select(F.col("x").alias("a"), F.col("c").alias("b"))
    labels = connected_components(_confirm(star, sets, percent), write)
    tables.drop(lists)

    found = [labels.select(F.col("id").alias("u"), F.col("component").alias("v"))]
    left = _live(live.select("g", "token", "x", "n", "d", "rest"), labels, percent, tables)
    tables.drop(live)
    whole = sets.select(F.col("rep").alias("x"), F.size("shingles").cast("long").alias("n"), F.col("shingles").alias("s"))
    items, on = whole, []
    for level in range(LEVELS):
        last = level == LEVELS - 1
        in_task = F.lit(not last) & ((F.col("m") <= MEMBERS) & (F.col("load") <= LOAD) if on else F.lit(False))
        by_pair = ~in_task & (F.lit(last) | ((F.col("m") <= SMALL) if not on else F.lit(False)))
        pairs = _pairs(left.where(by_pair), percent)
        a = items.select(*on, F.col("x").alias("a"), F.col("n").alias("an"), F.col("s").alias("as"))
        b = items.select(*on, F.col("x").alias("b"), F.col("n").alias("bn"), F.col("s").alias("bs"))
        both = (pairs if on else pairs.drop("g")).join(a, [*on, "a"]).join(b, [*on, "b"])
        edges = both.where(_similar(F.size(_apart("as", "bs")), F.col("an") + F.col("bn"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
        if on and not last:
            edges = _links(left.where(in_task), items, percent)
        edges = write(edges)
        many = left.where(~in_task & ~by_pair)
        found.append(edges)
        if last or many.isEmpty():
            break
        to = _to_centres(many, tables)
        items = write(_differences(to if on else to.drop("g"), items, on))
        on = ["g"]
        close = items.where((F.col("g") != F.col("x")) & _similar(F.col("d"), F.col("n") + F.col("cn"), percent)).select(F.col("g").alias("u"), F.col("x").alias("v"))
        found.append(close)
        labels = write(_relabelled(labels, edges.unionByName(close)))
        lists = write(_lists(items, percent, tables))
        left = _live(lists, labels, percent, tables)
        tables.drop(lists)
        if left.isEmpty():
            break
    edges = reduce(DataFrame.unionByName, [*found, _same_id(some, classes, tables)])
    final = connected_components(edges, write).withColumnRenamed("id", "rep")
    return component_rows(table, classes, final, tables)
