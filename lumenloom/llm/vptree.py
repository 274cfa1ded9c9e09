"""Nearest neighbours by inner product with vantage-point trees.

Vectors are scaled by the largest norm and lifted to the unit sphere by one more
coordinate, so that a larger inner product is a smaller distance. A coarse tree,
fitted on a bounded sample, deals all rows to regions; a region of more rows than
a shard has a tree of its own, fitted on a sample of its rows, whose leaves are
its shards, and each shard has a tree over all of its rows. A query first
searches one shard, which bounds its k-th distance, and then every shard that the
triangle inequality cannot exclude in the trees of either level. The bound is
divided by ``relax``: 1 excludes only what is proved to be farther, so the search
is exact, as registered; larger values exclude more, and lose true neighbours where
lengths spread, as most lifted vectors then lie close to the pole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.llm.common import Scratch, materialize

#: Rows of a shard and of a leaf, regions at most, rows of the sample, queries of a block.
SHARD, LEAF, REGIONS, SAMPLE, BLOCK = 8192, 512, 1024, 20_000, 1024
#: Rows of a region that its own tree is fitted on, and those of its rows or queries that one task places.
PLACE, PLACED = 4096, 50_000
RELAX = 1.0
_SLACK = 1e-6


@dataclass
class Node:
    vantage: np.ndarray | None = None
    inside: Node | None = None
    outside: Node | None = None
    #: Least and greatest distance to the vantage point in either part.
    near: tuple[float, float] = (0.0, 0.0)
    far: tuple[float, float] = (0.0, 0.0)
    rows: np.ndarray | None = None
    number: int = -1


def build(x: np.ndarray, leaf: int, rows: np.ndarray | None = None, pick: np.random.Generator | None = None) -> Node:
    """A tree over unit vectors; rows that are all equally far from their vantage point stay one leaf."""
    rows = np.arange(len(x)) if rows is None else rows
    pick = pick or np.random.default_rng(11)
    if len(rows) > leaf:
        v = x[rows[pick.integers(len(rows))]]
        d = np.linalg.norm(x[rows] - v, axis=1)
        mid = np.median(d)
        within = d <= mid if d.max() > mid else d < mid
        if within.any() and not within.all():
            return Node(
                v,
                build(x, leaf, rows[within], pick),
                build(x, leaf, rows[~within], pick),
                (d[within].min(), d[within].max()),
                (d[~within].min(), d[~within].max()),
            )
    return Node(rows=rows)


def number_leaves(node: Node, at: int = 0) -> int:
    if node.vantage is None:
        node.number = at
        return at + 1
    return number_leaves(node.outside, number_leaves(node.inside, at))


def excluded(d: np.ndarray, span: tuple[float, float], bound: np.ndarray, relax: float) -> np.ndarray:
    """May a part with these distances to the vantage point be left out by a query at distance d?"""
    gap = np.maximum(span[0] - d, d - span[1])
    return gap > bound / relax + _SLACK


def assign(node: Node, x: np.ndarray) -> np.ndarray:
    """The number of the leaf of each row, with the same rule that split the sample."""
    out = np.zeros(len(x), np.int64)

    def go(n: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if n.vantage is None:
            out[rows] = n.number
            return
        d = np.linalg.norm(x[rows] - n.vantage, axis=1)
        closer = d <= (n.near[1] + n.far[0]) / 2
        go(n.inside, rows[closer])
        go(n.outside, rows[~closer])

    go(node, np.arange(len(x)))
    return out


def regions_of(node: Node, q: np.ndarray, bound: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query's row and the number of a leaf that its bound does not exclude.

    Here a part spans everything on its side of the split, as rows outside of
    the sample may lie anywhere there.
    """
    found_q, found_n = [], []

    def go(n: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if n.vantage is None:
            found_q.append(rows)
            found_n.append(np.full(len(rows), n.number))
            return
        d = np.linalg.norm(q[rows] - n.vantage, axis=1)
        cut = (n.near[1] + n.far[0]) / 2
        go(n.inside, rows[~excluded(d, (0.0, cut), bound[rows], relax)])
        go(n.outside, rows[~excluded(d, (cut, 2.0), bound[rows], relax)])

    go(node, np.arange(len(q)))
    return (np.concatenate(found_q), np.concatenate(found_n)) if found_q else (np.empty(0, np.int64),) * 2


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    y = x / largest
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]])


def aim(q: np.ndarray) -> np.ndarray:
    return np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(q), 1))])


def search(
    x: np.ndarray, ids: np.ndarray, alike: np.ndarray, q: np.ndarray, own: np.ndarray, has_own: np.ndarray, k: int, floor: np.ndarray, largest: float, relax: float
) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows for each query, ties to smaller ids; the score is -inf where there are fewer.

    alike: a number that equal rows share, whose scores are computed once, so
    that they tie to the last bit. own: an id that is no candidate, where has_own
    is set. floor: a score that the query's k-th neighbour has at least, as known before.
    """
    tree = build(lift(x, largest), LEAF)
    aimed, length = aim(q), np.linalg.norm(q, axis=1) * largest
    best = np.full((len(q), k), -np.inf)
    best_ids = np.full((len(q), k), np.iinfo(np.int64).max)

    def bound(rows: np.ndarray) -> np.ndarray:
        s = np.maximum(best[rows, -1], floor[rows])
        return np.where(np.isfinite(s), np.sqrt(np.maximum(0, 2 - 2 * s / length[rows])), np.inf)

    def go(n: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if n.vantage is None:
            _, one, back = np.unique(alike[n.rows], return_index=True, return_inverse=True)
            score = (q[rows] @ x[n.rows[one]].T)[:, back]
            score[has_own[rows][:, None] & (own[rows][:, None] == ids[n.rows][None, :])] = -np.inf
            enough = score >= np.maximum(best[rows, -1], floor[rows] - 1e-9 * np.abs(floor[rows]))[:, None]
            some, cols = np.flatnonzero(enough.any(1)), np.flatnonzero(enough.any(0))
            if not len(some):
                return
            rows, score = rows[some], score[np.ix_(some, cols)]
            both = np.hstack([best[rows], score])
            both_ids = np.hstack([best_ids[rows], np.broadcast_to(ids[n.rows[cols]], score.shape)])
            order = np.lexsort((both_ids, -both), axis=1)[:, :k]
            best[rows], best_ids[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(both_ids, order, 1)
            return
        d = np.linalg.norm(aimed[rows] - n.vantage, axis=1)
        closer = d <= n.near[1]
        for first in (True, False):
            for part, span, here in ((n.inside, n.near, closer), (n.outside, n.far, ~closer)):
                turn = here if first else ~here
                some, at = rows[turn], d[turn]
                go(part, some[~excluded(at, span, bound(some), relax)])

    go(tree, np.arange(len(q)))
    return best_ids, best


def usable(v: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda e: e != 0), F.lit(False))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _usual_length(good: DataFrame) -> DataFrame:
    """The rows whose vectors have the most frequent length, the larger one of equally frequent ones."""
    sizes = good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    best = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return good.where(F.size("v") == best.n) if best else good


class _Index:
    """Rows placed in regions and shards, and the trees that tell which of these a query needs."""

    def __init__(self, good: DataFrame, largest: float, total: int, shard_rows: int, sample_rows: int, regions: int, tables: Scratch) -> None:
        spark = good.sparkSession
        few = good.orderBy(F.xxhash64("id"), "id").limit(sample_rows) if total > sample_rows else good
        sample = lift(_stack(few.toPandas().sort_values("id").v), largest)
        tree = build(sample, max(len(sample) // regions, int(len(sample) * shard_rows / total), 8))
        self.n_regions, self.largest, self.tables = number_leaves(tree), largest, tables
        self.coarse = spark.sparkContext.broadcast(tree)  # ``regions`` vantage points at most
        coarse = self.coarse

        @F.pandas_udf("long")
        def region(x: pd.Series) -> pd.Series:
            return pd.Series(assign(coarse.value, lift(_stack(x), largest)) if len(x) else [], dtype="int64")

        placed = tables.write(good.withColumn("region", region("v")))
        # Counts per region: one small row for each.
        self.n = np.zeros(self.n_regions, np.int64)
        for r in placed.groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect():
            self.n[r.region] = r.n
        self.shard_rows, self.large = shard_rows, np.flatnonzero(self.n > shard_rows)
        self.trees = None
        if len(self.large):
            own = placed.where(self._is_large())
            share = F.pmod(F.xxhash64("id", F.lit(3)), self._rows_of()) < PLACE
            self.trees = tables.write(own.where(share).groupBy("region").applyInPandas(self._fit(), "region long, tree binary"))
            split = self._place(own, lambda x: lift(x, largest), None)
            self.rows = tables.write(placed.where(~self._is_large()).withColumn("sub", F.lit(0).cast("long")).unionByName(split))
            tables.drop(placed)
        else:
            self.rows = placed.withColumn("sub", F.lit(0).cast("long"))
        self.sizes = self.rows.groupBy("region", "sub").agg(F.count(F.lit(1)).alias("rows"))

    def _is_large(self) -> Column:
        return F.col("region").isin(self.large.tolist())

    def _rows_of(self) -> Column:
        """The rows of a row's region, one at least."""
        return F.element_at(F.array(*[F.lit(max(1, int(x))) for x in self.n]), (F.col("region") + 1).cast("int"))

    def _fit(self):
        n, shard_rows, largest = self.n, self.shard_rows, self.largest

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            region = int(pdf.region.iloc[0])
            x = lift(_stack(pdf.sort_values("id").v), largest)
            tree = build(x, max(8, int(len(x) * shard_rows / n[region])))
            number_leaves(tree)
            return pd.DataFrame({"region": [region], "tree": [pickle.dumps(tree)]})

        return run

    def _place(self, df: DataFrame, as_unit, relax: float | None) -> DataFrame:
        """df with sub, for rows of large regions: the leaf of each, or with ``relax`` a row for each leaf within ``bound``.

        A region's rows are dealt over tasks of some PLACED rows each, every one with the region's tree.
        """
        slices = F.ceil(self._rows_of() / PLACED).cast("long")
        dealt = df.withColumn("slice", F.pmod(F.xxhash64("id", F.lit(7)), slices))
        copies = self.trees.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))

        def run(key: tuple, pdf: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf) or not len(tree):
                return pdf.assign(sub=pd.Series([], dtype="int64"))[:0]
            node, x = pickle.loads(tree.tree.iloc[0]), as_unit(_stack(pdf.v))
            if relax is None:
                return pdf.assign(sub=assign(node, x))
            at, number = regions_of(node, x, pdf.bound.to_numpy(float), relax)
            return pdf.iloc[at].assign(sub=number)

        fields = T.StructType([*dealt.schema.fields, T.StructField("sub", T.LongType())])
        return dealt.groupBy("region", "slice").cogroup(copies.groupBy("region", "slice")).applyInPandas(run, fields).drop("slice")

    def _spread(self, df: DataFrame, relax: float | None) -> DataFrame:
        """df, with region, and sub from its region's own tree, if it has one."""
        whole = df.withColumn("sub", F.lit(0).cast("long"))
        if self.trees is None:
            return whole
        df = self.tables.write(df)
        whole = df.where(~self._is_large()).withColumn("sub", F.lit(0).cast("long"))
        return whole.unionByName(self._place(df.where(self._is_large()), aim, relax))

    def home(self, queries: DataFrame) -> DataFrame:
        """Queries with the one shard in which they would lie."""
        coarse = self.coarse

        @F.pandas_udf("long")
        def region(x: pd.Series) -> pd.Series:
            return pd.Series(assign(coarse.value, aim(_stack(x))) if len(x) else [], dtype="int64")

        return self._spread(queries.withColumn("region", region("v")), None)

    def near(self, queries: DataFrame, relax: float) -> DataFrame:
        """A row for each query (id, own, has_own, v, floor) and each shard that its floor does not exclude."""
        coarse, n, largest = self.coarse, self.n, self.largest

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                q, floor = _stack(pdf.v), pdf.floor.to_numpy(float)
                scale = np.linalg.norm(q, axis=1) * largest
                bound = np.where(np.isfinite(floor), np.sqrt(np.maximum(0, 2 - 2 * floor / scale)), np.inf)
                at, number = regions_of(coarse.value, aim(q), bound, relax)
                some = n[number] > 0
                at, number = at[some], number[some]
                yield pdf.iloc[at].assign(region=number, bound=bound[at])

        sent = queries.select("id", "own", "has_own", "v", "floor").mapInPandas(route, "id long, own long, has_own boolean, v array<double>, floor double, region long, bound double")
        return self._spread(sent, relax).drop("bound")


def nearest(
    rows: DataFrame,
    k: int = 20,
    every: int = 20,
    relax: float = RELAX,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD,
    sample_rows: int = SAMPLE,
    regions: int = REGIONS,
) -> DataFrame:
    """query_id, rank, vec_id, score: up to k neighbours of the rows whose id is a multiple of ``every``.

    score is the inner product in double precision; candidates are all rows but
    those with the query's own id; ties go to smaller ids. Vectors that are
    null, empty, zero or hold a null or non-finite component, rows without an
    id, and vectors of another length than the most frequent one take no part.
    Rows that repeat an id and vector are one. A query with fewer candidates has
    them all if relax is 1. Other columns are ignored; an empty table gives no
    rows.

    How many shards a query is sent to goes by how far the data cluster: where
    the k-th neighbour is about as far as any row, as in high dimensions without
    clusters, nothing can be excluded and an exact search compares all pairs.
    """
    spark = rows.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    key = ["h1", "h2"]
    with Scratch(spark) as tables:
        good = _usual_length(tables.write(good.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})))
        # Of equal vectors, which tie with any query, only the k + 1 smallest ids can be in a list.
        nth = F.row_number().over(Window.partitionBy(*key).orderBy("id"))
        kept = tables.write(good.withColumn("nth", nth).where(F.col("nth") <= k + 1))
        total, top = kept.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).first()
        if not total:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        largest = float(np.sqrt(top)) * (1 + 1e-12)
        index = _Index(kept.select("id", "v", F.col("h1").alias("alike")), largest, total, shard_rows, sample_rows, regions, tables)
        # Equal vectors ask once, for k + 1 rows, of which each query leaves out its own; those of an id with several vectors ask for themselves.
        several = good.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id", F.lit(True).alias("has_own"))
        asking = good.where(F.pmod(F.col("id"), F.lit(every)) == 0).join(several, "id", "left").withColumn("has_own", F.coalesce("has_own", F.lit(False)))
        key.append("own")
        asking = tables.write(asking.select("id", "h1", "h2", F.when(F.col("has_own"), F.col("id")).otherwise(0).alias("own"), "has_own"))
        vectors = kept.where("nth = 1").select("h1", "h2", "v")
        wanted = tables.write(asking.select(*key, "has_own").distinct().join(vectors, ["h1", "h2"]).withColumn("q", F.monotonically_increasing_id()))
        queries = wanted.select(F.col("q").alias("id"), "own", "has_own", "v")
        first = index.home(queries).withColumn("floor", F.lit(float("-inf")))
        begun = _look(index, first, k + 1, relax, False).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        floors = tables.write(begun.where(F.col("n") > k).select(F.col("query_id").alias("id"), F.col("least").alias("floor")))
        known = queries.join(floors, "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        found = _look(index, index.near(known, relax), k + 1, relax, True)
        # A query vector has k + 1 rows from each of its shards at most.
        order = [F.desc("score"), "vec_id"]
        lists = found.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("nth") <= k + 1)
        lists = tables.write(lists.select(F.col("query_id").alias("q"), "vec_id", "score"))
        ids = tables.write(asking.join(wanted.drop("v"), [*key, "has_own"]).select(F.col("id").alias("query_id"), "q"))
        best = ids.join(lists, "q").where("vec_id <> query_id")
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
        return materialize(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _look(index: _Index, sent: DataFrame, k: int, relax: float, everywhere: bool) -> DataFrame:
    """sent: query number (id), own, v, floor, region, sub; the best rows of each shard for each query.

    A shard that is too large, as its rows are all alike to its tree, is dealt
    into parts; a query goes to one of them, or with ``everywhere`` to all.
    """
    sent = index.tables.write(sent.select("id", "own", "has_own", "v", "floor", "region", "sub"))
    shard = ["region", "sub"]
    asked = sent.groupBy(*shard).agg(F.count(F.lit(1)).alias("asked"))
    n_parts, n_blocks = F.ceil(F.col("rows") / (2 * index.shard_rows)).cast("long"), F.ceil(F.col("asked") / BLOCK).cast("long")
    sized = index.tables.write(asked.join(index.sizes, shard).select(*shard, n_parts.alias("parts"), n_blocks.alias("blocks")))
    up_to = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    mine = lambda c, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(c))
    data = index.rows.join(sized, shard).withColumn("part", mine("parts", 4)).withColumn("block", up_to("blocks"))
    again = sized.select(*[F.col(c).alias(c) for c in sized.columns])  # columns of their own, as both sides meet again
    asked = sent.join(again, shard).withColumn("block", mine("blocks", 5)).withColumn("part", up_to("parts") if everywhere else mine("parts", 6))
    largest = index.largest

    def run(key: tuple, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        rows, asks = (x.id.to_numpy(np.int64), x.alike.to_numpy(np.int64)), (q.own.to_numpy(np.int64), q.has_own.to_numpy(bool))
        ids, score = search(_stack(x.v), *rows, _stack(q.v), *asks, k, q.floor.to_numpy(float), largest, relax)
        out = pd.DataFrame({"query_id": np.repeat(q.id.to_numpy(np.int64), k), "vec_id": ids.ravel(), "score": score.ravel()})
        return out[np.isfinite(out.score)]

    keys = ["region", "sub", "part", "block"]
    return asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
