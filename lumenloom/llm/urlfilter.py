"""URL rules by a cascade of Bloom filters: exact membership without a join.

Level 0 of a cascade encodes the listed keys. Level 1 encodes those keys of the
corpus that level 0 passes although they are not listed, level 2 the listed ones
that level 1 passes, and so on until nothing passes wrongly. As the levels are
built against every key that the corpus can ask for, an answer is always right.

Level 0 errs the less the more keys the corpus has, so that level 1 encodes about
as many keys as level 0 does: a cascade's size goes with the list, and only with
the logarithm of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import Scratch

#: Share of wrongly passed keys at the levels after level 0, and at level 0 at most.
OTHER_RATE, FIRST_RATE = 0.5, 0.01
#: Words of a filter that come to the driver at a time.
PART_WORDS = 1 << 20


@dataclass
class Level:
    words: np.ndarray
    bits: int
    hashes: int

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h1), bool)
        for i in range(self.hashes):
            at = _place(h1, h2, i, self.bits)
            ok &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _place(h1: np.ndarray, h2: np.ndarray, i: int, bits: int) -> np.ndarray:
    return (h1 + np.uint64(i) * (h2 | np.uint64(1))) % np.uint64(bits)


def _salted(h: np.ndarray, level: int) -> np.ndarray:
    """Levels must err independently, so each hashes anew."""
    x = h ^ np.array([(level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF], np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class Cascade:
    """has(h1, h2): is the key with these two 64-bit hashes listed?"""

    def __init__(self, levels: list[Level]) -> None:
        self.levels = levels

    def depth(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """How many levels, one after the other, pass each key."""
        h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
        alive, depth = np.arange(len(h1)), np.zeros(len(h1), np.int64)
        for n, level in enumerate(self.levels):
            alive = alive[level.has(_salted(h1[alive], n), _salted(h2[alive], n))]
            depth[alive] = n + 1
        return depth

    def has(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.depth(h1, h2) % 2 == 1

    @property
    def n_bytes(self) -> int:
        return sum(x.words.nbytes for x in self.levels)


def _build_level(keys: DataFrame, n: int, level: int, rate: float, tables: Scratch) -> Level:
    """One Bloom filter of the n keys: bits are gathered by words, PART_WORDS at a time, so the driver sees no keys."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
    bits = (bits + 63) // 64 * 64
    hashes = max(1, round(-math.log2(rate)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h1 = _salted(pdf.h1.to_numpy(np.int64).view(np.uint64), level)
            h2 = _salted(pdf.h2.to_numpy(np.int64).view(np.uint64), level)
            at = np.unique(np.concatenate([_place(h1, h2, i, bits) for i in range(hashes)]))
            word, one = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pd.DataFrame({"word": word, "mask": one.view(np.int64)}).groupby("word", as_index=False).agg({"mask": np.bitwise_or.reduce})

    filled = tables.write(keys.mapInPandas(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")))
    words = np.zeros(bits // 64, np.uint64)
    for first in range(0, len(words), PART_WORDS):
        part = filled.where(F.col("word").between(first, first + PART_WORDS - 1)).toPandas()
        words[part.word.to_numpy(np.int64)] = part["mask"].to_numpy(np.int64).view(np.uint64)
    tables.drop(filled)
    return Level(words, bits, hashes)


def build_cascade(listed: DataFrame, universe: DataFrame, most_levels: int = 60) -> Cascade:
    """A cascade over ``universe`` (h1, h2 of each key), of the keys that are in ``listed`` too.

    Both are tables of distinct hash pairs and stay distributed; only filter
    words reach the driver. If nothing is listed, nothing is a member. Level 0
    passes a share of listed over other keys, divided by the square root of 2,
    but FIRST_RATE at most, so that neither level outgrows the other.
    """
    with Scratch(universe.sparkSession) as tables:
        inside = tables.write(listed.join(universe, ["h1", "h2"], "left_semi"))
        encode, other = inside, universe.join(inside, ["h1", "h2"], "left_anti")
        n_other = universe.count() - inside.count()
        levels: list[Level] = []
        for n in range(most_levels):
            count = encode.count()
            if not count:
                return Cascade(levels)
            rate = OTHER_RATE if n else min(FIRST_RATE, count / max(n_other, 1) * math.sqrt(0.5))
            levels.append(_build_level(encode, count, n, rate, tables))
            so_far = universe.sparkSession.sparkContext.broadcast(Cascade(list(levels)))

            def passing(batches: Iterator[pd.DataFrame], n: int = n, so_far=so_far) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    yield pdf[so_far.value.depth(pdf.h1.to_numpy(np.int64), pdf.h2.to_numpy(np.int64)) == n + 1]

            encode, other = tables.write(other.mapInPandas(passing, "h1 long, h2 long")), encode
        raise RuntimeError(f"the cascade did not end in {most_levels} levels")


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty without :// or for null."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def _candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Every key that a rule for this url could have: a host suffix of so many labels and a path prefix of such a length."""
    suffixes = [F.when(F.size(F.split(host, r"\.")) >= n, F.substring_index(host, ".", -n)) for n in labels]
    parts = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_compact(F.array(*[F.concat(s, p) for s in suffixes for p in parts]))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each row.

    rules: (allow or block, host, path). A rule fits its host and all of its
    subdomains if the path starts with the rule's path; the longest that fits
    wins and gives ``rule`` (host and path) and the verdict. Without one, rule
    is null and the verdict is ``default``: no cascade lists the url. A host and
    path may be listed once. Null urls and urls without :// have an empty host
    and path. Columns of ``pages`` named like a result are replaced. Repeated
    urls are judged alike; an empty table gives an empty result.
    """
    if len({(h, p) for _, h, p in rules}) < len(rules):
        raise ValueError("a host and path is listed twice")
    labels = sorted({len(h.split(".")) for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    # Columns of a made-up name stand apart from those of ``pages``, which are held in one struct meanwhile.
    own = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None)
    split = pages.select(own.alias("row"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    fields = [F.col("row")[c].alias(c) for c in keep]
    if not rules:
        return split.select(*fields, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    candidates = _candidates(F.col("host"), F.col("path"), labels, lengths)
    spark = pages.sparkSession
    with Scratch(spark) as tables:
        parts = split.select(F.explode(candidates).alias("key"))
        universe = tables.write(parts.select(*_hashes(F.col("key"))).distinct())
        cascades = {}
        for action in ("allow", "block"):
            keys = spark.createDataFrame([(h + p,) for a, h, p in rules if a == action], "key string")
            cascades[action] = build_cascade(keys.select(*_hashes(F.col("key"))), universe)
    shared = spark.sparkContext.broadcast(cascades)  # some 20 to 50 bits for each rule

    @F.pandas_udf("array<int>")
    def listed(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """1 for a key of the allow list, -1 for one of the block list, else 0."""
        n = h1.map(len).to_numpy()
        flat1 = np.concatenate([*h1, np.empty(0, np.int64)]).astype(np.int64)
        flat2 = np.concatenate([*h2, np.empty(0, np.int64)]).astype(np.int64)
        found = shared.value["allow"].has(flat1, flat2).astype(np.int32) - shared.value["block"].has(flat1, flat2)
        return pd.Series(np.split(found, np.cumsum(n)[:-1]))

    keyed = split.withColumn("keys", candidates)
    marked = keyed.withColumn("mark", listed(F.transform("keys", lambda k: F.xxhash64(k)), F.transform("keys", lambda k: F.xxhash64(F.lit(1), k))))
    hits = F.filter(F.arrays_zip("keys", "mark"), lambda x: x["mark"] != 0)
    longest = F.array_max(F.transform(hits, lambda x: F.struct(F.length(x["keys"]).alias("n"), x["keys"].alias("rule"), x["mark"].alias("mark"))))
    best = marked.withColumn("best", longest)
    verdict = F.when(F.col("best.mark") > 0, F.lit("allow")).when(F.col("best.mark") < 0, F.lit("block")).otherwise(F.lit(default))
    return best.select(*fields, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
