"""Near-duplicate groups by fast similarity sketches, banding and exact checks.

The sketch throws a document's shingles into ``t`` bins, round after round with
a new hash, and keeps each bin's least value of the earliest round that reached
it; the last ``t`` rounds aim all shingles at one bin each, so every coordinate
is filled. Equal sets have equal sketches and a coordinate agrees with the
probability of the Jaccard similarity, with concentration as if all shingles
had been hashed ``t`` times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from lumenloom.llm.common import Scratch, materialize
from lumenloom.llm.graph import connected_components

SHINGLE = 5
COORDINATES = 128
ROWS_PER_BAND = 4
#: Members of one block when a large bucket is compared in blocks.
BLOCK = 256
#: A pair is looked at if so many coordinates agree: at 75 % fewer do with a chance of about 3e-7.
LEAST = 72
#: Coordinates of the longer sketch that near documents get, and how many of them must agree, by the same chance.
WIDE, WIDE_LEAST = 1024, 699
_MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of the whole text.

    Words are runs without ASCII white space, with A-Z in lower case. A text of
    fewer than k words, but one at least, is a single shingle; null or blank
    texts have none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _GOLD + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def sketch(a: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The t coordinates of a non-empty set of hashes; t is a power of two."""
    s = np.full(t, _MASK, np.uint64)
    bits = np.uint64(t.bit_length() - 1)
    first, step = 0, max(1, min(16, 2 * t // len(a)))
    while first < t and (first == 0 or s.max() == _MASK):
        rounds = np.arange(first, min(t, first + step), dtype=np.uint64)
        h = mix(a[None, :] ^ mix(rounds * _GOLD + np.uint64(1))[:, None])
        value = (rounds[:, None] << np.uint64(54)) | (h >> np.uint64(10))
        np.minimum.at(s, (h & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64).ravel(), value.ravel())
        first += step
    for b in np.flatnonzero(s == _MASK):
        r = np.array([t + b], np.uint64)
        s[b] = ((r << np.uint64(54)) | (mix(a ^ mix(r * _GOLD + np.uint64(1))) >> np.uint64(10))).min()
    return s


def band_keys(s: np.ndarray, rows: int = ROWS_PER_BAND) -> np.ndarray:
    """One 64-bit key per band of ``rows`` coordinates; the band number is hashed in."""
    b = s.reshape(-1, rows)
    key = np.arange(len(b), dtype=np.uint64)
    for i in range(rows):
        key = mix(key * _GOLD + b[:, i])
    return key.view(np.int64)


_SKETCH = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>, bytes binary"


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, digest of the set, band keys and one byte per coordinate; nulls for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, bands, low = [], [], [], []
            for text in batch.column(2):
                a = shingle_hashes(text.as_py())
                n.append(len(a))
                if len(a):
                    s = sketch(a)
                    digest.append(xxh3_128_digest(a.tobytes()))
                    bands.append(band_keys(s))
                    low.append(mix(s).astype(np.uint8).tobytes())
                else:
                    digest.append(None), bands.append(None), low.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(low, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "bytes"],
            )

    return _texts(docs, id_col, text_col).mapInArrow(run, _SKETCH)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash and text: an id may have several texts, which the hash tells apart."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def _shingle_sets(docs: DataFrame, reps: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rep, its full set of shingle hashes and a byte per coordinate of a longer sketch, for the reps in ``ids``.

    Rows that repeat a rep's id and text give its set again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                sets = [shingle_hashes(x.as_py()) for x in part.column(1)]
                wide = [mix(sketch(a, WIDE)).astype(np.uint8).tobytes() if len(a) else None for a in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([a.view(np.int64) for a in sets], pa.list_(pa.int64())), pa.array(wide, pa.binary())],
                    names=["rep", "shingles", "wide"],
                )

    wanted = reps.join(ids, "rep", "left_semi").select("doc_id", "text_hash", "rep")
    # The ids grow with the corpus, so both sides are shuffled at any size.
    found = _texts(docs, id_col, text_col).join(wanted.hint("merge"), ["doc_id", "text_hash"])
    return found.select("rep", "text").mapInArrow(run, "rep long, shingles array<long>, wide binary")


def _agree(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs a, b of which at least ``least`` coordinates agree; reads a_bytes and b_bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf.a_bytes), np.uint8).reshape(len(pdf), -1)
                y = np.frombuffer(b"".join(pdf.b_bytes), np.uint8).reshape(len(pdf), -1)
                yield pdf.loc[(x == y).sum(1) >= least, ["a", "b"]]

    return pairs.select("a", "b", "a_bytes", "b_bytes").mapInPandas(run, "a long, b long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union, as edges u, v."""
    # b is the centre of many pairs: its set joins first, to the two ids alone.
    far = pairs.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("b_set")), "b")
    both = far.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("a_set")), "a")
    common = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - F.col("common")
    return (
        both.withColumn("common", common)
        .where(F.lit(100) * F.col("common") >= F.lit(percent) * union)
        .select(F.col("a").alias("u"), F.col("b").alias("v"))
    )


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()


def _compare_blocks(members: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """What agrees within a bucket under different labels: pairs a, b, or only rep of either end.

    members: key, rep, label, bytes, m (the bucket's size), n (the set's size)
    and, for pairs, wide, bands and c, a bound on how many of the set's shingles
    any other member has. A pair that shares several buckets is given by that of
    its first common band alone: either the pair is compared there too, or that
    bucket holds just the two, and the check against the centre has settled it. A bucket of up to BLOCK members is one cell; a larger one
    is dealt into blocks, and each pair of blocks is a cell, so no task holds a
    whole bucket. A pair is left out if too few coordinates agree, or if c of
    either end is below the intersection that sets of these sizes need.
    """
    more = ["wide", "bands", "c"] if pairs else []
    cells = (
        members.withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "rep", "label", "bytes", "n", *more)
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(pdf.bytes), np.uint8).reshape(len(pdf), -1)
        rep, label, mine, n = (pdf[k].to_numpy() for k in ("rep", "label", "mine", "n"))
        c = pdf.c.to_numpy() if pairs else n
        y = np.frombuffer(b"".join(pdf.wide), np.uint8).reshape(len(pdf), -1) if pairs else None
        bands = np.frombuffer(b"".join(pdf.bands), ">i8").reshape(len(pdf), -1) if pairs else None
        bucket, i, j = key
        found, right = [], np.flatnonzero(mine == j)
        for k in np.flatnonzero(mine == i):
            ok = right[(label[right] != label[k]) & ((rep[right] > rep[k]) | (i != j))]
            ok = ok[(100 + percent) * np.minimum(c[ok], c[k]) >= percent * (n[ok] + n[k])]
            ok = ok[(x[ok] == x[k]).sum(1) >= LEAST]
            if pairs:
                ok = ok[(y[ok] == y[k]).sum(1) >= WIDE_LEAST]
                ok = ok[bands[k][(bands[ok] == bands[k]).argmax(1)] == bucket]
            found += [(max(rep[k], rep[o]), min(rep[k], rep[o])) for o in ok]
        if pairs:
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")
        return pd.DataFrame({"rep": np.unique(np.array(found, np.int64).ravel())})

    return cells.groupBy("key", "i", "j").applyInPandas(run, "a long, b long" if pairs else "rep long")


def _shared_shingles(sets: DataFrame, tables: Scratch) -> DataFrame:
    """rep and c, how many of its shingles another of these sets has too."""
    each = sets.select("rep", F.explode("shingles").alias("s"))
    often = tables.write(each.groupBy("s").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("s"))
    return each.join(often, "s").groupBy("rep").agg(F.count(F.lit(1)).alias("c"))


def _same_id(some: DataFrame, classes: DataFrame, tables: Scratch) -> DataFrame:
    """Edges u, v between the classes of each id that has several; few, unless ids repeat."""
    h = F.xxhash64("digest")
    several = tables.write(some.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo < hi").select("doc_id"))
    held = some.join(several, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "rep"), "digest")
    held = tables.write(held.select("doc_id", "rep"))
    return held.join(held.groupBy("doc_id").agg(F.min("rep").alias("v")), "doc_id").select(F.col("rep").alias("u"), "v")


def component_rows(table: DataFrame, classes: DataFrame, final: DataFrame, tables: Scratch) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``table``.

    table: doc_id, n_shingles and digest; classes: digest, doc_id (its least
    one) and rep; final: rep and component of the reps that have links.
    """
    # Classes of a component have the least id of any of them; a class without a link has its own.
    linked = tables.write(final.join(classes.select("rep", "doc_id"), "rep"))
    least = tables.write(linked.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    linked = linked.join(least, "component").select("rep", "component_id")
    named = tables.write(classes.join(linked, "rep", "left").select("digest", F.coalesce("component_id", "doc_id").alias("component_id")))
    rows = table.select("doc_id", "n_shingles", "digest")
    known = tables.write(rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").join(named, "digest").select("doc_id", "n_shingles", "component_id"))
    alone = rows.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles")
    # An empty row of an id that has other rows goes by theirs.
    blank = alone.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    theirs = tables.write(known.join(blank, "doc_id", "left_semi").select("doc_id", "component_id").distinct())
    alone = alone.join(theirs, "doc_id", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.coalesce("component_id", "doc_id")).alias("component_id"))
    return known.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two documents are linked if their sets of distinct 5-word shingles have at
    least ``percent`` % in common; component_id is the least id reachable.
    Documents with equal sets are one class from the start, so that groups of
    copies cost one row each. In each bucket of a band the member that shares
    most buckets over all is the centre; the others are checked against it on
    full sets. Buckets whose members are then still in several components are
    compared in blocks by their sketches. Of what agrees there, the shingles
    that no other such document has are counted, since they bound how much a
    document can share with any other; the pairs that remain possible are
    checked on full sets too. No bucket is capped.

    Null or blank texts have an empty set and are linked with nothing. Rows with
    a null id keep n_shingles, with component_id null and kept false. Rows that
    repeat an id are one vertex, whatever their texts: a link of any of these is
    one of the id. Other columns of ``docs`` are ignored. An empty table gives an
    empty result.
    """
    with Scratch(docs.sparkSession) as tables:
        return materialize(_grouped(docs, id_col, text_col, percent, tables))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, tables: Scratch) -> DataFrame:
    write = tables.write
    table = write(sketch_table(docs, id_col, text_col))
    some = table.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    # A class is a set of shingles. Its number is given as it is written, and is its vertex from there on.
    classes = write(some.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("rep", F.monotonically_increasing_id()))
    one = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_shingles", "bands", "bytes")]
    reps = write(some.join(classes, ["digest", "doc_id"]).groupBy("rep").agg(*one, F.count(F.lit(1)).alias("rows")))
    repeated = reps.where("rows > 1").limit(1).count() > 0

    def full_sets(ids: DataFrame) -> DataFrame:
        found = _shingle_sets(docs, reps, ids, id_col, text_col)
        return found.dropDuplicates(["rep"]) if repeated else found

    keyed = reps.select("rep", F.explode("bands").alias("key"))
    sizes = write(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    shared = write(keyed.join(sizes, "key"))
    weight = shared.groupBy("rep").agg(F.sum("m").alias("w"))
    weighed = write(shared.join(weight, "rep"))
    centre = write(
        weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("rep")).alias("less"))).alias("c")).select("key", (-F.col("c.less")).alias("centre"))
    )
    star = weighed.select("key", "rep").join(centre, "key").where("rep <> centre").select("rep", "centre").distinct()
    low = reps.select("rep", "bytes")

    def with_bytes(pairs: DataFrame) -> DataFrame:
        """pairs: a and b; b may be a hub."""
        return pairs.join(low.select(F.col("rep").alias("b"), F.col("bytes").alias("b_bytes")), "b").join(
            low.select(F.col("rep").alias("a"), F.col("bytes").alias("a_bytes")), "a"
        )

    star = star.select(F.col("rep").alias("a"), F.col("centre").alias("b"))
    star = write(_agree(with_bytes(star), LEAST))
    tables.drop(weighed, centre, sizes)
    sets = write(full_sets(_ends(star)))
    first = connected_components(_confirm(star, sets, percent), write)
    label = F.coalesce(F.col("component"), F.col("rep"))
    labelled = write(
        shared.where("m > 2").join(first.withColumnRenamed("id", "rep"), "rep", "left").select("key", "rep", "m", label.alias("label"))
    )
    tables.drop(shared, star)
    mixed = write(labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key"))
    members = labelled.join(mixed, "key").join(reps.select("rep", "bytes", "bands", F.col("n_shingles").alias("n")), "rep")
    each = [F.unhex(F.lpad(F.hex(F.get("bands", F.lit(i))), 16, "0")) for i in range(COORDINATES // ROWS_PER_BAND)]
    members = write(members.withColumn("bands", F.concat(*each)))
    tables.drop(labelled, mixed)
    near = write(_compare_blocks(members, percent, pairs=False).distinct())
    missing = near.join(sets.select("rep"), "rep", "left_anti")
    less, sets = sets, write(sets.join(near, "rep", "left_semi").unionByName(full_sets(missing)))
    tables.drop(less, near)
    again = members.join(_shared_shingles(sets, tables), "rep").join(sets.select("rep", "wide"), "rep")
    cross = write(_compare_blocks(again, percent, pairs=True).distinct())
    more = _confirm(cross, sets, percent)
    edges = first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more).unionByName(_same_id(some, classes, tables))
    final = connected_components(edges, write).withColumnRenamed("id", "rep")
    tables.drop(members, sets, cross, first)
    return component_rows(table, classes, final, tables).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
