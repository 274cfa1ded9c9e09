"""Periodic runs of words within a text, by block matching.

A run of period q from 2^k up to, but without, 2^(k+1) that goes on for four
periods contains whole aligned blocks of 2^k words which recur q words later.
So for each power of two the aligned blocks are searched across the document
by one automaton over word numbers; occurrences at a distance of one to two
blocks are seeds, and each is extended both ways, word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words compared at once while a seed is extended; doubled as long as they agree.
STEP = 64
_NEVER = np.iinfo(np.int64).max
_RESULT = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_numbers(words: list[bytes]) -> np.ndarray:
    """Equal words have equal numbers from 0."""
    return pd.factorize(np.array(words, object))[0].astype(np.int64)


def next_same_quad(w: np.ndarray) -> np.ndarray:
    """For each place how far on the four words from it stand again; a very large number if they don't."""
    n = len(w) - 3
    out = np.full(len(w), _NEVER)
    if n < 2:
        return out
    two = pd.factorize(w[:-1] * (w.max() + 1) + w[1:])[0].astype(np.int64)
    four = pd.factorize(two[:n] * (two.max() + 1) + two[2 : n + 2])[0]
    order = np.argsort(four, kind="stable")
    same = four[order[1:]] == four[order[:-1]]
    out[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return out


def _seeds(w: np.ndarray, far: np.ndarray, size: int, settled: list[tuple[int, int, int]]) -> np.ndarray:
    """Rows of place and distance at which an aligned block of ``size`` words recurs, one to two blocks on.

    Within a run of four periods, each of the first places has its four words
    again within the period; blocks with other places are not searched. Nor are
    those that stand with the next two blocks' length in a settled run of a
    period of half a block or less: what recurs there is that run itself, as it
    is at multiples of its period up to its end.
    """
    blocks = len(w) // size
    wanted = (far[: blocks * size] < 2 * size).reshape(blocks, size).all(1)
    for start, end, _ in settled:
        wanted[-(-start // size) : max(0, (end - 3 * size) // size + 1)] = False
    at = np.flatnonzero(wanted)
    if not len(at):
        return np.empty((0, 2), np.int64)
    keys = w[: blocks * size].reshape(blocks, size)[at]
    number = np.full(blocks, -1)
    trie = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for b, key in zip(at, map(tuple, keys.tolist())):
        number[b] = trie.get(key, b)
        if number[b] == b:
            trie.add_word(key, int(b))
    trie.make_automaton()
    found = []
    # Only what can follow a searched block is walked through, stretch by stretch.
    cuts = np.flatnonzero(np.diff(at) > 3)
    for lo, hi in zip(at[np.r_[0, cuts + 1]] * size, (at[np.r_[cuts, len(at) - 1]] + 3) * size):
        found += [(lo + end - size + 1, key) for end, key in trie.iter(tuple(w[lo:hi].tolist()))]
    if not found:
        return np.empty((0, 2), np.int64)
    start, key = np.array(found, np.int64).T
    # Of all aligned blocks one is at a distance from ``size`` up to 2 * size - 1 before.
    block = start // size - 1
    ok = (block >= 0) & (number[block] == key)
    place, q = block[ok] * size, start[ok] - block[ok] * size
    fresh = np.ones(len(q), bool)
    for begin, end, period in settled:
        fresh &= (place < begin) | (place + q + size > end) | (q % period != 0)
    return np.unique(np.stack([q[fresh], place[fresh]], 1), axis=0)[:, ::-1]


def _agree(w: np.ndarray, at: int, q: int, way: int) -> int:
    """How many words from ``at`` on, in direction ``way``, equal those q words later."""
    total, step = 0, STEP
    while True:
        lo, hi = (at + total, min(at + total + step, len(w) - q)) if way > 0 else (max(0, at - total - step + 1), at - total + 1)
        if hi <= lo:
            return total
        differs = np.flatnonzero((w[lo:hi] != w[lo + q : hi + q])[::way])
        if len(differs):
            return total + int(differs[0])
        total += hi - lo
        step *= 2


def _is_power(w: np.ndarray, start: int, q: int) -> bool:
    """Whether the q words from start are a shorter piece repeated."""
    root, rest, r = w[start : start + q], q, 2
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            p = q // r
            if (root[p:] == root[:-p]).all():
                return True
            while rest % r == 0:
                rest //= r
        r += 1
    return False


def runs_of(w: np.ndarray) -> list[tuple[int, int, int]]:
    """start, length and period of each run of the numbers ``w``, in this order by start and period.

    A run is a longest stretch with smallest period q and a length of at least
    max(6, 4 * q).
    """
    n = len(w)
    if n < LEAST_WORDS:
        return []
    far = next_same_quad(w)
    least = far.min()
    found: dict[tuple[int, int], int] = {}
    size = 1
    while LEAST_TIMES * size <= n:
        if least < 2 * size:
            settled = [(s, s + length, q) for (s, q), length in found.items() if 2 * q <= size and length >= 2 * size]
            done_q, done_end = 0, -1
            for at, q in _seeds(w, far, size, settled).tolist():
                if q == done_q and at < done_end:
                    continue
                left, right = _agree(w, at - 1, q, -1), _agree(w, at, q, 1)
                done_q, done_end = q, at + right
                start, length = at - left, left + right + q
                if length >= max(LEAST_WORDS, LEAST_TIMES * q) and not _is_power(w, start, q):
                    found[start, q] = length
        size *= 2
    return [(s, length, q) for (s, q), length in sorted(found.items())]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run contains after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        gone[start + q] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, runs (start, length, period) and collapsed, a row for each row of ``docs``.

    Words are runs without ASCII white space of the whole text, numbered from 0,
    and compared as they are. collapsed has one period of each run, its words
    joined by one space. Null, blank and short texts have no run; a null text
    collapses to an empty one. Runs of different periods may overlap: both are
    given, and a word goes if either drops it. Rows with equal or null ids stay
    rows of their own; other columns are ignored; an empty table gives no rows.
    No shuffle: a row needs nothing but its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or b"").split()
                mine = runs_of(word_numbers(words)) if len(words) >= LEAST_WORDS else []
                counts.append(len(words))
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in mine])
                texts.append(b" ".join(collapse(words, mine)).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())],
                names=["id", "n_words", "runs", "collapsed"],
            )

    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, _RESULT)
    return found.withColumnRenamed("id", id_col)
