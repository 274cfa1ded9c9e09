"""Quality rules: plain counts, and a logistic regression over hashed n-grams.

The counts alone reject a text that is very short or repeats itself. The model
reads word and character n-grams, hashed into DIM places, is trained on labelled
documents, and its value is made a probability on documents held back from
training; a fixed threshold on that probability is its verdict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from lumenloom.llm.toxicity import fit_curve

#: Fixed rules: fewest words; most repeated words in a hundred; words of a window.
FEWEST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
#: Least probability of good quality of a kept text.
KEEP = 0.3
DIM_BITS = 15
DIM = 1 << DIM_BITS
#: Bound of the training sample: documents of either label.
SAMPLE_DOCS = 1000
_SYMBOLS = b"#*$%&|<>"
_SPACE = bytes([32, *range(9, 14)])
_IN_WORD = np.array([b not in _SPACE and b & 0xC0 != 0x80 for b in range(256)], np.int64)
_M = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def repeated_words(h: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that the text has twice or more."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    v = np.zeros(n, np.uint64)
    for i in range(window):
        v = (v ^ h[i : i + n]) * _M
        v ^= v >> np.uint64(32)
    order = np.argsort(v, kind="stable")
    same = v[order[1:]] == v[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge) > 0).sum())


def counts(raw: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    per_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
    return len(words), int(per_byte @ _IN_WORD), int(per_byte[list(_SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated_words(h)


def places(raw: bytes, h: np.ndarray) -> np.ndarray:
    """Hashed places of a text's words, word pairs, and runs of two and three bytes."""
    shift = np.uint64(64 - DIM_BITS)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    found = [(h * _M) >> shift, ((h[1:] * np.uint64(3) + h[:-1]) * _M) >> shift]
    for n, salt in ((2, 40503), (3, 60493)):
        if len(b) >= n:
            x = np.zeros(len(b) - n + 1, np.uint32)
            for i in range(n):
                x = x * np.uint32(257) + b[i : len(b) - n + 1 + i]
            found.append((x * np.uint32(2654435761 + salt * 2)) >> np.uint32(32 - DIM_BITS))
    return np.concatenate([f.astype(np.int64) for f in found])


def vector(raw: bytes, h: np.ndarray) -> np.ndarray:
    """Square roots of the counts per place, scaled to length one."""
    x = np.sqrt(np.bincount(places(raw, h), minlength=DIM), dtype=np.float32)
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


@dataclass
class Model:
    """Weights per place and the curve from values to the probability of good quality."""

    weights: np.ndarray
    slope: float
    shift: float

    def probability(self, raw: bytes, h: np.ndarray) -> float:
        """As the vector's value, without scaling the vector first."""
        x = np.sqrt(np.bincount(places(raw, h), minlength=DIM), dtype=np.float32)
        value = (x @ self.weights) / max(float(np.sqrt(x @ x)), 1e-12)
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500))))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, fold: np.ndarray, epochs: int = 12) -> Model:
    """Adaptive gradient steps over sparse rows (places, values); rows with fold true set the curve alone."""
    w, seen = np.zeros(DIM), np.full(DIM, 1e-6)
    pick = np.random.default_rng(5)
    use = np.flatnonzero(~fold) if (~fold).any() else np.arange(len(rows))
    for _ in range(epochs):
        for r in pick.permutation(use):
            at, v = rows[r]
            g = weight[r] * (1 / (1 + np.exp(-np.clip(v @ w[at], -30, 30))) - y[r]) * v + 1e-6 * w[at]
            seen[at] += g * g
            w[at] -= 0.3 * g / np.sqrt(seen[at])
    value = np.array([v @ w[at] for at, v in rows])
    held = fold if 0 < y[fold].sum() < fold.sum() else np.ones(len(y), bool)
    return Model(w.astype(np.float32), *fit_curve(value[held], y[held], weight[held]))


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model | None:
    """Train on up to ``sample_docs`` labelled documents of either quality, the first by a hash of the id.

    Whole texts are read. Each label has the same weight in total: how rare
    poor texts are among the labelled says little about other corpora. Repeated
    label rows of an id count as poor if one does; of several texts of an id the
    least one is used. Without both labels there is no model.
    """
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = [F.xxhash64("doc_id", F.lit(3)), F.col("doc_id")]
    chosen = [marked.where(F.col("quality") == q).orderBy(*order).limit(sample_docs) for q in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = [], []
            for x in batch.column(1):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                v = vector(raw, word_hashes(raw.split()))
                at.append(np.flatnonzero(v).astype("<u2").tobytes())
                values.append(v[v > 0].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(values, pa.binary())], names=["doc_id", "at", "value"])

    # The sample has a fixed bound, so the table of chosen ids may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = texts.mapInArrow(run, "doc_id long, at binary, value binary").join(F.broadcast(chosen), "doc_id")
    rows = found.toPandas().sort_values("doc_id")
    y = rows.quality.to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    sparse = [(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(v, "<f4").astype(np.float64)) for a, v in zip(rows["at"], rows.value)]
    fold = np.array([xxh3_64_intdigest(str(i)) % 4 == 0 for i in rows.doc_id])
    return train(sparse, y, weight, fold)


def judge(docs: DataFrame, model: Model | None, text_col: str = "text", keep_from: float = KEEP) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality_score and kept.

    A text is kept if the counts do not fail it and the model's probability of
    good quality is at least ``keep_from``, so a tie is kept; without a model the counts decide.
    Null and empty texts have no words and fail. Whole texts are read. Columns
    named like a result are replaced.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    keep = [c for c in docs.columns if c not in (*names, "base_failed", "quality_score", "kept")]
    fields = docs.select(*keep).schema
    for c in names:
        fields = fields.add(c, "long")
    fields = fields.add("quality_score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 128 KB
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found, score = [], []
            for x in batch.column(at):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                h = word_hashes(words)
                found.append(counts(raw, words, h))
                score.append(m.probability(raw, h) if m is not None else None)
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(score, pa.float64())], names=fields.names)

    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = docs.select(*keep).mapInArrow(run, fields).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.coalesce("quality_score", F.lit(1.0)) >= keep_from))
