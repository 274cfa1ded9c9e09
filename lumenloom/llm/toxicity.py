"""Toxic documents by a subsequence string kernel and a support vector machine.

What is compared are the words of a text, and windows over its sentences: two or
three short words in a row, and any run of single characters, count joined as
well, so that an insult that is split over several words is one string again.
Two strings are alike as far as they share subsequences of three characters, each
weighted by DECAY to the power of its span in either word, so that a word with
characters put in between stays near the word it came from. Landmark words and
the Nyström map turn the kernel into a few features, on which a linear machine
is trained. Kernel and machine are linear in the subsequences, so the trained
weights fold into one table over all of them, and a word's value is a sum of
table entries over its subsequences, divided by its norm under the kernel. A
sentence or document has the value of its worst word; a logistic curve fitted
on held-back documents makes it a probability.

Labels stand at documents. Training follows the usual scheme for such bags: all
words of clean documents are negative, and of each toxic one the word that the
present machine likes best is positive.
"""

from __future__ import annotations

import functools
import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECAY = 0.6
#: Longest string that is one unit; longer words give overlapping windows.
UNIT = 24
#: Characters of each of two or three neighbouring words that count joined, at most.
SHORT = 4
#: 0 for marks and digits, 1 to 26 for a to z, the rest for all other letters by their code point: an alphabet's letters differ.
_CODES = 64
#: Bounds of the training sample: documents of either label, clean words that are compared at once, and landmarks of either kind.
SAMPLE_DOCS, NEGATIVES, LANDMARKS = 1200, 12_000, 64
_MEMORY = 300_000
#: Words times their length cubed that are valued together.
AT_ONCE = 2_000_000
#: Texts, and about how many characters of them, whose new pieces are valued together.
DOCS_AT_ONCE, CHARS_AT_ONCE = 256, 1_000_000
_EDGE = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum())
#: Below it a word is left for later: if no word of a text is above, the exact values decide.
FLOOR = -0.6


def pieces(text: str | None) -> set[str]:
    """The distinct words of a whole text in lower case, and joined what may be an insult in parts.

    Joined are three or more single characters in a row, and every two and three
    neighbours of SHORT characters or fewer.
    """
    words = (text or "").lower().split()
    found = set(words)
    if len(words) < 2:
        return found
    length = np.fromiter(map(len, words), np.int64, len(words))
    two = (length[1:] <= SHORT) & (length[:-1] <= SHORT)
    at = np.flatnonzero(two)
    if len(at):
        found.update([words[i] + words[i + 1] for i in at.tolist()])
        found.update([words[i] + words[i + 1] + words[i + 2] for i in np.flatnonzero(two[1:] & two[:-1]).tolist()])
        single = length == 1
        if (single[2:] & single[1:-1] & single[:-2]).any():
            edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
            found.update("".join(words[a:b]) for a, b in zip(edge[::2], edge[1::2]) if b - a > 2)
    return found


def strings(piece: str) -> list[str]:
    """What is valued of a word: it without marks at its ends, or windows of UNIT characters of a longer one."""
    w = piece.strip(_EDGE)
    return [w] if len(w) <= UNIT else [w[i : i + UNIT] for i in range(0, len(w) - UNIT // 2, UNIT // 2)]


def units(text: str | None) -> set[str]:
    """All strings of a text that are valued."""
    found = {u for p in pieces(text) for u in strings(p)}
    found.discard("")
    return found


def codes(words: list[str], n: int) -> np.ndarray:
    """A column of codes for each word of n characters, see _CODES."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n).T
    out = np.where((flat >= 97) & (flat <= 122), flat - 96, 0)
    return np.ascontiguousarray(np.where(flat >= 170, 27 + flat % (_CODES - 27), out).astype(np.int32))


@functools.cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    at = np.array(list(itertools.combinations(range(n), 3)), np.int64).reshape(-1, 3)
    return at[:, 0], at[:, 1], at[:, 2], (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def features(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers, a column for each word, and the weight of each row; a subsequence with a 0 has number 0."""
    i, j, k, w = _triples(len(c))
    number = (c[i] * _CODES + c[j]) * _CODES + c[k]
    if not c.all():
        number[(c[i] == 0) | (c[j] == 0) | (c[k] == 0)] = 0
    return number, w


def norms(c: np.ndarray) -> np.ndarray:
    """Square root of each word's kernel with itself, by the usual recursion over all words at once."""
    n, m = c.shape
    same = ((c[:, None] == c[None, :]) & (c[:, None] > 0)).astype(np.float32) * np.float32(DECAY**2)
    inner = np.ones((n, n, m), np.float32)  # common subsequences of what stands before i and j, weighted up to there
    for _ in range(2):
        nxt = np.zeros((n, n, m), np.float32)
        for i in range(n - 1):
            row = np.zeros(m, np.float32)
            for j in range(n - 1):
                row = DECAY * row + same[i, j] * inner[i, j]
                nxt[i + 1, j + 1] = DECAY * nxt[i, j + 1] + row
        inner = nxt
    return np.sqrt((same * inner).sum((0, 1), dtype=np.float64))


def _by_length(words: list[str], at_once: int) -> Iterator[tuple[int, list[int]]]:
    by: dict[int, list[int]] = {}
    for at, w in enumerate(words):
        by.setdefault(len(w), []).append(at)
    for n, where in by.items():
        step = max(1, at_once // max(1, n**3))
        yield from ((n, where[i : i + step]) for i in range(0, len(where), step) if n > 2)


@dataclass
class Columns:
    """Weights of subsequences in columns; only those subsequences have rows that some column has."""

    place: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Columns:
        """The normalised subsequence weights of each word in a column."""
        number, at, weight = [], [], []
        for i, w in enumerate(words):
            c = codes([w], len(w))
            n, v = features(c)
            number.append(n[:, 0])
            weight.append(v / max(norms(c)[0], 1e-30))
            at.append(np.full(len(v), i))
        number = np.concatenate(number)
        known, row = np.unique(number, return_inverse=True)
        place = np.zeros(_CODES**3, np.int32)
        place[known] = np.arange(1, len(known) + 1)
        rows = np.zeros((len(known) + 1, len(words)), np.float32)
        np.add.at(rows, (row + 1, np.concatenate(at)), np.concatenate(weight))
        if place[0]:
            rows[place[0]] = 0
        return cls(place, rows)

    def fold(self, by: np.ndarray) -> np.ndarray:
        """One weight for every subsequence: the columns' weights times ``by``."""
        table = np.zeros((_CODES**3, 1), np.float32)
        table[self.place > 0, 0] = (self.rows @ by.astype(np.float32))[self.place[self.place > 0]]
        return table


def kernel(words: list[str], columns: Columns) -> np.ndarray:
    """The normalised kernel of each word with each column; words without a subsequence have 0."""
    out = np.zeros((len(words), columns.rows.shape[1]))
    for n, some in _by_length(words, 500_000):
        c = codes([words[x] for x in some], n)
        number, weight = features(c)
        norm = norms(c)
        for x, r, size in zip(some, columns.place[number].T, norm):
            if size > 0:
                out[x] = weight @ columns.rows[r] / size
    return out


def sums(words: list[str], table: np.ndarray, bias: float, floor: float = -np.inf) -> np.ndarray:
    """The normalised kernel with a table of one weight for every subsequence, plus bias; at most ``floor`` stands for what isn't above it.

    A norm is at least that of the subsequences each for itself, which is quick
    to tell; the exact one is needed only for words that may be over the floor.
    Words without a subsequence tell nothing, and have the floor.
    """
    out = np.full(len(words), floor)
    flat = table[:, 0]
    for n, where in _by_length(words, AT_ONCE):
        c = codes([words[x] for x in where], n)
        where = np.array(where)
        i, j, k, weight = _triples(n)
        letters = c.all(0)  # without a mark or digit no subsequence is empty, and the least norm is the same for all
        for some, whole in ((np.flatnonzero(letters), True), (np.flatnonzero(~letters), False)):
            if not len(some):
                continue
            part = c if len(some) == len(where) else np.ascontiguousarray(c[:, some])
            if whole:
                total = weight @ flat[((part * _CODES)[i] + part[j]) * _CODES + part[k]]
                least = np.full(len(some), np.sqrt((weight**2).sum()))
            else:
                number, _ = features(part)
                total, least = weight @ flat[number], np.sqrt(weight**2 @ (number != 0))
            at = where[some]
            # With a floor above the bias a sum must be above 0, so the least norm gives an upper bound.
            high = np.flatnonzero((least > 0) & (total > (floor - bias) * least if floor > bias else True))
            if len(high):
                norm = norms(np.ascontiguousarray(part[:, high]))
                out[at[high]] = np.maximum(floor, total[high] / norm + bias)
    return out


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """A linear support vector machine with squared hinge loss, by Newton steps; the last entry is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    b, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = 1e-8
    weight = weight / weight.sum()
    before = None
    for _ in range(rounds):
        inside = y * (x @ b) < 1
        xs, ws = x[inside], weight[inside]
        b = np.linalg.solve(xs.T @ (xs * ws[:, None]) + np.diag(ridge), xs.T @ (ws * y[inside]))
        if before is not None and (inside == before).all():
            break
        before = inside
    return b


def fit_curve(value: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic curve through values with labels 0 and 1, by Newton steps."""
    weight = np.ones(len(value)) if weight is None else weight
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    x, b = np.stack([value, np.ones(len(value))], 1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - target)) + 1e-6 * b
        h = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        b = b - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return float(b[0]), float(b[1])


@dataclass
class Machine:
    """Weights of all subsequences, bias, and the curve from values to probabilities."""

    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def values(self, words: list[str], floor: float = -np.inf) -> np.ndarray:
        return sums(words, self.table, self.bias, floor)

    def worst(self, words: list[str]) -> float:
        """The exact value of the worst word; the bias if none has a subsequence."""
        value = float(self.values(words).max(initial=-np.inf))
        return value if np.isfinite(value) else self.bias

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500)))


def train(bags: list[set[str]], toxic: np.ndarray, fold: np.ndarray, rounds: int = 3, counts: dict[int, int] | None = None, negatives: int = NEGATIVES, landmarks: int = LANDMARKS) -> Machine:
    """A machine from bags of units with document labels; bags with fold true set the curve alone.

    counts: documents of either label that the sample stands for, so that the
    curve's probabilities are those of all documents and not of the sample.
    negatives: clean words that a round compares, at first by chance, then the
    worst of all clean ones with them; landmarks: of either kind.
    """
    use = [(b, t) for b, t, f in zip(bags, toxic, fold) if not f]
    clean = Counter(w for b, t in use if not t for w in b)
    bad = Counter(w for b, t in use if t for w in b)
    liked = {w: n / (1 + 5 * clean[w]) for w, n in bad.items()}
    spotless = sorted(clean)
    pick = np.random.default_rng(7)
    few = [spotless[i] for i in pick.choice(len(spotless), min(len(spotless), negatives), replace=False)]
    machine = None
    for _ in range(rounds):
        witness = Counter()
        for b, t in use:
            if t and b:
                w = max(sorted(b), key=lambda w: liked.get(w, 0))
                if machine is not None or bad[w] > 1:
                    witness[w] += 1
        positives = [w for w in witness if not clean[w]] or list(witness) or [""]
        top = [w for w, _ in Counter({w: witness[w] for w in positives}).most_common(landmarks) if len(w) > 2]
        marks = [*top, *[few[i] for i in pick.choice(len(few), min(len(few), landmarks), replace=False) if len(few[i]) > 2]]
        if not marks:
            return Machine(np.zeros((_CODES**3, 1), np.float32), 0.0, 0.0, -20.0)
        columns = Columns.of(marks)
        size, turn = np.linalg.eigh(kernel(marks, columns))
        ok = size > 1e-6 * size.max()
        root = turn[:, ok] / np.sqrt(size[ok])  # Nyström: features are kernel values times this
        words = positives + few
        x = kernel(words, columns) @ root
        y = np.r_[np.ones(len(positives)), -np.ones(len(few))]
        weight = np.r_[np.full(len(positives), 1 / len(positives)), np.full(len(few), 1 / max(len(few), 1))]
        b = fit_machine(x, y, weight)
        machine = Machine(columns.fold(root @ b[:-1]), float(b[-1]), 1.0, 0.0)
        every = sorted(set(clean) | set(bad))
        value = dict(zip(every, machine.values(every, FLOOR).tolist()))
        liked = {w: v + 10 - 5 * (clean[w] > 0) for w, v in value.items()}
        hard = sorted((w for w in clean), key=lambda w: -value[w])[: negatives // 4]
        few = list(dict.fromkeys(hard + few))[:negatives]
    for part in (True, False):
        rows = [(machine.worst(sorted(b)), t) for b, t, f in zip(bags, toxic, fold) if f == part]
        labels = np.array([t for _, t in rows], float)
        if 0 < labels.sum() < len(labels):
            break
    share = np.ones(len(labels))
    for t, n in (counts or {}).items():
        share[labels == t] = n / max(1, int((toxic == t).sum()))
    machine.slope, machine.shift = fit_curve(np.array([v for v, _ in rows]), labels, share / share.mean())
    return machine


def fold_of(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def fit(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, sample_docs: int = SAMPLE_DOCS, negatives: int = NEGATIVES, landmarks: int = LANDMARKS) -> Machine:
    """Train on up to ``sample_docs`` documents of either label, the first by a hash of the id.

    Rows whose crc32(id) mod 4 is ``held_out`` are never used. Repeated label
    rows of one id count as toxic if one of them does. Of a sampled document
    all distinct words are used; of several texts of one id the least one is.
    negatives, landmarks: see train().
    """
    marked = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if held_out is not None:
        marked = marked.where(fold_of() != held_out)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [marked.where(F.col("toxic") == t).orderBy(*order).limit(sample_docs) for t in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted(units(x.as_py()))) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "words"])

    # The sample has a fixed bound, so the table of chosen ids may be broadcast.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(run, "doc_id long, words string").join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")
    bags = [set(w.split()) for w in rows.words]
    counts = {int(r.toxic): r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows
    return train(bags, rows.toxic.to_numpy(), rows.fold.to_numpy(), counts=counts, negatives=negatives, landmarks=landmarks)


class _Scorer:
    """Values of texts; what is new in several texts is valued at once, and remembered."""

    def __init__(self, machine: Machine) -> None:
        self.machine, self.known, self.low = machine, {}, {}

    def __call__(self, text: str | None) -> float:
        return self.values([text])[0]

    def _exact(self, some: set[str]) -> dict[str, float]:
        """Exact values of pieces, remembered like those above FLOOR."""
        new = {p: strings(p) for p in some if p not in self.low}
        value = iter(self.machine.values([w for u in new.values() for w in u]).tolist())
        self.low.update({p: max([next(value) for _ in u], default=-np.inf) for p, u in new.items()})
        found = {p: self.low[p] for p in some}
        if len(self.low) > _MEMORY:
            self.low.clear()
        return found

    def values(self, texts: list[str | None]) -> list[float]:
        """The value of each text's worst piece; where none is above FLOOR, the exact one of all its pieces."""
        found = [pieces(t) for t in texts]
        new = list(set().union(*found).difference(self.known))
        bare = [p.strip(_EDGE) for p in new]
        short = [w for w in bare if len(w) <= UNIT]
        self.known.update(zip([p for p, w in zip(new, bare) if len(w) <= UNIT], self.machine.values(short, FLOOR).tolist()))
        for p, w in zip(new, bare):
            if len(w) > UNIT:
                self.known[p] = float(self.machine.values(strings(p), FLOOR).max())
        out = [float(max(map(self.known.__getitem__, f), default=FLOOR)) for f in found]
        low = [i for i, v in enumerate(out) if v <= FLOOR]
        if low:
            exact = self._exact(set().union(*[found[i] for i in low]))
            for i in low:
                value = max(map(exact.__getitem__, found[i]), default=-np.inf)
                out[i] = value if np.isfinite(value) else self.machine.bias
        if len(self.known) > _MEMORY:
            self.known.clear()
        return out


def _runs(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts by DOCS_AT_ONCE, or fewer where they are long."""
    run, size = [], 0
    for x in texts:
        run.append(x.as_py())
        size += len(run[-1] or "")
        if len(run) == DOCS_AT_ONCE or size > CHARS_AT_ONCE:
            yield run
            run, size = [], 0
    if run:
        yield run


def score(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` (probability of being toxic) and ``predicted`` (1 from ``threshold`` on).

    Each whole text is scored, and nothing but the text; null and empty texts
    have the score of no words. Columns of these names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    fields = docs.select(*keep).schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # 1 MB
    source = docs.select(*keep)
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            values = np.array([v for run in _runs(batch.column(at)) for v in scorer.values(run)], float)
            p = shared.value.probability(values)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=fields.names)

    return source.mapInArrow(run, fields).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
