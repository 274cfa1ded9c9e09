"""Sequences of several permitted lengths, packed by best fit.

A document becomes one item of as many positions as it has token ids plus one for
its end id; one that is longer than the longest sequence is cut into pieces. A
piece goes into the open sequence that it leaves the least room in. If there is
none, a new one is opened of the length that costs least for what is still to
come; at last each sequence shrinks to the shortest permitted length that holds
what is in it. A sequence costs its length and a fixed overhead.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm import tokens

#: Permitted lengths, overhead of a sequence; pieces that are packed together, and ids of these, at most.
CAPACITIES, OVERHEAD, GROUP, GROUP_IDS = (512, 1024, 2048, 4096, 8192), 64, 10_000, 4_000_000


def opened(size: int, left: int, capacities: tuple[int, ...], overhead: int) -> int:
    """The capacity with the least cost per position that it can be filled with: by this piece and what is left."""
    fits = [c for c in capacities if c >= size]
    return min(fits, key=lambda c: ((c + overhead) / min(c, size + left), c))


def pack(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, place in it and its final length for each piece; larger pieces first, equal ones in their order."""
    n = len(sizes)
    bins, places = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room: list[tuple[int, int]] = []  # room and number of the open sequences, in order
    fill: list[int] = []
    size_of: list[int] = []
    left = int(sizes.sum())
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        left -= size
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            b, free = len(fill), opened(size, left, capacities, overhead)
            fill.append(0)
            size_of.append(free)
        bins[i], places[i] = b, fill[b]
        fill[b] += size
        if free > size:
            insort(room, (free - size, b))
    final = [next(c for c in capacities if c >= f) for f in fill]
    return bins, places, np.array([final[b] for b in bins], np.int64)


#: What pack_documents() gives: a row for each sequence.
SEQUENCES = "sequence long, capacity int, length int, ids binary, pieces array<struct<doc_id:long,piece:int,start:long,length:int,place:int>>"
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("place", pa.int32())])


class _Group:
    """Pieces that are packed together, each with its ids."""

    def __init__(self, top: int) -> None:
        self.top, self.rows, self.ids, self.n_ids = top, [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for piece, start in enumerate(range(0, len(ids), self.top)):
            part = ids[start : start + self.top]
            self.rows.append((doc_id, piece, start, len(part)))
            self.ids.append(part)
        self.n_ids += len(ids)

    def sequences(self, first: int, capacities: tuple[int, ...], overhead: int) -> pa.RecordBatch:
        """The group's sequences, numbered from ``first``."""
        bins, places, final = pack(np.array([r[3] for r in self.rows], np.int64), capacities, overhead)
        order = np.lexsort((places, bins))
        edge = np.flatnonzero(np.diff(bins[order], prepend=-1))
        whole = [b"".join(self.ids[i].astype("<u4").tobytes() for i in part) for part in np.split(order, edge[1:])]
        held = [{"doc_id": d, "piece": p, "start": s, "length": n, "place": int(places[i])} for i in order for d, p, s, n in [self.rows[i]]]
        pieces = pa.ListArray.from_arrays(pa.array([*edge, len(order)], pa.int32()), pa.array(held, _PIECE))
        columns = [pa.array(first + np.arange(len(edge))), pa.array(final[order[edge]], pa.int32()), pa.array([len(w) // 4 for w in whole], pa.int32()), pa.array(whole, pa.binary()), pieces]
        return pa.RecordBatch.from_arrays(columns, names=["sequence", "capacity", "length", "ids", "pieces"])


def pack_documents(
    docs: DataFrame,
    make: Callable,
    *args: str,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacities: tuple[int, ...] = CAPACITIES,
    overhead: int = OVERHEAD,
    group: int = GROUP,
    group_ids: int = GROUP_IDS,
) -> DataFrame:
    """Training sequences of whole documents' token ids, each document with ``end_id`` behind it: see SEQUENCES.

    make(*args) gives the tokenizer in each worker, as in tokens.encode(). One
    pass without a shuffle: a task encodes its rows, packs them by groups of
    about ``group`` pieces or ``group_ids`` ids, whichever is reached first, and
    gives whole sequences. A group costs at most one partly filled sequence.
    ``ids`` are little-endian unsigned 32-bit; in ``pieces``, by place, start
    counts ids of the document and place those of the sequence. Null and empty
    texts are an end id alone. Rows that repeat an id are packed each for itself;
    other columns are ignored; an empty table gives no sequences.
    """
    capacities = tuple(sorted(capacities))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.worker_encoder(make, *args, memory=tokens.FILE_MEMORY), np.array([end_id], "<u4")
        number, held = TaskContext.get().partitionId() << 33, _Group(capacities[-1])
        for batch in batches:
            for first, texts in tokens.slices(batch.column(1), tokens.FILE_AT_ONCE):
                flat, stops = encoder.column(texts)
                ids = batch.column(0).slice(first, len(texts)).to_pylist()
                for doc_id, a, b in zip(ids, [0, *stops[:-1].tolist()], stops.tolist()):
                    held.add(doc_id, np.concatenate([flat[a:b], end]))
                    if len(held.rows) >= group or held.n_ids >= group_ids:
                        made = held.sequences(number, capacities, overhead)
                        number, held = number + made.num_rows, _Group(capacities[-1])
                        yield made
        if held.rows:
            yield held.sequences(number, capacities, overhead)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SEQUENCES)


def pieces_of(packed: DataFrame) -> DataFrame:
    """doc_id, piece, start, length, sequence, place, capacity and the crc32 of its ids, for each piece of each document."""
    rows = packed.select("sequence", "capacity", "ids", F.explode("pieces").alias("p"))
    ids = F.substr("ids", F.col("p.place") * 4 + 1, F.col("p.length") * 4)
    return rows.select("p.doc_id", "p.piece", "p.start", F.col("p.length").cast("long").alias("length"), "sequence", F.col("p.place").cast("long").alias("place"), F.col("capacity").cast("long").alias("capacity"), F.crc32(ids).alias("ids_crc32"))
