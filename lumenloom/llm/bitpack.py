"""Token files: ids in fixed-width bit fields, in blocks that can be read alone.

Layout: the blocks, then a footer, then the footer's place (8 bytes) and MAGIC.
A block holds ``block_ids`` ids (the last one may hold fewer), each in ``bits``
bits, least significant bit first, filled up to a whole byte. The footer is five
unsigned 64-bit numbers (bits, block_ids, blocks, documents, ids), then the byte
offset of each block, then each document's id, validity and first id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lumenloom.llm.files import create, open_random

MAGIC = b"LLBITS01"
BLOCK_IDS = 65_536


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 to vocabulary - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids[:, None].astype(np.uint32) >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (fields.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class PackedWriter:
    def __init__(self, folder: str, stem: str, vocabulary: int, block_ids: int = BLOCK_IDS) -> None:
        self.bits, self.block_ids, self.top = bits_for(vocabulary), block_ids, vocabulary
        self.path, self.out = create(folder, stem, ".bits")
        self.waiting, self.n_waiting, self.at = [], 0, 0
        self.offsets, self.ids, self.valid, self.starts, self.n_ids = [], [], [], [], 0

    @property
    def n_docs(self) -> int:
        return len(self.ids)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >= self.top:
            raise ValueError(f"id {ids.max()} is not below {self.top}")
        self.ids.append(doc_id or 0), self.valid.append(doc_id is not None), self.starts.append(self.n_ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= self.block_ids:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(flat) if last else len(flat) // self.block_ids * self.block_ids
        for i in range(0, whole, self.block_ids):
            raw = pack(flat[i : min(whole, i + self.block_ids)], self.bits)
            self.offsets.append(self.at)
            self.out.write(raw)
            self.at += len(raw)
        self.waiting = [flat[whole:]]
        self.n_waiting = len(flat) - whole

    def close(self) -> None:
        self._flush(True)
        head = np.array([self.bits, self.block_ids, len(self.offsets), len(self.ids), self.n_ids], "<u8")
        for part in (head, np.array(self.offsets, "<u8"), np.array(self.ids, "<i8"), np.array(self.valid, "u1"), np.array(self.starts, "<u8")):
            self.out.write(part.tobytes())
        self.out.write(np.array([self.at], "<u8").tobytes() + MAGIC)
        self.out.close()


class PackedReader:
    """Random access to the ids and documents of one file."""

    def __init__(self, path: str) -> None:
        self.f = open_random(path)
        size = self.f.size()
        tail = self.f.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.end = int(np.frombuffer(tail[:8], "<u8")[0])
        foot = self.f.read_at(size - 16 - self.end, self.end)
        self.bits, self.block_ids, blocks, docs, self.n_ids = map(int, np.frombuffer(foot, "<u8", 5))
        at = 40
        self.offsets = np.frombuffer(foot, "<u8", blocks, at)
        self.doc_ids = np.frombuffer(foot, "<i8", docs, at + 8 * blocks)
        self.valid = np.frombuffer(foot, "u1", docs, at + 8 * (blocks + docs))
        self.starts = np.frombuffer(foot, "<u8", docs, at + 8 * (blocks + docs) + docs).astype(np.int64)

    def __enter__(self) -> PackedReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.f.close()

    def block(self, b: int) -> np.ndarray:
        first = int(self.offsets[b])
        last = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
        n = min(self.block_ids, self.n_ids - b * self.block_ids)
        return unpack(self.f.read_at(last - first, first), n, self.bits)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop; only their blocks are read."""
        if stop <= start:
            return np.empty(0, np.uint32)
        b, c = start // self.block_ids, (stop - 1) // self.block_ids
        flat = np.concatenate([self.block(i) for i in range(b, c + 1)])
        return flat[start - b * self.block_ids : stop - b * self.block_ids]

    def documents(self, at_once: int = 1_000_000) -> Iterator[tuple[list, list, list]]:
        """Lists of document ids, first ids and arrays of ids, about ``at_once`` ids at a time."""
        bounds = np.append(self.starts, self.n_ids)
        d = 0
        while d < len(self.doc_ids):
            e = max(d + 1, int(np.searchsorted(bounds, bounds[d] + at_once, "right")) - 1)
            flat = self.ids(int(bounds[d]), int(bounds[e]))
            cuts = bounds[d : e + 1] - bounds[d]
            yield (
                [int(i) if ok else None for i, ok in zip(self.doc_ids[d:e], self.valid[d:e])],
                [int(s) for s in bounds[d:e]],
                [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])],
            )
            d = e
