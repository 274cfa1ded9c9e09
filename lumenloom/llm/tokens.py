"""Byte-level BPE over Arrow batches: encoding with offsets, decoding, packed files.

Texts are cut at single spaces between visible characters. A token of the
GPT-2-style pattern can start at such a space but never reach across it, so the
pieces' ids, one after the other, are the ids of the whole text, and the
tokenizers library has to encode each distinct piece only once per worker.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenloom.llm.bitpack import PackedReader, PackedWriter
from lumenloom.llm.common import materialize, qualified, shared_dir

#: Pieces of a generation that a worker remembers, and the longest that it remembers.
MEMORY, LONGEST = 200_000, 48
#: New pieces that are encoded as one run.
_RUN = 2000
#: Bytes of text that are encoded at a time.
_AT_ONCE = 4_000_000
#: The same where files or sequences are written: a task has one Python worker there, and room for more.
FILE_MEMORY, FILE_AT_ONCE = 250_000, 8_000_000
#: Bytes of a source (as its files hold it) that make one token file.
FILE_BYTES = 128 << 20
_UNSAFE = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Texts that are not simply cut at each space.
_ODD = rf" {_BLANK}|{_BLANK} |^ | $"


def cut(text: str) -> list[str]:
    """Pieces of a text; all but the first stand after one space."""
    return _CUT.split(text) if _UNSAFE.search(text) or text[:1] == " " or text[-1:] == " " else text.split(" ")


def byte_table() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id, by the byte table in reverse; characters outside it stand for themselves."""
    back = {c: b for b, c in byte_table().items()}
    out = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return out


def library_tokenizer(path: str):
    """A tokenizers.Tokenizer as a JSON file defines it: where a text holds the string of a special token, that is its id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ranks_tokenizer(path: str, pattern: str):
    """A tokenizers.Tokenizer that merges by the ranks of a .tiktoken file, each match of ``pattern`` separately."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    table = byte_table()
    named = {t: "".join(table[b] for b in t) for t in ranks}
    merges = [
        (named[t[:i]], named[t[i:]])
        for t in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(t))
        if t[:i] in ranks and t[i:] in ranks
    ]
    tok = Tokenizer(models.BPE(vocab={named[t]: r for t, r in ranks.items()}, merges=merges))
    tok.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.Split(Regex(pattern), behavior="isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tok


class PieceEncoder:
    """Encodes texts to little-endian 32-bit ids, remembering the pieces seen before.

    New pieces are encoded together, one space before each: of the ids of such a
    run those whose bytes begin with a space are where the pieces begin. Pieces
    are held in two generations of MEMORY each; what is read again moves on.
    Texts that hold the string of an added token are encoded whole.
    """

    def __init__(self, tokenizer, memory: int = MEMORY) -> None:
        self.tokenizer, self.memory = tokenizer, memory
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values() if t.content]
        self.begins = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True

    def _encode(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode_after_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space before it."""
        out: list[bytes] = []
        runs = [pieces[i : i + _RUN] for i in range(0, len(pieces), _RUN)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" " + " ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            at = np.flatnonzero(self.begins[ids]) * 4
            if len(at) == len(run) and not at[0]:
                raw = ids.tobytes()
                ends = [*at[1:].tolist(), len(raw)]
                out += [raw[x:y] for x, y in zip(at.tolist(), ends)]
            else:  # a piece with a space of its own
                out += self._encode([" " + p for p in run])
        return out

    def _after_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, each with a space before it, from memory where they are known."""
        known, old = self.young, self.old
        new = set(pieces).difference(known)
        for p in new & old.keys():
            known[p] = old[p]
        new_list = list(new - old.keys())
        known.update(zip(new_list, self._encode_after_space(new_list)))
        out = list(map(known.__getitem__, pieces))
        for p in new_list:
            if len(p) > LONGEST:
                del known[p]
        if len(known) > self.memory:
            self.old, self.young = known, {}
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)]

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list[bytes]]:
        """Which texts are cut by hand; of those that are not and then those that are, the number of pieces of each.

        Then the place of each piece in what follows: what is known of the
        distinct pieces after a space, and the ids of each text's first piece.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        for token in self.added:
            odd = odd | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        by_hand = [[t] if any(x in t for x in self.added) else cut(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        values = pa.concat_arrays([split.flatten(), pa.array([p for c in by_hand for p in c], texts.type)])
        counts = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(c) for c in by_hand], np.int64)]).astype(np.int64)
        coded = values.dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        firsts = np.cumsum(counts) - counts
        first_ids = self._encode(values.take(pa.array(firsts)).to_pylist())
        at[firsts] = len(coded.dictionary) + np.arange(len(firsts))
        return odd, counts, at, self._after_space(coded.dictionary.to_pylist()), first_ids

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null as empty) one after the other, and where each text's ids end.

        Cutting and finding the distinct pieces are Arrow's work, so Python
        handles each distinct piece of a batch once.
        """
        odd, counts, at, spaced, firsts = self._coded(texts)
        raw = spaced + firsts
        lengths = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        table = np.frombuffer(b"".join(raw), "<u4")
        n = lengths[at]
        ends = np.cumsum(n)
        ids = table[np.repeat((np.cumsum(lengths) - lengths)[at] - (ends - n), n) + np.arange(int(n.sum()))]
        # Rows that were cut by hand come last so far.
        stops = np.append(0, ends)[np.cumsum(counts)]
        starts = np.append(0, stops[:-1])
        order = np.empty(len(odd), np.int64)
        order[np.concatenate([np.flatnonzero(~odd), np.flatnonzero(odd)])] = np.arange(len(odd))
        if odd.any():
            ids = np.concatenate([ids[starts[i] : stops[i]] for i in order])
        return ids, np.cumsum((stops - starts)[order])


@functools.cache
def worker_encoder(make: Callable, *args: str, memory: int = MEMORY) -> PieceEncoder:
    """One encoder per worker process and vocabulary."""
    return PieceEncoder(make(*args), memory)


@functools.cache
def _table(make: Callable, *args: str) -> list[bytes]:
    return token_bytes(make(*args).get_vocab(with_added_tokens=True))


def slices(column: pa.Array, at_once: int = _AT_ONCE) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of texts and their first rows, a bounded number of bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        base = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, base + at_once, "right")))
        stop = min(stop, first + 20_000)
        yield first, column.slice(first, stop - first)
        first = stop


def encode(docs: DataFrame, make: Callable, *args: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``, an array of ints, for each whole text (null as empty).

    make(*args) gives the tokenizers.Tokenizer, in each worker; see
    library_tokenizer and ranks_tokenizer. With ``offsets``, ``token_starts``
    has the place of the character in which each token begins: a token that
    begins inside a character's bytes has that character's place.
    A column named token_ids or token_starts of ``docs`` is replaced.
    """
    keep = [c for c in docs.columns if c not in ("token_ids", "token_starts")]
    source = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    fields = docs.select(*[docs[c] for c in keep]).schema.add("token_ids", T.ArrayType(T.IntegerType()))
    if offsets:
        fields = fields.add("token_starts", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(make, *args)
        lengths = np.array([len(b) for b in _table(make, *args)], np.int64) if offsets else None
        for batch in batches:
            for first, texts in slices(batch.column(len(keep))):
                flat, stops = encoder.column(texts)
                ends = np.append(0, stops).astype(np.int32)
                part = batch.slice(first, len(texts))
                columns = [*part.columns[: len(keep)], pa.ListArray.from_arrays(ends, pa.array(flat.view(np.int32), pa.int32()))]
                if offsets:
                    starts = [char_starts(t.as_py() or "", flat[a:b], lengths) for t, a, b in zip(texts, ends[:-1], ends[1:])]
                    columns.append(pa.array(starts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=fields.names)

    return source.mapInArrow(run, fields)


def char_starts(text: str, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The place of the character that holds each token's first byte."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    char_of = np.cumsum((raw & 0xC0) != 0x80) - 1  # by byte
    starts = np.cumsum(lengths[ids]) - lengths[ids]
    return char_of[starts].astype(np.int32)


def decode(encoded: DataFrame, make: Callable, *args: str, ids_col: str = "token_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the bytes of the ids; a null array gives null, an unknown id an error.

    Bytes, not text: an id may hold a part of a character. decode_text() puts
    the parts of a stream of ids together.
    """
    keep = [c for c in encoded.columns if c != "decoded"]
    fields = encoded.select(*keep).schema.add("decoded", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(make, *args)
        flat = np.frombuffer(b"".join(table), np.uint8)
        lengths = np.array([len(t) for t in table], np.int64)
        starts = np.cumsum(lengths) - lengths
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                values = part.column(keep.index(ids_col))
                counts = pc.fill_null(pc.list_value_length(values), 0).to_numpy(zero_copy_only=False)
                ids = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and ids.min() < 0:
                    raise IndexError(f"no such id: {ids.min()}")
                n = lengths[ids]
                ends = np.cumsum(n)
                raw = flat[np.repeat(starts[ids] - (ends - n), n) + np.arange(int(n.sum()))]
                offsets = np.append(0, np.append(0, ends)[np.cumsum(counts)]).astype(np.int32)
                valid = values.is_valid().to_numpy(zero_copy_only=False)
                out = pa.Array.from_buffers(pa.binary(), len(part), [pa.py_buffer(np.packbits(valid, bitorder="little").tobytes()), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=fields.names)

    return encoded.select(*keep).mapInArrow(run, fields)


def decode_text(parts: Iterator[bytes]) -> Iterator[str]:
    """Text of consecutive tokens' bytes; a character split over tokens comes out with its last byte."""
    import codecs

    d = codecs.getincrementaldecoder("utf-8")("replace")
    for p in parts:
        yield d.decode(p)
    yield d.decode(b"", True)


def source_bytes(texts: DataFrame) -> int:
    """The optimizer's estimate of the size of one column of text, or, where it knows none, the counted bytes."""
    guess = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess < 1 << 60:
        return guess
    return texts.agg(F.sum(F.octet_length(texts.columns[0]))).first()[0] or 0


def write_token_files(
    docs: DataFrame,
    make: Callable,
    *args: str,
    vocabulary: int,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    files: int | None = None,
) -> DataFrame:
    """Encode whole texts, add ``end_id`` to each, and write packed files in ascending order of ids.

    Returns the manifest, one row per file: file (its number in order), path,
    n_docs, n_tokens and start, the number of ids in all files before it.
    Documents are dealt by ranges of (id, hash of the text), so that one id can
    fill several files; rows without an id come first, rows of one id are in
    order of the hash. Each id takes the bits that ``vocabulary`` needs. Without
    ``files`` there is one for each FILE_BYTES of the source, and not fewer than
    shuffle partitions.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else shared_dir(spark)
    files = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-source_bytes(docs.select(text_col)) // FILE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number, out = worker_encoder(make, *args, memory=FILE_MEMORY), TaskContext.get().partitionId(), None
        end = np.array([end_id], "<u4")
        for batch in batches:
            for first, texts in slices(batch.column(1), FILE_AT_ONCE):
                if out is None:
                    out = PackedWriter(folder, f"tokens-{number:06d}", vocabulary)
                ids = batch.column(0).slice(first, len(texts)).to_pylist()
                flat, stops = encoder.column(texts)
                for doc_id, a, b in zip(ids, [0, *stops[:-1].tolist()], stops.tolist()):
                    out.add(doc_id, np.concatenate([flat[a:b], end]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file": [number], "path": [out.path], "n_docs": [out.n_docs], "n_tokens": [out.n_ids]},
                pa.schema([("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    manifest = materialize(ordered.select("doc_id", "text").mapInArrow(run, "file long, path string, n_docs long, n_tokens long"))
    # One row per file: the running sum over them is a handful of numbers at any input size.
    sums, start = [], 0
    for r in manifest.orderBy("file").toLocalIterator():
        sums.append((r.file, r.path, r.n_docs, r.n_tokens, start))
        start += r.n_tokens
    return spark.createDataFrame(sums, "file long, path string, n_docs long, n_tokens long, start long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with PackedReader(path) as reader:
                    for ids, starts, values in reader.documents():
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(ids, pa.int64()),
                                pa.array([base + s for s in starts], pa.int64()),
                                pa.array([len(v) for v in values], pa.int64()),
                                pa.array([v.astype("<u4").tobytes() for v in values], pa.binary()),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    n = max(1, manifest.count())
    dealt = manifest.select("path", "start", "file").repartitionByRange(n, "file").select("path", "start")
    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
