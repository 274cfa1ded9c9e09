"""WARC archives in Zstandard: a dictionary in front, every record a frame of its own."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import Scratch, materialize, qualified, shared_dir
from lumenloom.llm.files import create, open_random

#: The skippable frame that holds a dictionary in a .warc.zst file.
DICT_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records from which the dictionary is built, at most; larger payloads are left out of it.
SAMPLE, SAMPLE_BYTES, DICT_BYTES = 400, 20_000, 64 << 10
_READ = 8 << 10


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload: bytes) -> str:
    """The page's id as a uuid; for a page without one, a uuid of the payload."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, payload_digest(payload))}>"
    return f"<urn:uuid:{uuid.UUID(int=page_id & 0xFFFFFFFFFFFFFFFF)}>"


def page_of(urn: str) -> int:
    n = uuid.UUID(urn[10:-1]).int
    return n - (1 << 64) if n >> 63 else n


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit has the HTTP head alone, which still tells the full length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, payload)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        clean = "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in url)
        head.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to, b'')}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (names in lower case) and the HTTP body."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(warc["content-length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    return warc, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, body


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; of samples too few to train on, their own bytes."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)


def frames(f) -> Iterator[bytes]:
    """The records of an archive, one after the other; memory holds one of them."""
    magic, n = struct.unpack("<II", f.read(8))
    if magic != DICT_FRAME:
        raise ValueError("no dictionary in front")
    raw = f.read(n)
    if raw[:4] == zstandard.FRAME_HEADER:
        raw = zstandard.ZstdDecompressor().decompress(raw)
    d = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)) if raw else zstandard.ZstdDecompressor()
    rest = f.read(_READ)
    while rest:
        one, out = d.decompressobj(), io.BytesIO()
        while not one.eof:
            out.write(one.decompress(rest))
            rest = one.unused_data if one.eof else f.read(_READ)
            if not rest and not one.eof:
                raise ValueError("the archive ends inside a record")
        yield out.getvalue()
        rest = rest or f.read(_READ)


def _payload_hash(html_col: str):
    return F.sha1(F.coalesce(F.col(html_col), F.lit("")).cast("binary"))


def revisits(pages: DataFrame, id_col: str, html_col: str, least_bytes: int, tables: Scratch) -> DataFrame:
    """page_id, hash (hex SHA-1 of the payload) and refers_to of the pages that are revisits.

    Only ids and hashes are shuffled. The newest page of each hash comes from a
    partial aggregate, and the join back reads written tables on both sides.
    """
    length = F.octet_length(F.coalesce(F.col(html_col), F.lit("")))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), _payload_hash(html_col).alias("hash"), length.alias("n"))
    large = tables.write(rows.where(F.col("n") >= least_bytes).select("page_id", "hash"))
    newest = tables.write(
        large.groupBy("hash").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL").select("hash", "refers_to")
    )
    return (
        large.join(newest, "hash")
        .where(F.col("page_id").isNull() | (F.col("page_id") < F.col("refers_to")))
        .select("page_id", "hash", "refers_to")
        .distinct()
    )


def write_archives(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    folder: str | None = None,
    level: int = 3,
) -> DataFrame:
    """Write a record per row of ``pages`` to .warc.zst files; returns path and n_records of each.

    Of the pages whose payloads (html in UTF-8, null as empty) are equal and
    have at least ``least_bytes`` bytes, the one with the largest id is a
    response and the others revisit it; shorter ones are all responses. Rows
    that repeat that largest id are all responses. A page without an id revisits
    an equal page that has one, else it is a response. The dictionary is built
    from up to SAMPLE records, which is all that the driver sees. An empty table
    gives no files. Other columns are ignored.
    """
    folder = qualified(pages.sparkSession, folder) if folder else shared_dir(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    few = rows.where(F.col("page_id").isNotNull() & (F.octet_length("html") <= SAMPLE_BYTES)).select("page_id").distinct()
    chosen = [r.page_id for r in few.orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE).collect()]
    sampled = rows.where(F.col("page_id").isin(chosen) & (F.octet_length("html") <= SAMPLE_BYTES)).limit(2 * SAMPLE).collect()
    texts = [(r.page_id, r.url, r.html.encode("utf-8", "surrogatepass")) for r in sampled]
    texts.sort()
    dictionary = train_dictionary([build_record(i, u, p, payload_digest(p), None, date) for i, u, p in texts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, path = None, 0, ""
        for batch in batches:
            for page_id, url, html, to in zip(*batch.columns):
                if out is None:
                    path, out = create(folder, f"pages-{TaskContext.get().partitionId():06d}", ".warc.zst")
                    out.write(struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary)
                    data = _dictionary(dictionary) if dictionary else None
                    squeeze = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                out.write(squeeze.compress(build_record(page_id.as_py(), url.as_py(), payload, payload_digest(payload), to.as_py(), date)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    with Scratch(pages.sparkSession) as tables:
        again = revisits(pages, id_col, html_col, least_bytes, tables).toDF("again_id", "again_hash", "refers_to")
        typed = rows.withColumn("hash", _payload_hash("html")).join(
            again, F.col("page_id").eqNullSafe(F.col("again_id")) & (F.col("hash") == F.col("again_hash")), "left"
        )
        return materialize(typed.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, n_records long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null: revisit) of each record.

    A response whose payload does not have its digest is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_random(path) as f:
                    for raw in frames(f):
                        warc, http, body = parse_record(raw)
                        digest, kind = warc["warc-payload-digest"].removeprefix("sha1:"), warc["warc-type"]
                        if kind == "response" and payload_digest(body) != digest:
                            raise ValueError(f"a damaged record in {path}")
                        page = int(warc["x-page-id"]) if "x-page-id" in warc else None
                        to = page_of(warc["warc-refers-to"]) if kind == "revisit" else None
                        rows.append((page, warc.get("warc-target-uri"), int(http["content-length"]), digest, kind, to, body if kind == "response" else None))
                        size += len(body)
                        if size > 8 << 20 or len(rows) == 5000:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    n = max(1, manifest.count())
    dealt = manifest.select("path").repartitionByRange(n, "path")
    return dealt.mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    )
