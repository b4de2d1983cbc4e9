"""Media columns: texts as 8-bit samples, content-addressed in tar shards.

Each payload (a text's UTF-8 bytes, zeros up to a positive multiple of the row width) becomes an 8-bit greyscale PNG,
one byte a sample, named by the SHA-256 of its payload. Every task writes the images of its rows into tar shards in the
shared folder, each content once a shard; rows carry digest, shard, offset and length. A reader then fetches the 33
bytes of an image's header for the metadata columns and the image itself for its samples, by range reads only.

A shard is written under a name of its own by each task attempt, and a row names the shard of the attempt that counted,
so lost executors and repeated attempts leave at worst files that no row names. Null texts are empty, and an empty text
is one row of zeros. Repeated rows and equal texts give equal values, null ids come back as null; columns other than
doc_id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from compval.llm.common import documents, fresh_path, rows_out, slices

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Bytes of a PNG up to the end of its first chunk: size, depth and colour type.
HEADER = 33


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, width: int = 64, level: int = 1) -> bytes:
    """payload as an image of 8-bit samples; its length is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)  # each line starts with its filter, 0 for none
    lines[:, 1:] = rows
    return MAGIC + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from an image's first HEADER bytes."""
    if head[:8] != MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    width, height, bits, colour = struct.unpack(">IIBB", head[16:26])
    if colour != 0:
        raise ValueError("not greyscale")
    return width, height, bits


def from_png(data: bytes) -> bytes:
    """The samples of an image that to_png() made."""
    width, height, _ = png_header(data[:HEADER])
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a Hadoop-style address and the path within it. Executors have no JVM to open Spark's own with, so
    the names that Hadoop has for an object store are taken for that store's."""
    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest if rest else uri)


class Shard:
    """A tar file that grows member by member and tells where each one's bytes are."""

    def __init__(self, root: str):
        self.files, folder = opened(root)
        self.files.create_dir(folder, recursive=True)
        name = f"shard-{uuid.uuid4().hex}.tar"
        self.uri, self.out, self.size = f"{root}/{name}", self.files.open_output_stream(f"{folder}/{name}"), 0
        self.held: dict[str, tuple[int, int]] = {}

    def add(self, digest: str, data: bytes) -> tuple[int, int]:
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        self.held[digest] = (self.size + len(head), len(data))
        self.size += len(head) + len(data) + -len(data) % 512
        return self.held[digest]

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


INDEX = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write_media(docs: DataFrame, root: str, shard_bytes: int = 256 << 20, shard_rows: int = 200_000, unit: int = 64) -> DataFrame:
    """Stores each text in shards under root; the rows that name them are written and read back, so shards are written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                raw = text.encode()
                payload = padded(raw, unit)
                digest = hashlib.sha256(payload).hexdigest()
                if shard is None:
                    shard = Shard(f"{root}/shards")
                at = shard.held.get(digest) or shard.add(digest, to_png(payload, unit))
                rows.append((doc, len(raw), digest, shard.uri, *at))
                if shard.size >= shard_bytes or len(rows) >= shard_rows:
                    shard.close()
                    yield rows_out(INDEX, rows)
                    shard, rows = None, []
        if shard:
            shard.close()
            yield rows_out(INDEX, rows)

    index = documents(docs).mapInArrow(run, "doc_id long, n_bytes long, digest string, shard string, offset long, length long")
    index.write.parquet(f"{root}/index")
    return docs.sparkSession.read.schema(index.schema).parquet(f"{root}/index")


FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int64()), ("height", pa.int64())]
)


def feature(samples: np.ndarray) -> str:
    """Sum of the samples and how many fall in each eighth of the range."""
    return f"{int(samples.sum(dtype=np.int64))}:" + ",".join(map(str, np.bincount(samples >> 5, minlength=8).tolist()))


def read_media(index: DataFrame, unit: int = 64) -> DataFrame:
    """What the stored bytes say: metadata from the header's range, digests and features from the image's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, file, known = None, None, {}
        for b in batches:
            rows = []
            for doc, n, digest, shard, offset, length in zip(*(c.to_pylist() for c in b.columns)):
                if shard != uri:
                    files, path = opened(shard)
                    uri, file, known = shard, files.open_input_file(path), {}
                if offset not in known:
                    width, height, _ = png_header(file.read_at(HEADER, offset))
                    data = file.read_at(length, offset)
                    payload = from_png(data)
                    got = hashlib.sha256(payload).hexdigest()
                    if got != digest:
                        raise ValueError(f"{shard} at {offset} doesn't hold {digest}")
                    known[offset] = (len(payload), got, zlib.crc32(payload[-unit:]), len(data), hashlib.sha256(data).hexdigest(), feature(np.frombuffer(payload, np.uint8)), width, height)
                rows.append((doc, n, *known[offset]))
            yield rows_out(FEATURES, rows)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
    return index.mapInArrow(run, kinds)


def media_digests(docs: DataFrame) -> DataFrame:
    return read_media(write_media(docs, fresh_path(docs.sparkSession, "media")))
