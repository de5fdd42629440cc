"""Media columns: content-addressed payloads in tar shards.

A payload is stored as an 8-bit grey PNG under its SHA-256. Tasks write tar shards; rows carry the digest, the shard,
and offset and length of the PNG in it. A PNG's first 33 bytes say how wide, high and deep it is: range reads of these
alone fill the metadata columns. A range read of the whole gives the payload back, from which features are computed.

A task stores a payload once. Tasks don't wait for each other, so a payload that several of them met is stored by
each; one place, the least, stands for the digest in every row, and the others are referred to by none.
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
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrecall.llm.common import bounded_batches, documents, join_once, materialize, new_folder

UNIT = 64
#: Signature and IHDR, with its checksum.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of UNIT."""
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def width_of(n: int) -> int:
    """The widest row of at most 2048 samples that is a multiple of UNIT and divides n."""
    units = n // UNIT
    return UNIT * next(d for d in range(min(32, units), 0, -1) if units % d == 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, row by row, unfiltered."""
    width = width_of(len(payload))
    height = len(payload) // width
    lines = np.zeros((height, width + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, width)
    ihdr = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", ihdr) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def header(first: bytes) -> tuple[int, int, int, int]:
    """(width, height, bit depth, colour type) from the first HEADER bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIBB", first[16:26])


def decode(png: bytes) -> bytes:
    """The samples of an 8-bit grey PNG as `encode` writes it; checksums are verified."""
    width, height, depth, colour = header(png)
    at, data = 8, []
    while at < len(png):
        n = struct.unpack(">I", png[at : at + 4])[0]
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", png[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey PNG")
    return lines[:, 1:].tobytes()


def feature(payload: bytes, width: int, height: int) -> str:
    """Size, mean and deviation of the samples, and the eighths of a byte's range they fall in, in per mille."""
    x = np.frombuffer(payload, np.uint8)
    shares = np.bincount(x >> 5, minlength=8) * 1000 // len(x)
    return f"grey8 {width}x{height} mean={x.mean():.3f} std={x.std():.3f} eighths={'/'.join(map(str, shares))}"


def _open(folder: str):
    """The file system of a folder and the folder's path in it. Spark's names of object stores are Arrow's of the same."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = folder.partition(":")
    return FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "abfss": "abfs"}.get(scheme, scheme) + colon + rest)


def store(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", shard_bytes: int = 1 << 30) -> DataFrame:
    """Writes every payload to tar shards in `folder`, which all machines share, and returns the index:
    (key, n_bytes, payload_bytes, digest, shard, offset, length).

    An attempt at a task writes shards of its own names, so a task that is run again leaves files that no row of the
    returned table refers to. The table is written to the shared folder once, before it is returned.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, shard, at = None, "", 0
        seen: dict[bytes, tuple[str, int, int]] = {}
        for batch in batches:
            found = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                payload = padded(raw)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if out is None or at > shard_bytes:
                        if out is not None:
                            out.write(bytes(1024))
                            out.close()
                        shard, at = f"shard-{uuid.uuid4().hex}.tar", 0
                        out = fs.open_output_stream(f"{base}/{shard}")
                    png = encode(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(png)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + png + bytes(-len(png) % 512))
                    seen[digest] = (shard, at + len(head), len(png))
                    at += len(head) + len(png) + (-len(png) % 512)
                found.append((k, len(raw), len(payload), digest.hex(), *seen[digest]))
            columns = list(zip(*found, strict=True)) if found else [[]] * 7
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(columns, kinds, strict=True)], names=[key, "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"])
        if out is not None:
            out.write(bytes(1024))
            out.close()

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return materialize(docs.select(key, text).mapInArrow(write, f"`{key}` {kind}, n_bytes bigint, payload_bytes bigint, digest string, shard string, offset bigint, length bigint"), "index")


def places(index: DataFrame) -> DataFrame:
    """One row (digest, shard, offset, length) for each digest, in the order of the shards."""
    least = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at"))
    return least.select("digest", "at.*").repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(places_: DataFrame, folder: str, read, schema: str) -> DataFrame:
    """`read(digest, range)` for each place, where range(n) gives the first n bytes of it, or all."""
    names = [x.split()[0] for x in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        name, file = "", None
        for batch in batches:
            rows = []
            for digest, shard, offset, length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != name:
                    if file is not None:
                        file.close()
                    name, file = shard, fs.open_input_file(f"{base}/{shard}")
                rows.append(read(digest, lambda n=None: file.read_at(length if n is None else min(n, length), offset)))  # noqa: B023
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema([(x.split()[0], {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in schema.split(", ")]))
        if file is not None:
            file.close()

    return places_.select("digest", "shard", "offset", "length").mapInArrow(walk, schema)


def metadata(places_: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bit_depth), from the headers alone."""
    return _ranges(places_, folder, lambda digest, some: (digest, *header(some(HEADER))[:3]), "digest string, width int, height int, bit_depth int")


def read_back(places_: DataFrame, folder: str) -> DataFrame:
    """(digest, width, height, bit_depth, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the
    stored bytes. The header is read before the rest, and what it says is held against the samples."""

    def one(digest, some):
        width, height, depth, _ = header(some(HEADER))
        png = some()
        payload = decode(png)
        if len(payload) != width * height:
            raise ValueError("the header does not fit the samples")
        return (digest, width, height, depth, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(png), hashlib.sha256(png).hexdigest(), feature(payload, width, height))

    return _ranges(places_, folder, one, "digest string, width int, height int, bit_depth int, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload_bytes, digest, shard, offset, length, and the columns of read_back).

    Null texts are empty. Equal texts have equal values in every column but the key. Keys may be null or repeat; other
    columns are ignored. An empty table gives no rows and no shards.
    """
    folder = folder or new_folder(docs.sparkSession, "media")
    index = store(docs, folder, key, text)
    where = materialize(places(index), "places")
    # rows of one text, such as empty ones, can be many: a frequent digest's columns are broadcast
    told = materialize(where.join(read_back(where, folder), "digest").join(index.groupBy("digest").agg(F.count("*").alias("n")), "digest"), "told")
    return join_once(index.select(key, "n_bytes", "payload_bytes", "digest"), told, ["digest"], index.count())


def op2_tar_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length", "width", "height")
