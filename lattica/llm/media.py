"""Media columns: content-addressed payloads in tar shards, with metadata from header-only range reads.

A payload is stored losslessly as an 8-bit grey PNG image. Each task appends the images it makes to tar shards in the
shared folder, an image that a shard has already only once, under the digest of its bytes. Rows carry the shard, and the
digest, offset and length of the stored image. Metadata columns need the first HEADER bytes of an image alone; features
need it all. Shards appear under their final name when they are whole, and rows name only such shards.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.tables import settled, shared_dir, small_batches
from lattica.llm.words import chunks
from lattica.llm.workers import tidy

#: Samples in a row of the image; payloads are padded to a multiple of it.
WIDTH, PAD = 576, 255
#: Signature, then the image header chunk, fill an image's first 33 bytes.
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes after which a shard is closed, and text bytes taken at once.
SHARD, CHUNK = 128 << 20, 4 << 20


def padded(raw: bytes) -> bytes:
    return raw + bytes([PAD]) * (WIDTH - len(raw) % WIDTH if len(raw) % WIDTH or not raw else 0)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A grey 8-bit PNG, WIDTH samples wide, of a payload whose size is a positive multiple of WIDTH."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # filter type 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + _chunk(b"IEND", b"")


def read_header(raw: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth, from an image's first HEADER bytes."""
    if raw[:8] != _SIGNATURE or raw[12:16] != b"IHDR":
        raise ValueError("no image header")
    return struct.unpack(">IIB", raw[16:25])


def from_image(raw: bytes) -> bytes:
    """The payload of an image that to_image made; other PNG features aren't read."""
    width, height, depth = read_header(raw)
    at, data = 8, []
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        if zlib.crc32(raw[at + 4 : at + 8 + size]) != struct.unpack(">I", raw[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(raw[at + 8 : at + 8 + size])
        at += 12 + size
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if depth != 8 or rows[:, 0].any():
        raise ValueError("not an unfiltered 8-bit image")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Share of each of 16 value bands in thousandths, mean and deviation of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    bands = np.bincount(samples >> 4, minlength=16) * 1000 // len(samples)
    return ",".join(map(str, bands)) + f";{samples.mean():.3f};{samples.std():.3f}"


class _Shard:
    """A tar archive that is written from front to end."""

    def __init__(self, root: str):
        self.files, self.folder = fs.FileSystem.from_uri(root)
        self.files.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tar"
        self.out = self.files.open_output_stream(f"{self.folder}/.{self.name}")
        self.at, self.have = 0, {}

    def add(self, raw: bytes) -> tuple[str, int, int]:
        """Digest, offset and length of raw in this shard."""
        digest = hashlib.sha256(raw).hexdigest()
        if digest not in self.have:
            head = struct.pack("100s8s8s8s12s12s8s1s100s6s2s32s32s8s8s155s12x", digest.encode(), b"0000644", b"0000000", b"0000000", b"%011o" % len(raw), b"00000000000", b" " * 8, b"0", b"", b"ustar", b"00", b"", b"", b"", b"", b"")
            head = head[:148] + b"%06o\0 " % sum(head) + head[156:]
            self.out.write(head + raw + bytes(-len(raw) % 512))
            self.have[digest] = self.at + 512
            self.at += 512 + len(raw) + -len(raw) % 512
        return digest, self.have[digest], len(raw)

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        self.files.move(f"{self.folder}/.{self.name}", f"{self.folder}/{self.name}")


def stored(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) without text, with n_bytes, shard, media_sha256, media_offset and media_bytes.

    A null text has no bytes, and so a payload of padding alone. Equal texts have equal images. folder is a URI that
    pyarrow can open on driver and executors. A task that runs again writes shards of its own; rows name the shards of
    the run that counted, since they are written to the shared folder too before they are used.
    """
    root = folder or f"{shared_dir(small_batches(docs).sparkSession)}/media-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    names = [c for c in docs.columns if c not in ("text", "n_bytes", "shard", "media_sha256", "media_offset", "media_bytes")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "n_bytes long, shard string, media_sha256 string, media_offset long, media_bytes long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []
        for batch in batches:
            for part in chunks(batch, "raw", CHUNK):
                shard = shard or _Shard(root)
                sizes, found = [], []
                for raw in part.column("raw").to_pylist():
                    raw = raw or b""
                    sizes.append(len(raw))
                    found.append(shard.add(to_image(padded(raw))))
                digest, offset, length = zip(*found, strict=True)
                where = pa.array([shard.name] * len(found))
                waiting.append(pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sizes, pa.int64()), where, pa.array(digest), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], [*names, "n_bytes", "shard", "media_sha256", "media_offset", "media_bytes"]))
                if shard.at > SHARD:
                    shard.close()
                    yield from waiting
                    shard, waiting = None, []
        if shard:
            shard.close()
            yield from waiting

    rows = settled(docs.select(*names, F.col("text").cast("string").cast("binary").alias("raw")).mapInArrow(tidy(run), schema), "media-index")
    return rows.withColumn("shard", F.concat(F.lit(root.rstrip("/") + "/"), "shard"))


def _ranges(frame: pa.RecordBatch, most: int | None) -> Iterator[bytes]:
    """The stored bytes of each row, the first `most` only if given; a shard stays open while rows follow in it."""
    name, source = None, None
    for shard, offset, length in zip(*(frame.column(c).to_pylist() for c in ("shard", "media_offset", "media_bytes")), strict=True):
        if shard != name:
            files, path = fs.FileSystem.from_uri(shard)
            name, source = shard, files.open_input_file(path)
        yield source.read_at(length if most is None else min(most, length), offset)


def with_metadata(index: DataFrame) -> DataFrame:
    """index(shard, media_offset, media_bytes, ...) with width, height and depth, from HEADER bytes of each image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                heads = zip(*map(read_header, _ranges(batch, HEADER)), strict=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.int32()) for x in heads)], [*batch.schema.names, "width", "height", "depth"])

    return index.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields), "width int, height int, depth int"]))


def with_features(index: DataFrame) -> DataFrame:
    """index with payload_bytes, payload_sha256, tail_crc32 and feature, from whole images read back and checked."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), []
                for raw, digest in zip(_ranges(part, None), part.column("media_sha256").to_pylist(), strict=True):
                    if hashlib.sha256(raw).hexdigest() != digest:
                        raise ValueError(f"{digest} isn't what its shard holds")
                    payload = from_image(raw)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature(payload)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True))], [*part.schema.names, *names])

    return index.mapInArrow(tidy(run), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields), "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"]))
