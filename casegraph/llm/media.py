"""Media columns: content-addressed payloads in tar shards, with digest, offset and length in the rows.

``store`` writes each payload as an 8-bit RGB image (PNG, 64 pixels or 192 samples a line: deflate keeps every sample)
into tar files in the shared folder, named by the payload's SHA-256. Each task writes its own shards, so nothing is
shuffled; a shard holds a payload once, however many rows have it. A retried task writes under another name, and
only the names of the attempt that succeeded are in the rows. ``read_headers`` fills columns about the media from
the first 33 bytes of each member; ``read_payloads`` reads whole members back and computes features.

Files are opened through pyarrow's file systems by the URI of the shared folder.

Defined results: a null or empty text is one line of 192 spaces; equal payloads have equal values, repeated rows
too; an empty table gives no shard; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegraph.llm.common import materialise, scratch, text_bytes, text_or_empty

WIDTH, CHANNELS = 64, 3
LINE = WIDTH * CHANNELS
PNG_HEAD = 33  # signature (8), then the IHDR chunk (25)
MANIFEST = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
HEADER = MANIFEST + ", media_type string, width int, height int, bit_depth int, channels int"
FEATURES = HEADER + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def pad(data: bytes) -> bytes:
    """Spaces are appended up to a positive multiple of a line's samples."""
    lines = max(1, -(-len(data) // LINE))
    return data.ljust(lines * LINE, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    lines = np.zeros((len(payload) // LINE, LINE + 1), dtype=np.uint8)  # a line's first byte: no filter
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(-1, LINE)
    head = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and channels, from the first 33 bytes."""
    if head[:8] != b"\x89PNG\r\n\x1a\n" or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not the start of a PNG file")
    width, height, depth, colour = struct.unpack(">IIBB", head[16:26])
    return width, height, depth, {0: 1, 2: 3, 4: 2, 6: 4}[colour]


def decode_png(media: bytes) -> bytes:
    """The samples of an image as ``encode_png`` writes it; each chunk's checksum is verified."""
    width, height, depth, channels = png_header(media[:PNG_HEAD])
    at, packed = 8, []
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"checksum of {kind!r}")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width * channels + 1)
    if depth != 8 or lines[:, 0].any():
        raise ValueError("not 8-bit samples without filters")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and deviation of the samples, and 64 bits: which of 64 equal stretches are brighter than the whole."""
    x = np.frombuffer(payload, dtype=np.uint8)
    at = np.arange(65) * len(x) // 64
    sums = np.add.reduceat(x.astype(np.int64), at[:-1])
    bits = np.packbits(sums * len(x) > x.sum(dtype=np.int64) * np.diff(at)).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};ahash={bits}"


def tar_header(name: str, size: int) -> bytes:
    """A ustar header block."""
    octal = lambda n, width: b"%0*o\0" % (width - 1, n)
    length = octal(size, 12) if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    fields = [name.encode().ljust(100, b"\0"), octal(0o644, 8), octal(0, 8), octal(0, 8), length, octal(0, 12), b" " * 8, b"0", b"\0" * 100, b"ustar\x0000", b"\0" * 247]
    block = b"".join(fields).ljust(512, b"\0")
    return block[:148] + b"%06o\0 " % sum(block) + block[156:]


class _Shard:
    def __init__(self, fs: pafs.FileSystem, folder: str):
        self.path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tar"
        self.out, self.at, self.members = fs.open_output_stream(self.path), 0, {}

    def put(self, digest: str, payload: bytes) -> tuple[int, int]:
        if digest not in self.members:
            media = encode_png(payload)
            self.out.write(tar_header(f"{digest}.png", len(media)))
            self.out.write(media.ljust(-(-len(media) // 512) * 512, b"\0"))
            self.members[digest] = (self.at + 512, len(media))
            self.at += 512 + -(-len(media) // 512) * 512
        return self.members[digest]

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def store(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 256 << 20) -> DataFrame:
    """Write the shards and return the manifest (a table in the shared folder): doc_id, n_bytes, digest, shard, offset, length."""
    folder = folder or scratch(docs.sparkSession, "media")
    names, types = ["doc_id", "n_bytes", "digest", "shard", "offset", "length"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        shard = None
        for b in batches:
            rows = []
            for doc_id, data in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True):
                if shard is None:
                    fs.create_dir(root, recursive=True)
                    shard = _Shard(fs, root)
                payload = pad(data)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((doc_id, len(data), digest, shard.path.rpartition("/")[2], *shard.put(digest, payload)))
                if shard.at >= shard_bytes:
                    shard.close()
                    shard = None
            if rows:
                yield _table(rows, names, types)
        if shard:
            shard.close()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    manifest = materialise(slim.mapInArrow(run, MANIFEST), "manifest")
    return manifest.withColumn("shard", F.concat(F.lit(folder.rstrip("/") + "/"), "shard"))


class _Reader:
    """Range reads; the last shard stays open, as a shard's rows follow one another."""

    def __init__(self):
        self.uri, self.file = None, None

    def __call__(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            if self.file:
                self.file.close()
            fs, path = pafs.FileSystem.from_uri(uri)
            self.uri, self.file = uri, fs.open_input_file(path)
        return self.file.read_at(length, offset)


def read_headers(manifest: DataFrame) -> DataFrame:
    """The manifest with media_type, width, height, bit_depth and channels, from range reads of 33 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known, of = _Reader(), {}, None
        for b in batches:
            rows = []
            for uri, offset in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True):
                if uri != of:
                    of, known = uri, {}
                if offset not in known:
                    known[offset] = png_header(read(uri, offset, PNG_HEAD))
                rows.append(("image/png", *known[offset]))
            if rows:
                extra = [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), [pa.string(), *[pa.int32()] * 4], strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, "media_type", "width", "height", "bit_depth", "channels"])

    return manifest.mapInArrow(run, HEADER)


def read_payloads(rows: DataFrame) -> DataFrame:
    """Rows of ``read_headers`` with what whole members show: sizes, digests and the feature of what was read back."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, known, of = _Reader(), {}, None
        for b in batches:
            out = []
            for uri, offset, length in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length")), strict=True):
                if uri != of:
                    of, known = uri, {}
                if offset not in known:
                    media = read(uri, offset, length)
                    payload = decode_png(media)
                    known[offset] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload))
                out.append(known[offset])
            if out:
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names=[*b.schema.names, *names])

    return rows.mapInArrow(run, FEATURES)


def by_shard(manifest: DataFrame) -> DataFrame:
    """The manifest with a task a shard, in the order of its members: a few MB of rows stand for many GB of media."""
    shards = manifest.select("shard").distinct().count()
    return manifest.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "offset")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, then read back: the columns of the contract, then the media's own."""
    full = read_payloads(read_headers(by_shard(store(docs, id_col=id_col, text_col=text_col))))
    return full.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "width", "height", "bit_depth", "channels")
