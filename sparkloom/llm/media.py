"""Media columns: payloads as images in tar shards, addressed by their content.

A text's UTF-8 bytes, filled up with bytes 255 to a positive multiple of UNIT, are the samples of an 8-bit grey image of UNIT
columns, stored as PNG.  Each task appends the images it has not yet stored to a tar shard of its own below the shared
folder, under the name ``<sha256 of the image>.png``; rows carry digest, shard, offset and length.  A shard's name is new for
each attempt, and rows become visible only as a committed Parquet table, so what a lost attempt wrote is never referred to.

One image may lie in several shards (once for each task that met it); the least (shard, offset) serves all rows of a digest,
so nothing but small rows is shuffled and a text that fills a third of all rows is stored and read a few times only.  Metadata
columns come from the first bytes of an image, read as a range; features from reading its own range, and no other, back.

Shards are read and written through pyarrow's file systems, so the shared folder can be a mounted path, HDFS or an object
store.  Memory: about five times the longest text, and 150 bytes for each distinct text of a task.
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
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import blocks, materialize, pick, scratch

UNIT = 576  #: payloads are multiples of it; also the images' width
SHARD_BYTES = 256 << 20  #: a shard ends with the image that reaches it
READ_BYTES = 64 << 20  #: bytes of images that one reading task gets, about
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33  #: signature and IHDR chunk
CHUNK_BYTES = 1 << 24
SEGMENTS = 65

STORED = "doc_id {kind}, n_bytes long, digest string, shard string, offset long, length long"
HEADED = "digest string, shard string, offset long, length long, width long, height long, bit_depth int, colour_type int"
READ = HEADED + ", payload_sha256 string, tail_crc32 long, media_sha256 string, feature string"


def payload(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(samples: bytes) -> bytes:
    """An 8-bit grey PNG of UNIT columns, one unfiltered line for each UNIT samples."""
    height = len(samples) // UNIT
    lines = np.zeros((height, UNIT + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(height, UNIT)
    packed = zlib.compress(lines.tobytes(), 6)
    parts = [_chunk(b"IDAT", packed[i : i + CHUNK_BYTES]) for i in range(0, len(packed), CHUNK_BYTES)]
    return b"".join([SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, height, 8, 0, 0, 0, 0)), *parts, _chunk(b"IEND", b"")])


def header(first: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type, from an image's first HEADER_BYTES bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("no PNG image at this offset")
    return struct.unpack(">IIBB", first[16:26])


def decode(image: bytes) -> bytes:
    """The samples of an image as encode writes it; each chunk's checksum is tested."""
    width, height, depth, colour = header(image[:HEADER_BYTES])
    at, packed = HEADER_BYTES, []
    while (kind := image[at + 4 : at + 8]) != b"IEND":
        n = struct.unpack(">I", image[at : at + 4])[0]
        data = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("an image's chunk is damaged")
        packed.append(data)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("not an unfiltered 8-bit grey image")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """A difference hash (64 bits: does the next of 65 equal segments have a greater mean?), the mean and the number of
    different values, of the samples."""
    x = np.frombuffer(samples, np.uint8)
    cuts = np.arange(SEGMENTS + 1) * len(x) // SEGMENTS
    means = np.add.reduceat(x, cuts[:-1], dtype=np.int64) * 1000 // np.diff(cuts)
    bits = int("".join("01"[b] for b in (means[1:] > means[:-1]).astype(int)), 2)
    return f"{bits:016x}:{int(x.sum(dtype=np.int64)) * 1000 // len(x)}:{len(np.unique(x))}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it that uri names; s3a and s3n are names of s3."""
    for alias in ("s3a://", "s3n://"):
        uri = uri.replace(alias, "s3://", 1) if uri.startswith(alias) else uri
    return pafs.FileSystem.from_uri(uri)


class Shards:
    """Appends images to tar files below folder; a new one begins when the last has limit bytes."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit, self.out, self.name, self.size = folder, limit, None, "", 0

    def add(self, digest: str, image: bytes) -> tuple[str, int, int]:
        """The shard, and the image's offset and length in it."""
        if self.out is None:
            store, path = file_system(self.folder)
            store.create_dir(path, recursive=True)
            self.name = f"{uuid.uuid4().hex}.tar"
            self.out, self.size = store.open_output_stream(f"{path}/{self.name}"), 0
        entry = tarfile.TarInfo(f"{digest}.png")
        entry.size = len(image)
        head = entry.tobuf(tarfile.GNU_FORMAT)
        at = self.size + len(head)
        self.out.write(head)
        self.out.write(image)
        self.out.write(b"\0" * (-len(image) % tarfile.BLOCKSIZE))
        self.size = at + -(-len(image) // tarfile.BLOCKSIZE) * tarfile.BLOCKSIZE
        place = f"{self.folder}/{self.name}", at, len(image)
        if self.size >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.out = None


def store(docs: DataFrame, folder: str, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (of its text), digest, shard, offset, length of its image. Written down.

    A null text counts as empty; null and repeated doc_ids are kept as they are, and equal texts have equal digests.
    """
    docs = pick(docs, "doc_id", "text")
    schema = STORED.format(kind=docs.schema["doc_id"].dataType.simpleString())

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards, known = Shards(folder, limit), {}
        for part, block in blocks(batches, "text"):
            rows = []
            for i in range(len(block)):
                text = block.text(i)
                key = hashlib.sha256(text).digest()
                if key not in known:
                    image = encode(payload(text))
                    digest = hashlib.sha256(image).hexdigest()
                    known[key] = (digest, *shards.add(digest, image))
                rows.append((len(text), *known[key]))
            columns = zip(*rows, strict=True)
            types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        shards.close()

    return materialize(docs.mapInArrow(written, schema))


def places(stored: DataFrame) -> DataFrame:
    """digest, shard, offset, length: one place for each digest, dealt in runs of neighbours, each of about READ_BYTES."""
    once = stored.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("place")).select("digest", "place.*")
    total = once.agg(F.sum("length")).first()[0] or 0
    n = max(stored.sparkSession.sparkContext.defaultParallelism, -(-total // READ_BYTES))
    return once.repartitionByRange(n, "shard", "offset").sortWithinPartitions("shard", "offset")


def _ranges(batches: Iterator[pa.RecordBatch], names: list[str], extent: str | int) -> Iterator[tuple[tuple, bytes]]:
    """Each row (as names has its columns) with the bytes at its offset: extent many, or as the column extent says."""
    shard, source = None, None
    for batch in batches:
        for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
            at = dict(zip(names, row, strict=True))
            if at["shard"] != shard:
                if source is not None:
                    source.close()
                fs, path = file_system(at["shard"])
                shard, source = at["shard"], fs.open_input_file(path)
            n = at[extent] if isinstance(extent, str) else extent
            data = source.read_at(n, at["offset"])
            if len(data) < n:
                raise OSError(f"{shard} ends before byte {at['offset'] + n}")
            yield row, data


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _table(rows: Iterator[tuple], schema: str, size: int = 1000) -> Iterator[pa.RecordBatch]:
    """rows as Arrow batches."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    names, types = _names(schema), [kinds[c.split()[1]] for c in schema.split(", ")]
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)


def headers(entries: DataFrame) -> DataFrame:
    """entries (digest, shard, offset, length) with width, height, bit_depth and colour_type; only headers are read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _table(((*row, *header(first)) for row, first in _ranges(batches, ["digest", "shard", "offset", "length"], HEADER_BYTES)), HEADED)

    return entries.select("digest", "shard", "offset", "length").mapInArrow(read, HEADED)


def contents(headed: DataFrame) -> DataFrame:
    """headed with payload_sha256, tail_crc32 (of the last 32 bytes), media_sha256 and feature, of the stored bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for row, image in _ranges(batches, _names(HEADED), "length"):
                samples, digest = decode(image), hashlib.sha256(image).hexdigest()
                if digest != row[0]:
                    raise ValueError(f"{row[1]} holds another image at byte {row[2]}")
                yield *row, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), digest, feature(samples)

        yield from _table(rows(), READ)

    return headed.mapInArrow(read, READ)


def media_columns(docs: DataFrame, folder: str | None = None, limit: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_bytes, digest, shard, offset, length, the header's columns and what contents reads, for every row of docs.

    folder: where the shards go; a new one in the shared scratch folder if not given. Null texts count as empty and have one
    line of bytes 255; repeated rows are all kept; an empty table gives no rows and no shard.
    """
    stored = store(docs, folder or f"{scratch(docs.sparkSession)}/media", limit)
    read = materialize(contents(headers(places(stored))))
    return stored.select("doc_id", "n_bytes", "digest").join(read, "digest")
