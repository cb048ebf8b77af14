"""Media columns: payloads as 8-bit grey images in archives, read back by a Spark data source of our own.

Writing: each task stores its rows' payloads (UTF-8 bytes, padded with 0 to a positive multiple of 64) losslessly as PNG
images of 64 samples a row, in archives of bounded size. An archive is its members laid end to end, then a directory of
fixed-width entries, then a footer:

    member      a PNG file; a private chunk holds the number of bytes before padding
    key         the member's doc_id as UTF-8 text; keys lie end to end behind the members
    entry       offset and length of the key (length -1: null), offset, length and crc32 of the member; 8 bytes each, little-endian
    footer      b"SOFRAARC", offset of the directory (8), number of entries (8)

Archives are written under a name of the task attempt and listed by a manifest row only when complete, so an attempt
that is lost or repeated leaves a file that nothing reads.

Reading: the manifest, a Parquet table of all complete archives, holds where each directory begins and how many entries it
has. The source `sofra_archive` plans byte ranges of the directories from the manifest alone and opens no archive for it;
the plan has one small entry for each range, as a plan over files has. A task reads its range of entries, streams the members as Arrow batches, and retries each member by its offset, alone, if reading fails or its
checksum differs. A member that stays unreadable raises an error; nothing is skipped.

A null text is an empty one: a payload of 64 zero bytes. Equal texts give equal media. Repeated rows are members of their
own. Ids may be of any type that casts to text and back. A very long text is one member, whole in one task's memory. An
empty table gives no archives and no rows. Other columns are not stored, whatever their names."""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import map_arrow, scratch_dir, steps, texts

WIDTH = 64
ARCHIVE_BYTES, RANGE_ENTRIES, BATCH_BYTES, TRIES = 32 << 20, 4096, 4 << 20, 4
MAGIC, FOOTER, ENTRY = b"SOFRAARC", 24, np.dtype("<i8")
FIELDS = 5


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(text: bytes, level: int = 1) -> bytes:
    """The payload of the text as a grey image, one sample a byte; every image row begins with filter 0."""
    body = payload(text)
    rows = np.zeros((len(body) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(body, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"siZe", struct.pack(">Q", len(text))) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """Payload and the number of bytes before padding; errors for anything that to_png() doesn't write."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, data, size, rows = 8, b"", None, 0
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("a chunk's checksum differs")
        if kind == b"IHDR":
            width, rows, depth, colour = struct.unpack(">IIBB", body[:10])
            if (width, depth, colour) != (WIDTH, 8, 0):
                raise ValueError("not an 8-bit grey image of the width")
        elif kind == b"siZe":
            size = struct.unpack(">Q", body)[0]
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    samples = np.frombuffer(zlib.decompress(data), np.uint8).reshape(rows, WIDTH + 1)
    if samples[:, 0].any() or size is None:
        raise ValueError("filtered rows or no size")
    return samples[:, 1:].tobytes(), size


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    if not urlparse(path).scheme:
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(path)


class ArchiveWriter:
    """Members, then keys and the directory, then the footer, through any file system that Arrow knows."""

    def __init__(self, path: str):
        self.path, self.at, self.entries, self.keys = path, 0, [], []
        fs, name = _files(path)
        fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.out = fs.open_output_stream(name)

    def add(self, key: str | None, member: bytes) -> None:
        self.out.write(member)
        self.keys.append(None if key is None else key.encode())
        self.entries.append((self.at, len(member), zlib.crc32(member)))
        self.at += len(member)

    def close(self) -> tuple[str, int, int]:
        """Path, place of the directory and number of entries of the complete archive."""
        sizes = [0 if k is None else len(k) for k in self.keys]
        places = self.at + np.cumsum([0, *sizes])
        self.out.write(b"".join(k or b"" for k in self.keys))
        entries = [(int(p), -1 if k is None else len(k), *e) for p, k, e in zip(places, self.keys, self.entries)]
        self.out.write(np.array(entries, ENTRY).tobytes())
        self.out.write(MAGIC + struct.pack("<QQ", int(places[-1]), len(entries)))
        self.out.close()
        return self.path, int(places[-1]), len(entries)


def store(documents: DataFrame, folder: str) -> str:
    """Archives of all documents' payloads in the folder, about 32 MB each; the path of the manifest of the complete ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer = [], None
        for batch in steps(batches):
            for key, text in zip(batch.column("key").to_pylist(), texts(batch)):
                if writer is None:
                    writer = ArchiveWriter(f"{folder}/{uuid.uuid4().hex}.arc")
                writer.add(key, to_png(text))
                if writer.at >= ARCHIVE_BYTES:
                    made.append(writer.close())
                    writer = None
        if writer is not None:
            made.append(writer.close())
        path, directory, members = zip(*made) if made else ((), (), ())
        yield pa.record_batch({"path": pa.array(path, pa.string()), "directory": pa.array(directory, pa.int64()), "members": pa.array(members, pa.int64())})

    rows = map_arrow(documents.select(F.col("doc_id").cast("string").alias("key"), "text"), run, "path string, directory long, members long")
    rows.write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


class DirectoryRange(InputPartition):
    """Bytes first to stop of an archive's directory."""

    def __init__(self, path: str, first: int, stop: int):
        self.path, self.first, self.stop = path, first, stop


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest, self.entries = options["manifest"], int(options.get("entries", RANGE_ENTRIES))

    def partitions(self) -> list[DirectoryRange]:
        fs, name = _files(self.manifest)
        wide, out = FIELDS * ENTRY.itemsize, []
        for file in fs.get_file_info(pa.fs.FileSelector(name)):
            if file.path.endswith(".parquet"):
                with fs.open_input_file(file.path) as f:
                    for row in pq.read_table(f).to_pylist():
                        at, n = row["directory"], row["members"]
                        out += [DirectoryRange(row["path"], at + wide * i, at + wide * min(n, i + self.entries)) for i in range(0, n, self.entries)]
        return out or [DirectoryRange("", 0, 0)]

    def read(self, partition: DirectoryRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        f = Members(partition.path)
        entries = np.frombuffer(f.at(partition.first, partition.stop - partition.first), ENTRY).reshape(-1, FIELDS)
        begin = int(entries[0, 0])
        names = f.at(begin, int(entries[-1, 0] + max(0, entries[-1, 1])) - begin)
        keys, bodies, size = [], [], 0
        for key, wide, offset, length, crc in entries.tolist():
            keys.append(None if wide < 0 else names[key - begin : key - begin + wide].decode())
            bodies.append(f.at(offset, length, crc))
            size += length
            if size >= BATCH_BYTES:
                yield pa.record_batch({"key": pa.array(keys, pa.string()), "media": pa.array(bodies, pa.binary())})
                keys, bodies, size = [], [], 0
        if keys:
            yield pa.record_batch({"key": pa.array(keys, pa.string()), "media": pa.array(bodies, pa.binary())})


class Members:
    """Reads by offset; each is retried alone, with a file opened anew."""

    def __init__(self, path: str, wait: float = 0.05):
        self.path, self.wait, self.file = path, wait, None

    def _read(self, offset: int, length: int) -> bytes:
        if self.file is None:
            fs, name = _files(self.path)
            self.file = fs.open_input_file(name)
        self.file.seek(offset)
        return self.file.read(length)

    def at(self, offset: int, length: int, crc: int | None = None) -> bytes:
        for attempt in range(TRIES):
            try:
                body = self._read(offset, length)
                if len(body) == length and (crc is None or zlib.crc32(body) == crc):
                    return body
                error: Exception = OSError("short or damaged")
            except OSError as e:
                error = e
            self.file = None
            time.sleep(self.wait * 2**attempt)
        raise OSError(f"{self.path}: member at {offset} can't be read after {TRIES} tries: {error}")


class ArchiveSource(DataSource):
    """Format `sofra_archive`: option `manifest`, path of the manifest of store(); option `entries`, directory entries a partition."""

    @classmethod
    def name(cls) -> str:
        return "sofra_archive"

    def schema(self) -> str:
        return "key string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def feature(body: bytes) -> str:
    """Mean, deviation and byte-class shares of the samples, and a 64-bit average hash of the image in an 8 x 8 grid."""
    a = np.frombuffer(body, np.uint8)
    tall = a.reshape(-1, WIDTH)
    edges = np.linspace(0, len(tall), 9).astype(int)
    bands = np.array([tall[lo : max(hi, lo + 1)].reshape(-1, 8, WIDTH // 8).mean((0, 2)) if lo < len(tall) else np.zeros(8) for lo, hi in zip(edges[:-1], edges[1:])])
    bits = "".join("1" if x else "0" for x in (bands > bands.mean()).ravel())
    counts = np.bincount(a, minlength=256)
    shares = [counts[0], counts[32], counts[48:58].sum(), counts[65:91].sum(), counts[97:123].sum(), counts[128:].sum()]
    return f"{a.mean():.3f}|{a.std():.3f}|" + ",".join(f"{s / len(a):.4f}" for s in shares) + f"|{int(bits, 2):016x}"


def decode(media: DataFrame) -> DataFrame:
    """Features of (key, media) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = batch.column("media").to_pylist()
            both = [from_png(m) for m in images]
            yield pa.record_batch({
                "key": batch.column("key"), "n_bytes": pa.array([n for _, n in both], pa.int64()), "payload_bytes": pa.array([len(b) for b, _ in both], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(b).hexdigest() for b, _ in both]), "tail_crc32": pa.array([zlib.crc32(b[-WIDTH:]) for b, _ in both], pa.int64()),
                "media_bytes": pa.array([len(m) for m in images], pa.int64()), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in images]), "feature": pa.array([feature(b) for b, _ in both]),
            })

    return map_arrow(media, run, "key string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def open_archives(spark, manifest: str, entries: int = RANGE_ENTRIES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("sofra_archive").option("manifest", manifest).option("entries", entries).load()


def media_features(documents: DataFrame) -> DataFrame:
    """Every text stored, read back and described."""
    spark = documents.sparkSession
    folder = f"{scratch_dir(spark)}/media-{uuid.uuid4().hex}"
    made = decode(open_archives(spark, store(documents, folder)))
    return made.select(F.col("key").cast(documents.schema["doc_id"].dataType).alias("doc_id"), *[c for c in made.columns if c != "key"])
