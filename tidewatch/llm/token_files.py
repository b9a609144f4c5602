"""Token-ID output: independent zstandard frames, a trailing seek table, per-frame checksums.

Layout of a file (every part is a valid zstandard frame, so plain tools can decompress a file too):

    frame ...          one frame per document (a document over FRAME_IDS ids takes several), holding
                       little-endian unsigned 32-bit ids, with zstandard's own content checksum
    skippable 184D2A50 document index: number of documents, ids, null marks, id counts
    skippable 184D2A5E seek table of the public seekable format: per frame its compressed and
                       decompressed size and a 32-bit xxhash64 checksum; footer with its magic

A reader takes the tail, looks a document up and decompresses only its frames. Documents lie in
ascending doc_id order within and across files (null ids first; equal ids by a hash of the text).

Writing is one range shuffle and one task per file. A task writes under a name of its own and is
counted only if it succeeds: the manifest (a table) names the files that belong, so retried or
speculative attempts leave nothing that a reader could meet. The folder must be shared storage that
pyarrow can open (a mount, HDFS, an object store).

Defined results: a null text is a document of the end id alone; an empty table gives no files;
documents with an equal doc_id are all kept; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

from .tokens import encoder, tokenizer_path

END_ID = 2
FRAME_IDS = 1 << 20
ROWS = 2_000  # documents whose texts are objects at once
INDEX_MAGIC, SEEK_MAGIC, SEEK_FOOT = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
_MANIFEST = "part int, path string, n_docs long, n_tokens long"
_ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, path string"


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):  # how Hadoop writes local paths
        path = path[5:]
    return fs.FileSystem.from_uri(path)


class TokenWriter:
    """Writes one file, document by document; memory holds the index only."""

    def __init__(self, sink):
        import zstandard

        self.sink, self.zstd = sink, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.docs, self.counts, self.frames = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        self.docs.append(doc_id)
        self.counts.append(len(ids) // 4)
        for k in range(0, max(len(ids), 1), 4 * FRAME_IDS):
            raw = ids[k:k + 4 * FRAME_IDS]
            frame = self.zstd.compress(raw)
            self.sink.write(frame)
            self.frames.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        null = np.array([d is None for d in self.docs], "u1")
        ids = np.array([0 if d is None else d for d in self.docs], "<i8")
        index = struct.pack("<Q", len(ids)) + ids.tobytes() + null.tobytes() + np.array(self.counts, "<u8").tobytes()
        self.sink.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, "<u4").tobytes() + struct.pack("<IBI", len(self.frames), 0x80, SEEK_FOOT)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(table)) + table)


class TokenFile:
    """Random access to a file: only the frames of the documents asked for are read and decompressed."""

    def __init__(self, path: str):
        import zstandard

        store, name = _open(path)
        self.file = store.open_input_file(name)
        self.zstd, size = zstandard.ZstdDecompressor(), self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOT:
            raise ValueError(f"{path} has no seek table")
        at = size - 9 - 12 * n
        self.table = np.frombuffer(self._at(at, 12 * n), "<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        index = self.offsets[-1]
        magic, length = struct.unpack("<II", self._at(index, 8))
        if magic != INDEX_MAGIC or index + 8 + length != at - 8:
            raise ValueError(f"{path} has no document index")
        raw = self._at(index + 8, length)
        m = struct.unpack_from("<Q", raw)[0]
        self.null = np.frombuffer(raw, "u1", m, 8 + 8 * m)
        self.ids = np.frombuffer(raw, "<i8", m, 8)
        self.counts = np.frombuffer(raw, "<u8", m, 8 + 9 * m).astype(np.int64)
        per_doc = np.maximum(1, -(-self.counts // FRAME_IDS))
        self.first = np.concatenate([[0], np.cumsum(per_doc)])

    def _at(self, offset, n) -> bytes:
        return self.file.read_at(int(n), int(offset)) if n else b""

    def frames(self, k: int) -> Iterator[bytes]:
        """The raw ids of the k-th document of the file, frame by frame, checked."""
        import xxhash

        for j in range(self.first[k], self.first[k + 1]):
            packed, size, check = (int(x) for x in self.table[j])
            raw = self.zstd.decompress(self._at(self.offsets[j], packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {j} is damaged")
            yield raw

    def read(self, k: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.frames(k)), "<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document of this doc_id."""
        n = int(self.null.sum())  # nulls stand first
        ids = self.ids[n:]
        return [self.read(n + k) for k in range(bisect_left(ids, doc_id), bisect_right(ids, doc_id))]

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the token files of `docs` into `folder` and return the manifest (a written table)."""
    path, end = path or tokenizer_path(), struct.pack("<I", end_id)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, part = encoder(path, "ids"), None, TaskContext.get().partitionId()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if out is None and ids:
                name = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tok"
                files, at = _open(name)
                files.create_dir(at.rsplit("/", 1)[0], recursive=True)
                sink = files.open_output_stream(at)
                out = TokenWriter(sink)
            for a in range(0, len(ids), ROWS):
                texts = [t or "" for t in batch.column(1).slice(a, ROWS).to_pylist()]
                for doc_id, packed in zip(ids[a:a + ROWS], enc.values(texts)):
                    out.add(doc_id, packed + end)
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [name], "n_docs": pa.array([len(out.docs)], pa.int64()),
                "n_tokens": pa.array([sum(out.counts)], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_h"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "_h")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "text").select("doc_id", "text")
    rows.mapInArrow(store, _MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: one row per document, `start` = ids of all documents before it."""
    offset = F.coalesce(F.sum("n_tokens").over(  # one row per file
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", offset.alias("at"))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(name)
                starts = at + np.cumsum(file.counts) - file.counts
                for a in range(0, len(file.ids), 10_000):
                    b = min(a + 10_000, len(file.ids))
                    crcs = []
                    for k in range(a, b):
                        crc = 0
                        for raw in file.frames(k):
                            crc = zlib.crc32(raw, crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(file.ids[a:b], mask=file.null[a:b].astype(bool)),
                        "start": pa.array(starts[a:b]), "n_tokens": pa.array(file.counts[a:b]),
                        "ids_crc32": pa.array(crcs, pa.int64()), "path": pa.array([name] * (b - a))})
                file.close()

    n = max(1, min(manifest.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism))
    return files.repartition(n).mapInArrow(load, _ROWS)


def output_folder(spark: SparkSession) -> str:
    """A new folder in the session's shared folder (spark.checkpoint.dir)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4().hex}"
