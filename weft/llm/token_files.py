"""Flat token files: unsigned ids, 64-bit document offsets, memory-mapped on reading.

Ids take 16 bits if the vocabulary (and the end id) fits, else 32; the manifest says which.

The documents are range-partitioned and sorted by id.  Each partition streams its ids into
one file ``part-NNNNN.bin`` and its documents' offsets inside the part into ``.idx``; only a
row of counts per partition comes back, and a prefix sum over those gives the partitions'
bases.  A reader needs the manifest (part, base), the offsets and a memory map.

Files are written under a temporary name and renamed when whole, so a repeated or lost task
leaves nothing half-written.  ``pyarrow.fs`` opens the folder, which may be on any shared
store; only files on a mounted path can be memory-mapped, others are read by range.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import prepare, stored, with_base
from weft.llm.tokens import encoder
from weft.session import scratch_path

END_ID = 2
OFFSET = np.dtype("<u8")
MANIFEST = "part int, docs long, ids long, width int"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def _write_part(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, end_id: int | None) -> Iterator[pa.RecordBatch]:
    part, tok = TaskContext.get().partitionId(), encoder(vocabulary)
    store, root = _open(folder)
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
    width = 2 if tok.small and (end_id or 0) < 1 << 16 else 4
    names = [f"{root}/part-{part:05d}.{x}" for x in ("bin", "idx", "ids")]
    temporary = [f"{n}.{uuid.uuid4().hex}" for n in names]
    outs, docs, at = [], 0, 0
    for b in batches:
        if not outs:
            store.create_dir(root, recursive=True)
            outs = [store.open_output_stream(n) for n in temporary]
        coded = [x + tail for x in tok.encode(b.column("text").to_pylist())]
        ends = at + np.cumsum([len(x) // 4 for x in coded], dtype=OFFSET)
        outs[0].write(np.frombuffer(b"".join(coded), "<u4").astype(f"<u{width}").tobytes())
        outs[1].write(np.r_[np.array([at], dtype=OFFSET), ends[:-1]].astype(OFFSET).tobytes())
        ids = b.column("doc_id")
        outs[2].write(b"".join(b"\0" * 9 if x is None else b"\1" + int(x).to_bytes(8, "little", signed=True) for x in ids.to_pylist()))
        docs, at = docs + len(coded), int(ends[-1])
    for o, t, n in zip(outs, temporary, names):
        o.close()
        if store.get_file_info(n).type != pafs.FileType.NotFound:  # of an earlier, lost attempt
            store.delete_file(n)
        store.move(t, n)
    if docs:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([docs]), pa.array([at]), pa.array([width], pa.int32())], names=["part", "docs", "ids", "width"])


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = END_ID) -> DataFrame:
    """Write the files; returns the manifest ``part, docs, ids, width, base`` (base: ids before the part).

    A null or empty text has only its end id; null ids come last; rows that share an id lie
    next to each other, by text.  An empty table writes no file.
    """
    prepare(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    rows = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order)
    counts = stored(rows.mapInArrow(lambda it: _write_part(it, folder, vocabulary, end_id), MANIFEST), "manifest")
    return with_base(counts.withColumn("_p", F.col("part")), counts.withColumn("_p", F.col("part")), "ids", "base").drop("_p")


class TokenPart:
    """One part, opened for reading."""

    def __init__(self, folder: str, part: int, ids: int, width: int):
        self.store, root = _open(folder)
        name = f"{root}/part-{part:05d}"
        starts = np.frombuffer(self._all(f"{name}.idx"), dtype=OFFSET)
        self.starts = np.append(starts, np.array([ids], dtype=OFFSET)).astype(np.int64)
        raw = np.frombuffer(self._all(f"{name}.ids"), dtype=np.dtype([("some", "u1"), ("id", "<i8")]))
        self.doc_ids = [int(x["id"]) if x["some"] else None for x in raw]
        self.path = f"{name}.bin"
        local = isinstance(self.store, pafs.LocalFileSystem)
        self.kind = np.dtype(f"<u{width}")
        self.map = np.memmap(self.path, dtype=self.kind, mode="r") if local and ids else None

    def _all(self, name: str) -> bytes:
        with self.store.open_input_stream(name) as f:
            return f.read()

    def __len__(self) -> int:
        return len(self.doc_ids)

    def __getitem__(self, k: int) -> np.ndarray:
        a, b = int(self.starts[k]), int(self.starts[k + 1])
        if self.map is not None:
            return self.map[a:b]
        with self.store.open_input_file(self.path) as f:
            return np.frombuffer(f.read_at((b - a) * self.kind.itemsize, a * self.kind.itemsize), dtype=self.kind)


def _read_parts(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in b.to_pylist():
            p = TokenPart(folder, row["part"], row["ids"], row["width"])
            for lo in range(0, len(p), 4096):
                ks = range(lo, min(lo + 4096, len(p)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p.doc_ids[k] for k in ks], pa.int64()), pa.array([row["base"] + int(p.starts[k]) for k in ks], pa.int64()),
                     pa.array([int(p.starts[k + 1] - p.starts[k]) for k in ks], pa.int64()), pa.array([zlib.crc32(p[k].astype("<u4")) for k in ks], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    spark: SparkSession = manifest.sparkSession
    parts = manifest.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")
    return parts.mapInArrow(lambda it: _read_parts(it, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write the documents to ``folder`` (default: a new one in the shared folder) and read back."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, vocabulary), folder)
