"""Token ids in Arrow stream files of equal-length sequences.

A file holds the ids of a range of documents, in order of doc_id, as record batches of
two fixed-size-list columns: `ids` and `mask`, each a sequence of LENGTH. Only a file's
last sequence is padded, its mask tells where. Mapped into memory, a batch's ids are one
plain array: sequence i of a file is row i % ROWS of batch i // ROWS, without a copy. A
second stream beside it, the index, tells where each document starts.

Files are written by tasks through pyarrow's file systems, under names that no other
attempt uses; the manifest lists those of the attempts that Spark kept. An executor lost
later costs nothing, as the folder is shared.

Defined results: a null text is empty, its document is the end id alone; rows of equal
doc_id follow each other in order of their texts' hash; a null doc_id comes first. An
empty table gives no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ranged, shared_path, sums_before, tasks, text_or_empty, written
from .token_ids import encoder

LENGTH = 2048  # ids of a sequence
ROWS = 64  # sequences of a batch
MANIFEST = "part int, path string, n_docs long, n_tokens long"


class _SequenceFile:
    """A stream of sequences under way; holds a batch at most."""

    def __init__(self, fs: pafs.FileSystem, path: str, kind: np.dtype) -> None:
        self.kind, self.held, self.waiting, self.n = kind, [], 0, 0
        self.schema = pa.schema([
            ("ids", pa.list_(pa.from_numpy_dtype(kind), LENGTH)), ("mask", pa.list_(pa.bool_(), LENGTH)),
        ])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.places = fs.open_output_stream(f"{path}.places")

    def add(self, ids: bytes) -> None:
        self.held.append(np.frombuffer(ids, "<u4").astype(self.kind))
        self.n += len(ids) // 4
        self.waiting += len(ids) // 4
        if self.waiting >= LENGTH * ROWS:
            ids, size = np.concatenate(self.held), LENGTH * ROWS
            whole = len(ids) // size * size
            for at in range(0, whole, size):
                self._write(ids[at : at + size], size)
            self.held, self.waiting = [ids[whole:]], len(ids) - whole

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.arange(len(ids)) < used
        self.places.write(np.int64(self.sink.tell()).astype("<i8").tobytes())
        self.writer.write_batch(pa.RecordBatch.from_arrays([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), LENGTH),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), LENGTH),
        ], schema=self.schema))

    def close(self) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, self.kind)
        if len(ids):
            self._write(np.pad(ids, (0, -len(ids) % LENGTH)), len(ids))
        self.writer.close()
        self.sink.close()
        self.places.close()


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, text: str = "text") -> DataFrame:
    """Write the files of `docs` under `folder`; their manifest, a row per file, in order of `part`."""
    index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
    source = ranged(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text")),
        F.col("doc_id"), F.xxhash64("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part, ids_of = batch.column(2)[0].as_py(), encoder(tokenizer)
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                name = f"{part:08d}-{uuid.uuid4().hex}.arrows"
                out, docs_seen = _SequenceFile(fs, f"{base}/{name}", ids_of.width), 0
                index_sink = fs.open_output_stream(f"{base}/{name}.index")
                index = pa.ipc.new_stream(index_sink, index_schema)
            starts, sizes = [], []
            for t in batch.column(1):
                ids = ids_of.document(t.as_py())
                starts.append(out.n)
                sizes.append(len(ids) // 4)
                out.add(ids)
            docs_seen += batch.num_rows
            index.write_batch(pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())],
                schema=index_schema,
            ))
        if out is not None:
            out.close()
            index.close()
            index_sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "path": [f"{folder}/{name}"], "n_docs": [docs_seen], "n_tokens": [out.n]},
                schema=pa.schema([("part", pa.int32()), ("path", pa.string()),
                                  ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
            )

    return written(source.mapInArrow(run, MANIFEST), "manifest")


def _opened(path: str):
    """A file to read: mapped into memory where the file system is local."""
    fs, local = pafs.FileSystem.from_uri(path)
    return pa.memory_map(local) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(local)


def read_batches(path: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and masks of each batch of a file, a row per sequence, without a copy of the ids."""
    with _opened(path) as source, pa.ipc.open_stream(source) as stream:
        for batch in stream:
            ids = batch.column(0).flatten().to_numpy(zero_copy_only=True)
            mask = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield ids.reshape(-1, LENGTH), mask.reshape(-1, LENGTH)


def sequence(path: str, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence i of a file; of a mapped file both are views of the mapping."""
    with _opened(f"{path}.places") as places:
        at = places.read_at(8, 8 * (i // ROWS)) if i >= 0 else b""
    if len(at) < 8:
        raise IndexError(f"{path} has no sequence {i}")
    source = _opened(path)
    schema = pa.ipc.open_stream(source).schema
    source.seek(int.from_bytes(at, "little"))
    message = pa.ipc.read_message(source)
    if message.type == "schema":  # it is written with the first batch
        message = pa.ipc.read_message(source)
    batch = pa.ipc.read_record_batch(message, schema)
    if i % ROWS >= batch.num_rows:
        raise IndexError(f"{path} has no sequence {i}")
    ids, mask = (c.slice(i % ROWS, 1).flatten() for c in batch.columns)
    return ids.to_numpy(zero_copy_only=True), mask


def read_documents(path: str) -> Iterator[tuple[int | None, int, list[np.ndarray]]]:
    """doc_id, start in the file and ids, in pieces, of each document of a file."""
    batches = (ids[mask] for ids, mask in read_batches(path))
    have, at = np.zeros(0, np.uint16), 0
    with _opened(f"{path}.index") as source, pa.ipc.open_stream(source) as index:
        for batch in index:
            for doc_id, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                pieces, left = [], n
                while left:
                    if at == len(have):
                        have, at = next(batches), 0
                    pieces.append(have[at : at + left])
                    at += len(pieces[-1])
                    left -= len(pieces[-1])
                yield doc_id, start, pieces


def read_sequences(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a manifest."""
    n = tasks(manifest.sparkSession)
    files = sums_before(manifest, "n_tokens", "part").select("path", "before").repartition(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(*(c.to_pylist() for c in batch.columns)):
                rows: list[tuple] = []
                for doc_id, start, pieces in read_documents(path):
                    crc = 0
                    for p in pieces:
                        crc = zlib.crc32(p.astype("<u4").tobytes(), crc)
                    rows.append((doc_id, before + start, sum(map(len, pieces)), crc))
                    if len(rows) == 10_000:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write all documents, and what the files give back of each."""
    return read_sequences(write_sequences(docs, shared_path(spark, "token-ids"), tokenizer))
