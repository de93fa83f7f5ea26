"""Token ids in Arrow files of equal-length sequences with masks.

Each file holds record batches of two fixed-size lists, ``ids`` and ``mask``, of SEQUENCE
values.  Batches are uncompressed and have ROWS sequences each (the last may have fewer), so a
reader finds sequence i at batch i // ROWS, row i % ROWS, and sees it in the mapped file
without a copy.  The last sequence of a file is filled up with zeros under a false mask.
Beside it lies an index of the file's documents: id, first token, number of tokens.
Documents are in ascending order over the files; the first token of a file is the number of
tokens of all files before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import new_folder, partitions, save
from .tokens import encoder

SEQUENCE, ROWS = 2048, 64
INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def sequence_schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(dtype), nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])


class SequenceWriter:
    """Cuts a stream of ids in sequences and writes them; open files take the final name only when closed."""

    def __init__(self, place: fs.FileSystem, path: str, dtype: np.dtype, length: int, attempt: str):
        self.place, self.path, self.dtype, self.length, self.attempt = place, path, dtype, length, attempt
        self.schema = sequence_schema(dtype, length)
        self.out = place.open_output_stream(f"{path}.{attempt}")
        self.writer = ipc.new_file(self.out, self.schema)
        self.waiting, self.size, self.n, self.docs = [], 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n, n))
        self.n += n
        self.waiting.append(ids)
        self.size += n
        if self.size >= ROWS * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        a = np.frombuffer(b"".join(self.waiting), self.dtype)
        step, at = ROWS * self.length, 0
        while len(a) - at >= step or last and at < len(a):
            part = a[at : at + step]
            mask = np.ones(-(-len(part) // self.length) * self.length, bool)
            mask[len(part) :] = False
            part = np.concatenate([part, np.zeros(len(mask) - len(part), self.dtype)])
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), type=f.type) for x, f in zip((part, mask), self.schema, strict=True)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
            at += step
        self.waiting, self.size = [a[at:].tobytes()], max(0, len(a) - at)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.out.close()
        index = f"{self.path}.index"
        with self.place.open_output_stream(f"{index}.{self.attempt}") as out, ipc.new_file(out, INDEX) as w:
            columns = list(zip(*self.docs, strict=True)) or [[], [], []]
            w.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=INDEX))
        self.place.move(f"{index}.{self.attempt}", index)
        self.place.move(f"{self.path}.{self.attempt}", self.path)


class SequenceFile:
    """Random access to the sequences and the token ranges of a file."""

    def __init__(self, uri: str):
        self.place, self.path = fs.FileSystem.from_uri(uri)
        local = isinstance(self.place, fs.LocalFileSystem)
        self.reader = ipc.open_file(pa.memory_map(self.path) if local else self.place.open_input_file(self.path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch = (-1, None)

    def _column(self, k: int, name: str) -> pa.Array:
        if self.batch[0] != k:
            self.batch = (k, self.reader.get_batch(k))
        return self.batch[1].column(name)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the file) and mask of sequence i."""
        k, row = divmod(i, ROWS)
        return self._column(k, "ids")[row].values.to_numpy(zero_copy_only=True), self._column(k, "mask")[row].values.to_numpy(zero_copy_only=False)

    def ranges(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Views that hold tokens start to start + n, in turn."""
        step = ROWS * self.length
        while n > 0:
            k, at = divmod(start, step)
            part = self._column(k, "ids").flatten().to_numpy(zero_copy_only=True)[at : at + n]
            yield part
            start, n = start + len(part), n - len(part)

    def documents(self) -> pa.RecordBatch:
        return ipc.open_file(self.place.open_input_file(f"{self.path}.index")).get_batch(0)


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int, length: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs (an absent text has only the end id) and return the files: part, uri, n_docs, n_tokens.

    Repeated ids are kept, in the order of their texts; rows without id come first.  Other
    columns are ignored.  A task that runs again writes its file again under the same name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, code = TaskContext.get(), encoder(tokenizer)
        end, out, uri = np.array([end_id], code.dtype).tobytes(), None, f"{folder}/part-{TaskContext.get().partitionId():06d}.arrow"
        for batch in batches:
            if out is None and len(batch.column(0)):
                place, path = fs.FileSystem.from_uri(uri)
                place.create_dir(path.rsplit("/", 1)[0], recursive=True)
                out = SequenceWriter(place, path, code.dtype, length, f"{task.taskAttemptId()}.tmp")
            for at in range(0, len(batch.column(0)), 512):
                part = batch.slice(at, 512)
                for doc_id, ids in zip(part.column(0).to_pylist(), code.encode(part.column(1).to_pylist()), strict=True):
                    out.add(doc_id, ids.tobytes() + end)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((task.partitionId(), pa.int32()), (uri, pa.string()), (len(out.docs), pa.int64()), (out.n, pa.int64()))], names=["part", "uri", "n_docs", "n_tokens"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = docs.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return save(ordered.mapInArrow(run, "part int, uri string, n_docs long, n_tokens long"), "sequence_files")


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist(), strict=True):
            file = SequenceFile(uri)
            docs, sums = file.documents(), []
            starts, sizes = docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()
            for start, n in zip(starts, sizes, strict=True):
                crc = 0
                for part in file.ranges(start, n):
                    crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array([first + s for s in starts], pa.int64()), docs.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(files: DataFrame) -> DataFrame:
    """doc_id, start (tokens of all documents before it), n_tokens, ids_crc32, read from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = files.select("uri", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("first"))
    return placed.repartition(partitions(files.sparkSession)).mapInArrow(_read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_sequences(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """Write all documents to files of the shared folder and read them back."""
    return read_documents(write_sequences(docs, new_folder(docs.sparkSession, "sequences"), tokenizer, end_id))
