"""Token ids in Arrow files of fixed-size lists, and reading them back.

The corpus is one stream of ids in ascending order of doc_id, an end id after each
document. It is cut into rows of ``row_length`` ids; the last row of a file is
padded and its mask says where. Every file is an Arrow IPC file with two columns,
``ids`` (fixed-size list of unsigned integers: 16 bits where the vocabulary allows,
else 32) and ``mask`` (fixed-size list of booleans), and record batches of equally
many rows: row k lies at a computable place, and a memory-mapped file gives it
without a copy. A second Arrow file beside it lists its documents.

Each task writes the files of one range of ids under a name of its own and renames
them when they are whole, so a task that is run again leaves the same files.

Defined results: null text is the empty text, with the end id only; null ids come
first; repeated rows are separate documents; an empty table gives no files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_later, shared_dir, small_batches, table
from .tokens import END_ID, default_path, encoder

ROW_LENGTH = 2048
ROWS_PER_BATCH = 256


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Appends ids and writes record batches of whole rows."""

    def __init__(self, sink, kind: str, row_length: int, rows: int):
        self.kind, self.row_length, self.size = kind, row_length, row_length * rows
        value = pa.from_numpy_dtype(np.dtype(kind))
        self.schema = pa.schema([("ids", pa.list_(value, row_length)), ("mask", pa.list_(pa.bool_(), row_length))])
        self.sink = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            flat = np.concatenate(self.parts)
            whole = len(flat) // self.size * self.size
            for at in range(0, whole, self.size):
                self._write(flat[at : at + self.size], self.size)
            self.parts, self.held = [flat[whole:]], len(flat) - whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        values = pa.array(ids.astype(self.kind, copy=False))
        mask = pa.array(np.arange(len(ids)) < n)
        self.sink.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(values, self.row_length), pa.FixedSizeListArray.from_arrays(mask, self.row_length)], schema=self.schema))

    def close(self) -> None:
        if self.held:
            flat = np.concatenate(self.parts)
            padded = np.zeros(-(-self.held // self.row_length) * self.row_length, self.kind)
            padded[: self.held] = flat
            self._write(padded, self.held)
        self.sink.close()


def write_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, row_length: int = ROW_LENGTH, parts: int | None = None) -> list[tuple[int, int]]:
    """Writes the files; (part, number of ids) of each, in order. One row per part comes to the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    path = path or default_path()
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * docs.rdd.getNumPartitions())
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches):
        part, mine = TaskContext.get().partitionId(), uuid.uuid4().hex
        code = encoder(path)
        kind = "<u2" if max(code.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        end = end_id.to_bytes(4, "little")
        writer, total, lengths, names = None, 0, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, root = _store(folder)
                store.create_dir(root, recursive=True)
                sink = store.open_output_stream(f"{root}/{mine}.ids")
                writer = _Writer(sink, kind, row_length, ROWS_PER_BATCH)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at in range(0, len(texts), 2048):
                for ids in code.encode(texts[at : at + 2048]):
                    flat = np.frombuffer(ids + end, "<u4")
                    writer.add(flat.astype(kind))
                    lengths.append(len(flat))
            names.append(batch.column(0))
        if writer is None:
            return
        writer.close()
        sink.close()
        counts = np.array(lengths, "<i8")
        index = pa.table({"doc_id": pa.chunked_array(names), "start": np.cumsum(counts) - counts, "n_tokens": counts})
        with store.open_output_stream(f"{root}/{mine}.index") as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index)
        for suffix in ("ids", "index"):
            store.move(f"{root}/{mine}.{suffix}", f"{root}/part-{part:06d}.{suffix}.arrow")
        yield pa.RecordBatch.from_pydict({"part": [part], "n": [int(counts.sum())]}, schema=pa.schema([("part", pa.int32()), ("n", pa.int64())]))

    return sorted((r.part, r.n) for r in ordered.mapInArrow(run, "part int, n bigint").collect())


def open_part(folder: str, part: int):
    """The ids and the document list of one part; local files are mapped, not copied."""
    store, root = _store(folder)
    local = store.type_name == "local"

    def opened(name: str):
        at = f"{root}/part-{part:06d}.{name}.arrow"
        return pa.ipc.open_file(pa.memory_map(at) if local else store.open_input_file(at))

    return opened("ids"), opened("index").read_all()


def random_row(file: pa.RecordBatchFileReader, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row k of a part, without reading others: its ids and its mask."""
    per = file.get_batch(0).num_rows
    batch = file.get_batch(k // per)
    ids, mask = batch.column(0)[k % per].values, batch.column(1)[k % per].values
    return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)


def read_documents(spark, folder: str, parts: list[tuple[int, int]], id_type: str = "bigint") -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    starts, total = [], 0
    for part, n in parts:
        starts.append((part, total))
        total += n
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"

    def run(batches):
        for batch in batches:
            for part, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file, index = open_part(folder, part)
                chunks = [file.get_batch(k) for k in range(file.num_record_batches)]
                flat = np.concatenate([b.column(0).flatten().to_numpy()[b.column(1).flatten().to_numpy(zero_copy_only=False)] for b in chunks])
                begin, count = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                crc = [zlib.crc32(flat[s : s + n].astype("<u4")) for s, n in zip(begin.tolist(), count.tolist(), strict=True)]
                for out in pa.table({"doc_id": index["doc_id"], "start": begin + base, "n_tokens": count, "ids_crc32": pa.array(crc, pa.int64())}).to_batches(10_000):
                    yield out

    if not starts:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(starts, "part int, base bigint").repartition(min(len(starts), 10_000)).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    remove_later(spark, folder)
    return read_documents(spark, folder, write_files(docs, folder), dict(docs.dtypes)["doc_id"])
