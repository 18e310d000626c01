"""Token-ID output: shards in the Arrow IPC file format whose batches hold fixed-size lists.

The ids of all documents in ascending doc_id order, each document closed by an end id, form one stream; a shard is a
range of documents and cuts its part of the stream into sequences of ``seq_len`` ids, the last one padded. A task closes
a shard after ``SHARD_TOKENS`` ids and begins the next. A sequence is
one row of ``shard-*.arrow``: ``ids`` fixed_size_list<uint16 or uint32> and ``mask`` fixed_size_list<bool> (false on
padding), so a reader that maps the file gets any sequence without copying. ``shard-*.docs.arrow`` has a row per
document: doc_id, start (in the shard) and n_tokens.

A task writes its own uniquely named files and returns a manifest row for each shard; only files in the manifest count, so a task
that is run again after a lost executor does no harm. Files go through pyarrow's file systems to the folder given.

Defined results: a null or empty text is the end id alone; rows with equal doc_id are separate documents in the order
of their texts; a null doc_id comes first; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.encode import column_blocks, encoder
from tributary.session import save, shared_dir, shuffle_partitions

SEQ_LEN = 2048
BATCH_ROWS = 256
SHARD_TOKENS = 64 << 20
MANIFEST = "shard long, path string, docs_path string, n_docs long, n_tokens long"


def _open(path: str):
    return pafs.FileSystem.from_uri(path)


class ShardWriter:
    """Collects ids and writes full batches of sequences as they fill."""

    def __init__(self, path: str, dtype: np.dtype, seq_len: int = SEQ_LEN):
        fs, self.local = _open(path)
        fs.create_dir(self.local.rpartition("/")[0], recursive=True)
        self.seq_len, self.dtype, self.waiting, self.n_waiting, self.n_tokens = seq_len, dtype, [], 0, 0
        kind = pa.list_(pa.from_numpy_dtype(dtype), seq_len)
        self.schema = pa.schema([("ids", kind), ("mask", pa.list_(pa.bool_(), seq_len))])
        self.sink = fs.open_output_stream(self.local)
        self.writer = pa.ipc.new_file(self.sink, self.schema)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids.astype(self.dtype))
        self.n_waiting += len(ids)
        self.n_tokens += len(ids)
        if self.n_waiting >= self.seq_len * BATCH_ROWS:
            self._flush(False)

    def _flush(self, final: bool) -> None:
        ids = np.concatenate([np.zeros(0, self.dtype), *self.waiting])
        room = self.seq_len * BATCH_ROWS
        for lo in range(0, len(ids), room):
            part = ids[lo : lo + room]
            if len(part) < room and not final:
                break
            rows = -(-len(part) // self.seq_len)
            padded = np.zeros(rows * self.seq_len, self.dtype)
            padded[: len(part)] = part
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.seq_len) for x in (padded, np.arange(len(padded)) < len(part))]
            self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        done = len(ids) if final else len(ids) // room * room
        self.waiting, self.n_waiting = [ids[done:]], len(ids) - done

    def close(self) -> None:
        self._flush(True)
        self.writer.close()
        self.sink.close()


def _closed(writer: ShardWriter, shard: int, path: str, doc_ids: list[pa.Array], sizes: list[np.ndarray]) -> pa.RecordBatch:
    """Ends a shard, writes its table of documents, and gives its manifest row."""
    writer.close()
    n = np.concatenate(sizes)
    table = pa.table({"doc_id": pa.concat_arrays(doc_ids), "start": np.cumsum(n) - n, "n_tokens": n})
    fs, local = _open(f"{path}.docs.arrow")
    with fs.open_output_stream(local) as sink, pa.ipc.new_file(sink, table.schema) as out:
        out.write_table(table)
    row = [[shard], [f"{path}.arrow"], [f"{path}.docs.arrow"], [len(n)], [int(n.sum())]]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["shard", "path", "docs_path", "n_docs", "n_tokens"])


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 0, seq_len: int = SEQ_LEN, shards: int | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards under ``out_dir`` and returns the manifest (saved): shard, path, docs_path, n_docs, n_tokens."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        dtype = np.dtype(np.uint16 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32)
        part, number = TaskContext.get().partitionId(), 0
        writer, doc_ids, sizes = None, [], []
        for batch in batches:
            for lo, hi in column_blocks(batch.column(1)):
                if writer is None:
                    path = f"{out_dir}/shard-{part:06d}-{number:04d}-{uuid.uuid4().hex}"
                    writer, doc_ids, sizes = ShardWriter(f"{path}.arrow", dtype, seq_len), [], []
                ids, at = enc.encode(batch.column(1).slice(lo, hi - lo))
                writer.add(np.insert(ids, at[1:], end_id))
                doc_ids.append(batch.column(0).slice(lo, hi - lo))
                sizes.append(np.diff(at) + 1)
                if writer.n_tokens >= shard_tokens:
                    yield _closed(writer, part << 32 | number, path, doc_ids, sizes)
                    writer, number = None, number + 1
        if writer is not None:
            yield _closed(writer, part << 32 | number, path, doc_ids, sizes)

    spark = docs.sparkSession
    ranged = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange(shards or shuffle_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return save(ranged.mapInArrow(write, MANIFEST), "token-manifest")


def open_shard(path: str) -> pa.ipc.RecordBatchFileReader:
    """A local shard is mapped: the arrays of its batches point into the file."""
    fs, local = _open(path)
    return pa.ipc.open_file(pa.memory_map(local) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(local))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """ids (a view without copying) and mask of sequence ``i`` of a shard."""
    batch = reader.get_batch(i // BATCH_ROWS)
    size, k = batch.schema.field("ids").type.list_size, i % BATCH_ROWS
    ids = batch.column("ids").flatten().slice(k * size, size)
    mask = batch.column("mask").flatten().slice(k * size, size)
    return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def _checksums(reader: pa.ipc.RecordBatchFileReader, sizes: list[int]) -> list[int]:
    """crc32 of each document's ids as little-endian uint32, from one batch of the shard at a time."""
    out, number, ids = [], -1, np.zeros(0, np.uint16)
    for size in sizes:
        crc = 0
        while size:
            if not len(ids):
                number += 1
                ids = reader.get_batch(number).column("ids").flatten().to_numpy()
            part = ids[:size]
            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
            ids, size = ids[size:], size - len(part)
        out.append(crc)
    return out


def read_documents(manifest: DataFrame) -> DataFrame:
    """Reads the shards back, one task a shard: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    rows = manifest.orderBy("shard").collect()  # one row for up to SHARD_TOKENS ids
    begin = np.cumsum([0, *(r["n_tokens"] for r in rows)]).tolist()
    plan = [(n, r["path"], r["docs_path"], b) for n, (r, b) in enumerate(zip(rows, begin, strict=False))]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, docs_path, base in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                index = open_shard(docs_path).read_all()
                start, n = (index.column(k).to_numpy() for k in ("start", "n_tokens"))
                crc = _checksums(open_shard(path), n.tolist())
                out = [index.column("doc_id").combine_chunks(), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.createDataFrame(plan, "number long, path string, docs_path string, base long")
    return shards.repartition(max(1, len(plan)), "number").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes all documents under the shared folder and returns what the files say of each."""
    out_dir = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_documents(write_tokens(docs, out_dir, tokenizer_path))
