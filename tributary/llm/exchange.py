"""Which hashes of a document also occur elsewhere: an exchange of packed hash arrays between groups and buckets.

Documents are dealt to groups by a hash of their id. A group sends each of its distinct hashes once, packed into one
binary row per bucket of the hash space; a bucket merges what all groups sent and answers each group in the order of its
keys; the group, read again together with the answers, knows of each hash what the whole corpus says. The numbers of
groups and buckets follow the number of documents, so that messages stay few and large. A hash that occurs
in a third of all documents costs a bucket one entry a group, not one a document, so that hot passages and large groups
of copies do not meet in one task, and an exchanged hash takes a few bytes instead of a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents in a group at least (below MIN_GROUPS groups) and at most, bytes of text in a group at most (on average), and
#: documents for each bucket; beyond MANY_BUCKETS a bucket holds FULL_BUCKET of them, so that messages stay large.
MIN_GROUP, MAX_GROUP, MIN_GROUPS, GROUP_BYTES = 1_000, 20_000, 256, 96 << 20
PER_BUCKET, MANY_BUCKETS, FULL_BUCKET = 5_000, 4_096, 100_000

#: The column of group numbers; no table is expected to have it.
GROUP = "__exchange_group"

_SENT = "grp int, bucket int, keys binary, vals binary"
_REPLY = "grp int, bucket int, reply binary"


def pack(x: np.ndarray) -> bytes:
    """Bytes by significance, so that small numbers compress well in the shuffle."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpack(raw: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def n_groups(n_docs: int, n_bytes: int = 0) -> int:
    return max(1, min(MIN_GROUPS, -(-n_docs // MIN_GROUP)), -(-n_docs // MAX_GROUP), -(-n_bytes // GROUP_BYTES))


def n_buckets(n_docs: int, n_bytes: int = 0) -> int:
    return max(min(MANY_BUCKETS, max(n_groups(n_docs, n_bytes), -(-n_docs // PER_BUCKET))), -(-n_docs // FULL_BUCKET))


def sizes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    return tuple(docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first())


def with_group(docs: DataFrame, n: int) -> DataFrame:
    """Adds GROUP, a hash of the id."""
    if GROUP in docs.columns:
        raise ValueError(f"a column must not be named {GROUP}")
    return docs.withColumn(GROUP, F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int"))


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins in sorted 64-bit keys; buckets + 1 numbers."""
    bounds = [(k << 64) // buckets for k in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(bounds, np.uint64)), [len(keys)])).astype(np.int64)


def bucket_base(bucket: int, buckets: int) -> np.uint64:
    return np.uint64(-(-(bucket << 64) // buckets) if bucket else 0)


def ask(
    docs: DataFrame,
    send: Callable[[pa.Table], tuple[np.ndarray, list[bytes], list[bytes]]],
    answer: Callable[[list[bytes], list[bytes]], list[bytes]],
) -> DataFrame:
    """The answers for each group of ``docs`` (column GROUP). ``send`` gives a group's bucket numbers, keys and values;
    ``answer`` gets the keys and values of one bucket's groups and returns a reply for each."""

    def out(table: pa.Table) -> pa.Table:
        numbers, keys, values = send(table)
        grp = pa.array([table.column(GROUP)[0].as_py()] * len(keys), pa.int32())
        return pa.table({"grp": grp, "bucket": pa.array(numbers, pa.int32()), "keys": pa.array(keys, pa.binary()), "vals": pa.array(values, pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        replies = answer(table.column("keys").to_pylist(), table.column("vals").to_pylist())
        return pa.table({"grp": table.column("grp"), "bucket": table.column("bucket"), "reply": pa.array(replies, pa.binary())})

    return docs.groupBy(GROUP).applyInArrow(out, _SENT).groupBy("bucket").applyInArrow(merge, _REPLY)


def tell(docs: DataFrame, answers: DataFrame, use: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str) -> DataFrame:
    """Runs ``use`` on each group's rows and its answers by bucket."""

    def both(rows: pa.Table, replies: pa.Table) -> pa.Table:
        return use(rows, dict(zip(replies.column("bucket").to_pylist(), replies.column("reply").to_pylist(), strict=True)))

    return docs.groupBy(GROUP).cogroup(answers.groupBy("grp")).applyInArrow(both, schema)
