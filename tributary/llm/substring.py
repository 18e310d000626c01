"""Substring dedup by content-defined chunking.

A gear hash rolls over the words of a text: ``h = (h << 16) + G(word)`` in 64 bits, so that it depends on the last four
words, and a chunk begins at the smallest value of every ``2 * MEAN_CHUNK - 1`` adjacent ones (the last of equal ones), on
average every fourth word. Boundaries depend on nearby words only: text inserted before a passage does not move the
passage's chunks. No chunk inside a text is longer than 7 words, whatever the text repeats, and of a passage of 48 words
the boundaries from the 10th to the seventh last word are the same wherever it stands: one by the 16th word, and 20 to 26
words on another, so that every repeated passage of over 50 words has a whole stretch of its own. What is compared are stretches: from
each chunk on as many whole chunks as make ``MIN_WORDS`` words, by the 64-bit digest of their lower-cased words. A
stretch is a repeat if it occurs, word for word, in one document with a smaller doc_id; repeated stretches that overlap or
touch are one run, which is removed, and the first document keeps the passage. Shorter repeats, however many of them stand
side by side, and lines repeated inside one document only, stay.

Digests are exchanged by ``exchange``: every document is compared with all others.

Defined results: null and empty texts stay as they are and have no spans; rows with equal doc_id are one document to
each other and don't remove each other's text; a null doc_id counts as the largest; a text of which nothing is left
becomes empty, the row stays; other columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.llm.exchange import ask, bucket_edges, n_buckets, n_groups, pack, sizes, tell, unpack, with_group
from tributary.llm.kernel import Words, _power_tables, blocks, mix, utf8

MIN_WORDS = 20
MEAN_CHUNK = 4
WINDOW = 4
_LAST = np.iinfo(np.int64).max


def _begins(words: Words, gear: np.ndarray, mean: int) -> np.ndarray:
    """Which words begin a chunk."""
    n, reach = len(gear), 2 * mean - 1
    rolled = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        rolled[j:] += gear[: n - j] << np.uint64(16 * j)
    value = (rolled >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    head = words.first[:-1]
    for j in range(WINDOW - 1):  # no boundary before the window is full; the zeros also part the texts
        at = head + j
        value[at[at < words.first[1:]]] = 0
    free = np.ones(n, np.int8)  # values in a row, this one in them, of which it is the smallest
    left, right = np.ones(n, bool), np.ones(n, bool)
    for j in range(1, min(reach, n + 1)):
        left[j:] &= value[: n - j] >= value[j:]
        right[: n - j] &= value[j:] > value[: n - j]
        left[:j] = right[n - j :] = False
        free += left
        free += right
    begins = (free >= reach) & (value > 0)
    begins[head[head < words.first[1:]]] = True
    return begins


def stretches(data: np.ndarray, off: np.ndarray, min_words: int, mean: int = MEAN_CHUNK) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words; first word, end, digest and text number of each stretch: the fewest whole chunks from a chunk's first word
    on that have ``min_words`` words. Ends of texts end chunks, texts with fewer words have no stretch."""
    words = Words(data, off)
    gear = words.hashes()
    n = len(gear)
    first = np.append(np.flatnonzero(_begins(words, gear, mean)), n)
    row = np.searchsorted(words.first, first[:-1], "right") - 1
    enough = first[:-1] + min_words <= words.first[row + 1]
    begin, row = first[:-1][enough], row[enough]
    end = first[np.searchsorted(first, begin + min_words)]
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(gear * power[:n], out=total[1:])
    digest = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    return words, begin, end, digest, row


def _parts(column: pa.ChunkedArray):
    """Blocks of texts with the number of their first row."""
    data, off = utf8(column)
    for lo, hi in blocks(off):
        yield lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(table.column("doc_id"), _LAST).to_numpy().astype(np.int64)


def _firsts(table: pa.Table, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct digests of a group, sorted, and the smallest doc_id of each."""
    ids = _ids(table)
    digests, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, data, off in _parts(table.column("text")):
        *_, digest, row = stretches(data, off, min_words)
        digests.append(digest)
        owners.append(ids[lo + row])
    digest, owner = np.concatenate(digests), np.concatenate(owners)
    order = np.lexsort((owner, digest))
    digest, owner = digest[order], owner[order]
    new = np.concatenate((np.ones(min(1, len(digest)), bool), digest[1:] != digest[:-1]))
    return digest[new], owner[new]


def _sender(buckets: int, min_words: int):
    def send(table: pa.Table):
        digest, owner = _firsts(table, min_words)
        edges = bucket_edges(digest, buckets)
        used = np.flatnonzero(np.diff(edges))
        cut = [slice(edges[b], edges[b + 1]) for b in used]
        return used, [pack(np.diff(digest[c], prepend=np.uint64(0))) for c in cut], [pack(owner[c]) for c in cut]

    return send


def _answer(keys: list[bytes], values: list[bytes]) -> list[bytes]:
    """For each key sent, whether other groups have it, and then the smallest doc_id of all."""
    digests = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in keys]
    digest, owner = np.concatenate(digests), np.concatenate([unpack(v, np.int64) for v in values])
    order = np.lexsort((owner, digest))
    new = np.concatenate(([True], digest[order][1:] != digest[order][:-1]))
    run = np.cumsum(new) - 1
    first, many = np.empty(len(digest), np.int64), np.empty(len(digest), bool)
    first[order] = owner[order][new][run]
    many[order] = np.bincount(run)[run] > 1
    out, at = [], 0
    for d in digests:
        part = slice(at, at + len(d))
        out.append(np.packbits(many[part]).tobytes() + pack(first[part][many[part]]))
        at += len(d)
    return out


def _resolve(table: pa.Table, replies: dict[int, bytes], buckets: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The group's digests and the smallest doc_id of each in the whole corpus."""
    digest, first = _firsts(table, min_words)
    edges = bucket_edges(digest, buckets)
    for b, raw in replies.items():
        n = int(edges[b + 1] - edges[b])
        size = -(-n // 8)
        many = np.unpackbits(np.frombuffer(raw[:size], np.uint8), count=n).astype(bool)
        first[edges[b] + np.flatnonzero(many)] = unpack(raw[size:], np.int64)
    return digest, first


def _spans(table: pa.Table, replies: dict[int, bytes], buckets: int, min_words: int):
    """(row, first word, words, from byte, to byte, first documents) of each run of repeats, in row order."""
    digest, first = _resolve(table, replies, buckets, min_words)
    ids = _ids(table)
    for lo, data, off in _parts(table.column("text")):
        words, begin, end, own, row = stretches(data, off, min_words)
        source = first[np.searchsorted(digest, own)]
        repeat = source < ids[lo + row]
        if not repeat.any():
            continue
        begin, end, row, source = begin[repeat], end[repeat], row[repeat], source[repeat]  # begin and end both grow
        new = np.concatenate(([True], (begin[1:] > end[:-1]) | (row[1:] != row[:-1])))
        runs = np.append(np.flatnonzero(new), len(begin))
        for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
            r, w0, w1 = int(row[a]), int(begin[a]), int(end[b - 1])
            stop = words.starts[w1] if w1 < words.first[r + 1] else off[r + 1]
            docs = sorted(set(source[a:b].tolist()))
            yield lo + r, w0 - int(words.first[r]), w1 - w0, int(words.starts[w0] - off[r]), int(stop - off[r]), docs


_SPANS = "doc_id long, span int, start_word long, n_words long, start_char long, n_chars long, first_docs array<long>"


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row for each passage to remove: doc_id, span, start_word, n_words, start_char, n_chars, first_docs (the
    documents that keep its stretches)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n = sizes(docs)
    buckets = n_buckets(*n)
    keyed = with_group(docs, n_groups(*n))

    def use(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        rows: list[list] = [[], [], [], [], [], [], []]
        last, number, texts, ids = -1, 0, table.column("text"), table.column("doc_id")
        for r, word, n, a, b, sources in _spans(table, replies, buckets, min_words):
            if r != last:
                raw, number, done, place = texts[r].as_py().encode(), -1, 0, 0
            last, number = r, number + 1
            place += len(raw[done:a].decode())  # spans of a text come in order
            chars = len(raw[a:b].decode())
            for column, value in zip(rows, (ids[r].as_py(), number, word, n, place, chars, sources), strict=True):
                column.append(value)
            done, place = b, place + chars
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int64())]
        names = ["doc_id", "span", "start_word", "n_words", "start_char", "n_chars", "first_docs"]
        return pa.table([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names)

    return tell(keyed, ask(keyed, _sender(buckets, min_words), _answer), use, _SPANS)


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with repeated passages taken out of ``text``; all other columns and rows are kept."""
    columns = docs.columns
    if docs.schema["doc_id"].dataType != T.LongType() or docs.schema["text"].dataType != T.StringType():
        docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    n = sizes(docs)
    buckets = n_buckets(*n)
    keyed = with_group(docs, n_groups(*n))

    def use(table: pa.Table, replies: dict[int, bytes]) -> pa.Table:
        cuts: dict[int, list[tuple[int, int]]] = {}
        for r, _, _, a, b, _ in _spans(table, replies, buckets, min_words):
            cuts.setdefault(r, []).append((a, b))
        texts = table.column("text").to_pylist() if cuts else None
        for r, ranges in cuts.items():
            raw, at, kept = texts[r].encode(), 0, []
            for a, b in ranges:
                kept.append(raw[at:a])
                at = b
            texts[r] = b"".join([*kept, raw[at:]]).decode() if at < len(raw) else b"".join(kept).decode().rstrip()
        if cuts:
            table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))
        return table.select(columns)

    schema = T.StructType([T.StructField(c, keyed.schema[c].dataType) for c in columns])
    return tell(keyed, ask(keyed, _sender(buckets, min_words), _answer), use, schema)
