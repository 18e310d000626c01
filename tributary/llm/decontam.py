"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's word windows, each text scanned once.

Texts and items are normalised alike: A-Z lower-cased, words of digits, letters and non-ASCII characters joined by one
space. A window is ``width`` consecutive words of an item; an item of fewer words, but not none, is one window. Every
window is a pattern of a single automaton, with a space at both ends so that it matches whole words only. Matches are
mapped to word numbers and, for the spans, to character offsets of the original text.

The automaton is broadcast only up to ``max_block_bytes`` of patterns; a larger benchmark is cut into blocks of items,
every block is an automaton of its own, and each pass adds its word ranges to those of the passes before.

Defined results: a null or wordless text has no words and is clean; an empty benchmark leaves every document clean;
repeated items are separate items that share windows; repeated document rows are judged row by row;
``decontaminate`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 13
#: Bytes of patterns in one automaton: it takes about 48 bytes of memory for each, in every Python worker.
MAX_BLOCK_BYTES = 8 << 20

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalise(text: str | None) -> str:
    """`` w1 w2 ... `` as one character per UTF-8 byte; empty if there is no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()
    return f" {b' '.join(words).decode('latin-1')} " if words else ""


def windows(text: str | None, width: int = WINDOW) -> list[str]:
    words = normalise(text).split(" ")[1:-1]
    return sorted({f" {' '.join(words[i : i + width])} " for i in range(max(1, len(words) - width + 1))}) if words else []


def item_blocks(benchmark: DataFrame, width: int, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks whose patterns stay under ``limit`` bytes; rows arrive one partition at a time."""
    block, size, seen = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        need = len(row[1] or "") * width
        if block and size + need > limit:
            yield block
            block, size, seen = [], 0, True
        block.append((row[0], row[1]))
        size += need
    if block or not seen:
        yield block


_built: dict[int, tuple] = {}


def _automaton(shared) -> tuple[ahocorasick.Automaton, list[tuple[int, list[str]]]]:
    """Built once in each Python worker. Per window: its words and the ids of the items that have it."""
    key = id(shared.value)
    if key not in _built:
        width, items = shared.value
        owners: dict[str, set[str]] = {}
        for item_id, text in items:
            for window in windows(text, width):
                owners.setdefault(window, set()).add(str(item_id))
        auto, found = ahocorasick.Automaton(), []
        for k, (window, ids) in enumerate(owners.items()):
            auto.add_word(window, k)
            found.append((window.count(" ") - 1, sorted(ids)))
        if owners:
            auto.make_automaton()
        _built.clear()
        _built[key] = auto, found, shared.value
    return _built[key][:2]


def _matches(text: str | None, auto, found) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Number of words, word ranges [from, to) of the windows that occur, ids of their items."""
    norm = normalise(text)
    if not norm:
        return 0, [], set()
    ranges, items, at, word = [], set(), 0, -1
    for end, k in auto.iter(norm) if len(auto) else ():
        word += norm.count(" ", at, end + 1)
        at = end + 1
        size, ids = found[k]
        ranges.append((word - size, word))
        items.update(ids)
    return norm.count(" ") - 1, ranges, items


def word_offsets(text: str) -> np.ndarray:
    """Character ranges [start, end) of the words in the original text."""
    return np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)


_PAIRS = pa.list_(pa.list_(pa.int64()))
#: What a scan adds to a row, after a prefix that no column of the table has.
_ADDED = {"words": pa.int64(), "spans": _PAIRS, "chars": _PAIRS, "items": pa.list_(pa.string())}


def _prefix(columns: list[str]) -> str:
    prefix = "_hit_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = f"_{prefix}"
    return prefix


def _united(ranges: list) -> list[list[int]]:
    """Sorted, with overlapping and touching word ranges united."""
    out: list[list[int]] = []
    for lo, hi in sorted(map(list, ranges)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def _with_hits(docs: DataFrame, benchmark: DataFrame, width: int, max_block_bytes: int) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``docs`` with the columns of _ADDED, and these columns' names. One pass over the texts for each block
    of items."""
    spark, ranges = docs.sparkSession, F.array().cast("array<array<long>>")
    names = {name: f"{_prefix(docs.columns)}{name}" for name in _ADDED}
    first = {"words": F.lit(0).cast("long"), "spans": ranges, "chars": ranges, "items": F.array().cast("array<string>")}
    found = docs.withColumn("text", F.col("text").cast("string")).withColumns({names[k]: v for k, v in first.items()})
    for block in item_blocks(benchmark, width, max_block_bytes):
        shared = spark.sparkContext.broadcast((width, block))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            auto, patterns = _automaton(shared)
            for batch in batches:
                rows: dict[str, list] = {name: [] for name in _ADDED}
                columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
                before = zip(columns[names["spans"]].to_pylist(), columns[names["items"]].to_pylist(), strict=True)
                for text, (old, had) in zip(columns["text"].to_pylist(), before, strict=True):
                    n, ranges, items = _matches(text, auto, patterns)
                    spans = _united([*(old or []), *ranges])
                    at = word_offsets(text) if spans else None
                    chars = [[int(at[lo, 0]), int(at[hi - 1, 1])] for lo, hi in spans]
                    for name, value in zip(_ADDED, (n, spans, chars, sorted({*(had or []), *items})), strict=True):
                        rows[name].append(value)
                columns |= {names[name]: pa.array(rows[name], kind) for name, kind in _ADDED.items()}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

        found = found.mapInArrow(find, found.schema)
    return found, names


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, n_words, spans (word ranges hit), chars (the same as character ranges of the original
    text), items (ids of items with windows that occur, sorted as strings)."""
    hits, names = _with_hits(docs.select(F.col("doc_id").cast("long"), "text"), benchmark, width, max_block_bytes)
    return hits.select("doc_id", *(F.col(own).alias("n_words" if name == "words" else name) for name, own in names.items()))


def n_hit(spans: str = "spans"):
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x[1] - x[0])


def is_contaminated(spans: str = "spans", words: str = "n_words"):
    """At least one word is hit, and a twentieth of all words."""
    return (n_hit(spans) > 0) & (20 * n_hit(spans) >= F.col(words))


def report(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return scan(docs, benchmark, width).select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """The document rows that are not contaminated, with all their columns. No shuffle: rows pass through the scan."""
    hits, names = _with_hits(docs, benchmark, width, max_block_bytes)
    return hits.where(~is_contaminated(names["spans"], names["words"])).select(*docs.columns)
