"""Phrase collocations: counts of all phrases of one to three words by language, and the phrases whose words belong together.

Counting. A task numbers the words that it meets and counts phrases in a HAT-trie for each language: the levels of the
trie are word numbers, its leaves are hash tables (``Box``) over a range of numbers at their level. A box that has
``BURST`` entries bursts: in two at the middle of its range, or, if it holds a single word, into a node for the next
word; so hot first words get a subtree of their own and the trie stays shallow. Words on their own are counted in the
first level. When all boxes hold ``MAX_ENTRIES``, whole subtrees leave the trie as a sorted run, those first that have the
fewest occurrences an entry, until half is left; the words, too, are bounded by ``MAX_WORDS``.

A run is cut by partitions of phrase prefixes: a hash of the language and the first two words, spread over
``SPREAD`` neighbours by the third word, so that one hot prefix doesn't fill one partition. A cut is one packed row: its
distinct words in byte order, and the phrases as numbers in that list. For each partition the runs are merged: their word
lists become one list in byte order, which leaves every run sorted, and equal phrases are added up. So a shuffled phrase
takes a few bytes, a phrase in all documents one entry a run, and counts are exact, by the words themselves.

Only phrases that occur ``min_count`` times go on: a candidate's parts occur as often as it does. What follows are joins
of that small table.

Defined results: texts that are null, empty or without words count nothing; a null language is ``und``; repeated rows
count as often as they stand there; words are what stands between spaces and tabs within a piece, whatever its letters;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tributary.llm.encode import column_blocks
from tributary.llm.exchange import pack, unpack
from tributary.llm.kernel import LOWER, mix, utf8
from tributary.session import save

MIN_COUNT, TOP, COVER = 10, 2000, 50
BURST, MAX_ENTRIES, MAX_WORDS = 1 << 16, 800_000, 400_000
SPREAD = 64
#: Bytes of text for each partition of prefixes, and of a segment: its phrases may come on top of MAX_ENTRIES.
PER_PARTITION, BLOCK = 16 << 20, 2 << 20

#: A key holds three words of 21 bits: the first word's number, and the numbers + 1 of the others or 0.
_BITS = 21
_MASK = np.int64((1 << _BITS) - 1)

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09]] = True
_APART = _BREAK | _SPACE


class Box(Counter):
    """A hash table of keys whose word at the box's level lies in its range."""

    seen = 0


def _box(keys: np.ndarray, counts: np.ndarray) -> Box:
    out = Box()
    dict.update(out, zip(keys.tolist(), counts.tolist(), strict=True))
    return out


class Node:
    """Children by the number of one word of the key; a child from ``starts[i]`` on is a box, or the node of one word."""

    def __init__(self, level: int, box: Box | None = None):
        self.level, self.shift = level, _BITS * (2 - level)
        self.starts, self.children = [0], [Box() if box is None else box]

    def add(self, keys: np.ndarray, burst: int) -> None:
        """``keys`` are sorted and belong to this node."""
        words = keys >> self.shift & _MASK
        cuts = [*np.searchsorted(words, self.starts).tolist(), len(keys)]
        for i in range(len(self.starts) - 1, -1, -1):  # from behind, since bursting adds children
            if cuts[i] == cuts[i + 1]:
                continue
            child, part = self.children[i], keys[cuts[i] : cuts[i + 1]]
            if isinstance(child, Node):
                child.add(part, burst)
                continue
            child.update(part.tolist())
            child.seen += len(part)
            if len(child) > burst:
                self._burst(i, burst)

    def _burst(self, i: int, burst: int) -> None:
        box = self.children[i]
        keys = np.fromiter(box, np.int64, len(box))
        words = keys >> self.shift & _MASK
        low, high = int(words.min()), int(words.max())
        if low == high:
            if self.level == 1:
                return  # the last word's level: a box of one prefix may grow
            child = Node(self.level + 1, box)
            begin, end = low, low + 1
            # Other words of the box's range keep an empty box on each side.
            stop = self.starts[i + 1] if i + 1 < len(self.starts) else None
            starts, children = ([begin], [child]) if self.starts[i] == begin else ([self.starts[i], begin], [Box(), child])
            if stop is None or end < stop:
                starts, children = [*starts, end], [*children, Box()]
            self.starts[i : i + 1], self.children[i : i + 1] = starts, children
            return
        middle = max(low + 1, int(np.median(words)))
        counts, at_left = np.fromiter(box.values(), np.int64, len(box)), words < middle
        left, right = (_box(keys[x], counts[x]) for x in (at_left, ~at_left))
        left.seen, right.seen = box.seen * len(left) // len(box), box.seen * len(right) // len(box)
        self.starts[i : i + 1], self.children[i : i + 1] = [self.starts[i], middle], [left, right]

    def boxes(self) -> Iterator[Box]:
        for child in self.children:
            if isinstance(child, Node):
                yield from child.boxes()
            else:
                yield child

    def sizes(self) -> list[tuple[int, int]]:
        """Entries and occurrences of each child's subtree."""
        out = []
        for child in self.children:
            boxes = child.boxes() if isinstance(child, Node) else [child]
            found = [(len(b), b.seen) for b in boxes]
            out.append((sum(n for n, _ in found), sum(s for _, s in found)))
        return out

    def take(self, i: int) -> list[Box]:
        """The boxes of a subtree, which becomes empty."""
        child = self.children[i]
        self.children[i] = Box()
        return list(child.boxes()) if isinstance(child, Node) else [child]


def segments(data: np.ndarray, off: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """The words of consecutive texts, in segments of about ``limit`` bytes that cut no word: their lower-cased bytes and
    offsets, which of them begin a piece, and whether the last piece goes on."""
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + limit)
        while hi < n and not _APART[data[hi]]:
            more = np.flatnonzero(_APART[data[hi : hi + limit]])
            hi = min(n, hi + (int(more[0]) if len(more) else limit))
        part = data[lo:hi]
        inside, head = ~_APART[part], np.zeros(hi - lo, bool)
        head[off[np.searchsorted(off, lo) : np.searchsorted(off, hi)] - lo] = True  # a text begins
        starts = np.flatnonzero(inside & (head | ~np.concatenate(([False], inside[:-1]))))
        ends = np.flatnonzero(inside & np.concatenate((head[1:] | ~inside[1:], [True]))) + 1
        breaks = np.cumsum(_BREAK[part] | head, dtype=np.int32)  # up to a byte, with it
        at = breaks[starts]
        is_open = hi < n and breaks[-1] == (at[-1] if len(at) else 0)
        yield LOWER[part[inside]], np.concatenate(([0], np.cumsum(ends - starts))), np.diff(at, prepend=np.int32(0)) > 0, bool(is_open)
        lo = hi


class Counts:
    """A task's phrases: the words it has numbered, a trie for each language, and the runs that leave."""

    def __init__(self, partitions: int, max_words: int = 3, burst: int = BURST, max_entries: int = MAX_ENTRIES, max_vocabulary: int = MAX_WORDS):
        self.partitions, self.max_words, self.burst, self.max_entries = partitions, max_words, burst, max_entries
        self.max_vocabulary = min(max_vocabulary, (1 << _BITS) - 2)
        self._clear()

    def _clear(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.tries: dict[str, Node] = {}
        self.held = 0  # entries at most

    def _number(self, word: bytes) -> int:
        found = self.numbers.setdefault(word, len(self.names))
        if found == len(self.names):
            self.names.append(word)
        return found

    def _numbers(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        words = pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_pylist()
        table = np.fromiter(map(self.numbers.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(table < 0)
        table[new] = np.arange(len(self.names), len(self.names) + len(new))
        fresh = [distinct[k] for k in new.tolist()]
        self.numbers.update(zip(fresh, table[new].tolist(), strict=True))
        self.names += fresh
        return table[words.indices.to_numpy()]

    def add(self, lang: str, data: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts the texts (bytes and offsets) of a language; yields what the trie spills."""
        carry: list[bytes] = []  # the last words of a piece that goes on in the next segment
        for words, ends, begins, is_open in segments(data, off, BLOCK):
            if len(self.numbers) + len(begins) > (1 << _BITS) - 4:  # the segment might bring as many new words
                yield from self.flush()
            ids = self._numbers(words, ends)
            ahead = [self._number(w) for w in carry]
            begins = np.concatenate((np.zeros(len(ahead), bool), begins))
            ids = np.concatenate((np.array(ahead, np.int64), ids))
            self._phrases(lang, ids, begins, len(ahead))
            carry = []
            if is_open and self.max_words > 1:
                last = np.flatnonzero(begins)
                tail = ids[last[-1] if len(last) else 0 :][1 - self.max_words :]
                carry = [self.names[k] for k in tail.tolist()]
            yield from self._spill()
        if len(self.numbers) > self.max_vocabulary:
            yield from self.flush()

    def _phrases(self, lang: str, ids: np.ndarray, begins: np.ndarray, carried: int) -> None:
        """Adds the phrases whose last word is not carried."""
        trie = self.tries.setdefault(lang, Node(0))
        key, fits = ids << 2 * _BITS, np.ones(len(ids), bool)  # of phrases that begin at a word
        for width in range(1, self.max_words + 1):
            if width > 1:
                key = key[:-1] | (ids[width - 1 :] + 1) << _BITS * (3 - width)
                fits = fits[:-1] & ~begins[width - 1 :]
            whole = fits.copy()
            whole[: max(0, carried - width + 1)] = False
            found = key[whole]
            found.sort()
            self.held += len(found)
            if len(found):
                trie.add(found, self.burst)

    def _spill(self) -> Iterator[pa.RecordBatch]:
        """Subtrees leave while the boxes hold too much, until half is left."""
        if self.held <= self.max_entries:
            return
        parts = [(seen / n, n, lang, i) for lang, trie in self.tries.items() for i, (n, seen) in enumerate(trie.sizes()) if n]
        self.held = sum(p[1] for p in parts)
        if 4 * self.held <= 3 * self.max_entries:
            return
        gone: dict[str, list[Box]] = {}
        for _, n, lang, i in sorted(parts):
            gone.setdefault(lang, []).extend(self.tries[lang].take(i))
            self.held -= n
            if 2 * self.held <= self.max_entries:
                break
        for lang, boxes in gone.items():
            yield from self._run(lang, boxes)

    def flush(self) -> Iterator[pa.RecordBatch]:
        """Everything leaves, and numbering begins anew."""
        for lang, trie in self.tries.items():
            yield from self._run(lang, list(trie.boxes()))
        self._clear()

    def _run(self, lang: str, boxes: list[Box]) -> Iterator[pa.RecordBatch]:
        """A sorted run, cut by prefix partitions; a row each."""
        boxes = [b for b in boxes if b]
        if not boxes:
            return
        keys = np.concatenate([np.fromiter(b, np.int64, len(b)) for b in boxes])
        counts = np.concatenate([np.fromiter(b.values(), np.int64, len(b)) for b in boxes])
        w = [(keys >> 2 * _BITS) + 1, keys >> _BITS & _MASK, keys & _MASK]
        used = np.zeros(len(self.names) + 1, bool)
        for x in w:
            used[x] = True
        numbers = np.flatnonzero(used[1:])
        own = [self.names[k] for k in numbers.tolist()]
        words = pa.array(own, pa.binary())
        order = pc.sort_indices(words)
        words, order = words.take(order), order.to_numpy()
        crc = np.zeros(len(order) + 1, np.uint64)
        crc[1:] = np.fromiter(map(zlib.crc32, own), np.uint64, len(own))[order]
        rank = np.zeros(len(used), np.int64)
        rank[numbers[order] + 1] = np.arange(1, len(order) + 1)
        w = [rank[x] for x in w]
        home = mix(crc[w[0]] + np.uint64(zlib.crc32(lang.encode()) << 32)) + crc[w[1]] * np.uint64(0x9E3779B97F4A7C15)
        part = ((mix(home) >> np.uint64(8)) + crc[w[2]] % np.uint64(SPREAD)) % np.uint64(self.partitions)
        order = np.argsort((w[0] << 2 * _BITS) | (w[1] << _BITS) | w[2])
        part = part[order]
        order = order[np.argsort(part.astype(np.uint16) if self.partitions <= 1 << 16 else part, kind="stable")]
        part = np.sort(part)
        w, counts = [x[order].astype(np.uint32) for x in w], counts[order]
        edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)])).tolist()
        local, press = np.zeros(len(words) + 1, np.uint32), zstandard.ZstdCompressor(1).compress
        for a, b in pairwise(edges):
            cut = [x[a:b] for x in w]
            there = np.zeros(len(words) + 1, bool)
            for x in cut:
                there[x] = True
            there = np.flatnonzero(there[1:])
            local[there + 1] = np.arange(1, len(there) + 1)
            first, *rest = (local[x] for x in cut)
            raw = b"".join((pack(np.diff(first, prepend=np.uint32(0))), *map(pack, rest)))
            row = ([int(part[a])], [lang], *([press(x)] for x in (_joined(words.take(pa.array(there))), raw, pack(counts[a:b]))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, _RUN_KINDS, strict=True)], _RUN_NAMES)


def _joined(words: pa.Array) -> bytes:
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), b" ")[0].as_py()


_RUN = "part long, lang string, words binary, phrases binary, counts binary"
_RUN_NAMES = [x.split()[0] for x in _RUN.split(", ")]
_RUN_KINDS = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())
_SUMS = "lang string, width int, phrase string, f long"


def _unpacked(raw: bytes) -> list[np.ndarray]:
    size = len(raw) // 3
    first, *rest = (unpack(raw[k * size : (k + 1) * size], np.uint32) for k in range(3))
    return [np.cumsum(first, dtype=np.uint32), *rest]


def _merge_runs(words: list[bytes], phrases: list[bytes], counts: list[bytes], min_count: int) -> tuple[list[tuple[pa.Array, np.ndarray]], int]:
    """Phrases of each width that occur ``min_count`` times, with their counts, and the number of all words."""
    expand = zstandard.ZstdDecompressor().decompress
    lists = [pc.split_pattern(pa.array([expand(x)], pa.binary()), b" ").flatten() for x in words]
    coded = pa.concat_arrays(lists).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    names = coded.dictionary.take(pa.array(order))
    rank = np.zeros(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    codes, at = rank[coded.indices.to_numpy()], 0
    base = len(names) + 1
    fits = base**3 < 1 << 63  # else prefixes count by their rank
    keys, thirds, sums, total = [], [], [], 0
    for own, raw, n in zip(lists, phrases, counts, strict=True):
        table = np.concatenate(([0], codes[at : at + len(own)]))
        at += len(own)
        w, n = _unpacked(expand(raw)), unpack(expand(n), np.int64)
        prefix, third = table[w[0]] * base + table[w[1]], table[w[2]]
        keys.append(prefix * base + third if fits else prefix)
        if not fits:
            thirds.append(third)
        sums.append(n)
        total += int(n[w[1] == 0].sum())
    key, n = np.concatenate(keys), np.concatenate(sums)
    del keys, sums, coded, lists, codes
    if not fits:
        prefixes, key = np.unique(key, return_inverse=True)
        key = key * base + np.concatenate(thirds)
    order = np.argsort(key, kind="stable")  # a merge of the sorted runs
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    sums = np.add.reduceat(n, first)
    keep = sums >= min_count
    key, sums = key[first[keep]], sums[keep]
    prefix = key // base if fits else prefixes[key // base]
    w = [prefix // base, prefix % base, key % base]
    out = []
    for width in (1, 2, 3):
        of = ((w[1] > 0).astype(int) + (w[2] > 0) + 1) == width
        parts = [names.take(pa.array(x[of] - 1)) for x in w[:width]]
        out.append((pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())) if width > 1 else parts[0], sums[of]))
    return out, total


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = 3, burst: int = BURST, max_entries: int = MAX_ENTRIES, max_vocabulary: int = MAX_WORDS) -> DataFrame:
    """lang, width, phrase, f: all phrases of one to ``max_words`` words (at most three) that occur ``min_count`` times.
    Rows of width 0 without a phrase add up to the number of all words of a language."""
    if not 1 <= max_words <= 3:
        raise ValueError("phrases have one to three words")
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(1, -(-size // PER_PARTITION))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(partitions, max_words, burst, max_entries, max_vocabulary)
        for batch in batches:
            for lo, hi in column_blocks(batch.column(1), BLOCK):
                langs = batch.column(0).slice(lo, hi - lo).dictionary_encode()
                texts = batch.column(1).slice(lo, hi - lo)
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    data, off = utf8(texts.filter(pc.equal(langs.indices, k)))
                    yield from counts.add(lang, data, off)
        yield from counts.flush()

    def merge(table: pa.Table) -> pa.Table:
        rows: dict[str, list[tuple]] = {}
        for lang, *raw in zip(*(table.column(c).to_pylist() for c in _RUN_NAMES[1:]), strict=True):
            rows.setdefault(lang, []).append(raw)
        out = []
        for lang, runs in rows.items():
            found, total = _merge_runs(*map(list, zip(*runs, strict=True)), min_count)
            found = [(width, p, n) for width, (p, n) in enumerate(found, 1)] + [(0, pa.array([None], pa.binary()), np.array([total]))]
            for width, phrases, sums in found:
                columns = [pa.array([lang] * len(sums), pa.string()), pa.array([width] * len(sums), pa.int32()), phrases.cast(pa.string()), pa.array(sums, pa.int64())]
                out.append(pa.table(columns, ["lang", "width", "phrase", "f"]))
        return pa.concat_tables(out)

    return docs.mapInArrow(count, _RUN).groupBy("part").applyInArrow(merge, _SUMS)


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)), exactly: whole decimals of 38 digits hold all products of counts below 10^15; larger counts are an error."""
    a, left, right = (c.cast("decimal(15,0)") for c in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (a * a), left * right)


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, cover: int = COVER) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of two or three words of each language by score, among
    those that occur ``min_count`` times and are not covered by a longer one that occurs ``cover`` percent as often. The
    score is that of the weakest of a phrase's cuts in two."""
    counts = save(phrase_counts(docs, min_count), "phrase-counts")
    total = counts.where("width = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    words = F.split("phrase", " ", -1)

    def of(width: int, key: str, value: str) -> DataFrame:
        return counts.where(F.col("width") == width).select(F.col("lang").alias(f"{key}_lang"), F.col("phrase").alias(key), F.col("f").alias(value))

    def with_count(rows: DataFrame, width: int, column: str, value: str) -> DataFrame:
        key = f"{column}_key"
        return rows.join(of(width, key, value), (F.col("lang") == F.col(f"{key}_lang")) & (F.col(column) == F.col(key))).drop(key, f"{key}_lang")

    pairs = counts.where("width = 2").select("lang", "phrase", F.col("f").alias("a"), F.get(words, F.lit(0)).alias("w1"), F.get(words, F.lit(1)).alias("w2"))
    triples = counts.where("width = 3").select(
        "lang", "phrase", F.col("f").alias("a"), *(F.get(words, F.lit(k)).alias(f"w{k + 1}") for k in range(3)),
        F.concat_ws(" ", F.slice(words, 1, 2)).alias("w12"), F.concat_ws(" ", F.slice(words, 2, 2)).alias("w23"),
    )
    covering = triples.select("lang", F.explode(F.array("w12", "w23")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    pairs = pairs.join(covering, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    pairs = with_count(with_count(pairs, 1, "w1", "l"), 1, "w2", "r")
    two = pairs.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    for width, column, value in ((1, "w1", "l1"), (2, "w23", "r1"), (2, "w12", "l2"), (1, "w3", "r2")):
        triples = with_count(triples, width, column, value)
    triples = triples.withColumns({f"s{k}": _score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")) for k in (1, 2)})
    early = F.col("s1") <= F.col("s2")
    three = triples.select("lang", "phrase", "a", *(F.when(early, F.col(f"{x}1")).otherwise(F.col(f"{x}2")).alias(y) for x, y in (("l", "l"), ("r", "r"), ("s", "score"))))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))
    # The best of each of SPREAD shares of a language first, so that no task sees all phrases of a hot one.
    shares = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    best = two.unionByName(three).withColumn("rank", F.row_number().over(shares)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
