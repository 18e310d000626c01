"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, and how often which ids do.

Both tokenizers write the same bytes, a space and the text. The byte offsets where a token of A and one of B end together
cut both sequences into groups; the last tokens of a group are a link. How often a pair of ids is linked is counted over
the whole corpus.

The usual case goes by an identity map: for each id of A the id of B with the same bytes, made once from the two
vocabularies. A group of one token each whose ids the map joins is counted in a vector as long as A's vocabulary; only
links of other groups are shuffled as pairs, added up for a task before. The last tokens of such a group end with the same
byte, so one's bytes are a suffix of the other's: there are no more distinct pairs than suffixes of the tokens
(``most_pairs``, about half a million for vocabularies of 50,000 and 32,000 ids), whatever the corpus. So the table of
counts has a proven bound, and a second pass looks it up in a broadcast of it, without any shuffle by document.

Encoding. No token of the two supported layouts reaches over the beginning of " word" or "\\nword", so a text without
adjacent white space is cut there, and each distinct piece is encoded and aligned once; a table of pieces is kept. Other
texts, and other layouts, are encoded and aligned whole.

Defined results: texts that are null or empty, or of which A's or B's bytes are not the space and the text (such as a
literal U+2581, or a tokenizer that normalises), have no tokens: zeros and ''. Rows with equal or null doc_id are rows of
their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.encode import _alphabet, column_blocks, encoder, layout
from tributary.session import save

MAX_PIECES = 200_000
#: Pairs that a task counts before it sends them on.
MAX_PAIRS = 1_000_000
#: White space of any kind next to white space, or at an end of the text: what the cut could change.
_ODD = r"[\s\x0B\x1C-\x1F\x{85}\x{200B}\p{Z}]{2}|^[\s\x0B\x1C-\x1F\x{85}\x{200B}\p{Z}]|[\s\x0B\x1C-\x1F\x{85}\x{200B}\p{Z}]$"


class Vocabularies:
    """Two tokenizers, the bytes of their ids, and the identity map."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = encoder(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: b for b, c in _alphabet().items()}
        tokens = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(tokens.values()) + 1)
        for token, k in tokens.items():
            self.bytes_a[k] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [self._bytes_b(p) for p in pieces]
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        inner = any("▁" in p[1:] and p.strip("▁") or "\n" in p or " " in p for p in pieces)
        #: Whether texts may be cut before spaces and line ends.
        self.cuts = layout(spec) == "byte" and not inner and not any(map(self.b.is_unknown, self.b.encode("\n")))
        first = {}
        for k, raw in enumerate(self.bytes_b):
            if not self.b.is_control(k) and not self.b.is_unknown(k) and (raw not in first or self.b.is_byte(first[raw])):
                first[raw] = k  # a piece before a byte of the fallback
        self.identity = np.array([first.get(raw, -1) for raw in self.bytes_a], np.int64)

    @staticmethod
    def _bytes_b(piece: str) -> bytes:
        byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    @property
    def most_pairs(self) -> int:
        """A bound of the distinct irregular pairs: one token's bytes are a suffix of the other's; a suffix of one byte may
        be two ids of B."""
        return sum(len(x) + 1 for x in self.bytes_a) + sum(len(x) + 1 for x in self.bytes_b)

    def align(self, raw: bytes, a: list[int], b: list[int]) -> tuple | None:
        """Groups as text, the number of groups, and the links' ids and whether they are regular; None where the bytes of
        either side are not ``raw``."""
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        if b"".join([bytes_a[x] for x in a]) != raw or b"".join([bytes_b[x] for x in b]) != raw:
            return None
        groups, links_a, links_b, regular = [], [], [], []
        i = j = from_i = from_j = at_a = at_b = 0
        n, m = len(a), len(b)
        while i < n or j < m:
            if at_a <= at_b and i < n:
                at_a += len(bytes_a[a[i]])
                i += 1
            else:
                at_b += len(bytes_b[b[j]])
                j += 1
            if at_a == at_b:
                one = i - from_i == 1 and j - from_j == 1
                groups.append(f"{a[from_i]}|{b[from_j]}" if one else ",".join(map(str, a[from_i:i])) + "|" + ",".join(map(str, b[from_j:j])))
                links_a.append(a[i - 1])
                links_b.append(b[j - 1])
                regular.append(one and self.identity[a[i - 1]] == b[j - 1])
                from_i, from_j = i, j
        return ";".join(groups), links_a, links_b, regular


class Aligner:
    """Aligned texts of a column, by a table of pieces."""

    def __init__(self, words: Vocabularies, max_pieces: int = MAX_PIECES):
        self.words, self.max_pieces = words, max_pieces
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.text = pa.array([], pa.large_string())
        #: Per piece: tokens of A and of B, where its links begin in the pools and how many they are; -1 tokens: no alignment.
        self.n_a, self.n_b, self.begin, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.a, self.b = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.regular = np.zeros(0, bool)

    def _table(self, raws: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]):
        """Columns of aligned texts, in the order of the attributes from ``text`` on; begin counts from 0."""
        texts, sizes, links = [], [], ([], [], [])
        for raw, a, b in zip(raws, ids_a, ids_b, strict=True):
            found = self.words.align(raw, a, b)
            text, *rest = found or ("", [], [], [])
            texts.append(text)
            sizes.append((len(a), len(b), len(rest[0])) if found else (-1, -1, 0))
            for column, x in zip(links, rest, strict=True):
                column += x
        n_a, n_b, size = np.array(sizes, np.int64).reshape(-1, 3).T
        return pa.array(texts, pa.large_string()), n_a, n_b, np.cumsum(size) - size, size, np.array(links[0], np.uint32), np.array(links[1], np.uint32), np.array(links[2], bool)

    def _encode(self, piece: str) -> list[int]:
        a = self.words.a
        raw = a.piece(" " + piece) if piece[0] != "\n" else a.line_end() + (a.piece(piece[1:]) if piece[1:] else b"")
        return np.frombuffer(raw, np.uint32).tolist()

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        if len(self.known) > self.max_pieces:
            self.clear()
        found = pc.fill_null(pc.index_in(coded.dictionary, self.known), -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = coded.dictionary.take(pa.array(new))
            names = fresh.to_pylist()
            ids_b = self.words.b.encode(names, num_threads=1)
            ids_b = [x[1:] if p[0] == "\n" else x for p, x in zip(names, ids_b, strict=True)]  # no space before a line end
            raws = [p.encode() if p[0] == "\n" else b" " + p.encode() for p in names]
            text, n_a, n_b, begin, size, *links = self._table(raws, [self._encode(p) for p in names], ids_b)
            found[new] = len(self.known) + np.arange(len(new))
            self.known, self.text = pa.concat_arrays([self.known, fresh]), pa.concat_arrays([self.text, text])
            begin += len(self.a)
            for name, x in zip(("n_a", "n_b", "begin", "size", "a", "b", "regular"), (n_a, n_b, begin, size, *links), strict=True):
                setattr(self, name, np.concatenate((getattr(self, name), x)))
        return found[coded.indices.to_numpy()]

    def _whole(self, texts: list[str]):
        raws = [" " + x for x in texts]
        ids_a = [e.ids for e in self.words.a.tokenizer.encode_batch(raws, add_special_tokens=False)]
        return self._table([x.encode() for x in raws], ids_a, self.words.b.encode(texts, num_threads=1))

    def align(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b and n_groups of each text, the groups as text, and ids and regularity of all links, text by text."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        odd = pc.or_(pc.match_substring_regex(texts, _ODD), pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)
        if not self.words.cuts:
            odd = np.ones(len(texts), bool)
        full = pc.binary_length(texts).to_numpy() > 0
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd & full)
        n, parts = len(texts), []
        if len(plain):
            cut = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n"), " ")
            off, slots = cut.offsets.to_numpy().astype(np.int64), self._slots(cut.flatten())
            joined = pc.binary_join(pa.ListArray.from_arrays(cut.offsets, self.text.take(pa.array(slots))), pa.scalar(";", pa.large_string()))
            size = self.size[slots]
            ends = np.cumsum(size)
            gather = np.repeat(self.begin[slots] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
            bad = np.add.reduceat(self.n_a[slots] < 0, off[:-1]) > 0
            per = [np.add.reduceat(x[slots], off[:-1]) for x in (self.n_a, self.n_b, self.size)]
            parts.append((plain, *per, bad, joined, self.a[gather], self.b[gather], self.regular[gather]))
        if len(rest):
            text, n_a, n_b, _, size, *links = self._whole(texts.take(pa.array(rest)).to_pylist())
            parts.append((rest, n_a, n_b, size, n_a < 0, text, *links))
        counts = np.zeros((3, n), np.int64)
        order, groups, links = [], [], []
        for rows, n_a, n_b, size, bad, text, *own in parts:
            keep = np.repeat(~bad, size)
            links.append([np.repeat(rows, size)[keep], *(x[keep] for x in own)])
            for k, x in enumerate((n_a, n_b, size)):
                counts[k, rows] = np.where(bad, 0, x)
            order.append(rows)
            groups.append(pc.if_else(pa.array(bad), "", text))
        empty = np.flatnonzero(~full)
        order, groups = np.concatenate([*order, empty]), pa.concat_arrays([*groups, pa.array([""] * len(empty), pa.large_string())])
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        columns = [np.concatenate(x) for x in zip(*links, strict=True)] if links else [np.zeros(0, np.int64), self.a[:0], self.b[:0], self.regular[:0]]
        by_row = np.argsort(columns[0], kind="stable")
        return *counts, groups.take(pa.array(place)), *(x[by_row] for x in columns[1:])


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The Python worker's aligner of these files."""
    if (path_a, path_b) not in _aligners:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _aligners[path_a, path_b] = Aligner(Vocabularies(path_a, path_b))
    return _aligners[path_a, path_b]


#: Rows of documents (links packed as a | b << 32, or half as wide where ids have 16 bits), and of a task's counts.
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, is_count boolean, a array<int>, b array<int>, n array<long>"


def _kind(words: Vocabularies) -> tuple[np.dtype, np.uint64]:
    narrow = max(len(words.bytes_a), len(words.bytes_b)) <= 1 << 16
    return (np.dtype(np.uint32), np.uint32(16)) if narrow else (np.dtype(np.uint64), np.uint64(32))


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The saved table of aligned documents and of the tasks' link counts (rows with ``is_count``)."""

    def lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind))

    def count_row(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        nulls = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())]
        return pa.RecordBatch.from_arrays([*nulls, pa.array([True]), lists(a, pa.int32()), lists(b, pa.int32()), lists(n, pa.int64())], _NAMES)

    def pair_row(pairs: Counter) -> pa.RecordBatch:
        keys = np.fromiter(pairs, np.int64, len(pairs))
        return count_row(keys >> 32, keys & 0xFFFFFFFF, np.fromiter(pairs.values(), np.int64, len(pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        words, (dtype, shift) = own.words, _kind(own.words)
        straight, pairs = np.zeros(len(words.bytes_a), np.int64), Counter()
        for batch in batches:
            for lo, hi in column_blocks(batch.column(1), 2 << 20):
                n_a, n_b, n_groups, groups, a, b, regular = own.align(batch.column(1).slice(lo, hi - lo))
                straight += np.bincount(a[regular], minlength=len(straight))
                keys, counts = np.unique(a[~regular].astype(np.int64) << 32 | b[~regular], return_counts=True)
                for key, k in zip(keys.tolist(), counts.tolist(), strict=True):
                    pairs[key] += k
                if len(pairs) > MAX_PAIRS:
                    yield pair_row(pairs)
                    pairs = Counter()
                raw = pa.py_buffer((a.astype(dtype) | b.astype(dtype) << shift).tobytes())
                at = np.concatenate(([0], np.cumsum(n_groups))) * dtype.itemsize
                links = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(at.astype(np.int64)), raw]).cast(pa.binary())
                digests = [hashlib.sha256(x.as_buffer()).hexdigest() if x.as_buffer().size else "" for x in groups]
                rest = [pa.array(np.zeros(hi - lo, bool)), *(pa.nulls(hi - lo, pa.list_(t)) for t in (pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *map(pa.array, (n_a, n_b, n_groups)), pa.array(digests, pa.string()), links, *rest], _NAMES)
        if pairs:
            yield pair_row(pairs)
        used = np.flatnonzero(straight)
        if len(used):
            yield count_row(used, words.identity[used], straight[used])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return save(rows.mapInArrow(run, _ALIGNED), "aligned", "zstd")


_NAMES = [x.split()[0] for x in _ALIGNED.split(", ")]


def link_counts(aligned: DataFrame) -> DataFrame:
    """a, b, n, is_best: how often each pair of ids is linked in the corpus, and whether no id of A is linked with b more."""
    counts = aligned.where("is_count").select(F.explode(F.arrays_zip("a", "b", "n")).alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("n"))
    counts = save(counts, "link-counts")
    best = counts.groupBy("b").agg(F.max("n").alias("most")).withColumnRenamed("b", "of_b")
    return counts.join(best, F.col("b") == F.col("of_b")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("is_best"))


def report(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    aligned = align_documents(docs, path_a, path_b)
    words = Vocabularies(path_a, path_b)
    table = link_counts(aligned).toArrow()  # at most words.most_pairs rows, see above
    if len(table) > words.most_pairs + len(words.bytes_a):
        raise AssertionError("more linked pairs than the vocabularies allow")
    dtype, shift = _kind(words)
    keys = table.column("a").to_numpy().astype(dtype) | table.column("b").to_numpy().astype(dtype) << shift
    order = np.argsort(keys)
    known = docs.sparkSession.sparkContext.broadcast((keys[order], table.column("n").to_numpy()[order], table.column("is_best").to_numpy()[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in batches:
            for lo, hi in column_blocks(batch.column(5)):
                links = batch.column(5).slice(lo, hi - lo).cast(pa.large_binary())
                off = np.frombuffer(links.buffers()[1], np.int64, len(links) + 1, links.offset * 8)
                mine = np.frombuffer(links.buffers()[2] or b"", np.uint8)[off[0] : off[-1]].view(keys.dtype)
                at, inverse = np.unique(mine, return_inverse=True)
                at = np.searchsorted(keys, at)[inverse]
                edges = (off - off[0]) // keys.dtype.itemsize
                sums = [np.concatenate(([0], np.cumsum(x[at], dtype=np.int64))) for x in (best, counts)]
                n_best, count_sum = (pa.array(x[edges[1:]] - x[edges[:-1]]) for x in sums)
                own = [batch.column(k).slice(lo, hi - lo) for k in range(5)]
                yield pa.RecordBatch.from_arrays([*own[:4], own[3], n_best, count_sum, own[4]], _REPORTED)

    rows = aligned.where("not is_count").select(*_NAMES[:6])
    return rows.mapInArrow(look_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


_REPORTED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
