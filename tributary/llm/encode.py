"""Encoding whole texts with the tokenizers library, one distinct word at a time.

A byte-pair model works on pre-tokens, and no pre-token of the two supported layouts crosses the space before a word or
a single line end between two words. So a column of texts is cut there, and the ids of all occurrences are gathered from
a table of pieces that the Python worker keeps: known pieces are looked up by Arrow, new ones are encoded once. Pieces of
letters and closing punctuation go straight to the model; any other piece goes through the whole tokenizer; texts with
runs of white space, where cutting could change the pre-tokens, or with a special token's string are encoded whole. Other
tokenizer layouts are always encoded whole. The table holds a bounded number of pieces; the least used ones leave it.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_CACHED = 400_000
BLOCK = 8 << 20
_SIMPLE = re.compile(r"([^\W\d_]+)([.,|%$*#&:;!?]*)")
#: The byte alphabet of byte-level models (fixed values): printable bytes stand for themselves, others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _alphabet() -> dict[int, str]:
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + n) for n, b in enumerate(rest)}


def layout(spec: dict) -> str:
    """byte: byte-level with the usual split and no normaliser; word: NFC, one space, lower case, letters split; else whole."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec["model"]["type"] != "BPE" or spec.get("post_processor", None) and spec["post_processor"]["type"] != "ByteLevel":
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "byte"
    parts = [x["type"] for x in pre.get("pretokenizers", ())]
    steps = [x["type"] for x in (norm or {}).get("normalizers", ())]
    if parts == ["Split", "ByteLevel"] and steps == ["NFC", "Replace", "Lowercase"] and r"[\p{L}]+" in pre["pretokenizers"][0]["pattern"].get("Regex", ""):
        return "word"
    return "whole"


def _bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


def _is_open(piece: str) -> bool:
    """Whether a run of white space at its beginning or end can reach beyond what the piece shows."""
    return not piece or piece != "\n" and (piece[-1].isspace() or piece[0] == "\n" and piece[1].isspace())


class Encoder:
    """``plain``: strings of special tokens are ordinary text."""

    def __init__(self, path: str, max_cached: int = MAX_CACHED, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.layout = layout(spec)
        self.tokenizer.encode_special_tokens = plain
        self.special = [] if plain else [x["content"] for x in spec.get("added_tokens", ())]
        self.model, self.max_cached = self.tokenizer.model, max_cached
        #: Letters to ids; when the young ones are many, the old ones go.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = _alphabet()
        #: The table: pieces, where their ids begin in ``pool``, how many they are, how often the piece was used.
        self.known, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.uint32)
        self.begin, self.size, self.uses = (np.zeros(0, np.int64) for _ in range(3))
        #: Entries whose white space may go on in the next piece (byte layout).
        self.open = np.zeros(0, np.uint8)

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _core(self, core: str) -> bytes:
        """Ids of letters, with the space before them in the byte layout."""
        found = self.young.get(core)
        if found is None:
            found = self.old.get(core)
            if found is None:
                mapped = core.replace(" ", "Ġ") if core.isascii() else core.encode().decode("latin-1").translate(self.bytes)
                found = _bytes([t.id for t in self.model.tokenize(mapped)])
            if len(self.young) >= self.max_cached // 2:
                self.old, self.young = self.young, {}
            self.young[core] = found
        return found

    def piece(self, piece: str) -> bytes:
        """Ids of a piece; in the byte layout a leading space belongs to it."""
        space = piece[:1] == " "
        simple = _SIMPLE.fullmatch(piece, 1 if space else 0)
        core = simple[1] if simple else ""
        if simple and self.layout == "word":
            core = core.lower() if core.isascii() else unicodedata.normalize("NFC", core).lower()
        if not simple or not core.isalpha() or "Σ" in simple[1]:
            return _bytes(self.whole(piece))
        found = self._core(" " + core if space else core)
        return found + self._core_of_marks(simple[2]) if simple[2] else found

    def line_end(self) -> bytes:
        return self._core_of_marks("\n")

    def _core_of_marks(self, marks: str) -> bytes:
        found = self.young.get(marks)
        if found is None:
            found = self.young[marks] = _bytes(self.whole(marks))
        return found

    def _entry(self, piece: str) -> bytes:
        """Ids of a table entry: in the byte layout a space stands before it unless it begins with a line end."""
        if not piece:
            return b""
        if self.layout == "word":
            return self.piece(piece)
        if piece[0] != "\n":
            return self.piece(" " + piece)
        return self._core_of_marks("\n") + (self.piece(piece[1:]) if piece[1:] else b"")

    def _slots(self, pieces: pa.Array) -> np.ndarray:
        """The table entry of each piece; new pieces are encoded and added."""
        if len(self.known) > self.max_cached:
            self._evict()
        found = pc.index_in(pieces, self.known)
        slots = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        new = np.flatnonzero(slots < 0)
        if len(new):
            coded = pieces.take(pa.array(new)).dictionary_encode()
            slots[new] = coded.indices.to_numpy() + len(self.known)
            added = coded.dictionary.to_pylist()
            ids = [self._entry(x) for x in added]
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            self.begin = np.concatenate((self.begin, len(self.pool) + np.cumsum(size) - size))
            self.size, self.uses = np.concatenate((self.size, size)), np.concatenate((self.uses, np.zeros(len(ids), np.int64)))
            self.open = np.concatenate((self.open, np.fromiter(map(_is_open, added), np.uint8, len(added))))
            self.pool = np.concatenate((self.pool, np.frombuffer(b"".join(ids), np.uint32)))
            self.known = pa.concat_arrays([self.known, coded.dictionary])
        self.uses += np.bincount(slots, minlength=len(self.uses))
        return slots

    def _evict(self) -> None:
        """The more used two thirds stay."""
        n = 2 * self.max_cached // 3
        keep = np.sort(np.argpartition(-self.uses, n)[:n])
        begin, size = self.begin[keep], self.size[keep]
        ends = np.cumsum(size)
        self.pool = self.pool[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        self.known, self.begin, self.size, self.uses, self.open = self.known.take(pa.array(keep)), ends - size, size, self.uses[keep] // 2, self.open[keep]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all texts and len + 1 offsets. Nulls are empty."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        n = len(texts)
        if self.layout == "whole" or not n:
            found = [np.array(self.whole(x), np.uint32) for x in texts.to_pylist()]
            return (np.concatenate(found) if found else np.zeros(0, np.uint32)), np.cumsum([0, *map(len, found)])
        byte = self.layout == "byte"
        odd = np.zeros(n, bool)
        for mark in [*self.special, *(["  ", " \n", "\n ", "\n\n\n"] if byte else [])]:
            odd |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if byte else " "), " ")
        offsets = cut.offsets.to_numpy().astype(np.int64)
        pieces = cut.flatten()
        slots = self._slots(pieces)
        pool, begin, size = self.pool, self.begin, self.size
        if byte:
            first = offsets[:-1]
            odd |= pc.ends_with(texts, "\n\n").to_numpy(zero_copy_only=False)
            odd |= np.add.reduceat(self.open[slots], first) > 0
            # No space stands before a text's first piece.
            heads = [self.piece(x) if x else b"" for x in pieces.take(pa.array(first)).to_pylist()]
            lengths = np.fromiter(map(len, heads), np.int64, n) // 4
            begin = np.concatenate((begin, len(pool) + np.cumsum(lengths) - lengths))
            size, pool = np.concatenate((size, lengths)), np.concatenate((pool, np.frombuffer(b"".join(heads), np.uint32)))
            slots[first] = len(self.begin) + np.arange(n)
        lengths = size[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(pool)) < 1 << 31 else np.int64
        gather = np.repeat((begin[slots] - (ends - lengths)).astype(kind), lengths)
        gather += np.arange(total, dtype=kind)
        out = pool[gather]
        at = np.concatenate(([0], ends))[offsets]
        if odd.any():
            values = {k: np.array(self.whole(texts[k].as_py()), np.uint32) for k in np.flatnonzero(odd).tolist()}
            parts = [values.get(k, out[at[k] : at[k + 1]]) for k in range(n)]
            out, at = np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        return out, at


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """The Python worker's encoder of this file."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain=plain)
    return _encoders[path, plain]


def column_blocks(column: pa.Array, limit: int = BLOCK) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    block = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(block)) + 1
    return list(zip([0, *edges.tolist()], [*edges.tolist(), len(column)], strict=True)) if len(column) else []
