"""Toxicity scores from a learned lexicon, caught through misspellings and weighed by context.

The lexicon is learned from labelled documents: words, and word beginnings that many such words share, which are much
more frequent in toxic documents; near copies count once. Levenshtein automata are intersected with the trie of the
strong terms to catch misspelled ones. A window of words around each hit tells quotation from abuse: quotation marks
and reporting words lower the term's weight, direct address raises it. A logistic regression turns a document's hits
into a probability; it is fitted on hits of a lexicon learned from the other half of the training documents, so that
it does not trust chance terms.

``fit`` reads at most ``max_train`` labelled documents (taken by hash); scoring covers every whole text.

Defined results: null and empty texts have no hits and get the score of such a document; with no labels, or labels of
one class, every score is the (smoothed) share of label 1; conflicting labels of a document count as 1; repeated rows
are scored alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.llm.encode import column_blocks
from tributary.session import save

MAX_TRAIN = 20_000
THRESHOLD = 0.7
STEM_LENGTHS = (4, 5, 6)
MIN_ODDS = 2.7
WINDOW_WORDS = 6
QUOTED, DIRECT, MISSPELLED = 0.4, 1.2, 0.9
#: Fixed word lists for the context window.
REPORTING = set(
    "said says wrote quote quoted quoting called term word words phrase insult slur reported "
    "sagte schrieb zitat zitierte nannte begriff wort worte cité citation écrit appelé terme mot mots dijo escribió cita citó llamó palabra palabras término".split()
)
ADDRESS = set("you your you're youre ur u dich dir dein deine euch toi vous votre usted ustedes vosotros eres".split())
QUOTES = "\"“”„«»‘’"
#: Characters that commonly stand for letters.
LEET = str.maketrans("013457@$!", "oieastasi")
_EDGES = re.compile(r"^[^\w@$!]+|[^\w@$]+$")
_INNER = re.compile(r"[^\w@$!']+")


#: White space of any script, and marks that join two words of two letters or more. Single letters with marks between
#: them stay together, as ``clean`` takes the marks out of a word that is spelled out.
_OTHER = r"\t-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SPACE = rf" *[{_OTHER}][ {_OTHER}]*|  +"  # a single space, which stays one, is not matched: each match costs time
_JOINED = r"(\pL{2}['’]?)([,;:./\\|?()\[\]…–—-]+)(\pL{2})"


def pieces_of(texts: pa.Array) -> pa.Array:
    """The pieces of each text, for training and scoring alike."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    for _ in range(2):  # a word of two letters between two marks ends one match and begins the next
        texts = pc.replace_substring_regex(texts, _JOINED, r"\1\2 \3")
    return pc.split_pattern(pc.replace_substring_regex(texts, _SPACE, " "), " ")


def clean(piece: str) -> str:
    """Lower case, without punctuation."""
    if piece.isalpha():
        return piece.lower()
    return _INNER.sub("", _EDGES.sub("", piece.lower()))


class LevenshteinAutomaton:
    """Accepts the strings within ``edits`` of ``word``. A state has one bit set a number of edits: the matched lengths."""

    def __init__(self, word: str, edits: int):
        self.size, self.edits, self.at = len(word), edits, defaultdict(int)
        for i, c in enumerate(word):
            self.at[c] |= 1 << i
        self.all = (1 << (self.size + 1)) - 1

    def start(self) -> tuple[int, ...]:
        return tuple((1 << (e + 1)) - 1 & self.all for e in range(self.edits + 1))

    def step(self, state: tuple[int, ...], char: str) -> tuple[int, ...]:
        here, out, old, new = self.at.get(char, 0), [], 0, 0
        for bits in state:
            new = ((bits & here) << 1 | old | (old | new) << 1) & self.all
            out.append(new)
            old = bits
        return tuple(out)

    def accepts(self, state: tuple[int, ...]) -> int | None:
        return next((e for e, bits in enumerate(state) if bits >> self.size & 1), None)


class Trie:
    def __init__(self, words: dict[str, float]):
        self.root: dict = {}
        for word in words:
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word

    def within(self, automaton: LevenshteinAutomaton) -> list[tuple[int, str]]:
        """(edits, word) of the trie's words that the automaton accepts: both are walked together."""
        found, todo = [], [(self.root, automaton.start())]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c == "":
                    edits = automaton.accepts(state)
                    if edits is not None:
                        found.append((edits, child))
                elif (after := automaton.step(state, c))[-1]:
                    todo.append((child, after))
        return sorted(found)


@dataclass
class Lexicon:
    """Weights (log odds) of words, of word beginnings, and the strong words that misspellings are matched to."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    strong: dict[str, float] = field(default_factory=dict)
    harmless: frozenset[str] = frozenset()  # words of clean training documents that look like misspelled terms

    def __post_init__(self):
        self.trie, self.known, self.parts = Trie(self.strong), {}, set()
        for word in self.strong:  # with k edits one of k + 1 parts is intact
            n = self.edits(word) + 1
            cuts = [len(word) * i // n for i in range(n + 1)]
            self.parts |= {word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}
        self.longest = max(map(len, self.strong), default=0)
        self.part_sizes = sorted({len(p) for p in self.parts})

    def parts_of(self) -> tuple:
        return self.words, self.stems, self.strong, self.harmless

    @staticmethod
    def edits(word: str) -> int:
        return 0 if len(word) < 5 else 1 if len(word) < 9 else 2

    def match(self, piece: str) -> tuple[str, float, int] | None:
        """(term, weight, kind) of a piece; kind 0: word, 1: misspelled, 2: beginning."""
        if piece in self.known:
            return self.known[piece]
        found = self.look_up(clean(piece))
        if len(self.known) < 200_000:
            self.known[piece] = found
        return found

    def look_up(self, word: str) -> tuple[str, float, int] | None:
        """``match`` of a clean word, which is not remembered."""
        if word in self.words:
            return word, self.words[word], 0
        for size in reversed(STEM_LENGTHS):
            if len(word) > size and word[:size] in self.stems:
                return f"{word[:size]}*", self.stems[word[:size]], 2
        plain = word if word.isalpha() else word.translate(LEET).replace("'", "")
        if plain != word and plain in self.strong:
            return plain, MISSPELLED * self.strong[plain], 1
        if not 4 <= len(plain) <= self.longest + 2 or not any(plain[i : i + n] in self.parts for n in self.part_sizes for i in range(len(plain) - n + 1)):
            return None
        if word in self.harmless:
            return None
        near = self.trie.within(LevenshteinAutomaton(plain, max(1, self.edits(plain))))
        best = [t for e, t in near if e <= self.edits(t)]
        return (best[0], MISSPELLED * self.strong[best[0]], 1) if best else None


FEATURES = 6


def context_factor(before: list[str], piece: str, after: list[str]) -> tuple[float, bool]:
    """The factor of a hit in its window of pieces, and whether it is quoted."""
    opened = sum(any(q in x for q in QUOTES) for x in before) + (piece[:1] in QUOTES)
    closed = sum(any(q in x for q in QUOTES) for x in after) + (piece.rstrip(".,!?;:")[-1:] in QUOTES)
    words = {clean(x) for x in before} | {clean(x) for x in after}
    quoted = bool(opened and closed)
    factor = (QUOTED if quoted else 1.0) * (math.sqrt(QUOTED) if words & REPORTING else 1.0)
    return factor * (DIRECT if words & ADDRESS and not quoted else 1.0), quoted


def features(column: pa.Array, lexicons: list[Lexicon], which: np.ndarray | None = None) -> np.ndarray:
    """A row of FEATURES for each text, zeros for a text without hits, whatever its length; ``which`` names the lexicon
    of each row."""
    cut = pieces_of(column)
    offsets = cut.offsets.to_numpy()
    flat = cut.flatten().dictionary_encode()
    codes, pieces = flat.indices.to_numpy(), flat.dictionary.to_pylist()
    out = np.zeros((len(column), FEATURES))
    for k, lexicon in enumerate(lexicons):
        matches = [lexicon.match(p) for p in pieces]
        hit = np.fromiter((m is not None for m in matches), bool, len(matches))
        at = np.flatnonzero(hit[codes]) if len(codes) else np.zeros(0, np.int64)
        rows = np.searchsorted(offsets, at, "right") - 1
        best: dict[int, dict[str, tuple[float, int, bool]]] = defaultdict(dict)
        for row, i in zip(rows.tolist(), at.tolist(), strict=True):
            if which is not None and which[row] != k:
                continue
            lo, hi = max(offsets[row], i - WINDOW_WORDS), min(offsets[row + 1], i + WINDOW_WORDS + 1)
            term, weight, kind = matches[codes[i]]
            factor, quoted = context_factor([pieces[c] for c in codes[lo:i]], pieces[codes[i]], [pieces[c] for c in codes[i + 1 : hi]])
            if weight * factor > best[row].get(term, (0.0,))[0]:
                best[row][term] = weight * factor, kind, quoted
        for row, terms in best.items():
            found = list(terms.values())
            by_kind = [max((w for w, kind, _ in found if (kind == 2) == stem), default=0.0) for stem in (False, True)]
            sums = math.log1p(sum(w for w, _, _ in found)), math.log1p(len(found)), sum(q for _, _, q in found) / len(found)
            out[row] = *by_kind, *sums, math.log1p(int(offsets[row + 1] - offsets[row]))
    return out


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method; the intercept is not penalised."""
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _lexicon(stats: list, stems: list, parts: tuple[int, ...], totals: dict[int, tuple[int, int]]) -> Lexicon:
    """From rows (term, t0, c0, t1, c1[, n]): toxic and clean counts in the halves 0 and 1, of which ``parts`` count."""
    toxic, clean_n = (max(1, sum(totals.get(p, (0, 0))[k] for p in parts)) for k in (0, 1))
    # Pessimistic: one toxic document less and half a clean one more than were seen.
    odds = lambda t, c: math.log((t - 0.7) / (toxic + 1)) - math.log((c + 0.8) / (clean_n + 1))
    words, strong, begins = {}, {}, {}
    for r in stats:
        t, c = sum(r[f"t{p}"] for p in parts), sum(r[f"c{p}"] for p in parts)
        if t >= 2 and odds(t, c) > MIN_ODDS:
            words[r["term"]] = odds(t, c)
            if t >= max(3, 0.004 * toxic) and len(r["term"]) > 3:
                strong[r["term"]] = odds(t, c)
    best = max(strong.values(), default=0.0)
    strong = {w: x for w, x in strong.items() if x > 0.75 * best}
    for r in stems:
        t, c = sum(r[f"t{p}"] for p in parts), sum(r[f"c{p}"] for p in parts)
        if t >= 4 and r["n"] >= 3 and odds(t - 1, c) > MIN_ODDS:
            begins[r["term"]] = odds(t - 1, c)
    return Lexicon(words, begins, strong)


#: Whose counts a lexicon is learned from: all groups, or one half of them.
HALVES = ((0, 1), (1,), (0,))


def _telling(parts: tuple[int, ...], totals: dict[int, tuple[int, int]], least: int, off: int) -> Column:
    """Whether a term is frequent enough for ``_lexicon``, which decides the same way."""
    toxic, clean_n = (max(1, sum(totals.get(p, (0, 0))[k] for p in parts)) for k in (0, 1))
    t, c = (reduce(add, (F.col(f"{n}{p}") for p in parts)) for n in "tc")
    odds = F.log((t - off - 0.7) / (toxic + 1)) - F.log((c + 0.8) / (clean_n + 1))
    return F.when(t >= least, odds > MIN_ODDS - 1e-9).otherwise(False)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Learns from labelled documents that are not held out; at most ``max_train`` of them, by hash."""
    chosen = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(chosen), "doc_id")  # at most max_train rows of 12 bytes
    train = save(joined.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-train", "zstd")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (b.iloc[lo : lo + 500] for b in batches for lo in range(0, len(b), 500)):
            rows = set()
            for cut, toxic in zip(pieces_of(pa.array(batch["text"], pa.large_string())), batch["toxic"], strict=True):
                words = {clean(x) for x in cut.as_py()} - {""}
                group = min((zlib.crc32(w.encode()) for w in words), default=0)  # near copies mostly agree
                rows |= {(w, int(toxic), group) for w in words}
            yield pd.DataFrame(sorted(rows), columns=["term", "toxic", "grp"])

    half = F.pmod(F.col("grp"), F.lit(2))
    counted = lambda p, y: F.count_distinct(F.when((half == p) & (F.col("toxic") == y), F.col("grp")))
    names = {f"{n}{p}": counted(p, y) for p in (0, 1) for n, y in (("t", 1), ("c", 0))}
    seen = train.mapInPandas(terms, "term string, toxic int, grp long")
    stats = save(seen.groupBy("term").agg(*(c.alias(n) for n, c in names.items())), "toxicity-terms")
    toxic_n, clean_n = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    groups = seen.groupBy("grp").agg(F.max("toxic").alias("toxic"))
    totals = {r["half"]: (r["t"], r["c"]) for r in groups.groupBy(half.alias("half")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()}
    telling = lambda least, off: reduce(or_, (_telling(parts, totals, least, off) for parts in HALVES))
    words = stats.where(telling(2, 0)).collect()  # of at most max_train documents, and far more frequent in toxic ones
    begins = stats.select(F.explode(F.array(*(F.when(F.length("term") > n, F.substring("term", 1, n)) for n in STEM_LENGTHS))).alias("stem"), *names)
    begins = begins.where(F.col("stem").isNotNull()).groupBy(F.col("stem").alias("term")).agg(*(F.sum(n).alias(n) for n in names), F.sum(F.when(toxic_n > clean_n, 1).otherwise(0)).alias("n"))
    stems = begins.where((F.col("n") >= 3) & telling(4, 1)).collect()
    drafts = [_lexicon(words, stems, parts, totals) for parts in HALVES]
    terms_of = docs.sparkSession.sparkContext.broadcast([x.parts_of() for x in drafts])

    def lookalikes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicons = [Lexicon(*x) for x in terms_of.value]
        for batch in batches:
            hit = [any((m := x.look_up(w)) and m[2] == 1 for x in lexicons) for w in batch["term"]]
            yield batch[hit]

    seen_clean = stats.where((clean_n > 0) & (toxic_n < clean_n)).select("term")
    alike = seen_clean.mapInPandas(lookalikes, "term string").collect()  # words of the training documents near a strong term
    harmless = frozenset(r["term"] for r in alike)
    lexicon = Lexicon(*drafts[0].parts_of()[:3], harmless)
    shared = docs.sparkSession.sparkContext.broadcast([(*x.parts_of()[:3], harmless) for x in drafts[1:]])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicons = [Lexicon(*x) for x in shared.value]
        for batch in batches:
            for lo, hi in column_blocks(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                side = [min((zlib.crc32(w.encode()) for w in {clean(x) for x in cut.as_py()} - {""}), default=0) % 2 for cut in pieces_of(part.column(0))]
                x = features(part.column(0), lexicons, np.array(side))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(x.tolist(), pa.list_(pa.float64()))], ["toxic", "x"])

    rows = train.mapInArrow(measure, "toxic int, x array<double>").collect()  # at most max_train rows
    x, y = np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["toxic"] for r in rows], float)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        weights = np.array([math.log(share / (1 - share)), *[0.0] * FEATURES])
    else:
        weights = _logistic((x - mean) / scale, y)
    return Model(lexicon, weights, mean, scale)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted."""
    m = model.lexicon.parts_of(), model.weights, model.mean, model.scale
    shared = docs.sparkSession.sparkContext.broadcast(m)  # terms of at most max_train documents

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, *rest = shared.value
        own = Model(Lexicon(*terms), *rest)
        for batch in batches:
            for lo, hi in column_blocks(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(features(part.column(1), [own.lexicon])))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(apply, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The document rows that are not rejected, with all their columns. No shuffle: rows pass through the scoring."""
    shared = docs.sparkSession.sparkContext.broadcast((model.lexicon.parts_of(), model.weights, model.mean, model.scale))
    docs = docs.withColumn("text", F.col("text").cast("string"))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, *rest = shared.value
        own = Model(Lexicon(*terms), *rest)
        for batch in batches:
            for lo, hi in column_blocks(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(own.score(features(part.column(at), [own.lexicon])) < threshold))

    return docs.mapInArrow(keep, docs.schema)
