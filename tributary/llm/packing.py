"""Best-fit packing into sequences of fixed capacity by a grouping genetic algorithm on islands.

Documents are tokenised once; longer ones are cut into pieces of ``capacity`` ids. Pieces are dealt to islands of about
``ISLAND`` by hash. An island holds a small population of packings; genes are whole bins. Crossover injects well-filled
bins of one parent into the other, drops the bins that then hold a piece twice, and places the displaced pieces: first in
exchange for smaller ones of bins that they fill better, then by best fit; mutation empties badly filled bins. Every
island runs ``GENERATIONS`` generations an epoch, more where it has not met its lower bound. Between epochs the best-filled
bins of all islands migrate as patterns of lengths (a bounded number), and each island injects those that it can make up
from its own pieces. In the end pieces in badly filled bins of all islands are dealt to new, fewer islands, again until
one is enough or that helps no more, so that an island's remainder does not cost a sequence of its own.

Results are deterministic: seeds are island numbers, pieces are ordered within an island.

Defined results: a null or empty text is one piece of the end id; repeated rows are separate pieces; a text of any
length is cut, never dropped; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.encode import column_blocks, encoder
from tributary.session import save

CAPACITY = 4096
ISLAND = 16_384
POPULATION = 6
#: Every island runs this many generations in each epoch; beyond that it goes on until it meets its lower bound or has
#: found nothing better for PATIENCE generations.
GENERATIONS = 8
PATIENCE = 8
#: Epochs; elites migrate between them.
EPOCHS = 3
MIGRANTS = 64
#: Bins filled less than this share are dealt out once more.
TAIL = 0.995
#: That ends when it has saved no bin for so many rounds, or one island has had all that were left.
TAIL_PATIENCE = 3

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = f"{_PIECES}, island long, bin long, offset long"


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in batches:
            for lo, hi in column_blocks(batch.column(1)):
                ids, at = enc.encode(batch.column(1).slice(lo, hi - lo))
                ids, at = np.insert(ids, at[1:], end_id).astype("<u4"), at + np.arange(len(at))
                n = -(-np.diff(at) // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = number * capacity
                length = np.minimum(capacity, np.diff(at)[row] - begin)
                first = (at[:-1][row] + begin).tolist()
                crc = [zlib.crc32(ids[a : a + k].tobytes()) for a, k in zip(first, length.tolist(), strict=True)]
                doc = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(number.astype(np.int32)), pa.array(begin), pa.array(length), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, _PIECES)


class Packing:
    """Bins as lists of item numbers, and what room each has left."""

    def __init__(self, sizes: list[int], capacity: int, bins: list[list[int]] = ()):
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = [list(b) for b in bins]
        self.room = [capacity - sum(sizes[i] for i in b) for b in self.bins]

    def best_fit(self, items: list[int], rng: random.Random | None = None) -> Packing:
        """Places items, largest first (with ``rng`` only roughly so), each into the fullest bin that still takes it."""
        by_room: dict[int, list[int]] = defaultdict(list)
        mask = 0
        for b, r in enumerate(self.room):
            if r:
                by_room[r].append(b)
                mask |= 1 << r
        sizes, bins, room = self.sizes, self.bins, self.room
        order = {i: sizes[i] * rng.uniform(0.7, 1.3) for i in items} if rng else sizes
        for i in sorted(items, key=lambda i: (-order[i], i)):
            size = sizes[i]
            fitting = mask >> size
            if fitting:
                r = size + (fitting & -fitting).bit_length() - 1
                b = by_room[r].pop()
                if not by_room[r]:
                    mask ^= 1 << r
                bins[b].append(i)
                left = r - size
            else:
                b, left = len(bins), self.capacity - size
                bins.append([i])
                room.append(left)
            room[b] = left
            if left:
                by_room[left].append(b)
                mask |= 1 << left
        return self

    def fitness(self) -> tuple[int, float]:
        """Fewer bins first; among equals, fuller and emptier bins are better than even ones."""
        return -len(self.bins), sum((1 - r / self.capacity) ** 2 for r in self.room)


def exchange(packing: Packing, items: list[int]) -> list[int]:
    """Swaps one or two pieces of a bin for one of ``items`` that fills it better, as often as that helps; returns the
    pieces then left over. They are smaller than before, so that best fit places them more easily."""
    sizes = packing.sizes
    free = sorted(items, key=lambda i: (sizes[i], i))
    held = [sizes[i] for i in free]
    for k, b in enumerate(packing.bins):
        room = packing.room[k]
        while room and free:
            best, out = 0, ()
            for x, i in enumerate(b):
                for j in (None, *b[x + 1 :]):
                    was = sizes[i] + (0 if j is None else sizes[j])
                    at = bisect_right(held, was + room) - 1
                    if at >= 0 and held[at] - was > best:
                        best, out, new = held[at] - was, (i,) if j is None else (i, j), at
                    if best == room:
                        break
                if best == room:
                    break
            if not best:
                break
            i = free.pop(new)
            held.pop(new)
            b[:] = [*(j for j in b if j not in out), i]
            for j in out:
                at = bisect_right(held, sizes[j])
                free.insert(at, j)
                held.insert(at, sizes[j])
            room -= best
        packing.room[k] = room
    return free


def _repack(sizes: list[int], capacity: int, kept: list[list[int]], items: list[int]) -> Packing:
    packing = Packing(sizes, capacity, kept)
    return packing.best_fit(exchange(packing, items))


def crossover(giver: Packing, taker: Packing, share: float, rng: random.Random) -> Packing:
    """Injects whole well-filled bins of ``giver``, drops bins of ``taker`` with duplicates, places what is displaced."""
    ranked = sorted(range(len(giver.bins)), key=lambda b: (giver.room[b], rng.random()))
    injected = [giver.bins[b] for b in ranked[: max(1, int(share * len(ranked)))]]
    taken = {i for b in injected for i in b}
    kept, displaced = [], []
    for b in taker.bins:
        (kept if taken.isdisjoint(b) else displaced).append(b)
    return _repack(taker.sizes, taker.capacity, injected + kept, [i for b in displaced for i in b if i not in taken])


def mutate(packing: Packing, share: float, rng: random.Random) -> Packing:
    """Empties the worst-filled bins and a few others, and places their items again."""
    n = max(1, int(share * len(packing.bins)))
    worst = set(sorted(range(len(packing.bins)), key=lambda b: -packing.room[b])[:n]) | {rng.randrange(len(packing.bins)) for _ in range(n)}
    kept = [b for k, b in enumerate(packing.bins) if k not in worst]
    return _repack(packing.sizes, packing.capacity, kept, [i for k in sorted(worst) for i in packing.bins[k]])


def immigrate(packing: Packing, patterns: list[list[int]], rng: random.Random) -> Packing:
    """Injects each pattern of lengths that the island's pieces can make up, as crossover does with bins."""
    free: dict[int, list[int]] = defaultdict(list)
    for b, room in zip(packing.bins, packing.room, strict=True):
        if room:
            for i in b:
                free[packing.sizes[i]].append(i)
    made = []
    for pattern in patterns:
        found: list[int] = []
        for size in pattern:
            if not free[size]:
                break
            found.append(free[size].pop())
        if len(found) == len(pattern):
            made.append(found)
        else:
            for i in found:
                free[packing.sizes[i]].append(i)
    return crossover(Packing(packing.sizes, packing.capacity, made), packing, 1.0, rng) if made else packing


def evolve(sizes: list[int], capacity: int, seed: int, start: list[list[int]] | None = None, patterns: list[list[int]] = ()) -> Packing:
    """The best packing after the generations. The first members are best fit by falling size (or ``start``), best fit in
    random orders, which the others improve on, and what the migrants make of the first one."""
    rng, n = random.Random(seed), len(sizes)
    bound = -(-sum(sizes) // capacity)
    population = [Packing(sizes, capacity, start) if start else Packing(sizes, capacity).best_fit(list(range(n)))]
    if patterns:
        population.append(immigrate(population[0], patterns, rng))
    while len(population) < POPULATION:
        some = rng.sample(range(len(population[0].bins)), len(population[0].bins) // 2)
        kept = [population[0].bins[b] for b in some] if len(population) % 2 else []
        rest = sorted(set(range(n)).difference(*kept))
        population.append(Packing(sizes, capacity, kept).best_fit(rest, rng))
    generation = since = 0
    best = max(x.fitness() for x in population)
    while generation < GENERATIONS or -best[0] > bound and since < PATIENCE:
        population.sort(key=Packing.fitness, reverse=True)
        a, b = rng.sample(range(POPULATION // 2 + 1), 2)
        giver, taker = population[min(a, b)], population[max(a, b)]
        if rng.random() < 0.5:
            giver, taker = taker, giver
        child = mutate(crossover(giver, taker, rng.uniform(0.2, 0.6), rng), rng.uniform(0.01, 0.05), rng)
        if all(child.fitness() != x.fitness() for x in population):
            population[-1] = child
        generation, since = generation + 1, since + 1
        if child.fitness() > best:
            best, since = child.fitness(), 0
    return max(population, key=Packing.fitness)


def _settle(frame: DataFrame, capacity: int, patterns: list[list[int]], placed: bool) -> DataFrame:
    """Runs each island (column ``island``); ``placed``: its bins so far are the first member of the population."""

    def island(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        start = [g.tolist() for g in pdf.groupby("bin").indices.values()] if placed else None
        sizes = pdf["length"].tolist()
        best = evolve(sizes, capacity, int(pdf["island"].iloc[0]), start, patterns)
        number, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for k, b in enumerate(best.bins):
            at = 0
            for i in sorted(b):
                number[i], offset[i] = k, at
                at += sizes[i]
        return pdf.assign(bin=number, offset=offset)[["doc_id", "piece", "start", "length", "ids_crc32", "island", "bin", "offset"]]

    return frame.groupBy("island").applyInPandas(island, _PLACED)


def _deal(frame: DataFrame, n: int, first: int = 0) -> DataFrame:
    """Deals pieces to islands by hash; the place in the saved table is hashed, too, so that repeated rows part."""
    islands = max(1, -(-n // ISLAND))
    hashed = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start", F.monotonically_increasing_id(), F.lit(first)), F.lit(islands))
    return frame.withColumn("island", hashed + first).withColumns({"bin": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})


def _elite(placed: DataFrame) -> list[list[int]]:
    """The length patterns of the MIGRANTS best-filled bins of all islands; at most CAPACITY lengths each."""
    bins = placed.groupBy("island", "bin").agg(F.sum("length").alias("fill"), F.array_sort(F.collect_list("length")).alias("pattern"))
    found = bins.where(F.size("pattern") > 1).groupBy("pattern", "fill").agg(F.count("*").alias("n")).orderBy(F.desc("fill"), F.desc("n"), "pattern").limit(MIGRANTS)
    return [list(r["pattern"]) for r in found.collect()]


def _size(placed: DataFrame) -> tuple[int, int]:
    """Numbers of pieces and of bins."""
    counts = placed.groupBy("island", "bin").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    return counts[0], counts[1]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Places all pieces (columns of ``pieces``): adds sequence_id and offset."""
    cut = save(cut, "pieces")
    n = cut.count()
    placed = save(_settle(_deal(cut, n), capacity, [], False), "packing-epoch")
    if n > ISLAND:
        for _ in range(EPOCHS - 1):
            placed = save(_settle(placed, capacity, _elite(placed), True), "packing-epoch")
        done, number, vain = None, 0, 0
        while vain < TAIL_PATIENCE:
            number += 1
            fill = placed.groupBy("island", "bin").agg(F.sum("length").alias("fill"))
            marked = placed.join(fill, ["island", "bin"])
            is_tail = F.col("fill") < int(TAIL * capacity)
            full = marked.where(~is_tail).drop("fill")
            done = full if done is None else done.unionByName(full)
            tail = save(marked.where(is_tail).drop("fill"), "packing-tail")
            n, was = _size(tail)
            again = save(_settle(_deal(tail, n, first=number << 26), capacity, [], False), "packing-again") if n else tail
            now = _size(again)[1]
            placed, vain = (again, 0) if now < was else (tail, vain + 1)
            if n <= ISLAND:  # one island has had them all
                break
        placed = done.unionByName(placed)
    sequence = F.shiftleft("island", 32) + F.col("bin")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, end_id, capacity), capacity)
