"""Vectors and large vocabularies against plain NumPy."""

import math
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.functions import curation, text
from tributary.operators import ann, curate, dedup, evaluate, retrieval
from tributary.operators import softlabels as soft

BLOCKS = "batch int, example_id string, pos int, label int, first int, rag array<float>, bare array<float>"


def cut(rng, rows, sizes):
    """Rows (batch, example, pos, label, rag, bare) in blocks of random sizes, in any order."""
    out = []
    for batch, example, pos, label, rag, bare in rows:
        at = 0
        while at < len(rag):
            n = int(rng.integers(sizes[0], sizes[1] + 1))
            out.append((batch, example, pos, label, at, [float(x) for x in rag[at : at + n]], [float(x) for x in bare[at : at + n]]))
            at += n
    rng.shuffle(out)
    return [tuple(x) if not isinstance(x, tuple) else x for x in out]


def expected(rows):
    found = {}
    for batch, example, _, label, *columns in rows:
        cell = found.setdefault((batch, example), ([], []))
        for losses, x in zip(cell, columns, strict=True):
            if label != soft.IGNORE:
                x = x.astype(np.float32).astype(np.float64)
                losses.append(x.max() + math.log(np.exp(x - x.max()).sum()) - x[label])
    return {k: tuple(np.mean(x) if x else 0.0 for x in cell) for k, cell in found.items()}


@pytest.mark.parametrize("vocabulary, sizes", [(40, (1, 1)), (40, (7, 13)), (40, (40, 40)), (50_000, (3_000, 20_000))])
def test_losses_of_blocks_are_those_of_whole_rows(spark, vocabulary, sizes):
    rng = np.random.default_rng(vocabulary + sizes[0])
    rows = [(e % 2, f"e{e}", pos, -100 if pos == 1 or e == 3 else int(rng.integers(vocabulary)), rng.normal(0, 30, vocabulary), rng.normal(500, 2, vocabulary)) for e in range(4) for pos in range(3)]
    got = soft.example_nll_of_blocks(spark.createDataFrame(cut(rng, rows, sizes), BLOCKS).repartition(5), "rag", "bare").collect()
    want = expected(rows)
    assert len(got) == len(want) and all((r.nll_rag, r.nll_bare) == pytest.approx(want[r.batch, r.example_id], rel=1e-6) for r in got)


@pytest.mark.parametrize("sizes, settings", [((1, 3), {}), ((24, 24), {"contrast": False}), ((90, 90), {"epsilon": 0.0, "gated": False}), ((7, 40), {"center": False, "temperature": 1.0})])
def test_all_losses_of_blocks_are_those_of_whole_rows(spark, sizes, settings):
    rng, columns = np.random.default_rng(sizes[0]), ("rag", "bare", "student", "neg")
    rows, blocks = [], []
    for e in range(6):
        for pos in range(3):
            keys = e % 3, f"e{e}", pos, -100 if pos == 1 or e % 3 == 2 else int(rng.integers(90))
            logits = [[float(x) for x in rng.normal(0, scale, 90).astype(np.float32)] for scale in (3, 1, 2, 40)]
            rows.append((*keys, *logits))
            at = 0
            while at < 90:
                n = int(rng.integers(sizes[0], sizes[1] + 1))
                blocks.append((*keys, at, *(x[at : at + n] for x in logits)))
                at += n
            blocks.append((*keys, 90, [], [], [], []))
    blocks = [blocks[i] for i in rng.permutation(len(blocks))]
    keys, arrays = "batch int, example_id string, pos int, label int", ", ".join(f"{c} array<float>" for c in columns)
    p = soft.LossWeights(**settings)
    want = {r.batch: r for r in soft.kd_loss(spark.createDataFrame(rows, f"{keys}, {arrays}"), p).collect()}
    got = soft.kd_loss_of_blocks(spark.createDataFrame(blocks, f"{keys}, first int, {arrays}").repartition(5), p).collect()
    assert len(got) == len(want) == 3
    for r in got:
        for name, value in r.asDict().items():
            assert value == (None if want[r.batch][name] is None else pytest.approx(want[r.batch][name], rel=1e-6, abs=1e-9)), name


def test_hashed_vectors_are_those_of_the_words(spark):
    texts = ["One two TWO", "", None, "é x " * 40, "same same", "\t one\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.embedding for r in retrieval.embed(rows, "text", retrieval.hashing_encoder(16)).collect()}
    for i, text in enumerate(texts):
        v = [0.0] * 16
        for word in (text or "").lower().split():
            h = zlib.crc32(word.encode())
            v[h % 16] += 1 if h >= 1 << 31 else -1
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert got[i] == pytest.approx([x / norm for x in v], abs=1e-6)
    assert retrieval.embed(rows.limit(0), "text").where(F.size("embedding") > 0).count() == 0


class Captured:
    """Stands for a table; keeps the function that a task would run."""

    def __init__(self, spark, schema=None):
        self.sparkSession, self.schema = spark, schema

    def select(self, *columns):
        return self

    def mapInPandas(self, f, kind):
        self.f = f
        return self.sparkSession.createDataFrame([], kind)


def test_a_task_of_the_exact_search_holds_few_distances(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(4000, 8)).astype(np.float32)
    m[1::500] = m[1]  # copies, all at one distance
    queries = spark.createDataFrame(pd.DataFrame({"query_id": np.arange(4000), "embedding": m.tolist()}))
    corpus = Captured(spark)
    retrieval.cosine_top_k(queries, corpus, 3, exclude_self=True)
    batch = pd.DataFrame({"doc_id": np.arange(4000), "embedding": list(m)})
    tracemalloc.start()
    got = pd.concat(corpus.f(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6 and len(got) == 12_000
    assert got[got["query_id"] == 1]["doc_id"].tolist() == [501, 1001, 1501] and got[got["query_id"] == 1]["distance"].nunique() == 1
    unit = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    for i in (0, 777, 3999):
        every = 1 - unit @ unit[i]
        every[i] = np.inf
        assert got[got["query_id"] == i]["doc_id"].tolist() == np.argsort(every, kind="stable")[:3].tolist()


def test_a_task_gives_out_few_probed_cells_at_once(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(0, [0.0])], "query_id long, embedding array<float>")
    asked = Captured(spark, rows.schema)
    ann._assign(asked, "query_id", rng.normal(size=(300, 16)), 200)
    batch = pd.DataFrame({"query_id": np.arange(3000), "embedding": list(rng.normal(size=(3000, 16)).astype(np.float32))})
    sizes = [len(x) for x in asked.f(iter([batch]))]
    assert sum(sizes) == 600_000 and max(sizes) * 16 <= ann.AT_ONCE


def test_answers_are_scored_in_their_own_rows_by_all_tasks(spark):
    """Two examples of one id do not meet each other's references, and one small file does not stay one task."""
    wide = spark.createDataFrame([(1, "p q r s", "p q r s", "q"), (1, "x y", "x x y", "")], "example_id long, reference string, s string, t string").coalesce(1)
    rows = evaluate.long_answers(wide, ("s", "t"))
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r["model"], round(r["f1"], 6), round(r["bleu4"], 6)) for r in evaluate.measured(rows).collect()}
    eps = lambda *hits: math.exp(0.25 * sum(math.log(h) for h in hits))
    assert got == {("s", 1.0, 1.0), ("t", 0.4, round(math.exp(1 - 4) * eps(1, 0.1, 0.1, 0.1), 6)), ("s", 0.8, round(eps(2 / 3, 1 / 2, 0.1, 0.1), 6)), ("t", 0.0, 0.0)}


def test_a_gated_response_goes_through_python_once(spark, capsys):
    odd = ["I\u0007 am  so rry ﬁne", "\u0085 a b a b a b a b a b 　", "", None, "﻿ x​ y\u001f z", "é Ａ " * 9]
    rows = spark.createDataFrame([(i, "Say something about it, please", "", x) for i, x in enumerate(odd)], "rec_id long, instruction string, input string, output string")
    curate.curate(rows).explain()
    plan = capsys.readouterr().out
    assert plan.count("EvalPython") == 1
    both = rows.select(text.clean(F.col("output")).alias("a"), curation.signals(text.clean(F.col("output")), F.col("instruction")).alias("s"), curation.cleaned_signals(F.col("output"), F.col("instruction")).alias("f"))
    for r in both.collect():
        assert r["f"].asDict() == {"cleaned": r["a"], **r["s"].asDict()}


def test_tasks_hold_shingles_of_few_records(spark):
    rng = np.random.default_rng(5)
    texts = ["".join(chr(97 + x) for x in rng.integers(0, 26, 1500)) for _ in range(3000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array(texts)], ["rec_id", "key"])
    task = CapturedArrow(spark)
    dedup.prefixes(task, spark.sparkContext.broadcast(np.full(dedup.BUCKETS, 2, np.int64)), 0.85)
    tracemalloc.start()
    rows = sum(x.num_rows for x in task.f(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 600_000 and peak < 30e6


class CapturedArrow(Captured):
    def mapInArrow(self, f, kind):
        self.f = f
        return self.sparkSession.createDataFrame([], kind)
