"""Stores and indexes on disk: what they hold, how much is rewritten or compared, and what broken runs leave behind."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tributary.functions.text import character_shingles
from tributary.operators import ann, curriculum, inference, retrieval
from tributary.sources import answers
from tributary.sources.record_index import RecordIndex
from tributary.sources.vector_store import Conflict, VectorStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PASSAGES = "document string, embedding array<float>, metadata map<string,string>, ordinal long"


# Inverted file


def vectors(spark, m, name="doc_id"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, embedding array<float>").repartition(4)


def exact(m, queries, k):
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - unit[queries] @ unit.T
    return {(q, int(j)) for q, row in zip(queries, d, strict=True) for j in np.lexsort((np.arange(len(m)), row))[:k]}


def test_few_cells_find_neighbours_that_gather(spark, tmp_path):
    rng = np.random.default_rng(1)
    m = np.repeat(rng.standard_normal((40, 32)), 50, axis=0) + 0.25 * rng.standard_normal((2000, 32))
    index = ann.build(vectors(spark, m), f"file://{tmp_path}/index", 40)
    queries = list(range(0, 2000, 20))
    rows = ann.search(index, vectors(spark, m, "query_id").where("query_id % 20 = 0"), 3, probes=4, rerank=0.4).collect()
    assert len(rows) == 300 and len({(r["query_id"], r["rank"]) for r in rows}) == 300
    found = {(r["query_id"], r["doc_id"]) for r in rows}
    assert len(found & exact(m, queries, 3)) >= 0.9 * 300
    assert sum({r["query_id"]: r["compared"] for r in rows}.values()) < 0.1 * 2000 * len(queries)
    assert index.vectors(spark).count() == 2000 and index.vectors(spark).select("doc_id").distinct().count() == 2000


def test_the_given_vectors_reach_the_recall_with_a_tenth_of_the_comparisons(spark, tmp_path):
    from tributary.plans.queries_models import vectors as given

    q, corpus = given(spark, "/root/testdata/sf0.01")
    index = ann.build(corpus, f"file://{tmp_path}/index")
    best = {(r["query_id"], r["doc_id"]) for r in retrieval.cosine_top_k(q, corpus, 3).collect()}
    rows = ann.search(index, q, 3).collect()
    assert len({(r["query_id"], r["doc_id"]) for r in rows} & best) >= 0.9 * len(best)
    assert sum({r["query_id"]: r["compared"] for r in rows}.values()) < 0.1 * corpus.count() * q.count()


def test_hot_cells_are_dealt_out_and_small_ones_filled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 30)
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    rng = np.random.default_rng(2)
    m = np.concatenate((np.tile([1.0, 0, 0, 0], (200, 1)), rng.standard_normal((9, 4))))  # one vector, two hundred times
    index = ann.build(vectors(spark, m), f"file://{tmp_path}/index", 6)
    rows = ann.search(index, vectors(spark, m, "query_id"), 3, probes=1, rerank=1.0).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["distance"]))
    assert all(sorted(x[0] for x in by[q]) == [1, 2, 3] for q in range(209))
    assert [x[1] for x in sorted(by[150])] == [0, 1, 2] and all(abs(x[2]) < 1e-6 for x in by[150])  # ties: the smaller id
    assert all(d != q for q, x in ((r["query_id"], r["doc_id"]) for r in ann.search(index, vectors(spark, m, "query_id"), 3, 1, 1.0, exclude_self=True).collect()) for d in [x])


def test_indexes_of_few_or_odd_vectors(spark, tmp_path):
    kind = "doc_id long, embedding array<float>"
    none = ann.build(spark.createDataFrame([], kind), f"file://{tmp_path}/none")
    one = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, [])], kind)
    q = one.withColumnRenamed("doc_id", "query_id")
    assert ann.search(none, q, 3).count() == 0
    rows = ann.search(ann.build(one, f"file://{tmp_path}/one"), q, 3).collect()
    assert {(r["query_id"], r["doc_id"]) for r in rows} == {(1, 1), (1, 4), (4, 1), (4, 4)}


# Vector store


def passages(spark, ids, mark):
    return spark.createDataFrame([(f"document {i}", [float(i)], {"v": f"{mark}{i}"}, i) for i in ids], PASSAGES)


def content(df):
    return sorted((r["id"], r["document"], tuple(r["embedding"]), tuple(sorted(r["metadata"].items()))) for r in df.collect())


def test_a_small_upsert_writes_little_and_equals_the_full_one(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store", buckets=16)
    assert store.count() == 0 and store.version() == 0
    assert store.upsert(passages(spark, range(2000), "a")) == 2000
    few = [*range(0, 1000, 100), *range(5000, 5010)]
    written = store.upsert(passages(spark, few, "b"))
    assert written == 20 and store.version() == 2
    full = retrieval.upsert(retrieval.upsert(None, passages(spark, range(2000), "a")), passages(spark, few, "b"))
    assert content(store.read()) == content(full) and store.count() == 2010
    for n in range(5):  # the same rows again and again: nothing is counted twice, and buckets are merged in time
        store.upsert(passages(spark, range(300), f"c{n}"))
    layers = store.manifest()["layers"]
    assert max(sum(n for _, n in cells[1:]) / cells[0][1] for cells in layers.values()) <= 0.5
    last = {r["document"]: r["metadata"]["v"] for r in store.read().collect()}
    assert len(last) == 2010 and last["document 7"] == "c47" and last["document 1999"] == "a1999" and last["document 5001"] == "b5001"
    assert content(VectorStore(spark, f"file://{tmp_path}/store").read()) == content(store.read())  # the number of buckets is kept
    assert store.vacuum() > 0 and len(last) == store.count()


def test_broken_and_competing_writers_leave_the_store_as_it_was(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/store", buckets=2)
    store.upsert(passages(spark, range(5), "a"))
    (tmp_path / "store" / "layers" / "half").mkdir()  # a layer without a manifest
    (tmp_path / "store" / "manifest" / "000000000002.json").write_text('{"n_buckets": 2, "lay')
    assert store.version() == 1 and store.count() == 5
    other = VectorStore(spark, f"file://{tmp_path}/store")
    manifest = other.manifest()
    store.upsert(passages(spark, [9], "b"))
    with pytest.raises(Conflict):
        other._commit(2, manifest)
    assert store.version() == 2 and store.count() == 6
    assert store.upsert(passages(spark, [], "c")) == 0 and store.version() == 2


# Soft labels


class Scorer:
    """Logits by prompt length; writes down the examples and dies after some calls."""

    def __init__(self, folder, dies_after=None):
        self.folder, self.dies_after = Path(folder), dies_after

    def __call__(self):
        return self.score

    def score(self, prompts, labels):
        calls = len(list(self.folder.iterdir()))
        if self.dies_after is not None and calls >= self.dies_after:
            raise RuntimeError("the scorer is gone")
        (self.folder / f"{calls}-{len(prompts) // 3}").touch()
        return [[[float(len(p)), 1.0] for _ in y] for p, y in zip(prompts, labels, strict=True)]


def test_soft_labels_are_stored_once_whatever_breaks(spark, tmp_path):
    calls, log = tmp_path / "calls", f"file://{tmp_path}/log"
    calls.mkdir()
    rows = [(0, f"e{i}", "q" * (i + 1), ["c"], ["n"], [1, 0]) for i in range(10)]
    df = spark.createDataFrame(rows, "batch int, example_id string, question string, contexts array<string>, negative array<string>, labels array<int>")
    with pytest.raises(Exception, match="the scorer is gone"):
        inference.score_into(log, df, Scorer(calls, 3), batch_size=2, partitions=1)
    assert answers.read_soft_labels(spark, log).select("example_id").distinct().count() == 6
    for _ in range(2):
        inference.score_into(log, df, Scorer(calls), batch_size=2, partitions=1)
    assert sum(int(p.name.split("-")[1]) for p in calls.iterdir()) == 10  # every example once
    found = sorted((r.example_id, r.pos, r.label, tuple(r.rag), tuple(r.bare)) for r in answers.read_soft_labels(spark, log).collect())
    direct = sorted((r.example_id, r.pos, r.label, tuple(r.rag), tuple(r.bare)) for r in inference.three_way_scores(df, lambda: lambda p, y: [[[float(len(x)), 1.0] for _ in z] for x, z in zip(p, y, strict=True)]).collect())
    assert found == direct and len(found) == 20
    # Two runs at once may have scored the same example; one of them counts.
    import shutil

    shutil.copytree(tmp_path / "log", tmp_path / "log2")
    shutil.copytree(tmp_path / "log", tmp_path / "log2" / "run-again")
    assert answers.read_soft_labels(spark, f"file://{tmp_path}/log2").count() == 20
    assert answers.read_soft_labels(spark, f"{log}-none").count() == 0


# Permutation


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 10, 17, 64, 65, 97, 1000, 4099])
def test_places_are_a_permutation_and_depend_on_the_key(spark, n):
    rows = spark.range(n).select(*(curriculum.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(k).cast("long")).alias(f"p{k}") for k in (5, 6))).collect()
    for k in ("p5", "p6"):
        assert sorted(r[k] for r in rows) == list(range(n))
    if n > 60:
        one, two = ([r[k] for r in rows] for k in ("p5", "p6"))
        assert sum(a == b for a, b in zip(one, two, strict=True)) < n / 4
        assert abs(np.corrcoef(one, range(n))[0, 1]) < 0.35 and sum(abs(a - b) == 1 for a, b in zip(one, one[1:], strict=False)) < n / 5


# Record index


def near_copies(seed, n):
    """Texts of which many are near copies of earlier ones, chains among them, some equal and some without text."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            t = list(texts[rng.integers(len(texts))])
            for _ in range(rng.integers(0, 4)):
                t[rng.integers(len(t))] = "xyz"[rng.integers(3)]
            texts.append("".join(t))
        else:
            texts.append("".join("abcdefgh "[i] for i in rng.integers(0, 9, 120)).strip() or "a")
    return texts


def sequential(texts):
    kept = []
    for i, t in enumerate(texts):
        own = set(character_shingles(t).tolist())
        if not t or all(len(own & s) < 0.85 * len(own | s) for _, s in kept):
            kept.append((i, own))
    return [i for i, _ in kept]


def test_batches_one_after_the_other_are_one_run(spark, tmp_path):
    texts = near_copies(3, 150)
    texts[20] = texts[90] = ""
    index = RecordIndex(spark, f"file://{tmp_path}/records", parts=4)
    found, layers = [], []
    for number, (low, high) in enumerate([(0, 5), (5, 80), (80, 81), (81, 81), (81, 120), (120, 150)]):
        rows = spark.createDataFrame([(i, texts[i], "x") for i in range(low, high)], "rec_id long, key string, part string")
        found += sorted(r.rec_id for r in index.add(rows, f"b{number}").collect())
        layers.append(len(index.manifest()["layers"]))
    want = sequential(texts)
    assert 20 in want and 90 in want and len(want) < 120
    assert found == want and sorted(r.rec_id for r in index.kept().collect()) == want and max(layers) > 1
    # a batch that comes again, into an index that was opened again, changes nothing
    again = RecordIndex(spark, f"file://{tmp_path}/records", 0.5, 9, 7)
    version = again.version()
    rows = spark.createDataFrame([(i, texts[i]) for i in range(5, 80)], "rec_id long, key string")
    assert sorted(r.rec_id for r in again.add(rows, "b1").collect()) == [i for i in want if 5 <= i < 80]
    assert (again.version(), again.threshold, again.k, again.parts) == (version, 0.85, 5, 4)
    assert again.vacuum() > 0 and sorted(r.rec_id for r in again.kept().collect()) == want
    with pytest.raises(Conflict):
        again._commit(version, again.manifest())
    with pytest.raises(ValueError):
        RecordIndex(spark, f"file://{tmp_path}/other", 1.0)


def test_a_batch_that_breaks_off_leaves_the_index(spark, tmp_path, monkeypatch):
    texts = near_copies(4, 40)
    index = RecordIndex(spark, f"file://{tmp_path}/records", parts=2)
    batch = lambda low, high: spark.createDataFrame([(i, texts[i]) for i in range(low, high)], "rec_id long, key string")
    index.add(batch(0, 20), "a")
    before = sorted(r.rec_id for r in index.kept().collect())

    def broken(*_):
        raise RuntimeError

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(RecordIndex, "_commit", broken)
        index.add(batch(20, 40), "b")
    assert sorted(r.rec_id for r in index.kept().collect()) == before
    index.add(batch(20, 40), "b")
    assert sorted(r.rec_id for r in index.kept().collect()) == sequential(texts)
