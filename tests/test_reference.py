"""Behaviour of the record, budget, retrieval, evaluation and inference operators on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tributary.functions import curation as C
from tributary.functions import metrics, sft, text
from tributary.operators import ann, budget, curate, curriculum, dedup, evaluate, inference, retrieval
from tributary.operators import softlabels as soft
from tributary.operators.ranks import with_rank
from tributary.plans.pipelines import prepare_training_set
from tributary.sources import records as src

RECORD = "rec_id long, instruction string, input string, output string"


def rows_of(spark, outputs, instruction="Explain the process of photosynthesis in simple terms"):
    return spark.createDataFrame([(i, instruction, "", o) for i, o in enumerate(outputs)], RECORD)


def test_gate_gives_the_first_reason(spark):
    outputs = [
        "A complete and useful answer.", "", "   ", None, "word " * 40, "I'm sorry, I cannot help with that.", "Explain the process of photosynthesis in simple terms", "### Response: here it is.",
        "This is a long answer that simply stops in the middle of a sentence without", "42", "bad\x00\x07 control but a fine answer.", "Emoji 🎉 answer is okay!", "这是一个完整的回答。", "I’m sorry, typographic is kept.",
    ]
    want = [None, "empty", "empty", "non_text", "degenerate_repetition", "refusal", "prompt_leak", "prompt_leak", "truncated", "too_short", None, None, None, None]
    got = {r.rec_id: r for r in curate.classify(rows_of(spark, outputs)).collect()}
    assert [got[i].reason for i in range(len(outputs))] == want
    assert got[10].cleaned == "bad control but a fine answer."
    relaxed = C.Thresholds(drop_refusals=False, drop_truncated=False, min_chars=1)
    kept = {r.rec_id for r in curate.curate(rows_of(spark, outputs), relaxed).collect()}
    assert {5, 8, 9} <= kept and not {1, 3, 4, 6, 7} & kept
    report = {r.outcome: r for r in curate.report(curate.classify(rows_of(spark, outputs))).collect()}
    assert report["total"].n == len(outputs) and report["total"].keep_rate == round(5 / 14, 4) and report["kept"].n == 5


def test_text_columns(spark):
    df = spark.createDataFrame([("ＡＢ  c ", "Straße, Café!", "The U.S.A. a an, answer")], "a string, b string, c string")
    r = df.select(text.clean(F.col("a")).alias("a"), text.canonical("b").alias("b"), text.qa_normalize(F.col("c")).alias("c"), text.passage_id(F.col("b")).alias("p")).first()
    assert (r.a, r.b, r.c, len(r.p)) == ("AB c", "strasse café", "usa answer", 32)
    assert text.canonical_text(None) == "" and len(text.character_shingles("abc")) == 1 and len(text.character_shingles("")) == 0 and len(text.character_shingles("abcdefg")) == 3


def keyed(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "rec_id long, key string")


def test_near_dedup_is_the_sequential_pass(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(150)) for _ in range(6)]
    texts = []
    for _ in range(60):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    texts += ["", "", "ab", "ab"]
    sets = [set(text.character_shingles(t).tolist()) for t in texts]
    like = lambda a, b: bool(a & b) and len(a & b) / len(a | b) >= 0.85
    kept = []
    for i, s in enumerate(sets):
        if not any(like(s, sets[j]) for j in kept):
            kept.append(i)
    assert sorted(r.rec_id for r in dedup.near_dedup(keyed(spark, texts)).collect()) == kept
    pairs = {(r.a, r.b) for r in dedup.similar_pairs(keyed(spark, texts).where("key <> ''")).collect()}
    assert pairs == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if like(sets[i], sets[j])}
    assert dedup.exact_dedup(keyed(spark, texts)).count() == len(set(texts))


def test_chain_keeps_both_ends(spark):
    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9)], "a long, b long, similarity double")
    assert [r.rec_id for r in dedup.first_kept(pairs).collect()] == [2]


def test_decontaminate(spark):
    rng = random.Random(2)
    leak = "".join(rng.choice("abcdefgh ") for _ in range(200))
    train = keyed(spark, [leak, leak[:-3] + "zzz", "a clean text that is different"])
    assert [r.rec_id for r in dedup.decontaminate(train, keyed(spark, [leak])).collect()] == [2]
    assert dedup.decontaminate(train, keyed(spark, [leak]).where("rec_id < 0")).count() == 3


def test_budget(spark):
    df = spark.createDataFrame([("",), ("这是没有空格的文字",), ("abcd efgh ij",), ("ab",)], "t string")
    from tributary.functions.budget import estimate_tokens

    assert [r.n for r in df.select(estimate_tokens(F.col("t")).alias("n")).collect()] == [0, 9, 3, 2]
    with pytest.raises(ValueError):
        estimate_tokens(F.col("t"), 0)
    lengths = [5, 500, 7, 480, 6, 510, 8, 490]
    df = spark.createDataFrame(list(enumerate(lengths)), "rec_id long, n_tokens long")
    naive, bucketed = (budget.padding_waste(f(df, 2)).first().waste for f in (budget.sequential_batches, budget.bucket_by_length))
    assert bucketed < 0.05 < naive
    s = budget.length_stats(df, 495).first()
    ordered = sorted(lengths)
    assert (s["count"], s.total, s.p50, s.p95, s.max, s.over_limit) == (8, sum(lengths), ordered[round(0.5 * 7)], ordered[round(0.95 * 7)], 510, 2)
    empty = budget.length_stats(df.where("rec_id < 0")).first()
    assert (empty["count"], empty.total, empty["mean"], empty.p50) == (0, 0, 0.0, 0)
    cost = budget.teacher_cost(rows_of(spark, ["x"] * 10, "abcd " * 16), 256, 0.5, 1.0).first()
    assert (cost.input_tokens, cost.output_tokens, cost.estimated_cost) == (200, 2560, round(0.1 + 2.56, 4))


def test_ranks_equal_row_numbers(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(r.rank == r.k + 1 for r in with_rank(df, "k").collect())


def test_supervised_arrays(spark):
    df = spark.createDataFrame([([1, 2], [5, 6, 9], [5, 6])], "p array<int>, r array<int>, open array<int>")
    ids, labels, mask = sft.supervised(F.col("p"), F.col("open"), 9, 8)
    closed = sft.supervised(F.col("p"), F.col("r"), 9, 4)[1]
    masked = sft.supervised(F.col("p"), F.col("r"), None, 2)[1]
    r = df.select(ids.alias("i"), labels.alias("l"), mask.alias("m"), closed.alias("c"), sft.is_trainable(masked).alias("t"), sft.padded_labels(F.col("r"), 5, 0).alias("pl"), sft.shift_right(sft.padded_labels(F.col("r"), 5, 0), 0).alias("s")).first()
    assert (r.i, r.l, r.m, r.c, r.t) == ([1, 2, 5, 6, 9], [-100, -100, 5, 6, 9], [1] * 5, [-100, -100, 5, 6], False)
    assert (r.pl, r.s) == ([5, 6, 9, -100, -100], [0, 5, 6, 9, 0])


def test_chunks_cover_all_words(spark):
    words = [f"w{i}" for i in range(600)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "  "), (3, "one")], "source_id long, text string")
    got = retrieval.chunk_passages(df).orderBy("source_id", "chunk_no").collect()
    assert [r.chunk.split() for r in got if r.source_id == 1] == [words[0:256], words[224:480], words[448:600]]
    assert [r.source_id for r in got] == [1, 1, 1, 3]
    with pytest.raises(ValueError):
        retrieval.chunk_windows(F.col("text"), 8, 8)


def test_store_and_retrieval(spark, tmp_path):
    df = spark.createDataFrame([(f"passage {i}", [float(i == j) for j in range(8)], None, i) for i in range(8)], "document string, embedding array<float>, metadata map<string,string>, ordinal long")
    store = retrieval.upsert(None, df)
    assert retrieval.upsert(store, df).count() == 8 and store.first().metadata["idx"] is not None
    corpus = df.select(F.col("ordinal").alias("doc_id"), "embedding")
    hits = retrieval.cosine_top_k(corpus.withColumnRenamed("doc_id", "query_id"), corpus, 20).collect()
    assert len(hits) == 64 and all(r.query_id == r.doc_id for r in hits if r.rank == 1)
    near = ann.search(ann.build(corpus, f"file://{tmp_path}/index"), corpus.withColumnRenamed("doc_id", "query_id"), 1)
    assert all(r.query_id == r.doc_id for r in near.collect())
    got = spark.createDataFrame([(0, p, p, [str(p)]) for p in range(5)], "batch long, pos long, query_id long, contexts array<string>")
    assert {r.query_id: r.negative for r in retrieval.retrieve_negative(got).collect()} == {p: [str((p + 2) % 5)] for p in range(5)}


def test_metrics(spark):
    pairs = [("The cat sat.", "cat sat", 1.0, 1.0), ("", "", 1.0, 1.0), ("", "x", 0.0, 0.0), ("a b c", "b c d", 0.0, 0.8), ("dog", "cat", 0.0, 0.0)]
    df = spark.createDataFrame([(p, r) for p, r, _, _ in pairs], "p string, r string")
    got = df.select(metrics.exact_match(F.col("p"), F.col("r")).alias("em"), metrics.token_f1(F.col("p"), F.col("r")).alias("f1"), metrics.bleu4(F.col("p"), F.col("r")).alias("b")).collect()
    assert [r.em for r in got] == [x[2] for x in pairs] and [round(r.f1, 6) for r in got] == [x[3] for x in pairs]
    want = math.exp(0.25 * (math.log(1.0) + math.log(1.0) + math.log(0.1) + math.log(0.1)))
    assert abs(got[0].b - want) < 1e-9 and [r.b for r in got[1:3]] == [0.0, 0.0] and got[4].b == 0.0


def test_calibration_covers_edges(spark):
    values = [0.0, 0.1, 0.1000001, 0.5, 1.0, 1.5]
    df = spark.createDataFrame([(v, 1.0) for v in values], "confidence double, correct double")
    bins = {r.bin: r.n for r in evaluate.calibration_bins(df).collect()}
    assert (bins[0], bins[1], bins[4], bins[9], sum(bins.values()), len(bins)) == (2, 1, 1, 1, 5, 10)
    assert evaluate.expected_calibration_error(df).first().n == 6
    assert evaluate.calibration_bins(df.where("confidence > 9")).count() == 0


def test_loss_of_a_batch(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(0, b, p, -100 if p == 5 else int(rng.integers(8)), *(rng.normal(size=8).tolist() for _ in range(4))) for b in range(3) for p in range(6)]
    df = spark.createDataFrame(rows, "batch long, example_id long, pos long, label int, rag array<double>, bare array<double>, neg array<double>, student array<double>")
    full = soft.kd_loss(df).first()
    assert abs(full.total - (0.5 * full.l_rag + 0.2 * full.l_kl + 0.1 * full.l_cra + 0.2 * full.l_ce + 0.3 * full.l_fuse)) < 1e-9 and 0.05 <= full.gate_mean <= 0.95
    moved = df.withColumn("rag", F.when(F.col("label") == -100, F.transform("rag", lambda x: x * 9)).otherwise(F.col("rag")))
    assert abs(soft.kd_loss(moved).first().total - full.total) < 1e-9
    assert soft.kd_loss(df.withColumn("neg", F.col("rag"))).first().l_cra == pytest.approx(0.5)
    assert soft.kd_loss(df.withColumn("label", F.lit(-100))).first().l_ce is None
    assert soft.kd_loss(df, soft.LossWeights(gated=False, epsilon=0.0)).first()["gate_mean"] == 0.5


def test_curriculum(spark):
    df = spark.createDataFrame([(str(i), u) for i, u in enumerate((0.0, 5.0, -3.0, 2.0, 9.0))], "example_id string, utility double")
    ranks = curriculum.ranked(df)
    assert {r.example_id for r in curriculum.visible_pool(ranks, 0.4).collect()} == {"4", "1"}
    assert curriculum.visible_pool(ranks, 0.0).count() == 1 and curriculum.visible_pool(ranks, 1.0).count() == 5
    epochs = curriculum.epoch_pools(df, batch_size=1, accumulation=1).collect()
    assert sorted(r.place for r in epochs if r.epoch == 2) == [1, 2, 3, 4, 5]


def test_generation_job(spark):
    class Client:
        def __init__(self):
            self.n = 0

        def __call__(self, prompt):
            self.n += 1
            if "bad" in prompt:
                raise inference.CallFailed("bad request", 400)
            if "busy" in prompt and self.n % 3:
                raise inference.CallFailed("slow down", 429)
            return "ok"

    df = spark.createDataFrame([(1, "fine", "", ""), (2, "bad", "", ""), (3, "busy", "", "")], RECORD)
    got = {r.rec_id: r for r in inference.generate(df, Client, inference.JobSettings(base_delay=0.0, requests_per_second=0, partitions=2)).collect()}
    assert (got[1].output, got[3].output, got[2].output) == ("ok", "ok", None) and got[2].error.startswith("400")
    assert inference.delay(9, inference.JobSettings(), lambda: 1.0) == 60.0 and inference.is_retryable(None) and inference.is_retryable(503) and not inference.is_retryable(404)
    assert inference.provider(" PassThrough ") == "passthrough"
    with pytest.raises(ValueError):
        inference.provider("nobody")
    with pytest.raises(Exception, match="no teacher output"):
        inference.distill_targets(df, df.where("rec_id = 1").select("rec_id", "output")).collect()


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    src.append_generations(spark.createDataFrame([(1, "a"), (2, "é\n😀")], "rec_id long, output string"), path)
    (tmp_path / "log" / "zz-torn.txt").write_text('{"index": 3, "out\n\n{"index": "1", "output": "again"}\n{"index": 4}\n')
    got = {r.rec_id: r.output for r in src.read_generation_log(spark, path).collect()}
    assert got[2] == "é\n😀" and got[4] == "" and 3 not in got and set(got) == {1, 2, 4}


def test_normalize_maps_and_strips(spark):
    df = spark.createDataFrame([(1, " q ", None, 0)], "rec_id long, question string, answer string, extra int")
    r = src.normalize(df, "question", "extra", "answer").first()
    assert (r.instruction, r.input, r.output) == ("q", "", "")


def test_pipeline_reports_stages_and_refuses_an_empty_result(spark):
    good = [f"Answer number {i} explains the matter in a complete sentence about topic {i * 37}." for i in range(6)]
    train = spark.createDataFrame([(i, f"question {i * 7919} about {i}", "", o) for i, o in enumerate([*good, "", good[0]])], RECORD)
    kept, report = prepare_training_set(train, train.where("rec_id = 2"))
    stages = {r.stage: (r.n, r.removed) for r in report.collect()}
    assert stages["input"] == (8, 0) and stages["curated"] == (7, 1) and kept.where("rec_id = 2").count() == 0
    with pytest.raises(ValueError):
        prepare_training_set(rows_of(spark, ["", " "]), rows_of(spark, ["x"]))


def test_streams(spark, tmp_path):
    from tributary.streaming.streams import curate_stream, dedup_stream

    rows = rows_of(spark, ["A complete and useful answer.", "", "A complete and useful answer."]).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.write.parquet(str(tmp_path / "in"))
    stream = dedup_stream(curate_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("kept").count() == 1


def test_long_chains_are_decided(spark):
    pairs = spark.createDataFrame([(i, i + 1, 0.9) for i in range(230)], "a long, b long, similarity double")
    assert sorted(r.rec_id for r in dedup.first_kept(pairs).collect()) == list(range(1, 231, 2))


def test_crowds_of_near_copies(spark, monkeypatch):
    """Large groups are compared with their first record; the result is that of the sequential pass."""
    rng = random.Random(5)
    monkeypatch.setattr(dedup, "CROWD", 4)
    texts = []
    for base in ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(3)):
        for _ in range(30):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
    rng.shuffle(texts)
    sets, kept = [set(text.character_shingles(text.canonical_text(t)).tolist()) for t in texts], []
    for i, s in enumerate(sets):
        if not any(len(s & sets[j]) / len(s | sets[j]) >= 0.85 for j in kept):
            kept.append(i)
    assert sorted(r.rec_id for r in dedup.near_dedup(keyed(spark, texts)).collect()) == kept


def test_request_rate():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    pace = inference.Pace(2.0, lambda: now[0], sleep)
    waits = [pace.wait() for _ in range(6)]
    assert waits[:2] == [0, 0] and all(abs(w - 0.5) < 1e-9 for w in waits[2:]) and abs(sum(slept) - 2.0) < 1e-9
    now[0] += 100.0
    assert [pace.wait() for _ in range(2)] == [0, 0] and pace.wait() > 0  # no more than the burst is saved up
    assert inference.Pace(0).wait() == 0
    with pytest.raises(ValueError):
        inference.JobSettings(requests_per_second=-1)


def test_generation_job_resumes_and_batches(spark, tmp_path):
    class Batches:
        def batch(self, prompts):
            if any("bad" in p for p in prompts):
                raise inference.CallFailed("no", 400)
            return [f" {len(prompts)} " for p in prompts]

    df = spark.createDataFrame([(i, "bad" if i == 9 else f"q{i}", "", f"gold {i}") for i in range(10)], "rec_id long, instruction string, input string, output string")
    log, settings = f"file://{tmp_path}/log", inference.JobSettings(base_delay=0.0, requests_per_second=0, partitions=1, batch_size=3)
    got = {r.rec_id: r for r in inference.generation_job(df.where("rec_id < 7"), Batches, settings, log).collect()}
    assert len(got) == 7 and {r.output for r in got.values()} <= {"1", "3"} and not any(r.error for r in got.values())
    again = {r.rec_id: r for r in inference.generation_job(df, Batches, settings, log).collect()}
    assert all(again[i].output == got[i].output for i in got) and again[9].output == "" and "400" in again[9].error
    assert {r.output for r in inference.generation_job(df, " PassThrough ", settings).collect()} == {f"gold {i}" for i in range(10)}
    with pytest.raises(ValueError):
        inference.provider("nobody")
    assert src.read_generation_log(spark, f"file://{tmp_path}/none").count() == 0


def test_three_way_scores_are_split_back(spark):
    df = spark.createDataFrame([(0, f"e{i}", "q", ["c"], ["n"], [1, 2]) for i in range(5)], "batch int, example_id string, question string, contexts array<string>, negative array<string>, labels array<int>")
    make = lambda: lambda prompts, labels: [[[float(len(p)), float(k)] for k in range(len(y))] for p, y in zip(prompts, labels)]
    rows = inference.three_way_scores(df, make, batch_size=2).collect()
    bare, rag = len("Question: q\nAnswer:"), len("Context 1: c\nContext 2: \nContext 3: \nQuestion: q\nAnswer:")
    assert len(rows) == 10 and all((r.rag[0], r.bare[0], r.neg[0], r.bare[1]) == (rag, bare, rag, r.pos) for r in rows)


def test_generation_stream_goes_on_from_its_log(spark, tmp_path):
    from tributary.streaming.streams import generate_stream

    schema = "rec_id long, instruction string, input string, output string"
    settings = inference.JobSettings(base_delay=0.0, requests_per_second=0, partitions=2)
    for ids in (range(5), range(3, 9)):
        spark.createDataFrame([(i, f"question {i}", "", "") for i in ids], schema).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        generate_stream(rows, inference.EchoTeacher, f"file://{tmp_path}/log", f"{tmp_path}/state", settings).trigger(availableNow=True).start().awaitTermination(120)
    log = src.read_generation_log(spark, f"file://{tmp_path}/log").collect()
    assert sorted(r.rec_id for r in log) == list(range(9)) and {r.output for r in log} == {"echo 10"}
    assert spark.read.option("recursiveFileLookup", "true").text(f"file://{tmp_path}/log").count() == 9  # nothing was asked twice


def test_reports_are_written(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "name string, value double")
    for kind in ("json", "parquet"):
        src.write_report(rows, f"{tmp_path}/{kind}", kind)
        src.write_report(rows, f"{tmp_path}/{kind}", kind)
        assert sorted(map(tuple, src.read_table(spark, f"{tmp_path}/{kind}", kind, rows.schema).collect())) == [("a", 1.5), ("b", None)]
    labels = spark.createDataFrame([(0, "e", 0), (1, "f", 0)], "batch int, example_id string, pos int")
    src.write_soft_labels(labels, f"{tmp_path}/labels")
    assert src.pending_soft_labels(labels.union(spark.createDataFrame([(1, "g", 0)], labels.schema)), spark.read.parquet(f"{tmp_path}/labels")).first().example_id == "g"


def test_tokenized_records_are_cut_and_masked(spark):
    from tributary.operators.supervised import tokenize_records

    df = spark.createDataFrame([(1, "q", "", "ab"), (2, "q" * 400, "", "ab"), (3, None, None, None)], "rec_id long, instruction string, input string, output string")
    rows = {r.rec_id: r for r in tokenize_records(df, lambda: lambda texts: [[ord(c) for c in t] for t in texts], 2, 300).collect()}
    assert rows[1].labels[-3:] == [97, 98, 2] and set(rows[1].labels[:-3]) == {-100} and rows[1].attention_mask == [1] * len(rows[1].input_ids)
    assert len(rows[2].input_ids) == 300 and set(rows[2].labels) == {-100} and rows[3].labels[-1] == 2


def test_records_of_one_small_vocabulary_make_few_candidates(spark, tmp_path):
    """All texts share all shingles of one small vocabulary: tables of common shingles would hold every pair."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(80, 160))) for _ in range(300)]
    texts += [t + " xyz" for t in texts[:20]] + texts[:15]
    sets = [set(text.character_shingles(t).tolist()) for t in texts]
    want = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])}
    dedup.sketches(keyed(spark, texts), 0.85).write.parquet(f"{tmp_path}/sketches")
    drawn = spark.read.parquet(f"{tmp_path}/sketches")
    found = {(r.a, r.b) for r in dedup.candidates(drawn).collect()}
    meetings = sum(bool(a & b) for a, b in itertools.combinations(sets, 2))
    assert want <= found and len(found) < meetings / 20
    assert {(r.a, r.b) for r in dedup.similar_pairs(keyed(spark, texts)).collect()} == want


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_candidates_lose_no_pair_at_other_thresholds_and_block_sizes(spark, monkeypatch, threshold):
    rng = random.Random(8)
    monkeypatch.setattr(dedup, "ROWS", 16)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (3, 40, 90, 200, 500)]
    texts = [b[: rng.randrange(1, len(b) + 1)] + "".join(rng.choice("ab") for _ in range(rng.randrange(9))) for b in base for _ in range(24)]
    sets = [set(text.character_shingles(t).tolist()) for t in texts]
    like = lambda a, b: len(a & b) > 0 and len(a & b) / len(a | b) >= threshold
    got = {(r.a, r.b) for r in dedup.similar_pairs(keyed(spark, texts), threshold=threshold).collect()}
    assert got == {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if like(sets[i], sets[j])}
    left, right = keyed(spark, texts).where("rec_id < 70"), keyed(spark, texts).where("rec_id >= 70")
    got = {(r.a, r.b) for r in dedup.similar_pairs(left, right, threshold).collect()}
    assert got == {(i, j) for i in range(70) for j in range(70, len(texts)) if like(sets[i], sets[j])}


def test_pairs_of_a_crowd_are_compared_without_a_text_a_pair(spark, monkeypatch, capsys):
    """Keys go to tasks once for the pairs of two shares of a crowd, also where a crowd is cut into many shares."""
    rng = random.Random(21)
    monkeypatch.setattr(dedup, "TOGETHER", 2000)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3)]
    texts = [b[:at] + rng.choice("xyz") + b[at + 1 :] for b in base for at in rng.sample(range(300), 20)] + ["alone", "other"]
    sets = [set(text.character_shingles(t).tolist()) for t in texts]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    every = spark.createDataFrame(list(itertools.combinations(range(len(texts)), 2)), "a long, b long")
    keys = keyed(spark, texts)
    found = dedup._compared(every, keys, keys, 0.85, 5)
    assert {(r.a, r.b): r.similarity for r in found.collect()} == {(i, j): alike(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if alike(i, j) >= 0.85}
    both = dedup._compared(every.where("b < 30"), keys, keyed(spark, texts).where("rec_id < 30"), 0.85, 5)
    assert {(r.a, r.b) for r in both.collect()} == {(i, j) for i, j in itertools.combinations(range(30), 2) if alike(i, j) >= 0.85}
    found.explain()
    assert "FlatMapCoGroupsInArrow" in capsys.readouterr().out


def test_crowds_are_left_out_with_one_pass_over_all_sketches(spark, monkeypatch):
    """Records are compared again only where they had too many candidates; large widths are cut into tiles of like work."""
    rng = random.Random(9)
    passes, real = [], dedup.candidates
    monkeypatch.setattr(dedup, "candidates", lambda left, right=None, *args: (passes.append(right is None), real(left, right, *args))[1])
    monkeypatch.setattr(dedup, "CROWD", 3)
    texts = []
    for base in ("".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(4)):
        for _ in range(25):
            t = list(base)
            for _ in range(rng.randrange(0, 9)):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            texts.append("".join(t))
    rng.shuffle(texts)
    sets, kept = [set(text.character_shingles(t).tolist()) for t in texts], []
    for i, s in enumerate(sets):
        if not any(len(s & sets[j]) / len(s | sets[j]) >= 0.85 for j in kept):
            kept.append(i)
    assert sorted(r.rec_id for r in dedup.near_dedup(keyed(spark, texts)).collect()) == kept
    assert passes.count(True) == 1 and len(passes) > 1
    assert dedup._tiles([[(1024, 1_060_000)]], False)[1] >= 45
