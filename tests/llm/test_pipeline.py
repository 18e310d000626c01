"""The pipeline's stages on planted documents."""

import random

import public_tokenizers

import corpus_pipeline
from tributary.llm.encode import Encoder


def test_stages_do_what_they_say(spark, tmp_path):
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    bench = prose(40)
    clean = {i: prose(60) for i in range(60)}
    toxic = {100 + i: f"{prose(30)} wretchling {prose(5)} scumbagel {prose(20)}" for i in range(40)}
    copies = {200 + i: clean[0].replace(" ", f" x{i} ", 1) for i in range(3)}
    passage = prose(60)
    repeats = {300 + i: f"{prose(40)} {passage} {prose(40)}" for i in range(3)}
    leaked = {400: f"{prose(10)} {bench} {prose(10)}"}
    odd = {500: None, 501: "", 502: "short"}
    rows = clean | toxic | copies | repeats | leaked | odd
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "kept") for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long, score string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in (clean | toxic)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    now, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        left[name] = {r.doc_id: r for r in now.collect()}
    assert set(left["toxicity"]) == set(rows) - set(toxic)
    assert set(left["ngram_join"]) == set(left["toxicity"]) - set(copies)
    cut = left["substring_dedup"]
    assert set(cut) == set(left["ngram_join"]) and all(r.text == rows[i] for i, r in cut.items() if i not in (301, 302))
    assert all(len(cut[i].text.split()) <= 120 and cut[i].n_chars == len(cut[i].text) for i in (301, 302))
    last = left["benchmark_decontamination"]
    assert set(last) == set(cut) - {400} and all(last[i].score == "kept" for i in last)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    enc = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert packed.length.sum() == sum(len(enc.whole(r.text or "")) + 1 for r in last.values()) and set(packed.doc_id) == set(last)


def test_stages_of_empty_tables_and_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, n_chars long, island int, grp string, token string, n int"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    few = spark.createDataFrame([(1, "a b c", 5, 7, "g", "t", 9), (1, "a b c", 5, 7, "g", "t", 9), (None, None, 0, 7, "g", "t", 9)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, few, str(tmp_path))
        assert out.columns == few.columns and {(r.island, r.grp, r.token, r.n) for r in out.collect()} == {(7, "g", "t", 9)}, name
