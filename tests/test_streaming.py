"""Streams that keep state, against the same rows as a table."""

import hashlib
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tributary.functions import text
from tributary.operators import curate, dedup
from tributary.streaming import firsts
from tributary.streaming.streams import read_report, report_stream

SCHEMA = "rec_id long, key string, ts timestamp, fp string, replaces double"


@pytest.fixture
def stateful(spark):
    before = spark.conf.get(firsts.STATE_STORE[0])
    spark.conf.set(*firsts.STATE_STORE)
    yield spark
    spark.conf.set(firsts.STATE_STORE[0], before)


def arrivals(spark, rows, folder, n):
    """The rows as n files, in the order given, and the stream that reads one after the other."""
    size = -(-len(rows) // n)
    frames = [spark.createDataFrame(rows[i : i + size], SCHEMA) for i in range(0, len(rows), size)]
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination(180)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


def made(n, keys):
    rng = random.Random(n)
    return [(i, rng.choice([None, "", *(f"k{j}" for j in range(keys)), "hot", "hot"]), i, None if i % 3 else f"f{i}", float(i)) for i in range(n)]


def stamped(rows):
    from datetime import UTC, datetime

    return [(a, b, datetime.fromtimestamp(1_700_000_000 + c, UTC), *rest) for a, b, c, *rest in rows]


def first_ids(rows):
    """Brute force: the smallest id of each key."""
    found = {}
    for r in rows:
        if r[0] is not None:
            found[r[1]] = min(found.get(r[1], r[0]), r[0])
    return sorted(found.values())


def test_changes_give_the_batch_result_in_any_order(stateful, tmp_path):
    rows = made(400, 40)
    random.Random(5).shuffle(rows)
    rows = stamped([*rows, *rows[:20], (None, "only here", 0, None, None)])
    changes = run(firsts.first_changes(arrivals(stateful, rows, f"{tmp_path}/in", 4), F.col("key")), tmp_path)
    kept = firsts.current_firsts(changes).orderBy("rec_id").collect()
    assert [r.rec_id for r in kept] == first_ids(rows)
    batch = dedup.exact_dedup(stateful.createDataFrame(rows, SCHEMA).dropDuplicates().where("key is not null"))
    assert {r.rec_id for r in batch.collect()} == {r.rec_id for r in kept if r.key is not None}
    by_id = {r[0]: r for r in rows}
    assert all((r.key, r.fp) == (by_id[r.rec_id][1], by_id[r.rec_id][3]) for r in kept)  # records come whole
    assert changes.count() < 400  # repeats do not go out


def test_changes_go_on_from_their_state(stateful, tmp_path):
    rows = stamped(made(60, 6))
    run(firsts.first_changes(arrivals(stateful, rows[30:], f"{tmp_path}/in", 1), F.col("key")), tmp_path)
    changes = run(firsts.first_changes(arrivals(stateful, rows[:30], f"{tmp_path}/in", 1), F.col("key")), tmp_path)
    assert sorted(r.rec_id for r in firsts.current_firsts(changes).collect()) == first_ids(rows)
    assert changes.where("replaces is not null").count() > 0
    again = run(firsts.first_changes(stateful.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), F.col("key")), tmp_path)
    assert again.count() == changes.count()


def test_settled_records_come_once_when_the_watermark_has_passed(stateful, tmp_path):
    rows = made(300, 30)
    late = random.Random(1)
    rows.sort(key=lambda r: r[2] + late.randrange(80))  # disorder below the delay
    rows = stamped([*rows, (10_000, "flush", 10_000, None, None), (10_001, "flush", 10_001, None, None)])
    stream = firsts.first_settled(arrivals(stateful, rows, f"{tmp_path}/in", 4), F.col("key"), "ts", "100 seconds")
    got = sorted(r.rec_id for r in run(stream, tmp_path).collect())
    assert got == [i for i in first_ids(rows) if i < 10_000]  # the last key waits for the watermark


def test_empty_streams(stateful, tmp_path):
    stateful.createDataFrame([], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stateful.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert firsts.current_firsts(run(firsts.first_changes(stream, F.col("key")), tmp_path)).count() == 0


def test_running_report_is_that_of_the_table(spark, tmp_path):
    said = ["A complete and useful answer.", "", None, "I'm sorry, I cannot help.", "short", "### Response: leak here."] * 5
    rows = spark.createDataFrame([(i, f"ask {i}", "", o) for i, o in enumerate(said)], "rec_id long, instruction string, input string, output string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        report_stream(stream, f"{tmp_path}/report", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    want = {tuple(r) for r in curate.report(curate.classify(rows)).collect()}
    assert {tuple(r) for r in read_report(spark, f"{tmp_path}/report").collect()} == want


def test_digests_of_keys_hold_one_text_at_a_time():
    texts = pa.array([f"Text {i} " + "ＡＢ ß, word! " * 300 for i in range(3000)] + [None, ""])
    want = [hashlib.md5(text.canonical_text(x).encode()).hexdigest() for x in (texts[0].as_py(), texts[1].as_py(), None, "")]
    tracemalloc.start()
    got = text.key_digest.func(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [got[i].as_py() for i in (0, 1, 3000, 3001)] == want and peak < 2e6
