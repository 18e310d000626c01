"""Generation jobs that break off, are run again or run twice at once, and the rate that their tasks share."""

import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark import cloudpickle

from tributary.operators import inference
from tributary.operators.coordination import Bucket, Coordinator
from tributary.sources import answers
from tributary.sources import records as src

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this module

REPO = Path(__file__).resolve().parents[1]
RECORD = "rec_id long, instruction string, input string, output string"
FAST = inference.JobSettings(base_delay=0.0, requests_per_second=0, partitions=1)


def records(spark, n):
    return spark.createDataFrame([(i, f"question {i}", "", f"gold {i}") for i in range(n)], RECORD)


class Counting:
    """Writes down every call; dies at the given one."""

    def __init__(self, folder, dies_at=None):
        self.folder, self.dies_at = Path(folder), dies_at

    def __call__(self):
        return self.answer

    def answer(self, prompt):
        body = prompt.split("### Instruction:\n", 1)[-1].split("\n\n###", 1)[0]
        n = len(list(self.folder.iterdir())) + 1
        (self.folder / f"{time.time_ns()}-{body.split()[-1]}").touch()
        if n == self.dies_at:
            raise RuntimeError("the process is gone")
        return f"answer {body}"

    def calls(self):
        return sorted(int(p.name.split("-")[1]) for p in self.folder.iterdir())


def test_a_killed_job_leaves_its_answers_and_the_next_run_asks_for_the_rest(spark, tmp_path):
    log, calls = f"file://{tmp_path}/log", tmp_path / "calls"
    calls.mkdir()
    with pytest.raises(Exception, match="the process is gone"):
        inference.generation_job(records(spark, 10), Counting(calls, dies_at=6), FAST, log)
    logged = src.read_generation_log(spark, log).collect()
    assert len(logged) == 5 and all(r.output == f"answer question {r.rec_id}" for r in logged)
    got = inference.generation_job(records(spark, 10), Counting(calls), FAST, log).collect()
    assert sorted((r.rec_id, r.output, r.error) for r in got) == [(i, f"answer question {i}", None) for i in range(10)]
    made = Counting(calls).calls()
    assert len(made) == 6 + 5 and len(set(made)) == 10  # only the call that was under way was made twice
    assert inference.generation_job(records(spark, 10), Counting(calls, dies_at=12), FAST, log).count() == 10  # nothing is left to ask


def test_several_answers_in_a_file_and_a_compact_log(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    settings = inference.JobSettings(base_delay=0.0, requests_per_second=0, partitions=2, log_every=4)
    inference.generation_job(records(spark, 20), inference.EchoTeacher, settings, log)
    files = list((tmp_path / "log").rglob("*.json"))
    assert 5 <= len(files) <= 6 and not [p for p in files if p.name.startswith("_")]
    before = sorted(map(tuple, src.read_generation_log(spark, log).collect()))
    assert answers.compact_log(spark, log) >= 5 and not list((tmp_path / "log").rglob("*.json"))
    assert sorted(map(tuple, src.read_generation_log(spark, log).collect())) == before and len(before) == 20
    assert answers.compact_log(spark, f"{log}-none") == 0


def test_files_without_a_commit_mark_do_not_count(spark, tmp_path):
    own = answers.PartLog(f"file://{tmp_path}/log", "r", 3)
    own.add(1, "é\n")
    Path(own.folder, "_torn.json").write_text('{"index": 2, "out')
    assert own.landed() == {1: "é\n"}
    assert [tuple(r) for r in src.read_generation_log(spark, f"file://{tmp_path}/log").collect()] == [(1, "é\n")]


_RETRY = """
import sys
from pathlib import Path
from pyspark.sql import SparkSession
sys.path[:0] = [sys.argv[1], sys.argv[1] + "/tests"]
from test_jobs import Counting, RECORD
from tributary.operators import inference
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = spark.createDataFrame([(i, f"question {i}", "", "") for i in range(12)], RECORD)
Path(sys.argv[2], "calls").mkdir()
client = Counting(sys.argv[2] + "/calls", dies_at=5)
settings = inference.JobSettings(base_delay=0.0, requests_per_second=0, partitions=1)
got = inference.generation_job(rows, client, settings, "file://" + sys.argv[2] + "/log").collect()
assert sorted((r.rec_id, r.output) for r in got) == [(i, f"answer question {i}") for i in range(12)], got
made = client.calls()
assert len(made) == 13 and len(set(made)) == 12, made
print("fine")
"""


def test_a_task_that_is_run_again_goes_on_where_it_was(tmp_path):
    done = subprocess.run([sys.executable, "-c", _RETRY, str(REPO), str(tmp_path)], capture_output=True, text=True, timeout=240, check=False)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


def test_a_second_attempt_waits_for_the_first_one():
    order = []
    with Coordinator(0.0) as c:
        first, second, other = (c.address.connect() for _ in range(3))
        first.claim(4)
        other.claim(5)  # another partition is free

        def late():
            second.claim(4)
            order.append("second")

        waiting = threading.Thread(target=late)
        waiting.start()
        time.sleep(0.3)
        order.append("first is done")
        first.close()
        waiting.join(10)
        assert order == ["first is done", "second"]
        second.close()
        last = c.address.connect()
        last.claim(4)
        for lease in (other, last):
            lease.close()


def test_only_those_with_the_key_are_served():
    from multiprocessing import AuthenticationError
    from multiprocessing.connection import Client

    with Coordinator(0.0) as c:
        with pytest.raises((AuthenticationError, EOFError, ConnectionError)):
            Client((c.address.host, c.address.port), authkey=b"guess")
        assert c.address.connect().wait() == 0.0


def test_a_bucket_gives_the_whole_rate_and_never_more():
    now = [0.0]
    bucket = Bucket(4.0, clock=lambda: now[0])
    starts = [now[0] + bucket.reserve() for _ in range(24)]
    assert starts[:4] == [0.0] * 4 and starts[4:] == pytest.approx([(k + 1) / 4 for k in range(20)])
    now[0] = 100.0
    assert [bucket.reserve() for _ in range(5)] == pytest.approx([0, 0, 0, 0, 0.25])  # idle time saves up one second's calls
    assert Bucket(0.0).reserve() == 0.0 and Bucket(0.5, clock=lambda: 0.0).reserve() == 0.0


def test_partitions_of_unequal_size_keep_the_full_rate():
    """40 calls of one task and one each of three others at 50 a second: what the others don't use goes to the first."""
    at = []
    with Coordinator(50.0) as c:
        c.bucket.tokens = 1.0

        def task(n):
            with c.address.connect() as lease:
                for _ in range(n):
                    lease.wait()
                    at.append(time.monotonic())

        threads = [threading.Thread(target=task, args=(n,)) for n in (40, 1, 1, 1)]
        began = time.monotonic()
        for t in threads:
            t.start()
        for t in threads:
            t.join(30)
    took = max(at) - began
    assert len(at) == 43 and 42 / 50 * 0.9 <= took < 42 / 50 + 0.6  # a fourth of the rate would take three seconds
