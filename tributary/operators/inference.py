"""Resumable generation jobs against a teacher, with retries and a request rate."""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions.text import bare_prompt, build_prompt, filled, rag_prompt, strip, student_input
from tributary.operators.coordination import Coordinator
from tributary.session import save, shared_dir
from tributary.sources.answers import SOFT_LABELS, LabelLog, PartLog, read_soft_labels
from tributary.sources.records import read_generation_log

#: Statuses after which another attempt may succeed; so does a call that got no status at all.
RETRIED = {408, 409, 425, 429}


class CallFailed(Exception):
    """A teacher's error; ``status`` is its HTTP status, or None where there was no answer."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class JobSettings:
    attempts: int = 5
    base_delay: float = 1.0
    max_delay: float = 60.0
    requests_per_second: float = 4.0  # of all partitions together; 0: no limit
    partitions: int = 8
    batch_size: int = 8  # prompts in a call of a client that takes several
    log_every: int = 1  # answers in a file of the log

    def __post_init__(self):
        if self.requests_per_second < 0 or min(self.attempts, self.batch_size, self.partitions, self.log_every) < 1:
            raise ValueError("requests_per_second must not be negative; attempts, batch_size, partitions and log_every are at least 1")


class Pace:
    """A token bucket: ``rate`` calls a second, up to max(1, rate) of them at once."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.size, self.clock, self.sleep = rate, max(1.0, rate), clock, sleep
        self.tokens, self.at = self.size, clock()

    def wait(self) -> float:
        """Takes a token, after sleeping until there is one; returns the seconds slept."""
        if not self.rate:
            return 0.0
        now = self.clock()
        self.tokens, self.at = min(self.size, self.tokens + (now - self.at) * self.rate), now
        pause = max(0.0, (1 - self.tokens) / self.rate)
        if pause:
            self.sleep(pause)
        self.tokens -= 1
        return pause


def is_retryable(status: int | None) -> bool:
    return status is None or status in RETRIED or 500 <= status <= 599


def delay(attempt: int, s: JobSettings, jitter: Callable[[], float] = random.random) -> float:
    """Full jitter below an exponential cap; attempt counts from 1."""
    return min(s.base_delay * 2 ** (attempt - 1), s.max_delay) * jitter()


def call(client: Callable, request, s: JobSettings, sleep: Callable[[float], None] = time.sleep) -> tuple:
    """(output, error) of a request (a prompt, or a list of prompts) after at most ``attempts`` tries."""
    for attempt in range(1, s.attempts + 1):
        try:
            return client(request), None
        except CallFailed as e:
            if attempt == s.attempts or not is_retryable(e.status):
                return None, f"{e.status}: {e}"
            sleep(delay(attempt, s))
    raise AssertionError("attempts is at least 1")


def _answers(prompts: list[str], client, pace, s: JobSettings) -> Iterator[tuple[str | None, str | None]]:
    """(output, error) of each prompt; a client with a ``batch`` method gets ``batch_size`` prompts at once."""
    if not hasattr(client, "batch"):
        for prompt in prompts:
            pace.wait()
            yield call(client, prompt, s)
        return
    for lo in range(0, len(prompts), s.batch_size):
        part = prompts[lo : lo + s.batch_size]
        pace.wait()
        outputs, error = call(client.batch, part, s)
        yield from zip(outputs if error is None else [None] * len(part), [error] * len(part), strict=True)


def _ask(prompts: DataFrame, key: str, make_client: Callable[[], Callable], settings: JobSettings) -> DataFrame:
    """(key, prompt) to (key, output, error); the request rate is shared out among the partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, pace = make_client(), Pace(settings.requests_per_second / settings.partitions)
        for batch in batches:
            found = list(_answers(batch["prompt"].tolist(), client, pace, settings))
            yield pd.DataFrame({key: batch[key], "output": [x for x, _ in found], "error": [e for _, e in found]}, columns=[key, "output", "error"])

    kind = prompts.schema[key].dataType.simpleString()
    return prompts.select(key, "prompt").repartition(settings.partitions, key).mapInPandas(run, f"{key} {kind}, output string, error string")


def generate(records: DataFrame, make_client: Callable[[], Callable], settings: JobSettings = JobSettings()) -> DataFrame:
    """rec_id, output, error. ``make_client()`` is called once a partition; failures become rows, not failed tasks."""
    return _ask(records.select("rec_id", build_prompt(F.col("instruction"), F.col("input")).alias("prompt")), "rec_id", make_client, settings)


def predict(examples: DataFrame, make_client: Callable[[], Callable], settings: JobSettings = JobSettings(), n_contexts: int = 2) -> DataFrame:
    """(example_id, question, reference[, contexts]) to (example_id, prediction, reference, error): with contexts the first
    ``n_contexts`` of them stand before the question."""
    q = F.col("question")
    prompt = rag_prompt(q, F.col("contexts"), n_contexts) if "contexts" in examples.columns else student_input(q)
    said = _ask(examples.select("example_id", prompt.alias("prompt")), "example_id", make_client, settings)
    return examples.select("example_id", "reference").join(said, "example_id").select("example_id", F.col("output").alias("prediction"), "reference", "error")


def generate_into(log: str, records: DataFrame, make_client: Callable[[], Callable], settings: JobSettings = JobSettings()) -> DataFrame:
    """Asks for every record and puts each answer into the log as it lands; returns the failures (saved): rec_id, error.
    A task that is run again, or a speculative copy, goes on from what its partition has in the log, after the attempt
    before it has ended; only a call that was under way then is made twice. All tasks share the request rate."""
    spark, run = records.sparkSession, uuid.uuid4().hex

    with Coordinator.of(spark, settings.requests_per_second) as coordinator:
        address = coordinator.address

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            part, client = TaskContext.get().partitionId(), None
            with address.connect() as lease:
                lease.claim(part)
                own = PartLog(log, run, part, settings.log_every)
                done = own.landed()
                try:
                    for batch in batches:
                        rows = batch[[x not in done for x in batch["rec_id"]]]
                        client = client or (make_client() if len(rows) else None)
                        failed: list[tuple[int, str]] = []
                        for rec_id, (output, error) in zip(rows["rec_id"].tolist(), _answers(rows["prompt"].tolist(), client, lease, settings), strict=True):
                            if error is None:
                                own.add(rec_id, output or "")
                            else:
                                failed.append((rec_id, error))
                        yield pd.DataFrame(failed, columns=["rec_id", "error"])
                finally:
                    own.flush()

        prompts = records.select("rec_id", build_prompt(F.col("instruction"), F.col("input")).alias("prompt"))
        asked = prompts.repartition(settings.partitions, "rec_id").mapInPandas(work, "rec_id long, error string")
        return save(asked, "failed-calls")


PASSTHROUGH = "passthrough"


class EchoTeacher:
    """A deterministic teacher for tests: says how long the prompt's instruction is, and fails at first for some."""

    def __init__(self):
        self.failed: set[str] = set()

    def __call__(self, prompt: str) -> str:
        body = prompt.split("### Instruction:\n", 1)[-1].split("\n\n###", 1)[0]
        if len(body) % 5 == 0 and body not in self.failed:
            self.failed.add(body)
            raise CallFailed("busy", 429)
        return f"echo {len(body)}"


#: Teachers by name; a name maps to a client factory. ``passthrough`` needs no client: its targets are the gold answers.
PROVIDERS: dict[str, Callable[[], Callable] | None] = {PASSTHROUGH: None, "echo": EchoTeacher}


def provider(name: str | None) -> str:
    """The registered name, whatever its case and surrounding space; passthrough where there is none."""
    found = (name or PASSTHROUGH).strip().lower()
    if found not in PROVIDERS:
        raise ValueError(f"unknown teacher provider {name!r}; known: {', '.join(PROVIDERS)}")
    return found


def generation_job(records: DataFrame, teacher: str | Callable[[], Callable], settings: JobSettings = JobSettings(), log_path: str | None = None) -> DataFrame:
    """rec_id, output, error of all records: what the log has is kept, the rest is generated, and every answer is in the log
    as soon as it is there, so that a job that broke off goes on where it was. A failed call has an empty output and its
    error, and is tried again by the next run. ``teacher`` is a registered name or a client factory."""
    make_client = PROVIDERS[provider(teacher)] if isinstance(teacher, str) else teacher
    if make_client is None:
        return records.select("rec_id", F.coalesce("output", F.lit("")).alias("output"), F.lit(None).cast("string").alias("error"))
    spark = records.sparkSession
    log = log_path or f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}"
    failed = generate_into(log, pending(records, save(read_generation_log(spark, log), "generation-log")), make_client, settings)
    done = read_generation_log(spark, log).select("rec_id", strip(filled(F.col("output"))).alias("output"))
    return merge(records, save(done, "generations")).join(failed, "rec_id", "left")


def pending(records: DataFrame, done: DataFrame) -> DataFrame:
    return records.join(done.select("rec_id"), "rec_id", "left_anti")


def merge(records: DataFrame, done: DataFrame) -> DataFrame:
    """All ids with their output, empty where there is none."""
    return records.select("rec_id").join(done.select("rec_id", "output"), "rec_id", "left").select("rec_id", F.coalesce("output", F.lit("")).alias("output"))


def distill_targets(records: DataFrame, outputs: DataFrame) -> DataFrame:
    """Records with the teacher's output as target, the gold answer where it is blank. A missing id is an error."""
    rows = records.join(outputs.select("rec_id", F.col("output").alias("_teacher"), F.lit(True).alias("_there")), "rec_id", "left")
    said = strip(filled(F.col("_teacher")))
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a record has no teacher output"))).otherwise(F.when(said != "", said).otherwise(F.col("output")))
    return rows.withColumn("output", checked).drop("_teacher", "_there")


def three_way_prompts(examples: DataFrame) -> DataFrame:
    """(example_id, question, contexts, negative) to a row a prompt kind: rag, bare, neg."""
    q = F.col("question")
    kinds = F.array(
        F.struct(F.lit("rag").alias("kind"), rag_prompt(q, F.col("contexts")).alias("prompt")),
        F.struct(F.lit("bare").alias("kind"), bare_prompt(q).alias("prompt")),
        F.struct(F.lit("neg").alias("kind"), rag_prompt(q, F.col("negative")).alias("prompt")),
    )
    return examples.select("example_id", F.explode(kinds).alias("k")).select("example_id", "k.kind", "k.prompt")


def three_way_scores(examples: DataFrame, make_scorer: Callable[[], Callable], batch_size: int = 8) -> DataFrame:
    """(batch, example_id, question, contexts, negative, labels) to rows (batch, example_id, pos, label, rag, bare, neg).
    ``make_scorer()`` is called once a partition; its scorer takes prompts and the label ids of each and returns for each
    an array of logits [position, vocabulary]. The three prompts of ``batch_size`` examples are scored in one call and
    split back, so that no logits are shuffled."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make_scorer()
        for rows in batches:
            for lo in range(0, len(rows), batch_size):
                yield _scored(score, rows.iloc[lo : lo + batch_size])

    return _asked(examples).mapInPandas(run, SOFT_LABELS)


def _asked(examples: DataFrame) -> DataFrame:
    q = F.col("question")
    prompts = (rag_prompt(q, F.col("contexts")), bare_prompt(q), rag_prompt(q, F.col("negative")))
    return examples.select(F.col("batch").cast("int").alias("batch"), F.col("example_id").cast("string").alias("example_id"), F.col("labels").cast("array<int>").alias("labels"), F.array(*prompts).alias("prompts"))


def _scored(score: Callable, part: pd.DataFrame) -> pd.DataFrame:
    """Soft labels of a few examples (batch, example_id, labels, prompts), whose prompts go into one call."""
    labels = [[int(y) for y in x] for x in part["labels"]]
    logits = score([p[k] for k in range(3) for p in part["prompts"]], labels * 3)
    n = len(part)
    out = [
        (b, e, pos, y, *(np.asarray(logits[k * n + i][pos], np.float32) for k in range(3)))
        for i, (b, e) in enumerate(zip(part["batch"], part["example_id"], strict=True))
        for pos, y in enumerate(labels[i])
    ]
    return pd.DataFrame(out, columns=["batch", "example_id", "pos", "label", "rag", "bare", "neg"])


def score_into(log: str, examples: DataFrame, make_scorer: Callable[[], Callable], batch_size: int = 8, partitions: int = 8) -> None:
    """``three_way_scores`` of the examples that the log has not, into the log: the scores of ``batch_size`` examples are
    committed together as they land. A task that is run again, or a speculative copy, scores what is left."""
    spark, run_id = examples.sparkSession, uuid.uuid4().hex
    stored = save(read_soft_labels(spark, log).select("example_id").distinct(), "stored-examples")
    rows = _asked(examples).join(stored, "example_id", "left_anti").repartition(partitions, "example_id")
    schema = pa.schema([("batch", pa.int32()), ("example_id", pa.string()), ("pos", pa.int32()), ("label", pa.int32()), *((k, pa.list_(pa.float32())) for k in ("rag", "bare", "neg"))])
    with Coordinator.of(spark, 0.0) as coordinator:
        address = coordinator.address

        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            score, part = None, TaskContext.get().partitionId()
            with address.connect() as lease:
                lease.claim(part)
                own = LabelLog(log, run_id, part)
                done = own.landed()
                for batch in batches:
                    left = batch[[x not in done for x in batch["example_id"]]]
                    score = score or (make_scorer() if len(left) else None)
                    for lo in range(0, len(left), batch_size):
                        own.add(pa.Table.from_pandas(_scored(score, left.iloc[lo : lo + batch_size]), schema, preserve_index=False))
                    yield pd.DataFrame({"n": [len(left)]})

        rows.mapInPandas(work, "n long").agg(F.sum("n")).collect()
