"""Queries on records: sources, text, curation, dedup, budgets, supervised arrays."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tributary.functions import curation as C
from tributary.functions import sft, text
from tributary.functions.budget import estimate_tokens
from tributary.operators import budget, curate, dedup, inference, supervised
from tributary.plans.pipelines import prepare_training_set as prepare
from tributary.plans.registry import query, table
from tributary.session import shared_dir
from tributary.sources import records as src
from tributary.sources.record_index import RecordIndex
from tributary.streaming import firsts, streams

_PAIR = """(
  SELECT conv_id * 100 + turn AS rec_id, text AS instruction, coalesce(sys, '') AS input, nxt AS output FROM (
    SELECT *, lead(role) OVER w AS nrole, lead(text) OVER w AS nxt, max(CASE WHEN role = 'system' THEN text END) OVER (PARTITION BY conv_id) AS sys
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE role = 'user' AND nrole = 'assistant')"""
_INSTRUCTION = "'Write a short text about item ' || CAST(doc_id AS VARCHAR) || ', please'"
_VARIANTS = f"""(
  SELECT doc_id AS rec_id, {_INSTRUCTION} AS instruction, '' AS input, CASE doc_id % 10
    WHEN 3 THEN 'I''m sorry, I cannot help. ' || text WHEN 4 THEN '### Response: ' || text WHEN 5 THEN '' WHEN 6 THEN NULL
    WHEN 7 THEN {_INSTRUCTION} || ' ' || text ELSE text END AS output FROM documents)"""
_CTRL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _cleaned(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({column}, ''), '{_CTRL}', '', 'g'), '\\s+', ' ', 'g'))"


def _key(column: str) -> str:
    return f"trim(regexp_replace(regexp_replace(replace(lower({column}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant's answer; a system turn is the input."""
    conv = table(spark, sf_dir, "conversations")
    turn, whole = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    rows = conv.withColumns({"nrole": F.lead("role").over(turn), "nxt": F.lead("text").over(turn), "sys": F.max(F.when(F.col("role") == "system", F.col("text"))).over(whole)})
    rows = rows.where("role = 'user' and nrole = 'assistant'")
    return rows.select((F.col("conv_id") * 100 + F.col("turn")).alias("rec_id"), F.col("text").alias("instruction"), F.coalesce("sys", F.lit("")).alias("input"), F.col("nxt").alias("output"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as outputs, some of them turned into refusals, leaks, empty and missing ones."""
    docs = table(spark, sf_dir, "documents")
    asked = F.concat(F.lit("Write a short text about item "), F.col("doc_id").cast("string"), F.lit(", please"))
    kind, said = F.col("doc_id") % 10, F.col("text")
    output = (
        F.when(kind == 3, F.concat(F.lit("I'm sorry, I cannot help. "), said)).when(kind == 4, F.concat(F.lit("### Response: "), said)).when(kind == 5, "")
        .when(kind == 6, F.lit(None)).when(kind == 7, F.concat(asked, F.lit(" "), said)).otherwise(said)
    )
    return docs.select(F.col("doc_id").alias("rec_id"), asked.alias("instruction"), F.lit("").alias("input"), output.alias("output"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the text is the output and, for dedup, the key."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("rec_id"), F.lit("").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"))


def _arriving(records: DataFrame, folder: str) -> DataFrame:
    """The records as a stream: dealt into files by a hash of the id, a quarter of the files a batch."""
    spark = records.sparkSession
    records.withColumn("arrival", F.pmod(F.xxhash64("rec_id"), F.lit(4))).write.partitionBy("arrival").parquet(folder)
    files = len(spark.read.parquet(folder).inputFiles())
    return spark.readStream.schema(records.schema).option("maxFilesPerTrigger", max(1, -(-files // 4))).option("recursiveFileLookup", True).parquet(folder)


# Sources and mapping


@query("normalize_records", "SELECT doc_id AS rec_id, trim(lang) AS instruction, CASE WHEN n_chars = 0 THEN '' ELSE CAST(n_chars AS VARCHAR) END AS input, '' AS output FROM documents")
def normalize_records(spark, sf_dir):
    return src.normalize(table(spark, sf_dir, "documents"), instruction="lang", given="n_chars", output="answer", rec_id="doc_id")


@query("load_instructions", f"SELECT rec_id, trim(instruction) AS instruction, trim(input) AS input, trim(output) AS output FROM {_VARIANTS} WHERE trim(coalesce(output, '')) <> ''")
def load_instructions(spark, sf_dir):
    return src.load_instructions(variants(spark, sf_dir))


@query("train_eval_split", f"SELECT rec_id, CASE WHEN row_number() OVER (ORDER BY rec_id) <= greatest(1, least(200, greatest(1, (SELECT count(*) FROM {_PAIR}) // 5))) THEN 'eval' ELSE 'train' END AS split FROM {_PAIR}")
def train_eval_split(spark, sf_dir):
    return src.train_eval_split(pairs(spark, sf_dir), 200).select("rec_id", "split")


@query("source_slice", "SELECT doc_id, lang, text FROM documents ORDER BY doc_id LIMIT 100")
def source_slice(spark, sf_dir):
    return src.source_slice(table(spark, sf_dir, "documents"), 100, "doc_id").select("doc_id", "lang", "text")


@query("read_generation_log", f"""
SELECT rec_id, CASE WHEN rec_id % 5 = 0 THEN 'second ' || output ELSE output END AS output FROM {_PAIR} WHERE rec_id % 7 <> 0""")
def read_generation_log(spark, sf_dir):
    """A log with torn, blank and repeated lines, made of all records."""
    rows = pairs(spark, sf_dir)
    line = lambda out: F.to_json(F.struct(F.col("rec_id").cast("string").alias("index"), out.alias("output")))
    whole = line(F.col("output"))
    kinds = F.when(F.col("rec_id") % 7 == 0, F.array(F.substring(whole, 1, 15), F.lit(""))).when(F.col("rec_id") % 5 == 0, F.array(whole, line(F.concat(F.lit("second "), F.col("output"))))).otherwise(F.array(whole))
    lines = rows.select("rec_id", F.posexplode(kinds).alias("n", "value")).select((F.col("rec_id") * 10 + F.col("n")).alias("line_no"), "value")
    return src.parse_generation_log(lines)


@query("pending_generations", f"SELECT rec_id FROM {_PAIR} WHERE rec_id % 3 = 0")
def pending_generations(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return inference.pending(rows, rows.where("rec_id % 3 <> 0")).select("rec_id")


@query("merge_generations", f"SELECT rec_id, CASE WHEN rec_id % 3 <> 0 THEN output ELSE '' END AS output FROM {_PAIR}")
def merge_generations(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    return inference.merge(rows, rows.where("rec_id % 3 <> 0"))


@query("distill_targets", f"SELECT rec_id, instruction, input, CASE WHEN rec_id % 4 = 0 THEN output ELSE 'Teacher: ' || trim(output) END AS output FROM {_PAIR}")
def distill_targets(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    said = rows.select("rec_id", F.when(F.col("rec_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" Teacher: "), F.col("output"))).alias("output"))
    return inference.distill_targets(rows, said)


@query("generate_targets", f"""SELECT rec_id, CASE WHEN rec_id % 4 = 0 THEN 'logged ' || output ELSE 'echo ' || CAST(length(trim(instruction)) AS VARCHAR) END AS output, CAST(NULL AS VARCHAR) AS error FROM {_PAIR}""")
def generate_targets(spark, sf_dir):
    """A job that goes on from a log that has a quarter of the records."""
    rows, log = pairs(spark, sf_dir), f"{shared_dir(spark)}/generations-{uuid4().hex}"
    src.append_generations(rows.where("rec_id % 4 = 0").select("rec_id", F.concat(F.lit("logged "), F.col("output")).alias("output")), log)
    return inference.generation_job(rows, "echo", inference.JobSettings(base_delay=0.0, requests_per_second=0), log)


# Text


@query("clean_text", f"SELECT doc_id, {_cleaned('text')} AS cleaned FROM documents")
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@query("canonical_key", f"SELECT rec_id, {_key("instruction || ' ' || input")} AS key FROM {_PAIR}")
def canonical_key(spark, sf_dir):
    return dedup.with_key(pairs(spark, sf_dir)).select("rec_id", "key")


@query("fingerprint", f"SELECT doc_id, md5({_key('text')}) AS fingerprint FROM documents")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.fingerprint(F.col("text")).alias("fingerprint"))


@query("passage_id", "SELECT doc_id, left(sha256(text), 32) AS id FROM documents")
def passage_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.passage_id(F.col("text")).alias("id"))


_SHINGLES = "list_distinct(list_transform(range(1, greatest(length({0}) - 4, 1) + 1), lambda i: substring({0}, i, 5)))"


@query("shingle_stats", f"SELECT rec_id, CAST(CASE WHEN key = '' THEN 0 ELSE len({_SHINGLES.format('key')}) END AS INTEGER) AS n FROM (SELECT rec_id, {_key("instruction || ' ' || input")} AS key FROM {_PAIR})")
def shingle_stats(spark, sf_dir):
    return dedup.shingle_sets(dedup.with_key(pairs(spark, sf_dir))).select("rec_id", "n")


_ALPACA = f"""CASE WHEN trim(input) <> ''
  THEN '{text.ALPACA_INPUT}' || chr(10) || chr(10) || '### Instruction:' || chr(10) || trim(instruction) || chr(10) || chr(10) || '### Input:' || chr(10) || trim(input) || chr(10) || chr(10) || '### Response:' || chr(10)
  ELSE '{text.ALPACA_PLAIN}' || chr(10) || chr(10) || '### Instruction:' || chr(10) || trim(instruction) || chr(10) || chr(10) || '### Response:' || chr(10) END"""


@query("build_prompt", f"SELECT rec_id, {_ALPACA} AS prompt FROM {_PAIR}")
def build_prompt(spark, sf_dir):
    return pairs(spark, sf_dir).select("rec_id", text.build_prompt(F.col("instruction"), F.col("input")).alias("prompt"))


@query("to_messages", f"SELECT rec_id, 'user' AS role, trim(instruction) || CASE WHEN trim(input) <> '' THEN chr(10) || chr(10) || trim(input) ELSE '' END AS content FROM {_PAIR}")
def to_messages(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("rec_id", F.explode(text.to_messages(F.col("instruction"), F.col("input"))).alias("m"))
    return rows.select("rec_id", "m.role", "m.content")


_QA = r"array_to_string(list_filter(string_split_regex(regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"


@query("qa_normalize", f"SELECT doc_id, {_QA.format('text')} AS normal FROM documents")
def qa_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.qa_normalize(F.col("text")).alias("normal"))


# The gate

_GATE = f"""
WITH r AS (SELECT rec_id, instruction, output, {_cleaned('output')} AS t FROM {{records}}),
w AS (SELECT rec_id, t, CASE WHEN t = '' THEN [] ELSE string_split(t, ' ') END AS w FROM r),
g AS (SELECT rec_id, t, w, list_transform(range(1, greatest(len(w) - 2, 0) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) AS g FROM w),
x AS (SELECT rec_id, lower(unnest(w)) AS x, generate_subscripts(w, 1) AS i FROM w),
runs AS (SELECT rec_id, max(n) AS run FROM (SELECT rec_id, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY rec_id, x ORDER BY i) AS k FROM x) GROUP BY rec_id, x, k) GROUP BY rec_id),
m AS (
  SELECT r.rec_id, r.instruction, r.output, r.t, CAST(len(g.w) AS INTEGER) AS words, CAST(coalesce(runs.run, 0) AS INTEGER) AS run,
    CASE WHEN len(g.w) <= 3 THEN 0.0 ELSE 1 - CAST(len(list_distinct(g.g)) AS DOUBLE) / len(g.g) END AS ratio,
    regexp_replace(lower(left(r.t, 160)), '^["''` \\t\\n*-]+', '') AS head, lower(r.t) AS low, lower(trim(r.instruction)) AS asked
  FROM r JOIN g USING (rec_id) LEFT JOIN runs USING (rec_id)
),
f AS (
  SELECT *, run >= 5 OR ratio > 0.55 AS degenerate, {{refusal}} AS refusal,
    {{marks}} OR (length(asked) >= 20 AND starts_with(low, left(asked, CAST(greatest(20, floor(length(asked) * 0.9)) AS BIGINT)))) AS leak,
    words >= 12 AND NOT contains({{ends}}, right(t, 1)) AS truncated
  FROM m
)
"""
_sq = lambda s: "'" + s.replace("'", "''") + "'"
_PARTS = {
    "refusal": "(" + " OR ".join(f"starts_with(head, {_sq(p)}) OR contains(left(head, 80), {_sq(' ' + p)})" for p in C.REFUSALS) + ")",
    "marks": "(" + " OR ".join(f"contains(low, {_sq(p)})" for p in C.TEMPLATE_MARKS) + ")",
    "ends": _sq(C.SENTENCE_ENDS),
}


def _gate(records: str, select: str) -> str:
    out = _GATE.replace("{records}", records)
    for k, v in _PARTS.items():
        out = out.replace("{" + k + "}", v)
    return out + select


_REASON = """CASE WHEN output IS NULL THEN 'non_text' WHEN t = '' THEN 'empty' WHEN length(t) < 8 THEN 'too_short' WHEN degenerate THEN 'degenerate_repetition'
  WHEN refusal THEN 'refusal' WHEN leak THEN 'prompt_leak' WHEN truncated THEN 'truncated' END"""


@query("ngram_repeat_ratio", _gate(_VARIANTS, "SELECT rec_id, round(ratio, 6) AS ratio FROM f"))
def ngram_repeat_ratio(spark, sf_dir):
    found = C.cleaned_signals(F.col("output"))
    return variants(spark, sf_dir).select("rec_id", F.round(found["ratio"], 6).alias("ratio"))


def curate_input(spark, sf_dir):
    rows = variants(spark, sf_dir)
    return rows.withColumn("t", text.clean(F.col("output")))


@query("max_consecutive_repeats", _gate(_VARIANTS, "SELECT rec_id, run FROM f"))
def max_consecutive_repeats(spark, sf_dir):
    return curate_input(spark, sf_dir).select("rec_id", C.longest_run(F.col("t")).alias("run"))


@query("is_degenerate", _gate(_VARIANTS, "SELECT rec_id, degenerate FROM f"))
def is_degenerate(spark, sf_dir):
    return curate_input(spark, sf_dir).select("rec_id", C.is_degenerate(F.col("t")).alias("degenerate"))


@query("is_refusal", _gate(_VARIANTS, "SELECT rec_id, refusal FROM f"))
def is_refusal(spark, sf_dir):
    return curate_input(spark, sf_dir).select("rec_id", C.is_refusal(F.col("t")).alias("refusal"))


@query("leaks_prompt", _gate(_VARIANTS, "SELECT rec_id, leak FROM f"))
def leaks_prompt(spark, sf_dir):
    return curate_input(spark, sf_dir).select("rec_id", C.leaks_prompt(F.col("t"), F.col("instruction")).alias("leak"))


@query("looks_truncated", _gate(_VARIANTS, "SELECT rec_id, truncated FROM f"))
def looks_truncated(spark, sf_dir):
    return curate_input(spark, sf_dir).select("rec_id", C.looks_truncated(F.col("t")).alias("truncated"))


@query("classify_records", _gate(_VARIANTS, f"SELECT rec_id, {_REASON} AS reason FROM f"))
def classify_records(spark, sf_dir):
    return curate.classify(variants(spark, sf_dir)).select("rec_id", "reason")


@query("curate_records", _gate(_VARIANTS, f"SELECT rec_id, t AS output FROM f WHERE {_REASON} IS NULL"))
def curate_records(spark, sf_dir):
    return curate.curate(variants(spark, sf_dir)).select("rec_id", "output")


_REPORT = """, c AS (SELECT coalesce({0}, 'kept') AS outcome FROM f)
SELECT outcome, count(*) AS n, CAST(NULL AS DOUBLE) AS keep_rate FROM c GROUP BY outcome
UNION ALL SELECT 'total', count(*), round(CAST(count(*) FILTER (outcome = 'kept') AS DOUBLE) / count(*), 4) FROM c"""


@query("curation_report", _gate(_VARIANTS, _REPORT.format(_REASON)))
def curation_report(spark, sf_dir):
    return curate.report(curate.classify(variants(spark, sf_dir)))


@query("stream_curation_report", _gate(_VARIANTS, _REPORT.format(_REASON)))
def stream_curation_report(spark, sf_dir):
    """The same report, kept up to date while the records arrive."""
    folder = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    stream = _arriving(variants(spark, sf_dir), f"{folder}/in")
    streams.report_stream(stream, f"{folder}/report", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.read_report(spark, f"{folder}/report")


_RELAXED = """CASE WHEN output IS NULL THEN 'non_text' WHEN t = '' THEN 'empty' WHEN length(t) < 4 THEN 'too_short' WHEN run >= 9 OR ratio > 0.8 THEN 'degenerate_repetition' WHEN leak THEN 'prompt_leak' END"""


@query("curation_relaxed", _gate(_VARIANTS, _REPORT.format(_RELAXED)))
def curation_relaxed(spark, sf_dir):
    t = C.Thresholds(max_repeat_ratio=0.8, max_run=9, min_chars=4, drop_refusals=False, drop_truncated=False)
    return curate.report(curate.classify(variants(spark, sf_dir), t))


# Dedup

_KEYS = f"k AS (SELECT doc_id AS rec_id, {_key('text')} AS key FROM documents)"
_SETS = f"s AS (SELECT rec_id, {_SHINGLES.format('key')} AS s FROM k WHERE key <> '')"
_PREFIX = """, h AS (SELECT rec_id, len(s) AS n, unnest(s) AS g FROM s), df AS (SELECT g, count(*) AS df FROM h GROUP BY g),
p AS (SELECT rec_id, n, g FROM (SELECT h.*, row_number() OVER (PARTITION BY rec_id ORDER BY df, h.g) AS r FROM h JOIN df USING (g)) WHERE r <= n - ceil(0.85 * n - 1e-9) + 1)"""
_NEAR = f"""WITH RECURSIVE {_KEYS}, {_SETS}{_PREFIX},
cand AS (SELECT DISTINCT x.rec_id AS a, y.rec_id AS b FROM p x JOIN p y ON x.g = y.g AND x.rec_id < y.rec_id AND least(x.n, y.n) >= 0.85 * greatest(x.n, y.n) - 1e-9),
pairs AS (
  SELECT a, b, i / (na + nb - i) AS similarity FROM (
    SELECT a, b, CAST(len(list_intersect(x.s, y.s)) AS DOUBLE) AS i, len(x.s) AS na, len(y.s) AS nb FROM cand JOIN s x ON x.rec_id = a JOIN s y ON y.rec_id = b
  ) WHERE i / (na + nb - i) >= 0.85)
"""


def keyed_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), "text")
    return dedup.spread(docs).select("rec_id", dedup.key_of().alias("key"))


@query("jaccard_pairs", f"""WITH k AS (SELECT rec_id, {_key('instruction')} AS a, {_key('output')} AS b FROM {_PAIR}),
s AS (SELECT rec_id, list_distinct(string_split(a, ' ')) AS a, list_distinct(string_split(b, ' ')) AS b FROM k)
SELECT rec_id, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS similarity FROM s""")
def jaccard_pairs(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    words = lambda c: F.array_distinct(F.split(text.canonical(F.col(c)), " "))
    return rows.select("rec_id", F.round(dedup.jaccard(words("instruction"), words("output")), 6).alias("similarity"))


@query("exact_dedup", f"SELECT min(rec_id) AS rec_id FROM (SELECT doc_id AS rec_id, {_key('text')} AS key FROM documents) GROUP BY key")
def exact_dedup(spark, sf_dir):
    return dedup.exact_dedup(keyed_texts(spark, sf_dir)).select("rec_id")


@query("stream_exact_dedup", f"SELECT min(rec_id) AS rec_id FROM (SELECT doc_id AS rec_id, {_key('text')} AS key FROM documents) GROUP BY key")
def stream_exact_dedup(spark, sf_dir):
    """The same from a stream in which the records arrive in four batches and in no order."""
    spark.conf.set(*firsts.STATE_STORE)
    spark.conf.set(*firsts.CHANGELOG)
    folder = f"{shared_dir(spark)}/stream-{uuid4().hex}"
    stream = _arriving(texts(spark, sf_dir), f"{folder}/in")
    keyed = stream.select("rec_id", text.key_digest(F.col("output")).alias("key"))  # texts stay behind
    changes = firsts.first_changes(keyed, F.col("key")).select("rec_id", "fingerprint", "replaces")
    sink = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    sink.trigger(availableNow=True).start().awaitTermination()
    return firsts.current_firsts(spark.read.schema(changes.schema).parquet(f"{folder}/out"))


@query("near_dup_pairs", _NEAR + "SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def near_dup_pairs(spark, sf_dir):
    return dedup.similar_pairs(keyed_texts(spark, sf_dir).where("key <> ''")).select("a", "b", F.round("similarity", 6).alias("similarity"))


_NEAR_DEDUP = _NEAR + """, v AS (SELECT DISTINCT b AS id FROM pairs), o AS (SELECT id, row_number() OVER (ORDER BY id) AS r FROM v),
nb AS (SELECT o.r, o.id, list(a) AS smaller FROM o JOIN pairs ON b = o.id GROUP BY ALL),
walk AS (SELECT CAST(0 AS BIGINT) AS r, CAST([] AS BIGINT[]) AS gone
  UNION ALL SELECT nb.r, CASE WHEN len(list_filter(nb.smaller, lambda x: NOT list_contains(walk.gone, x))) > 0 THEN list_append(walk.gone, nb.id) ELSE walk.gone END FROM walk JOIN nb ON nb.r = walk.r + 1)
SELECT rec_id FROM k WHERE NOT list_contains((SELECT gone FROM walk ORDER BY r DESC LIMIT 1), rec_id)"""


@query("near_dedup", _NEAR_DEDUP)
def near_dedup(spark, sf_dir):
    return dedup.near_dedup(keyed_texts(spark, sf_dir)).select("rec_id")


@query("near_dedup_batches", _NEAR_DEDUP)
def near_dedup_batches(spark, sf_dir):
    """Three batches by ranges of ids, one after the other, into an index: what one run over all keeps."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").alias("rec_id"), dedup.key_of().alias("key"))  # the index deals them out
    index = RecordIndex(spark, f"{shared_dir(spark)}/record-index-{uuid4().hex}")
    low, high = table(spark, sf_dir, "documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is None:
        return texts.select("rec_id")
    at = [low, low + (high - low) // 2, low + 9 * (high - low) // 10, high + 1]
    for number in range(3):
        index.add(texts.where((F.col("rec_id") >= at[number]) & (F.col("rec_id") < at[number + 1])), str(number))
        index.vacuum()  # nobody else has this index
    return index.kept().select("rec_id")


@query("decontaminate", f"""WITH k AS (SELECT rec_id, {_key('t')} AS key FROM (SELECT doc_id AS rec_id, text AS t FROM documents UNION ALL SELECT 1000000000 + item_id, text || ' again' FROM benchmark)),
e AS (SELECT {_key('text')} AS key FROM benchmark), s AS (SELECT rec_id, key, {_SHINGLES.format('key')} AS s FROM k WHERE key <> ''), es AS (SELECT {_SHINGLES.format('key')} AS s FROM e WHERE key <> ''),
near AS (SELECT DISTINCT rec_id FROM s JOIN es ON least(len(s.s), len(es.s)) >= 0.85 * greatest(len(s.s), len(es.s))
  AND CAST(len(list_intersect(s.s, es.s)) AS DOUBLE) / (len(s.s) + len(es.s) - len(list_intersect(s.s, es.s))) >= 0.85)
SELECT rec_id FROM k WHERE key NOT IN (SELECT key FROM e) AND rec_id NOT IN (SELECT rec_id FROM near)""")
def decontaminate(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark")
    leaked = bench.select((F.col("item_id") + 1_000_000_000).alias("rec_id"), text.canonical(F.concat("text", F.lit(" again"))).alias("key"))
    evaluation = bench.select(F.col("item_id").alias("rec_id"), dedup.key_of().alias("key"))
    return dedup.decontaminate(keyed_texts(spark, sf_dir).unionByName(leaked), evaluation).select("rec_id")


@query("distinct_contexts", "SELECT text AS context, min(doc_id) AS first_seen FROM documents GROUP BY text")
def distinct_contexts(spark, sf_dir):
    return dedup.distinct_contexts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("text").alias("context")))


# Budget


def _tokens(c: str) -> str:
    return (
        f"CASE WHEN length({c}) = 0 THEN 0 WHEN CAST(length({c}) - length(replace({c}, ' ', '')) AS DOUBLE) / length({c}) < 0.02 THEN length({c}) "
        f"ELSE greatest(1, CAST(round_even(CAST(length({c}) / 4.0 AS DOUBLE), 0) AS INTEGER)) END"
    )


_LENGTHS = f"(SELECT rec_id, CAST({_tokens('instruction')} + {_tokens('input')} + {_tokens('output')} AS BIGINT) AS n_tokens FROM {_PAIR})"


@query("estimate_tokens", f"SELECT doc_id, CAST({_tokens('text')} AS INTEGER) AS n_tokens FROM documents")
def est_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("n_tokens"))


@query("record_lengths", f"SELECT * FROM {_LENGTHS}")
def record_lengths(spark, sf_dir):
    return budget.record_lengths(pairs(spark, sf_dir))


@query("length_stats", f"""WITH l AS {_LENGTHS}, r AS (SELECT n_tokens, row_number() OVER (ORDER BY n_tokens) - 1 AS i, count(*) OVER () AS c FROM l)
SELECT count(*) AS count, CAST(sum(n_tokens) AS BIGINT) AS total, avg(n_tokens) AS mean,
  min(n_tokens) FILTER (i = CAST(round_even(CAST(0.5 * (c - 1) AS DOUBLE), 0) AS BIGINT)) AS p50, min(n_tokens) FILTER (i = CAST(round_even(CAST(0.95 * (c - 1) AS DOUBLE), 0) AS BIGINT)) AS p95,
  max(n_tokens) AS max, count(*) FILTER (n_tokens > 1024) AS over_limit FROM r""")
def length_stats(spark, sf_dir):
    return budget.length_stats(budget.record_lengths(pairs(spark, sf_dir)))


@query("teacher_cost", f"""SELECT n, n * p AS input_tokens, n * 256 AS output_tokens, n * p + n * 256 AS total_tokens, round(n * p / 1000.0 * 0.5 + n * 256 / 1000.0 * 1.5, 4) AS estimated_cost
FROM (SELECT count(*) AS n, CAST(floor(avg({_tokens('instruction')})) AS BIGINT) AS p FROM {_PAIR})""")
def teacher_cost(spark, sf_dir):
    return budget.teacher_cost(pairs(spark, sf_dir), 256, 0.5, 1.5)


@query("bucket_by_length", f"SELECT rec_id, (row_number() OVER (ORDER BY n_tokens, rec_id) - 1) // 8 AS batch FROM {_LENGTHS}")
def bucket_by_length(spark, sf_dir):
    return budget.bucket_by_length(budget.record_lengths(pairs(spark, sf_dir)), 8).select("rec_id", "batch")


_WASTE = "SELECT '{0}' AS batching, round(1 - sum(s) / sum(m * c), 6) AS waste FROM (SELECT b, max(n_tokens) AS m, count(*) AS c, CAST(sum(n_tokens) AS DOUBLE) AS s FROM (SELECT n_tokens, (row_number() OVER (ORDER BY {1}) - 1) // 8 AS b FROM {2}) GROUP BY b)"


@query("padding_waste", _WASTE.format("sequential", "rec_id", _LENGTHS) + " UNION ALL " + _WASTE.format("bucketed", "n_tokens, rec_id", _LENGTHS))
def padding_waste(spark, sf_dir):
    lengths = dedup.save(budget.record_lengths(pairs(spark, sf_dir)), "lengths")
    row = lambda name, b: budget.padding_waste(b).select(F.lit(name).alias("batching"), F.round("waste", 6).alias("waste"))
    return row("sequential", budget.sequential_batches(lengths, 8)).unionByName(row("bucketed", budget.bucket_by_length(lengths, 8)))


# Supervised arrays: characters stand for token ids

_IDS = "list_transform(string_split({0}, ''), lambda c: CAST(unicode(c) AS INTEGER))"
_SFT = f"(SELECT rec_id, {_IDS.format('instruction')} AS p, {_IDS.format('output')} AS r FROM {_PAIR})"


def code_points(column: str):
    """All characters of a text as numbers."""
    return F.transform(F.filter(F.split(column, ""), lambda c: c != ""), lambda c: F.ascii(c))


def token_rows(spark, sf_dir):
    return pairs(spark, sf_dir).select("rec_id", code_points("instruction").alias("p"), code_points("output").alias("r"))


@query("tokenize_records", f"""SELECT rec_id, array_to_string(list_slice(list_concat(p, r, [2]), 1, 1024), ' ') AS input_ids,
  array_to_string(list_slice(list_concat(list_transform(p, lambda x: -100), r, [2]), 1, 1024), ' ') AS labels, CAST(least(len(p) + len(r) + 1, 1024) AS INTEGER) AS attended
FROM (SELECT rec_id, {_IDS.format('prompt')} AS p, {_IDS.format('output')} AS r FROM (SELECT rec_id, output, {_ALPACA} AS prompt FROM {_PAIR}))""")
def tokenize_records(spark, sf_dir):
    """Whole prompts and outputs; characters stand for the user's tokenizer."""
    rows = supervised.tokenize_records(pairs(spark, sf_dir), lambda: lambda texts: [[ord(c) for c in t] for t in texts], 2, 1024)
    joined = {c: F.array_join(c, " ") for c in ("input_ids", "labels")}
    return rows.select("rec_id", *(x.alias(c) for c, x in joined.items()), F.size("attention_mask").alias("attended"))


@query("supervised_labels", f"""SELECT rec_id, array_to_string(list_slice(list_concat(p, r, [2]), 1, 256), ' ') AS input_ids,
  array_to_string(list_slice(list_concat(list_transform(p, lambda x: -100), r, [2]), 1, 256), ' ') AS labels, len(p) < 256 AS trainable FROM {_SFT}""")
def supervised_labels(spark, sf_dir):
    ids, labels, _ = sft.supervised(F.col("p"), F.col("r"), 2, 256)
    return token_rows(spark, sf_dir).select("rec_id", F.array_join(ids, " ").alias("input_ids"), F.array_join(labels, " ").alias("labels"), sft.is_trainable(labels).alias("trainable"))


_PADDED = "list_slice(list_concat(r, list_transform(range(64), lambda x: 0)), 1, 64)"


@query("pad_labels", f"SELECT rec_id, array_to_string({_PADDED}, ' ') AS ids, array_to_string(list_transform({_PADDED}, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS labels, CAST(least(len(r), 64) AS INTEGER) AS attended FROM {_SFT}")
def pad_labels(spark, sf_dir):
    r = F.col("r")
    mask = F.aggregate(sft.attention(r, 64), F.lit(0), lambda a, x: a + x)
    return token_rows(spark, sf_dir).select("rec_id", F.array_join(sft.pad(r, 64, 0), " ").alias("ids"), F.array_join(sft.padded_labels(r, 64, 0), " ").alias("labels"), mask.alias("attended"))


@query("shift_right", f"SELECT rec_id, array_to_string(list_concat([0], list_slice({_PADDED}, 1, 63)), ' ') AS decoder_ids FROM {_SFT}")
def shift_right(spark, sf_dir):
    return token_rows(spark, sf_dir).select("rec_id", F.array_join(sft.shift_right(sft.padded_labels(F.col("r"), 64, 0), 0), " ").alias("decoder_ids"))


# The pipeline


_TRAIN = "(SELECT doc_id AS rec_id, text AS instruction, '' AS input, 'Answer: ' || text AS output FROM documents)"
_PREPARED = (
    _gate(_TRAIN, f", cur AS (SELECT rec_id, instruction, t, {_key("coalesce(instruction, '')")} AS key FROM f WHERE {_REASON} IS NULL), ").replace("WITH", "WITH RECURSIVE", 1)
    + _NEAR_DEDUP.replace(f"WITH RECURSIVE {_KEYS}", "k AS (SELECT rec_id, key FROM cur)", 1).replace("SELECT rec_id FROM k WHERE", ", nd AS (SELECT * FROM cur WHERE", 1)
    + f"""), e AS (SELECT {_key('text')} AS key FROM benchmark), es AS (SELECT {_SHINGLES.format('key')} AS s FROM e WHERE key <> ''),
leaked AS (SELECT DISTINCT rec_id FROM s JOIN es ON least(len(s.s), len(es.s)) >= 0.85 * greatest(len(s.s), len(es.s))
  AND CAST(len(list_intersect(s.s, es.s)) AS DOUBLE) / (len(s.s) + len(es.s) - len(list_intersect(s.s, es.s))) >= 0.85),
dc AS (SELECT * FROM nd WHERE key NOT IN (SELECT key FROM e) AND rec_id NOT IN (SELECT rec_id FROM leaked)),
l AS (
  SELECT 0 AS stage_no, {_tokens("coalesce(instruction, '')")} + {_tokens("coalesce(output, '')")} AS n_tokens FROM {_TRAIN}
  UNION ALL SELECT 1, {_tokens('instruction')} + {_tokens('t')} FROM cur UNION ALL SELECT 2, {_tokens('instruction')} + {_tokens('t')} FROM nd
  UNION ALL SELECT 3, {_tokens('instruction')} + {_tokens('t')} FROM dc),
i AS (SELECT stage_no, n_tokens, row_number() OVER (PARTITION BY stage_no ORDER BY n_tokens) - 1 AS i, count(*) OVER (PARTITION BY stage_no) AS c FROM l),
st AS (SELECT stage_no, count(*) AS n, max(n_tokens) AS max,
  min(n_tokens) FILTER (i = CAST(round_even(CAST(0.5 * (c - 1) AS DOUBLE), 0) AS BIGINT)) AS p50, min(n_tokens) FILTER (i = CAST(round_even(CAST(0.95 * (c - 1) AS DOUBLE), 0) AS BIGINT)) AS p95
  FROM i GROUP BY stage_no)
SELECT CAST(stage_no AS INTEGER) AS stage_no, ['input', 'curated', 'deduplicated', 'decontaminated'][stage_no + 1] AS stage, n, coalesce(lag(n) OVER (ORDER BY stage_no) - n, 0) AS removed,
  CAST(p50 AS BIGINT) AS p50, CAST(p95 AS BIGINT) AS p95, CAST(max AS BIGINT) AS max FROM st"""
)


@query("prepare_training_set", _PREPARED)
def prepare_training_set(spark, sf_dir):
    """Stage report over all documents as teacher outputs, each its own instruction, against the benchmark."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("rec_id"), F.col("text").alias("instruction"), F.lit("").alias("input"), F.col("text").alias("output"))
    train = docs.withColumn("output", F.concat(F.lit("Answer: "), F.col("output")))
    bench = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("rec_id"), F.col("text").alias("instruction"), F.lit("").alias("input"), F.lit("").alias("output"))
    return prepare(train, bench)[1]
