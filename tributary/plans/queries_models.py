"""Queries on passages, vectors, soft labels, curricula and predictions."""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import metrics, text
from tributary.operators import ann, curriculum, evaluate, inference, retrieval
from tributary.operators import softlabels as soft
from tributary.plans.pipelines import build_passage_index as build_index
from tributary.plans.pipelines import soft_label_job as run_soft_labels
from tributary.plans.queries_records import _PAIR, _QA, pairs
from tributary.plans.registry import query, table
from tributary.session import save, shared_dir
from tributary.sources import records as src
from tributary.sources import vector_store

# Passages and retrieval

_CHUNKS = """(SELECT doc_id AS source_id, CAST(i / 224 AS INTEGER) AS chunk_no, array_to_string(list_slice(w, i + 1, i + 256), ' ') AS chunk FROM (
  SELECT doc_id, w, unnest(range(0, greatest(len(w) - 32, 1), 224)) AS i FROM (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 0))"""


def passages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), "text")


@query("chunk_passages", f"SELECT source_id, chunk_no, chunk FROM {_CHUNKS}")
def chunk_passages(spark, sf_dir):
    return retrieval.chunk_passages(passages(spark, sf_dir))


@query("chunks_to_embed", f"SELECT source_id, chunk_no, left(sha256(chunk), 32) AS id FROM {_CHUNKS} WHERE left(sha256(chunk), 32) NOT IN (SELECT left(sha256(chunk), 32) FROM {_CHUNKS} WHERE source_id % 2 = 0)")
def chunks_to_embed(spark, sf_dir):
    chunks = retrieval.chunk_passages(passages(spark, sf_dir))
    stored = chunks.where("source_id % 2 = 0").select(text.passage_id(F.col("chunk")).alias("id"))
    return retrieval.not_stored(chunks, stored).select("source_id", "chunk_no", "id")


@query("embed_texts")
def embed_texts(spark, sf_dir):
    rows = retrieval.embed(table(spark, sf_dir, "documents"), "text")
    return rows.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query("vector_upsert", """WITH p AS (SELECT text AS document, doc_id AS o, CASE doc_id % 3 WHEN 0 THEN '_=1' WHEN 1 THEN 'idx=' || doc_id ELSE 'lang=' || lang END AS m FROM documents),
n AS (SELECT left(sha256(document), 32) AS id, m, row_number() OVER (PARTITION BY left(sha256(document), 32) ORDER BY o DESC) AS r FROM p)
SELECT id, m AS metadata FROM n WHERE r = 1""")
def vector_upsert(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    empty, kind = F.create_map().cast("map<string,string>"), F.col("doc_id") % 3
    meta = F.when(kind == 0, empty).when(kind == 2, F.create_map(F.lit("lang"), F.col("lang")))
    rows = docs.select(F.col("text").alias("document"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), meta.alias("metadata"), F.col("doc_id").alias("ordinal"))
    half = retrieval.upsert(None, rows.where("doc_id % 2 = 0"))
    store = retrieval.upsert(half, rows)
    return store.select("id", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@query("vector_store_upsert", """WITH p AS (SELECT text AS document, doc_id AS o, CASE WHEN doc_id % 2 = 0 THEN 0 WHEN doc_id % 100 = 1 THEN 1 ELSE 2 END AS batch FROM documents),
n AS (SELECT left(sha256(document), 32) AS id, 'idx=' || o AS m, row_number() OVER (PARTITION BY left(sha256(document), 32) ORDER BY batch DESC, o DESC) AS r FROM p)
SELECT id, m AS metadata FROM n WHERE r = 1""")
def vector_store_upsert(spark, sf_dir):
    """A store on disk after three upserts: half of the documents, one in a hundred, the rest."""
    store = vector_store.VectorStore(spark, f"{shared_dir(spark)}/vectors-{uuid4().hex}", buckets=64)
    rows = table(spark, sf_dir, "documents").select(
        F.col("text").alias("document"), F.array(F.lit(1.0)).cast("array<float>").alias("embedding"), F.lit(None).cast("map<string,string>").alias("metadata"), F.col("doc_id").alias("ordinal")
    )
    few = F.col("ordinal") % 100 == 1
    for part in (F.col("ordinal") % 2 == 0, few, (F.col("ordinal") % 2 == 1) & ~few):
        store.upsert(rows.where(part))
    return store.read().select("id", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("metadata"))


@query("collection_size", f"SELECT count(DISTINCT chunk) AS n FROM {_CHUNKS}")
def collection_size(spark, sf_dir):
    chunks = retrieval.chunk_passages(passages(spark, sf_dir))
    return chunks.agg(F.count_distinct(text.passage_id(F.col("chunk"))).alias("n"))


def vectors(spark, sf_dir):
    """Queries: every row whose id is divisible by 20; the corpus: all rows."""
    rows = table(spark, sf_dir, "embeddings")
    corpus = rows.select(F.col("vec_id").alias("doc_id"), "embedding")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), corpus


_TOP = """(SELECT query_id, CAST(r AS INTEGER) AS rank, doc_id, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS r FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, 1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE r <= 3)"""


@query("topk_cosine", f"SELECT query_id, rank, doc_id, round(d, 6) AS distance FROM {_TOP}")
def topk_cosine(spark, sf_dir):
    q, corpus = vectors(spark, sf_dir)
    return retrieval.cosine_top_k(q, corpus, 3, exclude_self=True).withColumn("distance", F.round("distance", 6))


@query("retrieve_batch", f"SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS contexts FROM {_TOP} GROUP BY query_id")
def retrieve_batch(spark, sf_dir):
    q, corpus = vectors(spark, sf_dir)
    hits = retrieval.cosine_top_k(q, corpus, 3, exclude_self=True)
    got = retrieval.retrieve_batch(hits, corpus.select("doc_id", F.col("doc_id").cast("string").alias("document")))
    return got.select("query_id", F.array_join("contexts", " ").alias("contexts"))


_NEG = f"""(SELECT query_id, contexts, (query_id // 20) // 8 AS batch, (query_id // 20) % 8 AS pos, count(*) OVER (PARTITION BY (query_id // 20) // 8) AS n FROM (
  SELECT query_id, string_agg(CAST(doc_id AS VARCHAR), ' ' ORDER BY rank) AS contexts FROM {_TOP} GROUP BY query_id))"""


@query("retrieve_negative", f"SELECT a.batch, a.query_id, b.contexts AS negative FROM {_NEG} a JOIN {_NEG} b ON a.batch = b.batch AND b.pos = (a.pos + greatest(1, a.n // 2)) % a.n")
def retrieve_negative(spark, sf_dir):
    got = save(retrieve_batch(spark, sf_dir), "retrieved")
    numbered = got.withColumns({"batch": F.floor(F.col("query_id") / 160), "pos": F.floor(F.col("query_id") / 20) % 8})
    return retrieval.retrieve_negative(numbered)


def _cells(spark, corpus):
    return ann.build(corpus, f"{shared_dir(spark)}/cells-{uuid4().hex}")


@query("topk_lsh")
def topk_lsh(spark, sf_dir):
    """Approximate neighbours by an inverted file; the name is that of the index before it."""
    q, corpus = vectors(spark, sf_dir)
    return ann.search(_cells(spark, corpus), q, 3).withColumn("distance", F.round("distance", 4)).drop("compared")


@query("index_recall")
def index_recall(spark, sf_dir):
    """Per query how many of the exact three neighbours the inverted file finds, and the share of all rows compared."""
    q, corpus = vectors(spark, sf_dir)
    found = ann.search(_cells(spark, corpus), q, 3)
    exact = retrieval.cosine_top_k(q, corpus, 3).select("query_id", "doc_id", F.lit(1).alias("hit"))
    joined = found.join(exact, ["query_id", "doc_id"], "left")
    return joined.groupBy("query_id").agg(F.count("hit").alias("found"), F.round(F.max("compared") / F.lit(corpus.count()), 4).alias("compared_share"))


@query("rag_prompt", """SELECT rec_id, 'Context 1: ' || instruction || chr(10) || 'Context 2: ' || output || chr(10) || 'Context 3: ' || chr(10) || 'Question: ' || instruction || chr(10) || 'Answer:' AS rag,
  'Context 1: ' || instruction || chr(10) || 'Context 2: ' || output || chr(10) || 'Question: ' || instruction || chr(10) || 'Answer:' AS eval, 'Question: ' || instruction || chr(10) || 'Answer:' AS bare FROM """ + _PAIR)
def rag_prompt(spark, sf_dir):
    ctx, q = F.array("instruction", "output"), F.col("instruction")
    return pairs(spark, sf_dir).select("rec_id", text.rag_prompt(q, ctx).alias("rag"), text.rag_prompt(q, ctx, 2).alias("eval"), text.bare_prompt(q).alias("bare"))


@query("three_way_prompts", f"""SELECT CAST(rec_id AS VARCHAR) AS example_id, kind, CASE kind WHEN 'bare' THEN '' WHEN 'rag' THEN 'Context 1: ' || output || chr(10) || 'Context 2: ' || chr(10) || 'Context 3: ' || chr(10)
  ELSE 'Context 1: ' || input || chr(10) || 'Context 2: ' || chr(10) || 'Context 3: ' || chr(10) END || 'Question: ' || instruction || chr(10) || 'Answer:' AS prompt FROM {_PAIR}, (VALUES ('rag'), ('bare'), ('neg')) AS t(kind)""")
def three_way_prompts(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.col("rec_id").cast("string").alias("example_id"), F.col("instruction").alias("question"), F.array("output").alias("contexts"), F.array("input").alias("negative"))
    return inference.three_way_prompts(rows)


def squad(spark, sf_dir):
    """Records as question-answer examples; some have no answer, many share a context."""
    rows = pairs(spark, sf_dir)
    answers = F.when(F.col("rec_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("output"))
    return rows.select("rec_id", F.col("instruction").alias("question"), F.when(F.col("rec_id") % 2 == 0, F.col("output")).otherwise(F.lit("one shared context")).alias("context"), F.struct(answers.alias("text")).alias("answers"))


@query("filter_answerable", f"SELECT rec_id FROM {_PAIR} WHERE rec_id % 3 <> 0")
def filter_answerable(spark, sf_dir):
    return src.answerable(squad(spark, sf_dir)).select("rec_id")


@query("student_inputs", f"SELECT rec_id, 'question: ' || instruction AS input_text, CASE WHEN rec_id % 3 = 0 THEN '' ELSE output END AS answer_text FROM {_PAIR}")
def student_inputs(spark, sf_dir):
    return squad(spark, sf_dir).select("rec_id", text.student_input(F.col("question")).alias("input_text"), F.coalesce(F.get("answers.text", F.lit(0)), F.lit("")).alias("answer_text"))


@query("build_passage_index", f"""WITH e AS (SELECT rec_id, CASE WHEN rec_id % 2 = 0 THEN output ELSE 'one shared context' END AS context FROM {_PAIR} WHERE rec_id % 3 <> 0),
c AS (SELECT DISTINCT context FROM e), w AS (SELECT list_filter(string_split_regex(context, '\\s+'), lambda x: x <> '') AS w FROM c),
k AS (SELECT DISTINCT array_to_string(list_slice(w, i + 1, i + 256), ' ') AS chunk FROM (SELECT w, unnest(range(0, greatest(len(w) - 32, 1), 224)) AS i FROM w WHERE len(w) > 0))
SELECT left(sha256(chunk), 32) AS id, chunk AS document FROM k""")
def build_passage_index(spark, sf_dir):
    return build_index(squad(spark, sf_dir)).select("id", "document")


# Soft labels: vectors as logits, eight positions an example, four examples a batch


def soft_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    neighbour = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("n"))
    label = F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("raw"))
    joined = rows.withColumnRenamed("label", "raw").join(neighbour, "vec_id", "left").withColumns({"v": v, "n": F.transform(F.coalesce("n", "embedding"), lambda x: x.cast("double"))})
    gold = F.transform("v", lambda x, i: 8 * x + F.when(i == F.col("raw"), 2.0).otherwise(0.0))
    return joined.select(
        F.floor(F.col("vec_id") / 32).alias("batch"), F.floor(F.col("vec_id") / 8).alias("example_id"), (F.col("vec_id") % 8).alias("pos"), label.alias("label"),
        gold.alias("rag"), F.transform("v", lambda x: 4 * x).alias("bare"), F.transform(F.reverse("v"), lambda x: 8 * x).alias("neg"), F.transform("n", lambda x: 6 * x).alias("student"),
    )


_SOFT = """(SELECT a.vec_id // 32 AS batch, a.vec_id // 8 AS example_id, CASE WHEN a.vec_id % 7 = 0 THEN -100 ELSE a.label END AS label, a.label AS gold,
  list_transform(CAST(a.embedding AS DOUBLE[]), lambda x, i: 8 * x + CASE WHEN i - 1 = a.label THEN 2.0 ELSE 0.0 END) AS rag, list_transform(CAST(a.embedding AS DOUBLE[]), lambda x: 4 * x) AS bare,
  list_transform(list_reverse(CAST(a.embedding AS DOUBLE[])), lambda x: 8 * x) AS neg, list_transform(CAST(coalesce(b.embedding, a.embedding) AS DOUBLE[]), lambda x: 6 * x) AS student
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - 1)"""
_LSE = "(list_max({0}) + ln(list_sum(list_transform({0}, lambda x: exp(x - list_max({0}))))))"


def _ls(c: str, t: float) -> str:
    scaled = f"list_transform({c}, lambda x: x / {t})"
    return f"list_transform({scaled}, lambda y: y - {_LSE.format(scaled)})"


_LP = f"""lp AS (SELECT batch, example_id, label, label <> -100 AS valid, {_ls('rag', 1.0)} AS rag1, {_ls('bare', 1.0)} AS bare1, {_ls('student', 1.0)} AS student1,
  {_ls('rag', 4.0)} AS rag4, {_ls('bare', 4.0)} AS bare4, {_ls('neg', 4.0)} AS neg4, {_ls('student', 4.0)} AS student4 FROM {_SOFT})"""
_KL = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: exp({0}[i]) * ({0}[i] - {1}[i])))"
_ENT = "(-list_sum(list_transform({0}, lambda x: exp(x) * x)))"
_MEAN = "coalesce(sum({0}) FILTER (valid), 0) / greatest(count(*) FILTER (valid), 1)"
_ROWS = f"""{_LP}, q AS (SELECT batch, example_id, label, valid, -rag1[label + 1] AS nr, -bare1[label + 1] AS nb, -student1[label + 1] AS ce, {_KL.format('rag4', 'student4')} AS kr, {_KL.format('bare4', 'student4')} AS kb,
  {_KL.format('rag4', 'neg4')} AS kn, {_KL.format('rag4', 'bare4')} AS kx, {_KL.format('rag1', 'bare1')} AS shift, {_ENT.format('bare4')} - {_ENT.format('rag4')} AS gap, rag4, bare4, student4 FROM lp),
w AS (SELECT *, 1 / (1 + exp(-(gap - coalesce(avg(gap) FILTER (valid) OVER (PARTITION BY batch), avg(gap) OVER (PARTITION BY batch))))) AS w FROM q),
f AS (SELECT *, list_sum(list_transform(range(1, len(rag4) + 1), lambda i: (w * exp(rag4[i]) + (1 - w) * exp(bare4[i])) * (ln(w * exp(rag4[i]) + (1 - w) * exp(bare4[i])) - student4[i]))) AS kf FROM w),
x AS (SELECT batch, example_id, {_MEAN.format('nr')} AS nr, {_MEAN.format('nb')} AS nb, {_MEAN.format('kr')} AS kr, {_MEAN.format('kb')} AS kb, {_MEAN.format('kn')} AS kn, {_MEAN.format('kx')} AS kx, {_MEAN.format('kf')} AS kf,
  sum(ce) FILTER (valid) AS ce, count(*) FILTER (valid) AS n, sum(w) FILTER (valid) AS wv FROM f GROUP BY batch, example_id),
g AS (SELECT *, nb - nr AS u, 0.05 + 0.9 / (1 + exp(-(nb - nr))) AS gate FROM x)"""
_LOSS = """SELECT batch, 16 * avg({gr} * kr) AS l_rag, 16 * avg({gb} * kb) AS l_kl, greatest(0.0, 0.5 - 16 * avg({kn})) AS l_cra, sum(ce) / sum(n) AS l_ce, {fuse} AS l_fuse, {gate} AS gate_mean, {u} AS utility_mean, {w} AS fusion_w_mean FROM g GROUP BY batch"""
_ROUND = "SELECT {0}batch, round(l_rag, 5) AS l_rag, round(l_kl, 5) AS l_kl, round(l_cra, 5) AS l_cra, round(l_ce, 5) AS l_ce, round(l_fuse, 5) AS l_fuse, round(gate_mean, 5) AS gate_mean, round(utility_mean, 5) AS utility_mean, round(fusion_w_mean, 5) AS fusion_w_mean, round(0.5 * l_rag + 0.2 * l_kl + 0.1 * l_cra + 0.2 * l_ce + 0.3 * l_fuse, 5) AS total FROM ({1})"
_FULL = {"gr": "gate", "gb": "(1 - gate)", "kn": "kn", "fuse": "16 * avg(kf)", "gate": "avg(gate)", "u": "avg(u)", "w": "sum(wv) / sum(n)"}


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, *(F.round(c, 5).alias(c) for c in df.columns if c not in keys))


@query("per_example_nll", f"WITH {_ROWS} SELECT batch, example_id, round(nr, 5) AS nll_rag, round(nb, 5) AS nll_bare FROM x")
def per_example_nll(spark, sf_dir):
    return _rounded(soft.example_nll(soft_rows(spark, sf_dir), "rag", "bare"), "batch", "example_id")


@query("nll_of_blocks", f"WITH {_ROWS} SELECT batch, example_id, round(nr, 5) AS nll_rag, round(nb, 5) AS nll_bare FROM x")
def nll_of_blocks(spark, sf_dir):
    """The same from rows that hold 24 of the 64 ids each."""
    rows = soft_rows(spark, sf_dir).select("*", F.explode(F.array(*(F.lit(k) for k in range(0, 64, 24)))).alias("first"))
    blocks = rows.select("batch", "example_id", "pos", "label", "first", *(F.slice(c, F.col("first") + 1, 24).alias(c) for c in ("rag", "bare")))
    return _rounded(soft.example_nll_of_blocks(blocks, "rag", "bare"), "batch", "example_id")


@query("retrieval_utility", f"WITH {_ROWS} SELECT batch, example_id, round(u, 5) AS utility FROM g")
def retrieval_utility(spark, sf_dir):
    return _rounded(soft.retrieval_utility(soft_rows(spark, sf_dir)), "batch", "example_id")


@query("utility_gate", f"WITH {_ROWS} SELECT batch, example_id, round(gate, 5) AS gate FROM g")
def utility_gate(spark, sf_dir):
    u = soft.retrieval_utility(soft_rows(spark, sf_dir))
    return u.select("batch", "example_id", F.round(soft.utility_gate(F.col("utility")), 5).alias("gate"))


@query("token_fusion", f"""WITH {_ROWS}, o AS (SELECT batch, example_id, label, round(w, 5) AS w, round(list_sum(list_transform(range(1, 65), lambda i: w * exp(rag4[i]) + (1 - w) * exp(bare4[i]))), 5) AS total,
round(list_sum(list_transform(range(1, 65), lambda i: i * (w * exp(rag4[i]) + (1 - w) * exp(bare4[i])))), 4) AS centre, round(list_sum(list_transform(range(1, 65), lambda i: i * i * (w * exp(rag4[i]) + (1 - w) * exp(bare4[i])))), 3) AS spread FROM w) SELECT * FROM o""")
def token_fusion(spark, sf_dir):
    rows = soft.fusion_weights(soft_rows(spark, sf_dir))
    fused = soft.fuse(soft.softmax(4.0)(F.col("rag")), soft.softmax(4.0)(F.col("bare")), F.col("w"))
    numbered = F.arrays_zip("fused", F.sequence(F.lit(1), F.size("fused")).alias("i"))

    def moment(power: int) -> F.Column:
        return F.aggregate(numbered, F.lit(0.0), lambda a, x: a + x["fused"] * F.pow(x["i"], F.lit(power)))

    shown = (F.round(moment(p), d).alias(n) for p, d, n in ((0, 5, "total"), (1, 4, "centre"), (2, 3, "spread")))
    return rows.withColumn("fused", fused).select("batch", "example_id", "label", F.round("w", 5).alias("w"), *shown)


@query("kl_per_example", f"WITH {_ROWS} SELECT batch, example_id, round(16 * kr, 5) AS kl_rag, round(16 * kb, 5) AS kl_bare FROM x")
def kl_per_example(spark, sf_dir):
    rows = soft_rows(spark, sf_dir).select("batch", "example_id", "label", soft.kl(4.0)(F.col("rag"), F.col("student")).alias("r"), soft.kl(4.0)(F.col("bare"), F.col("student")).alias("b"))
    return _rounded(rows.groupBy("batch", "example_id").agg((16 * soft.valid_mean(F.col("r"))).alias("kl_rag"), (16 * soft.valid_mean(F.col("b"))).alias("kl_bare")), "batch", "example_id")


@query("kd_loss", f"WITH {_ROWS} " + _ROUND.format("", _LOSS.format(**_FULL)))
def kd_loss(spark, sf_dir):
    return _rounded(soft.kd_loss(soft_rows(spark, sf_dir)), "batch")


@query("kd_loss_of_blocks", f"WITH {_ROWS} " + _ROUND.format("", _LOSS.format(**_FULL)))
def kd_loss_of_blocks(spark, sf_dir):
    """The same from rows that hold 24 of the 64 ids each."""
    rows = soft_rows(spark, sf_dir).select("*", F.explode(F.array(*(F.lit(k) for k in range(0, 64, 24)))).alias("first"))
    blocks = rows.select("batch", "example_id", "pos", "label", "first", *(F.slice(c, F.col("first") + 1, 24).alias(c) for c in ("rag", "bare", "student", "neg")))
    return _rounded(soft.kd_loss_of_blocks(blocks), "batch")


_VARIANTS = {
    "full": ({}, {}),
    "no_contrast": ({"kn": "kx"}, {"contrast": False}),
    "no_gate": ({"gr": "1", "gb": "1", "gate": "0.5", "u": "0.0"}, {"gated": False}),
    "no_fusion": ({"fuse": "0.0", "w": "0.0"}, {"epsilon": 0.0}),
}


@query("kd_loss_ablations", f"WITH {_ROWS} " + " UNION ALL ".join(_ROUND.format(f"'{name}' AS variant, ", _LOSS.format(**_FULL | change)) for name, (change, _) in _VARIANTS.items()))
def kd_loss_ablations(spark, sf_dir):
    rows = save(soft_rows(spark, sf_dir), "soft-rows")
    runs = [_rounded(soft.kd_loss(rows, soft.LossWeights(**p)), "batch").withColumn("variant", F.lit(name)) for name, (_, p) in _VARIANTS.items()]
    return reduce(DataFrame.unionByName, runs)


@query("loss_history", f"WITH {_ROWS}, l AS ({_LOSS.format(**_FULL)}), t AS (SELECT batch // 4 AS epoch, batch, 0.5 * l_rag + 0.2 * l_kl + 0.1 * l_cra + 0.2 * l_ce + 0.3 * l_fuse AS total FROM l) SELECT epoch, count(*) AS steps, count(*) FILTER (batch % 2 = 0) AS logged, round(avg(total), 5) AS mean_loss FROM t GROUP BY epoch")
def loss_history(spark, sf_dir):
    loss = soft.kd_loss(soft_rows(spark, sf_dir)).withColumn("epoch", F.floor(F.col("batch") / 4))
    return loss.groupBy("epoch").agg(F.count("*").alias("steps"), F.count_if(F.col("batch") % 2 == 0).alias("logged"), F.round(F.avg("total"), 5).alias("mean_loss"))


@query("utility_summary", f"WITH {_ROWS} SELECT round(avg(u), 5) AS mean, round(quantile_cont(u, 0.5), 5) AS median, round(avg(CASE WHEN u > 0 THEN 1.0 ELSE 0.0 END), 5) AS positive_share, avg(CASE WHEN u > 0 THEN 1.0 ELSE 0.0 END) < 0.5 AS warning FROM g")
def utility_summary(spark, sf_dir):
    return _rounded(soft.utility_summary(soft.retrieval_utility(soft_rows(spark, sf_dir))), "warning")


@query("retrieval_shift", f"WITH {_ROWS} SELECT round(avg(shift), 5) AS shift FROM q")
def retrieval_shift(spark, sf_dir):
    return _rounded(soft.retrieval_shift(soft_rows(spark, sf_dir)))


@query("sequence_confidence", f"WITH {_LP} SELECT example_id AS sequence_id, round(exp(coalesce(sum(rag1[abs(label) % 64 + 1]) FILTER (label <> -100 AND label <> 3), 0) / greatest(count(*) FILTER (label <> -100 AND label <> 3), 1)), 5) AS confidence FROM lp GROUP BY example_id")
def sequence_confidence(spark, sf_dir):
    steps = soft_rows(spark, sf_dir).select(F.col("example_id").alias("sequence_id"), F.col("label").alias("token"), F.col("rag").alias("logits"))
    return _rounded(soft.sequence_confidence(steps, -100, 3), "sequence_id")


@query("soft_label_pending", "SELECT DISTINCT vec_id // 8 AS example_id FROM embeddings WHERE (vec_id // 8) % 3 <> 0")
def soft_label_pending(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("example_id"))
    return src.pending_soft_labels(rows.distinct(), rows.where("example_id % 3 = 0"))


# Curriculum: utilities from the events table


def utilities(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("example_id"), F.col("value").alias("utility"))


@query("load_utilities", "SELECT o_orderkey AS example_id, coalesce(e.value, 0.0) AS utility FROM orders LEFT JOIN events e ON e.event_id = o_orderkey")
def load_utilities(spark, sf_dir):
    return src.align_utilities(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("example_id")), utilities(spark, sf_dir))


@query("competence", "SELECT event_id, round(least(1.0, sqrt(least(event_id / 5000.0, 1.0) * (1 - 0.0625) + 0.0625)), 6) AS competence FROM events")
def competence(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.round(curriculum.competence(F.col("event_id").cast("double"), F.lit(5000.0)), 6).alias("competence"))


@query("curriculum_pool", "SELECT event_id AS example_id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank, count(*) OVER () AS n FROM events) WHERE rank <= greatest(1, round_even(CAST(0.4 * n AS DOUBLE), 0))")
def curriculum_pool(spark, sf_dir):
    return curriculum.visible_pool(curriculum.ranked(utilities(spark, sf_dir)), 0.4).select("example_id", "rank")


def _permutation_sql(source: str) -> str:
    """Columns v (from 0), a, b, key of ``source`` with v one step of the permutation further."""
    mix = lambda x, k: f"({x} * (({x} * {curriculum._FACTORS[k]} + (key + {k}) % 2147483647) % 2147483647) % 2147483647)"
    out = f"(SELECT *, v // b AS l0, v % b AS r0 FROM {source})"
    for k in (0, 2):
        out = f"(SELECT *, (l{k} + {mix(f'r{k}', k)}) % a AS l{k + 2} FROM {out})"
        out = f"(SELECT *, (r{k} + {mix(f'l{k + 2}', k + 1)}) % b AS r{k + 2} FROM {out})"
    return f"SELECT epoch, event_id, size, a, b, key, l4 * b + r4 AS v FROM {out}"


@query("curriculum_epoch", f"""WITH RECURSIVE r AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS rank, count(*) OVER () AS n FROM events),
e AS (SELECT unnest(range(3)) AS epoch), s AS (SELECT r.*, epoch, epoch * (greatest(1, n // 8) // 4) AS step, greatest(1, CAST(floor((greatest(1, n // 8) // 4) * 3 * 0.5) AS BIGINT)) AS ramp FROM r, e),
z AS (SELECT *, greatest(1, CAST(round_even(CAST(least(1.0, sqrt(least(step / CAST(ramp AS DOUBLE), 1.0) * 0.9375 + 0.0625)) * n AS DOUBLE), 0) AS BIGINT)) AS size FROM s),
g AS (SELECT epoch, event_id, size, rank - 1 AS v, CAST(ceil(sqrt(CAST(size AS DOUBLE))) AS BIGINT) AS a, (42 * 7919 + epoch * 104729) % 2147483647 AS key FROM z WHERE rank <= size),
h AS (SELECT *, (size + a - 1) // a AS b FROM g),
w AS ({_permutation_sql("h")} UNION ALL {_permutation_sql("(SELECT * FROM w WHERE v >= size)")})
SELECT CAST(epoch AS INTEGER) AS epoch, v + 1 AS place, event_id AS example_id FROM w WHERE v < size""")
def curriculum_epoch(spark, sf_dir):
    return curriculum.epoch_pools(utilities(spark, sf_dir))


# Evaluation: part names as references, perturbed for each model

_PRED = """(SELECT p_partkey AS example_id, p_name AS reference, CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name ELSE split_part(p_name, ' ', 1) END AS bare,
  CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) || '.' ELSE p_name || ' extra words here' END AS rag, CASE WHEN p_partkey % 5 < 2 THEN p_name ELSE 'an ' || p_type END AS student,
  CASE WHEN p_partkey % 5 < 3 THEN p_name ELSE p_type END AS student_rag FROM part)"""
MODELS = ("bare", "rag", "student", "student_rag")


def predictions(spark, sf_dir):
    k, name, kind = F.col("p_partkey"), F.col("p_name"), F.col("p_type")
    return table(spark, sf_dir, "part").select(
        k.alias("example_id"), name.alias("reference"), F.when(k % 3 == 0, F.concat(F.lit("The "), name)).otherwise(F.split_part(name, F.lit(" "), F.lit(1))).alias("bare"),
        F.when(k % 2 == 0, F.concat(F.upper(name), F.lit("."))).otherwise(F.concat(name, F.lit(" extra words here"))).alias("rag"),
        F.when(k % 5 < 2, name).otherwise(F.concat(F.lit("an "), kind)).alias("student"), F.when(k % 5 < 3, name).otherwise(kind).alias("student_rag"),
    )


_LONG = "(" + " UNION ALL ".join(f"SELECT example_id, '{m}' AS model, {m} AS prediction, reference FROM {_PRED}" for m in MODELS) + ")"
_TOK = f"(SELECT example_id, model, {_QA.format('prediction')} AS p, {_QA.format('reference')} AS r FROM {_LONG})"
_F1 = f"""f AS (SELECT example_id, model, p, r, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS a, CASE WHEN r = '' THEN [] ELSE string_split(r, ' ') END AS b FROM {_TOK}),
c AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(list_intersect(a, b)), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))), 0) AS o FROM f),
m AS (SELECT *, CASE WHEN p = r THEN 1.0 ELSE 0.0 END AS exact_match, CASE WHEN len(a) = 0 OR len(b) = 0 THEN (CASE WHEN len(a) = len(b) THEN 1.0 ELSE 0.0 END) ELSE 2.0 * o / (len(a) + len(b)) END AS f1 FROM c)"""


def _hits(n: int) -> str:
    grams = lambda c: f"list_transform(range(1, greatest(len({c}) - {n - 1}, 0) + 1), lambda i: array_to_string(list_slice({c}, i, i + {n - 1}), ' '))"
    a, b = grams("a"), grams("b")
    return f"coalesce(list_sum(list_transform(list_distinct(list_intersect({a}, {b})), lambda x: least(len(list_filter({a}, lambda y: y = x)), len(list_filter({b}, lambda y: y = x))))), 0)"


_BLEU = f"""{_F1}, h AS (SELECT *, {', '.join(f'{_hits(n)} AS h{n}' for n in range(1, 5))} FROM m),
s AS (SELECT *, CASE WHEN len(a) = 0 OR h1 = 0 THEN 0.0 ELSE (CASE WHEN len(a) > len(b) THEN 1.0 ELSE exp(1 - CAST(len(b) AS DOUBLE) / len(a)) END) * exp(0.25 * ({' + '.join(f'ln((CASE WHEN h{n} = 0 THEN 0.1 ELSE CAST(h{n} AS DOUBLE) END) / greatest(len(a) - {n - 1}, 1))' for n in range(1, 5))})) END AS bleu4 FROM h)"""


def answers(spark, sf_dir):
    return evaluate.long_answers(predictions(spark, sf_dir), MODELS)


def scores(spark, sf_dir):
    return evaluate.measured(answers(spark, sf_dir))


@query("exact_match", f"WITH {_F1} SELECT example_id, model, exact_match FROM m")
def exact_match(spark, sf_dir):
    return answers(spark, sf_dir).select("example_id", "model", metrics.exact_match(F.col("prediction"), F.col("reference")).alias("exact_match"))


@query("token_f1", f"WITH {_F1} SELECT example_id, model, round(f1, 6) AS f1 FROM m")
def token_f1(spark, sf_dir):
    return answers(spark, sf_dir).select("example_id", "model", F.round(metrics.token_f1(F.col("prediction"), F.col("reference")), 6).alias("f1"))


@query("bleu4", f"WITH {_BLEU} SELECT example_id, model, round(bleu4, 6) AS bleu4 FROM s")
def bleu4(spark, sf_dir):
    return scores(spark, sf_dir).select("example_id", "model", F.round("bleu4", 6).alias("bleu4"))


@query("evaluate_models", f"WITH {_BLEU} SELECT model, round(avg(exact_match), 6) AS exact_match, round(avg(f1), 6) AS f1, round(avg(bleu4), 6) AS bleu4, count(*) AS n FROM s GROUP BY model")
def evaluate_models(spark, sf_dir):
    return evaluate.evaluate_models(scores(spark, sf_dir)).select("model", *(F.round(m, 6).alias(m) for m in evaluate.METRICS), "n")


@query("compare_models", f"WITH {_BLEU} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, {', '.join(f'round(100 * avg({m}) FILTER (model = {chr(39)}{x}{chr(39)}), 1) AS {x}' for x in MODELS)} FROM s" for m in evaluate.METRICS))
def compare_models(spark, sf_dir):
    return evaluate.compare_models(scores(spark, sf_dir))


@query("perplexity", "SELECT round(exp(sum(l_discount * 30 * l_quantity) / sum(l_quantity)), 6) AS perplexity FROM lineitem")
def perplexity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 30).alias("nll"), F.col("l_quantity").alias("n_tokens"))
    return evaluate.perplexity(rows).select(F.round("perplexity", 6).alias("perplexity"))


_STRATA = f"""(SELECT w.*, CASE WHEN eb = 1 THEN 'parametric' WHEN er = 1 THEN 'retrieval_dependent' ELSE 'hard' END AS stratum, es, eg FROM (SELECT *,
  CASE WHEN {_QA.format('bare')} = {_QA.format('reference')} THEN 1 ELSE 0 END AS eb, CASE WHEN {_QA.format('rag')} = {_QA.format('reference')} THEN 1 ELSE 0 END AS er,
  CASE WHEN {_QA.format('student')} = {_QA.format('reference')} THEN 1.0 ELSE 0.0 END AS es, CASE WHEN {_QA.format('student_rag')} = {_QA.format('reference')} THEN 1.0 ELSE 0.0 END AS eg FROM {_PRED}) w)"""


@query("stratify", f"SELECT example_id, stratum FROM {_STRATA}")
def stratify(spark, sf_dir):
    return evaluate.stratify(predictions(spark, sf_dir)).select("example_id", "stratum")


@query("probe_strata", f"WITH {_F1}, z AS (SELECT t.stratum, m.exact_match, m.f1 FROM {_STRATA} t JOIN m ON m.example_id = t.example_id AND m.model = 'student') SELECT stratum, round(avg(exact_match), 6) AS exact_match, round(avg(f1), 6) AS f1, count(*) AS n FROM z GROUP BY stratum")
def probe_strata(spark, sf_dir):
    rows = evaluate.probe_strata(evaluate.stratify(predictions(spark, sf_dir)))
    return rows.select("stratum", F.round("exact_match", 6).alias("exact_match"), F.round("f1", 6).alias("f1"), "n")


@query("retention_probe", f"""SELECT round(avg(es) FILTER (stratum = 'retrieval_dependent'), 6) AS retention_rate, round(avg(es) FILTER (stratum = 'parametric'), 6) AS parametric_preservation,
  count(*) FILTER (stratum = 'parametric') AS n_parametric, count(*) FILTER (stratum = 'retrieval_dependent') AS n_retrieval_dependent, count(*) FILTER (stratum = 'hard') AS n_hard FROM {_STRATA}""")
def retention_probe(spark, sf_dir):
    r = evaluate.retention(evaluate.stratify(predictions(spark, sf_dir)))
    return r.select(F.round("retention_rate", 6).alias("retention_rate"), F.round("parametric_preservation", 6).alias("parametric_preservation"), "n_parametric", "n_retrieval_dependent", "n_hard")


@query("independence_gap", f"SELECT round(avg(es), 6) AS em_alone, round(avg(eg), 6) AS em_with_retrieval, round(avg(eg) - avg(es), 6) AS gap, abs(avg(eg) - avg(es)) < 0.02 AS independent FROM {_STRATA}")
def independence_gap(spark, sf_dir):
    r = evaluate.independence_gap(predictions(spark, sf_dir))
    return r.select(*(F.round(c, 6).alias(c) for c in ("em_alone", "em_with_retrieval", "gap")), "independent")


def confidences(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("confidence"), (F.col("l_returnflag") == "R").cast("double").alias("correct"), "l_linestatus")


def _bins(group: str = "") -> str:
    g = f"{group}, " if group else ""
    return f"""p AS (SELECT l_quantity / 50 AS confidence, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS correct, l_linestatus FROM lineitem),
e AS (SELECT CAST(i AS INTEGER) AS bin, i * CAST(0.1 AS DOUBLE) AS lo, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * CAST(0.1 AS DOUBLE) END AS hi FROM (SELECT unnest(range(10)) AS i)),
h AS (SELECT {g}bin, count(*) AS n, avg(correct) AS acc, avg(confidence) AS conf FROM p JOIN e ON confidence <= hi AND (confidence > lo OR lo = 0 AND confidence >= 0) GROUP BY {g}bin),
t AS (SELECT {g}count(*) AS total FROM p {f'GROUP BY {group}' if group else ''})"""


@query("ece_bins", f"WITH {_bins()} SELECT e.bin, round(lo, 6) AS lo, round(hi, 6) AS hi, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(acc, 0), 6) AS acc, round(coalesce(conf, 0), 6) AS conf FROM e LEFT JOIN h USING (bin)")
def ece_bins(spark, sf_dir):
    b = evaluate.calibration_bins(confidences(spark, sf_dir))
    return b.select("bin", *(F.round(c, 6).alias(c) for c in ("lo", "hi")), "n", *(F.round(c, 6).alias(c) for c in ("acc", "conf")))


@query("ece", f"WITH {_bins()} SELECT round(sum(n * abs(acc - conf) / total), 6) AS ece, round(sum(n * (conf - acc) / total), 6) AS overconfidence, max(total) AS n FROM h, t")
def ece(spark, sf_dir):
    return evaluate.expected_calibration_error(confidences(spark, sf_dir)).select(F.round("ece", 6).alias("ece"), F.round("overconfidence", 6).alias("overconfidence"), "n")


@query("ece_by_group", f"WITH {_bins('l_linestatus')} SELECT l_linestatus, round(sum(n * abs(acc - conf) / total), 6) AS ece, round(sum(n * (conf - acc) / total), 6) AS overconfidence, max(total) AS n FROM h JOIN t USING (l_linestatus) GROUP BY l_linestatus")
def ece_by_group(spark, sf_dir):
    return evaluate.expected_calibration_error(confidences(spark, sf_dir), "l_linestatus").select("l_linestatus", F.round("ece", 6).alias("ece"), F.round("overconfidence", 6).alias("overconfidence"), "n")


# Whole runs

_PROMPT = "'Context 1: ' || output || chr(10) || 'Context 2: ' || chr(10) || 'Question: ' || instruction || chr(10) || 'Answer:'"


@query("predict_with_contexts", f"SELECT rec_id AS example_id, 'echo ' || length({_PROMPT}) AS prediction, output AS reference FROM {_PAIR}")
def predict_with_contexts(spark, sf_dir):
    rows = pairs(spark, sf_dir).select(F.col("rec_id").alias("example_id"), F.col("instruction").alias("question"), F.col("output").alias("reference"), F.array("output").alias("contexts"))
    settings = inference.JobSettings(base_delay=0.0, requests_per_second=0)
    return inference.predict(rows, inference.EchoTeacher, settings).select("example_id", "prediction", "reference")


_RUN = " UNION ALL ".join(f"SELECT 'models' AS part, model AS name, '{m}' AS metric, round(avg({m}), 6) AS value FROM s GROUP BY model" for m in evaluate.METRICS)


@query("evaluate_run", f"""WITH {_BLEU} {_RUN}
  UNION ALL SELECT 'probe', 'student', 'retention_rate', round(avg(es) FILTER (stratum = 'retrieval_dependent'), 6) FROM {_STRATA}
  UNION ALL SELECT 'probe', 'student', 'parametric_preservation', round(avg(es) FILTER (stratum = 'parametric'), 6) FROM {_STRATA}
  UNION ALL SELECT 'strata', stratum, 'n', CAST(count(*) AS DOUBLE) FROM {_STRATA} GROUP BY stratum
  UNION ALL SELECT 'gap', 'student', 'gap', round(avg(eg) - avg(es), 6) FROM {_STRATA}""")
def evaluate_run(spark, sf_dir):
    run = evaluate.evaluate_run(predictions(spark, sf_dir), tuple(MODELS))

    def rows(part: str, name, *metrics: str) -> DataFrame:
        wide = run[part].select(F.lit(part).alias("part"), name.alias("name"), *(F.round(F.col(m).cast("double"), 6).alias(m) for m in metrics))
        return wide.unpivot(["part", "name"], list(metrics), "metric", "value")

    student = F.lit("student")
    parts = [rows("models", F.col("model"), *evaluate.METRICS), rows("probe", student, "retention_rate", "parametric_preservation"), rows("strata", F.col("stratum"), "n"), rows("gap", student, "gap")]
    return reduce(DataFrame.unionByName, parts)


class StubScorer:
    """Logits over eight ids that depend on a prompt's length and the position."""

    def __call__(self, prompts: list[str], labels: list[list[int]]) -> list[list[list[float]]]:
        return [[[((3 * len(p) + 7 * pos + 5 * v) % 13) / 4 for v in range(8)] for pos in range(len(y))] for p, y in zip(prompts, labels, strict=True)]


_NLL = "ln(list_sum(list_transform(range(8), lambda v: exp(((3 * {0} + 7 * pos + 5 * v) % 13) / 4.0)))) - ((3 * {0} + 7 * pos + 5 * ((query_id + pos) % 8)) % 13) / 4.0"


_UTILITY = f"""WITH c AS (SELECT query_id, string_agg('Context ' || rank || ': passage ' || doc_id || chr(10), '' ORDER BY rank) AS ctx FROM {_TOP} GROUP BY query_id),
l AS (SELECT query_id, length('Question: q' || query_id || chr(10) || 'Answer:') AS lb, length(ctx) AS lc FROM c), p AS (SELECT query_id, lb, lb + lc AS lr, unnest(range(3)) AS pos FROM l)
SELECT CAST(query_id AS VARCHAR) AS example_id, CAST((query_id // 20) // 8 AS INTEGER) AS batch, round(avg(({_NLL.format('lb')}) - ({_NLL.format('lr')})), 5) AS utility FROM p GROUP BY query_id"""


def _examples(spark, sf_dir):
    q, corpus = vectors(spark, sf_dir)
    i = F.col("query_id")
    examples = q.select(
        "query_id", F.floor(i / 160).cast("int").alias("batch"), (F.floor(i / 20) % 8).alias("pos"), i.cast("string").alias("example_id"),
        F.concat(F.lit("q"), i.cast("string")).alias("question"), F.transform(F.sequence(F.lit(0), F.lit(2)), lambda x: ((i + x) % 8).cast("int")).alias("labels"),
    )
    return examples, q, corpus.withColumn("document", F.concat(F.lit("passage "), F.col("doc_id").cast("string")))


@query("soft_label_job", _UTILITY)
def soft_label_job(spark, sf_dir):
    _, utility = run_soft_labels(*_examples(spark, sf_dir), StubScorer, exclude_self=True)
    return utility.select("example_id", "batch", F.round("utility", 5).alias("utility"))


@query("soft_label_resume", _UTILITY)
def soft_label_resume(spark, sf_dir):
    """The same from a log in which a run over the examples of even batches has left theirs."""
    (examples, q, store), log = _examples(spark, sf_dir), f"{shared_dir(spark)}/soft-labels-{uuid4().hex}"
    run_soft_labels(examples.where("batch % 2 = 0"), q, store, StubScorer, log, exclude_self=True)
    _, utility = run_soft_labels(examples, q, store, StubScorer, log, exclude_self=True)
    return utility.select("example_id", "batch", F.round("utility", 5).alias("utility"))

