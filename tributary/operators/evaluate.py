"""Model evaluation: metric means, stratified retention, calibration, perplexity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tributary.functions.metrics import answer_metrics, exact_match, token_f1
from tributary.session import save, shuffle_partitions

STRATA = ("parametric", "retrieval_dependent", "hard")
METRICS = ("exact_match", "f1", "bleu4")


def long_answers(wide: DataFrame, models: tuple[str, ...]) -> DataFrame:
    """Rows (example_id, reference, and a column a model) to (example_id, reference, model, prediction), dealt out by id
    before: a small file of many short answers would be scored by one task."""
    dealt = wide.select("example_id", "reference", *models).repartition(shuffle_partitions(wide.sparkSession), "example_id")
    return dealt.unpivot(["example_id", "reference"], list(models), "model", "prediction")


def measured(rows: DataFrame) -> DataFrame:
    """Answers (example_id, model, prediction, reference) with their metrics."""
    found = rows.select("example_id", "model", answer_metrics(F.col("prediction"), F.col("reference")).alias("_m"))
    return found.select("example_id", "model", "_m.exact_match", "_m.f1", "_m.bleu4")


def scored(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """Long predictions (example_id, model, prediction) with their metrics."""
    rows = predictions.join(references, "example_id")
    return measured(rows.repartition(shuffle_partitions(rows.sparkSession), "example_id", "model"))


def evaluate_models(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("n"))


def compare_models(scores: DataFrame) -> DataFrame:
    """A row a metric, a column a model, in percent with one decimal."""
    means = save(evaluate_models(scores), "model-means").unpivot(["model"], list(METRICS), "metric", "value")
    models = [r["model"] for r in means.select("model").distinct().orderBy("model").collect()]  # they become columns
    return means.groupBy("metric").pivot("model", models).agg(F.round(100 * F.first("value"), 1))


def perplexity(texts: DataFrame) -> DataFrame:
    """From (nll, n_tokens): exp of the token-weighted mean."""
    return texts.agg(F.exp(F.sum(F.col("nll") * F.col("n_tokens")) / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("perplexity"))


def stratify(wide: DataFrame, match: Callable[[Column, Column], Column] = exact_match, threshold: float = 0.5) -> DataFrame:
    """Adds ``stratum`` to rows (reference, bare, rag): what the teacher knows alone, with retrieval, or not at all."""
    good = lambda c: match(F.col(c), F.col("reference")) >= threshold
    return wide.withColumn("stratum", F.when(good("bare"), STRATA[0]).when(good("rag"), STRATA[1]).otherwise(STRATA[2]))


def probe_strata(stratified: DataFrame, student: str = "student") -> DataFrame:
    """exact_match, f1 and n of the student in every stratum; zeros for an empty one."""
    s, r = F.col(student), F.col("reference")
    found = stratified.groupBy("stratum").agg(F.avg(exact_match(s, r)).alias("exact_match"), F.avg(token_f1(s, r)).alias("f1"), F.count("*").alias("n"))
    every = stratified.sparkSession.createDataFrame([(x,) for x in STRATA], "stratum string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long" if c == "n" else "double")).alias(c)
    return every.join(found, "stratum", "left").select("stratum", zero("exact_match"), zero("f1"), zero("n"))


def retention(stratified: DataFrame, student: str = "student") -> DataFrame:
    """How much the student keeps of what retrieval gave the teacher, and of what the teacher knew alone."""
    hit = exact_match(F.col(student), F.col("reference"))
    rate = lambda s: F.coalesce(F.avg(F.when(F.col("stratum") == s, hit)), F.lit(0.0))
    size = lambda s: F.count_if(F.col("stratum") == s)
    return stratified.agg(rate("retrieval_dependent").alias("retention_rate"), rate("parametric").alias("parametric_preservation"), *(size(s).alias(f"n_{s}") for s in STRATA))


def independence_gap(wide: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """What the student gains from retrieval at inference; near zero means that it no longer needs it."""
    mean = lambda c: F.avg(exact_match(F.col(c), F.col("reference")))
    gap = mean("student_rag") - mean("student")
    return wide.agg(mean("student").alias("em_alone"), mean("student_rag").alias("em_with_retrieval"), gap.alias("gap"), (F.abs(gap) < tolerance).alias("independent"))


def evaluate_run(wide: DataFrame, models: tuple[str, ...]) -> dict[str, DataFrame]:
    """All results of an evaluation of predictions (example_id, reference, and a column a model): ``models`` (the means of
    each), ``table`` (a row a metric), and the retention probe where there are ``bare``, ``rag`` and ``student`` columns:
    ``probe``, ``strata``, and ``gap`` where there is ``student_rag``, too."""
    scores = save(measured(long_answers(wide, models)), "scores")
    out = {"models": evaluate_models(scores), "table": compare_models(scores)}
    if {"bare", "rag", "student"} <= set(wide.columns):
        wide = wide.repartition(shuffle_partitions(wide.sparkSession), "example_id")
        stratified = stratify(wide)
        out |= {"probe": retention(stratified), "strata": probe_strata(stratified)}
        if "student_rag" in wide.columns:
            out["gap"] = independence_gap(wide)
    return out


def bin_edges(n_bins: int = 10) -> list[float]:
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def calibration_bins(pairs: DataFrame, *groups: str, n_bins: int = 10) -> DataFrame:
    """Equal-width bins (lo, hi], the first closed: lo, hi, n, acc, conf. Empty bins are listed; no rows give no bins.
    Pairs (confidence, correct) meet the bin table in a broadcast range join."""
    edges = bin_edges(n_bins)
    bins = pairs.sparkSession.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(n_bins)], "bin int, lo double, hi double")
    c = F.col("confidence")
    inside = (c <= F.col("hi")) & ((c > F.col("lo")) | (F.col("lo") == 0) & (c >= 0))
    hit = pairs.join(F.broadcast(bins), inside).groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg("correct").alias("acc"), F.avg("confidence").alias("conf"))
    totals = pairs.groupBy(*groups).agg(F.count("*").alias("total")).where("total > 0")
    every = totals.crossJoin(F.broadcast(bins))  # bins: n_bins rows
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return every.join(hit, [*groups, "bin"], "left").select(*groups, "bin", "lo", "hi", zero("n"), zero("acc"), zero("conf"), "total")


def expected_calibration_error(pairs: DataFrame, *groups: str, n_bins: int = 10) -> DataFrame:
    """ece, signed overconfidence and n; pairs outside [0, 1] count in n only."""
    weight = F.col("n") / F.col("total")
    out = calibration_bins(pairs, *groups, n_bins=n_bins).groupBy(*groups).agg(
        F.sum(weight * F.abs(F.col("acc") - F.col("conf"))).alias("ece"), F.sum(weight * (F.col("conf") - F.col("acc"))).alias("overconfidence"), F.max("total").alias("n")
    )
    return out.where(F.col("n").isNotNull())
