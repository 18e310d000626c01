"""Analytics over soft labels in long form: one row per (batch, example_id, pos) with label and logit arrays.

Vector reductions happen in Arrow batches with NumPy, a matrix for all rows of one vocabulary size, so vocabulary-sized
arrays never leave their row; what remains are scalars that Spark groups by example and batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.session import save

IGNORE, EPS = -100, 1e-9


def _log_softmax(rows: pd.Series, temperature: float) -> list[np.ndarray]:
    arrays, out = list(rows), [np.zeros(0)] * len(rows)
    for at in _by_length(arrays):
        for i, x in zip(at, _log_softmax_rows(np.stack([arrays[i] for i in at]), temperature), strict=True):
            out[i] = x
    return out


def _by_length(arrays: list[np.ndarray]) -> list[list[int]]:
    """Numbers of the rows of each vocabulary size."""
    found: dict[int, list[int]] = {}
    for i, x in enumerate(arrays):
        found.setdefault(len(x), []).append(i)
    return list(found.values())


def _log_softmax_rows(m: np.ndarray, temperature: float) -> np.ndarray:
    m = m.astype(np.float64) / temperature
    m = m - m.max(axis=1, keepdims=True)
    return m - np.log(np.exp(m).sum(axis=1, keepdims=True))


def nll(temperature: float = 1.0):
    """(logits, label) -> negative log likelihood of the label; null where it is ignored."""

    @F.pandas_udf("double")
    def of(logits: pd.Series, label: pd.Series) -> pd.Series:
        return pd.Series([None if y == IGNORE else -x[int(y)] for x, y in zip(_log_softmax(logits, temperature), label, strict=True)], dtype="float64")

    return of


def entropy(temperature: float):
    @F.pandas_udf("double")
    def of(logits: pd.Series) -> pd.Series:
        return pd.Series([-(p := np.exp(x)) @ np.log(np.maximum(p, EPS)) for x in _log_softmax(logits, temperature)])

    return of


def kl(temperature: float, clamp_second: bool = False):
    """(teacher logits, student logits) -> sum of p_T (log p_T - log p_S)."""

    @F.pandas_udf("double")
    def of(teacher: pd.Series, student: pd.Series) -> pd.Series:
        out = []
        for t, s in zip(_log_softmax(teacher, temperature), _log_softmax(student, temperature), strict=True):
            p = np.exp(t)
            out.append(p @ (np.log(np.maximum(p, EPS)) - (np.log(np.maximum(np.exp(s), EPS)) if clamp_second else s)))
        return pd.Series(out)

    return of


def loss_terms(temperature: float):
    """(rag, bare, student, contrast logits, label, fusion weight) -> what ``kd_loss`` adds up of a position: the negative
    log likelihoods nr, nb and ce at temperature 1, and at ``temperature`` the divergences kr and kb of the teachers, kn
    of the teacher from the contrast, and kf of the fused teachers."""

    @F.pandas_udf("nr double, nb double, ce double, kr double, kb double, kn double, kf double")
    def of(rag: pd.Series, bare: pd.Series, student: pd.Series, contrast: pd.Series, label: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = np.full((len(rag), 7), np.nan)
        columns, labels, weights = [list(x) for x in (rag, bare, student, contrast)], label.to_numpy(), w.to_numpy()
        for at in _by_length(columns[0]):
            r, b, s, c = (np.stack([x[i] for i in at]) for x in columns)
            valid = np.flatnonzero(labels[at] != IGNORE)
            gold = labels[at][valid].astype(np.int64)
            for k, m in enumerate((r, b, s)):
                out[np.array(at)[valid], k] = -_log_softmax_rows(m, 1.0)[valid, gold]
            lr, lb, ls, lc = (_log_softmax_rows(m, temperature) for m in (r, b, s, c))
            pr, pb = np.exp(lr), np.exp(lb)
            out[at, 3] = (pr * (np.log(np.maximum(pr, EPS)) - ls)).sum(axis=1)
            out[at, 4] = (pb * (np.log(np.maximum(pb, EPS)) - ls)).sum(axis=1)
            out[at, 5] = (pr * (np.log(np.maximum(pr, EPS)) - np.log(np.maximum(np.exp(lc), EPS)))).sum(axis=1)
            fused = weights[at, None] * pr + (1 - weights[at, None]) * pb
            out[at, 6] = (fused * (np.log(np.maximum(fused, EPS)) - ls)).sum(axis=1)
        return pd.DataFrame(out, columns=["nr", "nb", "ce", "kr", "kb", "kn", "kf"])

    return of


def valid_mean(value: Column) -> Column:
    """Mean over the positions that are not ignored; 0 if there is none."""
    valid = F.col("label") != IGNORE
    return F.coalesce(F.sum(F.when(valid, value)), F.lit(0.0)) / F.greatest(F.count_if(valid), F.lit(1))


def example_nll(rows: DataFrame, *columns: str) -> DataFrame:
    """nll_<column> of each example."""
    with_nll = rows.select("batch", "example_id", "label", *(nll()(F.col(c), F.col("label")).alias(c) for c in columns))
    return with_nll.groupBy("batch", "example_id").agg(*(valid_mean(F.col(c)).alias(f"nll_{c}") for c in columns))


_TERMS = ("nr", "nb", "ce", "kr", "kb", "kn", "kf")
_POSITION = ("batch", "example_id", "pos")
_TEACHERS = ("rag", "bare", "student", "neg")


def _log_sums(blocks: DataFrame, temperature: float, columns: tuple[str, ...]) -> DataFrame:
    """A row of each position: for every column its log-sum-exp at temperature 1 (``<column>_1``) and at ``temperature``
    (``<column>_t``), and the label's logit (``<column>_gold``), put together from the blocks."""

    @F.pandas_udf("most double, one double, tempered double, gold double")
    def sums(logits: pd.Series, first: pd.Series, label: pd.Series) -> pd.DataFrame:
        out = np.full((len(logits), 4), np.nan)
        for i, (x, at, y) in enumerate(zip(logits, first, label, strict=True)):
            if len(x):
                x = x.astype(np.float64)
                most = x.max()
                out[i, :3] = most, np.exp(x - most).sum(), np.exp((x - most) / temperature).sum()
                if 0 <= y - at < len(x):
                    out[i, 3] = x[int(y - at)]
        return pd.DataFrame(out, columns=["most", "one", "tempered", "gold"])

    stats = blocks.select(*_POSITION, "label", *(sums(c, "first", "label").alias(c) for c in columns))
    known = lambda c: F.filter(F.collect_list(F.struct(f"{c}.most", f"{c}.one", f"{c}.tempered")), lambda x: x["most"].isNotNull() & ~F.isnan(x["most"]))
    parts = stats.groupBy(*_POSITION, "label").agg(*(known(c).alias(c) for c in columns), *(F.max(F.nanvl(f"{c}.gold", F.lit(None).cast("double"))).alias(f"{c}_gold") for c in columns))

    def log_sum(c: str, part: str, t: float) -> Column:
        most = F.array_max(F.transform(c, lambda x: x["most"]))
        return most / t + F.log(F.aggregate(c, F.lit(0.0), lambda a, x: a + x[part] * F.exp((x["most"] - most) / t)))

    both = (log_sum(c, part, t).alias(f"{c}_{n}") for c in columns for part, t, n in (("one", 1.0, "1"), ("tempered", temperature, "t")))
    return parts.select(*_POSITION, "label", *both, *(f"{c}_gold" for c in columns))


def example_nll_of_blocks(blocks: DataFrame, *columns: str) -> DataFrame:
    """``example_nll`` of large vocabularies in blocks: a row has the logits of the ids from ``first`` on (batch, example_id,
    pos, label, first, columns). No row, task or group holds a whole vocabulary; blocks may have any size, and no order."""
    sums = _log_sums(blocks, 1.0, columns)
    losses = sums.select("batch", "example_id", "label", *(F.when(F.col("label") != IGNORE, F.col(f"{c}_1") - F.col(f"{c}_gold")).alias(c) for c in columns))
    return losses.groupBy("batch", "example_id").agg(*(valid_mean(F.col(c)).alias(f"nll_{c}") for c in columns))


def retrieval_utility(rows: DataFrame) -> DataFrame:
    """How much the retrieved context lowers the likelihood loss of each example."""
    return example_nll(rows, "rag", "bare").select("batch", "example_id", (F.col("nll_bare") - F.col("nll_rag")).alias("utility"))


def utility_gate(utility: Column, tau: float = 1.0, floor: float = 0.05, ceiling: float = 0.95) -> Column:
    if tau <= 0 or not 0 <= floor < ceiling <= 1:
        raise ValueError("tau must be positive and 0 <= floor < ceiling <= 1")
    return floor + (ceiling - floor) / (1 + F.exp(-utility / tau))


def fusion_weights(rows: DataFrame, temperature: float = 4.0, kappa: float = 1.0, center: bool = True) -> DataFrame:
    """Adds ``w``: how far each position trusts the teacher with context, from the entropy gap around its batch mean."""
    gap = entropy(temperature)(F.col("bare")) - entropy(temperature)(F.col("rag"))
    return _weights_of_gaps(rows.withColumn("_gap", gap), kappa, center)


def _weights_of_gaps(rows: DataFrame, kappa: float, center: bool) -> DataFrame:
    """``w`` in place of ``_gap``."""
    batch = Window.partitionBy("batch")
    mean = F.coalesce(F.avg(F.when(F.col("label") != IGNORE, F.col("_gap"))).over(batch), F.avg("_gap").over(batch))
    centred = F.col("_gap") - mean if center else F.col("_gap")
    return rows.withColumn("w", 1 / (1 + F.exp(-centred / kappa))).drop("_gap")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def fuse(rag: pd.Series, bare: pd.Series, weight: pd.Series) -> pd.Series:
    """w p_rag + (1 - w) p_bare of two probability arrays."""
    return pd.Series([w * np.asarray(a) + (1 - w) * np.asarray(b) for a, b, w in zip(rag, bare, weight, strict=True)])


def softmax(temperature: float = 1.0):
    @F.pandas_udf("array<double>")
    def of(logits: pd.Series) -> pd.Series:
        return pd.Series([np.exp(x) for x in _log_softmax(logits, temperature)])

    return of


@dataclass(frozen=True)
class LossWeights:
    alpha: float = 0.5
    beta: float = 0.2
    gamma: float = 0.1
    delta: float = 0.2
    epsilon: float = 0.3
    temperature: float = 4.0
    margin: float = 0.5
    tau: float = 1.0
    floor: float = 0.05
    ceiling: float = 0.95
    kappa: float = 1.0
    center: bool = True
    gated: bool = True
    contrast: bool = True


def kd_loss(rows: DataFrame, p: LossWeights = LossWeights()) -> DataFrame:
    """The loss components of each batch: l_rag, l_kl, l_cra, l_ce, l_fuse, total, gate_mean, utility_mean, fusion_w_mean.
    A batch without valid labels has a null l_ce and total."""
    t = p.temperature
    negative = F.col("neg") if p.contrast else F.col("bare")
    fused = fusion_weights(rows, t, p.kappa, p.center) if p.epsilon > 0 else rows.withColumn("w", F.lit(0.0))
    terms = loss_terms(t)(F.col("rag"), F.col("bare"), F.col("student"), negative, F.col("label"), F.col("w"))
    scalars = fused.select("batch", "example_id", "label", "w", terms.alias("x")).select("batch", "example_id", "label", "w", *(F.nanvl(f"x.{c}", F.lit(None).cast("double")).alias(c) for c in ("nr", "nb", "ce", "kr", "kb", "kn")), (F.col("x.kf") if p.epsilon > 0 else F.lit(0.0)).alias("kf"))
    return _batch_losses(scalars, p)


def _batch_losses(scalars: DataFrame, p: LossWeights) -> DataFrame:
    """The components of each batch from the terms of its positions."""
    t = p.temperature
    valid = F.col("label") != IGNORE
    each = scalars.groupBy("batch", "example_id").agg(
        *(valid_mean(F.col(c)).alias(c) for c in ("nr", "nb", "kr", "kb", "kn", "kf")),
        F.sum("ce").alias("ce"), F.count_if(valid).alias("n"), F.sum(F.when(valid, F.col("w"))).alias("wv"), F.sum("w").alias("wa"), F.count("*").alias("na"),
    )
    utility = F.col("nb") - F.col("nr") if p.gated else F.lit(0.0)
    gate = utility_gate(utility, p.tau, p.floor, p.ceiling) if p.gated else F.lit(0.5)
    weigh = (gate, 1 - gate) if p.gated else (F.lit(1.0), F.lit(1.0))
    square = t * t
    batch = each.groupBy("batch").agg(
        (F.avg(weigh[0] * F.col("kr")) * square).alias("l_rag"), (F.avg(weigh[1] * F.col("kb")) * square).alias("l_kl"),
        F.greatest(F.lit(0.0), p.margin - F.avg("kn") * square).alias("l_cra"), F.when(F.sum("n") > 0, F.sum("ce") / F.sum("n")).alias("l_ce"),
        (F.avg("kf") * square).alias("l_fuse"), F.avg(gate).alias("gate_mean"), F.avg(utility).alias("utility_mean"),
        F.when(F.sum("n") > 0, F.sum("wv") / F.sum("n")).otherwise(F.sum("wa") / F.sum("na")).alias("fusion_w_mean"),
    )
    parts = ((p.alpha, "l_rag"), (p.beta, "l_kl"), (p.gamma, "l_cra"), (p.delta, "l_ce"), (p.epsilon, "l_fuse"))
    return batch.withColumn("total", sum((w * F.col(c) for w, c in parts), start=F.lit(0.0)))


def _divergences_of_block(temperature: float):
    """Logits of one block of the four models and their log-sum-exps at ``temperature`` -> the block's shares of the entropies
    er and eb of the teachers and of the divergences kr, kb and kn."""

    @F.pandas_udf("er double, eb double, kr double, kb double, kn double")
    def of(rag: pd.Series, bare: pd.Series, student: pd.Series, neg: pd.Series, zr: pd.Series, zb: pd.Series, zs: pd.Series, zn: pd.Series) -> pd.DataFrame:
        out = np.empty((len(rag), 5))
        for i, (columns, z) in enumerate(zip(zip(rag, bare, student, neg, strict=True), zip(zr, zb, zs, zn, strict=True), strict=True)):
            lr, lb, ls, ln = (np.asarray(x, np.float64) / temperature - total for x, total in zip(columns, z, strict=True))
            pr, pb = np.exp(lr), np.exp(lb)
            hr, hb = np.log(np.maximum(pr, EPS)), np.log(np.maximum(pb, EPS))
            out[i] = -(pr @ hr), -(pb @ hb), pr @ (hr - ls), pb @ (hb - ls), pr @ (hr - np.log(np.maximum(np.exp(ln), EPS)))
        return pd.DataFrame(out, columns=["er", "eb", "kr", "kb", "kn"])

    return of


def _fused_of_block(temperature: float):
    """The block's share of the divergence of the fused teachers from the student."""

    @F.pandas_udf("double")
    def of(rag: pd.Series, bare: pd.Series, student: pd.Series, zr: pd.Series, zb: pd.Series, zs: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for r, b, s, *z, share in zip(rag, bare, student, zr, zb, zs, w, strict=True):
            lr, lb, ls = (np.asarray(x, np.float64) / temperature - total for x, total in zip((r, b, s), z, strict=True))
            fused = share * np.exp(lr) + (1 - share) * np.exp(lb)
            out.append(fused @ (np.log(np.maximum(fused, EPS)) - ls))
        return pd.Series(out, dtype="float64")

    return of


def position_terms_of_blocks(blocks: DataFrame, p: LossWeights) -> DataFrame:
    """What ``kd_loss`` adds up of each position, from rows that hold the logits of the ids from ``first`` on (batch,
    example_id, pos, label, first, rag, bare, student, neg). Three passes over the blocks: log-sum-exps, then entropies and
    divergences, then, as the fusion weight takes the entropies of a whole batch, the fused divergence. What goes between
    them is some twenty numbers a position. Blocks may have any size and order; all four models have the same ones.
    Blocks without logits add nothing; a position that has only such blocks has null terms, and one whose batch, example or
    place is null is left out."""
    t, models = p.temperature, _TEACHERS if p.contrast else _TEACHERS[:3]
    blocks = blocks if p.contrast else blocks.withColumn("neg", F.col("bare"))
    sums = save(_log_sums(blocks, t, models), "log-sums")
    z = {c: F.col(f"{c}_t") for c in models} | ({} if p.contrast else {"neg": F.col("bare_t")})
    totals = sums.select(*_POSITION, *(f"{c}_t" for c in models))
    shares = blocks.join(totals, [*_POSITION]).select(*_POSITION, _divergences_of_block(t)(*(F.col(c) for c in _TEACHERS), *(z[c] for c in _TEACHERS)).alias("x"))
    summed = shares.groupBy(*_POSITION).agg(*(F.sum(f"x.{c}").alias(c) for c in ("er", "eb", "kr", "kb", "kn")))
    loss = lambda c: F.when(F.col("label") != IGNORE, F.col(f"{c}_1") - F.col(f"{c}_gold"))
    known = sums.join(summed, [*_POSITION]).withColumns({"nr": loss("rag"), "nb": loss("bare"), "ce": loss("student"), "_gap": F.col("eb") - F.col("er")})
    if p.epsilon <= 0:
        return known.withColumns({"w": F.lit(0.0), "kf": F.lit(0.0)}).select(*_POSITION, "label", "w", *_TERMS)
    weighed = save(_weights_of_gaps(known, p.kappa, p.center), "fusion-weights")
    fused = blocks.join(weighed.select(*_POSITION, "rag_t", "bare_t", "student_t", "w"), [*_POSITION])
    shares = fused.select(*_POSITION, _fused_of_block(t)("rag", "bare", "student", "rag_t", "bare_t", "student_t", "w").alias("kf"))
    return weighed.join(shares.groupBy(*_POSITION).agg(F.sum("kf").alias("kf")), [*_POSITION]).select(*_POSITION, "label", "w", *_TERMS)


def kd_loss_of_blocks(blocks: DataFrame, p: LossWeights | None = None) -> DataFrame:
    """``kd_loss`` of vocabularies of any size: no row, task or group holds a whole one."""
    p = p or LossWeights()
    return _batch_losses(position_terms_of_blocks(blocks, p), p)


def utility_summary(utilities: DataFrame) -> DataFrame:
    """mean, median, share of positive utilities, and a warning if retrieval helps fewer than half of the examples."""
    share = F.avg((F.col("utility") > 0).cast("double"))
    return utilities.agg(F.avg("utility").alias("mean"), F.percentile("utility", F.lit(0.5)).alias("median"), share.alias("positive_share"), (share < 0.5).alias("warning"))


def retrieval_shift(rows: DataFrame) -> DataFrame:
    """Mean KL of the teacher with context to the bare one over all rows, at temperature 1."""
    return rows.agg(F.avg("k").alias("shift")) if "k" in rows.columns else rows.select(kl(1.0, True)(F.col("rag"), F.col("bare")).alias("k")).agg(F.avg("k").alias("shift"))


def sequence_confidence(steps: DataFrame, pad_id: int, eos_id: int | None = None) -> DataFrame:
    """exp of the mean log probability of the chosen tokens that are neither pad nor eos, per sequence."""
    counted = F.col("token") != pad_id
    if eos_id is not None:
        counted = counted & (F.col("token") != eos_id)
    chosen = steps.select("sequence_id", counted.alias("c"), nll()(F.col("logits"), F.col("token")).alias("nll"))
    mean = F.coalesce(F.sum(F.when(F.col("c"), -F.col("nll"))), F.lit(0.0)) / F.greatest(F.count_if("c"), F.lit(1))
    return chosen.groupBy("sequence_id").agg(F.exp(mean).alias("confidence"))
