"""Answer metrics as columns: exact match, token F1, smoothed BLEU-4.

Answers are normalised by column functions; the multiset counts come from one Arrow pass over the normal forms.
"""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tributary.functions.text import qa_normalize

EPSILON = 0.1


def exact_match(prediction: Column, reference: Column) -> Column:
    return (qa_normalize(prediction) == qa_normalize(reference)).cast("double")


def _common(a: list, b: list) -> int:
    """Size of the multiset intersection."""
    both = set(a).intersection(b)
    if len(both) in (0, len(a), len(b)):  # nothing, or each item of one side once
        return len(both)
    return sum((Counter(a) & Counter(b)).values())


def _f1(hyp: list[str], ref: list[str], common: int) -> float:
    # 2 p r / (p + r) with p = common / |hyp| and r = common / |ref|
    return 2.0 * common / (len(hyp) + len(ref)) if hyp and ref else float(hyp == ref)


def _bleu4(hyp: list[str], ref: list[str], common: int, epsilon: float) -> float:
    """Uniform weights to four-grams; a count of zero becomes epsilon, no shared word gives 0."""
    if not common:
        return 0.0
    logs, same = 0.0, hyp == ref
    for n in range(1, 5):
        size = len(hyp) - n + 1
        if n > 1 and common:  # without common runs there are no longer ones
            common = max(size, 0) if same else _common(*(list(zip(*(x[i:] for i in range(n)), strict=False)) for x in (hyp, ref)))
        logs += 0.25 * math.log((common or epsilon) / max(size, 1))
    brevity = 1.0 if len(hyp) > len(ref) else math.exp(1 - len(ref) / len(hyp))
    return brevity * math.exp(logs)


def answer_metrics(prediction: Column, reference: Column, epsilon: float = EPSILON) -> Column:
    """exact_match, f1 and bleu4 of an answer; a null answer is an empty one."""

    @F.pandas_udf("exact_match double, f1 double, bleu4 double")
    def of(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
        rows = []
        for p, r in zip(prediction, reference, strict=True):
            hyp, ref = p.split(), r.split()
            common = _common(hyp, ref)
            rows.append((float(p == r), _f1(hyp, ref, common), _bleu4(hyp, ref, common, epsilon)))
        return pd.DataFrame(rows, columns=["exact_match", "f1", "bleu4"], dtype="float64")

    return of(qa_normalize(prediction), qa_normalize(reference))


@F.pandas_udf(T.DoubleType())
def _f1_of(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    sides = ((p.split(), r.split()) for p, r in zip(prediction, reference, strict=True))
    return pd.Series([_f1(hyp, ref, _common(hyp, ref)) for hyp, ref in sides], dtype="float64")


def token_f1(prediction: Column, reference: Column) -> Column:
    return _f1_of(qa_normalize(prediction), qa_normalize(reference))


def bleu4(prediction: Column, reference: Column, epsilon: float = EPSILON) -> Column:
    return answer_metrics(prediction, reference, epsilon)["bleu4"]
