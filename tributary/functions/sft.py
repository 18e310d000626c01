"""Supervised-example arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def _ints(value: Column) -> Column:
    return value.cast("array<int>")


def with_eos(response: Column, eos: int | None) -> Column:
    """The response, closed by eos unless it is already."""
    response = _ints(response)
    if eos is None:
        return response
    closed = (F.size(response) > 0) & (F.element_at(response, -1) == eos)
    return F.when(closed, response).otherwise(F.concat(response, F.array(F.lit(eos))))


def supervised(prompt: Column, response: Column, eos: int | None, max_length: int) -> tuple[Column, Column, Column]:
    """input_ids, labels (the prompt masked) and attention_mask, cut on the right."""
    answer = with_eos(response, eos)
    ids = F.slice(F.concat(_ints(prompt), answer), 1, max_length)
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), answer), 1, max_length)
    return ids, labels, F.transform(ids, lambda _: F.lit(1))


def is_trainable(labels: Column) -> Column:
    return F.exists(labels, lambda x: x != IGNORE)


def pad(ids: Column, length: int, value: int) -> Column:
    return F.slice(F.concat(_ints(ids), F.array_repeat(F.lit(value), length)), 1, length)


def padded_labels(ids: Column, length: int, pad_id: int) -> Column:
    """Padded; every pad id, also one that was a real token, is masked."""
    return F.transform(pad(ids, length, pad_id), lambda x: F.when(x == pad_id, IGNORE).otherwise(x))


def attention(ids: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: (i <= F.size(ids)).cast("int"))


def shift_right(labels: Column, pad_id: int) -> Column:
    """Decoder input: masks become pad, everything moves one place to the right."""
    shown = F.transform(labels, lambda x: F.when(x == IGNORE, pad_id).otherwise(x))
    return F.concat(F.array(F.lit(pad_id)), F.slice(shown, F.lit(1), F.greatest(F.size(labels) - 1, F.lit(0))))
