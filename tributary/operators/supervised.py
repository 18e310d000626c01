"""Supervised examples from records and the user's tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.functions import sft
from tributary.functions.text import build_prompt, filled


def tokenize_records(records: DataFrame, make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], eos: int | None, max_length: int) -> DataFrame:
    """rec_id, input_ids, labels (the prompt masked), attention_mask. ``make_tokenizer()`` is called once a task and returns
    a function from a list of texts to their ids; prompts and outputs are whole, only ``max_length`` cuts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make_tokenizer()
        for batch in batches:
            yield pd.Series(encode(batch.tolist()))

    ids_of = F.pandas_udf(run, "array<int>", F.PandasUDFType.SCALAR_ITER)
    prompt = build_prompt(F.col("instruction"), F.col("input"))
    encoded = records.select("rec_id", ids_of(prompt).alias("_prompt"), ids_of(filled(F.col("output"))).alias("_answer"))
    ids, labels, mask = sft.supervised(F.col("_prompt"), F.col("_answer"), eos, max_length)
    return encoded.select("rec_id", ids.alias("input_ids"), labels.alias("labels"), mask.alias("attention_mask"))
