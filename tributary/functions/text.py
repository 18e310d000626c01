"""String columns: hygiene, comparison keys, prompts, answer normalisation."""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The prompt layouts.
ALPACA_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request."
)
ALPACA_PLAIN = "Below is an instruction that describes a task. Write a response that appropriately completes the request."
#: A left-over control character: everything below space but tab, newline and return, and delete.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """A string, empty for null."""
    return F.coalesce(text.cast("string"), F.lit(""))


def normal_field(value: Column, kind: str = "string") -> Column:
    """A record field as text: null, and 0 or false of typed columns, are empty; else stripped."""
    text = F.when(value == F.lit(0).cast(kind), "").otherwise(value.cast("string")) if kind not in ("string",) else value
    return strip(filled(text))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def strip_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def normal_space(text: Column) -> Column:
    """NFKC, with white space collapsed to single spaces."""
    return strip(F.regexp_replace(nfkc(filled(text)), r"(?U)\s+", " "))


def clean(text: Column) -> Column:
    """Control characters removed, then NFKC, then white space collapsed. Null becomes empty."""
    return normal_space(strip_control(filled(text)))


_NOT_WORD = re.compile(r"[^\w\s]")


def canonical_text(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    return " ".join(_NOT_WORD.sub(" ", folded).split())


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """The key under which copies that differ in case, width, punctuation or spacing are equal."""
    return text.map(canonical_text)


def record_key(instruction: Column, given: Column) -> Column:
    return canonical(F.concat_ws(" ", filled(instruction), filled(given)))


@F.arrow_udf(T.StringType())
def key_digest(text: pa.Array) -> pa.Array:
    """md5 of the key of a text, text by text out of Arrow: a task never holds the texts of a batch, or their keys, as
    Python strings."""
    return pa.array((hashlib.md5(canonical_text(x.as_py()).encode()).hexdigest() for x in text), pa.string())


def fingerprint(text: Column) -> Column:
    return F.md5(canonical(text))


def passage_id(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def character_shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-character windows of a canonical text; a shorter text is one shingle."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.int64)
    n = max(1, len(points) - k + 1)
    rolled = np.full(n, min(k, len(points)), np.uint64)
    for j in range(min(k, len(points))):
        rolled = (rolled ^ points[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled.view(np.int64))


def shingle_hashes(k: int = 5):
    """canonical text -> array<long>."""

    @F.pandas_udf("array<long>")
    def hashes(text: pd.Series) -> pd.Series:
        return text.map(lambda x: character_shingles(x, k))

    return hashes


def build_prompt(instruction: Column, given: Column) -> Column:
    """Alpaca layout; the variant with an input where there is one."""
    body, extra = strip(filled(instruction)), strip(filled(given))
    with_input = F.concat(F.lit(f"{ALPACA_INPUT}\n\n### Instruction:\n"), body, F.lit("\n\n### Input:\n"), extra, F.lit("\n\n### Response:\n"))
    return F.when(extra != "", with_input).otherwise(F.concat(F.lit(f"{ALPACA_PLAIN}\n\n### Instruction:\n"), body, F.lit("\n\n### Response:\n")))


def to_messages(instruction: Column, given: Column) -> Column:
    body, extra = strip(filled(instruction)), strip(filled(given))
    content = F.when(extra != "", F.concat(body, F.lit("\n\n"), extra)).otherwise(body)
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def rag_prompt(question: Column, contexts: Column, n_contexts: int = 3) -> Column:
    """Numbered contexts, padded or cut to n_contexts, before the question."""
    lines = [F.concat(F.lit(f"Context {i + 1}: "), F.coalesce(F.get(contexts, F.lit(i)), F.lit("")), F.lit("\n")) for i in range(n_contexts)]
    return F.concat(*lines, F.lit("Question: "), question, F.lit("\nAnswer:"))


def bare_prompt(question: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def student_input(question: Column) -> Column:
    return F.concat(F.lit("question: "), question)


def qa_normalize(text: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    plain = F.translate(F.lower(filled(text)), string.punctuation, "")
    article = r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])"
    return strip(F.regexp_replace(F.regexp_replace(plain, article, " "), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """White-space separated words; none for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def let(value: Column, use) -> Column:
    """use(value), with value computed once: inside lambdas an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ngrams(tokens: Column, n: int) -> Column:
    """All runs of n tokens, joined by a space; none if there are fewer."""

    def runs(t: Column) -> Column:
        last = F.size(t) - n + 1
        every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))
        return F.when(last > 0, every).otherwise(F.array().cast("array<string>"))

    return let(tokens, runs)
