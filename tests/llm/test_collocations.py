"""Phrase counts and collocations against brute force, with tries that burst and spill all the time."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tributary.llm import collocations

DOCS = "doc_id long, text string, lang string, phrase string, f long"


def table(spark, rows, slices=3):
    return spark.createDataFrame([(i, t, lang, "x", 1) for i, (t, lang) in enumerate(rows)], DOCS).repartition(slices)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_counts(rows):
    counts = {}
    for text, lang in rows:
        own = counts.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            words = re.findall("[^ \t]+", piece)
            for k in (1, 2, 3):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts


def brute(rows, top=2000, least=10, cover=50):
    for lang, f in brute_counts(rows).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        chosen = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in chosen.items():
            if any(q[i : i + len(p)] == p and 100 * c >= cover * a for q, c in chosen.items() if len(q) > len(p) for i in range(len(q) - len(p) + 1)):
                continue
            score, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            yield lang, rank, phrase.decode(), -a, left, right, n, -score


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Der", "der", "É", "é", "😀", " ", "a" * 300, "\x00", "don't"]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", "? ", " ; "]
    out = []
    for k in range(150):
        text = "".join(rng.choice(words[: 3 + k % 47]) + rng.choice(marks) for _ in range(rng.randrange(90)))
        out.append((text, rng.choice(["en", "de", "und", None, ""])))
    out += [(t, "en") for t in (None, "", " ", "...", "\n \n", "one")] + [("New York city hall", "en")] * 12 + [("new YORK", "en")] * 3
    return out + [("a a a a a a a a a a a a a a a", "xx"), ("b c", "only"), (" ".join(["x y z"] * 4000), "long")]


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("burst, entries, vocabulary, block", [(1 << 16, 10**6, 10**6, 4 << 20), (3, 40, 30, 64), (5, 10**6, 10, 1000), (2, 1, 10**6, 7)])
def test_counts_are_the_brute_force_counts(spark, rows, monkeypatch, burst, entries, vocabulary, block):
    found = []
    monkeypatch.setattr(collocations, "BLOCK", block)
    counts = collocations.Counts(3, 3, burst, entries, vocabulary)
    runs = []
    for text, lang in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        runs += list(counts.add("und" if lang is None else lang, data, np.array([0, len(data)])))
    runs += list(counts.flush())
    parts = {}
    for r in runs:
        part, lang, *raw = (c[0].as_py() for c in r.columns)
        parts.setdefault((part, lang), []).append(raw)
    totals = Counter()
    for (_, lang), raw in parts.items():
        merged, total = collocations._merge_runs(*map(list, zip(*raw, strict=True)), 1)
        totals[lang] += total
        found += [(lang, tuple(p.split(b" ")), n) for phrases, sums in merged for p, n in zip(phrases.to_pylist(), sums.tolist(), strict=True)]
    expected = {lang: {tuple(w.encode() for w in p): c for p, c in own.items()} for lang, own in brute_counts(rows).items()}
    assert len(found) == len({x[:2] for x in found})
    assert {(lang, p): n for lang, p, n in found} == {(lang, p): n for lang, own in expected.items() for p, n in own.items()}
    assert all(totals[lang] == sum(n for p, n in own.items() if len(p) == 1) for lang, own in expected.items())


def test_a_small_trie_bursts_into_subtrees():
    node = collocations.Node(0)
    keys = np.sort(np.array([(7 << 42) | (k + 1 << 21) for k in range(100)] + [k << 42 for k in range(20)], np.int64))
    for _ in range(8):
        node.add(keys, 10)
    held = {k: c for box in node.boxes() for k, c in box.items()}
    assert held == dict.fromkeys(keys.tolist(), 8)
    inner = [c for c in node.children if isinstance(c, collocations.Node)]
    assert len(inner) == 1 and len(inner[0].children) > 4 and node.starts == sorted(set(node.starts))
    assert max(len(b) for b in node.boxes()) <= 10


@pytest.mark.parametrize("limits", [{}, {"burst": 4, "max_entries": 50, "max_vocabulary": 25}])
def test_phrase_counts_of_a_table(spark, rows, limits):
    found = collocations.phrase_counts(table(spark, rows), 10, **limits)
    expected = [(lang, len(p), " ".join(p), n) for lang, own in brute_counts(rows).items() for p, n in own.items() if n >= 10]
    assert plain(found.where("width > 0")) == sorted(expected, key=str)


def test_collocations_are_the_brute_force_ones(spark, rows):
    assert plain(collocations.collocations(table(spark, rows))) == sorted(brute(rows), key=str)
    assert plain(collocations.collocations(table(spark, rows), top=3, min_count=4, cover=80)) == sorted(brute(rows, 3, 4, 80), key=str)


def test_tables_without_candidates(spark):
    assert collocations.collocations(table(spark, [("a b", "en"), (None, None)])).count() == 0
    assert collocations.collocations(table(spark, [])).count() == 0


def test_partitions_of_millions_of_words():
    words = [b"%d" % k for k in range(2_200_000)]
    counts = collocations.Counts(1, max_vocabulary=10**7, max_entries=10**8)
    data = b" ".join(words + words[:3])
    runs = [*counts.add("en", np.frombuffer(data, np.uint8), np.array([0, len(data)])), *counts.flush()]
    raw = [[r.column(c)[0].as_py() for c in (2, 3, 4)] for r in runs]
    merged, total = collocations._merge_runs(*map(list, zip(*raw, strict=True)), 2)
    assert total == len(words) + 3 and [(p.to_pylist(), n.tolist()) for p, n in merged] == [([b"0", b"1", b"2"], [2] * 3), ([b"0 1", b"1 2"], [2] * 2), ([b"0 1 2"], [2])]


def test_scores_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_998), (3_037_000_501, 3_037_000_502, 3_037_000_503), (10, 10, 10**14)]
    df = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations._score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 10**6 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())
