"""License scans with a trained paragraph classifier.

A softmax regression over hashed word one- to three-grams tells licence families apart. It is trained here: licence
paragraphs are the templates below, varied by dropping words and by surrounding them with words of the corpus; the
``unknown`` class is all segments of a bounded, hashed sample of documents. A temperature is fitted on held-back examples
so that the probabilities are calibrated, and a threshold below which a segment is unknown. A prediction counts only
if most word pairs of one of the family's templates are found close together in the paragraph, and half of those that
tell the template from other families.

A paragraph is the lines up to one without words, so that wrapped notices are whole. Every paragraph of every text is
scored in segments of at most ``SEGMENT`` words that overlap by the longest template, and every line also alone; the
comparison with templates sees the segment and its neighbours of the same paragraph.

Defined results: null, empty and wordless texts have no findings; every family of which a template is found is reported,
with the line on which the notice begins; of families that rest on the same word pairs the more probable one is; a notice
found in several segments is one finding; repeated rows are scanned alike; an empty table has no findings; other columns
are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.kernel import Words, blocks, mix, utf8

#: (family, template): short forms and notices in common use, written as lower-case words. Fixed texts.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "spdx license identifier mit"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "spdx license identifier apache 2 0"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", "released under the gnu gpl v2"),
    ("gpl", "spdx license identifier gpl 3 0 or later"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("lgpl", "spdx license identifier lgpl 2 1"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("agpl", "spdx license identifier agpl 3 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd 3 clause license"),
    ("bsd", "use of this source code is governed by a bsd style license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work cc0 1 0 universal"),
    ("cc0", "released under cc0 1 0 public domain dedication"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl", "licensed under the mozilla public license version 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "licensed under the isc license"),
    ("bsd", "spdx license identifier bsd 3 clause"),
    ("mpl", "spdx license identifier mpl 2 0"),
    ("isc", "spdx license identifier isc"),
    ("cc0", "spdx license identifier cc0 1 0"),
    ("cc-by", "spdx license identifier cc by 4 0"),
    ("unlicense", "spdx license identifier unlicense"),
    ("eupl", "licensed under the european union public licence version 1 2"),
    ("eupl", "spdx license identifier eupl 1 2"),
    ("epl", "licensed under the eclipse public license version 2 0"),
    ("epl", "spdx license identifier epl 2 0"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("wtfpl", "spdx license identifier wtfpl"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without prior written permission"),
    ("proprietary", "copyright all rights reserved unauthorized copying of this file is strictly prohibited"),
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *dict.fromkeys(f for f, _ in TEMPLATES)]

SAMPLE_DOCUMENTS = 1_000
BUCKETS = 1 << 15
SEGMENT = 40
CONTEXT = 24
MIN_SIMILARITY = 0.6
#: Grams of fewer training examples have no weight: else a notice inside a sampled document drowns in what was learned by heart.
MIN_EXAMPLES = 3
STRIDE = SEGMENT - max(len(t.split()) for _, t in TEMPLATES)

#: Separators: all of ASCII but letters and digits.
SEPARATORS = np.array([b < 128 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_PAIR, _TRIPLE = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC3A5C85C97CB3127)


def grams(hashes: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of one- to three-grams inside segments, and the segment of each; both in segment order."""
    features, owner = [hashes], [segment]
    for n, lane in ((2, _PAIR), (3, _TRIPLE)):
        m = max(0, len(hashes) - n + 1)
        joined = np.zeros(m, np.uint64)
        for j in range(n):
            joined = (joined + hashes[j : j + m]) * lane
        same = segment[:m] == segment[n - 1 :] if m else np.zeros(0, bool)
        features.append(mix(joined[same]))
        owner.append(segment[:m][same])
    feature, of = np.concatenate(features), np.concatenate(owner)
    order = np.argsort(of, kind="stable")
    return (feature[order] % np.uint64(BUCKETS)).astype(np.int64), of[order]


def _text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(pa.array(texts, pa.large_string()))
    words = Words(data, off, SEPARATORS)
    return grams(words.hashes(), np.repeat(np.arange(len(texts)), np.diff(words.first)))


@dataclass
class Model:
    weights: np.ndarray  # BUCKETS x families
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def logits(self, feature: np.ndarray, owner: np.ndarray, n: int, count: np.ndarray | None = None) -> np.ndarray:
        """``count``: grams of each text, if ``feature`` lacks some."""
        count = np.bincount(owner, minlength=n) if count is None else count
        out = np.stack([np.bincount(owner, w[feature], n) for w in np.ascontiguousarray(self.weights.T)], axis=1)
        return out / np.sqrt(np.maximum(count, 1))[:, None] + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = np.exp((logits - logits.max(axis=1, keepdims=True)) / self.temperature)
        return z / z.sum(axis=1, keepdims=True)


def examples(paragraphs: list[str], seed: int = 7, copies: int = 24) -> tuple[list[str], np.ndarray]:
    """Varied templates and unknown segments, with class numbers."""
    rng = random.Random(seed)
    pool = [w for p in paragraphs for w in p.split()] or ["text"]
    texts, classes = [], []
    for family, template in TEMPLATES:
        for k in range(copies):
            words = template.split()
            if k and len(words) > 6:
                words = [w for w in words if rng.random() > 0.06]
            extra = rng.randrange(max(0, SEGMENT - len(words)) + 1) if k % 3 else 0  # as much as a segment holds
            before = rng.randrange(extra + 1)
            around = [rng.choices(pool, k=n) for n in (before, extra - before)]
            texts.append(" ".join([*around[0], *words, *around[1]]))
            classes.append(FAMILIES.index(family))
    for p in paragraphs:
        texts.append(p)
        classes.append(0)
    return texts, np.array(classes)


def train(paragraphs: list[str], epochs: int = 120, rate: float = 0.5, ridge: float = 1e-5) -> Model:
    """Softmax regression by AdaGrad on all examples but every fifth, which set the temperature and the threshold."""
    texts, y = examples(paragraphs)
    feature, owner = _text_features(texts)
    held = np.arange(len(texts)) % 5 == 4
    model = Model(np.zeros((BUCKETS, len(FAMILIES))), np.zeros(len(FAMILIES)))
    keep = ~held[owner]
    number = np.cumsum(~held) - 1
    f, o, target = feature[keep], number[owner[keep]], np.eye(len(FAMILIES))[y[~held]]
    count = np.bincount(o, minlength=len(target))
    common = np.bincount(np.unique(f * len(target) + o) // len(target), minlength=BUCKETS)[f] >= MIN_EXAMPLES
    used, f = np.unique(f[common], return_inverse=True)
    o = o[common]
    part = Model(np.zeros((len(used), len(FAMILIES))), model.bias)
    balance = 1 / np.maximum(1, np.bincount(y[~held], minlength=len(FAMILIES)))[y[~held]]
    balance *= len(target) / balance.sum()
    scale = 1 / np.sqrt(np.maximum(1, count))
    squares, bias_squares = np.full_like(part.weights, 1e-8), np.full(len(FAMILIES), 1e-8)
    for _ in range(epochs):
        error = (part.probabilities(part.logits(f, o, len(target), count)) - target) * balance[:, None]
        scaled = np.ascontiguousarray((error * scale[:, None]).T)
        step = np.stack([np.bincount(f, e[o], len(used)) for e in scaled], axis=1) / len(target) + ridge * part.weights
        squares += step**2
        part.weights -= rate * step / np.sqrt(squares)
        step = error.mean(axis=0)
        bias_squares += step**2
        part.bias -= rate * step / np.sqrt(bias_squares)
    model.weights[used], model.bias = part.weights, part.bias
    logits = model.logits(feature, owner, len(texts))[held]
    truth = y[held]

    def loss(t: float) -> float:
        p = Model(model.weights, model.bias, t).probabilities(logits)
        return -np.log(np.maximum(p[np.arange(len(truth)), truth], 1e-12)).mean()

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss)
    known = 1 - model.probabilities(logits)[:, 0]
    worst = known[truth == 0].max() if (truth == 0).any() else 0.5
    model.threshold = float(np.clip((worst + np.quantile(known[truth != 0], 0.05)) / 2, 0.3, 0.9)) if (truth != 0).any() else 0.5
    return model


def _ngrams(words: list[str], n: int = 2) -> set[tuple[str, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


_SETS = [(family, k, _ngrams(template.split())) for k, (family, template) in enumerate(TEMPLATES)]
_TEMPLATES_OF: dict[tuple[str, ...], list[int]] = {}
for _, _k, _pairs in _SETS:
    for _pair in _pairs:
        _TEMPLATES_OF.setdefault(_pair, []).append(_k)


#: Of each template the word pairs that no template of another family has; half of them must be found.
_OWN = [{p for p in pairs if all(_SETS[k][0] == family for k in _TEMPLATES_OF[p])} for family, _, pairs in _SETS]


def places(words: list[str]) -> list[tuple[int, float, list[int]]]:
    """Where templates stand in ``words``: template, share of its word pairs found within twice its length, and where
    the pairs found begin. A template found several times has several places."""
    hits: dict[int, list[int]] = {}
    for i in range(len(words) - 1):
        for k in _TEMPLATES_OF.get((words[i], words[i + 1]), ()):
            hits.setdefault(k, []).append(i)
    out = []
    for k, at in sorted(hits.items()):
        pairs = len(_SETS[k][2])
        while len(at) >= MIN_SIMILARITY * pairs:
            best: list[int] = []
            for x, i in enumerate(at):
                near: dict[tuple[str, str], int] = {}
                for j in at[x:]:
                    if j - i < 2 * (pairs + 1):
                        near.setdefault((words[j], words[j + 1]), j)
                if (len(near), -(max(near.values()) - i)) > (len(best), -(best[-1] - best[0]) if best else 0):
                    best = sorted(near.values())
            if len(best) < MIN_SIMILARITY * pairs:
                break
            if 2 * len(_OWN[k].intersection((words[j], words[j + 1]) for j in best)) >= max(1, len(_OWN[k])):
                out.append((k, len(best) / pairs, best))
            at = [i for i in at if not best[0] <= i <= best[-1]]
    return out


def fit(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Model:
    """Trains on the templates and on all segments of at most ``sample_documents`` documents (taken by hash) as unknown."""
    chosen = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents)
    sampled = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id", "left_semi")
    rows = sampled.where(F.col("text").isNotNull()).orderBy("doc_id", "text").collect()  # ids first: at most sample_documents texts reach the driver
    known = [pairs for _, _, pairs in _SETS]
    out = []
    for r in rows:
        lines = ["".join(c if c.isalnum() else " " for c in line.lower()).split() for line in r["text"].split("\n")]
        for paragraph in (list(chain.from_iterable(g)) for full, g in groupby(lines, bool) if full):
            for words in (paragraph[a : a + SEGMENT] for a in range(0, len(paragraph), SEGMENT)):
                seen = _ngrams(words)
                if not any(len(pairs & seen) / len(pairs) >= 0.3 for pairs in known):
                    out.append(" ".join(words))
    return train(out)


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per licence notice: doc_id, paragraph (number of the line on which it begins, from 0), family, probability, template_id, similarity."""
    packed = model.weights.astype(np.float32), model.bias, model.temperature, model.threshold
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # BUCKETS x families numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                part = off[lo : hi + 1] - off[lo]
                found = _findings(data[off[lo] : off[hi]], part, own)
                names = ["doc_id", "paragraph", "family", "probability", "template_id", "similarity"]
                arrays = [pa.array([ids[lo + k] for k in found[0]], pa.int64()), pa.array(found[1], pa.int32()), pa.array(found[2], pa.string()), pa.array(found[3], pa.float64()), pa.array(found[4], pa.int32()), pa.array(found[5], pa.float64())]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, paragraph int, family string, probability double, template_id int, similarity double"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _findings(data: np.ndarray, off: np.ndarray, model: Model) -> list[list]:
    words = Words(data, off, SEPARATORS)
    out: list[list] = [[], [], [], [], [], []]
    if not len(words.starts):
        return out
    breaks = np.flatnonzero(data == 10)
    line = np.searchsorted(breaks, words.starts)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(words.first))
    n, other = len(doc), doc[1:] != doc[:-1]
    begin, paragraph = _spans_of(other | (line[1:] > line[:-1] + 1))
    line_begin, line_number = _spans_of(other | (line[1:] != line[:-1]))
    pieces = [_segments(begin, paragraph, n, STRIDE), _segments(line_begin, line_number, n, SEGMENT)]
    start, end = (np.concatenate(x) for x in zip(*pieces, strict=True))
    p = model.probabilities(_segment_logits(words.hashes(), paragraph, start, end, model))
    ends = np.append(begin[1:], n)
    found: dict[tuple[int, tuple[int, ...]], tuple[float, int, float]] = {}  # template, word pairs: best
    for s in np.flatnonzero(1 - p[:, 0] >= model.threshold).tolist():
        par = int(paragraph[start[s]])
        a, b = max(int(begin[par]), int(start[s]) - CONTEXT), min(int(ends[par]), int(end[s]) + CONTEXT)
        text = [words.low[i:j].tobytes().decode("utf-8", "replace") for i, j in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)]
        for template, share, at in places(text):
            key = template, tuple(a + i for i in at)
            found[key] = max(found.get(key, (0.0, 0, 0.0)), (float(p[s, FAMILIES.index(TEMPLATES[template][0])]), template, share))
    notices: dict[int, list[tuple[str, float, int, float, set[int]]]] = {}  # by document
    for (template, at), (prob, _, share) in sorted(found.items(), key=lambda x: (-x[1][0], -x[1][2], -len(x[0][1]), x[0])):
        family, here = TEMPLATES[template][0], notices.setdefault(int(doc[at[0]]), [])
        for same, *_, taken in here:
            shared = len(taken.intersection(at))
            if shared and same == family or 2 * shared > min(len(at), len(taken)):
                if same == family:
                    taken.update(at)
                break
        else:
            here.append((family, prob, template, share, set(at)))
    rows = [(d, int(line[min(at)] - np.searchsorted(breaks, off[d])), family, prob, template, share) for d, x in notices.items() for family, prob, template, share, at in x]
    for row in sorted(rows):
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return out


def _spans_of(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the spans that begin where ``new`` says (from the second word on), and the span of each word."""
    new = np.concatenate(([True], new))
    return np.flatnonzero(new), np.cumsum(new) - 1


def _segments(begin: np.ndarray, span: np.ndarray, n: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the segments of each span, ``stride`` words apart, up to the first that reaches its end."""
    ends = np.append(begin[1:], n)
    within = np.arange(n) - begin[span]
    start = np.flatnonzero((within % stride == 0) & ((within == 0) | (within - stride + SEGMENT < (ends - begin)[span])))
    return start, np.minimum(start + SEGMENT, ends[span[start]])


def _segment_logits(hashes: np.ndarray, paragraph: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model) -> np.ndarray:
    """As ``Model.logits`` of the segments' ``grams``, from running sums of the weights of the grams that begin at each
    word, less those of the grams that cross a segment's end."""
    n, none = len(hashes), np.zeros((1, len(FAMILIES)), model.weights.dtype)
    weights, longer = np.concatenate((model.weights, none)), []
    for size, lane in ((2, _PAIR), (3, _TRIPLE)):
        m, at = max(0, n - size + 1), np.full(n, BUCKETS, np.int64)
        joined = np.zeros(m, np.uint64)
        for j in range(size):
            joined = (joined + hashes[j : j + m]) * lane
        at[:m] = np.where(paragraph[:m] == paragraph[n - m :], (mix(joined) % np.uint64(BUCKETS)).astype(np.int64), BUCKETS)
        longer.append(at)
    pair, triple = longer
    total = np.zeros((n + 1, len(FAMILIES)))
    np.cumsum(weights[(hashes % np.uint64(BUCKETS)).astype(np.int64)] + weights[pair] + weights[triple], axis=0, dtype=np.float64, out=total[1:])
    size = end - start
    out = total[end] - total[start] - weights[pair[end - 1]] - weights[triple[end - 1]]
    out -= weights[np.where(size > 1, triple[np.maximum(end - 2, 0)], BUCKETS)]
    count = size + np.maximum(size - 1, 0) + np.maximum(size - 2, 0)
    return out / np.sqrt(count)[:, None] + model.bias
