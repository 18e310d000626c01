"""Alignment of two tokenizers against a brute-force version that encodes and aligns whole texts."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tributary.llm import align

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, n_a long, links string, is_count boolean"


def byte_alphabet():
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(rest)}


@pytest.fixture(scope="module")
def encode():
    a, b, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True

    def of_a(k):
        return bytes(back[c] for c in a.id_to_token(k))

    def of_b(k):
        piece = b.id_to_piece(k)
        byte = re.fullmatch("<0x(..)>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def tokens(text):
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return [(k, of_a(k)) for k in x], [(k, of_b(k)) for k in y]

    return tokens


def brute(encode, rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        if not text:
            docs.append((doc_id, 0, 0, [], []))
            continue
        a, b = encode(text)
        raw = (" " + text).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            docs.append((doc_id, 0, 0, [], []))
            continue
        ends = [{}, {}]
        for side, tokens in enumerate((a, b)):
            at = 0
            for n, (_, x) in enumerate(tokens):
                at += len(x)
                ends[side][at] = n
        common = sorted(ends[0].keys() & ends[1].keys())
        links = [(a[ends[0][e]][0], b[ends[1][e]][0]) for e in common]
        groups, i, j = [], 0, 0
        for e in common:
            p, q = ends[0][e] + 1, ends[1][e] + 1
            groups.append(",".join(str(k) for k, _ in a[i:p]) + "|" + ",".join(str(k) for k, _ in b[j:q]))
            i, j = p, q
        counts.update(links)
        docs.append((doc_id, len(a), len(b), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    for doc_id, n, m, groups, links in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        yield doc_id, n, m, len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest


ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\nb", "a \nb", "a\n b", "\na", "a\n", "\t", "a\tb", "a\t b", "a\r\nb", "x y", "x  y", "x y z", "a​ b", "\x1ca \x1c",
    "<|endoftext|> is <unk> <s>text</s><|endoftext|>", "<0x41>", "▁ literal", "mid▁dle of", "don't we'll 'tis it's", "½ ① ﬁ é é ＡＢ", "日本語 のテキスト", "😀 👩‍👩‍👧 x😀y", "Σίσυφος ΣΑΣ", "\x00 \x07a", "12345 67,890.12", "!!! ... ???", "a.b,c;d:e",
    "unbelievableness anti-disestablishmentarianism", "x" * 5000, "ab " * 3000, " line par", "fin\u0085x", "_under_score_ __init__", "https://a.b/c?d=e&f=g#h",
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = "the of und straße anblewh tioner'in é naïve 3rd жизнь 東京 e-mail (see) \"quoted\" a\nb C\nD NewLine\n".split(" ")
    out = [(k, t) for k, t in enumerate(ODD)]
    out += [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 80)))) for k in range(60)]
    return [*out, out[110 - 20], (None, "null id"), (7, "again"), (7, "again"), *((1000 + k, "the same text") for k in range(50))]


def table(spark, rows, slices=4):
    return spark.createDataFrame([(*r, "en", 5, "x", True) for r in rows], DOCS).repartition(slices)


def test_alignment_is_the_brute_force_alignment(spark, encode, rows):
    found = align.report(table(spark, rows), A, B)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(brute(encode, rows), key=str)


@pytest.mark.parametrize("cuts, pieces", [(True, 5), (False, 10**6)])
def test_pieces_and_whole_texts_give_the_same(encode, rows, cuts, pieces):
    import pyarrow as pa

    words = align.Vocabularies(A, B)
    assert words.cuts
    words.cuts = cuts
    own = align.Aligner(words, pieces)
    texts = [t for _, t in rows]
    expected = list(brute(encode, rows))
    for lo in range(0, len(texts), 17):
        n_a, n_b, n_groups, groups, a, b, regular = own.align(pa.array(texts[lo : lo + 17], pa.string()))
        want = expected[lo : lo + 17]
        assert [(*x,) for x in zip(n_a.tolist(), n_b.tolist(), n_groups.tolist(), strict=True)] == [x[1:4] for x in want]
        assert [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.to_pylist()] == [x[7] for x in want]
        assert all(words.bytes_a[x] == words.bytes_b[y] for x, y, r in zip(a.tolist(), b.tolist(), regular, strict=True) if r)


def test_links_are_suffixes_of_each_other_and_counts_take_both_ways(spark, rows):
    words = align.Vocabularies(A, B)
    counts = align.link_counts(align.align_documents(table(spark, rows), A, B)).collect()
    raw = [(words.bytes_a[r["a"]], words.bytes_b[r["b"]]) for r in counts]
    assert all(x.endswith(y) or y.endswith(x) for x, y in raw) and len(counts) == len({(r["a"], r["b"]) for r in counts})
    assert 300_000 < words.most_pairs < 1_000_000
    # The identity map joins ids of the same bytes only, and a piece before a byte of the fallback.
    known = [k for k in range(len(words.identity)) if words.identity[k] >= 0]
    assert len(known) > 10_000 and all(words.bytes_a[k] == words.bytes_b[words.identity[k]] for k in known)


def test_empty_tables_and_tables_without_tokens(spark):
    assert align.report(table(spark, []), A, B).count() == 0
    assert [tuple(r) for r in align.report(table(spark, [(1, None), (2, "")]), A, B).orderBy("doc_id").collect()] == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]
