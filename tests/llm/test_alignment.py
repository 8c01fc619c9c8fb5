"""Alignment of two tokenizers against brute force over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sunloom.llm.alignment import align, aligner, link_measures, pair_counts
from sunloom.llm.base import keep
from sunloom.llm.bpe import _byte_chars

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    texts = ["".join(rng.choices(["the ", "of", " and", "x", "é", "汉", "🙂", "\n", "  ", "1234", "don't", "\x00", "ing "], k=rng.randint(1, 60))) for _ in range(120)]
    texts += [None, "", " ", "   ", "\n\n", "a ▁ b", "x▁", "<|endoftext|> <s></s> <0x0A>", "﻿b", "the the the", "ab" * 30_000, "naïve ﬁ ｄ　́"]
    return [*enumerate(texts), (3, "of and the"), (3, "of and the"), (None, "the of")]


def brute(rows):
    lib, sp = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    lib.encode_special_tokens = True
    byte = {c: b for b, c in enumerate(_byte_chars())}
    out, links = [], []
    for _, text in rows:
        a, b = (lib.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        in_a = [bytes(byte[c] for c in lib.id_to_token(i)) for i in a]
        in_b = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
        if not text or b"".join(in_a) != f" {text}".encode() or b"".join(in_b) != f" {text}".encode():
            a, b, in_a, in_b = [], [], [], []
        ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] if len(x) < 3000 else _running(x) for x in (in_a, in_b))
        both, i, j, groups = sorted(set(ends_a) & set(ends_b)), 0, 0, []
        for end in both:
            m, n = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:m], b[j:n]))
            i, j = m, n
        links.append([(x[-1], y[-1]) for x, y in groups])
        out.append((len(a), len(b), len(groups), ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)))
    count = Counter(p for x in links for p in x)
    most: dict = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return [(*o, len(x), sum(count[p] == most[p[1]] for p in x), sum(count[p] for p in x)) for o, x in zip(out, links, strict=True)]


def _running(tokens):
    out, at = [], 0
    for t in tokens:
        out.append(at := at + len(t))
    return out


def test_rows_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(*r, i, "l") for i, r in enumerate(rows)], "doc_id long, text string, a int, links string")
    aligned = keep(align(df, A, B))
    want = brute(rows)
    names = ["n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum"]
    for most in (2_000_000, 0):  # looked up in each task, and joined
        from pyspark.sql import functions as F

        own = keep(aligned.select(F.monotonically_increasing_id().alias("row"), "*"))
        got = link_measures(own, keep(pair_counts(own)), most)
        assert sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in got.collect()) == sorted((str(i), *w) for (i, _), w in zip(rows, want, strict=True))
    assert sum(w[0] == 0 for w in want) >= 4 and max(w[0] for w in want) > 10_000 and any(w[2] < min(w[0], w[1]) for w in want)
    assert align(df.limit(0), A, B).count() == 0


def test_query(spark):
    """The registered query has the digest columns of whole rows."""
    from sunloom.llm.alignment import op13_alignment

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r["doc_id"]: (w[0], w[1], w[2], w[4], w[5], w[6], hashlib.sha256(w[3].encode()).hexdigest() if w[3] else "") for r, w in zip(docs, brute([(r["doc_id"], r["text"]) for r in docs]), strict=True)}
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in op13_alignment(spark, sf).collect()}
    assert got == want


def test_labels_are_per_byte():
    own, text = aligner(A, B), "naïve don't"
    a, b = own.a.encode(f" {text}", plain=True), own.b.encode([text])[0]
    labels = own.labels(np.array(a), np.array(b))
    assert len(labels) == len(f" {text}".encode()) and labels.endswith(b"*")
    assert labels.count(b"A") + labels.count(b"*") == len(a) and labels.count(b"B") + labels.count(b"*") == len(b)


def test_parts_and_whole_texts_agree(monkeypatch):
    """With parts remembered or not, and with a model that is not cut at spaces."""
    rng, own = random.Random(9), aligner(A, B)
    texts = ["".join(rng.choices(["ab", "the", " ", " ", "  ", "\n", "é", "▁", "\x1f", "\x85", "\u3000", "'s", "q" * 70], k=rng.randint(1, 30))) for _ in range(400)]
    want = [own._whole(t) or (0, 0, "", b"") for t in texts]
    monkeypatch.setattr("sunloom.llm.alignment.CACHE", 50)
    for cuts in (True, False):
        own.cache.clear()
        monkeypatch.setattr(own.b, "cuts", cuts)
        assert own.align(texts) == own.align(texts) == want and len(own.cache) <= 50
    own.cache.clear()
