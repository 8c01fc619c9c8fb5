"""Token files: exact round trips, damage, and the query's rows against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sunloom.llm.byte_bpe import BLANKS, WORD, ByteBpe, byte_bpe, parts
from sunloom.llm.rans import BITS, EVERY, LANES, Coder, frequencies
from sunloom.llm.token_files import folder, read_ids, tokens_to_files, write_ids

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("n", [0, 1, 7, 255, 256, 257, 5_000, 70_001])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.4, n) % 5000).astype(np.int64)
    coder = Coder(frequencies(np.bincount(ids, minlength=5000)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all() and len(coder.decode(block)) == n
    for _ in range(20):
        lo, hi = sorted(rng.integers(0, n + 1, 2))
        assert (coder.decode(block, lo, hi) == ids[lo:hi]).all()
    if n == 70_001:
        counts = np.bincount(ids) / n
        states = -(-n // (LANES * EVERY)) * (8 + 8 * LANES)
        assert len(block) < 1.05 * -(counts[counts > 0] * np.log2(counts[counts > 0])).sum() * n / 8 + states
        for at in (50, len(block) // 2, len(block) - 1):
            with pytest.raises(ValueError):
                coder.decode(block[:at] + bytes([block[at] ^ 4]) + block[at + 1 :])
        with pytest.raises(ValueError, match="another frequency table"):
            Coder(frequencies(np.ones(5000))).decode(block)
        with pytest.raises(ValueError, match="not in the frequency table"):
            coder.encode(np.array([5001]))


def test_frequencies_add_up():
    for counts in ([1], [1, 10**12], [1] * 1000 + [10**15], np.arange(70_000), [0, 5, 0]):
        f = frequencies(np.array(counts))
        assert f.sum() == 1 << BITS and ((f > 0) == (np.array(counts) > 0)).all()
    assert frequencies(np.zeros(3)).sum() == 0
    with pytest.raises(ValueError):
        frequencies(np.ones((1 << BITS) + 1))


def test_bpe_equals_the_library_on_every_code_point(lib):
    own = byte_bpe(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 20_000):
        texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}b" for c in points[lo : lo + 20_000]]
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert want == list(map(own.encode, texts)) == [np.frombuffer(own.packed(t), own.kind).tolist() for t in texts]


def test_bpe_equals_the_library_on_odd_texts(lib):
    from tokenizers import Tokenizer

    own, plain, rng = byte_bpe(PATH), Tokenizer.from_file(PATH), random.Random(2)
    plain.encode_special_tokens = True
    texts = ["", " ", "a<|endoftext|>b <|endoftext|> c<|endoftext|", "<|endoftext|><|endoftext|>", " " * (BLANKS + 5) + "x", "\n \t" * 900_000, "ab" * WORD, "é" * 1_200_000, "1" * 70_000 + " don't I'LL"]
    texts += ["".join(rng.choices("abc  \n\x1c\x85'stre12é汉🙂.<|>", k=rng.randint(1, 200))) for _ in range(500)]
    for t in texts:
        assert own.encode(t) == lib.encode(t, add_special_tokens=False).ids, t[:40]
        assert own.encode(t, plain=True) == plain.encode(t, add_special_tokens=False).ids, t[:40]
        assert np.frombuffer(own.packed(t), own.kind).tolist() == own.encode(t) and " ".join(parts(t)) == t, t[:40]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_files_hold_the_library_s_ids_in_order(spark, lib):
    rng = random.Random(3)
    rows = [(rng.randrange(-50, 10**12), "".join(rng.choices("abcd efg. é\n", k=rng.randint(0, 400)))) for _ in range(150)]
    rows += [(3, None), (4, ""), (5, "same"), (5, "same"), (5, "other <|endoftext|>"), (None, "no id"), (None, None), (6, "long word " * 40_000)] + [(9, "hot")] * 120
    df = spark.createDataFrame([(*r, "x", 1, b"p") for r in rows], "doc_id long, text string, part string, row int, ids binary").repartition(5)
    path = folder(spark)
    tokens_to_files(df, PATH, path, end=2)
    got = sorted((r["start"], r["n_tokens"], r["doc_id"], r["ids"]) for r in read_ids(spark, path).collect())
    assert [x[2] for x in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    want = sorted((str(i), lib.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows)
    assert sorted((str(x[2]), x[3]) for x in got) == want
    at = 0
    for start, n, _, ids in got:
        assert start == at and n == len(ids)
        at += n
    raw = {(r["start"], r["c"]) for r in read_ids(spark, path, raw=True).select("start", F.crc32("ids").alias("c")).collect()}
    assert raw == {(x[0], zlib.crc32(np.array(x[3], "<u4").tobytes())) for x in got}
    assert sorted(p.name for p in __import__("pathlib").Path(path.removeprefix("file:")).iterdir()) == ["blocks", "places", "table"]


def test_empty_table_and_small_blocks(spark):
    path = folder(spark)
    tokens_to_files(spark.createDataFrame([], "doc_id long, text string"), PATH, path, end=2)
    assert read_ids(spark, path).count() == 0
    rows = [(p, i, f"d{p}-{i}", np.arange(i * 7 % 40, dtype="<u4").tobytes()) for p in range(3) for i in range(50)]
    tokens, path = spark.createDataFrame(rows, "part int, row long, doc_id string, ids binary").coalesce(2), folder(spark)
    write_ids(tokens, path, block=64)
    got = {r["doc_id"]: (r["start"], r["ids"]) for r in read_ids(spark, path).collect()}
    at = 0
    for _, _, doc, ids in rows:
        assert got[doc] == (at, np.frombuffer(ids, "<u4").tolist())
        at += len(ids) // 4
    assert spark.read.parquet(f"{path}/blocks").count() > 30  # four documents or so each
