"""Token counts against sentencepiece, for a BPE model and a unigram model."""

import random

import public_tokenizers
import pytest
import sentencepiece

from sunloom.llm.token_counts import MergeCounter, UnigramCounter, counter, token_counts

TEXTS = ["Hello  WORLD's don't 12345", "naïve Σίσυφος 汉字 🙂🙂\n\tx", "", None, "a" * 5000, "  three   spaces  ", " ", "▁x <0x0A> <s>", "É ﬁ ｄ　\x00", "aaaa bbb abababab"]


def odd_texts():
    rng = random.Random(3)
    return TEXTS + ["".join(rng.choices("abcdeeinrst    é汉\n.", k=rng.randint(1, 80))) for _ in range(400)]


def test_bpe_model_is_counted_as_the_library_does(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, texts = sentencepiece.SentencePieceProcessor(model_file=path), odd_texts()
    assert isinstance(counter(path), MergeCounter)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r[0]: tuple(r[1:]) for r in token_counts(df, path).collect()}
    assert got == {i: (len(sp.encode(t or "")), len(t or ""), len((t or "").encode())) for i, t in enumerate(texts)}
    assert token_counts(df.limit(0), path).count() == 0


def train(tmp_path, **options):
    rng = random.Random(4)
    stems = ["".join(rng.choices("abcdeinrst", k=rng.randint(2, 7))) for _ in range(300)]
    lines = [" ".join(rng.choices(stems, k=8)) for _ in range(2000)]
    sentencepiece.SentencePieceTrainer.train(sentence_iterator=iter(lines), model_prefix=str(tmp_path / "m"), model_type="unigram", vocab_size=500, byte_fallback=True, minloglevel=2, **options)
    return str(tmp_path / "m.model")


def test_unigram_model_is_counted_as_the_library_does(tmp_path):
    path = train(tmp_path, normalization_rule_name="identity", remove_extra_whitespaces=False)
    sp, c = sentencepiece.SentencePieceProcessor(model_file=path), counter(path)
    assert isinstance(c, UnigramCounter)
    for t in odd_texts():
        assert c.count(t or "") == len(sp.encode(t or "")), t


def test_other_models_are_refused(tmp_path):
    with pytest.raises(ValueError, match="identity"):
        counter(train(tmp_path))
