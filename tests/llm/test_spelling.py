"""Spelling variants against brute force: the automaton, the halves, and whole rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from sunloom.llm import spelling
from sunloom.llm.spelling import Automaton, near_words, spelling_variants, word_counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, shortest=6, least=5, ratio=5):
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    out, form = {}, {}
    for w, n in words.items():
        found = sorted((-words[v], v) for v in words if near(w, v))
        taken = found and -found[0][0] >= ratio * n
        form[w] = found[0][1] if taken else None
        out[w] = (form[w], n, len(found), -found[0][0] if taken else None)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (f, root(w), n, k, m) for w, (f, n, k, m) in out.items()}


def words(rng, n, letters="abé", low=1, high=9):
    return sorted({"".join(rng.choices(letters, k=rng.randint(low, high))) for _ in range(n)})


def test_automaton_numbers_and_finds():
    rng = random.Random(5)
    own = words(rng, 400)
    a = Automaton(own)
    assert [a.number(w) for w in own] == list(range(len(own))) and a.number("zz") is None and a.number("") is None
    assert sum(bool(e) for e in a.edges) < sum(map(len, own))
    for w in [*own[:60], *words(rng, 60)]:
        for exact in (0, len(w) // 2):
            same = sorted(v for v in own if len(v) == len(w) and near(v, w) and v[:exact] == w[:exact])
            more = sorted(v for v in own if len(v) > len(w) and near(v, w) and any(v[:i] + v[i + 1 :] == w for i in range(exact, len(v))))
            assert sorted(own[i] for i in a.replaced(w, exact)) == same
            assert sorted(own[i] for i in a.inserted(w, exact)) == more
    assert Automaton([]).number("") is None and Automaton([""]).number("") == 0


@pytest.mark.parametrize("share", [4_000, 20, 2])
def test_halves_lose_no_pair(spark, monkeypatch, share):
    """Also where many words share a half, so that it is halved again, down to single characters."""
    monkeypatch.setattr(spelling, "SHARE", share)
    rng = random.Random(6)
    own = [*words(rng, 500, low=6, high=8), *("prefixed" + w for w in words(rng, 120, high=5)), *(w + "suffixes" for w in words(rng, 120, high=5))]
    own = sorted(set(own))
    df = spark.createDataFrame([(w, i + 5) for i, w in enumerate(own)], "word string, n long")
    got = {(r["word"], r["near"], r["near_n"]) for r in near_words(df).collect()}
    assert got == {(a, b, i + 5) for i, b in enumerate(own) for a in own if near(a, b)}


def test_rows_equal_brute_force(spark):
    rng = random.Random(7)
    stems = ["colour", "center", "Straße", "señores", "organise", "naïvely", "aaaaaa", "LONGWORDS", "Écoles"]
    def variant():
        w = rng.choice(stems)
        if rng.random() < 0.2:
            i = rng.randrange(len(w))
            w = w[:i] + rng.choice(["", "x", w[i] + "y"]) + w[i + 1 :]
        return w
    rows = [(i, " ".join(variant() for _ in range(rng.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "12 34 ..\n\t"), (None, "colour colour center"), (None, "colour colour center"), (7, "colour " * 20), (7, "colour " * 20), (503, "a" * 100_000 + " b"), (504, ("q" * 3000 + " ") * 6)]
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 13 == 0 else run] += 1
    df = spark.createDataFrame([(*r, "w", 1, 2.0) for r in rows], "doc_id long, text string, word string, n int, near double")
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(word_counts(df, modulus=13)).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    want = brute(counts)
    assert got == want and sum(bool(x[0]) for x in want.values()) > 10
    assert spelling_variants(word_counts(df.limit(0), modulus=13)).count() == 0


def test_chains_of_forms_end_in_their_root(spark):
    chain = [("aaaaaa" + "b" * i, 5 ** (8 - i)) for i in range(7)]  # each five times as often as the next
    got = {r["word"]: (r["form"], r["root"]) for r in spelling_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got == {w: (chain[i - 1][0] if i else None, "aaaaaa") for i, (w, n) in enumerate(chain) if n >= 5}
    with pytest.raises(ValueError, match="frequent"):
        spelling_variants(spark.createDataFrame(chain, "word string, n long"), ratio=1)
