"""Operators against brute force, the tokenizers library and edge cases, on small fixtures."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sunloom.llm import neighbours
from sunloom.llm.bpe import bpe_encode
from sunloom.llm.line_dup import dedup_lines
from sunloom.llm.neighbours import nearest
from sunloom.llm.toxicity import LONG, Automaton, Lexicon, features, scores

TEXTS = "doc_id long, text string, source string"


def test_bpe_is_the_library(spark):
    texts = ["Hello  WORLD's <|endoftext|> don't 12345", "naïve Σίσυφος 汉字 🙂🙂\n\tx", "", None, "a" * 5000, "..!!?? --", "É ﬁ x"]
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation(), t.no_padding()
    got = {r[0]: (list(r[1]), r[2]) for r in bpe_encode(spark.createDataFrame([(i, x, "s") for i, x in enumerate(texts)], TEXTS), path).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert got[i] == (ids, t.decode(ids, skip_special_tokens=False))


def test_nearest(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(40)]
    bad = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 50 = 0"), 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    for i, q in rows:
        if i % 50 == 0:
            assert got.pop(i) == [j for _, j in sorted((-round(dot(q, v), 9), j) for j, v in rows if j != i)[:5]]
    assert not got
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_lines(spark):
    line = "this is quite a long line that stands in more than one of the documents here"
    rows = [(1, f"{line}\nown one", "a"), (2, f"own two\n\n{line}!", "a"), (3, None, "a"), (4, "", "a"), (5, f"  {line}  ", "a"), (6, "own one", "a")]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"], r["source"]) for r in dedup_lines(spark.createDataFrame(rows, TEXTS)).collect()}
    assert got == {1: (rows[0][1], 2, 0, "a"), 2: ("own two\n", 3, 1, "a"), 3: (None, 1, 0, "a"), 4: ("", 1, 0, "a"), 5: ("", 1, 1, "a"), 6: ("", 1, 1, "a")}
    assert dedup_lines(spark.createDataFrame([], TEXTS)).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automaton_is_plain_edit_distance():
    rng = random.Random(1)
    terms = {"".join(rng.choices("abc", k=rng.randint(5, 11))): float(rng.randint(1, 9)) for _ in range(30)}
    automaton, hits = Automaton(terms), 0
    for i in range(3000):
        word = "".join(rng.choices("abcd", k=rng.randint(0, 13)))
        want = max([0.0, *(v for t, v in terms.items() if edits(t, word) <= (1 if len(t) < LONG else 2))])
        assert automaton.find(word) == want
        hits += want > 0
        if i == 1500:
            automaton._forget()
    assert hits > 20


def test_lexicon_and_context():
    lex = Lexicon({"moron": 3.0, "pathetic": 2.0, "vequ*": 1.0, "m" * 30: 2.0}, frozenset(["marons"]))
    assert lex.look("moron") == (3.0, 0) and lex.look("morron") == (3.0, 1) and lex.look("pathetik") == (2.0, 1)
    assert lex.look("vequlle") == (1.0, 0) and lex.look("marlin") is None and lex.look("maron") == (3.0, 1) and lex.look("marons") is None
    assert lex.look("m" * 28) == (2.0, 1)
    around = {"you": 2.0, "said": -3.0, '"': -2.0}
    plain, quoted = features(lex, around, "you are a moron"), features(lex, around, 'they said "moron" again')
    assert plain[0] > quoted[0] and quoted[2] > plain[2]
    assert features(lex, around, "") == features(lex, around, "nothing here") == [0.0] * 7


def test_scores(spark):
    filler = "the quick brown fox went over lazy dogs near rivers under old stone bridges".split()
    rng, rows = random.Random(6), []
    for i in range(120):
        words = rng.choices(filler, k=12)
        toxic = i % 4 == 0
        if toxic:
            words[5:5] = ["you", rng.choice(["grobnak", "grobnaks", "vilthorn"])]
        rows.append((i, " ".join(words), "a", int(toxic)))
    train = spark.createDataFrame([(t, y) for _, t, _, y in rows] + [(None, 0), ("", 0), ("you grobnak", None)], "text string, y int")
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, "my you grobnok over dogs", "x"), (1002, "my you grobnok over dogs", "x"), (None, "the fox", "x"), (1003, "fox " * 20000, "x")]
    docs = spark.createDataFrame([(i, t, s) for i, t, s, _ in rows] + odd, TEXTS)
    got = {}
    for r in scores(docs, train).collect():
        got.setdefault(r[0], []).append(r[1])
    assert all((got[i][0] >= 0.7) == bool(y) for i, _, _, y in rows)
    assert len(got[1002]) == 2 and min(got[1002]) >= 0.7 and max(got[1000][0], got[1001][0], got[None][0], got[1003][0]) < 0.3
    assert scores(docs.limit(0), train).count() == 0
    assert {r[1] for r in scores(docs, train.where("y = 0")).collect()} == {0.0}
    assert {r[1] for r in scores(docs, train.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("budget", [4, 64])
def test_nearest_among_vectors_of_many_lengths(spark, monkeypatch, budget):
    monkeypatch.setattr(neighbours, "SHARD", 8)
    monkeypatch.setattr(neighbours, "BUDGET", budget)  # 4: more large lengths than vectors to sample
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=1 + i % (6 if i < 120 else 40)) * (1 + i % 9)]) for i in range(300)]
    got = {}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for r in nearest(df, df.where("vec_id % 7 = 0"), 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i, q in rows[::7]:
        others = [(-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in rows if j != i and len(v) == len(q)]
        assert got.get(i, []) == [j for _, j in sorted(others)[:4]]


def test_nearest_by_ranges_of_norms(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SHARD", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 5)) * np.exp(2 * rng.normal(size=600))[:, None]
    x[:200] = [3.0, 4.0, 0.0, 0.0, 0.0]  # a third of all rows are equal
    x[200:260] *= 1e-170
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    parts = neighbours._parts(neighbours._placed(neighbours._valid(df, "vec_id", "embedding"), neighbours._pivots(neighbours._valid(df, "vec_id", "embedding"), 1e6), 1e6))
    assert all(len(most) == each.sum() and (np.diff(most) >= 0).all() and len(each) == len(cuts) + 1 for _, cuts, each, most in parts.values())
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i in range(0, 600, 20):
        order = sorted((-sum(a * b for a, b in zip(x[i].tolist(), x[j].tolist(), strict=True)), j) for j in range(600) if j != i)
        assert got[i] == [j for _, j in order[:20]]
