"""Toxicity scores (operator 1).

A lexicon of terms and word stems is learned from labelled rows. Its whole words make up a trie; the Levenshtein
automata of all of them are intersected with it and turned into one deterministic automaton, state by state as texts
need it, so misspelled terms are found in a step a letter. The words around a hit, weighed by the labels of the rows that
they stood in, tell quotation from abuse; a logistic regression over the sums of both gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import forget, keep, map_texts, remembered, table, tidied

#: Labelled rows that the model is fitted on at most, by smallest hash of doc_id; its terms, and its context words, at most.
TRAIN_ROWS, TERMS, AROUND = 20_000, 4_000, 2_000
#: Letters of a stem; shortest term that may be misspelled; letters from which two edits are allowed; words on either side of a hit.
STEMS, FUZZY, LONG, CONTEXT = (4, 5, 6), 5, 9, 6
#: Documents of this score or more count as toxic.
TOXIC = 0.7
_WORD = re.compile(r"[^\W\d_]+|[\"“”«»„]")
#: Words, and automaton states, that one worker remembers.
CACHE, STATES = 300_000, 50_000


class Automaton:
    """The words within a Levenshtein distance of any of the terms: one edit, from LONG letters on two.

    A state is the set of (trie node, edits so far) that the letters read can have led to. States are numbered as they
    are met, and their transitions remembered, for all words.
    """

    def __init__(self, terms: dict[str, float]):
        self.children: list[dict[str, int]] = [{}]
        self.weight, self.own, self.room = [0.0], [-1], [0]
        for term, weight in terms.items():
            node, edits = 0, 1 if len(term) < LONG else 2
            self.room[0] = max(self.room[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.weight.append(0.0), self.own.append(-1), self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], edits)
            self.weight[node], self.own[node] = weight, edits
        self._forget()

    def _forget(self) -> None:
        self.number: dict[tuple, int] = {(): 0}
        self.states, self.steps, self.value = [()], [{}], [0.0]
        self.start = self._state({0: 0})

    def _state(self, items: dict[int, int]) -> int:
        """The number of a state, with what leaving out letters of terms leads to."""
        todo = list(items.items())
        while todo:
            node, e = todo.pop()
            for child in self.children[node].values():
                if e + 1 <= self.room[child] and e + 1 < items.get(child, 99):
                    items[child] = e + 1
                    todo.append((child, e + 1))
        key = tuple(sorted(items.items()))
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key), self.steps.append({})
            self.value.append(max([0.0, *(self.weight[n] for n, e in key if e <= self.own[n])]))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        items: dict[int, int] = {}
        for node, e in self.states[state]:
            if e < self.room[node] and e + 1 < items.get(node, 99):
                items[node] = e + 1  # a letter too many
            for letter, child in self.children[node].items():
                new = e + (letter != c)
                if new <= self.room[child] and new < items.get(child, 99):
                    items[child] = new
        to = self.steps[state][c] = self._state(items)
        return to

    def find(self, word: str) -> float:
        """The largest weight of a term within its distance of the word; 0 without any."""
        if len(self.states) > STATES:
            self._forget()
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if not state:
                return 0.0
        return self.value[state]


class Lexicon:
    """Looks up words: (weight, 0) for a term or an inflected form of a stem, (weight, 1) for a misspelled term.

    Stems end in "*". Words in `ordinary` are never taken for misspelled ones.
    """

    def __init__(self, terms: dict[str, float], ordinary: frozenset[str] = frozenset()):
        self.whole = {t: w for t, w in terms.items() if not t.endswith("*")}
        self.stems = {t[:-1]: w for t, w in terms.items() if t.endswith("*")}
        self.ordinary = ordinary
        self.automaton = Automaton({t: w for t, w in self.whole.items() if len(t) >= FUZZY})
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[float, int]] = {}

    def look(self, word: str) -> tuple[float, int] | None:
        stems = [self.stems[word[:n]] for n in STEMS if len(word) > n and word[:n] in self.stems]
        weight = max([self.whole.get(word, 0.0), *stems])
        if weight:
            return weight, 0
        weight = 0.0 if word in self.ordinary or len(word) < FUZZY - 1 else self.automaton.find(word)
        return (weight, 1) if weight else None

    def find(self, text: str) -> tuple[list[str], list[tuple[int, float, int]]]:
        """The words of a text, and (place, weight, kind) of its hits."""
        words = _WORD.findall(text.lower())
        own = set(words)
        if len(self.seen) > CACHE:
            self.seen.clear(), self.hits.clear()
        for w in own - self.seen:
            if (hit := self.look(w)) is not None:
                self.hits[w] = hit
        self.seen |= own
        if own.isdisjoint(self.hits):
            return words, []
        return words, [(i, *self.hits[w]) for i, w in enumerate(words) if w in self.hits]


@remembered
def lexicon(terms: tuple, ordinary: frozenset[str]) -> Lexicon:
    """One for each worker, so tasks that follow each other share what it remembers."""
    return Lexicon(dict(terms), ordinary)


def features(lex: Lexicon, around: dict[str, float], text: str) -> list[float]:
    """Sums over the hits of a text: abuse, misspelled, quoted, the largest abuse, shares and counts."""
    words, hits = lex.find(text)
    if not hits:
        return [0.0] * 7
    abuse = wrong = quoted = most = 0.0
    for i, weight, kind in hits:
        z = sum(around.get(w, 0.0) for w in {*words[max(0, i - CONTEXT) : i], *words[i + 1 : i + 1 + CONTEXT]})
        share = 1 / (1 + math.exp(-max(-8.0, min(8.0, z))))
        quoted += weight * (1 - share)
        abuse += weight * share
        wrong += weight * share * kind
        most = max(most, weight * share)
    rate = 100 * abuse / max(50, len(words))
    return [math.log1p(abuse), math.log1p(wrong), math.log1p(quoted), most, float(most > 0), math.log1p(rate), math.log1p(len(hits))]


def _counted(train: DataFrame, units) -> DataFrame:
    """(unit, a, b): toxic and other rows of train (text, y) that have each unit; units(list of texts) counts them."""

    def count(batches):
        work = units()
        for b in batches:
            texts, labels = b.column(0).to_pylist(), b.column(1).to_pylist()
            for y in (0, 1):
                own = work([t for t, label in zip(texts, labels, strict=True) if label == y and t])
                yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array([y] * len(own), pa.int32()), pa.array(list(own.values()), pa.int64())], names=["unit", "y", "n"])

    one = lambda y: F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0))
    return train.select("text", "y").mapInArrow(tidied(count), "unit string, y int, n long").groupBy("unit").agg(one(1).alias("a"), one(0).alias("b"))


def _words_and_stems() -> callable:
    def work(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for t in texts:
            words = {w for w in _WORD.findall(t.lower()) if len(w) > 3}
            out.update(words)
            out.update({f"{w[:n]}*" for w in words for n in STEMS if len(w) > n})
        return out

    return work


def learn_terms(train: DataFrame, bad: int, good: int) -> tuple[dict[str, float], frozenset[str]]:
    """Terms and stems with weights from rows (text, y), and the ordinary words that only look like misspelled terms.

    A term has support in several toxic rows and is rare in others: its log odds are 2.5 at least; of more than TERMS,
    those of largest weight and support stay. A word is ordinary if it is no term and stands in two other rows or more.
    """
    units = keep(_counted(train, _words_and_stems))
    weight = F.log(((F.col("a") + 0.5) / (bad + 1)) / ((F.col("b") + 0.5) / (good + 1)))
    rows = units.where(f"a >= {max(3, bad // 250)}").withColumn("w", F.round(weight, 4)).where("w >= 2.5").orderBy(F.desc(F.col("w") * F.log1p("a")), "unit").limit(TERMS).collect()
    terms = {r["unit"]: r["w"] for r in rows}
    key = tuple(sorted(terms.items()))

    def alike(batches):
        forget(lexicon)
        lex = lexicon(key, frozenset())
        for b in batches:
            own = [w for w in b.column(0).to_pylist() if (hit := lex.look(w)) and hit[1]]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string())], names=["unit"])

    near = units.where("b >= 2 AND NOT endswith(unit, '*')").select("unit").mapInArrow(tidied(alike), "unit string")
    return terms, frozenset(r["unit"] for r in near.collect())  # neighbours of at most TERMS words


def learn_context(train: DataFrame, terms: dict[str, float], ordinary: frozenset[str]) -> dict[str, float]:
    """Log odds of the words near hits: above 0 where they stand in toxic rows, below in others. At most AROUND words."""
    key = tuple(sorted(terms.items()))

    def near():
        lex = lexicon(key, ordinary)

        def work(texts: list[str]) -> Counter:
            out: Counter = Counter()
            for t in texts:
                words, hits = lex.find(t)
                own = {w for i, _, _ in hits for w in (*words[max(0, i - CONTEXT) : i], *words[i + 1 : i + 1 + CONTEXT])}
                out.update(own)
                out[""] += bool(hits)
            return out

        return work

    units = keep(_counted(train, near))
    n = units.where("unit = ''").first()
    a, b = (n["a"], n["b"]) if n else (0, 0)
    if not a or not b:
        return {}
    odds = F.log(((F.col("a") + 1) / (a + 2)) / ((F.col("b") + 1) / (b + 2)))
    rows = units.where("unit <> '' AND a + b >= 5").withColumn("w", F.round(odds, 4)).orderBy(F.desc(F.abs("w") * F.log1p(F.col("a") + F.col("b"))), "unit").limit(AROUND).collect()
    return {r["unit"]: max(-3.0, min(3.0, r["w"])) for r in rows if r["unit"] not in terms}


def scores(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row of docs: the probability from 0 to 1 that its text is toxic.

    train has the text column and y (0 or 1; null labels are left out), as training_rows() gives them. Null and empty
    texts have no hits and score low; repeated rows score alike; without labelled rows of both classes every score is 0.
    Other columns are not read; an empty table gives no rows. A text is held whole by one task.
    """
    train = keep(train.where("y IN (0, 1)").select(F.coalesce(text_col, F.lit("")).alias("text"), F.col("y").cast("int").alias("y")))
    n = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return docs.select(id_col, F.lit(0.0).alias("score"))
    terms, ordinary = learn_terms(train, bad, good)
    around = learn_context(train, terms, ordinary)
    key = tuple(sorted(terms.items()))

    def start():
        forget(lexicon)
        lex = lexicon(key, ordinary)
        return lambda texts: [pa.array([features(lex, around, t) for t in texts], pa.list_(pa.float64()))]

    seen = keep(map_texts(train, "y", "text", start, "f array<double>"))
    model = LogisticRegression(featuresCol="v", labelCol="y", maxIter=60, regParam=1e-3).fit(seen.select("y", array_to_vector("f").alias("v")))
    z = F.lit(float(model.intercept))
    for i, c in enumerate(model.coefficients):
        z = z + F.col("f")[i] * float(c)
    return map_texts(docs, id_col, text_col, start, "f array<double>").select(id_col, (1 / (1 + F.exp(-z))).alias("score"))


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, y) of labelled rows of docs whose crc32(doc_id as text) mod 3 is not 1, for at most TRAIN_ROWS doc_ids.

    The ids are chosen from the labels alone, by smallest hash, before any text is read; a doc_id with several labels
    counts as toxic if one of them says so; labels without a doc_id or value are left out.
    """
    own = labels.where("crc32(CAST(doc_id AS STRING)) % 3 <> 1 AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    ids = keep(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # TRAIN_ROWS pairs of numbers at most
    return rows.repartition(16, F.xxhash64("doc_id", "text")).select("text", "y")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, training_rows(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(F.expr("crc32(CAST(doc_id AS STRING)) % 3 = 1"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
