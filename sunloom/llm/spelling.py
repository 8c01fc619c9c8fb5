"""Spelling variants of the corpus' words (operator 11): near words from forward and backward minimal acyclic automata.

One edit leaves the first or the second half of a word as it is. So words are dealt to tasks by their halves, a task
builds a forward automaton of the words that it got by first halves and a backward one of those by second halves, walks
the half that is equal exactly and completes it with one error. Paths carry word numbers (a perfect hash): how many words
of the automaton come before. Pairs that both directions find are counted once. A half that many words share is halved
again, with the same two directions, until few share it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, UPPER, bounded, keep, table

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
_LOWERED = dict(zip(map(ord, UPPER), LOWER, strict=True))
#: Words that a task counts before it passes its sums on, words that an automaton holds, and words that share a half.
HELD, CHUNK, SHARE = 300_000, 20_000, 4_000


class Automaton:
    """The minimal acyclic automaton of sorted distinct strings; a string's number is its place among them."""

    def __init__(self, strings: list[str]):
        edges: list[dict[str, int]] = [{}]
        self.final, self.size, self.skips = [False], [0], [{}]
        self.edges, known, path, before = edges, {}, [], ""

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, char, state = path.pop()
                own = (self.final[state], *edges[state].items())
                if (same := known.setdefault(own, state)) == state:
                    self._number(state)
                edges[parent][char] = same

        for s in strings:
            same = 0
            while same < min(len(s), len(before)) and s[same] == before[same]:
                same += 1
            settle(same)
            state = path[-1][2] if path else 0
            for c in s[same:]:
                edges.append({})
                self.final.append(False), self.size.append(0), self.skips.append({})
                edges[state][c] = new = len(edges) - 1
                path.append((state, c, new))
                state = new
            self.final[state], before = True, s
        settle(0)
        self._number(0)

    def _number(self, state: int) -> None:
        n = int(self.final[state])
        for c, k in self.edges[state].items():
            self.skips[state][c] = n
            n += self.size[k]
        self.size[state] = n

    def _walk(self, state: int, text: str, at: int) -> int | None:
        """The words before text[at:] among those from a state on, if it is one of them."""
        n, edges, skips = 0, self.edges, self.skips
        for i in range(at, len(text)):
            c = text[i]
            if (k := edges[state].get(c)) is None:
                return None
            n += skips[state][c]
            state = k
        return n if self.final[state] else None

    def number(self, text: str) -> int | None:
        return self._walk(0, text, 0)

    def replaced(self, text: str, exact: int) -> Iterator[int]:
        """The numbers of the words that differ from text in one character, from the place `exact` on."""
        return self._near(text, exact, 1)

    def inserted(self, text: str, exact: int) -> Iterator[int]:
        """The numbers of the words that have one character more than text, put in at the place `exact` or later."""
        return self._near(text, exact, 0)

    def _near(self, text: str, exact: int, skip: int) -> Iterator[int]:
        state, n, edges, skips = 0, 0, self.edges, self.skips
        for i in range(len(text) + 1 - skip):
            c = text[i] if i < len(text) else ""
            if i >= exact:
                for other, k in edges[state].items():
                    # A character put in before its like gives the same word as one put in behind it.
                    if other != c and (rest := self._walk(k, text, i + skip)) is not None:
                        yield n + skips[state][other] + rest
            if (k := edges[state].get(c)) is None:
                return
            n += skips[state][c]
            state = k


def word_counts(docs: DataFrame, modulus: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the distinct runs of Latin letters of all texts, A-Z in lower case, and how often they occur.

    modulus, if it isn't 0, plants misspellings that a test can foretell: where it divides crc32(id:run), the run loses
    the code point at that number modulo its length; a null id counts as an empty one. A task sums what it reads; only
    words and sums are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return rows

        held = 0
        for batch in batches:
            for doc, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = zlib.crc32(f"{doc}:".encode())
                for word, n in Counter(RUNS.findall(text)).items():
                    low = word.lower() if word.isascii() else word.translate(_LOWERED)
                    if modulus and not (h := zlib.crc32(low.encode(), start)) % modulus:
                        low = low[: h % len(low)] + low[h % len(low) + 1 :]
                    total[low] += n
                    held += len(low)
                if held > 12 * HELD:
                    if len(total) > HELD or sum(map(len, total)) > 12 * HELD:
                        yield out()
                        held = 0
                    else:
                        held = sum(map(len, total))
        if total:
            yield out()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row (word, n, m, a, b) twice: with more characters of its start that must be equal (a), and of its end (b).

    m is the length of the words that are looked for; what lies between start and end is (m - a - b) long. An edit in it
    leaves equal either the first or the last (m - a - b - 1) / 2 characters there.
    """
    half = F.floor((F.col("m") - F.col("a") - F.col("b") - 1) / 2).cast("int")
    ways = F.explode(F.array(F.struct((F.col("a") + half).alias("a"), F.col("b"), F.lit(True).alias("forward")), F.struct(F.col("a"), (F.col("b") + half).alias("b"), F.lit(False).alias("forward"))))
    rows = rows.withColumn("way", ways).select("word", "n", "m", "way.*")
    start = F.substr("word", F.lit(1), F.col("a"))
    end = F.substr("word", F.length("word") - F.col("b") + 1, F.col("b"))
    return rows.withColumn("key", F.xxhash64("m", "a", "b", "forward", start, end))


def _solve(rows: list[tuple]) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n) among rows (key, word, n, m, a, b, forward)."""
    for forward in (True, False):
        own = [x for x in rows if x[6] == forward]
        turn = (lambda w: w) if forward else (lambda w: w[::-1])
        counts = {turn(x[1]): x[2] for x in own if len(x[1]) == x[3]}
        if not counts:
            continue
        words = sorted(counts)
        automaton = Automaton(words)
        for _, word, n, m, a, b, _ in own:
            exact, text, longer = (a if forward else b), turn(word), len(word) < m
            for i in automaton.inserted(text, exact) if longer else automaton.replaced(text, exact):
                near = words[i]
                yield word, turn(near), counts[near]
                if longer:
                    yield turn(near), word, n


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of words that differ by one inserted, deleted or replaced code point, both ways.

    words: a kept frame (word, n) of distinct words. A word is a row of its own length (it is in the automaton, and looks
    for words of its length) and one of the length above (it looks for longer words), each by either half. Pairs may come
    twice. Halves that more than SHARE words share are halved again, a level at a time; levels end as words do.
    """
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    rows, found = _halved(rows), []
    while True:
        more = F.col("m") - F.col("a") - F.col("b") > 2
        hot = bounded(rows.where((F.length("word") == F.col("m")) & more).groupBy("key").agg(F.count(F.lit(1)).alias("w")).where(F.col("w") > SHARE).select("key"))
        if hot.isEmpty():
            found.append(rows)
            break
        found.append(rows.join(hot, "key", "left_anti"))
        rows = keep(_halved(rows.join(hot, "key", "left_semi").drop("key", "forward")))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def out() -> pa.RecordBatch:
            pairs = list(dict.fromkeys(_solve(held)))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["word", "near", "near_n"])

        for b in batches:
            for x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if x[0] != last and size > 12 * CHUNK:
                    yield out()
                    held, size = [], 0
                held.append(x)
                size, last = size + len(x[1]), x[0]
        if held:
            yield out()

    every = every.select("key", "word", "n", "m", "a", "b", "forward")
    return every.repartition("key").sortWithinPartitions("key").mapInArrow(run, "word string, near string, near_n long")


def _roots(forms: DataFrame, most: int, ratio: int) -> DataFrame:
    """(word, root) for rows (word, form): where the forms, followed to the last, end.

    Each form occurs `ratio` times as often as its word, so chains are short; each round doubles what a row has followed.
    """
    at = keep(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(2.0, math.log(max(most, 2), ratio))))):
        ahead = at.select(F.col("word").alias("from"), F.col("root").alias("to"))
        at = keep(at.join(ahead, F.col("root") == F.col("from"), "left").select("word", F.coalesce("to", "root").alias("root")))
    return at


def spelling_variants(counts: DataFrame, shortest: int = 6, least: int = 5, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of counts (word, n) that are long and frequent enough.

    Words have `shortest` code points or more and occur `least` times or more. form is the word within one edit that
    occurs most often (ties: the smallest in code-point order), if it occurs `ratio` times as often as the word, which
    must be 2 or more; root is where forms lead, followed to the last. No words give no rows. counts must be distinct.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their words, else chains of forms may not end")
    words = keep(counts.where((F.length("word") >= shortest) & (F.col("n") >= least)).select("word", "n"))
    # A word of length L has at most some 200 * (L + 1) words of Latin letters within one edit: a set is bounded.
    best: Column = F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.size(F.collect_set("near")).cast("long").alias("n_near"), best)
    near = near.select(F.col("word").alias("w"), "n_near", F.col("best.near").alias("near"), (-F.col("best.col1")).alias("near_n"))
    told = words.join(near, F.col("word") == F.col("w"), "left")
    taken = F.col("near_n") >= F.col("n") * ratio
    told = keep(told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, F.col("near")).alias("form"), F.when(taken, F.col("near_n")).alias("form_n")))
    most = told.agg(F.max("form_n")).first()[0] or 1
    roots = _roots(told.where("form IS NOT NULL").select("word", "form"), most, ratio).withColumnRenamed("word", "w")
    return told.join(roots, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(word_counts(table(spark, sf_dir, "documents"), modulus=199))


# The bytes of a run: its code points are below 256, so one or two bytes each in UTF-8. The table of crc32 is made from its
# polynomial, 0xEDB88320.
OP11_SQL = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) AS t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
runs AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY 1, 2),
bytes AS (
  SELECT *, flatten(list_transform(string_split(concat(doc_id, ':', r), ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END)) AS b FROM runs),
hashed AS (SELECT doc_id, r, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda h, x: xor(h >> 8, t[xor(h & 255, x) + 1]))) AS h FROM bytes, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r) + 2)::INT) ELSE r END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS (SELECT word, n, i, left(word, i::INT) || substr(word, (i + 2)::INT) AS v FROM words, unnest(range(length(word))) AS t(i)),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM words a JOIN less b ON a.word = b.v
  UNION SELECT b.word, a.word, a.n FROM words a JOIN less b ON a.word = b.v),
top AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS k, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM near),
forms AS (SELECT w.word, w.n, coalesce(k, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM words w LEFT JOIN top t ON w.word = t.word AND place = 1),
follow(word, last) AS (SELECT word, word FROM forms UNION ALL SELECT f.word, g.form FROM follow f JOIN forms g ON f.last = g.word WHERE g.form IS NOT NULL)
SELECT f.word, f.form, l.last AS root, f.n, f.n_near, f.form_n FROM forms f JOIN follow l ON f.word = l.word JOIN forms e ON l.last = e.word WHERE e.form IS NULL
"""
