"""Line dedup and the link search against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from sunloom.llm.line_dup import BITS, _apart, _loaded, dedup_lines, dropped_lines, gram_sets, signatures
from sunloom.llm.linking import SHARE, connect


def shingles(line):
    return {line} if len(line) < 5 else {line[i : i + 5] for i in range(len(line) - 4)}


def brute(rows, percent=80):
    """(doc_id, at) of the lines that are dropped."""
    first = {}
    for doc, text in rows:
        for at, line in enumerate((text or "").split("\n")):
            if line := line.strip(" \t\r\x0b\x0c"):
                first.setdefault(line, []).append((doc, at))
    lines = sorted(first, key=lambda x: min(first[x]))
    sets, best = [shingles(x) for x in lines], list(range(len(lines)))

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both * 100 >= (len(a) + len(sets[j]) - both) * percent:
                x, y = sorted((root(i), root(j)))
                best[y] = x
    return {p for i, x in enumerate(lines) for p in first[x] if p != min(first[lines[root(i)]])}


def test_lines_equal_brute_force(spark):
    rng, rows = random.Random(11), []
    base = [" ".join("".join(rng.choices("abcdefghijklé", k=rng.randint(2, 8))) for _ in range(n)) for n in (3, 6, 12, 25, 60, 150, 400)]
    for i in range(60):
        lines = []
        for _ in range(4):
            words = rng.choice(base).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5, 30])):
                words[rng.randrange(len(words))] = "".join(rng.choices("mnopqr", k=4))
            lines.append(rng.choice(["", "  ", "\t"]) + " ".join(words) + rng.choice(["", "\r", "!"]))
        rows.append((i, "\n".join([*lines, "", "abc"])))
    rows += [(90, None), (91, ""), (92, "\n\n \t\r\n"), (93, "x" * 30000 + "\nab"), (94, "x" * 29999 + "y\n\tabc\r")]
    df = spark.createDataFrame([(*r, "s", 7, "l") for r in rows], "doc_id long, text string, d string, n_lines int, _lost string")
    want = brute(rows)
    assert {(r["doc_id"], r["at"]) for r in dropped_lines(df).collect()} == want and len(want) > 100
    got = {r["doc_id"]: r for r in dedup_lines(df).collect()}
    for doc, text in rows:
        lines = (text or "").split("\n")
        rest = "\n".join(x for at, x in enumerate(lines) if (doc, at) not in want)
        lost = len(lines) - len([at for at in range(len(lines)) if (doc, at) not in want])
        assert (got[doc]["text"], got[doc]["n_lines"], got[doc]["n_dropped"], got[doc]["_lost"]) == (text if not lost else rest, len(lines), lost, "l")
    assert dropped_lines(df.limit(0)).count() == 0


def test_pairs_on_two_sides_of_a_power_of_two(spark):
    """Lines of `low` and `high` shingles, the one the other's start, so their similarity is low / high."""
    rng, rows = random.Random(1), []
    for low, high in ((60, 68), (62, 66), (30, 34), (120, 136), (240, 270), (15, 18), (65, 73), (33, 38), (130, 150), (70, 76), (51, 64), (60, 80)):
        for _ in range(20):
            line = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=high + 4))
            rows += [(len(rows), line), (len(rows) + 1, line[: low + 4])]
            assert [len(shingles(t)) for _, t in rows[-2:]] == [high, low]
    got = {(r["doc_id"], r["at"]) for r in dropped_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {(i, 0) for i, _ in rows if i % 2 and i < 400}


def test_many_unlike_lines_of_one_bucket(spark):
    """Of lines that share most of their text, but too little to be alike, those that are alike are found, and no others."""
    rng = random.Random(5)
    body = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))
    tail = lambda n: "".join(rng.choices("0123456789", k=n))
    lines = [body + tail(20) for _ in range(300)]
    lines += [lines[7][:-2] + "xy", lines[211][:-1] + "z"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    assert {(r["doc_id"], r["at"]) for r in dropped_lines(df).collect()} == brute(list(enumerate(lines)))
    # The bucket of the first band that a pair shares, told to be a large one: its pairs are counted inside a task.
    keys = _loaded([(x,) for x in lines])[0]
    band = int(np.flatnonzero(keys[7] == keys[300])[0])
    same = [int(i) for i in np.flatnonzero(keys[:, band] == keys[7, band])]
    lead = df.select(F.col("doc_id").alias("node"), F.lit(80).alias("n"), F.col("text").alias("line"))
    told = lead.where(F.col("node").isin(same)).select(F.lit(int(keys[7, band])).alias("key"), "node", "n", F.lit(len(lines)).alias("m"), F.col("node").alias("label"))
    found = {(r["a"], r["b"]) for r in _apart(told, lead, lambda pairs: pairs, 80).collect()}
    sets = [shingles(x) for x in lines]
    assert (7, 300) in found and all(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in found)


def test_repeated_ids_are_told_apart(spark):
    line = "this is quite a long line that stands in more than one of the documents here"
    rows = [(1, f"{line}\nown"), (1, f"{line}\nown"), (1, f"other words\n{line}"), (None, f"{line}."), (None, "alone in here")]
    got = sorted((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # The row without a doc_id comes first, so its line stays.
    assert got == sorted([("1", "own", 1), ("1", "own", 1), ("1", "other words", 1), ("None", f"{line}.", 0), ("None", "alone in here", 0)])


def test_sets_and_signatures():
    """Sets of lines of all lengths have the right sizes; bins are equal about as often as the similarity says."""
    rng = random.Random(3)
    lines = ["".join(rng.choices("abé\U0001f600 ", k=n)) for n in (0, 1, 4, 5, 6, 63, 64, 69, 128, 133, 500, 3)]
    at = gram_sets(lines) >> np.uint64(64 - BITS)
    assert [int((at == i).sum()) for i in range(len(lines))] == [len(shingles(x)) if len(x) >= 5 else 0 for x in lines]
    assert len(gram_sets([])) == len(gram_sets(["", "ab"])) == 0
    equal, real = [], []
    for n in (40, 300, 2000):
        for _ in range(30):
            line = "".join(rng.choices("abcdefghijklmnop", k=n))
            pair = [line, line[: n * 9 // 10] + "".join(rng.choices("qrstuv", k=n // 20))]
            low = signatures(gram_sets(pair), 2)
            a, b = map(shingles, pair)
            equal.append((low[0] == low[1]).mean())
            real.append(len(a & b) / len(a | b))
    assert abs(np.mean(equal) - np.mean(real)) < 0.015


def test_hot_bucket_of_unlike_nodes(spark):
    """Nodes that share a bucket but are alike only in pairs far apart; more of them than one task compares."""
    n = SHARE * 2 + 10
    nodes = spark.range(n).select(F.lit(7).cast("long").alias("key"), F.col("id").alias("node"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("low"))
    verify = lambda pairs: pairs.where((F.col("b") - F.col("a") == n // 2) & (F.col("a") % 100 == 3))
    got = {r["node"]: r["component"] for r in connect(nodes, verify, lambda a, b: F.lit(True)).collect()}
    want = {x: a for a in range(3, n // 2, 100) for x in (a, a + n // 2)}
    assert got == want
