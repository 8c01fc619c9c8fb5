"""Suffix arrays and repeated strings against brute force."""

import hashlib
import random

from sunloom.llm import suffixes as S


def test_suffix_array():
    rng = random.Random(1)
    for k in (1, 2, 3, 20):
        for n in (1, 2, 5, 60, 300):
            s = [rng.randint(1, k) for _ in range(n)]
            sa = S.suffix_array(s, k + 1)
            assert sa == sorted(range(n), key=lambda i: s[i:])
            lcp = S.common_prefixes(s, sa)
            for a, b in zip(sa, sa[1:], strict=False):
                h = 0
                while max(a, b) + h < n and s[a + h] == s[b + h]:
                    h += 1
                assert lcp[b] == h


def brute(rows):
    first, out = {}, {}
    for i, t in rows:
        for p in range(len(t) - 49):
            first[t[p : p + 50]] = min(i, first.get(t[p : p + 50], i))
    for i, t in rows:
        gone = [False] * len(t)
        for p in range(len(t) - 49):
            if first[t[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_long_texts_are_cut_into_pieces(spark):
    rng = random.Random(4)
    part = "".join(rng.choices("abcdef ", k=900))
    rows = [(i, "".join(rng.choices("ghijk", k=rng.randint(0, 400))) + part[rng.randint(0, 300) : rng.randint(500, 900)] + "z" * 120) for i in range(12)]
    got = {r[0]: tuple(r[1:]) for r in S.repeated(spark.createDataFrame(rows, "doc_id long, text string"), 1, 256).collect()}
    assert got == brute([(i, t.encode()) for i, t in rows])


def test_repeated(spark, monkeypatch):
    rng = random.Random(2)
    parts = ["".join(rng.choices("ab é", k=rng.choice([20, 30, 49, 50, 51, 120]))) for _ in range(12)]
    line = "a common line of some forty bytes or so, yes"
    rows = [(i, "".join(rng.choice(parts) if rng.random() < 0.5 else "".join(rng.choices("abcdefgh ", k=40)) for _ in range(6)) + line + str(rng.random())) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a" * 400), (63, "a" * 300), (64, rows[3][1])]
    want = brute([(i, (t or "").encode()) for i, t in rows])
    rows += [(64, rows[3][1]), (None, rows[5][1])]  # a repeated row, and one without a doc_id
    for hot, rounds in ((2_000, 1), (1, 2)):
        monkeypatch.setattr(S, "HOT", hot)
        out = S.repeated(spark.createDataFrame(rows, "doc_id long, text string"), rounds).collect()
        assert len(out) == len(rows)
        got = {r[0]: tuple(r[1:]) for r in out}
        assert got.pop(None)[1:3] == (0, 0) and got == want
    assert S.repeated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_of_a_round_are_one_row_a_document(spark):
    rng = random.Random(5)
    text, other = ("".join(rng.choices("abcdefgh ", k=3000)) for _ in range(2))
    docs = spark.createDataFrame([(0, text), (1, text), (2, f"{text[:1000]}#{other}#{text[2000:]}"), (3, other)], "doc_id long, text string")
    own = docs.selectExpr("doc_id", "0L AS row", "encode(text, 'UTF-8') AS data")
    # Each place of an anchor had a row of its own, some hundreds a document, and all of them were kept on disk.
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S._spans_of_round(own, (0, 1), S.PIECE).collect()}
    assert got == {1: [(0, 3000)], 2: [(0, 1000), (4002, 5002)], 3: [(0, 3000)]}
    assert S._spans_of_round(own, (0, 1), S.PIECE).count() == 3


def test_merged():
    import pyarrow as pa

    spans = [[(5, 60), (0, 50), (60, 70), (72, 80)], [], [(3, 9)], [(10, 90), (20, 70), (80, 95)]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(range(4)), pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], pa.list_(pa.struct({"a": pa.int64(), "b": pa.int64()})))], names=["doc_id", "row", "spans"])
    (out,) = S._merged(iter([batch]))
    assert [[tuple(s.values()) for s in x] for x in out.column(2).to_pylist()] == [[(0, 70), (72, 80)], [], [(3, 9)], [(10, 95)]]


def test_places_are_not_rows(spark, monkeypatch):
    rng = random.Random(6)
    text = "".join(rng.choices("abcdefgh ", k=20_000))
    own = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string").selectExpr("doc_id", "0L AS row", "encode(text, 'UTF-8') AS data")
    written, write = [], S.write
    monkeypatch.setattr(S, "write", lambda df: (written.append(df.count()), write(df))[1])
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in S._spans_of_round(own, (0, 1), S.PIECE).collect()}
    assert got == {i: [(0, 20_000)] for i in range(1, 20)}
    # Each place of an anchor was a row that was shuffled and joined on its own, over 20,000 of them here.
    assert max(written) < 1_000


def test_suffixes_by_their_first_symbols():
    import numpy as np

    rng = random.Random(7)
    s = bytes(rng.choices(b"ab", k=400)) + b"c" * 60
    for depth in (1, 8, 13, 50):
        order, new = S.suffixes(np.frombuffer(s, np.uint8), 256, depth)
        prefixes = [s[i : i + depth] for i in order]
        assert sorted(order) == list(range(len(s))) and prefixes == sorted(prefixes)
        assert new.tolist() == [True, *(a.ljust(depth, b"\0") != b.ljust(depth, b"\0") for a, b in zip(prefixes, prefixes[1:], strict=False))]
    cuts = [s[:90], s[30:120], s[200:280], s[10:70]]
    place, cut, low = S.first_docs(np.frombuffer(b"".join(cuts), np.uint8), np.cumsum([len(c) for c in cuts]), np.array([7, 5, 9, 8]))
    first = {}
    for doc, c in zip((7, 5, 9, 8), cuts, strict=True):
        for p in range(len(c) - 49):
            first[c[p : p + 50]] = min(doc, first.get(c[p : p + 50], doc))
    data = b"".join(cuts)
    assert len(place) == sum(len(c) - 49 for c in cuts) and all(low == [first[data[p : p + 50]] for p in place])


def test_a_bucket_in_parts_gives_the_same(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(8)
    parts = ["".join(rng.choices("abcd ", k=90)) for _ in range(6)]
    texts = ["".join(rng.choice(parts) + "".join(rng.choices("xyz", k=3)) for _ in range(8)).encode() for _ in range(40)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([0] * 40), pa.array(texts)], names=["doc_id", "row", "data"])
    dealt = pa.Table.from_batches(b for i in range(0, 40, 5) for b in S._dealt((0, 1), S.PIECE)(iter([rows.slice(i, 5)]))).sort_by("bucket").combine_chunks().to_batches()

    def run(many):
        monkeypatch.setattr(S, "MANY", many)
        out = {True: [], False: []}
        for b in S._settled(iter(dealt)):
            for asked, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                out[asked] += np.frombuffer(data, S._ASK if asked else S._GONE).tolist()
        return {k: sorted(v) for k, v in out.items()}

    whole = run(1_000_000)
    assert whole[True] and whole[False] and run(2) == whole
