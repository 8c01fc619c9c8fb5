"""BPE against the tokenizers library, near-duplicates, leaks and the pipeline on small fixtures with odd rows."""

import numpy as np
import public_tokenizers
import pytest

ODD = [(1, None, "a"), (2, "", "b"), (3, "  \n\t ", None), (4, "one two", "x"), (4, "one two", "x"), (5, "Straße <|endoftext|> ΣΣ it's 12 \U0001f600 é", "y"), (6, "w " * 3000, "z")]
SCHEMA = "doc_id long, text string, n string"


@pytest.fixture()
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    from sunloom.llm.bpe import bpe_decode, bpe_encode

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_truncation(), lib.no_padding()
    out = bpe_encode(odd, path)
    want = []
    for i, text, _ in ODD:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, lib.decode(ids, skip_special_tokens=False)))
    assert sorted((r.doc_id, r.ids, r.decoded) for r in out.collect()) == sorted(want)
    assert sorted(map(tuple, bpe_decode(out, path).collect())) == sorted((i, d) for i, _, d in want)
    assert bpe_encode(odd.limit(0), path).count() == 0


def test_bpe_on_every_code_point():
    """Inside a word, alone, and behind one; all but surrogates."""
    from tokenizers import Tokenizer

    from sunloom.llm.bpe import WordBpe

    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), WordBpe(path)
    lib.no_truncation(), lib.no_padding()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for lo in range(0, len(points), 4000):
        text = " . ".join(f"ab{chr(c)}cd {chr(c)} e{chr(c)}" for c in points[lo : lo + 4000])
        assert np.frombuffer(own.encode(text)[0], "<i4").tolist() == lib.encode(text, add_special_tokens=False).ids, hex(points[lo])


def test_other_files_are_refused(tmp_path):
    from sunloom.llm.bpe import WordBpe

    with pytest.raises(ValueError, match="only BPE files"):
        WordBpe(public_tokenizers.path("byte_bpe_50k.json"))


def brute_components(rows, size, percent):
    sets = {}
    for i, text, _ in rows:
        w = (text or "").lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = sets[a] & sets[b]
                if both and 100 * len(both) >= percent * len(sets[a] | sets[b]) and label[b] > label[a]:
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    from sunloom.llm.near_dup import near_duplicates

    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows = list(ODD)
    for i in range(40):
        words = list(base)
        for j in rng.integers(0, len(words), i % 8):
            words[j] = f"v{rng.integers(0, 99)}"
        rows.append((10 + i, " ".join(words), "c"))
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA), size=3, percent=85)
    want = brute_components(rows, 3, 85)
    got = out.collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_registers_fill_and_agree_with_similarity():
    from sunloom.llm.near_dup import likely, registers, shingle_sets

    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(380)) + " end"
    sets = shingle_sets([a, b, "one", ""], 3)
    regs = registers(sets)
    assert (regs[:3] > 0).all() and (regs[3] == 0).all()
    exact = len(np.intersect1d(*sets[:2])) / len(np.union1d(*sets[:2]))
    near = likely(regs[:1], regs[1:2], np.array([float(len(sets[0]))]), np.array([float(len(sets[1]))]))[0]
    assert abs(near - exact) < 0.06


def test_leaks_on_odd_rows(spark, odd):
    from sunloom.llm.decontaminate import leaks

    passage = " ".join(f"p{i}" for i in range(14))
    docs = odd.unionByName(spark.createDataFrame([(7, f"before {passage} after", "q"), (None, passage, "q")], SCHEMA))
    bench = spark.createDataFrame([("b1", passage), ("b2", None), ("b3", ""), ("b4", "one two")], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in leaks(docs, bench).collect()}
    assert got[None] == (14, 14, ["b1"])
    assert got[7] == (16, 14, ["b1"]) and got[4] == (2, 2, ["b4"]) and got[1] == (0, 0, []) and got[6] == (3000, 0, [])
    assert leaks(docs, bench.limit(0)).where("n_hit > 0").count() == 0 and leaks(docs.limit(0), bench).count() == 0


def test_bpe_remembers_frequent_words_when_its_cache_is_full(monkeypatch):
    import public_tokenizers

    from sunloom.llm import bpe

    monkeypatch.setattr(bpe, "CACHE", 8)
    own, seen = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")), []
    plain = own.word_ids
    monkeypatch.setattr(own, "word_ids", lambda w: seen.append(w) or plain(w))
    rare = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(60)]
    got = [own.encode(f"often {w}") for w in rare]
    assert seen.count("often") == 1 and len(seen) == 61  # forgetting all words at once encoded it again and again
    assert got == [bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json")).encode(f"often {w}") for w in rare]
    assert len(own.cache) <= 4 and len(own.older) <= 4
