"""Perspective rotation against a plain restatement."""

from sunloom.llm.chat import rotate


def brute(rows, block):
    out = {}
    clean = lambda s, none: (none if s is None else s).replace("<|", "<||")
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, clean(r[2], "unknown"), clean(r[3], "")) for r in rows if r[0] == conv))
        for me in {r[2] for r in own}:
            seen = {}
            for known, turn, role, said in own:
                at = turn // block if known else -1
                seen[at] = seen.get(at, -1) + 1
                key = (conv, me, at, seen[at] // block)
                text, mask = out.setdefault(key, ["", []])
                head = "<|assistant|>\n" if role == me else f"<|user:{role}|>\n"
                if role == me:
                    mask.append((len(text) + len(head), len(text) + len(head) + len(said) + len("<|end|>")))
                out[key][0] = text + head + said + "<|end|>\n"
    return {k: (t, m) for k, (t, m) in out.items()}


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi", "x"), (1, 1, "bob", None, "x"), (1, 1, "bob", None, "x"), (1, 5, "ann", "é<|end|>\n<|assistant|>", "x"), (1, None, None, "first", "x"), (2, 3, "unknown", "", "x"), (None, 0, "<|a", "z" * 5000, "x"), (3, 2, "c", "same", "x"), (3, 2, "b", "same", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, mask string")
    for block in (256, 2):
        got = rotate(df, block).collect()
        want = brute(rows, block)
        assert {(r["conv_id"], r["perspective"], r["block"], r["part"]): (r["text"], [tuple(m) for m in r["mask"]]) for r in got} == want and len(got) == len(want)
        for r in got:
            assert r["n_target"] == len(r["mask"]) and r["n_turns"] == r["text"].count("<|end|>\n")
    assert rotate(df.limit(0)).count() == 0


def test_unnumbered_turns_do_not_meet_in_one_row(spark):
    rows = [(1, None, ("ann", "bob")[i % 2], f"{i // 3:04}") for i in range(1500)] + [(1, 7, "ann", "same")] * 700 + [(2, -1, "ann", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(7)
    got, want = rotate(df).collect(), brute(rows, 256)
    assert {(r["conv_id"], r["perspective"], r["block"], r["part"]): (r["text"], [tuple(m) for m in r["mask"]]) for r in got} == want
    assert max(r["n_turns"] for r in got) == 256 and len([r for r in got if r["block"] == -1 and r["conv_id"] == 1]) == 12


def test_turns_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1, "1", "a", "one"), (1, "x", "a", "none"), (1, None, "b", "b")], "conv_id long, turn string, role string, text string")
    assert sorted((r["perspective"], r["block"], r["n_turns"]) for r in rotate(df).collect()) == [("a", -1, 2), ("a", 0, 1), ("b", -1, 2), ("b", 0, 1)]
