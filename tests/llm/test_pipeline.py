"""The stages of the corpus pipeline on a small corpus with odd rows and clashing column names."""

import corpus_pipeline as P
import public_tokenizers
import pytest

LINE = "this is quite a long line that stands in more than one of the documents of this small corpus"
LONG = " ".join(f"word{i}" for i in range(120))
PASSAGE = " ".join(f"item{i}" for i in range(14))
ROWS = [(1, f"{LINE}\nown one"), (2, f"own two\n{LINE}!"), (3, None), (4, ""), (5, LONG), (6, f"{LONG} more"), (6, f"{LONG} more"), (7, f"before {PASSAGE} after"), (7, "clean words of the same id"), (None, f"{PASSAGE}"), (None, "clean without id"), (8, " \n\t")]
EXTRA = "_lost string, n_lines int, d string, row int, key string, score double, kept string, y int"


@pytest.fixture()
def corpus(spark, tmp_path):
    toxic = [(100 + i, " ".join(["plain", "words", "here", "you", "grobnak", f"w{i}"]), 1) for i in range(12)]
    clean = [(200 + i, " ".join(["plain", "words", "there", "on", "stones", f"w{i}"]), 0) for i in range(24)]
    docs = spark.createDataFrame([(i, t, None if t is None else len(t), "l", i2, "d", 1, "k", 0.5, "no", 9) for i2, (i, t) in enumerate([*ROWS, *[x[:2] for x in toxic + clean]])], f"doc_id long, text string, n_chars int, {EXTRA}")
    spark.createDataFrame([(i, 1, y) for i, _, y in toxic + clean], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("a", PASSAGE), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return docs, str(tmp_path)


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages(spark, corpus):
    docs, path = corpus
    assert [name for name, _ in P.STAGES] == ["toxicity", "line dedup", "near-dedup", "decontamination", "bpe"]
    before = pairs(docs)
    out = P.toxicity(spark, docs, path)
    assert out.columns == docs.columns and pairs(out) == [r for r in before if not (r[0] or 0) in range(100, 200)]

    few = docs.where("doc_id IS NULL OR doc_id < 100")
    out = P.lines(spark, few, path)
    got = {(r["doc_id"], r["n_lines"]): r for r in out.collect()}
    assert out.columns == docs.columns and len(got) == len(ROWS)
    assert (got[2, 1]["text"], got[2, 1]["n_chars"]) == ("own two", 7) and got[1, 0]["text"] == ROWS[0][1] and got[3, 2]["text"] is None
    assert P.lines(spark, few.drop("n_chars"), path).columns == few.drop("n_chars").columns

    out = P.near(spark, few, path)
    assert out.columns == docs.columns and pairs(out) == [r for r in pairs(few) if r[0] != 6]

    out = P.decontaminate(spark, few, path)
    assert out.columns == docs.columns and pairs(out) == [r for r in pairs(few) if PASSAGE not in (r[1] or "")]

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = sorted(((r["doc_id"], r["ids"]) for r in P.encode(spark, few, path).collect()), key=str)
    assert got == sorted(((i, lib.encode(t or "", add_special_tokens=False).ids) for i, t in ROWS), key=str)
    for stage in (P.toxicity, P.decontaminate, P.encode):  # those of lines and near copies have tests of their own
        assert stage(spark, docs.limit(0), path).count() == 0


def test_run(spark, corpus):
    docs, path = corpus
    ids = sorted((r["doc_id"] for r in P.run(spark, path).collect()), key=str)
    # The lines of documents 6 and 7 are near copies of earlier ones, so these stay without text.
    kept = [r["doc_id"] for r in docs.collect() if not (r["doc_id"] or 0) in range(100, 200) and r["text"] != PASSAGE]
    assert ids == sorted(kept, key=str)


def test_workers_drop_what_the_stage_before_remembers():
    from sunloom.llm import line_dup
    from sunloom.llm.base import forget
    from sunloom.llm.toxicity import lexicon

    class Pairs:  # runs the function on no batches, in this process
        def mapInArrow(self, run, schema):
            return list(run(iter([])))

    lexicon((("ugly", 3.0),), frozenset())
    forget(lexicon)
    assert lexicon.cache_info().currsize == 1
    line_dup._alike(Pairs(), 80)
    assert lexicon.cache_info().currsize == 0  # it stayed in memory for all stages that followed


def test_workers_give_memory_back_after_a_task(spark, monkeypatch):
    import os

    import numpy as np
    import pyarrow as pa
    from sunloom.llm import base

    def used():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    pins, runs = [], []

    def start():
        def work(texts):
            rows = []
            for _ in range(4_000):  # 200 MB in pieces, among which some small ones stay
                rows.append(np.ones(50_000, np.uint8))
                pins.append(np.ones(100, np.uint8))
            return [pa.array([len(rows)] * len(texts), pa.int64())]

        return work

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run))
    base.map_texts(docs, "doc_id", "text", start, "n long")
    before = used()
    out = [*runs[0](iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a"])], names=["doc_id", "text"])]))]
    assert out[0].column(1).to_pylist() == [4_000]
    assert used() - before < 100  # all of it stayed with the worker
