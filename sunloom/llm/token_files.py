"""Token ids as binary files in the order of doc_id (operator 12): blocks of a static range asymmetric numeral system.

A folder holds three Parquet tables, written by Spark, so that attempts of lost executors leave nothing behind: `table`
(id, freq), the frequency table that all blocks share; `blocks` (part, row, n, at, doc_ids, sizes, payload), of which
payload is a byte string as rans.py describes; and `places` (part, row, start), the ids before each block. Documents are
never cut: a block ends with the first document that fills it. Blocks are decoded alone, in any order.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import bounded, shared, slices, table
from .byte_bpe import byte_bpe
from .rans import BITS, Coder, frequencies

#: Ids that fill a block.
BLOCK = 131_072


def folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares."""
    shared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/ids-{uuid.uuid4().hex}"


def _tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def encode_docs(docs: DataFrame, path: str, end: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, row, doc_id, ids): the ids of each document, as little-endian bytes of 2 or 4 each, in the order of doc_id.

    part and row number the rows in that order. Rows of equal doc_id are ordered by their texts' hashes; rows without a
    doc_id come first. The order is a range partitioning by (doc_id, hash, row of the input), so a doc_id that holds many
    rows is dealt to several tasks. end, if given, follows the ids of each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, row = byte_bpe(path), TaskContext.get().partitionId(), 0
        tail = b"" if end is None else np.array(end, bpe.kind).tobytes()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                own = batch.slice(lo, hi - lo)
                ids = [bpe.packed(t) + tail for t in own.column(1).to_pylist()]
                at = np.arange(row, row + len(ids))
                row += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, "i4")), pa.array(at), own.column(0), pa.array(ids, pa.binary())], names=["part", "row", "doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "hash", "place").sortWithinPartitions("doc_id", "hash", "place")
    return rows.select("doc_id", "text").mapInArrow(run, f"part int, row long, doc_id {docs.schema[id_col].dataType.simpleString()}, ids binary")


def count_ids(tokens: DataFrame, kind: str) -> np.ndarray:
    """How often each id occurs: a row an id comes to the driver, at most 2 ** BITS."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            own = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), kind))
            if len(own) > len(total):
                own, total = total, own
            total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype("i8")), pa.array(total[used].astype("i8"))], names=["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    if len(rows) > 1 << BITS:
        raise ValueError(f"more than {1 << BITS} different ids")
    counts = np.zeros(1 + max((r["id"] for r in rows), default=-1), np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_ids(tokens: DataFrame, path: str, kind: str = "<u4", block: int = BLOCK) -> None:
    """Writes rows (part, row, doc_id, ids) as a folder of files; tokens must give the same rows each time it is read.

    Rows are coded in the order of (part, row); where a task doesn't get the row that follows, it begins a new block.
    """
    spark, doc_type = tokens.sparkSession, tokens.schema["doc_id"].dataType.simpleString()
    freq = frequencies(count_ids(tokens, kind))
    schema = f"part int, row long, n long, at array<long>, doc_ids array<{doc_type}>, sizes array<long>, payload binary"
    spark.createDataFrame([(int(i), int(freq[i])) for i in np.flatnonzero(freq)], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, held, n, after = Coder(freq), [], 0, None

        def done() -> pa.RecordBatch:
            sizes = np.array([len(x[3]) // np.dtype(kind).itemsize for x in held])
            ids = np.frombuffer(b"".join(x[3] for x in held), kind).astype("i8")
            columns = [[held[0][0]], [held[0][1]], [len(ids)], [(np.cumsum(sizes) - sizes).tolist()], [[x[2] for x in held]], [sizes.tolist()], [coder.encode(ids)]]
            fields = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(doc), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(columns, fields, strict=True)], names=["part", "row", "n", "at", "doc_ids", "sizes", "payload"])

        for b in batches:
            doc = b.schema.field(2).type
            for x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (x[:2] != after or n >= block):
                    yield done()
                    held, n = [], 0
                held.append(x)
                n, after = n + len(x[3]) // np.dtype(kind).itemsize, (x[0], x[1] + 1)
        if held:
            yield done()

    tokens.select("part", "row", "doc_id", "ids").mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    # A row a block, and then a row a part, are summed up: parts are counted in one task.
    blocks = spark.read.parquet(f"{path}/blocks").select("part", "row", "n")
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("row")) - F.col("n")
    blocks.join(bounded(parts), F.col("part") == F.col("p")).select("part", "row", (F.col("before") + inside).alias("start")).write.parquet(f"{path}/places")


def read_ids(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """(doc_id, start long, n_tokens long, ids array<int>) of every document in a folder; damaged blocks raise.

    start is the number of ids of all documents before. raw: ids as little-endian unsigned 32-bit integers in a binary.
    Rows come in no order; start has it.
    """
    rows = spark.read.parquet(f"{path}/table").collect()  # at most 2 ** BITS rows
    freq = np.zeros(1 + max((r["id"] for r in rows), default=-1), np.uint32)
    for r in rows:
        freq[r["id"]] = r["freq"]
    blocks, places = spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/places")
    doc_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            for i in range(b.num_rows):
                start, at, docs, sizes, payload = (b.column(k).slice(i, 1) for k in range(5))
                ids = coder.decode(payload[0].as_py()).astype("<u4")
                at, sizes = (x.flatten().to_numpy() for x in (at, sizes))
                ends = np.append(at, len(ids)).astype("i4")
                own = pa.array([ids[a:e].tobytes() for a, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) if raw else pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype("i4")))
                yield pa.RecordBatch.from_arrays([docs.flatten(), pa.array(at + start[0].as_py()), pa.array(sizes), own], names=["doc_id", "start", "n_tokens", "ids"])

    rows = blocks.join(places, ["part", "row"]).select("start", "at", "doc_ids", "sizes", "payload")
    return rows.mapInArrow(run, f"doc_id {doc_type}, start long, n_tokens long, ids {'binary' if raw else 'array<int>'}")


def tokens_to_files(docs: DataFrame, tokenizer: str, path: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes documents with a byte-level BPE file and writes their ids to a new folder, in ascending order of doc_id.

    Null and empty texts have no ids but `end`, if that is given. Repeated rows are written each; rows without a doc_id
    come first; an empty table gives a folder without documents. Other columns are neither read nor written. A text is
    held whole by one task, as is a block of BLOCK ids and one document more. The ids are kept once, in `path`/tokens,
    which is deleted at the end: the frequency table needs all of them before the first block is coded.
    """
    spark, kept = docs.sparkSession, f"{path}/tokens"
    encode_docs(docs, tokenizer, end, id_col, text_col).write.option("compression", "zstd").parquet(kept)
    _tidy(spark)
    write_ids(spark.read.parquet(kept), path, byte_bpe(tokenizer).kind)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = folder(spark)
    tokens_to_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path, end=2)
    return read_ids(spark, path, raw=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
