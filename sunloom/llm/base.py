"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that are no part of a word: all but letters and digits.
GAPS = "".join(chr(i) for i in (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> None:
    """Makes sure that checkpoint() has a folder that all executors share.

    It is the one that the session names in spark.checkpoint.dir. Where none is named, only a local master gets a
    temporary folder, as in tests; on a cluster that would lose data, so it is an error.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sunloom-"))


def keep(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and cuts its lineage; it survives the loss of executors.

    The shuffle files of the steps before it are of no use then, and neither are kept frames that nothing refers to any
    more. Spark deletes both as soon as the driver's garbage is collected, which is asked for here.
    """
    shared(df.sparkSession)
    out, spark = df.checkpoint(eager=True), df.sparkSession
    del df
    _clean(spark)
    return out


def _clean(spark: SparkSession) -> None:
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clean(spark: SparkSession, wait: float = 1.0) -> None:
    """Asks once more for what keep() and write() ask for, when Spark's listeners, which hold the last query, had some time.

    It is meant for large shuffles that must be gone before the next step.
    """
    time.sleep(wait)
    _clean(spark)


def write(df: DataFrame) -> str:
    """Writes a frame as Parquet in the folder that the cluster shares; gives its path.

    It takes less disk there than keep(), as checkpoints are not compressed, but stays until remove(). Of the shuffle files
    before it what keep() says holds.
    """
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    del df
    _clean(spark)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of ids up to which a side is broadcast (some 100 MB at most); beyond, Spark's joins shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """A kept frame of numbers only, marked for broadcast if it is counted and found small."""
    df = keep(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


_REMEMBERED: list = []


def remembered(make: Callable) -> Callable:
    """Keeps what make() gave last for each worker, until a task calls forget() for another operator.

    Workers outlive the stages of a pipeline, and what one stage remembers must not add to the memory of the next.
    """
    out = lru_cache(maxsize=1)(make)
    _REMEMBERED.append(out)
    return out


def forget(*own: Callable) -> None:
    """Drops what this worker remembers, but for own, and gives the memory back to the system."""
    others = [x for x in _REMEMBERED if x not in own and x.cache_info().currsize]
    for x in others:
        x.cache_clear()
    if others:
        gc.collect()
        trim()


def trim() -> None:
    """Gives the memory that this process holds but doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library, which gives memory back in its own way
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the worker's free memory goes back to the system.

    Workers stay for later tasks, also of stages that run in the JVM alone, and would hold the peak of all tasks till then.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return go


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case: runs of ASCII letters and digits and all beyond ASCII; null has none."""
    spaced = F.translate(text, UPPER + GAPS, LOWER + " " * len(GAPS))
    return F.coalesce(F.array_remove(F.split(spaced, " "), ""), F.array().cast("array<string>"))


def map_texts(df: DataFrame, id_col: str, text_col: str, start: Callable[[], Callable[[list[str]], list[pa.Array]]], schema: str, most: int = 4_000_000) -> DataFrame:
    """Runs a function over Arrow batches of texts (null: empty); it returns the columns that follow the id.

    start() is called once in each task and returns the function, which gets slices of about `most` bytes at most; a
    longer text comes alone.
    """
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for lo, hi in slices(batch.column(1), most):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), *work(part.column(1).to_pylist())], names=[id_col, *names])

    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col)).mapInArrow(tidied(run), f"{id_col} {df.schema[id_col].dataType.simpleString()}, {schema}")


def slices(texts: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts come to about `most` bytes; a longer text stands alone."""
    import pyarrow.compute as pc

    lo, total = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)
