"""Benchmark decontamination by winnowing (operator 9, DataFrame functions only).

Of each window of 10 words the smallest hash of its 6 five-word grams is kept as a fingerprint, so texts that share 10
consecutive words share a fingerprint. Fingerprints of documents and of benchmark items are joined; hits are extended to
exact 10-word windows and to the words that these cover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import bounded, keep, table, words

#: Words of a window, and of a gram.
WINDOW, GRAM = 10, 5

def _grams(hashes: Column, k: int) -> Column:
    """The hash of each run of k words, by position; an empty array for fewer words."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))).otherwise(none)


def _winnow(grams: Column) -> Column:
    """The distinct smallest hashes over windows of WINDOW - GRAM + 1 grams."""
    w = WINDOW - GRAM + 1
    none = F.array().cast("array<bigint>")
    return F.when(F.size(grams) >= w, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - w), lambda i: F.least(*[F.get(grams, i + j) for j in range(w)])))).otherwise(none)


def _tagged(size: int, hashes: Column) -> Column:
    return F.transform(hashes, lambda x: F.struct(F.lit(size).alias("size"), x.alias("fp")))


def _prints(df: DataFrame, sizes: list[int]) -> DataFrame:
    """Adds prints: array of (window size, fingerprint). df has hashes. A short window is its own fingerprint.

    Callers unfold it with inline_outer: for inline() Spark infers a filter that evaluates the whole expression again.
    """
    df = df.withColumn("grams", _grams(F.col("hashes"), GRAM))
    parts = [_tagged(n, _winnow(F.col("grams")) if n == WINDOW else F.array_distinct(_grams(F.col("hashes"), n))) for n in sizes]
    return df.withColumn("prints", F.concat(*parts))


def _tokenized(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns, words(F.col("text")).alias("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document row: doc_id, row (a hash of its text), n_words, spans, items, n_hit.

    docs has doc_id and text, benchmark item_id and text; other columns are neither read nor returned. A window is 10
    consecutive words of an item, or all words of an item of 1 to 9. spans is a sorted array of (start word, words) of
    the windows found in the document, items a sorted array of the ids, as strings, of the items that have them, n_hit
    the number of words inside any of the windows. A null or empty text has no words and no hits; an item without words
    has no windows; an item without an id counts as the item "". Repeated rows each give the same row, rows without a
    doc_id are told apart by their texts; an empty benchmark gives no hits, an empty table no rows.
    """
    items = keep(_tokenized(benchmark.select("item_id", "text"), F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id")).where(F.size("words") > 0))
    sizes = sorted(r["size"] for r in items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("size")).distinct().collect())  # ten values at most
    no_spans, no_items = F.array().cast("array<struct<start:int,size:int>>"), F.array().cast("array<string>")
    if not sizes:
        return _tokenized(docs, "doc_id", F.xxhash64("text").alias("row")).select("doc_id", "row", F.size("words").cast("long").alias("n_words"), no_spans.alias("spans"), no_items.alias("items"), F.lit(0).cast("long").alias("n_hit"))
    size = F.least(F.size("words"), F.lit(WINDOW))
    windows = items.select("item_id", size.alias("size"), F.explode_outer(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.array_join(F.slice("words", i + 1, size), " "))).alias("window"))
    windows = windows.select("item_id", "size", "window", F.xxhash64("window").alias("print")).distinct()
    prints = _prints(items, sizes).select(F.least(F.size("words"), F.lit(WINDOW)).alias("own"), F.inline_outer("prints")).where("own = size").select("size", "fp").distinct()

    # One pass over the words: of each document its number of words, in a row of size 0, and the fingerprints found.
    mark = F.array(F.struct(F.lit(0).alias("size"), F.lit(0).cast("long").alias("fp")))
    own = _prints(_tokenized(docs, "doc_id", F.xxhash64("text").alias("row")), sizes)
    own = own.select("doc_id", "row", F.size("words").alias("n"), F.inline_outer(F.concat(mark, "prints")))
    known = bounded(prints.unionByName(docs.sparkSession.createDataFrame([(0, 0)], "size int, fp long")))
    seen = keep(own.join(known, ["size", "fp"]))
    found = seen.where("size > 0").select("doc_id", "row", "size", "fp").distinct()

    # Only texts with fingerprints are read again: each word place whose gram is found, and the windows around it.
    ids = bounded(found.select("doc_id", "row").distinct()).select(F.col("doc_id").alias("d"), F.col("row").alias("r"))
    back = docs.select("doc_id", "text", F.xxhash64("text").alias("row")).join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row").eqNullSafe(F.col("r"))).select("doc_id", "row", "text").dropDuplicates(["doc_id", "row"])
    back = keep(_tokenized(back, "doc_id", "row"))
    n = F.size("words")
    places = None
    for k in sizes:
        gram = GRAM if k == WINDOW else k
        one = back.select("doc_id", "row", n.alias("n"), F.posexplode(_grams(F.col("hashes"), gram)).alias("i", "fp")).join(known.where(F.col("size") == k).select("fp"), "fp")
        one = one.select("doc_id", "row", F.lit(k).alias("size"), F.explode(F.sequence(F.greatest(F.col("i") - (k - gram), F.lit(0)), F.least(F.col("i"), F.col("n") - k))).alias("start")) if k == WINDOW else one.select("doc_id", "row", F.lit(k).alias("size"), F.col("i").alias("start"))
        one = one.where(F.col("start") >= 0)
        places = one if places is None else places.unionByName(one)
    starts = places.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "size")).alias("starts")).select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "starts")
    texts = back.join(starts, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row").eqNullSafe(F.col("r")))
    texts = texts.select("doc_id", "row", F.transform("starts", lambda s: F.struct(s["start"].alias("start"), s["size"].alias("size"), F.array_join(F.slice("words", s["start"] + 1, s["size"]), " ").alias("window"))).alias("windows"))
    hits = texts.select("doc_id", "row", F.inline("windows")).withColumn("print", F.xxhash64("window"))
    hits = hits.join(windows, ["size", "print", "window"])
    hits = hits.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "size"))).alias("spans"), F.array_sort(F.collect_set("item_id")).alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(a["end"], x["start"]))).alias("n"),
    )
    hits = hits.withColumn("n_hit", F.aggregate("spans", zero, step)["n"])
    out = seen.where("size = 0").alias("b").join(hits.alias("h"), F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")) & F.col("b.row").eqNullSafe(F.col("h.row")), "left")
    return out.select("b.doc_id", "b.row", F.col("n").cast("long").alias("n_words"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("items", no_items).alias("items"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, coalesce({_WORDS.format('text')}, []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM bw) AS s, unnest(range(1, len(w) - k + 2)) AS t(i)),
hit AS (SELECT DISTINCT doc_id, i, dw.k, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) AS t(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
