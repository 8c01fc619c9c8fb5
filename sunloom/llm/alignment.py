"""Alignment of two tokenizers (operator 13): where tokens of both end together.

A text's bytes get a label each: none, end of a token of A, end of one of B, or of both. A regular expression takes the
spans up to each byte that ends both; the labels that a span holds tell how many tokens of A and of B make up its group.
Where both tokenizers always cut, before single spaces, texts are cut into parts, and a part that came before isn't aligned
again.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import keep, map_texts, shared, slices, table
from .byte_bpe import byte_bpe, parts

#: Labels of a byte: no end, A's, B's, both.
NONE, ENDS_A, ENDS_B, BOTH = b".AB*"
_LABELS = np.frombuffer(b".AB*", np.uint8)
_SPAN = re.compile(rb"[^*]*\*")
#: Distinct pairs of ids up to which their counts go to each task; more are joined with a shuffle. Links counted at once.
PAIRS, HELD = 2_000_000, 1_000_000
#: Parts of texts that one worker remembers, and how long they are at most.
CACHE, SHORT = 150_000, 60


class Pieces:
    """A sentencepiece model whose ids are looked at as bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.sp.get_piece_size()
        self.bytes = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(self.sp.id_to_piece, range(self.size)))]

        # A path is cut before each space if spaces come through as they are and no piece has a mark behind another character.
        m = self._model(path)
        norm = m.normalizer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and not m.trainer_spec.treat_whitespace_as_suffix
        self.cuts = bool(plain) and not any("▁" in p.piece.lstrip("▁") for p in m.pieces)

    @staticmethod
    def _model(path: str):
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            return sentencepiece_model_pb2.ModelProto.FromString(f.read())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.sp.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class _Shapes(dict):
    """How many tokens of A and of B end in a span, remembered for short spans."""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        out = span.count(ENDS_A) + 1, span.count(ENDS_B) + 1
        if len(span) <= 16:
            self[span] = out
        return out


class Aligner:
    def __init__(self, a: str, b: str):
        self.a, self.b = byte_bpe(a), pieces(b)
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes]) for t in (self.a, self.b))
        self.text_a, self.text_b = ([str(i) for i in range(t.size)] for t in (self.a, self.b))
        self.shapes, self.cache = _Shapes(), {}

    def labels(self, a: np.ndarray, b: np.ndarray) -> bytes:
        """The label of each byte; a and b are ids whose bytes are the same."""
        ends = np.cumsum(self.size_a[a])
        marks = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
        marks[ends - 1] = 1
        marks[np.cumsum(self.size_b[b]) - 1] += 2
        return _LABELS[marks].tobytes()

    def _same(self, text: str, a: list[int], b: list[int]) -> bool:
        whole = f" {text}".encode()
        return b"".join([self.a.bytes[i] for i in a]) == whole and b"".join([self.b.bytes[i] for i in b]) == whole

    def _aligned(self, a: list[int], b: list[int], bounds: np.ndarray) -> list[tuple[int, int, str, bytes]]:
        """(n_a, n_b, groups, links) of each of the stretches of bytes that end at bounds, where tokens of both end."""
        x, y = np.array(a, int), np.array(b, int)
        spans = _SPAN.findall(self.labels(x, y))
        shapes = [self.shapes[s] for s in spans]
        i, j, out, ta, tb = 0, 0, [], [self.text_a[k] for k in a], [self.text_b[k] for k in b]
        for m, n in shapes:
            out.append(f"{ta[i]}|{tb[j]}" if m == n == 1 else f"{','.join(ta[i : i + m])}|{','.join(tb[j : j + n])}")
            i, j = i + m, j + n
        last = np.cumsum(np.array(shapes, int).reshape(-1, 2), axis=0)
        links = np.stack([x[last[:, 0] - 1], y[last[:, 1] - 1]], axis=1).astype("<u4").tobytes()
        # The group that ends with each stretch, and how many tokens there are up to it.
        upto = np.searchsorted(np.cumsum([len(s) for s in spans]), bounds) + 1
        n = np.diff(last[upto - 1], axis=0, prepend=0).tolist()
        upto = upto.tolist()
        return [(*k, ";".join(out[i:j]), links[8 * i : 8 * j]) for k, i, j in zip(n, [0, *upto], upto, strict=False)]

    def _whole(self, text: str) -> tuple[int, int, str, bytes] | None:
        """Of one text; None where the bytes of either tokenizer are not those of a space and the text."""
        a, b = self.a.encode(f" {text}", plain=True), self.b.encode([text])[0]
        return self._aligned(a, b, np.array([1 + len(text.encode())]))[0] if self._same(text, a, b) else None

    def _many(self, own: list[str]) -> dict[str, tuple[int, int, str, bytes] | None]:
        """Of parts without white space at either end: as one text, since both tokenizers cut before each."""
        if not own:
            return {}
        a, each = self.a.encode("".join([f" {p}" for p in own]), plain=True), self.b.encode(own)
        b = [i for x in each for i in x]
        sizes = [1 + len(p.encode()) for p in own]
        if self._same(" ".join(own), a, b) and sizes == [sum([len(self.b.bytes[i]) for i in x]) for x in each]:
            return dict(zip(own, self._aligned(a, b, np.cumsum(sizes)), strict=True))
        return {p: self._whole(p) for p in own}

    def align(self, texts: list[str]) -> list[tuple[int, int, str, bytes]]:
        """(n_a, n_b, groups, links) of each text."""
        cut = [(parts(t) if self.b.cuts else [t]) if t else [] for t in texts]
        new = [p for p in set().union(*cut) if p not in self.cache]
        short = [p for p in new if len(p) <= SHORT and not p[0].isspace() and not p[-1].isspace()]
        known = self._many(short)
        self.cache.update(list(known.items())[: max(0, CACHE - len(self.cache))])
        known |= {p: self._whole(p) for p in set(new).difference(short)}
        out, get = [], self.cache.get
        for text, own in zip(texts, cut, strict=True):
            found = [get(p) or known.get(p) for p in own]
            if None in found:  # the whole text decides
                found = [x for x in [self._whole(text)] if x]
            a, b = (sum(map(itemgetter(i), found)) for i in (0, 1))
            out.append((a, b, ";".join(map(itemgetter(2), found)), b"".join(map(itemgetter(3), found))))
        return out


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups long, groups string, links binary) of each document row.

    a: a byte-level BPE file, which encodes a space and the text; b: a sentencepiece model that puts the space itself.
    Special tokens' strings are ordinary text. groups is `a1,a2|b1;a3|b2,b3`: the ids, in order, of the tokens between two
    places where tokens of both end. links holds the last id of A and of B of each group, the two that end together, as
    pairs of little-endian unsigned 32-bit integers. Null and empty texts, and those that either tokenizer's bytes don't
    give back, have no tokens. Repeated rows each give a row, an empty table none; other columns are not read.
    """

    def start():
        own = aligner(a, b)

        def work(texts: list[str]) -> list[pa.Array]:
            n_a, n_b, groups, links = zip(*own.align(texts), strict=True)
            return [pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array([len(x) // 8 for x in links], pa.int64()), pa.array(groups, pa.string()), pa.array(links, pa.binary())]

        return work

    return map_texts(docs, id_col, text_col, start, "n_a long, n_b long, n_groups long, groups string, links binary", most=1_000_000)


def _pairs(links: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The links of the rows as a * 2 ** 32 + b, and how many each row has."""
    rows = links.to_pylist()
    both = np.frombuffer(b"".join(rows), "<u4").astype(np.int64).reshape(-1, 2)
    return (both[:, 0] << 32) | both[:, 1], np.array([len(x) // 8 for x in rows])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of the corpus hold a pair of ids, and whether no other pair of that b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, keys, counts = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def fold():
            own, n = np.unique(np.concatenate(held), return_counts=True)
            every, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([counts, n]), len(every)).astype(np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(counts)], names=["a", "b", "n"])

        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                held.append(_pairs(batch.column(0).slice(lo, hi - lo))[0])
                size += len(held[-1])
                if size >= HELD:
                    keys, counts = fold()
                    held, size = [], 0
                    if len(keys) >= HELD:
                        yield out()
                        keys, counts = keys[:0], counts[:0]
        if held:
            keys, counts = fold()
        if len(keys):
            yield out()

    # Of one b there are at most as many rows as A has ids.
    found = aligned.select("links").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = found.groupBy("b").agg(F.max("n").alias("most"))
    return found.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def link_measures(aligned: DataFrame, counts: DataFrame, most: int = PAIRS) -> DataFrame:
    """aligned with n_links, n_best (links of the pairs that are best for their b) and count_sum, in place of links.

    counts: a kept frame as pair_counts() gives it. If it has at most `most` rows, each task looks links up in it; a larger
    one is joined to the distinct links of each row, by a shuffle whose hot pairs adaptive execution splits.
    """
    if counts.count() <= most:
        rows = counts.toPandas()
        key = (rows["a"].to_numpy(np.int64) << 32) | rows["b"].to_numpy(np.int64)
        order = np.argsort(key)
        known = aligned.sparkSession.sparkContext.broadcast((key[order], rows["n"].to_numpy(np.int64)[order], rows["best"].to_numpy(bool)[order]))
        rest = [c for c in aligned.columns if c != "links"]

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, n, best = known.value
            for whole in batches:
                for lo, hi in slices(whole.column(whole.num_columns - 1)):
                    batch = whole.slice(lo, hi - lo)
                    pairs, sizes = _pairs(batch.column(batch.num_columns - 1))
                    at, ends = np.searchsorted(keys, pairs), np.concatenate([[0], np.cumsum(sizes)])
                    sums = [np.concatenate([[0], np.cumsum(x[at], dtype=np.int64)]) for x in (best, n)]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes.astype(np.int64)), *[pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]], names=[*rest, "n_links", "n_best", "count_sum"])

        kinds = [f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in rest]
        return aligned.select(*rest, "links").mapInArrow(look, ", ".join([*kinds, "n_links long", "n_best long", "count_sum long"]))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.column(0).to_pylist()):
                keys, n = np.unique(_pairs(batch.column(1).slice(i, 1))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), row)), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n.astype(np.int64))], names=["own", "a", "b", "k"])

    linked = aligned.select("row", "links").mapInArrow(spread, "own long, a long, b long, k long").join(counts, ["a", "b"])
    sums = linked.groupBy("own").agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    out = aligned.withColumn("n_links", (F.length("links") / 8).cast("long")).drop("links").join(sums, F.col("row") == F.col("own"), "left").drop("own")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/aligned-{uuid.uuid4().hex}"
    out = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    # Counts need all links first; Parquet keeps them at a quarter of the size that a checkpoint would take.
    out.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_a", "n_b", "n_groups", digest, "links").write.option("compression", "zstd").parquet(path)
    kept = spark.read.parquet(path)
    return link_measures(kept, keep(pair_counts(kept))).drop("row")
