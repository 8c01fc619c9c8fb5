"""BPE encoding and decoding with a word-level merge queue (operator 5).

Each word is merged by a priority queue of (merge rank, position) over a doubly linked list of symbols. Entries whose
pair has changed since they were queued are stale and skipped. Decoding concatenates vocabulary strings.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import forget, map_texts, remembered, table

#: White space as the normalizer's pattern has it.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Distinct words whose encoding one worker remembers.
CACHE = 200_000


# Fixed values of Unicode 16.0 and 17.0, beyond the 15.1 of Python 3.13's unicodedata: letters and numbers that 16.0 added,
# as first and last code point, and lower-case forms of capitals that both added.
ADDED = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D40-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B-1138B 1138E-1138E 11390-113B5 113B7-113B7 113D1-113D1 113D3-113D3 116D0-116E3 11BC0-11BE0 11BF0-11BF9 13460-143FA 16100-1611D 16130-16139 16D40-16D6C 16D70-16D79 18CFF-18CFF 1CCF0-1CCF9 1E5D0-1E5ED 1E5F0-1E5FA"
LOWERED = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LOWERED |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


@lru_cache(maxsize=1)
def _newer() -> str:
    """The ranges of code points that the regex module takes for letters or numbers, but the library's tables don't.

    The library's pattern has the letters and numbers of Unicode 16.0; the regex module has newer tables.
    """
    every = "".join(chr(c) for c in chain(range(0xD800), range(0xE000, 0x110000)))
    added = {c for x in ADDED.split() for a, b in [x.split("-")] for c in range(int(a, 16), int(b, 16) + 1)}
    new = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c)[0] not in "LN" and ord(c) not in added]
    ranges: list[list[int]] = []
    for c in new:
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


def _written(kind: str) -> str:
    """The ranges of code points up to U+FFFF that the regex module finds by a class."""
    found = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    return "".join(f"{m[0][0]}-{m[0][-1]}" for m in regex.finditer(f"{kind}+", found))


def _pattern(spec: dict) -> str:
    """The file's own pattern of a word; files that normalize or cut otherwise are refused, not encoded wrongly."""
    normal = [(x["type"], x.get("pattern"), x.get("content")) for x in (spec["normalizer"] or {}).get("normalizers", [])]
    cuts = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = next((x for x in cuts if x["type"] == "Split"), {})
    known = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
    plain = [x["type"] for x in cuts] == ["Split", "ByteLevel"] and split["behavior"] == "Removed" and split["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]
    if normal != known or not plain or spec["model"]["type"] != "BPE" or not spec["model"].get("end_of_word_suffix") or spec["decoder"]:
        raise ValueError("only BPE files with NFC, white space replaced, lower case, a split by a pattern, bytes and word ends are encoded")
    return split["pattern"]["Regex"]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class WordBpe:
    """Encodes and decodes with a tokenizer file that has word ends, lower case and byte-level symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [tuple(x.split(" ") if isinstance(x, str) else x) for x in model["merges"]]
        # By rank, the ids of a merge's two symbols and of what they make; ranks by both ids in one number.
        self.left, self.right = ([self.vocab[m[side]] for m in merges] for side in (0, 1))
        self.made = [self.vocab[a + b] for a, b in merges]
        self.ranks = {a << 32 | b: i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True))}
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: t for t, i in chain(self.vocab.items(), self.added.items())}
        self.inner, self.last = ([self.vocab.get(c + end, -1) for c in _byte_chars()] for end in ("", self.end))
        pattern = _pattern(spec).replace(r"\s", _SPACE)
        self.pattern = regex.compile(pattern)
        # For the few texts with characters that only the regex module knows as letters or numbers.
        self.newer = regex.compile(f"[{_newer()}{''.join(map(chr, LOWERED))}]")
        self.newest = re.compile(f"[{min(c for c in _newer() + ''.join(map(chr, LOWERED)) if c != '-')}-\U0010ffff]")
        # Up to U+FFFF the classes are written out, for the faster module; other texts are looked for by the class of what lies beyond.
        self.plain = re.compile(pattern.replace(r"\p{L}", _written(r"\p{L}")).replace(r"\p{N}", _written(r"\p{N}")))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")
        self.exact = regex.compile(regex.sub(r"\](?=\+|\||$)", f"--[{_newer()}]]", pattern), regex.V1) if _newer() else self.pattern
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.cache: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def word_ids(self, word: str) -> list[int]:
        data = word.encode()
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        n, ranks, left, right = len(symbols), self.ranks, self.left, self.right
        before, after, shift = list(range(-1, n - 1)), list(range(1, n + 1)), n.bit_length()
        # An entry is one number, the rank in front of the position.
        queue = [r << shift | i for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks.get(a << 32 | b)) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            rank, i = top >> shift, top & (1 << shift) - 1
            j = after[i]
            if symbols[i] != left[rank] or j >= n or symbols[j] != right[rank]:
                continue  # stale
            symbols[i], symbols[j] = self.made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(symbols[i] << 32 | symbols[k])) is not None:
                    heapq.heappush(queue, r << shift | i)
            if (k := before[i]) >= 0 and (r := ranks.get(symbols[k] << 32 | symbols[i])) is not None:
                heapq.heappush(queue, r << shift | k)
        return [s for s in symbols if s >= 0]

    def _word(self, word: str) -> tuple[bytes, str]:
        if (out := self.older.get(word)) is None:
            ids = self.word_ids(word)
            out = (pack(f"<{len(ids)}i", *ids), self.decode(ids))
        if len(self.cache) >= CACHE // 2:
            # Words that are met again come back from the older half, so the frequent ones stay.
            self.older, self.cache = self.cache, {}
        self.cache[word] = out
        return out

    def words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.newest.search(text) and self.newer.search(text):
                return self.exact.findall(text.lower().translate(LOWERED))
        text = text.lower()
        return self.pattern.findall(text) if not text.isascii() and self.beyond.search(text) else self.plain.findall(text)

    def _all(self, words: list[str]) -> list[tuple[bytes, str]]:
        out = list(map(self.cache.get, words))
        if None in out:
            miss, get = self._word, self.cache.get  # a dict that is made older meanwhile is still right
            out = [x or get(w) or miss(w) for x, w in zip(out, words, strict=True)]
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the decoded text."""
        out, at = [], 0
        if "<" in text:
            for m in self.special.finditer(text):
                out += self._all(self.words(text[at : m.start()]))
                out.append((pack("<i", self.added[m[0]]), m[0]))
                at = m.end()
        out += self._all(self.words(text[at:] if at else text))
        return b"".join([x[0] for x in out]), " ".join([x[1] for x in out if x[1]])

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, one space between two; unknown ids are left out."""
        return " ".join([self.strings[i] for i in ids if i in self.strings])


@remembered
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, ids array<int>, decoded string) for each input row.

    Null and empty texts give no ids and an empty decoded text; white space gives none either. Repeated rows each give
    a row, an empty table gives none, and other columns are neither read nor returned, so their names can't clash. A
    text is held whole by one task, in slices of a few MB together with others.
    """

    def start():
        forget(tokenizer)
        bpe = tokenizer(path)

        def work(texts: list[str]) -> list[pa.Array]:
            out = [bpe.encode(t) for t in texts]
            ids = np.frombuffer(b"".join([x[0] for x in out]), "<i4")
            ends = np.cumsum([0, *(len(x[0]) // 4 for x in out)], dtype="i4")
            return [pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array([x[1] for x in out], pa.string())]

        return work

    return map_texts(docs, id_col, text_col, start, "ids array<int>, decoded string")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """A row (id, decoded string) for each row of ids; null ids give an empty text."""

    def run(batches):
        bpe = tokenizer(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"{id_col} {encoded.schema[id_col].dataType.simpleString()}, decoded string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
