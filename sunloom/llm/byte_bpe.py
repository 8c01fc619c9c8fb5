"""Byte-level BPE files, encoded by tiktoken with the file's own vocabulary and, for odd texts, by the tokenizers library.

Both give the same ids (tested on every code point); tiktoken takes a third of the time.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

from .bpe import _SPACE, _byte_chars

#: The pattern of a word that the library's ByteLevel cut has. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longest runs of white space and of other characters that tiktoken's backtracking gets; longer ones go to the library.
BLANKS = WORD = 50_000
_TWO, _CUT = re.compile(f"[{_SPACE}]{{2}}"), re.compile(f"(?<=[^{_SPACE}]) (?=[^{_SPACE}])")


def parts(text: str) -> list[str]:
    """The text cut at single spaces, with no white space on either side, where the pattern always begins a new word."""
    return _CUT.split(text) if _TWO.search(f" {text} ") else text.split(" ")


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "unk_token"))
        plain = plain and spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
        byte = {c: b for b, c in enumerate(_byte_chars())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special} if plain else {}
        merged = [ranks.get(bytes(byte[c] for c in "".join(x if isinstance(x, list) else x.split(" ")))) for x in model["merges"]] if plain else []
        if not plain or merged != sorted(set(merged)) or None in merged or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError(f"{path}: only byte-level BPE files without a normalizer, whose ids follow their merges, are encoded")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens that take white space or whole words are not known")
        self.path, self._lib = path, {}
        self.tik = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = 1 + max([*ranks.values(), *self.special.values()])
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        self.bytes = [b""] * self.size
        for t, i in [*ranks.items(), *((t.encode(), i) for t, i in self.special.items())]:
            self.bytes[i] = t
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.blanks = re.compile(r"\s{%d}" % BLANKS)

    def _library(self, text: str, plain: bool) -> list[int]:
        if plain not in self._lib:
            from tokenizers import Tokenizer

            lib = Tokenizer.from_file(self.path)
            lib.no_truncation(), lib.no_padding()
            lib.encode_special_tokens = plain
            self._lib[plain] = lib
        return self._lib[plain].encode(text, add_special_tokens=False).ids

    def encode(self, text: str, plain: bool = False) -> list[int]:
        """The ids of a text. plain: strings of special tokens are ordinary text; else they are their tokens."""
        if len(text) >= WORD and (self.blanks.search(text) or max(map(len, text.split()), default=0) >= WORD):
            return self._library(text, plain)
        if plain or self.marks is None or not any(t in text for t in self.special):
            return self.tik.encode_ordinary(text)
        out: list[int] = []
        for part in self.marks.split(text):
            out += [self.special[part]] if part in self.special else self.tik.encode_ordinary(part)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a text, special tokens included, as little-endian integers of self.kind."""
        return array("H" if self.kind == "<u2" else "I", self.encode(text)).tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
