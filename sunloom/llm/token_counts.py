"""Token counts of sentencepiece models (operator 3): only counts, no piece lists.

The model says how it cuts a text. Of a unigram model, an Aho-Corasick automaton enumerates the vocabulary pieces that
end at each place, and dynamic programming (Viterbi) carries the best score and its number of pieces. Tie rule of unigram
tokenizers: of equal scores at one place, the piece that starts first stays. A BPE model's scores are merge ranks, no log
probabilities, so Viterbi can't give its counts; there the best-ranked adjacent pair is merged until none is left, the
leftmost of equal ranks first. A character that no single piece covers counts as its UTF-8 bytes (byte fallback); in
Viterbi it costs the lowest score less 10.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import map_texts, table

SPACE = "▁"
#: Distinct words whose count one worker remembers.
CACHE = 500_000


class Counter:
    """Counts the pieces of texts. scores: piece -> score; only ordinary pieces, no control or byte pieces."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        # No piece has a space mark behind another character: then a path can be cut before each run of marks.
        cuts = not any(SPACE in p.lstrip(SPACE) for p in scores)
        self.pattern = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if cuts else r"(?s).+")
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> int:
        raise NotImplementedError

    def _miss(self, part: str) -> int:
        if len(self.cache) >= CACHE:
            self.cache.clear()
        self.cache[part] = n = self.pieces(part)
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        get, miss, total = self.cache.get, self._miss, 0
        for part in self.pattern.findall(SPACE + text.replace(" ", SPACE)):
            n = get(part)
            total += miss(part) if n is None else n
        return total


class UnigramCounter(Counter):
    """Scores are log probabilities; the best path counts."""

    def __init__(self, scores: dict[str, float]):
        super().__init__(scores)
        self.automaton = ahocorasick.Automaton()
        for piece, score in scores.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p in scores if len(p) == 1}
        self.unknown = min(scores.values(), default=0.0) - 10

    def pieces(self, text: str) -> int:
        n, low = len(text), float("-inf")
        best, count = [0.0] + [low] * n, [0] * (n + 1)
        ends: dict[int, list[tuple[int, float]]] = {}
        for end, match in self.automaton.iter(text):
            ends.setdefault(end + 1, []).append(match)
        for at in range(1, n + 1):
            char = text[at - 1]
            options = [(at - size, score, 1) for size, score in ends.get(at, ())]
            if char not in self.single:
                options.append((at - 1, self.unknown, len(char.encode())))
            for begin, score, pieces in sorted(options, key=lambda x: x[0]):
                if best[begin] + score > best[at]:
                    best[at], count[at] = best[begin] + score, count[begin] + pieces
        return count[n]


class MergeCounter(Counter):
    """Scores are merge ranks, higher first; pairs are merged as long as their string is a piece."""

    def pieces(self, text: str) -> int:
        symbols, n, scores = list(text), len(text), self.scores
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = [(-scores[pair], i, pair) for i in range(n - 1) if (pair := text[i : i + 2]) in scores]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if not symbols[i] or j >= n or symbols[i] + symbols[j] != pair:
                continue  # stale
            symbols[i], symbols[j] = pair, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in scores:
                    heapq.heappush(queue, (-scores[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in scores:
                heapq.heappush(queue, (-scores[new], h, new))
        return sum(1 if s in scores else len(s.encode()) for s in symbols if s)


#: Model types of sentencepiece.
KINDS = {1: UnigramCounter, 2: MergeCounter}


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a model file; models whose rules it doesn't have are refused, not counted by others."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(path, "rb") as f:
        model = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    kind, norm, piece = model.trainer_spec.model_type, model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap and model.trainer_spec.byte_fallback and not model.trainer_spec.treat_whitespace_as_suffix
    if kind not in KINDS or not plain or any(p.type in (piece.USER_DEFINED, piece.UNUSED) for p in model.pieces):
        raise ValueError(f"{path}: only unigram and BPE models with identity normalization, a space put before the text, byte fallback and no user-defined or unused pieces are counted")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return KINDS[kind]({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))})


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (id, n_tokens long, n_chars long, n_bytes long) for each input row.

    path: a sentencepiece model file, unigram or BPE; n_tokens is the number of ids that the library gives. Null and empty texts have 0 tokens. Repeated rows each give a row, an empty table gives none, other
    columns are neither read nor returned. A long text costs time in proportion to its length.
    """

    def start():
        c = counter(path)
        return lambda texts: [pa.array([c.count(t) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64())]

    return map_texts(docs, id_col, text_col, start, "n_tokens long, n_chars long, n_bytes long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
