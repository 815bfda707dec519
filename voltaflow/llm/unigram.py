"""Token counts by a count-only Viterbi over a unigram vocabulary (operator 3).

An Aho-Corasick automaton enumerates the vocabulary's matches; dynamic programming carries only the
best score and the piece count of each position, no back pointers. Ties follow the tokenizer: of two
paths with equal scores the one found first stays, which is the one whose last piece starts earlier;
a character without a piece of its own is unknown, at the lowest score less ten, after other pieces
of its start; unknown characters in a row are one piece, spelled in bytes if byte pieces exist.

Defined results: null and empty texts have 0 pieces and score 0; spaces become the word mark, one is
put in front; repeated rows count each; long texts count whole; other columns aren't read.

Texts are split at each space, as Metaspace(split=True) of the tokenizers library does, and each part is
counted alone: pieces that are runs of marks are never used, so a run of spaces counts one by one.
"""

from __future__ import annotations

import math
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, table

MARK, UNKNOWN_PENALTY, MEMO = "▁", 10.0, 300_000


class UnigramCounter(dict):
    """word (without its mark) -> (pieces, score); a dict so that repeated words cost one lookup."""

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0, byte_fallback: bool = True) -> None:
        super().__init__()
        self.unk, self.bytes = pieces[unk_id][0], byte_fallback and all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in range(256))
        self.unk_score = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.auto, self.plain, self.inner = ahocorasick.Automaton(), ahocorasick.Automaton(), {}
        self.chars = {p for p, _ in pieces if len(p) == 1}
        for p, s in pieces:
            if p:
                self.auto.add_word(p, (len(p), s, p == self.unk))
                self.plain.add_word(p, (len(p), s))
        self.auto.make_automaton()
        self.plain.make_automaton()
        # runs of characters that no piece holds cut a word; where runs count by bytes, the parts don't touch each other
        held = {c for p, _ in pieces for c in p}
        self.cut = re.compile("([^" + "".join(map(re.escape, sorted(held))) + "]+)") if self.bytes else None

    def run_length(self, run: str) -> int:
        """Pieces of a run of unknown characters."""
        return len(run.encode()) if self.bytes and run != self.unk else 1 if run else 0

    def word(self, word: str) -> tuple[int, float]:
        n = len(word)
        score, count, run = [0.0] + [None] * n, [0] * (n + 1), [""] * (n + 1)
        found: list[list] = [[] for _ in range(n + 1)]
        for end, match in self.auto.iter(word):
            found[end + 1].append(match)
        for end in range(1, n + 1):
            best = None
            for length, s, unknown in sorted(found[end], reverse=True):  # earlier starts first
                at = end - length
                if best is None or score[at] + s > best:
                    best, start, is_unknown = score[at] + s, at, unknown
            if word[end - 1] not in self.chars and (best is None or score[end - 1] + self.unk_score > best):
                best, start, is_unknown = score[end - 1] + self.unk_score, end - 1, True
            score[end] = best
            if is_unknown:
                count[end], run[end] = count[start], run[start] + word[start:end]
            else:
                count[end] = count[start] + self.run_length(run[start]) + 1
        return count[n] + self.run_length(run[n]), score[n]

    def known(self, word: str) -> tuple[int, float]:
        """The same for a word all of whose characters are pieces: matches come by end, of one end the longest first."""
        n = len(word)
        score, count = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for end, (length, s) in self.plain.iter(word):
            value = score[end + 1 - length] + s
            if value > score[end + 1]:
                score[end + 1], count[end + 1] = value, count[end + 1 - length] + 1
        return count[n], score[n]

    def any_word(self, word: str) -> tuple[int, float]:
        if self.unk in word:
            return self.word(word)
        if self.chars.issuperset(word):
            return self.known(word)
        if self.cut is None:
            return self.word(word)
        n, score = 0, 0.0
        for i, part in enumerate(self.cut.split(word)):
            if i % 2:  # unknown characters
                n, score = n + len(part.encode()), score + len(part) * self.unk_score
            elif part:
                found = self.inner.get(part)
                if found is None:
                    found = self.known(part) if self.chars.issuperset(part) else self.word(part)
                    if len(self.inner) >= MEMO:
                        self.inner.clear()
                    self.inner[part] = found
                n, score = n + found[0], score + found[1]
        return n, score

    def __missing__(self, part: str) -> tuple[int, float]:
        out = self.any_word(MARK + part)
        if len(part) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[part] = out
        return out

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(MARK, " ")
        parts = (text[1:] if text[0] == " " else text).split(" ")
        n, score = zip(*map(self.__getitem__, parts))
        return sum(n), sum(score)


def vocabulary(model_path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with their scores, and the unknown piece's id, of a sentencepiece file."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())], p.unk_id()


_LOADED: dict[str, UnigramCounter] = {}


def count_tokens(spark: SparkSession, docs: DataFrame, pieces: list[tuple[str, float]], unk_id: int = 0, key: str = "doc_id", text: str = "text", byte_fallback: bool = True) -> DataFrame:
    """key, n_tokens, score of every document; the vocabulary is broadcast (its size is the tokenizer's)."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(pieces)
    name = f"{len(pieces)}:{unk_id}:{byte_fallback}:{hash(tuple(pieces))}"

    def run(batch: dict) -> dict:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = UnigramCounter(shared.value, unk_id, byte_fallback)
        n, score = zip(*map(_LOADED[name].count, batch["text"].to_pylist()))
        return {"key": batch["key"], "n_tokens": n, "score": score}

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    out = map_arrow(src, run, "key long, n_tokens long, score double", pa.schema([("key", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())]))
    return out.withColumnRenamed("key", key)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text under the public 32k vocabulary's pieces and scores."""
    import public_tokenizers

    pieces, unk = vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return count_tokens(spark, table(spark, sf_dir, "documents"), pieces, unk)
