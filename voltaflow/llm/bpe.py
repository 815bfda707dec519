"""BPE encoding and decoding with a compiled lexicon of frequent words (operator 1).

Frequent words are counted over all documents, their ids compiled into a minimal acyclic
transducer (lexicon.py) that every worker maps into memory; other words are merged exactly.

Defined results: null text counts as empty; empty text has no ids; a long text is encoded whole;
repeated rows are encoded each; columns besides the key and the text aren't read.
"""

from __future__ import annotations

import heapq
import json
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, materialize
from .lexicon import Lexicon, compile_lexicon

#: Split of the byte-level tokenizer (fixed value of that public tokenizer).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in the lexicon, their greatest length in bytes, entries in a worker's memo.
LEXICON_WORDS, LEXICON_BYTES, MEMO = 50_000, 64, 300_000
_NONE = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        out[chr(256 + n)] = b
    return out


class _Irregular(Exception):
    """A piece between spaces that isn't a word of its own: it touches other whitespace."""


class _Memo(dict):
    def __init__(self, make, lead: str) -> None:
        super().__init__()
        self.make, self.lead = make, lead

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Irregular
        out = self.make(self.lead + part)
        if len(part) <= LEXICON_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[part] = out
        return out


class _Words(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        out = self.make(word)
        if len(word) <= LEXICON_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out


class ByteBpe:
    """A byte-level BPE tokenizer read from a tokenizers JSON file's bytes."""

    def __init__(self, definition: bytes, lexicon: bytes | None = None) -> None:
        d = json.loads(definition)
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", ())}
        raw = {piece: bytes(alphabet[c] for c in piece) for piece in d["model"]["vocab"] if all(c in alphabet for c in piece)}
        self.bytes_of: list[bytes] = [b""] * (1 + max([*d["model"]["vocab"].values(), *self.special.values()]))
        for piece, i in d["model"]["vocab"].items():
            self.bytes_of[i] = raw.get(piece, piece.encode())
        for piece, i in self.special.items():
            self.bytes_of[i] = piece.encode()
        vocab = d["model"]["vocab"]
        self.single = [vocab.get(c) for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
        self.pairs: dict[int, int] = {}
        for rank, merge in enumerate(d["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
        self.core = self._compiled(d["model"], raw)
        self.split = regex.compile(SPLIT)
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.head, self.tail, self.words = _Memo(self._part, ""), _Memo(self._part, " "), _Words(self._word)
        self.at_space = regex.compile(r"(?<=\S) (?=\S)")

    def _compiled(self, model: dict, raw: dict[str, bytes]):
        """tiktoken's compiled merge loop, where ids are in merge order, so that its ranks say the same as the merges; else None."""
        made = [v & 0xFFFFF for v in self.pairs.values()]
        if len(model["vocab"]) - len(made) != 256 or made != sorted(made) or sorted(self.single) != [i for i in range(256)]:
            return None
        import tiktoken

        last = max(made)
        ranks = {b: model["vocab"][piece] for piece, b in raw.items() if model["vocab"][piece] <= last}
        return getattr(tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), "_core_bpe", None)

    def merge(self, word: bytes) -> bytes:
        """Exact merges of one word: lowest rank first, leftmost first among equals."""
        if self.core is not None:
            return array("I", self.core.encode_single_piece(word)).tobytes() if word else b""
        return self.merge_plain(word)

    def merge_plain(self, word: bytes) -> bytes:
        """The same merges in Python, for vocabularies whose ids aren't in merge order."""
        ids = [self.single[b] for b in word]
        get = self.pairs.get
        if len(ids) > 96:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min([get(a << 20 | b, _NONE) for a, b in zip(ids, ids[1:])])
            if best == _NONE:
                break
            new, out, i, n = best & 0xFFFFF, [], 0, len(ids)
            while i < n:
                if i + 1 < n and get(ids[i] << 20 | ids[i + 1]) == best:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return np.array(ids, "<u4").tobytes()

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same merges by a heap over linked neighbours, in n log n."""
        n, get = len(ids), self.pairs.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(v >> 20, i, v & 0xFFFFF, ids[i], ids[i + 1]) for i in range(n - 1) if (v := get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (v := get(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (v >> 20, x, v & 0xFFFFF, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        raw = word.encode()
        return (self.lexicon and self.lexicon.lookup(raw)) or self.merge(raw)

    def _part(self, part: str) -> bytes:
        """Words have a memo of their own: parts longer than its limit, as in texts without single spaces, are made of them."""
        return b"".join(map(self.words.__getitem__, self.split.findall(part)))

    def _plain(self, text: str) -> bytes:
        """Single spaces between two other characters always begin a word, so parts between them are independent."""
        if not text:
            return b""
        head, *parts = text.split(" ")
        try:
            return self.head[head] + b"".join(map(self.tail.__getitem__, parts))
        except _Irregular:
            head, *parts = self.at_space.split(text)
            get = self.tail.get
            return self._part(head) + b"".join([get(p) or self._part(" " + p) for p in parts])

    def encode(self, text: str | None) -> bytes:
        """Ids of the text, special tokens in it included, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.at_special is None or not self.at_special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", errors="replace")


def greatest_id(definition: bytes) -> int:
    d = json.loads(definition)
    return max([*d["model"]["vocab"].values(), *(t["id"] for t in d.get("added_tokens", ()))])


_LOADED: dict[str, ByteBpe] = {}


def loaded(key: str, definition, lexicon=None) -> ByteBpe:
    """The worker's tokenizer: made once, kept while its key lasts."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(definition.value, lexicon.value if lexicon is not None else None)
    return _LOADED[key]


def frequent_words(spark: SparkSession, docs: DataFrame, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words of the split over all documents, of at most LEXICON_BYTES bytes and seen twice or more.

    Words of one level of counts come all or not at all, so at most `words` reach the driver, without a sort.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, heads, tails = regex.compile(SPLIT), Counter(), Counter()

        def flush() -> pa.RecordBatch:
            found: Counter = Counter()
            for lead, parts in (("", heads), (" ", tails)):
                for part, n in parts.items():
                    for word in split.findall(lead + part):
                        found[word] += n
                parts.clear()
            kept = {w: n for w, n in found.items() if len(w.encode()) <= LEXICON_BYTES}
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for value in batch.column(0).to_pylist():
                head, *parts = (value or "").split(" ")
                heads[head] += 1
                tails.update(parts)
            if len(heads) + len(tails) > 2 * MEMO:
                yield flush()
        yield flush()

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "word string, n long").where("word <> ''")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counted = materialize(spark, counted, "words").withColumn("level", F.floor(16 * F.log2("n")))
    # the counts' levels (sixteenths of a power of two, so at most about a thousand) tell from which level up the words fit
    least, total = None, 0
    for level, n in sorted(((r.level, r.n) for r in counted.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True):
        total += n
        if total > words:
            break
        least = level
    return [] if least is None else [r.word for r in counted.where(F.col("level") >= least).select("word").collect()]


def build_lexicon(definition: bytes, words: list[str]) -> bytes:
    bpe = ByteBpe(definition)
    return compile_lexicon((raw, np.frombuffer(bpe.merge(raw), "<u4").tolist()) for raw in (w.encode() for w in words))


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", words: int = LEXICON_WORDS, decode: bool = True) -> DataFrame:
    """key, ids (binary, little-endian unsigned 32-bit), n_tokens and, if asked, decoded: the text that the ids give back."""
    bounded_batches(spark)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    lexicon = build_lexicon(data, frequent_words(spark, docs, text, words))
    definition, automaton = spark.sparkContext.broadcast(data), spark.sparkContext.broadcast(lexicon)
    name = f"{tokenizer_path}:{hash(lexicon)}"
    fields = [pa.field("ids", pa.binary()), *([pa.field("decoded", pa.string())] if decode else [])]

    def run(batch: dict) -> dict:
        bpe = loaded(name, definition, automaton)
        ids = [bpe.encode(t) for t in batch["text"].to_pylist()]
        out = {"key": batch["key"], "ids": ids}
        if decode:
            out["decoded"] = [bpe.decode(i) for i in ids]
        return out

    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    schema = "key long, ids binary" + (", decoded string" if decode else "")
    out = map_arrow(src, run, schema, pa.schema([pa.field("key", pa.int64()), *fields]))
    return out.withColumnRenamed("key", key).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode_documents(spark: SparkSession, encoded: DataFrame, tokenizer_path: str, key: str = "doc_id") -> DataFrame:
    """key, decoded: the text of a column `ids` as written by encode_documents."""
    bounded_batches(spark)
    with open(tokenizer_path, "rb") as f:
        definition = spark.sparkContext.broadcast(f.read())

    def run(batch: dict) -> dict:
        bpe = loaded(tokenizer_path, definition)
        return {"key": batch["key"], "decoded": [bpe.decode(i or b"") for i in batch["ids"].to_pylist()]}

    src = encoded.select(F.col(key).cast("long").alias("key"), "ids")
    return map_arrow(src, run, "key long, decoded string", pa.schema([("key", pa.int64()), ("decoded", pa.string())])).withColumnRenamed("key", key)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    import public_tokenizers

    from .common import table

    out = encode_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
