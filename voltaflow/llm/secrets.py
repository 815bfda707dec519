"""Secret scans by assignment-aware lexing (operator 4).

Base spans come from three fixed patterns. The method then reads source and configuration syntax:
every assignment (=, :=, =>, : in code, JSON, YAML, TOML, INI and shell) becomes a pair of name and
value, where a value is a chain of literals and of names; names known from earlier assignments stand
for their literals, so constants are carried to the names they end up in. A literal is scored by the
most sensitive name it reaches and by its own look; high scores add `named` spans at the literal.

A pair's value is never built: the spelling of a chain (length, kinds and shares of its characters, those
beyond ASCII in 128 classes) is added up from its parts', for chains that a sensitive name is given and
what they are made of, and is dropped behind its last use. Scores go back from names to literals once. So
work and memory grow with the text, however constants are chained. A name is the word right before its sign
(quotes, a bracket and blanks may stand between), of any length; a value ends where no joint follows. A
literal that is a placeholder (of any length) has no strength, nor has a chain of placeholders only.

Defined results: null text counts as empty; a document without secrets has zeros and empty strings;
long texts are scanned whole; repeated rows give repeated results; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, table

#: Base patterns (fixed by the contract), in the order in which kinds of one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "named")
ASSIGN_MIN = 12

OPERATOR = re.compile(r"[:=]")
STRING = re.compile(r"""[rbfuRBFU]{0,2}(?:'((?:[^'\\\n]|\\.)*)'|"((?:[^"\\\n]|\\.)*)"|`((?:[^`\\]|\\.)*)`)""")
REFERENCE = re.compile(r"\$\{([A-Za-z_]\w*)\}|\$?([A-Za-z_][\w]*(?:\.[A-Za-z_]\w*)*)(?=[ \t]*(?:[+.;,)\]}\n]|\|\||$))")
BARE = re.compile(r"""[^\s"'`,;()\[\]{}<>]+""")
#: A type between a name's colon and the sign before its literal: its front, its word, what follows its brackets.
TYPE_FRONT = re.compile(r"""[ \t]*(?:&[ \t]*(?:'\w+[ \t]+)?)?(?=[A-Za-z_])""")
TYPE_WORD = re.compile(r"[\w.:]+")
TYPE_BACK = re.compile(r"""[?!]?(?:[ \t]*\|[ \t]*[A-Za-z_]\w*)*[ \t]*=[ \t]*(?=[rbfuRBFU]{0,2}["'`])""")
JOINER = re.compile(r"[ \t]*(?:\+|\.\.|&|\|\||\bor\b)[ \t]*\n?[ \t]*")

#: Parts of names and how sensitive they are.
STRONG = frozenset("password passwd pwd passphrase secret token apikey credential credentials privatekey accesskey secretkey authtoken bearer".split())
WEAK = frozenset("pass key auth access private api signature salt cookie session webhook dsn".split())
PLACEHOLDER = re.compile(r"^(?:x+|\*+|\.+|changeme|change_me|example\w*|placeholder|none|null|true|false|undefined|your\w*|todo|test|dummy|<.*>|\$\{.*\}|%\(.*\)s|\{\{.*\}\})$", re.IGNORECASE)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
THRESHOLD = 1.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    out, lower = [], text.lower()
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


class Spelling:
    """What strength() needs of a value: its length (a float, so that sums never overflow), kinds of its characters, shares of their classes, and whether it is made of placeholders only.

    Two spellings make that of their concatenation in the number of classes, however long the values are.
    """

    __slots__ = ("size", "shares", "kinds", "placeholder")

    def __init__(self, value: str) -> None:
        counts = Counter(value)
        self.size, self.placeholder = float(len(value)), PLACEHOLDER.match(value) is not None
        self.kinds = frozenset(map(kind_of, counts))
        self.shares: dict[int, float] = {}
        for c, k in counts.items():
            at = ord(c) if ord(c) < 128 else 128 + ord(c) % 128
            self.shares[at] = self.shares.get(at, 0.0) + k / len(value)

    def __add__(self, other: "Spelling") -> "Spelling":
        out = Spelling.__new__(Spelling)
        out.size = min(self.size + other.size, 1e300)
        out.kinds, out.placeholder = self.kinds | other.kinds, self.placeholder and other.placeholder
        out.shares = {}
        for part in (self, other):
            for c, share in part.shares.items():
                out.shares[c] = out.shares.get(c, 0.0) + share * (part.size / out.size)
        return out


def kind_of(c: str) -> str:
    return "space" if c.isspace() else "lower" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit() else "letter" if c.isalnum() else "sign"


def entropy(shares) -> float:
    return -sum(p * math.log2(p) for p in shares if p > 0)


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:])} | set(parts)
    return 1.0 if joined & STRONG else 0.5 if joined & WEAK else 0.0


def strength(value: "str | Spelling") -> float:
    """0 for placeholders and plain words, up to 1 for long strings of many kinds of characters."""
    x = value if isinstance(value, Spelling) else Spelling(value)
    if x.size < 6 or len(x.shares) < 2 or x.placeholder or "space" in x.kinds:
        return 0.0
    return min(1.0, 0.2 * len(x.kinds - {"letter"}) + 0.1 * entropy(x.shares.values()) + 0.01 * min(x.size, 40))


class Pair:
    """A name and its value: parts in order, literals (start, end, value) and earlier pairs, and how many literals that makes in all."""

    __slots__ = ("name", "parts", "count")

    def __init__(self, name: str) -> None:
        self.name, self.parts, self.count = name, [], 0.0

    def add(self, part: "tuple[int, int, str] | Pair") -> None:
        self.parts.append(part)
        self.count = min(self.count + (part.count if isinstance(part, Pair) else 1.0), 1e300)

    def references(self) -> "list[Pair]":
        return [p for p in self.parts if isinstance(p, Pair)]


def name_before(text: str, i: int) -> str | None:
    """The name that ends right before the sign at i; the sign's colon, blanks, a bracket and a quote may stand between."""
    j = i - 1 if i and text[i - 1] == ":" else i
    while j and text[j - 1] in " \t":
        j -= 1
    if j and text[j - 1] == "]":
        j -= 1
    if j and text[j - 1] in "\"'":
        j -= 1
    k = j
    while k and ((c := text[k - 1]).isalnum() or c in "_$.-"):
        k -= 1
    return text[k:j] if k < j and (text[k] in "_$" or (text[k].isascii() and text[k].isalpha())) else None


class Types:
    """Where a type ends that begins behind a colon, if a literal follows it. Ends that were found once are known for all colons before them."""

    def __init__(self, text: str) -> None:
        self.text, self.word, self.ends = text, (0, 0), {}

    def next(self, mark: str, at: int) -> int:
        """The next place of the mark, the text's end where there is none."""
        known = self.ends.get(mark, (0, -1))
        if not known[0] <= at <= known[1]:
            found = self.text.find(mark, at)
            self.ends[mark] = known = (at, len(self.text) if found < 0 else found)
        return known[1]

    def end(self, at: int) -> int | None:
        front = TYPE_FRONT.match(self.text, at)
        if not front:
            return None
        at = front.end()
        if not self.word[0] <= at < self.word[1]:
            self.word = (at, TYPE_WORD.match(self.text, at).end())
        at = self.word[1]
        for opened, closed in (("[", "]"), ("<", ">")):
            if self.text.startswith(opened, at):
                at = self.next(closed, at)
                if at == len(self.text) or self.next("\n", self.word[1]) < at:
                    return None
                at += 1
                break
        back = TYPE_BACK.match(self.text, at)
        return back.end() if back else None


def pairs(text: str) -> list[Pair]:
    """Name-literal pairs in order; a value that names an earlier pair refers to it, so that no literal is copied."""
    known: dict[str, Pair] = {}
    out, after, types = [], 0, Types(text)
    for m in OPERATOR.finditer(text):
        i = m.start()
        if i < after or text[i + 1 : i + 2] in ("=", "~") or text[max(0, i - 1) : i] in ("=", "!", "<", ">", "~", "+", "-", "*") or (text[i] == ":" and text[i + 1 : i + 2] in (":", "/", "=")):
            continue
        name = name_before(text, i)
        if not name:
            continue
        at, first = i + 1 + (text[i + 1 : i + 2] == ">"), True
        pair = Pair(name)
        if text[i] == ":" and (typed := types.end(at)) is not None:  # the literal goes to the name before its type
            at = typed
        while at < len(text) and text[at] in " \t":
            at += 1
        while at < len(text):
            if s := STRING.match(text, at):
                g = s.lastindex
                if g:
                    pair.add((s.start(g), s.end(g), s[g]))
            elif (s := REFERENCE.match(text, at)) and (ref := (s[1] or s[2])) in known:
                pair.add(known[ref])
            elif first and (s := BARE.match(text, at)):
                pair.add((s.start(), s.end(), s[0]))
            else:
                break
            at, first = s.end(), False
            joint = JOINER.match(text, at)
            if not joint:
                break
            at = joint.end()
        if pair.count:
            known[pair.name] = pair
            known.setdefault(pair.name.rpartition(".")[2], pair)
            out.append(pair)
            after = at if not first and at > i else 0
    return out


def strengths(found: list[Pair]) -> dict[int, float]:
    """Strength of the whole value of each pair (by id) of several literals under a sensitive name.

    Spellings are made for these and for what they are made of only, in order, and dropped behind their last use.
    """
    wanted = {id(p) for p in found if p.count > 1 and sensitivity(p.name)}
    needed, last = set(wanted), {}
    for at in range(len(found) - 1, -1, -1):
        if id(found[at]) in needed:
            for other in found[at].references():
                needed.add(id(other))
                last.setdefault(id(other), at)
    out, held = {}, {}
    for at, pair in enumerate(found):
        if id(pair) not in needed:
            continue
        total = None
        for part in pair.parts:
            own = held.get(id(part)) if isinstance(part, Pair) else Spelling(part[2]) if part[2] else None
            if own is not None:
                total = own if total is None else total + own
        for other in pair.references():
            if last.get(id(other)) == at:
                held.pop(id(other), None)
        if id(pair) in last and total is not None:
            held[id(pair)] = total
        if id(pair) in wanted and total is not None:
            out[id(pair)] = strength(total)
    return out


def named_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name, unless a base span covers them already.

    Names are scored from the last pair to the first: a pair hands the best score of its whole value (of several
    literals), or the weight of its name (of one), on to the pairs that its value names. So each pair is seen once.
    """
    if "=" not in text and ":" not in text:
        return []
    found = pairs(text)
    of_chain = strengths(found)
    best: dict[tuple[int, int], float] = {}
    whole: dict[int, float] = {}
    alone: dict[int, float] = {}
    for pair in reversed(found):
        of_whole, of_one, weight = whole.pop(id(pair), 0.0), alone.pop(id(pair), 0.0), sensitivity(pair.name)
        if weight and id(pair) in of_chain:
            of_whole = max(of_whole, weight * 2 * of_chain[id(pair)])
        elif weight:
            of_one = max(of_one, weight)
        for part in pair.parts:
            if isinstance(part, Pair):
                whole[id(part)] = max(whole.get(id(part), 0.0), of_whole)
                alone[id(part)] = max(alone.get(id(part), 0.0), of_one)
            elif of_whole or of_one:
                start, end, value = part
                score = max(of_whole if value else 0.0, of_one * 2 * strength(value) if value and of_one else 0.0)
                best[start, end] = max(best.get((start, end), 0.0), score)
    out, covered = [], 0
    spans, at = sorted((s, e) for s, e, _ in base), 0
    for (s, e), score in sorted(best.items()):
        while at < len(spans) and spans[at][0] <= s:  # the furthest end of the base spans that begin before this one does
            covered, at = max(covered, spans[at][1]), at + 1
        if score >= THRESHOLD and e > s and e > covered:
            out.append((s, e, "named"))
    return out


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and all spans."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + named_spans(text, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def spell(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found span (overlapping ones as one) replaced by the mark."""
    if not text:
        return text
    out, at = [], 0
    for start, end, _ in scan(text)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_secrets(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, base_spans and all_spans (arrays of kind, start, end; code points, end exclusive)."""
    bounded_batches(spark)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batch: dict) -> dict:
        found = [scan(t) for t in batch["text"].to_pylist()]
        rows = [[[{"kind": k, "start": s, "end": e} for s, e, k in spans] for spans in both] for both in found]
        return {"key": batch["key"], "base_spans": [r[0] for r in rows], "all_spans": [r[1] for r in rows]}

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    src = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return map_arrow(src, run, f"key long, base_spans {kind}, all_spans {kind}", pa.schema([("key", pa.int64()), ("base_spans", span), ("all_spans", span)])).withColumnRenamed("key", key)


def redact_documents(spark: SparkSession, docs: DataFrame, text: str = "text", count: str = "n_chars") -> DataFrame:
    """docs with secrets in their text replaced; the character count follows the text."""
    bounded_batches(spark)
    from pyspark.sql.pandas.types import to_arrow_schema

    def run(batch: dict) -> dict:
        texts = [redact(t) for t in batch[text].to_pylist()]
        return batch | {text: texts} | ({count: [None if t is None else len(t) for t in texts]} if count in batch else {})

    return map_arrow(docs, run, docs.schema, to_arrow_schema(docs.schema))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans found in every whole text."""

    def spelled(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    out = find_secrets(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", *map(count, KINDS[:3]), F.sha2(spelled("base_spans").cast("binary"), 256).alias("base_sha256"), spelled("all_spans").alias("spans"))
