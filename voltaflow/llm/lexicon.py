"""Minimal acyclic transducer: words to id sequences, suffixes shared, read from a memory map.

Words are added in sorted order; a state is merged with an equal one as soon as no later word can
change it, so the automaton is minimal at every step. Every arc carries how many accepted words
come before the words through it; the sum along a path is the word's place among all words, and
that place finds the ids in the mapped table. Suffixes are shared whatever the ids are.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Iterable

import numpy as np

MAGIC = b"VFLEX1\0\0"


class _Builder:
    def __init__(self) -> None:
        self.register: dict[tuple, int] = {}
        self.arcs: list[tuple[tuple[int, int], ...]] = []
        self.final: list[bool] = []
        self.path: list[list] = [[False, []]]  # [final, [(label, state or None)]] for the last word's states
        self.last = b""

    def _freeze(self, node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = self.register.get(key)
        if state is None:
            state = self.register[key] = len(self.arcs)
            self.arcs.append(key[1])
            self.final.append(node[0])
        return state

    def _close(self, depth: int) -> None:
        while len(self.path) - 1 > depth:
            node = self.path.pop()
            label, _ = self.path[-1][1][-1]
            self.path[-1][1][-1] = (label, self._freeze(node))

    def add(self, word: bytes) -> None:
        if word <= self.last and self.last:
            raise ValueError("words must be sorted, without repeats")
        common = len(os.path.commonprefix([word, self.last]))
        self._close(common)
        for b in word[common:]:
            self.path[-1][1].append((b, None))
            self.path.append([False, []])
        self.path[-1][0] = True
        self.last = word

    def finish(self) -> int:
        self._close(0)
        return self._freeze(self.path[0])


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Compile (word, ids) pairs into the file's bytes. Repeats: the first counts; the empty word is left out."""
    known: dict[bytes, list[int]] = {}
    for word, ids in entries:
        if word:
            known.setdefault(bytes(word), list(ids))
    builder, order = _Builder(), sorted(known)
    for word in order:
        builder.add(word)
    root = builder.finish()
    size: list[int] = []
    for state, arcs in enumerate(builder.arcs):  # targets come before their sources
        size.append(builder.final[state] + sum(size[t] for _, t in arcs))
    first, label, target, skip = [0], bytearray(), [], []
    for state, arcs in enumerate(builder.arcs):
        before = int(builder.final[state])
        for b, t in arcs:
            label.append(b)
            target.append(t)
            skip.append(before)
            before += size[t]
        first.append(len(target))
    starts = np.cumsum([0, *(len(known[w]) for w in order)], dtype="<u4")
    ids = np.array([i for w in order for i in known[w]], dtype="<u4")
    parts = [
        np.array(first, "<u4").tobytes(), np.array(target, "<u4").tobytes(), np.array(skip, "<u4").tobytes(),
        starts.astype("<u4").tobytes(), ids.tobytes(), bytes(bytearray(map(int, builder.final))), bytes(label),
    ]
    head = MAGIC + struct.pack("<4I", root, len(builder.arcs), len(target), len(order)) + struct.pack("<7I", *map(len, parts))
    return head + b"".join(parts)


class Lexicon:
    """A compiled lexicon, read through a memory map of a file that only this process holds."""

    def __init__(self, data: bytes) -> None:
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        view = memoryview(self.map)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a lexicon")
        self.root, self.n_states, self.n_arcs, self.n_words = struct.unpack("<4I", view[8:24])
        at, parts = 52, []
        for n in struct.unpack("<7I", view[24:52]):
            parts.append(view[at : at + n])
            at += n
        self.first, self.target, self.skip, self.starts = (p.cast("I") for p in parts[:4])
        self.ids, self.final = parts[4], parts[5]
        self.label_at = at - len(parts[6])

    def lookup(self, word: bytes) -> bytes | None:
        """The word's ids as little-endian unsigned 32-bit integers, or None."""
        state, place, first, find = self.root, 0, self.first, self.map.find
        for i in range(len(word)):
            lo, hi = first[state], first[state + 1]
            at = find(word[i : i + 1], self.label_at + lo, self.label_at + hi)
            if at < 0:
                return None
            at -= self.label_at
            place += self.skip[at]
            state = self.target[at]
        if not word or not self.final[state]:
            return None
        return bytes(self.ids[4 * self.starts[place] : 4 * self.starts[place + 1]])
