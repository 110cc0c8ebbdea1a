"""A minimal acyclic transducer from words to token ids, in one block that can be memory-mapped.

States with the same future are one state (suffixes are shared). Every arc carries
the number of words that sort before those behind it, so the sum along a word is its
place in the sorted list, and that place points into a pool of ids.
"""

from __future__ import annotations

import mmap
import os

import numpy as np

_INT = 4


def compile_words(words: dict[bytes, tuple[int, ...]]) -> bytes:
    """The transducer of ``words`` as bytes; keys in any order."""
    ordered = sorted(words)
    arcs_of: list[tuple[tuple[int, int], ...]] = []  # of every finished state: (byte, target) in order
    final_of: list[bool] = []
    known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}

    def finish(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in known:
            known[key] = len(arcs_of)
            arcs_of.append(key[1])
            final_of.append(final)
        return known[key]

    # The path of the last word: its states can still get arcs.
    finals, pending, last = [False], [[]], b""
    for word in ordered:
        shared = len(os.path.commonprefix([word, last]))
        while len(pending) > shared + 1:
            state = finish(finals.pop(), pending.pop())
            pending[-1].append((last[len(pending) - 1], state))
        for _ in word[shared:]:
            pending.append([])
            finals.append(False)
        finals[-1] = True
        last = word
    while len(pending) > 1:
        state = finish(finals.pop(), pending.pop())
        pending[-1].append((last[len(pending) - 1], state))
    root = finish(finals[0], pending[0])

    behind: list[int] = []  # words that can be read from a state; targets are finished before their sources
    first, labels, targets, before = [0], bytearray(), [], []
    for arcs, final in zip(arcs_of, final_of, strict=True):
        count = int(final)
        for byte, target in arcs:
            labels.append(byte)
            targets.append(target)
            before.append(count)
            count += behind[target]
        behind.append(count)
        first.append(len(labels))
    offsets = np.cumsum([0, *(len(words[w]) for w in ordered)])
    pool = [i for w in ordered for i in words[w]]
    head = np.array([len(arcs_of), len(labels), len(ordered), len(pool), root], np.int32)
    ints = [np.array(a, np.int32).tobytes() for a in (first, targets, before, offsets, pool)]
    return head.tobytes() + b"".join(ints) + bytes(final_of) + bytes(labels)


class Lexicon:
    """The transducer in a file that every worker of a machine maps into its memory."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            self._file = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        whole = memoryview(self._file)
        states, arcs, words, ids, self._root = whole[:5 * _INT].cast("i")
        at, parts = 5 * _INT, []
        for size in (states + 1, arcs, arcs, words + 1, ids):
            parts.append(whole[at:at + size * _INT].cast("i"))
            at += size * _INT
        self._first, self._targets, self._before, self._offsets, self._pool = parts
        self._final, self._labels = at, at + states
        self.states, self.words = states, words

    def get(self, word: bytes) -> tuple[int, ...] | None:
        find, first, labels, state, place = self._file.find, self._first, self._labels, self._root, 0
        for at in range(len(word)):
            arc = find(word[at:at + 1], labels + first[state], labels + first[state + 1])
            if arc < 0:
                return None
            place += self._before[arc - labels]
            state = self._targets[arc - labels]
        if not self._file[self._final + state]:
            return None
        return tuple(self._pool[self._offsets[place]:self._offsets[place + 1]])
