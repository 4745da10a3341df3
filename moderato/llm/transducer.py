"""A minimal acyclic transducer: sorted byte strings to their lexicographic ordinals.

States are made minimal while the strings come in, in order: what lies below
the prefix shared with the next string can't change any more, and is looked up among
the states there are.  Each edge carries how many strings of its state come
before those that go on over it, so the sum along a path is the string's
ordinal, and the edges lead from an ordinal back to its string.  Many strings are looked up at
once, one byte of each at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_HEAD = 4


class Transducer:
    """``edges`` (256 * state + byte, ascending), their ``target`` and ``skip``, and which states are ``final``."""

    def __init__(self, root: int, edges: np.ndarray, target: np.ndarray, skip: np.ndarray, final: np.ndarray, size: int):
        self.root, self.edges, self.target, self.skip, self.final, self.size = root, edges, target, skip, final, size

    def to_bytes(self) -> bytes:
        head = np.array([self.root, len(self.edges), len(self.final), self.size], np.int64)
        return b"".join(a.tobytes() for a in (head, self.edges, self.target, self.skip, self.final))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        root, edges, states, size = np.frombuffer(blob, np.int64, _HEAD).tolist()
        at, parts = 8 * _HEAD, []
        for dtype, n in ((np.int64, edges), (np.int32, edges), (np.int64, edges), (np.bool_, states)):
            parts.append(np.frombuffer(blob, dtype, n, at))
            at += n * np.dtype(dtype).itemsize
        return cls(root, *parts, size)

    def ordinals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The ordinal of each string ``data[offsets[i]:offsets[i + 1]]``, -1 where it isn't one of them."""
        out = np.full(len(offsets) - 1, -1, np.int64)
        if not self.size:
            return out
        length = np.diff(offsets)
        if self.final[self.root]:
            out[length == 0] = 0
        live = np.flatnonzero(length > 0)
        state, total, at = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = (state << 8) | data[offsets[live] + at]
            edge = np.searchsorted(self.edges, key)
            edge[edge == len(self.edges)] = 0
            on = self.edges[edge] == key if len(self.edges) else np.zeros(len(live), bool)
            live, edge, total = live[on], edge[on], total[on]
            state, total, at = self.target[edge].astype(np.int64), total + self.skip[edge], at + 1
            whole = length[live] == at
            hit = whole & self.final[state]
            out[live[hit]] = total[hit]
            live, state, total = live[~whole], state[~whole], total[~whole]
        return out

    def string(self, ordinal: int) -> bytes:
        """The string of an ordinal."""
        out, state = bytearray(), self.root
        while not (self.final[state] and ordinal == 0):
            first = int(np.searchsorted(self.edges, state << 8))
            last = int(np.searchsorted(self.edges, (state + 1) << 8))
            edge = first + int(np.searchsorted(self.skip[first:last], ordinal, "right")) - 1
            ordinal -= int(self.skip[edge])
            out.append(int(self.edges[edge]) & 255)
            state = int(self.target[edge])
        return bytes(out)


def build(strings: Iterable[bytes]) -> Transducer:
    """The minimal transducer of distinct strings that come in ascending order."""
    known: dict[tuple, int] = {}
    below: list[int] = []                   # strings below each state
    made: list[tuple] = []                  # final, labels, targets

    def settled(node: list) -> int:
        key = (node[0], bytes(node[1]), tuple(node[2]))
        state = known.get(key)
        if state is None:
            state = known[key] = len(made)
            made.append(key)
            below.append(node[0] + sum(below[t] for t in node[2]))
        return state

    path, last, size = [[False, bytearray(), []]], None, 0
    for s in strings:
        if last is not None and s <= last:
            raise ValueError("strings must be distinct and in order")
        shared = 0
        if last is not None:
            stop = min(len(last), len(s))
            while shared < stop and last[shared] == s[shared]:
                shared += 1
        while len(path) > shared + 1:
            node = path.pop()
            path[-1][2].append(settled(node))
        for b in s[shared:]:
            path[-1][1].append(b)
            path.append([False, bytearray(), []])
        path[-1][0] = True
        last, size = s, size + 1
    while len(path) > 1:
        node = path.pop()
        path[-1][2].append(settled(node))
    root = settled(path[0])
    edges, target, skip = [], [], []
    for state, (final, labels, targets) in enumerate(made):
        before = int(final)
        for b, t in zip(labels, targets, strict=True):
            edges.append(state << 8 | b)
            target.append(t)
            skip.append(before)
            before += below[t]
    return Transducer(root, np.array(edges, np.int64), np.array(target, np.int32), np.array(skip, np.int64),
                      np.array([m[0] for m in made], np.bool_), size)
