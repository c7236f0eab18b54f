"""Encoding of text blocks through their repeated pieces.

Text between two isolated spaces is encoded alike wherever it stands, so a block is cut there, each distinct piece is
numbered and encoded once, and the texts' ids are gathered from the pieces' ids with array operations.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

import numpy as np

#: Encodes strings: all their ids in one array, and the number of ids of each.
Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]


class _Numbers(dict):
    def __missing__(self, key):
        n = self[key] = len(self)
        return n


class PieceTable:
    """Ids of texts by pieces. ``spaced``: a piece is encoded with the space before it; else white space means nothing."""

    def __init__(self, encode: Encode, spaced: bool, most: int = 500_000):
        self.encode, self.spaced, self.most = encode, spaced, most
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.count = np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)
        self.seen = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the pieces that came more than once; all go if these are still too many."""
        keep = self.seen > 1
        if keep.sum() * 2 > self.most:
            return self._clear()
        start = np.cumsum(self.count) - self.count
        size = self.count[keep]
        ends = np.cumsum(size)
        self.flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start[keep] - (ends - size), size)]
        self.count, self.odd, self.seen = size, self.odd[keep] if self.spaced else self.odd, np.ones(len(size), np.int64)
        self.numbers = _Numbers(zip((p for p, k in zip(self.numbers, keep.tolist()) if k), range(len(size))))

    def cut(self, text: str) -> list[str]:
        if self.spaced:  # a piece that starts with a line feed has no space before it
            return text.replace("\n", " \n").split(" ")
        return text.replace("\n", " ").split(" ")

    def block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block, and where each text's ids start (with the end)."""
        gc.disable()  # a block makes many small objects and no cycles
        try:
            return self._block(texts)
        finally:
            gc.enable()

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.numbers) > self.most:
            self._forget()
        known, number = len(self.numbers), self.numbers.__getitem__
        codes, heads, hard = [], [], []
        for i, t in enumerate(texts):
            head, *rest = self.cut(t)
            codes.append(np.fromiter(map(number, rest), np.int64, len(rest)))
            heads.append(head)
            hard.append(self.spaced and bool(rest) and (not head or head[-1].isspace()))
        new = list(self.numbers)[known:]
        self.seen = np.bincount(np.concatenate([*codes, np.zeros(0, np.int64)]), minlength=len(self.numbers)) + np.append(self.seen, np.zeros(len(new), np.int64))
        if self.spaced:
            odd = np.array([not p or p[-1].isspace() for p in new], bool)  # the words on both sides may share this white space
            self.odd = np.concatenate([self.odd, odd])
            todo = [p if p[:1] == "\n" else " " + p for p in new]
            for i, c in enumerate(codes):
                if hard[i] or self.odd[c].any():
                    heads[i], codes[i] = texts[i], c[:0]
        else:
            todo = new
        flat, count = self.encode(todo + heads)
        cut = int(count[: len(todo)].sum())
        self.flat, self.count = np.concatenate([self.flat, flat[:cut].astype(np.uint32)]), np.concatenate([self.count, count[: len(todo)]])
        first = np.append(self.count, count[len(todo) :])
        base, pool = len(self.count), np.concatenate([self.flat, flat[cut:].astype(np.uint32)])
        start = np.cumsum(first) - first
        ids, ends, i = [], [0], 0
        while i < len(texts):  # a bounded number of pieces at a time
            group, n = [], 0
            while i < len(texts) and (not n or n < 300_000):
                group += [np.array([base + i]), codes[i]]
                n += len(codes[i]) + 1
                i += 1
            c = np.concatenate(group)
            size = first[c]
            at = np.cumsum(size)
            ids.append(pool[np.arange(at[-1] if len(at) else 0) + np.repeat(start[c] - (at - size), size)])
            sizes = np.add.reduceat(size, np.cumsum([0] + [len(g) + 1 for g in group[1::2]])[:-1])
            ends += (ends[-1] + np.cumsum(sizes)).tolist()
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.array(ends, np.int64)


class Spelling:
    """Byte strings by id, put together for arrays of ids."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(x) for x in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def of(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - size), size)].tobytes()
