"""Trees of byte contexts for language models: counting, states and lookups over many texts.

A gram is a context of ``depth`` bytes, oldest first, and the byte that follows, packed into one
integer.  The byte 255, which UTF-8 never holds, stands before each text and ends it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

MARK = 255
#: Bytes that one vectorised step handles.
STEP = 1 << 20
#: Distinct grams that a counter holds before it sums them up.
HELD = 1 << 21


def grams(texts: Iterable[bytes], depth: int, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of whole texts and their counts; with ``end``, the end mark is one more byte."""
    texts = list(texts)
    pad = bytes([MARK]) * depth
    a = np.frombuffer(b"".join(pad + t + pad[:1] for t in texts), np.uint8)
    if len(a) <= depth:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = a.astype(np.uint64)
    g = wide[: len(a) - depth].copy()
    for k in range(1, depth + 1):
        g <<= np.uint64(8)
        g |= wide[k : len(a) - depth + k]
    now, before = a[depth:], a[depth - 1 : -1]
    g = g[(now != MARK) | (before != MARK)] if end else g[now != MARK]
    empty = sum(not t for t in texts) if end else 0
    if empty:
        g = np.concatenate((g, np.full(empty, (1 << 8 * (depth + 1)) - 1, np.uint64)))
    return np.unique(g, return_counts=True)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table of grams and counts from several."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Counter:
    """Sums grams of many batches in bounded memory; ``take`` gives what is held."""

    def __init__(self, depth: int, end: bool):
        self.depth, self.end, self.parts, self.held = depth, end, [], 0

    def add(self, texts: list[bytes]) -> None:
        part = grams(texts, self.depth, self.end)
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > HELD:
            self.parts = [merge(self.parts)]
            self.held = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.held > HELD // 2 and len(self.parts) == 1

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = merge(self.parts)
        self.parts, self.held = [], 0
        return out


class Tree:
    """Contexts of up to ``depth`` (at most 4) bytes as numbered states; state 0 has no context.

    ``keys[d]`` are the sorted contexts of d bytes; each one's suffixes must be there too.
    """

    def __init__(self, keys: list[np.ndarray]):
        self.keys = [np.asarray(k, np.uint64) for k in keys]
        self.depth = len(keys) - 1
        self.base = np.concatenate(([0], np.cumsum([len(k) for k in self.keys]))).astype(np.int64)
        self.size = int(self.base[-1])
        self.parent = np.zeros(self.size, np.int64)
        for d in range(1, self.depth + 1):
            self.parent[self.base[d] : self.base[d + 1]] = self.find(d - 1, self.keys[d] & np.uint64((1 << 8 * (d - 1)) - 1))
        used = np.unique(np.concatenate([(k[:, None] >> np.uint64(8) * np.arange(d, dtype=np.uint64)).ravel() & np.uint64(255) for d, k in enumerate(self.keys) if d and len(k)] or [np.zeros(0, np.uint64)]))
        self.width = len(used) + 1  # the last code is any byte that no context has
        self.code = np.full(256, self.width - 1, np.int32)
        self.code[used.astype(np.int64)] = np.arange(len(used), dtype=np.int32)
        w = self.width
        near = np.zeros((w, w, w), np.int32)
        for d in range(1, min(3, self.depth) + 1):
            c = [self.code[((self.keys[d] >> np.uint64(8 * k)) & np.uint64(255)).astype(np.int64)] for k in range(d)]
            states = np.arange(self.base[d], self.base[d + 1], dtype=np.int32)
            near[(*[slice(None)] * (3 - d), *c[::-1])] = states
        self.near = near.ravel()
        self.far = None
        if self.depth > 3:
            self.far = np.repeat(np.arange(self.base[4], dtype=np.int32)[:, None], w, axis=1)
            oldest = self.code[(self.keys[4] >> np.uint64(24)).astype(np.int64)]
            self.far[self.parent[self.base[4] :], oldest] = np.arange(self.base[4], self.base[5], dtype=np.int32)
            self.far = self.far.ravel()

    def find(self, depth: int, contexts: np.ndarray) -> np.ndarray:
        return self.base[depth] + np.searchsorted(self.keys[depth], contexts)

    def states(self, a: np.ndarray) -> np.ndarray:
        """For each byte from the place ``depth`` on, the state of the longest kept context."""
        c, n, w = self.code[a], len(a) - self.depth, self.width
        back = lambda k: c[self.depth - k : self.depth - k + n]
        index = back(1).copy()
        if self.depth > 1:
            index += back(2) * w
        if self.depth > 2:
            index += back(3) * (w * w)
        if self.depth < 3:
            index += (w - 1) * (w * w if self.depth == 2 else w * w + w)
        state = self.near[index]
        if self.far is not None:
            state = self.far[state.astype(np.int64) * w + back(4)]
        return state


def pieces(texts: list[bytes], depth: int, end: bool, step: int = STEP) -> Iterator[tuple[list[int], list[int], bytes]]:
    """(numbers of texts, where each begins, bytes): each part has ``depth`` bytes before it.

    A text is cut at multiples of ``step`` of its own, so equal texts are summed alike.
    """
    pad, held = bytes([MARK]) * depth, 0
    owner, starts, parts, at = [], [], [], 0
    for i, t in enumerate(texts):
        whole = t + pad[:1] if end else t
        for k in range(0, len(whole), step):
            part = (pad[: max(0, depth - k)] + whole[max(0, k - depth) : k + step])
            owner.append(i)
            starts.append(at)
            parts.append(part)
            at += len(part)
            held += len(part)
            if held >= step:
                yield owner, starts, b"".join(parts)
                owner, starts, parts, at, held = [], [], [], 0, 0
    if parts:
        yield owner, starts, b"".join(parts)


def costs(tree: Tree, table: np.ndarray, symbol: np.ndarray, width: int, texts: list[bytes], end: bool) -> np.ndarray:
    """Sum of ``table[state * width + symbol[byte]]`` over each text, one column for each model."""
    models = table.shape[1] if table.ndim > 1 else 1
    out = np.zeros((len(texts), models))
    step = max(1 << 14, STEP // models)
    for owner, starts, raw in pieces(texts, tree.depth, end, step):
        a = np.frombuffer(raw, np.uint8)
        row = tree.states(a).astype(np.int64) * width + symbol[a[tree.depth :]]
        found = np.take(table, row, axis=0).reshape(len(row), models).astype(np.float64)
        # Of the places behind one part, those that hold the next part's context belong to nobody.
        begins = np.asarray(starts, np.int64)
        ends = np.concatenate((begins[1:], [len(a)])) - tree.depth
        edges = np.stack((begins, ends), axis=1).ravel()
        sums = np.add.reduceat(np.concatenate((found, np.zeros((1, models)))), edges, axis=0)[::2]
        np.add.at(out, owner, sums)
    return out


def sums(keys: np.ndarray, values: np.ndarray, texts: list[bytes], depth: int) -> np.ndarray:
    """Sum of the values of each text's grams and its end's; all of them are among ``keys`` (sorted)."""
    out = np.zeros(len(texts))
    for owner, starts, raw in pieces(texts, depth, True):
        a = np.frombuffer(raw, np.uint8).astype(np.uint64)
        n = len(a) - depth
        g = a[:n].copy()
        for k in range(1, depth + 1):
            g <<= np.uint64(8)
            g |= a[k : n + k]
        begins = np.asarray(starts, np.int64)
        ends = np.concatenate((begins[1:], [len(a)])) - depth
        # Grams that reach from one part into the next belong to nobody, and need not be known.
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        found = np.concatenate((values[at], [0.0]))
        np.add.at(out, owner, np.add.reduceat(found, np.stack((begins, ends), axis=1).ravel())[::2])
    return out
