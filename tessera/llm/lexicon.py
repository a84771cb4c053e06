"""A minimal acyclic transducer from words (bytes) to token ids, in one memory-mapped file.

States with the same futures are one state, so words share suffixes as well as
prefixes. Transitions carry numbers that add up to a word's place in sorted order,
which finds its ids. The file holds plain arrays; look-ups walk many words at once.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"TSLEX001"
_FIELDS = (("keys", "<u4"), ("targets", "<u4"), ("adds", "<u4"), ("finals", "u1"), ("offsets", "<u4"), ("ids", "<u4"))


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file's bytes for ``entries``, built word by word in sorted order."""
    words = sorted(entries)
    register: dict[tuple, int] = {}
    edges: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []
    counts: list[int] = []

    def settle(state: list) -> int:
        """The number of the one state with these futures."""
        signature = (state[0], tuple(state[1]))
        if signature not in register:
            register[signature] = len(edges)
            edges.append(signature[1])
            finals.append(state[0])
            counts.append(state[0] + sum(counts[t] for _, t in signature[1]))
        return register[signature]

    path: list[list] = [[False, []]]  # open states along the last word
    last = b""
    for word in words:
        shared = 0
        while shared < len(last) and shared < len(word) and last[shared] == word[shared]:
            shared += 1
        for k in range(len(last), shared, -1):
            path[k - 1][1].append((last[k - 1], settle(path.pop())))
        path.extend([False, []] for _ in range(len(word) - shared))
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1][1].append((last[k - 1], settle(path.pop())))
    root = settle(path[0])
    # the root becomes state 0, so that walks start there
    number = lambda s: 0 if s == root else s + 1 if s < root else s
    rows, final_of = [], np.zeros(len(edges), np.uint8)
    for s, out in enumerate(edges):
        final_of[number(s)] = finals[s]
        passed = int(finals[s])
        for label, t in out:
            rows.append((number(s) * 256 + label, number(t), passed))
            passed += counts[t]
    table = np.array(sorted(rows), dtype="<u4").reshape(-1, 3)
    sizes = [len(entries[w]) for w in words]
    arrays = {
        "keys": table[:, 0],
        "targets": table[:, 1],
        "adds": table[:, 2],
        "finals": final_of,
        "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype("<u4"),
        "ids": np.array([i for w in words for i in entries[w]], "<u4"),
    }
    head = np.array([len(arrays[name]) for name, _ in _FIELDS], "<u8").tobytes()
    return MAGIC + head + b"".join(np.ascontiguousarray(arrays[name]).astype(kind).tobytes() for name, kind in _FIELDS)


class Lexicon:
    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a lexicon")
        lengths = np.frombuffer(raw[8 : 8 + 8 * len(_FIELDS)].tobytes(), "<u8")
        at = 8 + 8 * len(_FIELDS)
        for (name, kind), n in zip(_FIELDS, lengths.tolist(), strict=True):
            size = n * np.dtype(kind).itemsize
            setattr(self, name, np.asarray(raw[at : at + size]).view(kind))
            at += size
        self.raw_ids = memoryview(self.ids.view(np.uint8))

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in sorted order, -1 for words that are not in the lexicon."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(length) - length
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        alive, k = np.arange(len(words)), 0
        while len(alive := alive[length[alive] > k]) and len(self.keys):
            key = state[alive] * 256 + data[start[alive] + k]
            at = np.minimum(np.searchsorted(self.keys, key.astype(np.uint32)), len(self.keys) - 1)
            found = self.keys[at] == key
            state[alive[~found]] = -1
            alive, at = alive[found], at[found]
            state[alive] = self.targets[at]
            place[alive] += self.adds[at]
            k += 1
        if not len(self.keys):
            state[length > 0] = -1
        return np.where((state >= 0) & (self.finals[np.maximum(state, 0)] > 0), place, -1)

    def ids_of(self, words: list[bytes]) -> list[bytes | None]:
        """Each word's ids as little-endian unsigned 32-bit integers, None for unknown words."""
        place = self.places(words)
        found = np.flatnonzero(place >= 0)
        begin, end = self.offsets[place[found]] * 4, self.offsets[place[found] + 1] * 4
        out: list[bytes | None] = [None] * len(words)
        for k, a, b in zip(found.tolist(), begin.tolist(), end.tolist(), strict=True):
            out[k] = self.raw_ids[a:b].tobytes()
        return out
