"""Word and shingle hashes of many texts at once, in numpy.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``; A-Z count as a-z. All words
of a batch are hashed side by side, eight bytes a step, each step mixing every bit of the
state; words beyond 64 bytes are hashed by BLAKE2b. Equal words always get equal hashes;
two words of one length up to eight bytes never share one. Where that is not enough, a
second lane of hashes, seeded otherwise, stands beside the first.
"""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Keeps the low bytes of a word's last step.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: Seeds of the lanes.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at once, which bounds the arrays; a longer word is still hashed whole.
SEGMENT = (1 << 20) - 8192


def _hash_words(low: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """The words' hashes; ``low`` has eight bytes more than the text."""
    length = end - begin
    eight = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    out = mix(length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(LANES[lane]))
    left = np.flatnonzero(length <= LONG_WORD)
    for step in range(0, LONG_WORD, 8):
        if step:
            left = left[length[left] > step]
        if not len(left):
            break
        block = eight[begin[left] + step] & _KEEP[np.minimum(length[left] - step, 8)]
        out[left] = mix(out[left] ^ block)
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(low[begin[k] : end[k]].tobytes(), digest_size=8, salt=bytes([lane])).digest(), "little")
    return out


def _segment_words(raw: np.ndarray, at: np.ndarray, lanes: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    n = len(raw)
    inside = np.zeros(n + 2, dtype=bool)
    np.logical_not(_IS_SPACE[raw], out=inside[1:-1])
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    cuts = at[(at > 0) & (at < n)]  # a text's end ends a word
    first[cuts] |= inside[1:-1][cuts]
    last[cuts - 1] |= inside[1:-1][cuts - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    low = np.zeros(n + 8, np.uint8)
    low[:n] = _LOWER[raw]
    return [_hash_words(low, begin, end, k) for k in range(lanes)], begin, end


def words(data: bytes, starts: np.ndarray, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """Of the texts that begin at ``starts`` (ascending, one more for the end) in ``data``:
    the words' hashes (an array a lane), first bytes and ends, and each text's first word
    (one more for the end)."""
    raw = np.frombuffer(data, dtype=np.uint8)[: starts[-1]]
    parts, lo = [], int(starts[0])
    while lo < len(raw):
        hi = min(lo + SEGMENT, len(raw))
        while hi < len(raw):  # ends at white space, so that no word is cut
            space = np.flatnonzero(_IS_SPACE[raw[hi : hi + 4096]])
            if len(space):
                hi += int(space[0])
                break
            hi = min(hi + 4096, len(raw))
        hashed, begin, end = _segment_words(raw[lo:hi], starts[(starts > lo) & (starts < hi)] - lo, lanes)
        parts.append((*hashed, begin + lo, end + lo))
        lo = hi
    *hashed, begin, end = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(lanes + 2))
    return (*(h.astype(np.uint64) for h in hashed), begin, end, np.searchsorted(begin, starts))


def ngrams(word: np.ndarray, n: int) -> np.ndarray:
    """A hash for each ``n`` words in a row of ``word``."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    size = len(word) - n + 1
    out = np.zeros(size, dtype=np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0xFF51AFD7ED558CCD) + word[k : k + size])
    return out


def arrow_text(column) -> tuple[bytes, np.ndarray]:
    """The bytes and the starts of an Arrow string array; nulls count as empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (data.to_pybytes() if data is not None else b""), starts


#: Words share so many counters when their frequencies are estimated.
WORD_BUCKETS = 1 << 16


def word_buckets(hashed: np.ndarray) -> np.ndarray:
    return (hashed >> np.uint64(48)).astype(np.int64)


def shingle_sets(column, n: int = 5, rarity: np.ndarray | None = None, counts: np.ndarray | None = None, lanes: int = 1):
    """Yields each text's sorted distinct ``n``-word shingle hashes; with fewer words the
    whole sequence is one shingle, without words there is none. With ``rarity`` (of word
    buckets) or a second lane it yields (hashes, sums of the words' rarities or None, the
    second lane's hashes or None) instead; words are added to ``counts`` by bucket."""
    data, starts = arrow_text(column)
    *hashed, _, _, first = words(data, starts, lanes)
    if counts is not None:
        counts += np.bincount(word_buckets(hashed[0]), minlength=WORD_BUCKETS)
    every = [ngrams(h, n) for h in hashed]
    if rarity is not None:
        sums = np.concatenate([[0], np.cumsum(rarity[word_buckets(hashed[0])], dtype=np.int64)])
        rare = (sums[n:] - sums[:-n]) if len(hashed[0]) >= n else sums[:0]
    plain = rarity is None and lanes == 1
    for k in range(len(starts) - 1):
        a, b = first[k], first[k + 1]
        if b - a >= n and not plain:
            tokens, at = np.unique(every[0][a : b - n + 1], return_index=True)
            yield tokens, rare[a : b - n + 1][at] if rarity is not None else None, every[1][a : b - n + 1][at] if lanes > 1 else None
            continue
        if b - a >= n:
            yield np.unique(every[0][a : b - n + 1])
            continue
        one = [mix(ngrams(h[a:b], b - a) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64) for h in hashed]
        yield one[0] if plain else (one[0], np.zeros(len(one[0]), np.int64), one[-1])
