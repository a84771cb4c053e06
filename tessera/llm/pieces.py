"""Texts cut into pieces at white space, each distinct piece handled once a batch.

Pieces are cut and made distinct in Arrow, their ids are looked up per distinct piece,
and a batch's ids are put together by one gather; no Python runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.textnum import arrow_text

#: UTF-8 of the white space of Unicode beyond ASCII.
_WIDE_SPACE = tuple(c.encode() for c in "\x85\xa0                　")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def distinct(pieces: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct values, and each piece's place among them."""
    coded = pieces.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)


def split_at_space(column) -> tuple[pa.Array, np.ndarray]:
    """Runs without ASCII white space (empty ones at the ends), and each text's first (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets.astype(np.int64) - offsets[0]


def split_before_space(column) -> tuple[pa.Array, np.ndarray]:
    """Runs of white space with what follows them up to the next run: each text in such pieces, and each
    text's first (one more for the end). Texts with white space beyond ASCII stay whole."""
    data, starts = arrow_text(column)
    lo, hi = int(starts[0]), int(starts[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi]
    at = starts - lo
    cut = np.zeros(hi - lo + 1, bool)
    if hi > lo:
        space = _SPACE[raw]
        cut[1:-1] = space[1:] & ~space[:-1]
        part = bytes(data[lo:hi])
        leads = {w[:1] for w in _WIDE_SPACE if w[:1] in part}
        for wide in (w for w in _WIDE_SPACE if w[:1] in leads):
            k = part.find(wide)
            while k >= 0:  # rare: no cut inside that text
                row = int(np.searchsorted(at, k, side="right")) - 1
                cut[at[row] : at[row + 1]] = False
                k = part.find(wide, int(at[row + 1]))
    cut[at] = True
    cut[hi - lo] = False
    begins = np.flatnonzero(cut)
    offsets = np.append(begins, hi - lo).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data[lo:hi])])
    # an empty text has no piece of its own: it begins where the next one does
    return pieces, np.searchsorted(begins, at)


def gather(values: list[bytes], places: np.ndarray, first: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All pieces' ids in a row, and where each text's begin (one more for the end)."""
    width = kind.itemsize
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // width
    flat = np.frombuffer(b"".join(values), kind)
    each = sizes[places] if len(places) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(each)])
    if not len(places) or not len(flat):
        return np.zeros(0, kind), ends[first]
    shift = (np.cumsum(sizes) - sizes)[places] - ends[:-1]
    return flat[np.repeat(shift, each) + np.arange(ends[-1])], ends[first]


def lists(values: pa.Array, ends: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values)


def binary_rows(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each text's ids as bytes."""
    at = (ends * ids.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(ids))])


def with_last(ids: np.ndarray, ends: np.ndarray, value: int) -> tuple[np.ndarray, np.ndarray]:
    """``value`` after each text's ids."""
    n = len(ends) - 1
    out = np.full(len(ids) + n, value, ids.dtype)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(ends))] = ids
    return out, ends + np.arange(n + 1)
