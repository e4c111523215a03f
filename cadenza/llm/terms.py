"""Terms of texts as arrays: runs of term bytes, lower-cased, counted by document inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textkernel import LOWER, prefix_sums, span_hash, words

#: Bytes that part terms: all ASCII but letters and digits, and all ASCII but letters. Bytes of longer characters belong to terms.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the given runs of ``data``, one after the other."""
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """UTF-8 runs as Arrow strings."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """``values`` as binaries, cut at ``cuts`` (counts of values)."""
    size = values.dtype.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * size).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


class Counted:
    """Term counts of a run of documents.

    ``hash``, ``term_at``: the distinct terms by 64-bit hash, and where each one's counts begin (one more entry at
    the end); ``doc``, ``tf``: for every term its documents, ascending, and its occurrences in each; ``text`` gives
    the terms' strings; ``lengths``: terms of each document with repeats.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separates: np.ndarray):
        self.data = LOWER[data]
        starts, ends, doc = words(data, offsets, separates)
        self.lengths = np.bincount(doc, minlength=len(offsets) - 1).astype(np.int64)
        h = span_hash(prefix_sums(self.data), starts, ends)
        order = np.argsort(h, kind="stable")  # documents stay ascending within a term
        h, d = h[order], doc[order]
        new_term = np.ones(len(h), bool)
        new_term[1:] = h[1:] != h[:-1]
        new = new_term.copy()
        new[1:] |= d[1:] != d[:-1]
        at = np.flatnonzero(new)
        self.doc, self.tf = d[at], np.diff(np.concatenate([at, [len(h)]]))
        first = np.flatnonzero(new_term)
        self.hash = h[first]
        self.term_at = np.concatenate([np.searchsorted(at, first), [len(at)]])
        self._from, self._size = starts[order[first]], (ends - starts)[order[first]]

    def text(self) -> pa.Array:
        return strings(*gather(self.data, self._from, self._size))
