"""Substring dedup over words by suffix trees of groups that share a prefix.

Suffixes are split by prefixes of variable length: nine words from the anchor of a window (see ``repeats``), and where
more suffixes than a task should hold have these in common, all twenty words of the window; a prefix that occurs once
is dropped at once, and a group of whole windows is a single node.  The pieces of text of a group go to one task, which
builds their subtree: words become numbers, suffixes are ranked by doubling, sorted, and the common prefixes of
neighbours are measured with the ranks of all doublings.  The subtree's inner nodes are the stretches of suffixes
whose neighbours have a prefix in common; those at a depth of twenty words or more are the repeated windows, and of
their leaves all but the earliest are removed.

Nulls are empty texts.  Texts under 20 words stay whole.  Repeated rows: equal (doc_id, start) are ordered by batch,
so one of them stays.  A null doc_id comes after all others.  An empty table gives no rows.  Further columns, whatever
their names, are dropped.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridicta.llm.common import Words, ragged, slices
from veridicta.llm.repeats import Batch, Scheme, remove_repeats

WINDOW_WORDS = 20
SLICE_BYTES = 1 << 19


class WordUnits:
    """The words of some texts."""

    def __init__(self, texts: list[bytes]):
        self.data, start, end, self.first, code, size = b" ".join(texts), [], [], np.zeros(len(texts) + 1, np.int64), [], 0
        for i, j in slices(np.array([len(t) for t in texts], np.int64), SLICE_BYTES):
            w = Words(texts[i:j])
            start.append(w.start + size)
            end.append(w.end + size)
            code.append(w.hash)
            self.first[i + 1 : j + 1] = w.first[1:] + self.first[i]
            size += sum(len(t) + 1 for t in texts[i:j])
        empty = np.zeros(0, np.int64)
        self.start, self.end = np.concatenate([empty, *start]), np.concatenate([empty, *end])
        self.hash = np.concatenate([np.zeros(0, np.uint64), *code])

    def code(self, i: int, j: int) -> np.ndarray:
        return self.hash[i:j]

    def piece(self, i: int, j: int) -> bytes:
        return self.data[self.start[i] : self.end[j - 1]]


class Subtree:
    """The suffix tree of some pieces of words, as the order of suffixes and the depth of their nodes."""

    def __init__(self, pieces: list[bytes]):
        words = [p.split() for p in pieces]
        size = np.array([len(w) for w in words], np.int64)
        coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
        self.first = np.cumsum(size + 1) - size - 1  # an end after each piece
        n = int((size + 1).sum())
        self.rest = np.repeat(self.first + size, size + 1) - np.arange(n)  # words up to the piece's end
        rank = np.zeros(n, np.int64)
        rank[self.rest > 0] = coded.indices.to_numpy(zero_copy_only=False) + 1
        self.ranks, k = [(1, rank)], 1
        while k < int(size.max(initial=0)):
            later = np.zeros(n, np.int64)
            more = np.flatnonzero(self.rest > k)
            later[more] = rank[more + k]
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1]
            k *= 2
            self.ranks.append((k, rank))

    def nodes(self, leaves: np.ndarray, depth: int) -> np.ndarray:
        """A number for each leaf: that of the highest inner node of at least ``depth`` words above it, or 0."""
        by = np.argsort(self.ranks[-1][1][leaves], kind="stable")
        x, y = leaves[by[:-1]], leaves[by[1:]]
        common = np.zeros(len(x), np.int64)
        for k, rank in reversed(self.ranks):  # a step of k words where these are the same in both
            fits = np.flatnonzero((self.rest[x] - common >= k) & (self.rest[y] - common >= k))
            fits = fits[rank[x[fits] + common[fits]] == rank[y[fits] + common[fits]]]
            common[fits] += k
        joined = common >= depth
        node = np.cumsum(np.r_[True, ~joined]) if len(leaves) else np.zeros(0, np.int64)
        inner = np.r_[False, joined] | np.r_[joined, False]
        out = np.zeros(len(leaves), np.int64)
        out[by] = np.where(inner, node, 0)
        return out


def equal_windows(window: int):
    def run(pieces: list[bytes], windows: np.ndarray) -> np.ndarray:
        tree = Subtree(pieces)
        return tree.nodes(ragged(tree.first, windows), window)

    return run


def scheme(window: int = WINDOW_WORDS) -> Scheme:
    reach = max(1, window * 3 // 5)
    return Scheme(WordUnits, equal_windows(window), window, reach, min(4, window - reach + 1), keep_first=True)


def _finish(texts: bool):
    def run(b: Batch, gone: np.ndarray) -> pa.RecordBatch:
        first = b.units.first
        total = np.diff(first)
        cuts = np.r_[0, np.cumsum(gone)]
        removed = cuts[first[1:]] - cuts[first[:-1]]
        digests, kept = [], []
        for k, text in enumerate(b.texts):
            words = text.split()
            if removed[k]:
                words = list(compress(words, (~gone[first[k] : first[k + 1]]).tolist()))
            text = b" ".join(words)
            digests.append(hashlib.sha256(text).hexdigest())
            if texts:
                kept.append(text)
        doc = b.rows.column("doc_id").combine_chunks().cast(pa.int64())
        cols = [doc, pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if texts:
            cols, names = [*cols, pa.array(kept, pa.binary()).cast(pa.string())], [*names, "kept_text"]
        return pa.RecordBatch.from_arrays(cols, names)

    return run


def dedup_words(documents: DataFrame, window: int = WINDOW_WORDS, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept_text of each document of (doc_id, text)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * texts
    return remove_repeats(documents.select("doc_id", "text"), scheme(window), _finish(texts), schema)
