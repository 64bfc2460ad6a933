"""Substring dedup over bytes by prefix-free parsing.

Stretches that can hold repeated windows of 400 bytes are found and grouped as ``repeats`` tells: by the 273 bytes at
an anchor, which all windows of the anchor share.  The order of a group's suffixes then comes from prefix-free parsing.
A place whose eight bytes have a rolling hash divisible by 32 is a trigger; a phrase reaches from one trigger to
the end of the next, so no phrase's suffix longer than a trigger is the beginning of another one's.  Highly repetitive
text has few distinct phrases: the dictionary, whose suffixes are ranked by doubling, and the parse, the sequence of
phrases, whose suffixes are ranked likewise.  A suffix of the text is ordered by the rank of the rest of its phrase,
then by the rank of the parse from the next phrase on.  Neighbours in that order that agree in 400 bytes, which is
checked on the bytes themselves, are repeats.

Nulls are empty texts; texts under 400 bytes stay whole.  Repeated rows are repeats of each other.  Removed stretches
that touch count as one.  An empty table gives no rows.  ``dedup_bytes`` keeps further columns, whatever their names;
bytes of a character that a cut splits are left out of ``text`` there, but not out of the digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veridicta.llm.common import BYTE_CODE, SpanHash, ragged
from veridicta.llm.repeats import Batch, Scheme, remove_repeats

WINDOW_BYTES = 400
TRIGGER, APART = 8, 32  # bytes of a trigger, one place in so many is one
PACKED = 7  # symbols of 9 bits in one number
COMPARED = 1 << 12


class ByteUnits:
    def __init__(self, texts: list[bytes]):
        self.first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.first[1:])
        self.data = b"".join(texts)

    def code(self, i: int, j: int) -> np.ndarray:
        return BYTE_CODE[np.frombuffer(self.data, np.uint8, j - i, i)]

    def piece(self, i: int, j: int) -> bytes:
        return self.data[i:j]


def _doubled(rank: np.ndarray, rest: np.ndarray, k: int, most: int) -> np.ndarray:
    """Ranks of the suffixes at each place, from those by their first k symbols; ``rest``: symbols up to the string's end."""
    n, kinds = len(rank), -1
    while k < most:
        more = np.flatnonzero(rest > k)
        later = np.zeros(n, np.int64)
        later[more] = rank[more + k] + 1
        value, rank = np.unique(rank * (n + 1) + later, return_inverse=True)
        if len(value) == kinds:  # nothing was told apart, so nothing will be
            break
        kinds, k = len(value), k * 2
    return rank


class Parsing:
    """Prefix-free parsing of a text: dictionary and parse, with the ranks of their suffixes."""

    def __init__(self, text: bytes):
        t = np.frombuffer(text, np.uint8)
        hashed = SpanHash(BYTE_CODE[t]).grams(TRIGGER)
        trigger = np.flatnonzero(hashed % np.uint64(APART) == 0)
        self.start = np.r_[0, trigger[trigger > 0]]
        end = np.r_[self.start[1:] + TRIGGER, len(t)]
        number: dict[bytes, int] = {}
        phrases = [number.setdefault(text[i:j], len(number)) for i, j in zip(self.start.tolist(), end.tolist(), strict=True)]
        self.dictionary = list(number)
        rank = np.zeros(len(number), np.int64)
        rank[sorted(range(len(number)), key=self.dictionary.__getitem__)] = np.arange(len(number))
        self.parse = np.array(phrases, np.int64)
        self.in_parse = _doubled(rank[self.parse], np.arange(len(self.parse), 0, -1), 1, len(self.parse))

    def order(self, places: np.ndarray) -> np.ndarray:
        """The places in the order of the text's suffixes.  Only phrases that places stand in have all suffixes ranked."""
        phrase = np.searchsorted(self.start, places, "right") - 1
        used, which = np.unique(self.parse[phrase], return_inverse=True)
        held = [self.dictionary[k] for k in used.tolist()]
        size = np.array([len(p) for p in held], np.int64)
        first = np.cumsum(size) - size
        data = np.frombuffer(b"".join(held), np.uint8).astype(np.int64) + 1
        rest = np.repeat(first + size, size) - np.arange(len(data))
        packed = np.zeros(len(data), np.int64)
        padded = np.r_[data, np.zeros(PACKED, np.int64)]
        for i in range(PACKED):
            packed = packed << 9 | np.where(rest > i, padded[i : i + len(data)], 0)
        rank = np.unique(packed, return_inverse=True)[1]
        rank = _doubled(rank, rest, PACKED, int(size.max(initial=0)))[first[which] + places - self.start[phrase]]
        after = np.r_[self.in_parse + 1, 0][phrase + 1]
        return np.lexsort((after, rank))


def equal_windows(window: int):
    def run(pieces: list[bytes], windows: np.ndarray) -> np.ndarray:
        text = b"".join(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        places = ragged(np.cumsum(size) - size, windows)
        by = Parsing(text).order(places)
        view = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text, np.uint8), window)
        at, joined = places[by], np.zeros(max(0, len(by) - 1), bool)
        for i in range(0, len(joined), COMPARED):
            span = at[i : i + COMPARED + 1]
            joined[i : i + COMPARED] = (view[span[:-1]] == view[span[1:]]).all(1)
        out = np.zeros(len(by), np.int64)
        inner = np.r_[False, joined] | np.r_[joined, False]
        out[by] = np.where(inner, np.cumsum(np.r_[True, ~joined]), 0)
        return out

    return run


def scheme(window: int = WINDOW_BYTES) -> Scheme:
    reach = max(1, min(128, window // 3))
    return Scheme(ByteUnits, equal_windows(window), window, reach, min(16, window - reach + 1), keep_first=False)


def _kept(b: Batch, gone: np.ndarray):
    """(removed bytes, removed runs, kept bytes) of each text."""
    first = b.units.first
    cuts = np.r_[0, np.cumsum(gone)]
    removed = cuts[first[1:]] - cuts[first[:-1]]
    spans, kept = np.zeros(len(b.texts), np.int64), []
    for k, text in enumerate(b.texts):
        if removed[k]:
            mark = gone[first[k] : first[k + 1]]
            spans[k] = np.count_nonzero(np.diff(mark.astype(np.int8), prepend=np.int8(0)) == 1)
            text = np.frombuffer(text, np.uint8)[~mark].tobytes()
        kept.append(text)
    return removed, spans, kept


def _digest(b: Batch, gone: np.ndarray) -> pa.RecordBatch:
    removed, spans, kept = _kept(b, gone)
    doc = b.rows.column("doc_id").combine_chunks().cast(pa.int64())
    return pa.RecordBatch.from_arrays(
        [doc, pa.array(np.diff(b.units.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def repeated_bytes(documents: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document of (doc_id, text)."""
    return remove_repeats(
        documents.select("doc_id", "text"), scheme(window), _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )


def dedup_bytes(documents: DataFrame, window: int = WINDOW_BYTES) -> DataFrame:
    """The documents with repeated stretches removed from ``text``; a column n_chars follows the new text."""
    given = documents.columns
    documents = documents.toDF(*(c.lower() if c.lower() in ("doc_id", "text", "n_chars") else c for c in given))
    names = documents.columns

    def finish(b: Batch, gone: np.ndarray) -> pa.RecordBatch:
        removed, _, kept = _kept(b, gone)
        texts = [x.decode("utf-8", "ignore") for x in kept]
        old = b.rows.column("text").combine_chunks()
        text = [None if t is False else x for t, x in zip(old.is_valid().to_pylist(), texts, strict=True)]
        columns = []
        for name in names:
            c = b.rows.column(name).combine_chunks()
            if name == "text":
                c = pa.array(text, pa.string())
            elif name == "n_chars":
                n = pa.array([None if x is None else len(x) for x in text]).cast(c.type)
                c = n if not c.null_count else pa.array([y if z else None for y, z in zip(n.to_pylist(), c.is_valid().to_pylist(), strict=True)], c.type)
            columns.append(c)
        return pa.RecordBatch.from_arrays(columns, names)

    return remove_repeats(documents, scheme(window), finish, documents.schema).toDF(*given)
