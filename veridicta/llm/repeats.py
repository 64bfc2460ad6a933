"""Repeated windows of L units (words or bytes) across a corpus, found in groups of windows that can be equal.

Every window has an anchor: the place with the least rolling hash among its first ``reach`` places, so equal windows
have their anchor at the same offset.  Windows of one anchor form a run, and what they cover, at most L + reach - 1
units, is the run's piece of text.  Three exchanges follow, each among what is still undecided:

1. prefix: the L - reach + 1 units from the anchor on, which all windows of a run have.  A run whose prefix occurs
   once has no repeats.
2. class: equal pieces, by 128 bits, are decided as one; only one member goes on.
3. order: the pieces themselves go to the groups of their prefixes, where the unit's own module (a suffix tree over
   words, prefix-free parsing over bytes) sorts their suffixes and finds equal windows exactly.  A prefix with more
   pieces than a task should hold is lengthened to the whole window: each window then goes by its own 128 bits.

The corpus stays in batches, dealt out by batch once, and is not shuffled again: a batch tells its values, a row for
each part, and hears back bits in the order of what it told.  A batch tells each value once, however often it has it,
so no value puts more rows into a task than there are batches.  A long text is cut into overlapping slices for the
search of runs; a run that a slice's end divides is only a class of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridicta.llm.common import SpanHash, binary, byte_column, cut, dealt, ids_of, mix, numbers, ragged, trim
from veridicta.plans.shipping import ship

BATCH_BYTES = 3 << 20
PARTITION_BYTES = 24 << 20
PART_VALUES = 400_000
SLICE_UNITS = 1 << 18
GROUP_BYTES = 2 << 20
_TOLD = "part long, batch long, a binary, b binary, doc binary, place binary, size binary, text binary"
_REPLY = "batch long, part long, yes binary, no binary"


@dataclass
class Scheme:
    """``units(texts)`` has ``first`` (where each text's units begin), ``code(i, j)`` (units as 64-bit numbers) and
    ``piece(i, j)`` (their bytes).  ``equal(pieces, windows)`` gives numbers to the windows of pieces, in order, equal
    ones for equal windows, and the number 0 to those that equal none; a piece's windows begin at its first units."""

    units: Callable
    equal: Callable
    length: int
    reach: int
    gram: int
    keep_first: bool

    def __post_init__(self):
        assert self.reach + self.gram <= self.length + 1


def pack(df: DataFrame, limit: int = BATCH_BYTES, deal: bool = False) -> DataFrame:
    """Rows in batches of about ``limit`` bytes of text: batch, rows (compressed Arrow), size.  ``deal``: partitioned
    by batch, so that joins by batch leave them where they are."""

    ship(df.sparkSession)

    def run(batches):
        n, held, size = 0, [], 0
        where = TaskContext.get().partitionId() << 32

        def out():
            t = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            return pa.RecordBatch.from_arrays([pa.array([where + n]), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([size])], ["batch", "rows", "size"])

        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                held.append(part)
                size += part.nbytes
                if size >= limit:
                    yield out()
                    n, held, size = n + 1, [], 0
                    trim()
        if held:
            yield out()

    packed = cut(df.mapInArrow(run, "batch long, rows binary, size long"))
    if not deal:
        return packed
    size = packed.agg(F.sum("size")).first()[0] or 0
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt(packed, max(least, size // PARTITION_BYTES), "batch")


def unpacked(rows: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(rows)).read_all()


class Runs:
    """The runs of windows of some texts: anchor, first and last window start, text, prefix and class."""

    NAMES = ("anchor", "low", "high", "text", "key", "kind", "kind2")

    def __init__(self, scheme: Scheme, units):
        found = [self._of(scheme, units, *s) for s in self._slices(scheme, np.diff(units.first), units.first)]
        for k, name in enumerate(self.NAMES):
            kind = np.int64 if k < 4 else np.uint64
            setattr(self, name, np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind))

    @staticmethod
    def _slices(s: Scheme, count: np.ndarray, first: np.ndarray):
        """(texts, first window starts, windows): whole texts together, or a part of one long text."""
        held, total = [], 0
        for k in np.flatnonzero(count >= s.length):
            windows = int(count[k]) - s.length + 1
            if total and total + count[k] > SLICE_UNITS:
                yield held, first[held], count[held] - s.length + 1
                held, total = [], 0
            if windows <= SLICE_UNITS:
                held.append(k)
                total += count[k]
            else:
                for at in range(0, windows, SLICE_UNITS):
                    yield [k], first[[k]] + at, np.array([min(SLICE_UNITS, windows - at)])
        if held:
            yield held, first[held], count[held] - s.length + 1

    @staticmethod
    def _of(s: Scheme, units, texts, begin: np.ndarray, windows: np.ndarray):
        base, end = int(begin[0]), int(begin[-1] + windows[-1] + s.length - 1)
        code = units.code(base, end)
        n = len(code)
        spans, again = SpanHash(code), SpanHash(mix(code))
        least = (spans.grams(s.gram) >> np.uint64(32) << np.uint64(32)) | np.arange(n - s.gram + 1, dtype=np.uint64)
        width = 1
        while width * 2 <= s.reach:  # least of the places i .. i + reach - 1
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < s.reach:
            least = np.minimum(least[: len(least) - (s.reach - width)], least[s.reach - width :])
        starts = ragged(begin - base, windows)
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        text = np.repeat(np.array(texts), windows)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
        last = np.r_[new[1:], len(at)] - 1
        anchor, low, high = at[new], starts[new], starts[last]
        shape = mix(((anchor - low) << 20 | (high - low)).astype(np.uint64))
        key = spans.of(anchor, anchor + s.length - s.reach + 1)
        kind, kind2 = (mix(x.of(low, high + s.length) + shape) for x in (spans, again))
        return anchor + base, low + base, high + base, text[new], key, kind, kind2


def tell(batch: int, parts: int, value, extra=None, doc=None, place=None):
    """One row for each part that gets some of the values; none where there are no values."""
    if not len(value):
        return []
    part = (value % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.r_[True, np.diff(part[by]) != 0])
    ends = np.r_[edge[1:], len(by)]
    held = [None if x is None else x[by] for x in (value, extra, doc, place)]
    return [(int(part[by[i]]), batch, *(None if x is None else binary(x[i:j]) for x in held)) for i, j in zip(edge, ends, strict=True)]


def record(rows, schema: str):
    names = [x.split()[0] for x in schema.split(",")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


class Dealt:
    """How some values of a batch are dealt into parts: ``rows`` tells them, ``heard`` reads the bits that come back."""

    def __init__(self, value: np.ndarray, parts: int, base: int = 0):
        part = (value % np.uint64(parts)).astype(np.int64) + base
        self.by = np.argsort(part, kind="stable")
        self.part, at = np.unique(part[self.by], return_index=True)
        self.span = list(zip(at, np.r_[at, len(value)][1:], strict=True))

    def rows(self, batch: int, *columns, pieces: list[bytes] | None = None):
        for p, (i, j) in zip(self.part.tolist(), self.span, strict=True):
            pick = self.by[i:j]
            held = [None if c is None else binary(c[pick]) for c in columns]
            held += [None] * (5 - len(held))
            yield (p, batch, *held, None if pieces is None else b"".join(pieces[k] for k in pick.tolist()))

    def heard(self, replies: list | None, which: str, size: np.ndarray | None = None) -> np.ndarray:
        """A mark for each value; with ``size`` for each of so many windows of each value."""
        per = np.ones(len(self.by), np.int64) if size is None else size
        first = np.cumsum(per) - per
        out = np.zeros(int(per.sum()), bool)
        span = dict(zip(self.part.tolist(), self.span, strict=True))
        for r in replies or []:
            if r["part"] in span and r[which]:
                i, j = span[r["part"]]
                pick = self.by[i:j]
                at = ragged(first[pick], per[pick])
                out[at] = np.unpackbits(np.frombuffer(r[which], np.uint8), count=len(at)).astype(bool)
        return out


def _told(t: pa.Table, column: str, dtype):
    return numbers(t.column(column), dtype)


def _replies(t: pa.Table, many: np.ndarray, yes: np.ndarray, no: np.ndarray | None = None) -> pa.Table:
    """The marks of each row's values, or windows, as bits."""
    edge = np.r_[0, np.cumsum(many)]
    bits = [None if m is None else [binary(np.packbits(m[i:j])) for i, j in zip(edge[:-1], edge[1:], strict=True)] for m in (yes, no)]
    return pa.table([t.column("batch").cast(pa.int64()), t.column("part").cast(pa.int64()), *(pa.array(x or [None] * len(many), pa.binary()) for x in bits)], ["batch", "part", "yes", "no"])


def _counts(t: pa.Table, column: str = "a", width: int = 8) -> np.ndarray:
    return np.array([len(x) // width for x in byte_column(t.column(column))], np.int64)


def _prefixes(limit: int):
    """yes: the prefix occurs elsewhere too.  no: too often for one group."""

    def run(t: pa.Table) -> pa.Table:
        value, count = _told(t, "a", np.uint64), _told(t, "b", np.int64)
        _, inverse, rows = np.unique(value, return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=count)[inverse] if len(value) else np.zeros(0)
        return _replies(t, _counts(t), (rows[inverse] > 1) | (count > 1), total > limit)

    return run


def _same(keep_first: bool, columns: list[np.ndarray], order: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(repeats to remove, all but the first) of rows that are equal in ``columns``."""
    n = len(columns[0])
    by = np.lexsort((*order[::-1], *columns[::-1]))
    new = np.ones(n, bool)
    for k, c in enumerate(columns):
        differs = c[by[1:]] != c[by[:-1]]
        new[1:] = differs if not k else new[1:] | differs
    later = np.zeros(n, bool)
    later[by[~new]] = True
    if keep_first:
        return later, later
    group = np.cumsum(new) - 1
    many = np.zeros(n, bool)
    many[by] = np.bincount(group)[group] > 1 if n else many
    return many, later


def _order(t: pa.Table, many: np.ndarray, keep_first: bool) -> list[np.ndarray]:
    batch = np.repeat(t.column("batch").to_numpy(), many)
    return [_told(t, "doc", np.int64), _told(t, "place", np.int64), batch] if keep_first else [batch]


def _classes(keep_first: bool):
    """yes: the batch's place of this value is a repeat to remove.  no: another batch goes on with it."""

    def run(t: pa.Table) -> pa.Table:
        many = _counts(t)
        yes, no = _same(keep_first, [_told(t, "a", np.uint64), _told(t, "b", np.uint64)], _order(t, many, keep_first))
        return _replies(t, many, yes, no)

    return run


def _groups(scheme: Scheme, parts: int):
    """Parts of pieces, by their suffixes' order, and after these parts of single windows, by their 128 bits."""
    classes = _classes(scheme.keep_first)

    def run(t: pa.Table) -> pa.Table:
        if t.column("part")[0].as_py() >= parts:
            return classes(t)
        many = _counts(t)
        key, windows, size = _told(t, "a", np.uint64), _told(t, "b", np.int64), _told(t, "size", np.int64)
        order = _order(t, many, scheme.keep_first)
        text = b"".join(byte_column(t.column("text")))
        begin, first = np.cumsum(size) - size, np.cumsum(windows) - windows
        gone = np.zeros(int(windows.sum()), bool)
        by = np.argsort(key, kind="stable")
        new = np.flatnonzero(np.r_[True, key[by[1:]] != key[by[:-1]]])
        weight = np.add.reduceat(size[by], new)
        edge = np.r_[new, len(by)]
        held, i = 0, 0
        for g in range(len(new)):  # whole groups, some at a time
            held += weight[g]
            if held >= GROUP_BYTES or g == len(new) - 1:
                pick = by[edge[i] : edge[g + 1]]
                number = scheme.equal([text[begin[k] : begin[k] + size[k]] for k in pick.tolist()], windows[pick])
                at, of = ragged(first[pick], windows[pick]), np.repeat(pick, windows[pick])
                some = np.flatnonzero(number)
                place = (at - first[of])[some]
                ranks = [o[of[some]] for o in order]
                if scheme.keep_first:
                    ranks[1] = ranks[1] + place
                gone[at[some]] = _same(scheme.keep_first, [number[some]], [*ranks, at[some]])[0]
                held, i = 0, g + 1
                trim()
        return _replies(t, np.add.reduceat(windows, np.cumsum(many) - many), gone)

    return run


class Batch:
    """One batch's runs and how far they are decided."""

    def __init__(self, scheme: Scheme, row: dict, parts: tuple[int, int]):
        self.scheme, self.id, self.row, (self.parts, self.piece_parts) = scheme, row["batch"], row, parts
        self.rows = unpacked(row["rows"])
        self.texts = byte_column(self.rows.column("text"))
        self.doc = ids_of(self.rows.combine_chunks())
        self.units = scheme.units(self.texts)
        self.runs = Runs(scheme, self.units)

    def _keys(self):
        value, inverse, count = np.unique(self.runs.key, return_inverse=True, return_counts=True)
        return value, inverse, count, Dealt(value, self.parts)

    def tell_keys(self):
        value, _, count, dealt = self._keys()
        yield from dealt.rows(self.id, value, count)

    def _order(self, run: np.ndarray):
        text = self.runs.text[run]
        return self.doc[text], self.runs.low[run] - self.units.first[text]

    def _kinds(self):
        """(open runs, of them the ones whose prefix is too frequent, repeats, first runs of their classes)."""
        value, inverse, _, dealt = self._keys()
        heard = self.row.get("keys")
        i = np.flatnonzero(dealt.heard(heard, "yes")[inverse])
        crowded = dealt.heard(heard, "no")[inverse[i]]
        r = self.runs
        gone, later = _same(self.scheme.keep_first, [r.kind[i], r.kind2[i]], [*self._order(i), i])
        return i, crowded, gone, np.flatnonzero(~later)

    def tell_kinds(self):
        i, _, _, at = self._kinds()
        i = i[at]
        yield from Dealt(self.runs.kind[i], self.parts).rows(self.id, self.runs.kind[i], self.runs.kind2[i], *(self._order(i) if self.scheme.keep_first else ()))

    def _open(self):
        """(runs all of whose windows go, runs that go on as pieces, runs that go on window by window)."""
        i, crowded, gone, at = self._kinds()
        r, heard = self.runs, self.row.get("kinds")
        dealt = Dealt(r.kind[i[at]], self.parts)
        gone[at] |= dealt.heard(heard, "yes")
        if not self.scheme.keep_first:  # what holds for a class's first run holds for all of them
            gone = self._any(gone, r.kind[i], r.kind2[i])
        go = at[~dealt.heard(heard, "no")]
        return i[gone], i[go[~crowded[go]]], i[go[crowded[go]]]

    @staticmethod
    def _any(mark: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A mark for all rows with equal (a, b) where one of them has it."""
        if not len(a):
            return mark
        by = np.lexsort((b, a))
        group = np.zeros(len(a), np.int64)
        group[by] = np.cumsum(np.r_[True, (np.diff(a[by]) != 0) | (np.diff(b[by]) != 0)]) - 1
        return (np.bincount(group, weights=mark) > 0)[group]

    def _windows(self, run: np.ndarray):
        """(starts, run, both fingerprints) of each of the runs' windows."""
        r, length = self.runs, self.scheme.length
        n = r.high[run] - r.low[run] + 1
        starts, of = ragged(r.low[run], n), np.repeat(run, n)
        a, b = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        at = 0
        for k, m in zip(run.tolist(), n.tolist(), strict=True):
            code = self.units.code(int(r.low[k]), int(r.high[k]) + length)
            a[at : at + m], b[at : at + m] = SpanHash(code).grams(length), SpanHash(mix(code)).grams(length)
            at += m
        return starts, of, a, b

    def _single(self, run: np.ndarray):
        """(window starts, repeats among them, the first of each value, how these are dealt, what is told of them)."""
        starts, of, a, b = self._windows(run)
        text = self.runs.text[of]
        doc, place = self.doc[text], starts - self.units.first[text]
        gone, later = _same(self.scheme.keep_first, [a, b], [doc, place, np.arange(len(a))])
        at = np.flatnonzero(~later)
        told = (a[at], b[at], *((doc[at], place[at]) if self.scheme.keep_first else ()))
        return starts, gone, at, Dealt(a[at], self.parts, self.piece_parts), told, (a, b)

    def tell_pieces(self):
        _, pieces, single = self._open()
        r, length = self.runs, self.scheme.length
        if len(pieces):
            data = [self.units.piece(i, j + length) for i, j in zip(r.low[pieces].tolist(), r.high[pieces].tolist(), strict=True)]
            order = self._order(pieces) if self.scheme.keep_first else (None, None)
            size = np.array([len(x) for x in data], np.int64)
            yield from Dealt(r.key[pieces], self.piece_parts).rows(self.id, r.key[pieces], r.high[pieces] - r.low[pieces] + 1, *order, size, pieces=data)
        if len(single):
            *_, dealt, told, _ = self._single(single)
            yield from dealt.rows(self.id, *told)

    def removed(self) -> np.ndarray:
        """Marks of the units to remove."""
        r, length = self.runs, self.scheme.length
        cover = np.zeros(int(self.units.first[-1]) + 1, np.int32)
        gone, pieces, single = self._open()
        heard = self.row.get("pieces")
        np.add.at(cover, r.low[gone], 1)
        np.add.at(cover, r.high[gone] + length, -1)
        n = r.high[pieces] - r.low[pieces] + 1
        mark = Dealt(r.key[pieces], self.piece_parts).heard(heard, "yes", n)
        starts = [ragged(r.low[pieces], n)[mark]]
        if len(single):
            at, repeats, firsts, dealt, _, (a, b) = self._single(single)
            repeats[firsts] |= dealt.heard(heard, "yes")
            if not self.scheme.keep_first:  # all windows that equal one that goes
                repeats = self._any(repeats, a, b)
            starts.append(at[repeats])
        for s in starts:
            np.add.at(cover, s, 1)
            np.add.at(cover, s + length, -1)
        return np.cumsum(cover[:-1]) > 0


def _rows(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]
            trim()


def remove_repeats(df: DataFrame, scheme: Scheme, finish: Callable[[Batch, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``finish`` gets each batch with its marks and makes the rows of ``schema``."""
    packed = pack(df, deal=True)
    many = packed.rdd.getNumPartitions()
    size = packed.agg(F.sum("size")).first()[0] or 0
    per_value = (scheme.reach + 1) / 2 * (6 if scheme.length < 64 else 1)
    parts = (max(4, int(size / per_value / PART_VALUES) + 1), max(4, size // (4 * GROUP_BYTES)))
    limit = GROUP_BYTES // (scheme.length * (6 if scheme.length < 64 else 1))

    def exchange(step, reply, joined):
        def run(batches):
            for row in _rows(batches):
                if out := list(step(Batch(scheme, row, parts))):
                    yield record(out, _TOLD)

        got = cut(joined.mapInArrow(run, _TOLD).groupBy("part").applyInArrow(reply, _REPLY), free=True)
        return got.repartition(many, "batch").groupBy("batch").agg(F.collect_list(F.struct("part", "yes", "no")).alias("told"))

    def joined(**replies):
        out = packed
        for name, r in replies.items():
            out = out.join(r.withColumnRenamed("told", name), "batch", "left")
        return out

    k = exchange(Batch.tell_keys, _prefixes(limit), packed)
    c = exchange(Batch.tell_kinds, _classes(scheme.keep_first), joined(keys=k))
    w = exchange(Batch.tell_pieces, _groups(scheme, parts[1]), joined(keys=k, kinds=c))

    def last(batches):
        for row in _rows(batches):
            b = Batch(scheme, row, parts)
            yield finish(b, b.removed())

    return joined(keys=k, kinds=c, pieces=w).mapInArrow(last, schema)
