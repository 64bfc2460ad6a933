"""Best-fit packing: token sequences of at most ``CAPACITY``, from a configuration linear program.

1. Documents become ids (the named tokenizer, no special tokens added, then id 1) and pieces of at most 4096.
2. The pieces' lengths are counted: a histogram of at most 4096 numbers, all that the driver ever holds.
3. The configuration program asks for the fewest sequences, each filled by a configuration of lengths, that hold the
   histogram.  Multiplicative weights set a price on every length, higher where more of it is left than of the others;
   a knapsack over the capacity prices all configurations at once, and those that are worth nearly as much as the
   dearest get fractions of uses, till a length is served or an eighth of what is left is.  As every use serves a
   length or an eighth, there are few more configurations than lengths.  The prices bound the program's value from
   below (``Plan.bound``).
4. Uses are rounded down.  What remains is less than a sequence a configuration, so its size depends on the number of
   lengths, not on the corpus; the same pricing places it in whole uses, lengths with their counts, never piece by piece.
5. Pieces of a length are numbered with running sums over buckets, and a small table of number ranges, which has a row
   for each place of each configuration, tells each piece its sequence and its offset.

Null text is empty: one id.  Documents are only cut above the capacity.  Repeated rows are packed like others, null
ids too.  An empty table gives no rows.  Further columns of the documents, whatever their names, are dropped.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.llm.common import Words, chunks, cut, ragged, trim
from veridicta.plans.shipping import ship

CAPACITY = 4096
END_ID = 1
BUCKET_PIECES = 500_000
TOKENIZER = "word_bpe_49k.json"
_CACHE = 500_000

# Fixed value: how the tokenizer's file splits normalised text.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordTokenizer:
    """Ids of single words; white space is dropped by this tokenizer, so a text's ids are those of its words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.split = regex.compile(_SPLIT).findall
        self.plain = re.compile(r"[a-z]+").fullmatch
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.forget()
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.symbols = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}

    def _keep(self, keep: np.ndarray) -> None:
        self.flat = self.flat[ragged(self.first[keep], self.size[keep])]
        self.value, self.check, self.size, self.met = self.value[keep], self.check[keep], self.size[keep], self.met[keep]
        self.first = np.cumsum(self.size) - self.size

    def shrink(self) -> None:
        """Only the words of the last chunks stay, among them all frequent ones."""
        self._keep(np.flatnonzero(self.met > self.turn - 3))
        self.pieces.clear()

    def forget(self) -> None:
        # known words by fingerprint: a check, and where their ids are in ``flat``, and when they were met last
        self.value = self.check = np.zeros(0, np.uint64)
        self.first = self.size = self.met = np.zeros(0, np.int64)
        self.flat, self.turn = np.zeros(0, np.uint32), 0
        self.pieces.clear()

    def piece(self, s: str) -> tuple[int, ...]:
        ids = self.pieces.get(s)
        if ids is None:
            ids = tuple(t.id for t in self.model.tokenize(s.encode().decode("latin-1").translate(self.symbols)))
            if len(self.pieces) >= _CACHE // 4:
                self.pieces.clear()
            self.pieces[s] = ids
        return ids

    def word(self, raw: bytes) -> tuple[int, ...]:
        s = raw.decode()
        if b"<|" in raw or not (s.isascii() or max(s) < "ɐ"):
            return tuple(self.whole.encode(s, add_special_tokens=False).ids)
        s = s.lower() if s.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", s))
        if self.plain(s):
            return self.piece(s)
        out: tuple[int, ...] = ()
        for p in self.split(s):
            out += self.piece(p)
        return out

    def _learn(self, value: np.ndarray, check: np.ndarray, words: list[bytes]) -> None:
        """Keeps the ids of new words; when there are too many, those go that were not met for longest."""
        ids = [self.word(x) for x in words]
        size = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))
        if len(self.value) + len(value) > _CACHE and len(self.met):
            self._keep(np.flatnonzero(self.met >= np.partition(self.met, len(self.met) // 2)[len(self.met) // 2]))
        first = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.value, value)  # both are sorted
        self.value, self.check, self.first = np.insert(self.value, at, value), np.insert(self.check, at, check), np.insert(self.first, at, first)
        self.size, self.met = np.insert(self.size, at, size), np.insert(self.met, at, self.turn)

    def batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each text followed by END_ID; how many each text has).  Words are told apart by 128 bits."""
        w = Words(texts, second=True)
        value, at, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        check = w.second[at]
        data, self.turn = w.data.tobytes(), self.turn + 1
        i = np.minimum(np.searchsorted(self.value, value), max(0, len(self.value) - 1))
        known = self.value[i] == value if len(self.value) else np.zeros(len(value), bool)
        self.met[i[known]] = self.turn
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(value[new], check[new], [data[a:b] for a, b in zip(w.start[at[new]].tolist(), w.end[at[new]].tolist(), strict=True)])
        i = np.searchsorted(self.value, value)
        if len(value) and ((self.check[i] != check).any() or (check[inverse] != w.second).any()):
            return self._one_by_one(texts)
        self.met[i] = self.turn
        known = i[inverse]
        per_word = self.size[known]
        total = np.r_[0, np.cumsum(per_word)]
        count = total[w.first[1:]] - total[w.first[:-1]] + 1
        out = np.full(int(count.sum()), END_ID, np.uint32)
        ends = np.cumsum(count) - 1
        mark = np.ones(len(out), bool)
        mark[ends] = False
        out[mark] = self.flat[ragged(self.first[known], per_word)]
        return out, count

    def _one_by_one(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same without any fingerprints, for words whose first ones collide."""
        ids = [[i for x in t.split() for i in self.word(x)] + [END_ID] for t in texts]
        return np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64)


@cache
def tokenizer(path: str) -> WordTokenizer:
    """One a Python worker; few of the words it met stay at a task's end, since other stages use the worker too."""
    return WordTokenizer(path)


def token_pieces(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    ship(documents.sparkSession)

    def run(batches):
        words = tokenizer(path)
        for b in batches:
            for part, texts in chunks(b):
                ids, count = words.batch(texts)
                n = -(-count // capacity)
                piece = ragged(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(np.repeat(count, n) - start, capacity)
                at = np.repeat(np.cumsum(count) - count, n) + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(at.tolist(), length.tolist(), strict=True)]
                doc = part.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [doc, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )
        words.shrink()
        trim()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


NEAR = 1e-3  # configurations worth so much less than the dearest are used with it
BATCH = 128  # configurations between two pricings
SHARE = 8
STEP = 0.5


@dataclass
class Plan:
    """Configurations with their uses; ``bound``: no packing has fewer sequences; ``value``: those of the fractional
    program; ``rest``: pieces that rounding down left over."""

    configs: list[tuple[dict[int, int], int]]
    bound: float
    value: float
    rest: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configs)


def _knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(the most that each capacity can be worth, a length of its dearest content or 0), for prices by length."""
    best, pick = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    back = np.zeros(capacity + 1)  # best, in reverse, so that both operands run forwards
    for c in range(1, capacity + 1):
        value = back[capacity + 1 - c :] + price[1 : c + 1]  # best[c - k] + price[k]
        k = int(value.argmax())
        if value[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = value[k], k + 1
        else:
            best[c], pick[c] = best[c - 1], pick[c - 1]
        back[capacity - c] = best[c]
    return best, pick


def _configuration(length: int, pick: np.ndarray, left: np.ndarray, capacity: int, whole: bool) -> dict[int, int]:
    """``length`` with the dearest content of the rest of the capacity, and then the longest lengths that still fit;
    only lengths of which something is left, and in ``whole`` no more than that."""
    out, free = {length: 1}, capacity - length

    def fits(k: int) -> bool:
        return left[k] > 0 and (not whole or left[k] > out.get(k, 0))

    while free > 0 and (k := int(pick[free])):
        if not fits(k):
            break
        out[k] = out.get(k, 0) + 1
        free -= k
    while free > 0:
        open_ = left[1 : free + 1] > 0
        for k, n in out.items():
            if whole and k <= free and left[k] <= n:
                open_[k - 1] = False
        if not open_.any():
            break
        k = free - int(open_[::-1].argmax())
        n = min(free // k, int(left[k]) - out.get(k, 0) if whole else free)
        out[k] = out.get(k, 0) + max(1, n)
        free -= k * max(1, n)
    return out


def _uses(counts: np.ndarray, capacity: int, whole: bool) -> tuple[list[tuple[dict[int, int], float]], float]:
    """(configurations and their uses that hold ``counts`` pieces of each length, a lower bound of the uses)."""
    left = counts.astype(np.int64 if whole else np.float64)
    sizes = np.arange(capacity + 1)
    weight = np.ones(capacity + 1)
    out: list[tuple[dict[int, int], float]] = []
    bound = 0.0
    while (live := np.flatnonzero(left > 0)).size:
        price = np.full(capacity + 1, -np.inf)
        price[live] = live * weight[live]
        best, pick = _knapsack(price, capacity)
        bound = max(bound, float(price[live] @ counts[live]) / best[capacity])
        worth = price[live] + best[capacity - live]
        near = live[worth >= (1 - NEAR) * best[capacity]][::-1][:BATCH]
        for length in near.tolist():
            if left[length] <= 0:
                continue
            config = _configuration(length, pick, left, capacity, whole)
            most = min(left[k] // n if whole else left[k] / n for k, n in config.items())
            share = float(left @ sizes) / capacity / SHARE
            uses = max(1, min(most, int(share) + 1)) if whole else min(most, max(share, 1.0))
            for k, n in config.items():
                left[k] -= uses * n
                if not whole and left[k] <= 1e-9 * max(1.0, uses * n):
                    left[k] = 0
            out.append((config, uses))
        open_ = np.flatnonzero(left > 0)
        if len(open_):
            share = left[open_] / counts[open_]
            weight[open_] *= np.exp(STEP * (share - share.mean()))
            weight[open_] /= weight[open_].mean()
            weight[open_] = np.clip(weight[open_], 0.5, 2.0)
    return out, bound


def program(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Configurations {length: pieces} with uses that hold the histogram exactly."""
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        counts[int(k)] = n
    fractions, bound = _uses(counts, capacity, False)
    configs, left = [], counts.copy()
    for config, uses in fractions:
        n = min(int(uses + 1e-9), *(int(left[k]) // m for k, m in config.items()))
        if n > 0:
            configs.append((config, n))
            for k, m in config.items():
                left[k] -= n * m
    rest = int(left.sum())
    more, _ = _uses(left, capacity, True)
    return Plan(configs + [(c, int(n)) for c, n in more], bound, float(sum(n for _, n in fractions)), rest)


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    return program(histogram, capacity).configs


def places(configs: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, from, to, first sequence, offset, pieces a sequence): numbers from .. to - 1 of a length go to
    sequence first + (number - from) // pieces at offset + length * ((number - from) % pieces)."""
    rows, used, sequence = [], {}, 0
    for config, uses in configs:
        offset = 0
        for length, n in sorted(config.items(), reverse=True):
            a = used.get(length, 0)
            used[length] = a + n * uses
            rows.append((length, a, a + n * uses, sequence, offset, n))
            offset += length * n
        sequence += uses
    return rows


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    rows = places(solve(histogram, capacity))
    schema = "__length long, __from long, __to long, __sequence long, __offset long, __each long"
    table = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    buckets = max(256, sum(histogram.values()) // BUCKET_PIECES)
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets))
    p = pieces.withColumn("__bucket", bucket)
    before = W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    base = p.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    base = base.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    p = p.join(base, ["length", "__bucket"])
    p = p.withColumn("__number", F.col("__base") + F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "piece")) - 1)
    on = (F.col("length") == F.col("__length")) & (F.col("__number") >= F.col("__from")) & (F.col("__number") < F.col("__to"))
    got = p.join(F.broadcast(table), on)  # a row for each place of each configuration; lengths, not pieces, bound their number: see solve
    k = F.col("__number") - F.col("__from")
    return got.select(
        *pieces.columns,
        (F.col("__sequence") + F.floor(k / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + F.col("length") * F.pmod(k, F.col("__each"))).cast("long").alias("offset"),
    )


def pack_documents(documents: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return assign(cut(token_pieces(documents, path, capacity)), capacity)
