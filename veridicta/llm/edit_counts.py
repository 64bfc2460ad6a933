"""Edit-aware token counts: a tree of pre-token counts a document, of which an edit touches a few leaves.

A text is split by the byte-level vocabulary's pattern into pre-tokens, which are encoded on their own, so counts add
up.  The leaves of a document's tree are runs of up to ``LEAF`` pre-tokens with their characters and tokens; inner
nodes hold sums.  An edit replaces characters [start, end) by a text.  Splitting starts again at the first pre-token
that ends at or after start - 1 (the pattern looks at most one character past the end of a run of spaces), and stops
where a new boundary meets an old one behind the edit; from there on all matches are as before.  Only the pre-tokens in
between are encoded, and only the sums above the changed leaves are made anew: an edit fills the leaves it touches, as
many as there were, up to ``FULL`` times their size.  Only an insertion beyond that makes more leaves, and all sums.

Positions are clipped to the text (end below start counts as start); edits apply in the order given, each to the
outcome of the ones before.  Null text is empty; null numbers in an edit are 0, a null text in it is empty.  Rows come
back one for one, repeated rows and null ids too; an empty table gives none.  Further columns, whatever their names,
are dropped.  The file of ranks is a parameter, read on each executor.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridicta.llm.common import chunks
from veridicta.plans.shipping import ship

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF = 64
FULL = 4  # a leaf takes so many times its size before it is split
_CACHE = 500_000


class Counter:
    """Tokens of single pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}
        self.encoded = 0

    def count(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > _CACHE:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = len(self.encode(p))
        self.encoded += len(parts)
        return [known[p] for p in parts]


class Tree:
    """Leaves are [lengths, counts] of pre-tokens; ``sums[0]`` has (characters, tokens, pre-tokens) of each leaf and
    every level above the sums of pairs of the level below."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text = counter, text
        parts = counter.pattern.findall(text)
        sizes, tokens = list(map(len, parts)), counter.count(parts)
        self.leaves = [[sizes[i : i + LEAF], tokens[i : i + LEAF]] for i in range(0, len(parts), LEAF)] or [[[], []]]
        self.sums: list[list[tuple[int, int, int]]] = []
        self._sum(0, len(self.leaves), len(self.leaves))

    @property
    def tokens(self) -> int:
        return self.sums[-1][0][1]

    @property
    def pretokens(self) -> int:
        return self.sums[-1][0][2]

    def _sum(self, low: int, high: int, old_high: int) -> None:
        """Leaves [low, high) stand where [low, old_high) stood; sums to their left stay, and to their right where
        the number of leaves did not change."""
        fresh = [(sum(a), sum(b), len(a)) for a, b in self.leaves[low:high]]
        if not self.sums or high != old_high:
            keep = self.sums[0] if self.sums else []
            level = keep[:low] + fresh + keep[old_high:]
            self.sums = [level]
            while len(level) > 1:
                level = [tuple(map(sum, zip(*level[i : i + 2], strict=True))) for i in range(0, len(level), 2)]
                self.sums.append(level)
            return
        self.sums[0][low:high] = fresh
        for below, level in zip(self.sums, self.sums[1:], strict=False):
            low, high = low // 2, (high + 1) // 2
            for k in range(low, high):
                level[k] = tuple(map(sum, zip(*below[2 * k : 2 * k + 2], strict=True)))

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """(leaf, its first character) of the first leaf that ends at or after ``place``; down from the root."""
        k, begin = 0, 0
        for depth in range(len(self.sums) - 1, 0, -1):
            k *= 2
            below = self.sums[depth - 1]
            if begin + below[k][0] < place and k + 1 < len(below):
                begin += below[k][0]
                k += 1
        return k, begin

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters; returns how many pre-tokens were encoded."""
        old_text = self.text
        start = min(max(start, 0), len(old_text))
        end = min(max(end, start), len(old_text))
        self.text = text = old_text[:start] + new + old_text[end:]
        shift = len(new) - (end - start)
        leaf, begin = self._leaf_at(start - 1)
        sizes, tokens = self.leaves[leaf]
        at = 0
        while at < len(sizes) and begin + sizes[at] < start - 1:
            begin += sizes[at]
            at += 1
        # old boundaries from here on, leaf by leaf, until a new one meets one of them behind the edit
        parts: list[str] = []
        place, old, last, k = begin, begin, leaf, at
        ends_at = end
        while True:
            while old < ends_at or old + shift < place:
                if k < len(self.leaves[last][0]):
                    old += self.leaves[last][0][k]
                    k += 1
                elif last + 1 < len(self.leaves):
                    last, k = last + 1, 0
                else:
                    break
            if old >= ends_at and old + shift == place and place >= start + len(new):
                break
            m = self.counter.pattern.match(text, place) if place < len(text) else None
            if m is None:
                break
            parts.append(m.group())
            place = m.end()
        counts = self.counter.count(parts)
        new_sizes = sizes[:at] + list(map(len, parts)) + self.leaves[last][0][k:]
        new_tokens = tokens[:at] + counts + self.leaves[last][1][k:]
        n, span = len(new_sizes), last + 1 - leaf
        # as many leaves as before, unless what came in would make them too large: then all sums are made anew
        size = -(-n // span) if n <= span * FULL * LEAF else LEAF
        fresh = [[new_sizes[i : i + size], new_tokens[i : i + size]] for i in range(0, n, size)] if n else []
        if n <= span * FULL * LEAF:
            fresh += [[[], []] for _ in range(span - len(fresh))]
        self.leaves[leaf : last + 1] = fresh
        self._sum(leaf, leaf + len(fresh), last + 1)
        return len(parts)


def standard_edits(text: Column) -> Column:
    """Three edits of a text of n characters: a line put in at n/2, the 16 characters from n/3 on replaced by "edit 42",
    and the 8 characters from 3n/4 on taken out."""
    n = F.length(text)
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("new"))
    half, third, late = F.floor(n / 2), F.floor(n / 3), F.floor(n * 3 / 4)
    return F.array(edit(half, half, "\n one more line.\n"), edit(third, third + 16, "edit 42"), edit(late, late + 8, ""))


def edited_counts(documents: DataFrame, path: str, pattern: str, edits: Column | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens, n_edits, reencoded, n_pretokens_after, n_tokens_after for (doc_id, text).

    ``edits``: a column of array<struct<start, end, new>>; by default ``standard_edits``.
    """
    ship(documents.sparkSession)
    text = F.coalesce("text", F.lit(""))
    d = documents.select("doc_id", text.alias("text"), (standard_edits(text) if edits is None else edits).alias("edits"))
    names = ["doc_id", "n_pretokens", "n_tokens", "n_edits", "reencoded", "n_pretokens_after", "n_tokens_after"]

    def run(batches):
        counter = Counter(path, pattern)
        for b in batches:
            for part, texts in chunks(b):
                rows = []
                for raw, changes in zip(texts, part.column(2).to_pylist(), strict=True):
                    tree = Tree(counter, raw.decode())
                    before = tree.pretokens, tree.tokens
                    again = sum(tree.edit(e["start"] or 0, e["end"] or 0, e["new"] or "") for e in changes or [])
                    rows.append((*before, len(changes or []), again, tree.pretokens, tree.tokens))
                cols = np.array(rows, np.int64).reshape(len(rows), 6).T
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *map(pa.array, cols)], names)

    return d.mapInArrow(run, ", ".join(f"{c} long" for c in names))
