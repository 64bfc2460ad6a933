"""URL filters: rules by host and path, and for what no rule fits a character model of accepted and rejected URLs.

The URLs that a rule allows are the accepted ones, those that a rule blocks the rejected ones; four of five of them (by
crc32) teach the models, the fifth calibrates.  Each class has a Markov model of variable order: a string of up to
ORDER + 1 symbols is kept if its class has it LEAST_COUNT times and in LEAST_SHARE of all places, so of each length
there are 1 / LEAST_SHARE at most however large the table, and the context grows as long as the strings that hold it are
kept.  Probabilities of longer contexts are smoothed by the next shorter one's with a weight of one for each kind of
successor, the shortest by equal ones.  Counting is by batch, then by string; only kept strings reach the driver.

The log-likelihood difference by symbol is made a score by logistic regression (classes of equal weight, Newton steps)
over a histogram of the held-out differences; 0.5 and above is allowed.  A class without a URL held out leaves the
difference as it is.

Null URL, or one without '://': empty host and path.  No rules that fit any URL: all scores are those of equal models,
0.5.  Repeated rows count each.  Long URLs are read whole, in pieces.  Columns other than page_id and url are not looked
at.  Empty table: no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridicta.llm.common import byte_column, cut, ragged, slices

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
ORDER = 5
LEAST_COUNT = 2
LEAST_SHARE = 1 / 20_000
FOLDS = 5
PIECE = 1 << 18  # symbols at once
STEP, LIMIT = 0.01, 16  # of the histogram
RIDGE = 1e-3
ALLOWED = 0.5
_CLASSES = ("allow", "block")
_SCALE = 1e9  # log ratios are added as whole numbers, so their order doesn't matter

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SYMBOL = np.full(256, 61, np.uint8)  # other than ASCII
_SYMBOL[:128] = 60
_SYMBOL[ord("0") : ord("9") + 1] = 27
for _first in b"aA":
    _SYMBOL[_first : _first + 26] = np.arange(1, 27)
_SYMBOL[list(_PUNCTUATION)] = 28 + np.arange(len(_PUNCTUATION))
_END, SYMBOLS, _BITS = 62, 63, 6  # 0 stands before the first


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, url, host, path, rule, ruled): the longest rule that fits and what it says, or nulls."""
    url = F.coalesce("url", F.lit(""))
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substr(url, begin + 3)).otherwise("")
    p = pages.select("page_id", "url", rest.alias("rest"))
    p = p.select(
        "page_id", "url", F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1).alias("path")
    )
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):  # the longest last, so it stands outside
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, ruled = F.when(fits, text).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return p.select("*", rule.alias("rule"), ruled.alias("ruled"))


def _symbols(urls: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All URLs' symbols, each behind ORDER starts and before an end; the places to predict, and how many of each URL."""
    sizes = np.array([len(u) for u in urls], np.int64)
    begins = np.cumsum(sizes + ORDER + 1) - (sizes + ORDER + 1)
    out = np.zeros(int((sizes + ORDER + 1).sum()), np.uint8)
    out[ragged(begins + ORDER, sizes)] = _SYMBOL[np.frombuffer(b"".join(urls), np.uint8)]
    out[begins + ORDER + sizes] = _END
    return out, ragged(begins + ORDER, sizes + 1), sizes + 1


def symbols_of(url: str | None) -> list[int]:
    return _symbols([(url or "").encode()])[0].tolist()


def _pieces(urls: list[bytes]):
    """(symbols, places, index of each place's URL), PIECE places at a time."""
    for i, j in slices(np.array([len(u) for u in urls], np.int64), PIECE):
        symbols, places, counts = _symbols(urls[i:j])
        of = np.repeat(np.arange(i, j), counts)
        for a in range(0, len(places), PIECE):
            yield symbols, places[a : a + PIECE], of[a : a + PIECE]


def _strings(symbols: np.ndarray, places: np.ndarray):
    """For each length the number of the string that ends at each place; without its last symbol it is the context's."""
    code, mark = np.zeros(len(places), np.int64), 1
    for k in range(ORDER + 1):
        code = code | (symbols[places - k].astype(np.int64) << (_BITS * k))
        mark <<= _BITS
        yield code | mark


def _gram_counts(batches):
    for batch in batches:
        urls, kinds = byte_column(batch.column("url")), batch.column("ruled").to_pylist()
        for kind in _CLASSES:
            for symbols, places, _ in _pieces([u for u, k in zip(urls, kinds, strict=True) if k == kind]):
                for strings in _strings(symbols, places):
                    gram, n = np.unique(strings, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([kind] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["kind", "gram", "n"])


class Chain:
    """One class's model: kept strings with their counts, contexts with the sum and number of what may follow."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        by = np.argsort(grams)
        self.grams, self.counts = grams[by].astype(np.int64), counts[by].astype(np.float64)
        self.contexts, at = np.unique(self.grams >> _BITS, return_inverse=True)
        self.total = np.bincount(at, self.counts, len(self.contexts))
        self.kinds = np.bincount(at, minlength=len(self.contexts)).astype(np.float64)

    @staticmethod
    def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
        return at, known[at] == wanted

    def log_likelihoods(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        p, open_ = np.full(len(places), 1 / SYMBOLS), np.arange(len(places))
        for strings in _strings(symbols, places):
            if not len(self.grams) or not len(open_):
                break
            wanted = strings[open_]
            at, known = self._find(self.contexts, wanted >> _BITS)
            open_, at, wanted = open_[known], at[known], wanted[known]  # a longer context is known only if this one is
            g, has = self._find(self.grams, wanted)
            p[open_] = (np.where(has, self.counts[g], 0) + self.kinds[at] * p[open_]) / (self.total[at] + self.kinds[at])
        return np.log(p)


@dataclass
class Model:
    allow: Chain
    block: Chain
    slope: float = 1.0
    offset: float = 0.0

    def differences(self, urls: list[bytes]) -> np.ndarray:
        """By URL, the mean log ratio of its symbols."""
        total, n = np.zeros(len(urls), np.int64), np.zeros(len(urls), np.int64)
        for symbols, places, of in _pieces(urls):
            ratio = self.allow.log_likelihoods(symbols, places) - self.block.log_likelihoods(symbols, places)
            np.add.at(total, of, np.rint(ratio * _SCALE).astype(np.int64))
            np.add.at(n, of, 1)
        return total / _SCALE / np.maximum(n, 1)

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * differences + self.offset, -700, 700)))


def _logistic(d: np.ndarray, good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """Slope and offset of least loss: the mean of each class's, and RIDGE times the slope squared."""
    if not good.sum() or not bad.sum():
        return 1.0, 0.0
    w_good, w_bad = good / good.sum(), bad / bad.sum()

    def loss(x: np.ndarray) -> float:
        z = x[0] * d + x[1]
        return float(w_good @ np.logaddexp(0, -z) + w_bad @ np.logaddexp(0, z) + RIDGE * x[0] ** 2)

    x = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x[0] * d + x[1])))
        g, h = (w_good + w_bad) * p - w_good, (w_good + w_bad) * p * (1 - p)
        gradient = np.array([g @ d + 2 * RIDGE * x[0], g.sum()])
        curvature = np.array([[h @ (d * d) + 2 * RIDGE, h @ d], [h @ d, h.sum() + 1e-12]])
        step, size, now = np.linalg.solve(curvature, gradient), 1.0, loss(x)
        while size > 1e-9 and loss(x - size * step) > now:
            size /= 2
        x = x - size * step
        if np.abs(gradient).max() < 1e-10:
            break
    return float(x[0]), float(x[1])


def train(pages: DataFrame, rules=RULES) -> Model:
    ruled = with_rules(pages, rules).where("rule IS NOT NULL").select("url", "ruled", (F.crc32(F.col("url").cast("binary")) % FOLDS == 0).alias("held"))
    grams = ruled.where("NOT held").select("url", "ruled").mapInArrow(_gram_counts, "kind string, gram long, n long")
    counts = cut(grams.groupBy("kind", "gram").agg(F.sum("n").alias("n")))
    places = dict(counts.where(f"gram < {1 << (2 * _BITS)}").groupBy("kind").agg(F.sum("n")).collect())  # of the strings of one symbol
    chains = []
    for kind in _CLASSES:
        least = max(LEAST_COUNT, math.ceil(places.get(kind, 0) * LEAST_SHARE))
        kept = counts.where((F.col("kind") == kind) & (F.col("n") >= least)).select("gram", "n").toArrow()  # of each length 1 / LEAST_SHARE at most
        chains.append(Chain(kept.column("gram").to_numpy(), kept.column("n").to_numpy()))
    model = Model(*chains)

    def histogram(batches):
        for batch in batches:
            bins = np.clip(np.rint(model.differences(byte_column(batch.column("url"))) / STEP), -LIMIT / STEP, LIMIT / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("ruled"), pa.array(bins)], ["kind", "bin"])

    found = ruled.where("held").select("url", "ruled").mapInArrow(histogram, "kind string, bin long").groupBy("kind", "bin").count().collect()
    tally = np.zeros((2, 2 * int(LIMIT / STEP) + 1))
    for kind, b, n in found:
        tally[_CLASSES.index(kind), b + int(LIMIT / STEP)] = n
    model.slope, model.offset = _logistic(np.arange(-int(LIMIT / STEP), int(LIMIT / STEP) + 1) * STEP, *tally)
    return model


def judge(pages: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, difference) of every row."""

    def scored(batches):
        for batch in batches:
            d = model.differences(byte_column(batch.column("url")))
            s = model.scores(d)
            names = ["page_id", "host", "path", "rule"]
            verdicts = [r or ("allow" if x >= ALLOWED else "block") for r, x in zip(batch.column("ruled").to_pylist(), s, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(verdicts, pa.string()), pa.array(s), pa.array(d)], [*names, "verdict", "score", "difference"])

    x = with_rules(pages, rules)
    return x.mapInArrow(scored, f"page_id {x.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double, difference double")


def url_verdicts(pages: DataFrame, rules=RULES) -> DataFrame:
    return judge(pages, train(pages, rules), rules)


RULES_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT * FROM (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) t(rule, rule_host, rule_path, ruled))
SELECT page_id, host, path, r.rule, r.ruled FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(r.rule) DESC) = 1
"""
