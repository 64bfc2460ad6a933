"""Near-duplicate classes by ProbMinHash over five-word shingles.

A document is the multiset of its five-word shingles (a shorter one is a single shingle, one without words has none
and is near nothing).  Shingle i with count w sends arrivals of a Poisson process with rate w; each arrival falls on
one of ``HASHES`` places, and each place keeps the shingle that arrives first.  All shingles of a text send their
first arrivals, then their second ones, and a shingle stops once its time is past the latest place's first, since
later arrivals change nothing.  Two texts agree in a place with the probability Jaccard similarity of their counts.

Signatures are cut into bands.  In every bucket of a band the text that shares most buckets is the pivot; each text
is verified against the pivots of its buckets, exactly, by the shingle counts of both texts.  Texts of one bucket that
are then still in different components are looked at again: those outside the bucket's largest component have their
signatures compared with all others of the bucket in other components, in blocks.  Where these agree in as many
places as pairs at the threshold do but once in three million times (five standard deviations less), the text asks the
block that the other one stands in: a part of that one's most crowded bucket.  Every text goes to its own block once,
and with it all that ask this block; pairs are verified there and never become rows.  A block gives back a spanning
forest, fewer links than texts.  So no pair that shares a bucket is dropped, and a group of copies costs each member
a few links and blocks.  With 32 bands of 4 rows a pair at similarity 0.8 shares no bucket once in 20 million times.

Texts with the same words are one class before any of this; only the one with the least id stands in bands.  Classes
are the connected components of the links, named by their least doc_id.  ``n_links``: verified links to other texts
of the class that this class's search made (it doesn't verify pairs that are connected already).

Null text is empty.  Rows come back one for one; a null doc_id takes part, and is kept only if its whole class has
null ids.  Further columns are dropped by ``near_duplicates`` and kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.llm.common import FIRST, SpanHash, Words, binary, byte_column, chunks, cut, mix, ragged, slices, trim, unused
from veridicta.plans.shipping import ship

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
CHUNK = 1 << 20
MARGIN = 5 * (SIMILARITY * (1 - SIMILARITY) / HASHES) ** 0.5
BLOCK = 2000
CELL_BYTES = 4 << 20
PAIRS = 1 << 18


def shingles(texts: list[bytes]):
    """(text, shingle, count) of the distinct shingles, and each text's word digest (None without words)."""
    w = Words(texts)
    spans = SpanHash(w.hash)
    n = np.where(w.count >= SHINGLE, w.count - SHINGLE + 1, np.minimum(w.count, 1))
    start = ragged(w.first[:-1], n)
    text = np.repeat(np.arange(len(texts)), n)
    value = spans.of(start, np.minimum(start + SHINGLE, w.first[1:][text]))
    by = np.lexsort((value, text))
    text, value = text[by], value[by]
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (value[1:] != value[:-1])]) if len(by) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(by)])
    digests = [hashlib.blake2b(binary(w.hash[a:b]), digest_size=16).digest() if b > a else None for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    return text[new], value[new], count, digests


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(texts: int, text: np.ndarray, value: np.ndarray, count: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """The shingle that arrives first at each place, for each text; 0 for texts without shingles."""
    first = np.full(texts * hashes, np.inf)
    holder = np.zeros(texts * hashes, np.uint64)
    time = np.zeros(len(text))
    live, turn = np.arange(len(text)), 0
    while len(live):
        turn += 1
        seed = mix(value[live] + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time[live] -= np.log(_uniform(seed)) / count[live]
        place = text[live] * hashes + (mix(seed) % np.uint64(hashes)).astype(np.int64)
        t = time[live]
        near = t < first[place]
        np.minimum.at(first, place[near], t[near])
        won = near & (t == first[place])
        holder[place[won]] = value[live[won]]
        latest = first.reshape(texts, hashes).max(1)
        live = live[t < latest[text[live]]]
    return holder.reshape(texts, hashes)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two (sorted values, counts): sum over common i of 1 / sum_j max(a_j/a_i, b_j/b_i)."""
    (va, ca), (vb, cb) = a, b
    common, i, j = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = ca[i].astype(float), cb[j].astype(float)
    ratio = x / y
    by = np.argsort(ratio, kind="stable")
    x, y, ratio = x[by], y[by], ratio[by]
    only_a, only_b = ca.sum() - x.sum(), cb.sum() - y.sum()
    above = np.cumsum(x[::-1])[::-1] + only_a  # of all j with a ratio as large or larger
    below = np.r_[0.0, np.cumsum(y)[:-1]] + only_b
    left = np.searchsorted(ratio, ratio, "left")
    return float((1 / (above[left] / x + below[left] / y)).sum())


def counts_of(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    _, value, count, _ = shingles([text])
    return value, count


def signed(documents: DataFrame) -> DataFrame:
    """doc_id, digest (16 bytes, null without words), bands (a number for each band), places (16 bits for each hash), size."""
    ship(documents.sparkSession)

    def run(batches):
        for b in batches:
            for part, texts in chunks(b, limit=CHUNK):
                text, value, count, digests = shingles(texts)
                rows = mix(signatures(len(texts), text, value, count))
                band = np.zeros((len(texts), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band + rows.reshape(len(texts), BANDS, ROWS)[:, :, r])
                flat = pa.array(band.view(np.int64).ravel())
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * BANDS, pa.int32()), flat)
                places = pa.array([binary(r) for r in rows.astype(np.uint16)], pa.binary())
                size = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(digests, pa.binary()), bands, places, size], ["doc_id", "digest", "bands", "places", "size"])
                trim()

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, bands array<long>, places binary, size long")


def _similar(threshold: float):
    """For cogroups of texts that ask and texts that are asked for, by (lead, part, turn): links (a, b) of similar texts
    of different components, with their components.  Each side's shingles are counted once; one text is held against
    all of the other side at once.  Links that join what others of the cogroup have joined already are left out, and
    pairs that they would join aren't looked at, so there are fewer links than texts."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            out = list(_links(left, right, threshold))
        trim()
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table([pa.array(c, pa.binary()) for c in cols], ["a", "b", "component_a", "component_b"])

    return run


class _Shingled:
    """The texts of a cogroup: shingles by number, shares and counts."""

    def __init__(self, texts: list[bytes]):
        parts = [(i, *shingles(texts[i:j])[:3]) for i, j in slices(np.array([len(t) for t in texts]), CHUNK // 2)]
        text, value, count = (np.concatenate(x) for x in zip(*((t + i, v, c) for i, t, v, c in parts), strict=True))
        self.first = np.searchsorted(text, np.arange(len(texts) + 1))
        self.n = np.diff(self.first)
        self.value, self.count = value, count
        _, self.number = np.unique(value, return_inverse=True)
        total = np.bincount(text, weights=count, minlength=len(texts))
        self.share = count / total[text]
        self.plain = np.bincount(text, weights=count > 1, minlength=len(texts)) == 0  # no shingle repeats
        self.mark = np.zeros(int(self.number.max()) + 1 if len(value) else 1)

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.first[k], self.first[k + 1]
        return self.value[a:b], self.count[a:b]

    def near(self, k: int, others: np.ndarray, threshold: float) -> np.ndarray:
        """Which of ``others`` are as similar to k as ``threshold``.  Without repeated shingles that is Jaccard; else
        common shares, which are never less than the similarity, tell which pairs need their own sum."""
        span = slice(self.first[k], self.first[k + 1])
        self.mark[self.number[span]] = self.share[span]
        at = ragged(self.first[others], self.n[others])
        seen = self.mark[self.number[at]]
        begin = np.cumsum(self.n[others]) - self.n[others]
        common = np.add.reduceat((seen > 0).astype(np.float64), begin)
        bound = np.add.reduceat(np.minimum(seen, self.share[at]), begin)
        self.mark[self.number[span]] = 0
        good = common >= threshold * (self.n[k] + self.n[others] - common) - 1e-9
        for i in np.flatnonzero(~(self.plain[others] & self.plain[k])):
            good[i] = bound[i] >= threshold - 1e-9 and similarity(self.of(k), self.of(others[i])) >= threshold - 1e-9
        return good


def _links(left: pa.Table, right: pa.Table, threshold: float):
    sides = pa.concat_tables([left, right])
    digest = sides.column("digest").combine_chunks().dictionary_encode()
    code = digest.indices.to_numpy()
    row = np.zeros(len(digest.dictionary), np.int64)
    row[code] = np.arange(len(code))
    data = _Shingled(byte_column(sides.column("text").take(pa.array(row))))
    names = digest.dictionary.to_pylist()
    kind = sides.column("component").combine_chunks().dictionary_encode()
    component, up = kind.indices.to_numpy()[row], np.arange(len(kind.dictionary))
    called = kind.dictionary.to_pylist()

    key = np.zeros(len(code), np.uint64)
    for c in ("lead", "part", "turn"):  # groups that collide are looked at together
        key = mix(key + sides.column(c).cast(pa.int64()).to_numpy().view(np.uint64))
    n = left.num_rows
    lo, ro = np.argsort(key[:n], kind="stable"), np.argsort(key[n:], kind="stable")
    lk, rk = key[:n][lo], key[n:][ro]
    for g in np.unique(lk):
        x = code[:n][lo[np.searchsorted(lk, g, "left") : np.searchsorted(lk, g, "right")]]
        y = code[n:][ro[np.searchsorted(rk, g, "left") : np.searchsorted(rk, g, "right")]]
        few, many = (x, y) if len(x) <= len(y) else (y, x)
        for k in few.tolist():
            others = many[up[component[many]] != up[component[k]]]
            if not len(others):
                continue
            for o in others[data.near(k, others, threshold)].tolist():
                r, s = up[component[k]], up[component[o]]
                if r != s:
                    up[up == max(r, s)] = min(r, s)  # a cogroup's components: a few thousand
                    yield min(names[k], names[o]), max(names[k], names[o]), called[component[k]], called[component[o]]


def _verified(asking: DataFrame, asked: DataFrame, texts: DataFrame, load: int, threshold: float) -> DataFrame:
    """Links between ``asking`` and ``asked``: (lead, part, turn, digest, component) of the texts that meet."""
    cells = max(64, load // CELL_BYTES)

    def side(df):
        d = df.join(texts, "digest").withColumn("cell", F.pmod(F.xxhash64("lead", "part", "turn"), F.lit(cells)))
        return d.select(*(F.col(c).alias(c) for c in ("cell", "lead", "part", "turn", "digest", "component", "text"))).groupBy("cell")

    return side(asking).cogroup(side(asked)).applyInArrow(_similar(threshold), "a binary, b binary, component_a binary, component_b binary")


def _settled(df: DataFrame) -> DataFrame:
    """``df`` cut, and without the size that Spark estimates: a checkpoint keeps it, joins multiply it, and in a loop
    the number's own length grows exponentially."""
    spark = df.sparkSession
    done = cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of links (a, b), named by the least node.  Each round every node goes to its least
    neighbour if that is less than itself, pointers are followed to the roots in steps that grow, and links are redrawn between roots.
    At most every second node that has a link is a root, so rounds are logarithmic, whatever the shape."""
    both = _settled(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = both.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    edges = both.where("a <> b")
    while not edges.isEmpty():
        root = _settled(edges.groupBy(F.col("a").alias("component")).agg(F.min(F.least("a", "b")).alias("root")))
        while True:
            far = root.select(F.col("component").alias("root"), F.col("root").alias("far"))
            farther = far.select(F.col("root").alias("far"), F.col("far").alias("farther"))
            step = _settled(root.join(far, "root").join(farther, "far").select("component", F.col("root").alias("old"), F.col("farther").alias("root")))
            root = step.select("component", "root")
            if step.where("old <> root").isEmpty():
                break
        now = now.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        of_a, of_b = (root.select(F.col("component").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
        redrawn = edges.join(of_a, "a").join(of_b, "b").where("root_a <> root_b")
        edges = _settled(redrawn.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct())
    return _settled(now)


def _alike(threshold: float):
    """For cogroups of texts outside their bucket's largest component and of others: which (lead, part) holds others of
    a different component with signatures as alike as the threshold asks for."""
    least = int(np.ceil((threshold - MARGIN) * HASHES))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            found = list(_pairs_alike(left, right, least))
        x, lead, part = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        by = np.lexsort((part, lead, x))
        x, lead, part = x[by], lead[by], part[by]
        new = np.r_[True, (np.diff(x) != 0) | (np.diff(lead) != 0) | (np.diff(part) != 0)] if len(x) else np.zeros(0, bool)
        digest = left.column("digest").combine_chunks().take(pa.array(x[new]))
        return pa.table([digest, pa.array(lead[new]), pa.array(part[new])], ["digest", "lead", "part"])

    return run


def _pairs_alike(left: pa.Table, right: pa.Table, least: int):
    n = left.num_rows
    sides = pa.concat_tables([left, right])
    key = np.zeros(len(sides), np.uint64)
    for c in ("band", "bucket", "i", "j"):  # buckets that collide are looked at together
        key = mix(key + sides.column(c).cast(pa.int64()).to_numpy().view(np.uint64))
    component = sides.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    places = np.frombuffer(b"".join(byte_column(sides.column("places"))), np.uint16).reshape(len(sides), HASHES)
    lead, part = (right.column(c).cast(pa.int64()).to_numpy() for c in ("lead", "part"))
    group, of = np.unique(key, return_inverse=True)
    lo, ro = np.argsort(of[:n], kind="stable"), np.argsort(of[n:], kind="stable")
    ln, rn = np.bincount(of[:n], minlength=len(group)), np.bincount(of[n:], minlength=len(group))
    lf, rf = np.cumsum(ln) - ln, np.cumsum(rn) - rn
    # a row for each asking text and its bucket's others, some millions of cells at a time
    x = lo
    many = rn[of[x]]
    step = np.searchsorted(np.cumsum(many), np.arange(0, int(many.sum()) + PAIRS, PAIRS), "left")
    for a, b in zip(step, np.r_[step[1:], len(x)], strict=True):
        p = np.repeat(x[a:b], many[a:b])
        q = ro[ragged(rf[of[x[a:b]]], many[a:b])]
        apart = component[p] != component[n + q]
        p, q = p[apart], q[apart]
        for at in range(0, len(p), PAIRS // 8):
            i, j = p[at : at + PAIRS // 8], q[at : at + PAIRS // 8]
            hit = (places[i] == places[n + j]).sum(1) >= least
            yield i[hit], lead[j[hit]], part[j[hit]]


def _questions(shared: DataFrame, groups: DataFrame, places: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(asking texts with the blocks they ask, texts with their block): (lead, part, digest, component, size) of both.
    A text's block is a part of its most crowded bucket among those that hold different components."""
    named = shared.join(groups.withColumnRenamed("node", "digest"), "digest", "left")
    named = named.withColumn("component", F.coalesce("component", "digest"))
    sizes = named.groupBy("band", "bucket", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("band", "bucket").agg(F.max(F.struct("m", "component")).alias("most"), F.count("*").alias("k"), F.sum("m").alias("n")).where("k > 1")
    largest = largest.select("band", "bucket", "n", F.col("most.component").alias("largest"), (F.col("n") - F.col("most.m")).alias("outside"))
    split = cut(named.drop("n").join(largest, ["band", "bucket"]))
    crowded = F.max(F.struct("n", F.xxhash64("band", "bucket").alias("h")))["h"].alias("lead")
    block = split.groupBy("digest").agg(crowded, F.first("component").alias("component"), F.first("size").alias("size"))
    parts = block.groupBy("lead").agg(F.ceil(F.sum("size") / F.lit(float(CELL_BYTES))).alias("parts"))
    block = cut(block.join(parts, "lead").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts"))).drop("parts"))
    rows = split.drop("component", "size").join(block, "digest").join(places, "digest")
    cells = max(64, split.count() // 20_000)
    left_blocks, right_blocks = F.ceil(F.col("outside") / F.lit(float(BLOCK))), F.ceil(F.col("n") / F.lit(float(BLOCK)))

    def side(df, own, other, own_blocks, other_blocks):
        d = df.withColumn(own, F.pmod(F.xxhash64("digest"), own_blocks)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), other_blocks - 1)))
        d = d.withColumn("cell", F.pmod(F.xxhash64("band", "bucket", "i", "j"), F.lit(cells)))
        return d.select(*(F.col(c).alias(c) for c in ("cell", "band", "bucket", "i", "j", "digest", "component", "places", "lead", "part"))).groupBy("cell")

    left, right = side(rows.where("component <> largest"), "i", "j", left_blocks, right_blocks), side(rows, "j", "i", right_blocks, left_blocks)
    asked = left.cogroup(right).applyInArrow(_alike(threshold), "digest binary, lead long, part long").distinct()
    return cut(asked.join(block.select("digest", "component", "size"), "digest")), block


def members(documents: DataFrame, threshold: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id and digest of each row; for each digest its class_id, head and n_links).  The head is the digest of the
    text that names the class; a class without ids has ``FIRST`` as class_id."""
    docs = cut(signed(documents))
    place = F.coalesce(F.col("doc_id"), F.lit(FIRST))
    # the least id among texts with the same words, and one signature of theirs
    distinct = docs.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min(place).alias("least"), F.first("bands").alias("bands"), F.first("places").alias("places"), F.max("size").alias("size")
    )
    bands = distinct.select("digest", "size", F.posexplode("bands").alias("band", "bucket"))
    crowd = bands.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(bands.join(crowd, ["band", "bucket"]))  # skew: the crowded side has one row a bucket
    degree = shared.groupBy("digest").agg(F.sum("n").alias("degree"))
    shared = cut(shared.join(degree, "digest"))
    pivots = shared.groupBy("band", "bucket").agg(F.max(F.struct("degree", "digest"))["digest"].alias("pivot"))

    wanted = shared.select("digest").distinct()
    least = cut(distinct.select("digest", "least").join(wanted, "digest", "left_semi"))
    ids = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("least"), "text")
    # rows that repeat an id may differ in text, so the digest decides
    texts = ids.join(least.select("least").distinct(), "least", "left_semi")
    texts = cut(_with_digest(texts.select("text")).join(wanted, "digest", "left_semi").dropDuplicates(["digest"]), free=True)

    # every text against the pivots of its buckets; a pivot of many goes to each of their parts once
    star = shared.join(pivots, ["band", "bucket"]).where("digest <> pivot").select("digest", "pivot", "size").distinct()
    parts = star.groupBy("pivot").agg(F.ceil(F.sum("size") / F.lit(float(CELL_BYTES))).alias("parts"))
    star = star.join(parts, "pivot").select(
        F.xxhash64("pivot").alias("lead"), F.pmod(F.xxhash64("digest"), F.col("parts")).alias("part"), F.lit(0).alias("turn"), "digest", F.col("digest").alias("component"), "pivot", "size"
    )
    star = cut(star)
    pivot = star.select("lead", "part", "turn", F.col("pivot").alias("digest"), F.col("pivot").alias("component")).distinct()
    star_links = cut(_verified(star, pivot, texts, _load(star), threshold), free=True).select("a", "b")
    groups = components(star_links)

    # what no pivot has settled
    places = distinct.select("digest", "places").join(wanted, "digest", "left_semi")
    asking, block = _questions(shared, groups, places, threshold)
    turns = asking.groupBy("lead", "part").agg(F.ceil(F.sum("size") / F.lit(float(CELL_BYTES))).alias("turns"))
    asked = block.join(turns, ["lead", "part"]).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))
    asking = asking.join(turns, ["lead", "part"]).withColumn("turn", F.pmod(F.xxhash64("digest"), F.col("turns")))
    more = cut(_verified(asking, asked, texts, _load(asking) + _load(asked), threshold))
    roots = components(more.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
    links = star_links.unionByName(more.select("a", "b"))

    ends = links.select(F.col("a").alias("digest")).unionByName(links.select(F.col("b").alias("digest")))
    degree = ends.groupBy("digest").agg(F.count("*").alias("n_links"))
    member = distinct.select("digest", "least").join(groups.withColumnRenamed("node", "digest"), "digest", "left").join(degree, "digest", "left")
    member = member.withColumn("star", F.coalesce("component", "digest")).drop("component")
    member = member.join(roots.select(F.col("node").alias("star"), F.col("component")), "star", "left").withColumn("component", F.coalesce("component", "star"))
    named = F.min(F.struct("least", "digest"))
    heads = member.groupBy("component").agg(named["least"].alias("class_id"), named["digest"].alias("head"))
    return docs.select("doc_id", "digest"), member.join(heads, "component").select("digest", "class_id", "head", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _load(rows: DataFrame) -> int:
    return int(rows.agg(F.sum("size")).first()[0] or 0)


def classes(documents: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, digest, class_id, n_links for each row of (doc_id, text)."""
    docs, member = members(documents, threshold)
    out = docs.join(member, "digest", "left")
    alone = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.nullif("class_id", F.lit(FIRST)))
    return out.select("doc_id", "digest", alone.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _digests(texts: list[bytes]) -> list[bytes | None]:
    w = Words(texts)
    return [hashlib.blake2b(binary(w.hash[i:j]), digest_size=16).digest() if j > i else None for i, j in zip(w.first[:-1], w.first[1:], strict=True)]


def _with_digest(rows: DataFrame, name: str = "digest") -> DataFrame:
    """The rows with the digest of their ``text``."""
    names = rows.columns

    def run(batches):
        for b in batches:
            for part, data in chunks(b, limit=CHUNK):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_digests(data), pa.binary())], [*names, name])
                trim()

    return rows.mapInArrow(run, rows.withColumn(name, F.lit(b"")).schema)


def near_duplicates(documents: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links, kept: one document of each class is kept, the one that names it."""
    got = classes(documents, threshold)
    return got.select("doc_id", "class_id", "n_links", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_duplicates(documents: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One row of each class, with its columns: one that has the id and the words that name the class.  Rows without
    words all stay."""
    _, member = members(documents, threshold)
    no_words = F.coalesce("text", F.lit("")).rlike(r"^[\x20\x09-\x0D]*\z")
    digest, ident, number = unused(documents.columns, "digest", "id", "n")
    rows = _with_digest(documents.where(~no_words), digest).withColumn(ident, F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)))
    heads = member.where("digest = head").select(F.col("digest").alias(digest), F.col("class_id").alias(ident))
    first = F.row_number().over(W.partitionBy(digest, ident).orderBy(F.lit(1)))
    one = rows.join(heads, [digest, ident]).withColumn(number, first).where(F.col(number) == 1)
    return one.select(*documents.columns).unionByName(documents.where(no_words))
