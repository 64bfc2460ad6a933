"""Nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors get one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and queries, scaled to norm M, a zero
there; then the largest inner product is the least Euclidean distance.  A table hashes a vector with some functions
floor((a.x + b) / w), a Gaussian.  A query visits in each table its own bucket and others one step off in some
projections, in the order of their estimated success: the steps are ordered by the distance to the border they cross,
and sets of steps by what the sum of squares of these distances is expected to be.  Buckets are dealt into cells; a
vector goes to a cell once, whichever of its buckets are there, and a query's candidates of all tables in a cell are
scored together, each once, exactly on the original vectors and in double.

How many functions, tables and probes are enough depends on how far neighbours lie apart from others.  So the true
neighbours of ``TRIAL_QUERIES`` queries are found first, in blocks over all points, and of ``CHOICES`` the one is taken
that finds ``TRIAL_RECALL`` of them at the least cost: of buckets visited, and of points scored by their share of
``TRIAL_POINTS`` points.  Clustered vectors are found
in some hundredths of the points; vectors without structure need most of them, whatever the hashing.

Equal vectors are one point of the index, which holds the first ids only (more can't be among the nearest), so a
vector that a third of the rows share makes no crowded bucket.  Buckets beyond ``BUCKET_ROWS`` points are split, and a
query visits all parts.  Queries that find fewer than asked for, while there are more, are compared with all points in
blocks.  Recall against brute force is above 0.9 on vectors without any structure (tests/llm).

Vectors that are null, zero or hold null or non-finite components take no part, as queries too, nor rows with null
ids.  Vectors of different lengths are never compared.  Rows that repeat (id, vector) count once.
"""

from __future__ import annotations

import heapq
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.llm.common import cut, ragged
from veridicta.plans.shipping import ship



class Hashing(NamedTuple):
    tables: int
    projections: int
    width: float  # in units of the largest norm
    probes: int


CHOICES = (
    Hashing(16, 12, 1.2, 200), Hashing(16, 12, 1.5, 200), Hashing(32, 12, 1.5, 100), Hashing(24, 10, 1.2, 300), Hashing(16, 8, 1.2, 100), Hashing(40, 12, 1.6, 200), Hashing(16, 8, 1.2, 300), Hashing(8, 6, 1.3, 100),
    Hashing(8, 6, 1.3, 200), Hashing(8, 5, 1.5, 48), Hashing(8, 5, 1.5, 80),
)
TRIAL_QUERIES, TRIAL_POINTS, TRIAL_RECALL = 64, 1024, 0.94
VISIT = 0.5  # what a visit to a bucket costs, in points scored
BUCKET_ROWS = 20_000
CELL_ROWS = 60_000


@cache
def _tables(size: int, h: Hashing):
    rng = np.random.default_rng([size, h.tables, h.projections])
    n = h.tables * h.projections
    return rng.normal(size=(size + 1, n)), rng.uniform(0, 1, n), rng.integers(1, 1 << 62, h.projections) * 2 + 1


@cache
def _step_sets(h: Hashing) -> list[tuple[int, ...]]:
    """Sets of steps, as places in the order of their distances, by their expected sums of squares; a projection's two
    steps, whose places add up to the last, are never together."""
    k, n = h.projections, 2 * h.projections
    j = np.arange(1, n + 1)
    up = n + 1 - j
    cost = np.where(j <= k, j * (j + 1) / (4 * (k + 1) * (k + 2)), 1 - up / (k + 1) + up * (up + 1) / (4 * (k + 1) * (k + 2)))
    out, queue = [()], [(cost[0], (0,))]
    while queue and len(out) < h.probes:
        c, s = heapq.heappop(queue)
        if all(n - 1 - i not in s for i in s):
            out.append(s)
        if (last := s[-1]) + 1 < n:
            heapq.heappush(queue, (c - cost[last] + cost[last + 1], (*s[:-1], last + 1)))
            heapq.heappush(queue, (c + cost[last + 1], (*s, last + 1)))
    return out


def _place(x: np.ndarray, top: float, query: bool, h: Hashing) -> np.ndarray:
    """Where vectors lie along all projections, in cells: (rows, tables, projections)."""
    norm = np.sqrt((x * x).sum(1))
    if query:
        x, last = x * (top / norm)[:, None], np.zeros(len(x))
    else:
        last = np.sqrt(np.maximum(top * top - norm * norm, 0))
    a, b, _ = _tables(x.shape[1], h)
    y = np.column_stack([x, last]) @ a / (h.width * top) + b
    return y.reshape(len(x), h.tables, h.projections)


def _keys(x: np.ndarray, top: float, query: bool, h: Hashing) -> np.ndarray:
    """A number for each bucket, (rows, tables, 1), or for each that a query visits, (rows, tables, probes)."""
    size, y = x.shape[1], _place(x, top, query, h)
    odd = _tables(size, h)[2]
    cell = np.floor(y)
    own = (cell.astype(np.int64) * odd).sum(-1) + np.int64((size & 0x7FFF) << 48)  # modulo 2^64
    if not query:
        return own[..., None]
    order = np.argsort(np.concatenate([y - cell, 1 - (y - cell)], -1), axis=-1, kind="stable")
    by = np.where(order < h.projections, -1, 1) * odd[order % h.projections]  # what each step adds to the number
    return own[..., None] + np.stack([by[..., list(s)].sum(-1) for s in _step_sets(h)], -1)


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)


def _by_length(batch, column: str):
    """Row numbers and vectors for each length of vectors."""
    col = batch.column(column)
    sizes = np.array(pa.compute.list_value_length(col).to_numpy(zero_copy_only=False), np.int64)
    flat, ends = _vectors(col), np.cumsum(sizes)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]


def _buckets(points: DataFrame, top: float, query: bool, h: Hashing) -> DataFrame:
    """(uid, bucket) with the table's number in the bucket's; queries get all they visit."""
    schema = "uid long, slot int, bucket long"

    def run(batches):
        for b in batches:
            for _, rows, x in _by_length(b, "embedding"):
                for at in range(0, len(rows), 512):
                    key = _keys(x[at : at + 512], top, query, h)
                    uid = b.column("uid").to_numpy()[rows[at : at + 512]]
                    slot = np.broadcast_to(np.arange(h.tables)[None, :, None], key.shape)
                    many = key.shape[1] * key.shape[2]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(uid, many)), pa.array(slot.ravel(), pa.int32()), pa.array(key.ravel())], ["uid", "slot", "bucket"])

    return points.select("uid", "embedding").mapInArrow(run, schema)


_FOUND = "quid long, uid long, score double"


def _matrices(t: pa.Table):
    """For each length of vectors: (row numbers by rising uid, vectors in double)."""
    if t.num_rows:
        t = t.append_column("row", pa.array(np.arange(t.num_rows))).sort_by("uid").combine_chunks()
        for n, rows, x in _by_length(t, "embedding"):
            yield n, t.column("row").to_numpy()[rows], x


def _pairs_of_keys(points: pa.Table, queries: pa.Table):
    """(query row, point row) of the rows that share a key, as sorted parts of two arrays: the points of each key, and
    for each query where the points of its keys begin and how many there are."""
    flat = lambda t: (np.repeat(np.arange(t.num_rows), pa.compute.list_value_length(t.column("keys")).to_numpy()), pa.compute.list_flatten(t.column("keys").combine_chunks()).to_numpy())
    row, key = flat(points)
    by = np.argsort(key, kind="stable")
    row, key = row[by], key[by]
    asks, wanted = flat(queries)
    begin = np.searchsorted(key, wanted, "left")
    count = np.searchsorted(key, wanted, "right") - begin
    first = np.searchsorted(asks, np.arange(queries.num_rows + 1))
    return row, begin, count, first


def _best(keep: int):
    """For cogroups of points and queries (uid, embedding, keys): each query's best points among those that share a key
    with it.  A point that a query meets in several buckets is scored once, and a cogroup gives ``keep`` rows a query."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if points.num_rows and queries.num_rows:
            held, begin, count, first = _pairs_of_keys(points, queries)
            uid, quid = points.column("uid").to_numpy(), queries.column("uid").to_numpy()
            asked = {n: (rows, q) for n, rows, q in _matrices(queries)}
            for n, rows, x in _matrices(points):
                place = np.full(points.num_rows, -1)
                place[rows] = np.arange(len(rows))
                ids = uid[rows]
                for k, q in zip(*asked.get(n, ((), ())), strict=True):
                    near = place[held[ragged(begin[first[k] : first[k + 1]], count[first[k] : first[k + 1]])]]
                    mark = np.zeros(len(rows), bool)
                    mark[near[near >= 0]] = True
                    near = np.flatnonzero(mark)
                    if not len(near):
                        continue
                    score = x[near] @ q
                    least = np.partition(score, -min(keep, len(near)))[-min(keep, len(near))]
                    near = near[score >= least - 1e-9 * (1 + abs(least))]
                    exact = (x[near] * q).sum(1)
                    pick = np.argsort(-exact, kind="stable")[:keep]  # ids rise, so ties go to the least
                    out.append((np.full(len(pick), quid[k]), ids[near[pick]], exact[pick]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(cols, ["quid", "uid", "score"])

    return run


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new references, so that two sides of a cogroup don't share any."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _top(found: DataFrame, keep: int) -> DataFrame:
    """The best points of each query; a point that several tables found counts once."""
    once = found.groupBy("quid", "uid").agg(F.max("score").alias("score"))
    order = W.partitionBy("quid").orderBy(F.col("score").desc(), "uid")
    return once.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")


def _in_blocks(points: DataFrame, queries: DataFrame, n: int, keep: int) -> DataFrame:
    """Queries against all points."""
    blocks = max(1, n // CELL_ROWS + 1)
    one = F.array(F.lit(0).cast("long")).alias("keys")
    all_points = points.select("uid", "embedding", one, F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    all_queries = queries.select("uid", "embedding", one, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    return _fresh(all_points).groupBy("block").cogroup(_fresh(all_queries).groupBy("block")).applyInArrow(_best(keep), _FOUND)


def _index(points: DataFrame, wanted: DataFrame, top: float, h: Hashing) -> tuple[DataFrame, DataFrame]:
    """(uid, slot, bucket, part) of the points, and of the queries for the buckets that they visit and that aren't empty."""
    at = ["slot", "bucket"]
    held = cut(_buckets(points, top, False, h))
    sizes = held.groupBy(*at).agg(F.ceil(F.count("*") / F.lit(float(BUCKET_ROWS))).cast("int").alias("parts"))
    index = held.join(sizes, at).withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    return index, _buckets(wanted, top, True, h).join(sizes, at).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _trial(h: Hashing, top: float, queries: dict[int, list], near: dict[int, list], others: list) -> tuple[float, float]:
    """Of the true neighbours the share that is found, and of other points the share that is visited."""
    found = wanted = seen = all_ = 0
    held = {}
    for v in others:
        held.setdefault(len(v), []).append(v)
    held = {size: _keys(np.array(x, np.float64), top, False, h)[:, :, 0] for size, x in held.items()}
    for uid, q in queries.items():
        visits = _keys(np.array([q], np.float64), top, True, h)[0]
        hit = lambda keys: np.any([np.isin(keys[:, t], visits[t]) for t in range(h.tables)], axis=0)  # noqa: E731, B023
        true = [v for v in near[uid] if len(v) == len(q)]
        if true:
            mine = hit(_keys(np.array(true, np.float64), top, False, h)[:, :, 0])
            found, wanted = found + int(mine.sum()), wanted + len(true)
        if len(q) in held:
            other = hit(held[len(q)])
            seen, all_ = seen + int(other.sum()), all_ + len(other)
    return found / max(wanted, 1), seen / max(all_, 1)


def _chosen(points: DataFrame, wanted: DataFrame, top: float, n: int, keep: int) -> Hashing:
    """What a bounded sample says is enough; the most thorough choice where none is."""
    by_hash = [F.xxhash64("uid"), "uid"]
    asks = cut(wanted.orderBy(*by_hash).limit(TRIAL_QUERIES))
    queries = {r["uid"]: r["embedding"] for r in asks.collect()}
    true = _top(_in_blocks(points, asks, n, keep), keep)
    near: dict[int, list] = {uid: [] for uid in queries}
    for r in true.join(points.select("uid", "embedding"), "uid").where("uid <> quid").select("quid", "embedding").collect():
        near[r["quid"]].append(r["embedding"])
    others = [r["embedding"] for r in points.select("uid", "embedding").orderBy(*by_hash).limit(TRIAL_POINTS).collect()]
    trials = [(*_trial(h, top, queries, near, others), h) for h in CHOICES]
    good = [(seen * n + VISIT * h.tables * h.probes, -found, h) for found, seen, h in trials if found >= TRIAL_RECALL]
    return min(good)[2] if good else max(trials)[2]


def candidate_share(vectors: DataFrame, queries: DataFrame, k: int = 20) -> tuple[Hashing, float]:
    """The hashing that is chosen, and the share of all points that a query scores with it."""
    points, wanted = (df.select(F.col("vec_id").alias("uid"), "embedding") for df in (vectors, queries))
    top, n = float(_norms(points).first()["top"]) * (1 + 1e-9), points.count()
    h = _chosen(points, wanted, top, n, k + 1)
    index, visits = _index(points, wanted, top, h)
    pairs = index.join(visits.withColumnRenamed("uid", "quid"), ["slot", "bucket", "part"]).groupBy("quid").agg(F.count_distinct("uid").alias("m"))
    return h, pairs.agg(F.sum("m")).first()[0] / n / wanted.count()


def _norms(points: DataFrame, *more) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return points.agg(F.max(norm).alias("top"), F.count("*").alias("n"), *more)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries`` (rows of ``vectors``) its k nearest other rows.
    Both have vec_id and embedding."""
    ship(vectors.sparkSession)

    def valid(df):
        e = F.col("embedding")
        fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & fine & F.exists(e, lambda x: x != 0))

    keep = k + 1
    by_id = W.partitionBy("embedding").orderBy("vec_id")
    rows = valid(vectors).distinct()
    first = rows.withColumn("__n", F.row_number().over(by_id)).where(F.col("__n") <= keep)  # cut before the shuffle too
    points = cut(first.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("uid", F.col("ids")[0]))
    asked = cut(valid(queries).distinct().join(points.select("embedding", "uid"), "embedding").select("vec_id", "uid"))
    wanted = points.join(asked.select("uid").distinct(), "uid", "left_semi").select("uid", "embedding")
    stats = _norms(points, F.sum(F.size("ids")).alias("ids")).first()
    if not stats["n"]:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    top, n = float(stats["top"]) * (1 + 1e-9), int(stats["n"])

    h = _chosen(points, wanted, top, n, keep)
    index, visits = _index(points, wanted, top, h)
    cells = max(16, n * h.tables // CELL_ROWS)

    def met(rows, vectors):
        """(cell, uid, embedding, keys): each vector once in each cell where it has buckets."""
        key = F.xxhash64("slot", "bucket", "part")
        d = rows.select("uid", key.alias("key"), F.pmod(key, F.lit(cells)).alias("cell")).groupBy("uid", "cell").agg(F.collect_list("key").alias("keys"))
        return _fresh(d.join(vectors, "uid").select("cell", "uid", "embedding", "keys")).groupBy("cell")

    found = met(index, points.select("uid", "embedding")).cogroup(met(visits, wanted)).applyInArrow(_best(keep), _FOUND)
    found = cut(_top(found, keep))

    # too few found: all points, in blocks
    got = found.join(points.select("uid", F.size("ids").alias("m")), "uid").groupBy("quid").agg(F.sum("m").alias("m"))
    short = wanted.join(got.withColumnRenamed("quid", "uid"), "uid", "left").where(F.coalesce("m", F.lit(0)) < min(keep, int(stats["ids"]))).select("uid", "embedding")
    found = _top(found.unionByName(_in_blocks(points, short, n, keep)), keep)

    ids = found.join(points.select("uid", "ids"), "uid").select("quid", F.explode("ids").alias("vec_id"), "score")
    order = W.partitionBy("quid").orderBy(F.col("score").desc(), "vec_id")
    ids = ids.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= keep).drop("__n")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("uid").alias("quid")).join(ids, "quid").where("query_id <> vec_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_embeddings(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """The rows whose vec_id is divisible by 20 against all."""
    return nearest(embeddings, embeddings.where(F.col("vec_id") % 20 == 0), k)
