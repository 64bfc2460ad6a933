"""A Merkle manifest of a table: leaves, roots by source, the root, and each row's proof.

Leaves are hashed by Spark, next to the texts.  A leaf's place in its source is a running sum: rows are dealt by ranges
of (source, id), counted in each range, and added to the sums of the ranges before; so no source, however large, meets
in a task.  Equal rows go as one with their number until they have their places.

A source's places are cut into aligned blocks of FANOUT ** LEVELS.  A block is one row: its leaves' digests, 64 bytes
each, side by side.  As a numpy matrix it is reshaped by the fanout and hashed row by row, level by level; its root is a
node of the next tier, whose blocks are formed alike, until each source has one node.  These are the leaves of the last
tree.  On the way back down each block hands its members what stands above it: the runs they are in and their places,
which are quotients of their index.  A proof is these runs without the member; the root is found again by putting a
digest into its place in each.

Null id: before all others, '-' in the leaf, and as the empty text for crc32.  Equal ids: by leaf.  A null source is a
source of its own, before all others.  Null text: not tampered with.  Repeated rows are leaves of their own.  Columns
other than the five are not looked at.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veridicta.llm.common import byte_column, crc_of_id, cut

FANOUT = 16
LEVELS = 2  # of a block, so that a thousand of them make a batch of some 30 MB
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER = 5  # one of so many
_HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(text: str | Column = "text") -> Column:
    """The digest of a row's five values, each with its number of bytes."""
    parts = []
    for c in COLUMNS:
        v = (F.col(text) if isinstance(text, str) else text) if c == "text" else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(documents: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, tampered): ``key`` orders as the source does, null first; ``tampered`` only where a row is."""
    d = documents.select(*COLUMNS)
    touched = F.when(crc_of_id() % TAMPER == 0, leaf(F.translate("text", _UPPER, _LOWER)))
    return d.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"), "doc_id", leaf().alias("leaf"), touched.alias("tampered"))


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) and ``size``, the place within the key and its number of rows.  Ranges, not keys,
    are what tasks get."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = rows.columns
    once = rows.groupBy(*names).agg(F.count("*").alias("__n"))
    ranged = cut(once.repartitionByRange(n, key, *order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy(F.col(key).alias("__k"), F.col("__range").alias("__r")).agg(F.sum("__n").alias("__sum"))
    before = W.partitionBy("__k").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("*", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"), F.sum("__sum").over(W.partitionBy("__k")).alias("size"))
    here = W.partitionBy(key, "__range").orderBy(key, *order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("__at", F.coalesce(F.sum("__n").over(here), F.lit(0)))
    local = local.join(sums, (local[key] == sums["__k"]) & (local["__range"] == sums["__r"]))
    start = F.col("__before") + F.col("__at")
    return local.withColumn("place", F.explode(F.sequence(start, start + F.col("__n") - 1))).select(*names, "place", "size")


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def climb(nodes: np.ndarray, size: int, fanout: int = FANOUT, levels: int = LEVELS) -> list[np.ndarray]:
    """The levels of a block, from its nodes (n x 64) to its one root: as many as it has, or until one node is left if
    the block is all there is of ``size`` nodes."""
    out = [nodes]
    alone = size <= fanout**levels
    while (len(out[-1]) > 1) if alone else (len(out) <= levels):
        below = out[-1]
        full = len(below) // fanout
        rows = np.ascontiguousarray(below[: full * fanout]).reshape(full, fanout * _HEX)
        up = [sha(r) for r in rows]
        if full * fanout < len(below):
            up.append(sha(below[full * fanout :].tobytes()))
        out.append(np.frombuffer(b"".join(up), np.uint8).reshape(-1, _HEX))
    return out


def runs_of(levels: list[np.ndarray], i: int, fanout: int = FANOUT) -> list[tuple[int, bytes]]:
    """For each level below the root, the place of member i's node in its run and the run's digests."""
    out = []
    for nodes in levels[:-1]:
        first = i // fanout * fanout
        out.append((i - first, nodes[first : first + fanout].tobytes()))
        i //= fanout
    return out


def fold(digest: bytes, path: list[tuple[int, bytes]]) -> bytes:
    for at, run in path:
        digest = sha(run[: at * _HEX] + digest + run[(at + 1) * _HEX :])
    return digest


def siblings(path: list[tuple[int, bytes]]) -> bytes:
    return b"".join(run[: at * _HEX] + run[(at + 1) * _HEX :] for at, run in path)


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))


def _matrix(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, np.uint8).reshape(-1, _HEX)


def blocks(nodes: DataFrame, digest: str, fanout: int, levels: int) -> DataFrame:
    """Rows (key, place, size, digest, ...) to one a block: (key, block, size, digests, the other columns as arrays, root)."""
    span = fanout**levels
    others = [c for c in nodes.columns if c not in ("key", "place", "size", digest)]
    member = F.sort_array(F.collect_list(F.struct("place", digest, *others)))
    b = nodes.groupBy("key", F.floor(F.col("place") / span).alias("block"), "size").agg(member.alias("m"))
    b = b.select("key", "block", "size", F.array_join(f"m.{digest}", "").cast("binary").alias("digests"), *(F.col(f"m.{c}").alias(c) for c in others))

    def hashed(batches):
        for batch in batches:
            size, digests = batch.column("size").to_pylist(), byte_column(batch.column("digests"))
            roots = [climb(_matrix(d), n, fanout, levels)[-1].tobytes().decode() for n, d in zip(size, digests, strict=True)]
            yield batch.append_column("root", pa.array(roots, pa.string()))

    return cut(b.mapInArrow(hashed, ", ".join(f"{c} {t}" for c, t in [*b.dtypes, ("root", "string")])))


_PATH = {"key": pa.string(), "place": pa.int64(), "at": pa.list_(pa.int32()), "runs": pa.list_(pa.binary()), "top": pa.string(), "subroot": pa.string()}


def tree(nodes: DataFrame, digest: str, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """The blocks of each tier, from the leaves up; the last has a block a key.  ``most``: nodes of the largest key."""
    span, out = fanout**levels, []
    while True:
        out.append(blocks(nodes, digest, fanout, levels))
        most = -(-most // span)
        if most <= 1:
            return out
        digest = "root"
        nodes = out[-1].select("key", F.col("block").alias("place"), F.ceil(F.col("size") / span).alias("size"), "root")


def _with_path(tier: DataFrame, paths: DataFrame) -> DataFrame:
    p = paths.withColumnsRenamed({"key": "__key", "place": "__place"})
    return tier.join(p, (tier["key"] == p["__key"]) & (tier["block"] == p["__place"])).drop("__key", "__place")


def _member_paths(tier: DataFrame, paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """From what stands above each block of a tier to what stands above each of its members."""
    span = fanout**levels

    def members(batches):
        for batch in batches:
            for row in batch.to_pylist():
                up, rows = climb(_matrix(row["digests"]), row["size"], fanout, levels), []
                for i in range(len(up[0])):
                    path = runs_of(up, i, fanout)
                    rows.append((row["key"], row["block"] * span + i, [at for at, _ in path] + row["at"], [run for _, run in path] + row["runs"], row["top"], row["subroot"]))
                yield _batch(rows, _PATH)

    return _with_path(tier, paths).mapInArrow(members, "key string, place long, at array<int>, runs array<binary>, top string, subroot string")


def _down(tiers: list[DataFrame], paths: DataFrame, fanout: int, levels: int) -> DataFrame:
    """What stands above the blocks of the first tier."""
    for tier in reversed(tiers[1:]):
        paths = _member_paths(tier, paths, fanout, levels)
    return paths


_RESULT = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}


def manifest(documents: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """A row a row of ``documents``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    rows = placed(leaves(documents), "key", ["doc_id", "leaf"])
    first = blocks(rows, "leaf", fanout, levels)
    most = first.agg(F.max("size")).first()[0] or 0
    span = fanout**levels
    tiers = [first]
    if most > span:
        up = first.select("key", F.col("block").alias("place"), F.ceil(F.col("size") / span).alias("size"), "root")
        tiers += tree(up, "root", -(-most // span), fanout, levels)
    subroots = tiers[-1].select(F.lit("").alias("key"), F.col("key").alias("of"), "root")
    over = placed(subroots, "key", ["of"])
    sources = tree(over, "root", tiers[-1].count(), fanout, levels)

    # what stands above the last tree: nothing, and its root
    top = sources[-1].select("key", F.col("block").alias("place"), F.array().cast("array<int>").alias("at"), F.array().cast("array<binary>").alias("runs"), F.col("root").alias("top"), F.lit("").alias("subroot"))
    leaf_paths = _member_paths(sources[0], _down(sources, top, fanout, levels), fanout, levels).withColumnsRenamed({"key": "__none", "place": "__at", "subroot": "__sub"})
    paths = over.join(leaf_paths, over["place"] == leaf_paths["__at"]).select(F.col("of").alias("key"), F.lit(0).cast("long").alias("place"), "at", "runs", "top", F.col("root").alias("subroot"))
    above = _with_path(first, _down(tiers, paths, fanout, levels))

    def proofs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                up, out = climb(_matrix(row["digests"]), row["size"], fanout, levels), []
                rest, root = list(zip(row["at"], row["runs"], strict=True)), row["top"]
                for i, (doc_id, tampered) in enumerate(zip(row["doc_id"], row["tampered"], strict=True)):
                    own = up[0][i].tobytes()
                    path = runs_of(up, i, fanout) + rest
                    folded = fold(tampered.encode() if tampered else own, path).decode()
                    out.append((doc_id, own.decode(), row["subroot"], root, sha(siblings(path)).decode(), folded, folded == root))
                yield _batch(out, _RESULT)

    return above.mapInArrow(proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _oracle(levels: int = 6) -> str:
    """Both trees, ``levels`` deep at most."""
    fields = " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{t}"))
    crc = (
        "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), "
        "lambda c: CASE WHEN c = '' THEN [] ELSE [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] END))), "
        "lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
    )
    ctes = [
        f"d AS (SELECT row_number() OVER () AS id, doc_id, source, sha256({fields.format(t='text')}) AS leaf, CASE WHEN {crc} % {TAMPER} = 0 THEN sha256({fields.format(t=f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS fake FROM documents)",
        "p0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, '' AS proof, coalesce(fake, leaf) AS folded FROM d)",
        "a0 AS (SELECT source, i, n, leaf AS h FROM p0)",
    ]

    def level(t: str, k: int, by: str) -> None:
        """From nodes {t}{k} (by, i, n, h) up one level; n of 1 stays."""
        ctes.append(f"r{t}{k} AS (SELECT {by}, i // {FANOUT} AS g, n, list(h ORDER BY i) AS hs FROM {t}{k} GROUP BY ALL)")
        ctes.append(
            f"q{t}{k} AS (SELECT p.*, CASE WHEN x.n = 1 THEN '' ELSE array_to_string(list_concat(hs[1:p.i % {FANOUT}], hs[p.i % {FANOUT} + 2:]), '') END AS sib,"
            f" CASE WHEN x.n = 1 THEN p.folded ELSE sha256(array_to_string(list_concat(hs[1:p.i % {FANOUT}], [p.folded], hs[p.i % {FANOUT} + 2:]), '')) END AS up"
            f" FROM p{t}{k} p JOIN r{t}{k} x ON x.{by} IS NOT DISTINCT FROM p.{by} AND x.g = p.i // {FANOUT})"
        )
        ctes.append(f"p{t}{k + 1} AS (SELECT * EXCLUDE (i, proof, folded, sib, up), i // {FANOUT} AS i, proof || sib AS proof, up AS folded FROM q{t}{k})")
        ctes.append(
            f"{t}{k + 1} AS (SELECT {by}, g AS i, CAST(ceil(n / CAST({FANOUT} AS DOUBLE)) AS BIGINT) AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM r{t}{k})"
        )

    ctes.append("pa0 AS (SELECT * FROM p0)")
    for k in range(levels):
        level("a", k, "source")
    ctes.append(f"b0 AS (SELECT 0 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM a{levels})")
    ctes.append(f"pb0 AS (SELECT p.* EXCLUDE (i, n), 0 AS one, b.i, b.n, b.h AS subroot FROM pa{levels} p JOIN b0 b ON b.source IS NOT DISTINCT FROM p.source)")
    for k in range(levels):
        level("b", k, "one")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified FROM pb{levels} JOIN b{levels} USING (one)"


ORACLE_SQL = _oracle()
