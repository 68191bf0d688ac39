"""Approximate nearest neighbours: inverted lists with an adaptive dimension scan.

Vectors are scaled to length 1 and turned by one random rotation. A k-means on a bounded sample
(``SAMPLE`` vectors) gives the list centres; every vector is indexed in its nearest list, every query
probes its nearest lists: ``SHARE`` of them and ``EXTRA`` times the square root of their number. The share
is large because vectors without clusters (as in the test tables) need it for a recall of 0.95; clustered
vectors do with a small one. Within a list a query scans the rotated vectors in blocks of
``BLOCK`` columns: after each block, candidates whose partial distance, scaled up to all dimensions, fails
the hypothesis test against the distance of the fifth best so far are given up. What survives is scored
exactly, as the cosine of the original vectors in double precision.

Scale: queries and vectors meet by list; lists with more than ``TILE`` rows are dealt over several tiles
(by a hash of the row) and their queries visit each, so neither one vector nor one id that a third of all
rows share makes one task. A tile is streamed in batches; a query keeps its best five ids, and the tiles'
best are merged by a window over a few rows a query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, thinned

SAMPLE = 8_192
LISTS = 256
SHARE, EXTRA = 0.55, 0.75
BLOCK = 16
SURE = 2.5
TILE = 20_000
SEED = 7


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v double[]) of vectors that are not null, not zero, and hold neither null nor non-finite components, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select("vec_id", v.alias("v")).filter("vec_id is not null and v is not null").filter(good)
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).first()
    return rows.filter(F.size("v") == (length.d if length else 0))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares of huge nor of tiny components leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = SEED) -> np.ndarray:
    """k-means on unit vectors; empty lists keep their centre."""
    distinct = np.unique(sample, axis=0)
    out = distinct[np.random.default_rng(seed).permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        own = (sample @ out.T).argmax(axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, sample)
        size = np.sqrt((sums * sums).sum(axis=1))
        out[size > 0] = sums[size > 0] / size[size > 0, None]
    return out


def matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, every row by the same operations: equal vectors have equal scores."""
    size = lambda x: np.sqrt((x * x).sum(axis=-1))
    return (rows * query).sum(axis=1) / (size(rows) * size(query))


def scan(query: np.ndarray, turned: np.ndarray, bound: float) -> np.ndarray:
    """Indices of the rows that no test gives up: turned vectors against a turned query, squared distance bound."""
    alive, partial, d = np.arange(len(turned)), np.zeros(len(turned)), turned.shape[1]
    for at in range(0, d, BLOCK):
        to = min(at + BLOCK, d)
        gap = turned[alive, at:to] - query[at:to]
        partial = partial + (gap * gap).sum(axis=1)
        limit = bound if to == d else bound * to / d * (1 + SURE / np.sqrt(to)) ** 2
        stays = partial <= limit * (1 + 1e-9) + 1e-12
        alive, partial = alive[stays], partial[stays]
        if not len(alive):
            break
    return alive


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best different ids, each with its best score."""
    order = np.lexsort((ids, -scores))
    if len(set(ids[order[:k]].tolist())) < min(k, len(ids)):  # repeated rows
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
    return ids[order[:k]], scores[order[:k]]


def search_tiles(rows: DataFrame, k: int, d: int) -> DataFrame:
    """(query_id, vec_id, score) of each query's best in each tile. rows sorted by (list, tile), queries first."""
    turn = rotation(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, queries = None, []  # of one tile: [id, vector, turned vector, best ids, best scores]
        out: list[tuple[int, np.ndarray, np.ndarray]] = []

        def close() -> None:
            out.extend((q[0], q[3], q[4]) for q in queries if len(q[3]))
            queries.clear()

        def emitted() -> pa.RecordBatch:
            columns = [np.repeat([x[0] for x in out], [len(x[1]) for x in out]).astype(np.int64), np.concatenate([x[1] for x in out]), np.concatenate([x[2] for x in out])] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

        for batch in batches:
            which, tile, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "tile", "vec_id"))
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            x = matrix(batch.column("v"))
            turned = unit(x) @ turn
            cuts = [0, *(np.flatnonzero((which[1:] != which[:-1]) | (tile[1:] != tile[:-1])) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if (which[lo], tile[lo]) != key:
                    close()
                    key = (which[lo], tile[lo])
                n = lo + int(asks[lo:hi].sum())
                queries += [[int(ids[j]), x[j], turned[j], np.zeros(0, np.int64), np.zeros(0)] for j in range(lo, n)]
                for at in range(n, hi, 2048):
                    part = slice(at, min(at + 2048, hi))
                    for q in queries:
                        _update(q, ids[part], x[part], turned[part], k)
            if len(out) > 4096:
                yield emitted()
        close()
        yield emitted()

    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def _update(q: list, ids: np.ndarray, x: np.ndarray, turned: np.ndarray, k: int) -> None:
    """Take a block of candidates into a query's best k."""
    start = 0
    if len(q[3]) < k:  # the first candidates give the first bound
        start = min(len(ids), 64)
        head = np.flatnonzero(ids[:start] != q[0])
        q[3], q[4] = best_of(np.concatenate([q[3], ids[head]]), np.concatenate([q[4], cosines(q[1], x[head])]), k)
    if start < len(ids):
        bound = 2 - 2 * q[4][-1] if len(q[4]) == k else np.inf
        keep = scan(q[2], turned[start:], bound) + start
        keep = keep[ids[keep] != q[0]]
        if len(keep):
            q[3], q[4] = best_of(np.concatenate([q[3], ids[keep]]), np.concatenate([q[4], cosines(q[1], x[keep])]), k)


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, lists: int = LISTS, share: float = SHARE, extra: float = EXTRA) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest by cosine, ties to the smaller vec_id.

    vectors: vec_id, embedding. Queries are the rows whose vec_id ``every`` divides, candidates all others than
    the query's own vec_id. Vectors that are null, zero or hold null or non-finite components take no part, nor do
    null ids. A cosine needs vectors of one length: those of another than the commonest (of several the smallest) take
    no part either. Tables with fewer than 64 k vectors are searched whole, and by a query whose lists hold fewer than k ids. Rows of one vec_id, equal or not, are one
    result with the best of their scores, as queries and as candidates. Other columns are left out; empty tables give no rows.
    """
    rows = settle(usable(vectors).withColumn("rid", F.monotonically_increasing_id()))
    sample = thinned(rows, ["vec_id", "v"], SAMPLE).orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]  # SAMPLE rows at most
    if not len(sample):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    own = centres(unit(np.stack(sample.to_numpy())), max(1, min(lists, len(sample) // 32)))
    probed = min(len(own), math.ceil(share * len(own) + extra * math.sqrt(len(own)))) if len(sample) >= 64 * k else len(own)

    found = settle(_searched(rows.withColumn("asking", F.col("vec_id") % every == 0), own, probed, k))
    if probed < len(own):  # repeated ids may fill the probed lists: who found too few asks all
        others = rows.select("vec_id").distinct().limit(k + 1).count() - 1
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min(k, others)).select(F.col("query_id").alias("vec_id"))
        short = settle(rows.filter(F.col("vec_id") % every == 0).select("vec_id").distinct().join(enough, "vec_id", "left_anti"))
        if short.limit(1).count():
            asked = rows.join(short.withColumn("asking", F.lit(True)), "vec_id", "left").na.fill(False, ["asking"])
            found = found.unionByName(_searched(asked, own, len(own), k)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, own: np.ndarray, probed: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each tile, once an id. rows: vec_id, v, rid, asking; own: the centres, of which a query probes the nearest."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, rid, asking = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "rid", "asking"))
                near = unit(matrix(batch.column("v"))) @ own.T
                home = near.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(ids), pa.array(rid), pa.array(np.zeros(len(ids), bool)), batch.column("v")], ["list", "vec_id", "rid", "asks", "v"])
                ask = np.flatnonzero(asking)
                if len(ask):
                    visits = np.argsort(-near[ask], axis=1, kind="stable")[:, :probed].ravel()
                    who = np.repeat(ask, probed)
                    yield pa.RecordBatch.from_arrays([pa.array(visits.astype(np.int32)), pa.array(ids[who]), pa.array(rid[who]), pa.array(np.ones(len(who), bool)), batch.column("v").take(pa.array(who))], ["list", "vec_id", "rid", "asks", "v"])

    dealt = rows.mapInArrow(place, "list int, vec_id long, rid long, asks boolean, v array<double>")
    sizes = dealt.filter("not asks").groupBy("list").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    tiles = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array(F.pmod(F.xxhash64("vec_id", "rid"), F.col("tiles")).cast("int")))
    met = (
        dealt.join(sizes, "list").withColumn("tile", F.explode(tiles)).select("list", "tile", "vec_id", "asks", "v")
        .repartition("list", "tile").sortWithinPartitions("list", "tile", F.desc("asks"))
    )
    return search_tiles(met, k, own.shape[1]).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
