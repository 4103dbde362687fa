"""Nearest neighbours by largest inner product: multiprobe p-stable hashing.

Inner products become distances: with M the largest norm, a vector x gets one component
more, sqrt(M^2 - |x|^2), and a query gets 0; then nearer means larger inner product. A table
has n_hashes functions floor((a x + b) / w), a Gaussian, b uniform. Distances along a
Gaussian direction are normal, so the chance that a neighbour at distance r lies in a
perturbed bucket (each function one step down, equal, or up) is a product of normal
probabilities. A query visits buckets in the order of that chance, until their sum over
the tables reaches the wanted recall. r is the distance of the k-th neighbour, as
measured for `SAMPLE` queries against all vectors (the largest of theirs).

Every vector is indexed in every table. Buckets are cut into chunks of `CHUNK` vectors, so a
bucket that a third of all vectors fall into is spread, and queries into blocks of about
`QUERY_BLOCK`, so a task holds one chunk and one block whatever the number of visitors. A chunk
meets the queries of a block that visit it in one matrix product and returns each query's best, k at
most; those of all chunks, blocks and tables are merged by the exact score. Only vectors within REACH times r count here. Queries
that found fewer than k, though there are more vectors, are run against all chunks of one
table without that bar, which is exact.

Vectors that are null, zero, of another than the commonest dimension, or hold null or
non-finite components take no part, nor do rows without vec_id. Rows with an equal vec_id
count once (the least vector in byte order). Ties go to the smaller vec_id. Other columns
are not used. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from waygrid.llm.common import saved

SAMPLE, CHUNK, QUERY_BLOCK, TABLES, SEED = 64, 1024, 4096, 2, 5
#: Chance that a table finds the k-th neighbour; with two tables 0.93 of them are found.
RECALL = 0.93
#: How far beyond r a vector may be to count as found.
REACH = 1.05


def _matrix(column) -> np.ndarray:
    found = column.to_pylist()
    return np.frombuffer(b"".join(found), "<f8").reshape(len(found), -1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, v (components as little-endian doubles) of vectors that take part."""

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v").to_pylist()):
                if i is None or not v or any(c is None for c in v):
                    continue
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    found = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")
    return found.groupBy("vec_id").agg(F.min("v").alias("v"))


class Index:
    """The hash functions; small (TABLES x n_hashes x dimension numbers), sent with each task."""

    def __init__(self, dim: int, n_hashes: int, width: float, radius: float, norm: float):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.width, self.radius, self.norm, self.n_hashes = width, radius, norm, n_hashes
        self.a = rng.standard_normal((TABLES, dim + 1, n_hashes))
        self.b = rng.random((TABLES, n_hashes)) * width
        self.steps = np.array(list(itertools.product((-1, 0, 1), repeat=n_hashes)))

    def place(self, x: np.ndarray, table: int, query: bool) -> np.ndarray:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.norm**2 - (x * x).sum(1)))
        return (np.column_stack([x, last]) @ self.a[table] + self.b[table]) / self.width

    def key(self, cells: np.ndarray) -> np.ndarray:
        """A 64-bit key of a bucket; another bucket with the same key only adds candidates."""
        out = np.full(cells.shape[:-1], 1469598103934665603, np.uint64)
        for j in range(self.n_hashes):
            out = (out ^ cells[..., j].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out.view(np.int64)

    def probes(self, x: np.ndarray, table: int) -> list[np.ndarray]:
        """Keys of the buckets that each query visits, most likely first."""
        at = self.place(x, table, True)
        cell = np.floor(at)
        edge = (at - cell) * self.width / max(self.radius, 1e-12) / math.sqrt(2)
        side = self.width / max(self.radius, 1e-12) / math.sqrt(2)
        cdf = np.vectorize(math.erf, otypes=[float])
        marks = [cdf(-edge - side), cdf(-edge), cdf(side - edge), cdf(2 * side - edge)]
        chance = np.stack([(marks[j + 1] - marks[j]) / 2 for j in range(3)])  # step, query, function
        wanted = 1 - (1 - RECALL) ** (1 / TABLES)
        out = []
        for q in range(len(x)):
            p = np.ones(len(self.steps))
            for j in range(self.n_hashes):
                p *= chance[self.steps[:, j] + 1, q, j]
            order = np.argsort(-p, kind="stable")
            n = int(np.searchsorted(np.cumsum(p[order]), wanted)) + 1
            out.append(self.key(cell[q] + self.steps[order[:n]]))
        return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores; equal to 12 digits counts as equal here, smaller ids first."""
    near = np.argpartition(-scores, k)[: k + 1] if len(scores) > k + 1 else np.arange(len(scores))
    bar = scores[near].min() - 1e-9 if len(near) else 0
    some = np.flatnonzero(scores >= bar)
    return some[np.lexsort((ids[some], -np.round(scores[some], 12)))][:k]


def _meet(k: int):
    """Queries of a chunk against its vectors by one matrix product: what reaches the query's bar,
    the k best at most."""
    schema = "query_id long, vec_id long, score double"

    def run(vectors, queries):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        ids, qids, bar = np.array(vectors["vec_id"]), np.array(queries["query_id"]), np.array(queries["bar"])
        x, q = (_matrix(t["v"]) if t.num_rows else np.zeros((0, 1)) for t in (vectors, queries))
        for a in range(0, len(q) if len(x) else 0, 512):
            scores = q[a : a + 512] @ x.T
            scores[qids[a : a + 512, None] == ids[None, :]] = -np.inf
            at, place = np.nonzero((scores >= bar[a : a + 512, None]) & (scores > -np.inf))
            for i in np.flatnonzero(np.bincount(at, minlength=1) > k):
                rows = np.flatnonzero(at == i)
                drop = np.delete(rows, _best(ids[place[rows]], scores[i, place[rows]], k))
                at, place = np.delete(at, drop), np.delete(place, drop)
            out.append((qids[a + at], ids[place], np.einsum("ij,ij->i", q[a + at], x[place])))
        cols = [np.concatenate(c) for c in zip(*out)]
        return pa.Table.from_pydict({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    return run, schema


def _radius(vecs: DataFrame, sample: list, norm: float, k: int) -> float:
    """Largest distance of a k-th neighbour among the sampled queries, over all vectors."""
    ids = np.array([r.vec_id for r in sample])
    q = np.stack([np.frombuffer(r.v, "<f8") for r in sample])

    def run(batches):
        best = np.full((len(ids), 0), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            s = q @ _matrix(b.column("v")).T
            s[ids[:, None] == np.array(b.column("vec_id"))[None, :]] = -np.inf
            best = -np.sort(-np.concatenate([best, s], axis=1), axis=1)[:, :k]
        rows = [(i, float(x)) for i, line in enumerate(best) for x in line if x > -np.inf]
        yield pa.RecordBatch.from_pydict({"q": pa.array([r[0] for r in rows], pa.int32()), "score": pa.array([r[1] for r in rows], pa.float64())})

    top = vecs.mapInArrow(run, "q int, score double").withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))).where(F.col("rank") <= k)
    far = {r.q: r.score for r in top.groupBy("q").agg(F.min("score").alias("score")).collect()}  # SAMPLE rows
    return max((math.sqrt(max(0.0, norm**2 + float(q[i] @ q[i]) - 2 * s)) for i, s in far.items()), default=norm)


def nearest(vectors: DataFrame, is_query, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query. is_query is a Column over vec_id."""
    vecs = saved(usable(vectors, id_column, vector_column), "ann-vectors")
    by_dim = vecs.groupBy(F.length("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if by_dim is None:
        return vecs.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    vecs = vecs.where(F.length("v") == by_dim["size"])
    n, dim = by_dim["count"], by_dim["size"] // 8

    def norms(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((_matrix(b.column("v")) ** 2).sum(1)).max())])], ["norm"])

    norm = vecs.mapInArrow(norms, "norm double").agg(F.max("norm")).first()[0]
    sample = vecs.where(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not sample:
        return vecs.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    radius = _radius(vecs, sample, norm, k) or 1e-6
    index = Index(dim, max(3, min(8, int(math.log10(n)))), 1.5 * radius, radius, norm)

    def hashed(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column("v"))
                for t in range(TABLES):
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(x), pa.int32()), pa.array(index.key(np.floor(index.place(x, t, False)))), b.column("vec_id"), b.column("v")], ["tab", "bucket", "vec_id", "v"])

    def probed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("v"))
            for t in range(TABLES):
                for i in range(0, len(x), 256):
                    keys = index.probes(x[i : i + 256], t)
                    at = np.repeat(np.arange(i, i + len(keys)), [*map(len, keys)])
                    pick = pa.array(at)
                    bar = (norm**2 + (x[at] ** 2).sum(1) - (REACH * radius) ** 2) / 2
                    yield pa.RecordBatch.from_arrays([pa.array([t] * len(at), pa.int32()), pa.array(np.concatenate(keys)), b.column("vec_id").take(pick), pa.array(bar)], ["tab", "bucket", "query_id", "bar"])

    rows = vecs.mapInArrow(hashed, "tab int, bucket long, vec_id long, v binary")
    sizes = saved(rows.groupBy("tab", "bucket").agg(F.count("*").alias("n")).select("tab", "bucket", F.ceil(F.col("n") / CHUNK).cast("long").alias("chunks")), "ann-buckets")
    chunked = rows.join(sizes, ["tab", "bucket"]).select("tab", "bucket", F.pmod(F.xxhash64("vec_id"), "chunks").alias("chunk"), "vec_id", "v")
    where = vecs.where(is_query)
    n_blocks = -(-where.count() // QUERY_BLOCK)
    visits = where.mapInArrow(probed, "tab int, bucket long, query_id long, bar double").dropDuplicates(["tab", "bucket", "query_id"])
    visits = saved(visits.join(sizes, ["tab", "bucket"]), "ann-visits")
    keys = ["tab", "bucket", "chunk", "block"]

    def merged(found: DataFrame) -> DataFrame:
        best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def searched(data: DataFrame, asked: DataFrame) -> DataFrame:
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)))
        left = data.join(asked.select("tab", "bucket", F.col("block").alias("part")).distinct(), ["tab", "bucket"])
        right = asked.join(where.select(F.col("vec_id").alias("query_id"), "v"), "query_id").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        return merged(left.groupBy("tab", "bucket", "chunk", "part").cogroup(right.select(*keys, "query_id", "v", "bar").groupBy(*keys)).applyInArrow(*_meet(k)))

    found = saved(searched(chunked, visits), "ann-found")
    full = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = where.join(full, "vec_id", "left_anti")
    if n > 1 and not short.isEmpty():
        done = short.select(F.col("vec_id").alias("query_id"))
        # each short query visits all buckets of one table: a stated query set against all rows
        asked = done.withColumn("bar", F.lit(float("-inf"))).withColumn("tab", F.lit(0)).join(sizes.where("tab = 0"), "tab")
        found = found.join(done, "query_id", "left_anti").unionByName(searched(chunked.where("tab = 0"), asked))
    return found
