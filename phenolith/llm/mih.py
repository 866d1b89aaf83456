"""Nearest neighbours by cosine with multi-index hashing.

Codes: vectors, centred and turned by ``ROTATIONS`` learned rotations (principal
axes, then alternation between signs and rotation), give one bit a dimension
and rotation.  A code is cut into 16-bit substrings, each with its own table.
If two codes differ in at most r of their bits, some substring differs in at
most r // m, so probing every table that far finds every code within r; codes
farther than r are dropped and the rest are ranked by their float vectors in
double precision.  The radius comes from the sample: it holds ``SURE`` of its
true neighbours, which lie farther off than those in all rows.  A query that
finds fewer than k within r widens r until it has them.

Vectors without structure need a radius of some 40 % of the bits, since their neighbours are hardly nearer than others;
then probing looks at most buckets and the tables prune little (figures in the README).  What is found stays right.

Learning takes at most ``SAMPLE`` vectors; every vector is indexed.  Queries
and rows meet in cells of at most about ``ROWS`` rows and ``QUERIES`` queries, each
cell keeps k a query.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or whose length isn't the commonest, take no part; rows without an
id neither; of repeated ids each row is a candidate of its own but a query
takes no row with its own id, and repeated query rows count once; ties go to
the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, ROTATIONS, ROWS, QUERIES, SURE, BITS = 4096, 4, 16384, 4096, 0.97, 16


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int32)


class Codes:
    """Rotations learned from a sample, the codes they give and the radius to search."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 7):
        rng, unit = np.random.default_rng(seed), _unit(sample)
        d = unit.shape[1]
        self.mean = unit.mean(0)
        z = unit - self.mean
        axes = np.linalg.eigh(z.T @ z)[1]
        self.turn = []
        for _ in range(ROTATIONS):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(12):
                u, _, vt = np.linalg.svd(np.where(z @ axes @ r > 0, 1.0, -1.0).T @ (z @ axes))
                r = (u @ vt).T
            self.turn.append(axes @ r)
        self.turn = np.concatenate(self.turn, 1)
        codes = self(sample)
        self.m = codes.shape[1]
        q = rng.permutation(len(unit))[:256]
        near = unit[q] @ unit.T
        near[np.arange(len(q)), q] = -2
        best = np.argsort(-near, 1)[:, : min(k, max(1, len(unit) - 1))]
        self.radius = int(np.quantile(np.take_along_axis(_distances(codes[q], codes), best, 1), SURE))

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        bits = (_unit(vectors) - self.mean) @ self.turn > 0
        bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % BITS)))
        return np.packbits(bits, axis=1).view(np.uint16)


def _tame(x: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _tame(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _masks(rho: int) -> np.ndarray:
    every = np.arange(1 << BITS, dtype=np.uint16)
    return every[np.bitwise_count(every) <= rho]


class Tables:
    """One table for each substring: rows sorted by its value."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.table = codes, []
        for t in range(codes.shape[1]):
            order = np.argsort(codes[:, t], kind="stable")
            value, start = np.unique(codes[order, t], return_index=True)
            self.table.append((order, value, np.append(start, len(order))))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row whose code differs in at most ``radius`` bits."""
        m, rho = len(code), radius // len(code)
        hit = np.zeros(len(self.codes), bool)
        for t, (order, value, start) in enumerate(self.table):
            if sum(comb(BITS, i) for i in range(min(rho, BITS) + 1)) < len(value):
                probe = _masks(rho) ^ code[t]
                at = np.searchsorted(value, probe)
                at = at[(at < len(value)) & (value[np.minimum(at, len(value) - 1)] == probe)]
            else:  # fewer buckets than probes: look at the buckets
                at = np.flatnonzero(np.bitwise_count(value ^ code[t]) <= rho)
            count = start[at + 1] - start[at]
            begin = np.repeat(start[at] - np.cumsum(count) + count, count)
            hit[order[begin + np.arange(count.sum())]] = True
        some = np.flatnonzero(hit)
        return some[np.bitwise_count(self.codes[some] ^ code).sum(1, dtype=np.int32) <= radius]


def search_cell(model: Codes, k: int, ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, row ids, cosines) of the k nearest found among the rows."""
    x, q = _tame(x), _tame(q)
    tables, codes = Tables(model(x)), model(q)
    norm = np.sqrt((x * x).sum(1))
    for i, v, code in zip(qids.tolist(), q, codes, strict=True):
        radius, others = model.radius, int(np.count_nonzero(ids != i))
        while True:
            at = tables.within(code, radius)
            at = at[ids[at] != i]
            if len(at) >= min(k, others):
                break
            radius += max(1, model.m // 2)
        score = (x[at] * v).sum(1) / (norm[at] * np.sqrt((v * v).sum()))
        best = np.lexsort((ids[at], -score))[:k]
        yield i, ids[at][best], score[best]


def nearest(df: DataFrame, queries: Column, *, k: int = 5, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows of each row that ``queries`` holds for."""
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    plain = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = df.filter(F.col(id).isNotNull() & v.isNotNull() & plain).select(F.col(id).cast("long").alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("long")).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d, n, n_queries = sizes[0]
    rows = rows.filter(F.size("v") == d)
    sample = rows.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    shared = spark.sparkContext.broadcast(Codes(np.array([r.v for r in sample]), k))
    cells, blocks = max(1, -(-n // ROWS)), max(1, -(-n_queries // QUERIES))
    cell = lambda salt, of: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    index = rows.select(F.lit(0).alias("role"), "id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(cells)).cast("int").alias("a"), every(blocks).alias("b"))
    asked = rows.filter("is_query").dropDuplicates(["id"]).select(F.lit(1).alias("role"), "id", "v", cell(1, blocks).alias("b"), every(cells).alias("a"))
    both = index.unionByName(asked).select("a", "b", "role", "id", "v").repartition(max(1, min(cells * blocks, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4)), "a", "b").sortWithinPartitions("a", "b", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def close() -> Iterator[pa.RecordBatch]:
            role, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            x = np.concatenate([p[2] for p in parts])
            if role.min() == 0 and role.max() == 1:
                found = list(search_cell(shared.value, k, ids[role == 0], x[role == 0], ids[role == 1], x[role == 1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[2] for f in found]).astype(float))], names=["query_id", "vec_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, role, ids = (batch.column(i).to_numpy() for i in range(4))
            x = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(a), -1)
            cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(a)], strict=True):
                if parts and key != (a[lo], b[lo]):
                    yield from close()
                    parts = []
                key = (a[lo], b[lo])
                parts.append((role[lo:hi], ids[lo:hi], x[lo:hi]))
        if parts:
            yield from close()

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
