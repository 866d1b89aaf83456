"""Cross products and correlations of many columns, in one pass over distributed rows.

Partial matrices are made per task with numpy over Arrow batches; a task returns
one row of a few d x d matrices, summed a block of rows of the matrix at a time on the
executors, so that the driver receives each matrix once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.functions.exprs import number
from phenolith.functions.ranks import average_ranks, codes, rank_bounds, value_counts_of

#: Matrices of more columns than this aren't collected.
WIDEST = 8192


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns of an Arrow batch as a double matrix; nulls are NaN."""
    out = np.empty((batch.num_rows, len(columns)))
    for j, c in enumerate(columns):
        out[:, j] = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)
    return out


def _summed(df: DataFrame, columns: list[str], parts, count: int, matrices=None) -> list[np.ndarray]:
    """Sum over tasks of ``count`` matrices (d x d) that ``parts`` makes of the task's rows, or of those that ``matrices`` makes of its batches."""
    d = len(columns)
    if d > WIDEST:
        raise ValueError(f"{d} columns; at most {WIDEST} are correlated")
    chosen = df if matrices else df.select(*[number(c).alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in matrices(batches) if matrices else (matrix(b, columns) for b in batches):
            for lo in range(0, len(x), 4096):
                p = parts(x[lo : lo + 4096])
                total = p if total is None else [a + b for a, b in zip(total, p, strict=True)]
        if total is not None:
            rows = np.concatenate([t.reshape(-1, d) for t in total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([r.tobytes() for r in rows], pa.binary())], names=["r", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(d)
        done: list[tuple[int, bytes]] = []
        for b in batches:
            for r, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if r != at:
                    if at is not None:
                        done.append((at, total.tobytes()))
                    at, total = r, np.zeros(d)
                total += np.frombuffer(v)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done]), pa.array([x[1] for x in done], pa.binary())], names=["r", "v"])
                done = []
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total.tobytes()], pa.binary())], names=["r", "v"])

    out = np.zeros((count * d, d))
    for r in chosen.mapInArrow(run, "r long, v binary").repartition("r").sortWithinPartitions("r").mapInArrow(add, "r long, v binary").toLocalIterator():
        out[r.r] = np.frombuffer(r.v)
    return [out[i * d : (i + 1) * d] for i in range(count)]


def triangle(df: DataFrame, columns: list[str], center: np.ndarray | None = None, scale: np.ndarray | None = None) -> np.ndarray:
    """R of the QR decomposition of the (centred, scaled) columns: it has the matrix's singular
    values and right singular vectors.

    Each task decomposes its rows block by block and gives the rows of its R; about the square
    root of that many tasks stack them and decompose them again, and the driver the rest.
    """
    d = len(columns)
    if d > WIDEST:
        raise ValueError(f"{d} columns; at most {WIDEST} are decomposed")
    shift, by = (np.zeros(d) if center is None else center), (np.ones(d) if scale is None else scale)
    chosen = df.select(*[number(c).alias(c) for c in columns])
    block = max(4096, 2 * d)

    def folded(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for x in parts:
            for lo in range(0, len(x), block):
                r = np.linalg.qr(np.concatenate([r, x[lo : lo + block]]), mode="r")
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in r], pa.binary())], names=["v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded((matrix(b, columns) - shift) / by for b in batches)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from folded(np.frombuffer(b"".join(b.column(0).to_pylist())).reshape(-1, d) for b in batches if b.num_rows)

    made = chosen.mapInArrow(first, "v binary")
    fewer = made.repartition(max(1, int(df.sparkSession.sparkContext.defaultParallelism**0.5))).mapInArrow(again, "v binary")
    r = np.zeros((0, d))
    for row in fewer.toLocalIterator():
        r = np.concatenate([r, np.frombuffer(row.v)[None]])
        if len(r) >= 2 * d:
            r = np.linalg.qr(r, mode="r")
    return np.linalg.qr(r, mode="r") if len(r) else r


#: Columns up to which statistics are one SQL aggregation; a plan of thousands of aggregates takes longer than the data.
NARROW = 64


@dataclass
class Stats:
    """Statistics of columns, a number each; missing values are left out of all but ``rows``."""

    rows: int
    count: np.ndarray
    mean: np.ndarray
    squares: np.ndarray  # sums of squared distances from the mean
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Stats:
        have = ~np.isnan(x)
        count = have.sum(0).astype(float)
        mean = np.where(have, x, 0.0).sum(0) / np.maximum(count, 1)
        away = np.where(have, x - mean, 0.0)
        return Stats(len(x), count, mean, (away * away).sum(0), np.where(have, x, np.inf).min(0, initial=np.inf), np.where(have, x, -np.inf).max(0, initial=-np.inf))

    def add(self, other: Stats) -> Stats:
        count = self.count + other.count
        share, delta = other.count / np.maximum(count, 1), other.mean - self.mean
        return Stats(self.rows + other.rows, count, self.mean + delta * share, self.squares + other.squares + delta * delta * self.count * share, np.minimum(self.low, other.low), np.maximum(self.high, other.high))

    def packed(self) -> bytes:
        return np.concatenate([np.full(1, float(self.rows)), self.count, self.mean, self.squares, self.low, self.high]).tobytes()

    @staticmethod
    def unpacked(raw: bytes) -> Stats:
        x = np.frombuffer(raw)
        return Stats(int(x[0]), *x[1:].reshape(5, -1))


def column_stats(df: DataFrame, columns: list[str]) -> Stats:
    """Statistics of any number of columns in one pass: a row of partial results a task, folded by
    about the square root of that many tasks and then on the driver."""
    chosen, names = df.select(*[number(c).alias(f"_{j}") for j, c in enumerate(columns)]), [f"_{j}" for j in range(len(columns))]

    def folded(parts: Iterator[Stats]) -> Iterator[pa.RecordBatch]:
        total = None
        for p in parts:
            total = p if total is None else total.add(p)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.packed()], pa.binary())], names=["v"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(invalid="ignore"):
            yield from folded(Stats.of(matrix(b.slice(lo, 4096), names)) for b in batches for lo in range(0, b.num_rows, 4096))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(invalid="ignore"):
            yield from folded(Stats.unpacked(v) for b in batches for v in b.column(0).to_pylist())

    made = chosen.mapInArrow(first, "v binary").repartition(max(1, int(df.sparkSession.sparkContext.defaultParallelism**0.5))).mapInArrow(again, "v binary")
    total = Stats.of(np.zeros((0, len(columns))))
    for r in made.collect():
        total = total.add(Stats.unpacked(bytes(r.v)))
    return total


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, means, population standard deviations), in one pass."""
    if len(columns) > NARROW:
        s = column_stats(df, columns)
        none = s.count == 0
        return s.rows, np.where(none, np.nan, s.mean), np.where(none, np.nan, np.sqrt(s.squares / np.maximum(s.count, 1)))
    row = df.agg(F.count("*"), *[f(number(c)) for c in columns for f in (F.avg, F.stddev_pop)]).first()
    nan = lambda v: np.nan if v is None else v
    return row[0], np.array([nan(v) for v in row[1::2]]), np.array([nan(v) for v in row[2::2]])


def pearson(df: DataFrame, columns: list[str], ranks: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """Correlations over the rows where both columns are present; constant columns give NaN.
    With ``ranks`` (sorted codes of each column's values, and what stands for each), of those."""
    if ranks is None:
        return _correlated(df, columns, np.nan_to_num(moments(df, columns)[1]))
    mean = np.array([(r[0] + r[-1]) / 2 if len(r) else 0.0 for _, r in ranks])
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def ranked(x: np.ndarray) -> np.ndarray:
        known = ~np.isnan(x)
        for j, (code, rank) in enumerate(shared.value):
            x[known[:, j], j] = rank[np.searchsorted(code, codes(x[known[:, j], j]))]
        return x

    return _correlated(df, columns, mean, ranked)


def _correlated(df: DataFrame, columns: list[str], mean: np.ndarray, change=lambda x: x, matrices=None) -> np.ndarray:
    """Correlations of the rows, or what ``change`` makes of them, with what is near each column's mean."""

    def parts(x: np.ndarray) -> list[np.ndarray]:
        x = change(x)
        have = (~np.isnan(x)).astype(float)
        z = np.where(have > 0, x - mean, 0.0)
        return [have.T @ have, z.T @ have, (z * z).T @ have, z.T @ z]

    n, s, q, p = _summed(df, columns, parts, 4, matrices)
    with np.errstate(all="ignore"):
        cov = p - s * s.T / n
        var = q - s * s / n
        noise = 1e-14 * (q + s * s / np.maximum(n, 1))
        var = np.where(var <= noise, 0.0, var)
        out = cov / np.sqrt(var * var.T)
    out[~np.isfinite(out)] = np.nan
    return np.clip(out, -1, 1)


#: Distinct values of all columns together up to which their ranks are sent to every task.
RANKS = 1 << 18


def rank_tables(df: DataFrame, columns: list[str]) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """For each column its values' codes and average ranks, or None if there are more than ``RANKS`` of them."""
    table = value_counts_of(df, columns).limit(RANKS + 1).toArrow()
    if table.num_rows > RANKS:
        return None
    j, code, n = (table.column(i).to_numpy() for i in range(3))
    code = code.view(np.uint64) ^ np.uint64(1 << 63)
    out = []
    for k in range(len(columns)):
        at = np.flatnonzero(j == k)
        at = at[np.argsort(code[at])]
        out.append((code[at], np.cumsum(n[at]) - (n[at] - 1) / 2))
    return out


def _rank_correlation(df: DataFrame, columns: list[str], n: int) -> np.ndarray:
    """Correlations of average ranks of ``n`` rows without missing values: ranks of few distinct values are sent to tasks,
    others are found by ranges of values."""
    bounds = rank_bounds(df, columns, n, RANKS)
    if bounds is None and (tables := rank_tables(df, columns)) is not None:
        return pearson(df, columns, tables)
    dealt, matrices = average_ranks(df, columns, bounds or rank_bounds(df, columns, n, 0))
    return _correlated(dealt, columns, np.full(len(columns), (n + 1) / 2), matrices=matrices)


def spearman(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Correlations of ranks.  With missing values ranks must be taken anew for each pair."""
    row = df.agg(*[F.count("*")], *[F.count(number(c)) for c in columns]).first()
    if all(v == row[0] for v in row[1:]):
        return _rank_correlation(df, columns, row[0])
    out = np.eye(len(columns))
    for i, a in enumerate(columns):
        for j in range(i):
            both = df.select(number(a).alias("a"), number(columns[j]).alias("b")).dropna()
            out[i, j] = out[j, i] = _rank_correlation(both, ["a", "b"], both.count())[0, 1]
    return out


def kendall(df: DataFrame, columns: list[str]) -> np.ndarray:
    """Tau-b of each pair by counting discordances in sorted order.

    Distinct (a, b) pairs of values are counted on the executors; a pair of columns
    then is one group of at most its distinct pairs, merge-counted in a task.
    """
    pairs = [(i, j) for i in range(len(columns)) for j in range(i)]
    out = np.eye(len(columns))
    if not pairs:
        return out
    values = df.select(*[number(c).alias(f"_{i}") for i, c in enumerate(columns)])
    long = values.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{i}").alias("a"), F.col(f"_{j}").alias("b")) for k, (i, j) in enumerate(pairs)])).alias("x")).select("x.*").filter("a is not null and b is not null").groupBy("k", "a", "b").agg(F.count("*").alias("n"))

    def tau(key: tuple, table: pa.Table) -> pa.Table:
        a, b, n = (table.column(c).to_numpy() for c in ("a", "b", "n"))
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "tau": pa.array([tau_b(a, b, n)])})

    for r in long.groupBy("k").applyInArrow(tau, "k int, tau double").collect():
        i, j = pairs[r.k]
        out[i, j] = out[j, i] = np.nan if r.tau is None else r.tau
    return out


def tau_b(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> float:
    """Tau-b of weighted pairs, in n log n with a Fenwick tree."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order].astype(float)
    total = n.sum()
    ties = lambda x: sum(m * (m - 1) / 2 for m in np.bincount(np.unique(x, return_inverse=True)[1], n))
    both = (n * (n - 1) / 2).sum()
    rank = np.unique(b, return_inverse=True)[1] + 1
    tree = np.zeros(rank.max() + 1)

    def upto(i: int) -> float:
        s = 0.0
        while i:
            s += tree[i]
            i &= i - 1
        return s

    worse, seen, at = 0.0, 0.0, 0
    while at < len(a):
        stop = int(np.searchsorted(a, a[at], "right"))
        for k in range(at, stop):
            worse += n[k] * (seen - upto(int(rank[k])))
        for k in range(at, stop):
            i = int(rank[k])
            while i < len(tree):
                tree[i] += n[k]
                i += i & -i
            seen += n[k]
        at = stop
    pairs, ta, tb = total * (total - 1) / 2, ties(a), ties(b)
    scale = np.sqrt((pairs - ta) * (pairs - tb))
    return float((pairs - ta - tb + both - 2 * worse) / scale) if scale > 0 else float("nan")


def correlation(df: DataFrame, columns: list[str], method: str = "pearson") -> np.ndarray:
    try:
        return {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method.lower()](df, columns)
    except KeyError:
        raise ValueError(f"method must be pearson, spearman or kendall, not {method}") from None


def pairwise(df: DataFrame, columns: list[str], method: str = "pearson") -> tuple[np.ndarray, list[tuple[str, str, float]]]:
    """The matrix, and its strict lower triangle as (pair_a, pair_b, correlation)."""
    c = correlation(df, columns, method)
    return c, [(columns[i], columns[j], float(c[i, j])) for i in range(len(columns)) for j in range(i)]
