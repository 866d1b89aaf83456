"""Replicates combined into one consensus profile: mean, median, or correlation-weighted mean."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenolith.functions.exprs import col, number, unique_name
from phenolith.functions.linalg import tau_b
from phenolith.functions.schema import features_of
from phenolith.operators.aggregate import aggregate, check_operation
from phenolith.sources.readers import load_profiles
from phenolith.sources.sinks import sink

#: Rows of a group that are correlated with all others at a time; larger groups are dealt out in blocks.
BLOCK = 512
#: Most rows and numbers of a block.
MOST_ROWS, MOST_CELLS = 4096, 1 << 21


def _ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks within each row, all rows at once."""
    n, d = x.shape
    order = np.argsort(x, axis=1, kind="stable")
    v = np.take_along_axis(x, order, 1)
    new = np.ones((n, d), bool)
    new[:, 1:] = v[:, 1:] != v[:, :-1]
    run = np.cumsum(new.ravel()) - 1  # runs of equal values don't cross rows
    size = np.bincount(run)
    first = (np.flatnonzero(new.ravel()) % d)[run] if d else run
    out = np.empty_like(x)
    np.put_along_axis(out, order, (first + (size[run] + 1) / 2).reshape(n, d), 1)
    return out


def _pearson(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each row of a with each of b; constant rows give NaN."""
    a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
    with np.errstate(all="ignore"):
        return (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :])


def correlations(a: np.ndarray, b: np.ndarray, method: str) -> np.ndarray:
    """Row-by-row correlations over the columns where both are present."""
    if method != "kendall" and not (np.isnan(a).any() or np.isnan(b).any()):
        return _pearson(a, b) if method == "pearson" else _pearson(_ranks(a), _ranks(b))
    out = np.full((len(a), len(b)), np.nan)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            both = ~(np.isnan(x) | np.isnan(y))
            if both.sum() > 1:
                u, v = x[both], y[both]
                out[i, j] = tau_b(u, v, np.ones(len(u))) if method == "kendall" else _pearson(*((u[None], v[None]) if method == "pearson" else (_ranks(u[None]), _ranks(v[None]))))[0, 0]
    return out


def modz_profile(x: np.ndarray, method: str = "spearman", min_weight: float = 0.01, precision: int = 4) -> np.ndarray:
    """One profile of replicates (rows): each weighs as much as it agrees, on average, with the others."""
    if not len(x):
        raise ValueError("a group needs at least one row")
    if len(x) == 1:
        return np.nan_to_num(x[0])
    total, have = agreement(x, None, method)[:2]
    raw = _raw(total, have, min_weight)
    return _weighted(x, raw, np.nansum(raw), len(x), precision)


def agreement(a: np.ndarray, b: np.ndarray | None, method: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sums and counts of the correlations of a's rows with b's, negative ones as 0, for a's rows and for b's; without b with a's other rows."""
    other = a if b is None else b
    total, have, total_b, have_b = np.zeros(len(a)), np.zeros(len(a), np.int64), np.zeros(len(other)), np.zeros(len(other), np.int64)
    for lo in range(0, len(a), BLOCK):
        c = correlations(a[lo : lo + BLOCK], other, method)
        if b is None:
            c[np.arange(len(c)), np.arange(lo, lo + len(c))] = np.nan
        c = np.maximum(c, 0)
        known = ~np.isnan(c)
        total[lo : lo + len(c)], have[lo : lo + len(c)] = np.nansum(c, 1), known.sum(1)
        total_b += np.nansum(c, 0)
        have_b += known.sum(0)
    return total, have, total_b, have_b


def _raw(total: np.ndarray, have: np.ndarray, min_weight: float) -> np.ndarray:
    return np.maximum(np.where(have > 0, total / np.maximum(have, 1), np.nan), min_weight)


def _weighted(x: np.ndarray, raw: np.ndarray, total: float, n: int, precision: int) -> np.ndarray:
    """The part of these rows in the profile of a group of n rows."""
    weight = np.full(len(x), 1 / n) if total == 0 else raw / total
    return np.nansum(x * np.round(weight, precision)[:, None], axis=0)


def modz(df: DataFrame, replicate_columns: str | Sequence[str], features: str | Sequence[str] = "infer", method: str = "spearman", min_weight: float = 0.01, precision: int = 4) -> DataFrame:
    """The weighted consensus of each group; null keys form groups of their own.

    A group of up to BLOCK rows is handled in one task.  The rows of a larger group are
    dealt into blocks, and each pair of blocks is correlated in a task of its own.
    """
    if method.lower() not in ("pearson", "spearman", "kendall"):
        raise ValueError("method must be pearson, spearman or kendall")
    keys = [replicate_columns] if isinstance(replicate_columns, str) else list(replicate_columns)
    if missing := [k for k in keys if k not in df.columns]:
        raise ValueError(f"{missing} not in the table")
    features = [c for c in features_of(df, features) if c not in keys]
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(c, T.DoubleType()) for c in features])
    chosen = df.select(*[col(k) for k in keys], *[number(c).alias(c) for c in features])

    how = method.lower(), min_weight, precision
    small = lambda rows: _batches(rows, keys, features, schema, *how)
    n = unique_name("n", [*keys, *features])
    large = chosen.groupBy(*[col(k) for k in keys]).agg(F.count("*").alias(n)).filter(col(n) > BLOCK)
    if not features or large.isEmpty():
        return small(chosen)
    marked = _beside(chosen, large, keys, "left")
    few = marked.filter(col(n).isNull()).select(*[col(c) for c in chosen.columns])
    return small(few).unionByName(_blocks(marked.filter(col(n).isNotNull()), keys, features, n, schema, *how))


def profiles(x: np.ndarray, method: str, min_weight: float, precision: int) -> np.ndarray:
    """The profiles of groups of one size (groups, rows, columns), all at once, as ``modz_profile`` makes them."""
    groups, n, d = x.shape
    if n == 1:
        return np.nan_to_num(x[:, 0])
    if method == "kendall":
        return np.stack([modz_profile(g, method, min_weight, precision) for g in x])
    out, holes = np.empty((groups, d)), np.isnan(x).any((1, 2))
    for g in np.flatnonzero(holes).tolist():
        out[g] = modz_profile(x[g], method, min_weight, precision)
    whole = x[~holes]
    z = whole if method == "pearson" else _ranks(whole.reshape(-1, d)).reshape(whole.shape)
    z = z - z.mean(2, keepdims=True)
    size = (z * z).sum(2)
    with np.errstate(all="ignore"):
        c = np.matmul(z, z.transpose(0, 2, 1)) / np.sqrt(size[:, :, None] * size[:, None, :])
    c[:, np.arange(n), np.arange(n)] = np.nan
    c = np.maximum(c, 0)
    raw = _raw(np.nansum(c, 2), (~np.isnan(c)).sum(2), min_weight)
    total = np.nansum(raw, 1, keepdims=True)
    with np.errstate(all="ignore"):
        weight = np.where(total == 0, 1 / n, raw / total)
    out[~holes] = np.nansum(whole * np.round(weight, precision)[:, :, None], axis=1)
    return out


def _starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where a new group begins among rows sorted by their first columns; null and NaN equal themselves."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for i in range(keys):
        col = table.column(i).combine_chunks()
        now, before = col[1:], col[:-1]
        differ = pc.fill_null(pc.not_equal(now, before), False).to_numpy(zero_copy_only=False) | (now.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))
        if pa.types.is_floating(col.type):
            differ &= ~pc.fill_null(pc.and_(pc.is_nan(now), pc.is_nan(before)), False).to_numpy(zero_copy_only=False)
        new[1:] |= differ
    return np.flatnonzero(new)


def _batches(rows: DataFrame, keys: list[str], features: list[str], schema: T.StructType, method: str, min_weight: float, precision: int) -> DataFrame:
    """The profiles of groups of at most ``BLOCK`` rows: rows come sorted by key, and the groups of a batch
    are handled together, those of one size at once."""
    of = [col(k) for k in keys]

    def made(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x = np.stack([table.column(len(keys) + j).to_numpy() for j in range(len(features))], 1).astype(float) if features else np.zeros((table.num_rows, 0))
        sizes, out = np.diff(np.append(starts, table.num_rows)), np.zeros((len(starts), len(features)))
        for n in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == n)
            step = max(1, MOST_CELLS // max(1, n * len(features)))
            for lo in range(0, len(at), step):
                some = at[lo : lo + step]
                out[some] = profiles(x[starts[some][:, None] + np.arange(n)], method, min_weight, precision)
        first = table.select(range(len(keys))).take(pa.array(starts)).combine_chunks()
        return pa.RecordBatch.from_arrays([*[c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in first.columns], *[pa.array(out[:, j]) for j in range(len(features))]], names=[*keys, *features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            starts = _starts(held, len(keys))
            if len(starts) > 1:  # the last group may go on
                yield made(held.slice(0, starts[-1]), starts[:-1])
                held = held.slice(starts[-1])
        if held is not None:
            yield made(held, np.zeros(1, np.int64))

    return rows.repartition(*of).sortWithinPartitions(*of).mapInArrow(run, schema)


def _beside(df: DataFrame, groups: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Columns of large groups beside their rows; there are fewer groups than one in BLOCK rows, so they are broadcast."""
    names = {k: unique_name(f"key{i}", [*df.columns, *groups.columns]) for i, k in enumerate(keys)}
    right = F.broadcast(groups.select(*[col(c).alias(names.get(c, c)) for c in groups.columns]))
    same = F.lit(True)
    for k, r in names.items():
        same = same & col(k).eqNullSafe(col(r))
    return df.join(right, same, how).drop(*names.values())


def _blocks(rows: DataFrame, keys: list[str], features: list[str], n: str, schema: T.StructType, method: str, min_weight: float, precision: int) -> DataFrame:
    """The profiles of large groups.  A row's weight doesn't depend on the block it is dealt to."""
    block, blocks, lo, hi, x, total, have, size = (unique_name(c, [*keys, *features, n]) for c in ("block", "blocks", "lo", "hi", "x", "total", "have", "size"))
    by, width = [col(k) for k in keys], len(features)
    key_fields = [rows.schema[k] for k in keys]
    binary, number_, long_ = T.BinaryType(), T.DoubleType(), T.LongType()
    fields = lambda *pairs: T.StructType([*key_fields, *[T.StructField(c, kind) for c, kind in pairs]])
    each = F.least(F.greatest(F.lit(BLOCK), F.ceil(col(n) / 64)), F.lit(MOST_ROWS), F.lit(max(1, MOST_CELLS // width)))
    dealt = rows.withColumn(blocks, F.ceil(col(n) / each)).withColumn(block, F.pmod(F.xxhash64(F.monotonically_increasing_id()), col(blocks)))
    dealt = dealt.select(*by, col(blocks), col(block), F.array(*[col(c) for c in features]).alias(x))

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        flat = table.column(x).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
        return pa.Table.from_arrays([*[pa.array([v.as_py()], v.type) for v in key], pa.array([flat.tobytes()], pa.binary())], names=[*keys, blocks, block, x])

    def matrix(raw: bytes) -> np.ndarray:
        return np.frombuffer(raw).reshape(-1, width)

    def correlated(key: tuple, table: pa.Table) -> pa.Table:
        first, last = (v.as_py() for v in key[len(keys) :])
        of = {b: matrix(raw) for b, raw in zip(table.column(block).to_pylist(), table.column(x).to_pylist(), strict=True)}
        out = []
        if first == last:
            out = [(first, *agreement(of[first], None, method)[:2], of[first].tobytes())]
        elif len(of) == 2:
            t, h, u, v = agreement(of[first], of[last], method)
            out = [(first, t, h, None), (last, u, v, None)]
        columns = [pa.array([r[0] for r in out], pa.int64()), *[pa.array([r[i].tobytes() for r in out], pa.binary()) for i in (1, 2)], pa.array([r[3] for r in out], pa.binary())]
        return pa.Table.from_arrays([*[pa.array([v.as_py()] * len(out), v.type) for v in key[: len(keys)]], *columns], names=[*keys, block, total, have, x])

    def summed(key: tuple, table: pa.Table) -> pa.Table:
        add = lambda name, kind: sum(np.frombuffer(v.as_py(), kind) for v in table.column(name))
        raw = _raw(add(total, np.float64), add(have, np.int64), min_weight)
        own = next(v for v in table.column(x).to_pylist() if v is not None)
        return pa.Table.from_arrays([*[pa.array([v.as_py()], v.type) for v in key[: len(keys)]], pa.array([own], pa.binary()), pa.array([raw.tobytes()], pa.binary()), pa.array([float(np.nansum(raw))]), pa.array([len(raw)], pa.int64())], names=[*keys, x, have, total, size])

    def weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = dict(zip(b.schema.names, b.columns, strict=True))
            parts = [_weighted(matrix(m), np.frombuffer(r), t, s, precision) for m, r, t, s in zip(*(of[c].to_pylist() for c in (x, have, total, size)), strict=True)]
            yield pa.RecordBatch.from_arrays([*[of[k] for k in keys], *[pa.array(v) for v in np.array(parts).reshape(-1, width).T]], names=[*keys, *features])

    one = dealt.groupBy(*by, col(blocks), col(block)).applyInArrow(packed, fields((blocks, long_), (block, long_), (x, binary)))
    pairs = one.select(*by, col(block), col(x), F.explode(F.sequence(F.lit(0).cast("long"), col(blocks) - 1)).alias(hi))
    pairs = pairs.select(*by, F.least(col(block), col(hi)).alias(lo), F.greatest(col(block), col(hi)).alias(hi), col(block), col(x))
    raw = pairs.groupBy(*by, col(lo), col(hi)).applyInArrow(correlated, fields((block, long_), (total, binary), (have, binary), (x, binary))).groupBy(*by, col(block)).applyInArrow(summed, fields((x, binary), (have, binary), (total, number_), (size, long_)))
    totals = raw.groupBy(*by).agg(F.sum(col(total)).alias(total), F.sum(col(size)).alias(size))
    parts = _beside(raw.select(*by, col(x), col(have)), totals, keys, "inner").mapInArrow(weighted, schema)
    return parts.groupBy(*by).agg(*[F.sum(col(c)).alias(c) for c in features])


@sink
def consensus(
    profiles: str | DataFrame,
    replicate_columns: str | Sequence[str] = ("Metadata_Plate", "Metadata_Well"),
    operation: str = "median",
    features: str | Sequence[str] = "infer",
    modz_args: dict | None = None,
) -> DataFrame:
    how = check_operation(operation, ("mean", "median", "modz"))
    df = load_profiles(profiles)
    if how == "modz":
        return modz(df, replicate_columns, features, **({"method": "spearman"} if modz_args is None else modz_args))
    return aggregate(df, strata=replicate_columns, features=features, operation=how)
