"""Exact order statistics and ranks of distributed columns; no task and no driver holds a column.

A double is taken as the unsigned integer that sorts as it does.  Order
statistics come from passes over those integers' leading bits: each task counts
its values by prefix, the prefixes that hold a wanted rank are looked at closer in
the next pass, until each holds one value.  Only counts travel: at most about
``ROWS`` rows a pass reach the driver, wider requests go in several passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenolith.functions.exprs import col, number, unique_name
from phenolith.functions.reuse import kept

#: Rows of counts that a pass may bring to the driver, bits of the first prefix and most bits of a later step.
ROWS, FIRST, STEP = 1 << 21, 12, 16
_TOP = np.uint64(1 << 63)


def codes(x: np.ndarray) -> np.ndarray:
    """Unsigned integers that sort as the doubles do; both zeros are one."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >= _TOP, ~u, u | _TOP)


def values(c: np.ndarray) -> np.ndarray:
    return np.where(c >= _TOP, c ^ _TOP, ~c).view(np.float64)


def _signed(c: np.ndarray) -> np.ndarray:
    return (c ^ _TOP).view(np.int64)


def _unsigned(c: np.ndarray) -> np.ndarray:
    return c.view(np.uint64) ^ _TOP


_COUNTS = "g int, j int, code long, n long, lo long, hi long"


def _counted(df: DataFrame, group: str | None, columns: Sequence[str], bits: int, step: int, wanted: dict[tuple[int, int], np.ndarray] | None) -> DataFrame:
    """(group, column, prefix, count, least, greatest) of ``bits + step`` leading bits, among the wanted prefixes of ``bits``."""
    shift = np.uint64(64 - bits - step)
    before = np.uint64(64 - bits) if bits else None
    used = range(len(columns)) if wanted is None else sorted({j for _, j in wanted})
    chosen = df.select((F.col(group) if group else F.lit(0)).cast("int").alias("_g"), *[number(columns[j]).alias(f"_{j}") for j in used])
    shared = df.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        size = 0

        def counts() -> Iterator[pa.RecordBatch]:
            for (g, j), parts in held.items():
                c = np.sort(np.concatenate(parts))
                prefix = c >> shift
                at = np.append(np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))), len(c))
                first, n = at[:-1], np.diff(at)
                cols = [np.full(len(n), g, np.int32), np.full(len(n), j, np.int32), prefix[first].view(np.int64), n, _signed(c[first]), _signed(c[at[1:] - 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["g", "j", "code", "n", "lo", "hi"])
            held.clear()

        for b in batches:
            groups = b.column(0).to_numpy()
            for g in np.unique(groups).tolist():
                rows = groups == g
                for at, j in enumerate(used, 1):
                    if shared.value is not None and (g, j) not in shared.value:
                        continue
                    x = b.column(at).to_numpy(zero_copy_only=False)[rows]
                    c = codes(x[~np.isnan(x)])
                    if shared.value is not None:
                        own, p = shared.value[g, j], c >> before
                        c = c[own[np.minimum(np.searchsorted(own, p), len(own) - 1)] == p]
                    if len(c):
                        held.setdefault((g, j), []).append(c)
                        size += len(c)
            if size > 1 << 21:
                yield from counts()
                size = 0
        yield from counts()

    made = chosen.mapInArrow(run, _COUNTS)
    return made.groupBy("g", "j", "code").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


class _Search:
    """The wanted ranks (from 0) of one column of one group, and what is known of them."""

    def __init__(self, at: np.ndarray, n: int, p: Sequence[float]):
        self.ranks = at
        self.value = np.full(len(at), np.nan)
        self.n, self.p = n, p

    def narrow(self, code: np.ndarray, n: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(prefixes, their first ranks, their counts) to look at closer."""
        open_ = np.flatnonzero(np.isnan(self.value))
        at = np.searchsorted(start, self.ranks[open_], "right") - 1
        ok = (at >= 0) & (self.ranks[open_] < start[at] + n[at])
        open_, at = open_[ok], at[ok]
        done = lo[at] == hi[at]
        self.value[open_[done]] = values(lo[at[done]])
        left = np.unique(at[~done])
        return code[left], start[left], n[left]


def order_statistics(df: DataFrame, columns: Sequence[str], p: Sequence[float], group: str | None = None, once: bool = True) -> dict[int, np.ndarray]:
    """For each group (an integer column, or 0) exact percentiles at ``p``, interpolated between
    neighbours, as a row each; NaN for columns without values.  Missing values are left out.  With ``once`` a table that is more
    than a scan is made once for all passes."""
    if once:
        with kept(df.select(*[col(c) for c in dict.fromkeys([*([group] if group else []), *columns])])) as rows:
            return order_statistics(rows, columns, p, group, once=False)
    out: dict[int, np.ndarray] = {}
    width = max(1, min(len(columns), ROWS >> FIRST))
    for lo in range(0, len(columns), width):
        part = list(columns[lo : lo + width])
        table = _counted(df, group, part, 0, FIRST, None).toArrow()
        g, j, code, n, least, most = (table.column(i).to_numpy() for i in range(6))
        code, least, most = code.view(np.uint64), _unsigned(least), _unsigned(most)
        searches: dict[tuple[int, int], _Search] = {}
        todo: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        order = np.lexsort((code, j, g))
        cut = np.append(np.flatnonzero(np.concatenate(([True], (np.diff(g[order]) != 0) | (np.diff(j[order]) != 0)))), len(order)) if len(order) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            at = order[a:b]
            total = int(n[at].sum())
            place = np.asarray(p, float) * (total - 1)
            search = _Search(np.unique(np.concatenate([np.floor(place), np.ceil(place)]).astype(np.int64)), total, p)
            key = int(g[at[0]]), int(j[at[0]])
            searches[key] = search
            start = np.cumsum(n[at]) - n[at]
            if len((rest := search.narrow(code[at], n[at], start, least[at], most[at]))[0]):
                todo[key] = rest
        _resolve(df, group, part, searches, todo)
        for (gi, ji), s in searches.items():
            place = np.asarray(p, float) * (s.n - 1)
            low, high = (s.value[np.searchsorted(s.ranks, r(place).astype(np.int64))] for r in (np.floor, np.ceil))
            with np.errstate(invalid="ignore"):
                between = (np.ceil(place) - place) * low + (place - np.floor(place)) * high
            out.setdefault(gi, np.full((len(p), len(columns)), np.nan))[:, lo + ji] = np.where(low == high, low, between)
    return out or {0: np.full((len(p), len(columns)), np.nan)}


def _resolve(df: DataFrame, group: str | None, columns: list[str], searches: dict, todo: dict) -> None:
    bits = FIRST
    while todo:
        rows = sum(int(n.sum()) for _, _, n in todo.values())
        prefixes = sum(len(c) for c, _, _ in todo.values())  # so many bits that one pass over the data does for all columns
        step = 64 - bits if rows <= ROWS else min(max(4, min(STEP, int(ROWS // prefixes).bit_length() - 1)), 64 - bits)
        after: dict = {}
        keys = list(todo)
        while keys:  # as many columns at a time as bring ROWS rows at most
            some, most = [], 0
            while keys and (not some or most + min(int(todo[keys[0]][2].sum()), len(todo[keys[0]][0]) << min(step, 40)) <= ROWS):
                k = keys.pop(0)
                most += min(int(todo[k][2].sum()), len(todo[k][0]) << min(step, 40))
                some.append(k)
            table = _counted(df, group, columns, bits, step, {k: todo[k][0] for k in some}).toArrow()
            g, j, code, n, least, most_ = (table.column(i).to_numpy() for i in range(6))
            code, least, most_ = code.view(np.uint64), _unsigned(least), _unsigned(most_)
            for k in some:
                at = np.flatnonzero((g == k[0]) & (j == k[1]))
                at = at[np.argsort(code[at])]
                parent, first, _ = todo[k]
                of = np.searchsorted(parent, code[at] >> np.uint64(step))
                own = np.cumsum(n[at]) - n[at]
                start = own - own[np.searchsorted(of, of)] + first[of]  # ranks within the prefix, after those before it
                if len((rest := searches[k].narrow(code[at], n[at], start, least[at], most_[at]))[0]):
                    after[k] = rest
        todo, bits = after, bits + step


def value_counts_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(j, code, n): how often each distinct value of each column is there; codes sort as the values do."""
    return _counted(df, None, columns, 0, 64, None).select("j", F.col("lo").alias("code"), "n")


#: Values of a block of rows that is ranked together, and of a range of a column's values that a task ranks.
BLOCK, RANGE = 1 << 20, 1 << 21


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The codes of all columns, for a block of rows at a time."""
    held, rows = [], 0
    for b in batches:
        most = max(1, BLOCK // b.num_columns)
        for lo in range(0, b.num_rows, most):
            held.append(b.slice(lo, most))
            rows += held[-1].num_rows
            if rows >= most:
                yield [codes(np.concatenate([h.column(j).to_numpy(zero_copy_only=False) for h in held])) for j in range(b.num_columns)]
                held, rows = [], 0
    if held:
        yield [codes(np.concatenate([h.column(j).to_numpy(zero_copy_only=False) for h in held])) for j in range(held[0].num_columns)]


def _even(code: np.ndarray, weight: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The codes at shares of the whole weight."""
    order = np.argsort(code)
    below = np.cumsum(weight[order])
    return code[order][np.minimum(np.searchsorted(below, share * below[-1]), len(code) - 1)]


def rank_bounds(df: DataFrame, columns: Sequence[str], n: int, distinct: int) -> list[np.ndarray] | None:
    """For each column of ``n`` values bounds of ranges that hold about equally many distinct values, ``RANGE`` or fewer.
    None if no task meets more than ``distinct`` distinct values of all columns together."""
    ranges = max(-(-n // RANGE), -(-2 * df.sparkSession.sparkContext.defaultParallelism // len(columns)))
    picks = 4 * ranges
    share = (np.arange(picks) + 0.5) / picks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] | None = [np.zeros(0, np.uint64)] * len(columns)
        picked: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in columns]
        for block in _blocks(batches):
            own = [np.unique(c) for c in block]
            for p, u in zip(picked, own, strict=True):
                p.append((u[(share * len(u)).astype(np.int64)], np.full(picks, len(u) / picks)))
            if seen is not None:
                seen = [np.union1d(a, b) for a, b in zip(seen, own, strict=True)]
                if sum(map(len, seen)) > distinct:
                    seen = None
        if picked[0]:
            for j, p in enumerate(picked):
                code, weight = (np.concatenate([x[i] for x in p]) for i in range(2))
                yield pa.RecordBatch.from_arrays([pa.array([j], pa.int32()), pa.array([seen is None]), pa.array([weight.sum()]), pa.array([_even(code, weight, share).tobytes()], pa.binary())], names=["j", "many", "weight", "codes"])

    got = df.select(*[number(c).alias(f"_{j}") for j, c in enumerate(columns)]).mapInArrow(run, "j int, many boolean, weight double, codes binary").collect()
    if distinct and not any(r.many for r in got):
        return None
    out, cut = [], np.arange(1, ranges) / ranges
    for j in range(len(columns)):
        own = [r for r in got if r.j == j]
        code = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r.codes, np.uint64) for r in own)])
        out.append(np.unique(_even(code, np.repeat([r.weight for r in own], picks), cut)) if len(code) else code)
    return out


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, compressed, the bytes of one place together."""
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return np.array([len(x), width], "<i8").tobytes() + pa.compress(x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, width = np.frombuffer(data, "<i8", 2).tolist()
    out = np.zeros((n, 8), np.uint8)
    if n * width:
        out[:, :width] = np.frombuffer(pa.decompress(data[16:], n * width, "zstd"), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel()


def _steps(x: np.ndarray) -> bytes:
    return _packed(np.diff(x, prepend=x.dtype.type(0)))


_DEALT = "part int, kind byte, block long, j int, r int, data binary, counts binary"


def average_ranks(df: DataFrame, columns: Sequence[str], bounds: list[np.ndarray]) -> tuple[DataFrame, Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]]:
    """(a table, what makes matrices of average ranks of its batches), for columns without missing values.

    A block of rows sends a column's distinct values with their counts to the tasks that rank the ranges which they are in, and where its
    rows' values are among them along; ranks come back by block.  So values that are often there weigh no more than others, and the
    rows' order doesn't matter."""
    d = len(columns)
    chosen = df.select(*[number(c).alias(f"_{j}") for j, c in enumerate(columns)])
    ranges = max(len(b) for b in bounds) + 1
    parts = min(d * ranges, 4096)
    shared = df.sparkSession.sparkContext.broadcast(bounds)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, ranges), np.int64)
        for block in _blocks(batches):
            for j, (c, b) in enumerate(zip(block, shared.value, strict=True)):
                total[j] += np.bincount(np.searchsorted(b, c, "right"), minlength=ranges)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["n"])

    total = sum((np.frombuffer(r.n, np.int64).reshape(d, ranges) for r in chosen.mapInArrow(count, "n binary").toLocalIterator()), np.zeros((d, ranges), np.int64))
    before = df.sparkSession.sparkContext.broadcast(np.cumsum(total, 1) - total)

    def records(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int8(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["part", "kind", "block", "j", "r", "data", "counts"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, block in enumerate(_blocks(batches), TaskContext.get().partitionId() << 32):
            for j, (c, b) in enumerate(zip(block, shared.value, strict=True)):
                u, inverse, n = np.unique(c, return_inverse=True, return_counts=True)
                cut = [0, *np.searchsorted(u, b).tolist(), len(u)]
                rows = [((j * ranges + r) % parts, 0, k, j, r, _steps(u[lo:hi]), _packed(n[lo:hi])) for r, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if lo < hi]
                yield records([*rows, ((k * 31 + (k >> 32) + j) % parts, 1, k, j, 0, _packed(inverse), None)])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def ranked() -> Iterator[pa.RecordBatch]:
            code = [np.cumsum(_unpacked(data), dtype=np.uint64) for _, data, _ in held]
            u, of = np.unique(np.concatenate(code), return_inverse=True)
            n = np.bincount(of, np.concatenate([_unpacked(counts) for *_, counts in held]), len(u)).astype(np.int64)
            twice, lo = 2 * (before.value[at] + np.cumsum(n) - n) + n + 1, 0
            for (block, *_), c in zip(held, code, strict=True):
                yield records([(0, 0, block, *at, _steps(twice[of[lo : lo + len(c)]]), None)])
                lo += len(c)
            held.clear()

        for b in batches:
            for _, kind, block, j, r, data, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (kind or (j, r) != at):
                    yield from ranked()
                if kind:
                    yield records([(0, 1, block, j, 0, data, None)])
                else:
                    at = j, r
                    held.append((block, data, counts))
        if held:
            yield from ranked()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        at, ranks, x = None, [], None
        for b in batches:
            for block, kind, j, data in zip(*(b.column(i).to_pylist() for i in (2, 1, 3, 5)), strict=True):
                if kind == 0:  # a column's ranks come first, in order of their ranges
                    ranks.append(np.cumsum(_unpacked(data)))
                    continue
                inverse = _unpacked(data).astype(np.int64)
                if block != at:
                    if x is not None:
                        yield x
                    at, x = block, np.empty((len(inverse), d))
                x[:, j] = np.concatenate(ranks)[inverse] / 2
                ranks = []
        if x is not None:
            yield x

    by_range = chosen.mapInArrow(deal, _DEALT).repartitionById(parts, F.col("part")).sortWithinPartitions("kind", "j", "r")
    return by_range.mapInArrow(rank, _DEALT).repartition(parts, "block").sortWithinPartitions("block", "j", "kind", "r"), matrices


def repeatable_rank(df: DataFrame, strata: Sequence[Column], seed: int, name: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in its stratum, in the order of a keyed hash of the whole row.

    Rows are dealt to 4,096 buckets of the hash, counted, and ranked within a bucket: a task holds one
    bucket of one stratum, and a rerun gives the same places (equal rows are interchangeable).
    """
    mark, bucket, before = (unique_name(x, [*df.columns, name]) for x in ("_mark", "_bucket", "_before"))
    kinds = ("map", "variant")
    whole = [F.col("`" + f.name.replace("`", "``") + "`") for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in kinds)]
    marked = df.withColumn(mark, F.xxhash64(F.lit(seed), *whole)).withColumn(bucket, F.shiftrightunsigned(F.col(mark), 52))
    keys = [unique_name(f"_key{i}", [*df.columns, name]) for i in range(len(strata))]
    keyed = marked.withColumns(dict(zip(keys, strata, strict=True)))
    counts = keyed.groupBy(*keys, bucket).agg(F.count("*").alias(before))
    sums = counts.withColumn(before, F.coalesce(F.sum(before).over(Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    other = [unique_name(f"_other{i}", [*df.columns, name]) for i in range(len(keys) + 1)]
    sums = sums.select(*[F.col(a).alias(b) for a, b in zip([*keys, bucket], other, strict=True)], before)
    same = F.col(bucket) == F.col(other[-1])
    for a, b in zip(keys, other, strict=False):
        same = same & F.col(a).eqNullSafe(F.col(b))
    place = F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(mark))
    ranked = keyed.withColumn(name, place).join(sums, same).withColumn(name, F.col(name) + F.col(before))
    return ranked.drop(mark, bucket, before, *keys, *other)
