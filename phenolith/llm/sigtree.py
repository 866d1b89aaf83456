"""N-gram Jaccard join with signature trees.

A document's set holds the hashes of its distinct k-word shingles; documents
with equal sets form one class.  Sets that reach the threshold share one of
the first ``n - ceil(t n) + 1`` hashes of each in any common order, so classes
meet only where they share such a hash.  In each meeting the classes stand in a
signature tree: a node holds the OR of its members' token bitmaps, their size
range, the most bits that collided in a member, and the label that all of them
have, if they have one.  Two trees (or one with itself) are walked together and
a pair of nodes is dropped if sizes are too far apart, if the overlap that
bitmaps allow is too small, or if all are linked already.  What is left is
compared set against set.

* The order puts hashes of frequent cells of a count sketch last, and among the
  others longer shingles first; the sketch has a fixed size and covers all
  documents.  So common passages and chance meetings of short words seldom head
  a set.  The order never changes which links are found.
* A bitmap has four to eight bits a shingle; trees hold it folded to one size, and
  the pairs they leave are held against the whole bitmaps.
* First, classes are compared with the least class that shares one of their
  four least hashes of long shingles.  Those links give labels; hashes under which all classes
  have one label need no meeting, so large groups of near copies cost one
  comparison a class.  This step only saves work.
* A meeting of more than ``CELL`` classes is dealt out as pairs of chunks, so no
  task holds more than two chunks of it.

Links are kept between classes and components are found by alternating stars.

Defined results: a null or empty text, or one without words, has an empty set
and is linked with nothing; a text of fewer words than ``k`` has its whole
sequence as one shingle; repeated rows are one class; rows without an id take
part, and a component's id is the least id in it (null if it has none; the id
-2**63 counts as none); an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.llm.components import components
from phenolith.llm.kernel import NONSPACE, grams, slices, words
from phenolith.llm.runtime import forget, merged, stored

SKETCH, BLOCK = 22, 16  # bits: cells of the count sketch, and of one block of it
WIDTH = 32  # 64-bit words of a bitmap, at least
LOW, LONG = 4, 20  # least hashes for the first step, among shingles of so many bytes
CELL = 2048  # classes of one side of a dealt meeting
SALT = 64  # members compared with one copy of a hub's text
NODE = 16  # members of a leaf and children of a node
NO_ID = -(1 << 63)


def shingle_sets(col: pa.Array, k: int, sizes: bool = False) -> list:
    """Sorted distinct 64-bit shingle hashes of each text; with ``sizes``, also the bytes of each shingle's words."""
    w = words(col, NONSPACE)
    by_n = {n: grams(w.hash, n) for n in {min(k, int(x)) for x in np.diff(w.first)} - {0}}
    length = np.concatenate(([0], np.cumsum(w.end - w.start)))
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = min(k, b - a)
        if not n:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)) if sizes else np.zeros(0, np.uint64))
        elif sizes:
            s, first = np.unique(by_n[n][a : b - n + 1], return_index=True)
            out.append((s, length[a + first + n] - length[a + first]))
        else:
            out.append(np.unique(by_n[n][a : b - n + 1]))
    return out


def prefix_size(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shared hashes that sets of sizes a and b need to reach the threshold."""
    return -(-(percent * (a + b)) // (100 + percent))


def bitmap(s: np.ndarray) -> np.ndarray:
    """One bit a hash in four to eight times as many bits, a power of two."""
    bits = max(WIDTH * 64, 1 << (4 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[((s >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out).view(np.uint64)


def folded(sig: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (a row each) brought to ``width`` words."""
    return np.bitwise_or.reduce(sig.reshape(len(sig), -1, width), axis=1) if sig.shape[1] > width else sig


def overlap_bound(n: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared hashes that bitmaps of equal width, row by row, allow to sets of n and m hashes."""
    over = np.minimum(n - np.bitwise_count(a).sum(1, dtype=np.int64), m - np.bitwise_count(b).sum(1, dtype=np.int64))
    return np.minimum(np.bitwise_count(a & b).sum(1, dtype=np.int64) + over, np.minimum(n, m))


def cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH)).astype(np.int64)


def digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


class Tree:
    """Levels of nodes over members sorted by size; level 0 is the members."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, label: np.ndarray):
        order = np.lexsort((label, size))
        self.order = order
        over = size[order] - np.bitwise_count(sig[order]).sum(1, dtype=np.int64)
        self.levels = [(size[order], size[order], over, sig[order], label[order])]
        while len(self.levels[-1][0]) > NODE:
            lo, hi, e, s, g = self.levels[-1]
            at = np.arange(0, len(lo), NODE)
            same = np.minimum.reduceat(g, at) == np.maximum.reduceat(g, at)
            same &= np.minimum.reduceat(g, at) >= 0
            self.levels.append((np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(e, at), np.bitwise_or.reduceat(s, at, axis=0), np.where(same, g[at], -1)))


def walk(a: Tree, b: Tree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members (of a, of b) whose sets may reach the threshold and whose labels differ, part by part."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    x, y = (z.ravel() for z in np.meshgrid(np.arange(len(a.levels[la][0])), np.arange(len(b.levels[lb][0])), indexing="ij"))
    work = [(la, lb, x, y)]
    step = 1 << 15
    while work:
        la, lb, x, y = work.pop()
        if len(x) > step:
            work += [(la, lb, x[i : i + step], y[i : i + step]) for i in range(0, len(x), step)]
            continue
        alo, ahi, ae, asig, ag = a.levels[la]
        blo, bhi, be, bsig, bg = b.levels[lb]
        ok = (100 * ahi[x] >= percent * blo[y]) & (100 * bhi[y] >= percent * alo[x]) & ((ag[x] != bg[y]) | (ag[x] < 0))
        if a is b:  # each pair once
            ok &= y >= x if la else y > x
        x, y = x[ok], y[ok]
        bound = np.bitwise_count(asig[x] & bsig[y]).sum(1, dtype=np.int64) + np.minimum(ae[x], be[y])
        ok = np.minimum(bound, np.minimum(ahi[x], bhi[y])) >= least_overlap(alo[x], blo[y], percent)
        x, y = x[ok], y[ok]
        if not len(x):
            continue
        if not la and not lb:
            yield a.order[x], b.order[y]
            continue
        down_a, down_b = (la > 0, lb > 0) if la == lb else (la > lb, lb > la)
        if down_a:
            n = len(a.levels[la - 1][0])
            kids = x[:, None] * NODE + np.arange(NODE)
            keep = kids < n
            x, y = kids[keep], np.repeat(y, keep.sum(1))
        if down_b:
            n = len(b.levels[lb - 1][0])
            kids = y[:, None] * NODE + np.arange(NODE)
            keep = kids < n
            y, x = kids[keep], np.repeat(x, keep.sum(1))
        work.append((la - down_a, lb - down_b, x, y))


def _scan(docs: DataFrame, k: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, digest) of every row; and a level for each cell of a fixed-size count sketch
    of all shingles, 0 unless the cell is clearly over the mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH, np.uint32)
        for b in slices(batches, "text"):
            sets = shingle_sets(b.column(1), k)
            if any(map(len, sets)):
                np.add.at(counts, cell(np.concatenate(sets)), 1)
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) for s in sets], pa.binary()), none], names=["doc_id", "n", "digest", "block"])
        blocks = np.minimum(counts, 255).astype(np.uint8).reshape(-1, 1 << BLOCK)
        full = np.flatnonzero(blocks.any(1))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(full), pa.int64()), pa.nulls(len(full), pa.int64()), pa.array([blocks[i].tobytes() for i in full], pa.binary()), pa.array(full, pa.int32())], names=["doc_id", "n", "digest", "block"])

    both = stored(docs, "scan", run, "doc_id long, n long, digest binary, block int")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << BLOCK, np.int64)

        def level() -> pa.RecordBatch:
            mean = total.mean()
            out = np.where(total > mean + 6 * np.sqrt(mean) + 3, np.frexp(total.astype(float))[1], 0).astype(np.uint8)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "level"])

        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if i != at:
                    if at is not None:
                        yield level()
                    at, total = i, np.zeros(1 << BLOCK, np.int64)
                total += np.frombuffer(v, np.uint8)
        if at is not None:
            yield level()

    blocks = both.filter("block is not null").select("block", "digest").repartition(1 << (SKETCH - BLOCK), "block").sortWithinPartitions("block")
    level = np.zeros((1 << (SKETCH - BLOCK), 1 << BLOCK), np.uint8)
    for r in blocks.mapInArrow(add, "block int, level binary").collect():  # 2**SKETCH bytes
        level[r.block] = np.frombuffer(r.level, np.uint8)
    return both.filter("block is null").drop("block"), level.ravel()


def _classes(docs: DataFrame, k: int, percent: int, level: np.ndarray) -> DataFrame:
    """(digest, id, n, sig, low, prefix) of every distinct set; ``id`` is its least document's."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            both = shingle_sets(b.column(1), k, True)
            some = [i for i, (s, _) in enumerate(both) if len(s)]
            both = [both[i] for i in some]
            first = [s[np.lexsort((-size, shared.value[cell(s)]))][: prefix_size(len(s), percent)] for s, size in both]
            low = [(s[size >= LONG] if np.count_nonzero(size >= LONG) >= LOW else s)[:LOW] for s, size in both]
            many = lambda x: pa.array([s.view(np.int64) for s in x], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(some, pa.int64())), pa.array([len(s) for s, _ in both], pa.int64()), pa.array([digest(s) for s, _ in both], pa.binary()), pa.array([bitmap(s).tobytes() for s, _ in both], pa.binary()), many(low), many(first)],
                names=["doc_id", "n", "digest", "sig", "low", "prefix"],
            )

    each = docs.mapInArrow(run, "doc_id long, n long, digest binary, sig binary, low array<long>, prefix array<long>")
    out = stored(each.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("id"), *[F.first(c).alias(c) for c in ("n", "sig", "low", "prefix")]), "classes")
    shared.unpersist()
    return out


def _bloom(keys: DataFrame, column: str) -> Callable[[np.ndarray], np.ndarray]:
    """A test that holds for every value of a long column and for few others: two bits a value in
    32 times as many, 16 MB at most.  Tasks make parts of it that don't overlap."""
    n = keys.count()
    bits, deal = int(np.clip(int(32 * n + 1).bit_length(), 16, 27)), 4

    def places(v: np.ndarray) -> tuple[np.ndarray, ...]:
        return tuple((v.view(np.uint64) * np.uint64(m) >> np.uint64(64 - bits)).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.concatenate(places(b.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> (bits - deal)).astype(np.int32)), pa.array(at)], names=["part", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            part, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(part).tolist():
                parts.setdefault(p, np.zeros(1 << (bits - deal), bool))[at[part == p] & ((1 << (bits - deal)) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([np.packbits(x).tobytes() for x in parts.values()], pa.binary())], names=["part", "bits"])

    whole = np.zeros((1 << deal, (1 << bits - deal) // 8), np.uint8)
    made = keys.select(column).mapInArrow(place, "part int, at long").repartition(1 << deal, "part").mapInArrow(run, "part int, bits binary")
    for r in made.collect():
        whole[r.part] = np.frombuffer(r.bits, np.uint8)
    whole = whole.ravel()
    shared = keys.sparkSession.sparkContext.broadcast(whole)

    def test(v: np.ndarray) -> np.ndarray:
        one, two = ((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) for at in places(v))
        return one & two

    return test


def _picked(classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Classes whose digest is in ``wanted``, and few others: spares a join the rest's bitmaps."""
    test = _bloom(wanted.select(F.xxhash64("digest").alias("h")).distinct(), "h")
    columns = ["digest", "id", "n", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(test(b.column(0).to_numpy(zero_copy_only=False)))).select(columns)

    return classes.select(F.xxhash64("digest").alias("h"), *columns).mapInArrow(run, classes.select(*columns).schema)


def _verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, a_id, b, b_id) of classes whose sets reach the threshold, as (u, v)."""
    pairs = pairs.withColumn("s", F.pmod(F.hash("b"), F.lit(1 << 30)))
    hubs = pairs.groupBy("a", "a_id").agg(F.count("*").alias("c")).withColumn("deal", F.ceil(F.col("c") / SALT).cast("int"))
    members = pairs.join(hubs.select("a", "deal"), "a").select("a", (F.col("s") % F.col("deal")).cast("int").alias("s"), F.lit(1).alias("role"), F.col("b").alias("digest"), F.col("b_id").alias("id"))
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)).alias("s"), F.lit(0).alias("role"), F.col("a").alias("digest"), F.col("a_id").alias("id"))
    want = heads.union(members)
    ids = want.select("id").distinct()
    wanted = _bloom(ids, "id")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(wanted(b.column(0).to_numpy(zero_copy_only=False))))
            for c in slices([some], "text"):
                yield pa.RecordBatch.from_arrays([c.column(0), pa.array([digest(s) for s in shingle_sets(c.column(1), k)], pa.binary()), c.column(1)], names=["id", "digest", "text"])

    found = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(texts, "id long, digest binary, text string")
    rows = want.join(found, ["id", "digest"]).select("a", "s", "role", "digest", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = (None, None), np.zeros(0, np.uint64)
        for b in slices(batches, "text"):
            out = []
            for a, s, role, d, x in zip(*(b.column(i).to_pylist() for i in range(4)), shingle_sets(b.column(4), k), strict=True):
                if role == 0:
                    hub, own = (a, s), x
                elif hub == (a, s):
                    at = np.minimum(np.searchsorted(own, x), len(own) - 1)
                    if np.count_nonzero(own[at] == x) >= least_overlap(len(own), len(x), percent):
                        out.append((a, d))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["u", "v"])

    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartition(parts, "a", "s").sortWithinPartitions("a", "s", "role")
    return stored(dealt.mapInArrow(compare, "u binary, v binary").distinct(), "links")


def _near_bound(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, a_id, b, b_id) of the pairs (a, b) whose sizes and whole bitmaps allow the threshold."""
    picked = _picked(classes, pairs.select(F.col("a").alias("digest")).union(pairs.select("b")))
    side = lambda x: picked.select(F.col("digest").alias(x), F.col("id").alias(f"{x}_id"), F.col("n").alias(f"{x}_n"), F.col("sig").alias(f"{x}_sig"))
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("a_sig", "b_sig")]
            n = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("a_n", "b_n")]
            wide = [np.array([len(x) // 8 for x in z]) for z in sig]
            ok = np.zeros(b.num_rows, bool)
            for wa, wb in sorted(set(zip(*(w.tolist() for w in wide), strict=True))):
                at = np.flatnonzero((wide[0] == wa) & (wide[1] == wb))
                x, y = (folded(np.frombuffer(b"".join([z[i] for i in at]), np.uint64).reshape(len(at), -1), min(wa, wb)) for z in sig)
                ok[at] = overlap_bound(n[0][at], x, n[1][at], y) >= least_overlap(n[0][at], n[1][at], percent)
            yield b.filter(pa.array(ok)).select(["a", "a_id", "b", "b_id"])

    return stored(pairs, "pairs", run, "a binary, a_id long, b binary, b_id long")


def _meetings(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) of rows (key, i, j, side, digest, id, n, sig, label), sorted by meeting."""

    def pairs(group: list[tuple], i: int, j: int) -> Iterator[tuple[tuple, tuple]]:
        label = {g: c for c, g in enumerate(dict.fromkeys(r[8] for r in group))}
        bands: dict[tuple[int, int], list[tuple]] = {}  # one tree for each side and width
        for r in group:
            bands.setdefault((len(r[7]) // 8, r[3]), []).append(r)

        def tree(part: list[tuple], width: int) -> Tree:
            return Tree(np.array([r[6] for r in part], np.int64), folded(np.frombuffer(b"".join(r[7] for r in part), np.uint64).reshape(len(part), -1), width), np.array([label[r[8]] for r in part], np.int64))

        for at, (one, left) in enumerate(sorted(bands.items())):
            for two, right in sorted(bands.items())[at:]:
                if (i != j and one[1] == two[1]) or 100 * max(r[6] for r in left) < percent * min(r[6] for r in right):
                    continue
                t = tree(left, one[0])
                for x, y in walk(t, t if left is right else tree(right, one[0]), percent):
                    yield from ((left[p], right[q]) for p, q in zip(x.tolist(), y.tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: dict[tuple, None] = {}

        def flushed() -> pa.RecordBatch:
            part = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)], names=["a", "b"])
            out.clear()
            return part

        def close() -> Iterator[pa.RecordBatch]:
            if len(group) > 1 and len({r[8] for r in group}) > 1:
                for p, q in pairs(group, group[0][1], group[0][2]):
                    out[(p[4], q[4]) if (p[5], p[4]) < (q[5], q[4]) else (q[4], p[4])] = None
                    if len(out) >= 10_000:
                        yield flushed()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group and group[0][:3] != r[:3]:
                    yield from close()
                    group = []
                group.append(r)
        yield from close()
        yield flushed()

    return rows.mapInArrow(run, "a binary, b binary").distinct()


def jaccard_components(documents: DataFrame, *, k: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when 100 |A & B| >= percent |A or B|."""
    if not 0 < percent <= 100 or k < 1:
        raise ValueError("percent must be in 1..100 and k positive")
    docs = merged(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shapes, level = _scan(docs, k)
    classes = _classes(docs, k, percent, level)

    # each class with the least class that shares one of its least hashes
    low = classes.select("digest", "id", F.explode("low").alias("key"))
    hub = low.groupBy("key").agg(F.min(F.struct("id", "digest")).alias("h"), F.count("*").alias("c")).filter("c > 1").select("key", F.col("h.digest").alias("a"))
    near = stored(low.join(hub, "key").filter("digest != a").select("a", F.col("digest").alias("b")).distinct(), "near")
    pairs = _near_bound(near, classes, percent)
    links = _verified(docs, pairs, k, percent)
    forget(near, pairs)

    # labels: the least hub a class was linked with, then that hub's own
    own = links.groupBy(F.col("v").alias("digest")).agg(F.min("u").alias("l"))
    label = stored(own.join(own.select(F.col("digest").alias("l"), F.col("l").alias("l2")), "l", "left").select("digest", F.coalesce("l2", "l").alias("label")), "labels")
    known = classes.select("digest", "id", "n", "sig", "prefix").join(label, "digest", "left").withColumn("label", F.coalesce("label", "digest"))

    # hashes under which classes of more than one label meet; 64 bits of a label, as of a shingle, keep the shuffle of all prefixes small
    meet = stored(known.select(F.xxhash64("label").alias("label"), F.explode("prefix").alias("key")).groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("c")).filter("x != y").select("key", F.ceil(F.col("c") / CELL).cast("int").alias("deal")), "meet")
    wanted = _bloom(meet, "key")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(b.schema.get_field_index("prefix"))
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(b.num_rows), np.diff(keys.offsets.to_numpy()))
            ok = wanted(flat)
            some = pa.array(owner[ok])
            small = pa.array([folded(np.frombuffer(x, np.uint64)[None], WIDTH).tobytes() for x in b.column(b.schema.get_field_index("sig")).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(flat[ok]), small.take(some), *(b.column(b.schema.get_field_index(c)).take(some) for c in ("digest", "id", "n", "label"))], names=["key", "sig", "digest", "id", "n", "label"])

    hot = meet.filter("deal > 1")  # the few dealt out; other rows need no look at the table
    rows = known.mapInArrow(spread, "key long, sig binary, digest binary, id long, n long, label binary").join(hot, "key", "left")
    rows = rows.withColumn("deal", F.coalesce("deal", F.lit(1))).withColumn("side", F.pmod(F.hash("digest"), F.col("deal")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("deal") - 1)))
    rows = rows.select("key", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"), "side", "digest", "id", "n", "sig", "label")
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = stored(_meetings(rows, percent), "near")
    forget(meet, label)
    pairs = _near_bound(near, classes, percent)
    more = _verified(docs, pairs, k, percent)
    forget(near, pairs)
    groups = components(links.union(more))
    forget(links, more)
    least = groups.withColumnRenamed("node", "digest").join(classes.select("digest", "id"), "digest")
    ids = least.groupBy("label").agg(F.min(F.when(F.col("id") != NO_ID, F.col("id"))).alias("c"))
    grouped = stored(classes.select("digest", "id").join(groups.withColumnRenamed("node", "digest"), "digest", "left").join(ids, "label", "left").select("digest", F.coalesce("c", F.when(F.col("id") != NO_ID, F.col("id"))).alias("c")), "grouped")
    forget(classes)
    out = shapes.filter("digest is not null").join(grouped, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))
    return merged(out.union(shapes.filter("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))), docs)
