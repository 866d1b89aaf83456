"""Benchmark decontamination by winnowing.

Each text's words give k-gram hashes; of every ``window - k + 1`` consecutive
ones the smallest is kept (all of them on a tie), so the choice depends on the
window's words alone and two texts that share ``window`` consecutive words
share a kept hash.  Kept hashes of documents meet those of benchmark items, and
each meeting is extended left and right, word by word, up to the window; spans
of ``window`` words or more are hits.  The words' bytes are compared before a
hit counts.  Items shorter than the window are looked up whole.

The benchmark side goes to every task only while its texts stay under
``max_broadcast_bytes``; beyond that fingerprints meet in a shuffled join.

Defined results: a null or empty text has no words (0, 0, 0 and not
contaminated); an item without words or without an id has no windows; repeated
rows each get their row; an empty benchmark hits nothing; other columns of the
inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenolith.llm.kernel import ALNUM, Words, expand, grams, rolling, slices, words

K = 5
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
MAX_BROADCAST = 32 << 20


def winnow(h: np.ndarray, first: np.ndarray, window: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept k-grams of texts laid end to end."""
    g = grams(h, k)
    span = window - k + 1
    if len(h) < window:
        return np.zeros(0, np.int64), g[:0]
    low = rolling(g, span, np.minimum)
    at = np.arange(len(low))
    owner_end = first[1:][np.searchsorted(first[1:], at, "right")]
    low = np.where(at + window <= owner_end, low, np.uint64(0))  # windows over a text's end keep nothing
    pad = np.zeros(span - 1, np.uint64)
    best = rolling(np.concatenate((pad, low, pad)), span, np.maximum)
    kept = np.flatnonzero((best == g) & (best > 0))
    return kept, g[kept]


class Index:
    """Benchmark items: word hashes end to end, kept k-grams, and whole short items."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, k: int = K):
        self.window, self.k = window, k
        w = words(pa.array(texts, pa.large_string()), ALNUM)
        self.ids, self.hash, self.first = ids, w.hash, w.first
        self.bytes_of = w.bytes_of
        self.item = w.doc
        at, fp = winnow(w.hash, w.first, window, k) if len(w.hash) else (np.zeros(0, np.int64), w.hash)
        order = np.argsort(fp, kind="stable")
        self.fp, self.fp_at = fp[order], at[order]
        size = np.diff(w.first)
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({int(x) for x in size if 0 < x < window}):
            at = w.first[:-1][size == n]
            g = grams(w.hash, n)[at]
            order = np.argsort(g, kind="stable")
            self.short[n] = g[order], at[order]
        self.filter = {0: self._bits(self.fp)} | {n: self._bits(g) for n, (g, _) in self.short.items()}

    @staticmethod
    def _bits(h: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 16, bool)
        out[(h & np.uint64(0xFFFF)).astype(np.int64)] = True
        return out

    def _meet(self, h: np.ndarray, n: int, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, benchmark position) of all equal hashes."""
        maybe = np.flatnonzero(self.filter[n][(h & np.uint64(0xFFFF)).astype(np.int64)])
        lo = np.searchsorted(keys, h[maybe], "left")
        count = np.searchsorted(keys, h[maybe], "right") - lo
        owner, element = expand(lo, count)
        return maybe[owner], at[element]

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, past the last word, item) of each shared span in the documents' words."""
        spans: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        end_of = w.first[1:]
        if len(self.fp):
            at, fp = winnow(w.hash, w.first, self.window, self.k)
            which, j = self._meet(fp, 0, self.fp, self.fp_at)
            p = at[which]
            doc = np.searchsorted(end_of, p, "right")
            item = self.item[j]
            left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for reach, step, lo, hi, jlo, jhi in ((left, -1, w.first[doc], None, self.first[item], None), (right, 1, None, end_of[doc], None, self.first[item + 1])):
                alive = np.ones(len(p), bool)
                for s in range(1, self.window - self.k + 1):
                    x, y = (p - s, j - s) if step < 0 else (p + self.k - 1 + s, j + self.k - 1 + s)
                    alive &= (x >= lo) & (y >= jlo) if step < 0 else (x < hi) & (y < jhi)
                    alive[alive] = w.hash[x[alive]] == self.hash[y[alive]]
                    reach += alive
                    if not alive.any():
                        break
            good = left + right + self.k >= self.window
            spans.append((p[good] - left[good], p[good] + self.k + right[good], j[good] - left[good]))
        for n, (keys, where) in self.short.items():
            g = grams(w.hash, n)
            which, j = self._meet(g, n, keys, where)
            doc = np.searchsorted(end_of, which, "right")
            good = which + n <= end_of[doc] if len(which) else np.zeros(0, bool)
            spans.append((which[good], which[good] + n, j[good]))
        if not spans:
            none = np.zeros(0, np.int64)
            return none, none, none
        lo, hi, j = (np.concatenate(x) for x in zip(*spans, strict=True))
        same = np.fromiter((all(w.bytes_of(a + s) == self.bytes_of(c + s) for s in range(b - a)) for a, b, c in zip(lo.tolist(), hi.tolist(), j.tolist(), strict=True)), bool, len(lo))
        return lo[same], hi[same], self.item[j[same]]


def _marked(w: Words, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Number of words of each text inside any span."""
    edges = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edges, lo, 1)
    np.add.at(edges, hi, -1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))
    return inside[w.first[1:]] - inside[w.first[:-1]]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, percent: int = 5, max_broadcast_bytes: int = MAX_BROADCAST) -> DataFrame:
    """One row per document: words, words inside shared windows, and the items that share one."""
    if window < K:
        raise ValueError(f"window must be at least {K}")
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bench, shared = _bench(benchmark, max_broadcast_bytes)
    if shared is None:
        return _shuffled(docs, bench, window, percent).drop("_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value, window)
        for b in slices(batches, "text"):
            yield _judged(index, b.column(0), b.column(1), percent)

    return docs.mapInArrow(run, SCHEMA)


def clean(documents: DataFrame, benchmark: DataFrame, *, window: int = 13, percent: int = 5, max_broadcast_bytes: int = MAX_BROADCAST) -> DataFrame:
    """The rows, whole and as they are, that aren't contaminated."""
    bench, shared = _bench(benchmark, max_broadcast_bytes)
    if shared is None:
        docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        bad = _shuffled(docs, bench, window, percent).filter("contaminated").select("_key").distinct()
        key = unique_name("_key", documents.columns)
        keyed = documents.withColumn(key, _key(F.col("doc_id").cast("long"), F.col("text").cast("string")))
        return keyed.join(bad.withColumnRenamed("_key", key), key, "left_anti").select(*documents.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value, window)
        for b in slices(batches, "text"):
            id, text = (b.column(b.schema.get_field_index(c)) for c in ("doc_id", "text"))
            yield b.filter(pc.invert(_judged(index, id, text, percent).column(5)))

    return documents.mapInArrow(run, documents.schema)


def _judged(index: Index, id: pa.Array, text: pa.Array, percent: int) -> pa.RecordBatch:
    w = words(text, ALNUM)
    lo, hi, item = index.hits(w)
    n_hit, n_words = _marked(w, lo, hi), np.diff(w.first)
    found: list[set] = [set() for _ in range(len(text))]
    for d, i in zip(np.searchsorted(w.first[1:], lo, "right").tolist(), item.tolist(), strict=True):
        found[d].add(index.ids[i])
    items = [sorted(x) for x in found]
    return pa.RecordBatch.from_arrays(
        [id, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([items_digest(x) for x in items], pa.string()), pa.array((n_hit > 0) & (100 * n_hit >= percent * n_words)), pa.array(items, pa.list_(pa.string()))],
        names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
    )


def _bench(benchmark: DataFrame, max_broadcast_bytes: int):
    """The benchmark's ids and texts, and their broadcast while they are small enough."""
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("item_text")).dropna()
    size = bench.agg(F.coalesce(F.sum(F.octet_length("item_text") + F.octet_length("item_id")), F.lit(0))).first()[0]
    if size > max_broadcast_bytes:
        return bench, None
    rows = bench.collect()  # its size was just checked
    return bench, benchmark.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.item_text for r in rows]))


def unique_name(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def _key(id: Column, text: Column) -> Column:
    """256 bits that stand for a document's id and text; a null text is as an empty one."""
    return F.sha2(F.concat_ws("\n", F.coalesce(id.cast("string"), F.lit("-")), F.coalesce(text, F.lit(""))), 256)


def _shuffled(docs: DataFrame, bench: DataFrame, window: int, percent: int) -> DataFrame:
    """The same rows when the benchmark is too large to send to every task: kept hashes
    (and whole short items) of both sides meet in a join, pairs of a document and an item that
    share one are extended on their texts."""
    keyed = docs.withColumn("_key", _key(F.col("doc_id"), F.col("text")))
    lengths = [r[0] for r in bench.select(F.size(F.regexp_extract_all(F.col("item_text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).alias("n")).filter(f"n between 1 and {window - 1}").distinct().collect()]

    def prints(text: str, key: str, of_items: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text):
                w = words(b.column(1), ALNUM)
                at, fp = winnow(w.hash, w.first, window)
                size, owner, parts = np.diff(w.first), [np.searchsorted(w.first[1:], at, "right")], [fp]
                for n in lengths:
                    g = grams(w.hash, n)
                    p = np.arange(len(g))
                    d = np.searchsorted(w.first[1:], p, "right")
                    ok = (p + n <= w.first[1:][d]) & ((size[d] == n) | (not of_items))
                    owner.append(d[ok])
                    parts.append(g[ok])
                both = np.unique(np.stack([np.concatenate(owner).astype(np.uint64), np.concatenate(parts)]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(both[0].astype(np.int64))), pa.array(both[1].view(np.int64))], names=[key, "fp"])

        return run

    left = keyed.select("_key", "text").distinct().mapInArrow(prints("text", "_key", False), "_key string, fp long")
    right = bench.select("item_id", "item_text").mapInArrow(prints("item_text", "item_id", True), "item_id string, fp long")
    pairs = left.join(right, "fp").select("_key", "item_id").distinct()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, item, text, item_text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = words(pa.array([text], pa.large_string()), ALNUM)
                lo, hi, _ = Index([item], [item_text], window).hits(w)
                at = np.unique(expand(lo, hi - lo)[1]) if len(lo) else lo
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(at), pa.string()), pa.array([item] * len(at), pa.string()), pa.array(at)], names=["_key", "item_id", "pos"])

    texts = keyed.select("_key", "text").dropDuplicates(["_key"])
    spans = pairs.join(texts, "_key").join(bench, "item_id").select("_key", "item_id", "text", "item_text").mapInArrow(extend, "_key string, item_id string, pos long")
    per_doc = spans.select("_key", "pos").distinct().groupBy("_key").agg(F.count("*").alias("n_hit"))
    per_item = spans.select("_key", "item_id").distinct().groupBy("_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(words(b.column(1), ALNUM).first))], names=["doc_id", "_key", "n_words"])

    out = keyed.mapInArrow(count, "doc_id long, _key string, n_words long").join(per_doc, "_key", "left").join(per_item, "_key", "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0))
    return out.select("_key", "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (100 * n_hit >= percent * F.col("n_words"))).alias("contaminated"), items.alias("items"))
