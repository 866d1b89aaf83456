"""A hashed maximum-entropy language model with a class-factored softmax.

``P(w | h) = P(class(w) | h) P(w | class(w), h)``.  A word's class comes from its
bytes: its first and last bytes fall into one of ``KEYS`` keys, and keys are
clustered by the keys that stand beside them in the training texts.

* The softmax over classes has weights for hashed n-gram and skip features of the
  three classes before; it is trained by gradient steps whose gradients are
  computed on the executors from counts of all training contexts.
* The softmax over a class's words starts from their relative frequencies and has
  a weight for each kept pair of a context and a word.  A token's context is the
  word before it (an n-gram feature), or, where that is rare, the word before
  that (a skip feature).  Kept are all pairs that occur ``LEAST`` times or more.
  A word whose pair has no weight needs no term of its own, so
  the normalizer of a context and class is 1 plus a sum over its kept pairs.
  Groups of pairs that share a normalizer are trained by gradient steps of their
  own, all over the cluster.

The share of a class's words seen once goes to the one symbol that stands for all unseen
words; so the probabilities of the training words and that symbol add up to 1
after every history.  Texts are scored in batches of flat arrays, in which weights are looked up
by the hashes of pairs.

All counts cover all training texts; what is counted grows with them.  What reaches every task has a
fixed bound: class weights, at most ``FREQUENT`` words' counts, ``VOCABULARY`` words
that pairs are made of, ``FEATURES`` weights of pairs, the commonest, and the normalizers of all groups, of which there are 2 x ``CONTEXTS`` x
``CLASSES`` at most.  Counts of all other words are joined in a shuffle, one row a document and word.  Counts of
pairs, and tokens whose pair has a weight elsewhere, go through shuffles in packed blocks of sorted
numbers.  Words are told apart by 64-bit hashes.

Defined results: null and empty texts consist of the end token; without training
texts all words are unseen; repeated rows count, and are scored, each; null
``learn`` counts as false; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phenolith.llm.kernel import NONSPACE, Words, mix, release, slices, words
from phenolith.llm.runtime import forget, stored
from phenolith.llm.sigtree import _bloom as bloom

KEYS, CLASSES, ROWS, FREQUENT = 512, 32, 1 << 13, 1 << 20
#: Words of pairs at most and their least count, words that are contexts at most and theirs, weights and normalizers that reach every task, and the least count of a pair.
VOCABULARY, WORTH, CONTEXTS, CONTEXT, FEATURES, LEAST = 1 << 16, 8, 1 << 14, 32, 1 << 21, 3
#: Gradient steps, their length, and the variance of the weights' prior.
STEPS, RATE, PRIOR = 24, 0.125, 0.3
#: The same of the weights of pairs.
WORD_STEPS, WORD_PRIOR = 40, 3.0
END = np.uint64(0xE2D0E2D0E2D0E2D1)
_STEP = 1 << 21
#: Entries that a task holds before it deals them out in packed blocks.
_BLOCK = 1 << 20
#: Bits of a code (_code) that tell a group's words apart.
_WORD = 20


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, key, text) of each token, texts ending with the end token (key KEYS)."""
    n, texts = len(w.hash), len(w.first) - 1
    at = np.arange(n) + w.doc
    end = w.first[1:] + np.arange(texts)
    h, key, doc = np.empty(n + texts, np.uint64), np.empty(n + texts, np.int64), np.empty(n + texts, np.int64)
    h[at], h[end] = w.hash, END
    if n:
        d = w.data.astype(np.uint64)
        last, first = w.end - 1, w.start
        edge = d[first] | d[np.minimum(first + 1, last)] << np.uint64(8) | d[last] << np.uint64(16) | d[np.maximum(last - 1, first)] << np.uint64(24)
        key[at] = (mix(edge) % np.uint64(KEYS)).astype(np.int64)
    key[end] = KEYS
    doc[at], doc[end] = w.doc, np.arange(texts)
    return h, key, doc


def histories(c: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The three classes before each token as one number; before a text stands the end's class."""
    out = np.zeros(len(c), np.int64)
    for back in (1, 2, 3):
        prev = np.full(len(c), CLASSES - 1)
        same = doc[back:] == doc[:-back]
        prev[back:][same] = c[:-back][same]
        out = out * CLASSES + prev
    return out


def _features() -> np.ndarray:
    """Hashed features of every history: n-grams and skips of the three classes before it."""
    h = np.arange(CLASSES**3, dtype=np.uint64)
    c = np.uint64(CLASSES)
    one, two, three = h // (c * c), h // c % c, h % c
    kinds = [np.zeros_like(h), one, two, three, one * c + two, one * c + three, two * c + three, h]
    return np.stack([(mix(x * np.uint64(16) + np.uint64(i + 1)) % np.uint64(ROWS)).astype(np.int64) for i, x in enumerate(kinds)], 1)


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


class Lookup:
    """Places of 64-bit keys among sorted ones, found by way of their leading bits."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = int(np.clip(len(keys).bit_length(), 1, 22))
        self.start = np.full((1 << self.bits) + 1, len(keys), np.int32)
        for a in range(0, 1 << self.bits, 1 << 16):  # in pieces: the driver's memory is small
            edge = np.arange(a, min(a + (1 << 16), 1 << self.bits), dtype=np.uint64) << np.uint64(64 - self.bits)
            self.start[a : a + len(edge)] = np.searchsorted(keys, edge)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for those that aren't there."""
        out = np.full(len(h), -1, np.int64)
        cell = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.start[cell], self.start[cell + 1]
        open_ = np.flatnonzero(at < stop)
        at, stop, h = at[open_], stop[open_], h[open_]
        while len(open_):
            hit = self.keys[at] == h
            out[open_[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < stop))
            open_, at, stop, h = open_[more], at[more] + 1, stop[more], h[more]
        return out


@dataclass
class Vocabulary:
    """Words that pairs are made of."""

    find: Lookup
    counts: np.ndarray
    classes: np.ndarray
    least: int  # count of a word that can be a context

    def contexts(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each token's word, its context), -1 where there is none: twice the place of the word
        before, or where that is rare one more than twice that of the word before it."""
        word = self.find(h)
        good = (word >= 0) & (self.counts[word] >= self.least) if len(self.counts) else np.zeros(len(h), bool)
        out = np.full(len(h), -1, np.int64)
        for back in (2, 1):
            some = np.flatnonzero((doc[back:] == doc[:-back]) & good[:-back]) if len(h) > back else np.zeros(0, np.int64)
            out[some + back] = 2 * word[some] + back - 1
        return word, out


def _pair(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return context << 20 | word


def _hashed(code: np.ndarray) -> np.ndarray:
    return mix(code.astype(np.uint64) + np.uint64(1))


def _code(context: np.ndarray, c: np.ndarray, word: np.ndarray) -> np.ndarray:
    """A pair and its class as one number, in which the group of context and class leads; word -1 is the group itself."""
    return (context << 5 | c) << _WORD | (word + 1)


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers from 0 on, the first one sorted, compressed: of the first its steps, of each the bytes of one place together."""
    head, planes = [len(columns[0])], []
    for i, x in enumerate(columns):
        x = np.diff(x, prepend=0) if i == 0 else x
        head.append((int(x.max(initial=0)).bit_length() + 7) // 8)
        planes.append(x.astype("<i8").view(np.uint8).reshape(-1, 8).T[: head[-1]].tobytes())
    return np.array(head, "<i4").tobytes() + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    n, *widths = np.frombuffer(data, "<i4", columns + 1).tolist()
    raw, out, at = np.frombuffer(pa.decompress(data[4 * (columns + 1) :], n * sum(widths), "zstd"), np.uint8), [], 0
    for i, width in enumerate(widths):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = raw[at : at + n * width].reshape(width, n).T
        at += n * width
        x = x.view("<i8").ravel()
        out.append(np.cumsum(x) if i == 0 else x)
    return out


def _deal(kind: int, key: np.ndarray, code: np.ndarray, other: np.ndarray, parts: int) -> pa.RecordBatch:
    """(part, kind, data): the codes and what goes with them, packed for each part that their keys fall into."""
    to = (mix(key.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((code, to))
    to, code, other = to[order], code[order], other[order]
    here, first = np.unique(to, return_index=True)
    stop = np.append(first, len(to))[1:]
    data = [_pack(code[a:b], other[a:b]) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(np.full(len(here), kind, np.int8)), pa.array(data, pa.binary())], names=["part", "kind", "data"])


_DEALT = "part int, kind byte, data binary"


def _parts(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all lists, sorted, each with the sum of its numbers."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, inverse = np.unique(np.concatenate([p[0] for p in held]), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate([p[1] for p in held]), len(code)).astype(np.int64)


def _values(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values at places, 0 at place -1."""
    return np.where(at >= 0, values[at], 0) if len(values) else np.zeros(len(at))


@dataclass
class Model:
    classes: np.ndarray  # of each key, the end's key last
    log_class: np.ndarray  # log10 P(class | history)
    log_unseen: np.ndarray  # log10 P(unseen | history)
    log_share: np.ndarray  # log10 of (1 - unseen share) / class total
    frequent_words: Lookup
    counts: np.ndarray
    least: int  # level of counts (_level) from which words are among the frequent ones
    total: int
    distinct: int
    vocabulary: Vocabulary
    pairs: Lookup  # of hashed pairs
    weight: np.ndarray  # log10 of each pair's factor
    groups: Lookup  # of hashed contexts and classes
    norm: np.ndarray  # log10 of each group's normalizer

    def frequent(self, h: np.ndarray) -> np.ndarray:
        """Counts of frequent words; 0 for others."""
        at = self.frequent_words(h)
        return np.where(at >= 0, self.counts[at], 0) if len(self.counts) else np.zeros(len(h), np.int64)

    def context_factor(self, h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """log10 of what the context makes of each word's probability within its class, by the weights that are here."""
        return self.context_factors(h, c, doc)[0]

    def context_factors(self, h: np.ndarray, c: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the tokens whose group has weights, but whose pair has none here, with their codes."""
        out = np.zeros(len(h))
        word, context = self.vocabulary.contexts(h, doc)
        some = np.flatnonzero((word >= 0) & (context >= 0))
        context, c, word = context[some], c[some], word[some]
        group, pair = self.groups(_hashed(context << 5 | c)), self.pairs(_hashed(_pair(context, word)))
        out[some] = _values(self.weight, pair) - _values(self.norm, group)
        rest = (group >= 0) & (pair < 0)
        return out, some[rest], _code(context[rest], c[rest], word[rest])


def _level(c: Column) -> Column:
    """Counts in some ten thousand levels at most, in their order: small ones each their own."""
    return F.when(c < 4096, c).otherwise(4096 + F.floor((F.log2(c) - 12) * 256)).cast("int")


def _commonest(table: DataFrame, count: str, most: int, least: int = 1) -> int:
    """The lowest level, at least that of ``least``, from which there are ``most`` rows at most."""
    level, have = _level(F.col(count)), 0
    low = 1 << 30
    for r in sorted(table.filter(F.col(count) >= least).groupBy(level.alias("l")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if have + r.n > most:
            break
        have += r.n
        low = r.l
    return low


def _sparse(counts: np.ndarray, names: list[str]) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=names)


def count(train: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(h, key, c) of all training tokens, and how often one key follows another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, k = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        beside = np.zeros((KEYS + 1) ** 2, np.int64)
        parts: list[tuple] = []

        def merged() -> tuple:
            hs, cs, ks = (np.concatenate([p[i] for p in parts]) for i in range(3))
            u, first, inverse = np.unique(hs, return_index=True, return_inverse=True)
            return u, np.bincount(inverse, cs, len(u)).astype(np.int64), ks[first]

        def words_out(p: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(p[0]), np.int32)), pa.array(p[0].view(np.int64)), pa.array(p[2]), pa.array(p[1])], names=["kind", "h", "key", "c"])

        for b in slices(batches, "text", _STEP):
            h, key, doc = tokens(words(b.column(0), NONSPACE))
            u, first, n = np.unique(h, return_index=True, return_counts=True)
            parts.append((u, n, key[first]))
            same = doc[1:] == doc[:-1]
            beside += np.bincount(key[:-1][same] * (KEYS + 1) + key[1:][same], minlength=len(beside))
            if sum(len(p[0]) for p in parts) > 2_000_000:
                parts = [merged()]
                if len(parts[0][0]) > 1_000_000:
                    yield words_out(parts.pop())
        if parts:
            yield words_out(merged())
        at = np.flatnonzero(beside)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.array(at), pa.array(np.zeros(len(at), np.int64)), pa.array(beside[at])], names=["kind", "h", "key", "c"])

    raw = train.select("text").mapInArrow(run, "kind int, h long, key long, c long")
    table = stored(raw.groupBy("kind", "h").agg(F.max("key").alias("key"), F.sum("c").alias("c")), "counts")
    cells = table.filter("kind = 1").select("h", "c").toPandas()  # at most (KEYS + 1)**2
    beside = np.zeros((KEYS + 1) ** 2)
    beside[cells["h"].to_numpy(np.int64)] = cells["c"].to_numpy(float)
    return table.filter("kind = 0").select("h", "key", "c"), beside.reshape(KEYS + 1, KEYS + 1)


def cluster(beside: np.ndarray, seed: int = 3) -> np.ndarray:
    """A class for each key, by k-means on what stands before and after it; the end is a class of its own."""
    total = beside.sum()
    if not total:
        return np.append(np.arange(KEYS) % (CLASSES - 1), CLASSES - 1)
    left, right = beside.sum(1, keepdims=True), beside.sum(0, keepdims=True)
    lift = np.log((beside + 0.5) * total / ((left + 1) * (right + 1)))
    lift = np.clip(lift, -3, 3) * np.sqrt(np.minimum(1, (left + 1) * (right + 1) / total / 4))
    both = np.concatenate([lift[:KEYS], lift[:, :KEYS].T], 1)
    u, s, _ = np.linalg.svd(both - both.mean(0), full_matrices=False)
    x = u[:, :12] * s[:12]
    weight = np.sqrt(beside.sum(0)[:KEYS] + 1)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(KEYS, CLASSES - 1, replace=False, p=weight / weight.sum())]
    for _ in range(40):
        near = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for k in range(CLASSES - 1):
            if (m := near == k).any():
                centre[k] = np.average(x[m], axis=0, weights=weight[m])
    return np.append(near, CLASSES - 1)


def contexts(train: DataFrame, classes: np.ndarray, vocabulary: Vocabulary) -> DataFrame:
    """(kind, code, v, n) over all training tokens: kind 0, counts of histories with classes; kind 1, groups of a context and a class
    with their normalizers and counts; kind 2, pairs that occur ``LEAST`` times or more, with their weights and counts.

    Counts of pairs are dealt out by group in packed blocks, so the task that sums them has whole groups and trains their weights."""
    parts = _parts(train)
    within = np.bincount(vocabulary.classes, vocabulary.counts, CLASSES)
    share = vocabulary.counts / np.maximum(within[vocabulary.classes], 1)
    shared = train.sparkSession.sparkContext.broadcast((classes, vocabulary))
    shares = train.sparkSession.sparkContext.broadcast(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, vocabulary = shared.value
        cells = np.zeros(CLASSES**4, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out = lambda code, n: _deal(2, code >> _WORD, code, n, parts)
        for b in slices(batches, "text", _STEP):
            h, key, doc = tokens(words(b.column(0), NONSPACE))
            c = classes[key]
            cells += np.bincount(histories(c, doc) * CLASSES + c, minlength=len(cells))
            word, context = vocabulary.contexts(h, doc)
            some = (word >= 0) & (context >= 0)
            held.append(np.unique(_code(context[some], c[some], word[some]), return_counts=True))
            if sum(len(p[0]) for p in held) > 2 * _BLOCK:
                held = [_summed(held)]
                if len(held[0][0]) > _BLOCK:
                    yield out(*held.pop())
        if held:
            yield out(*_summed(held))
        at = np.flatnonzero(cells)
        yield _deal(0, at // CLASSES, at, cells[at], parts)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {0: [], 2: []}
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                held[kind].append(tuple(_unpack(data, 2)))
        out = lambda kind, code, v, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(code), kind, np.int8)), pa.array(code), pa.array(v.astype(np.float32)), pa.array(n)], names=["kind", "code", "v", "n"])
        code, n = _summed(held.pop(0))
        yield out(0, code, np.zeros(len(code)), n)
        code, n = _summed(held.pop(2))
        group, of = np.unique(code >> _WORD, return_inverse=True)
        total, kept = np.bincount(of, n, len(group)).astype(np.int64), n >= LEAST
        code, n, of = code[kept], n[kept], of[kept]
        some, of = np.unique(of, return_inverse=True)
        group, total = group[some], total[some]
        weight, norm = train_words(shares.value[(code & ((1 << _WORD) - 1)) - 1], of, n, total)
        yield out(1, group << _WORD, norm / np.log(10), total)
        yield out(2, code, weight / np.log(10), n)

    raw = train.select("text").mapInArrow(run, _DEALT)
    return stored(raw.repartitionById(parts, F.col("part")), "weights", summed, "kind byte, code long, v float, n long")


def train_words(share: np.ndarray, of: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights of pairs, logarithms of their groups' normalizers) from the words' shares of their classes, the
    pairs' groups and counts, and the groups' counts.  Gradient steps go for all groups at once; a group's
    expected counts come from its own normalizer."""
    weight = np.zeros(len(share))
    norm = lambda: 1 + np.bincount(of, share * np.expm1(weight), len(total))
    for _ in range(WORD_STEPS):
        expected = total[of] * share * np.exp(weight) / norm()[of]
        weight += np.clip((n - expected - weight / WORD_PRIOR) / (np.maximum(n, expected) + 1 / WORD_PRIOR), -1, 1)
    return weight, np.log(norm())


def _lookups(weights: DataFrame) -> tuple[Lookup, np.ndarray, Lookup, np.ndarray]:
    """(pairs, their weights, groups, their normalizers) as tasks look them up."""
    out = []
    for kind in (2, 1):
        table = weights.filter(F.col("kind") == kind).select("code", "v").toArrow()
        code, v = (c.to_numpy() for c in table.columns)
        del table
        group = code >> _WORD
        h = _hashed(_pair(group >> 5, (code & ((1 << _WORD) - 1)) - 1) if kind == 2 else group)
        order = np.argsort(h)
        out += [Lookup(h[order]), v[order]]
        del code, v, group, h, order
        release()
    return tuple(out)


def _beyond(weights: DataFrame, packed: DataFrame, parts: int) -> DataFrame:
    """(row, x): sums of the weights of packed tokens, each token meeting its pair in the part of its group."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = b.column(0).to_numpy()
            yield _deal(0, code >> _WORD, code, b.column(1).to_numpy().view(np.uint32).astype(np.int64), parts)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, code = [], None
        for b in batches:
            for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if kind == 0:  # weights come first
                    held.append(_unpack(data, 2))
                    continue
                if code is None:
                    code, bits = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in held)]) for i in range(2))
                    order = np.argsort(code)
                    code, weight = code[order], bits[order].astype(np.uint32).view(np.float32)
                    held.clear()
                want, row = _unpack(data, 2)
                at = np.searchsorted(code, want)
                hit = np.flatnonzero(at < len(code))
                hit = hit[code[at[hit]] == want[hit]]
                rows, of = np.unique(row[hit], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(of, weight[at[hit]], len(rows)).astype(float))], names=["row", "x"])

    both = weights.select("code", "v").mapInArrow(dealt, _DEALT).union(packed)
    return both.repartitionById(parts, F.col("part")).sortWithinPartitions("kind").mapInArrow(meet, "row long, x double").groupBy("row").agg(F.sum("x").alias("x"))


def step(weight: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """A gradient step of class weights under their prior, each by its own curvature.

    What pulls a weight up and what pulls it down are counts and the prior; their difference is divided by the larger.
    So no weight moves by more than ``RATE``, and, with 1 / ``RATE`` features a history, by less than iterative scaling
    would move it: no step makes the training texts less likely under the prior, however large the counts are."""
    up, down = observed + np.maximum(-weight, 0) / PRIOR, expected + np.maximum(weight, 0) / PRIOR
    return RATE * (up - down) / (np.maximum(up, down) + 1 / PRIOR)


def train_classes(cells: DataFrame) -> np.ndarray:
    """log P(class | history) by gradient steps over the distributed counts of contexts."""
    sc = cells.sparkSession.sparkContext
    weight = np.zeros((ROWS, CLASSES))
    totals = {r["class"]: r.n for r in cells.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    n = sum(totals.values())
    if not n:
        return np.full((CLASSES**3, CLASSES), -np.log(CLASSES))
    features = _features()
    weight[features[0, 0]] = np.log([(totals.get(k, 0) + 0.5) / (n + CLASSES / 2) for k in range(CLASSES)])
    # a row for each history, CLASSES**3 at most, dealt to four parts; each returns one matrix a step
    parts = stored(cells.groupBy("history").pivot("class", list(range(CLASSES))).agg(F.sum("n")).repartition(4), "cells")

    def summed(weight: np.ndarray | None) -> np.ndarray:
        """How often each feature goes with each class: as counted (None), or as the weights expect it."""
        shared = sc.broadcast(weight)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], 1) for b in batches if b.num_rows]
            both = np.nan_to_num(np.concatenate(rows)) if rows else np.zeros((0, 1 + CLASSES))
            seen, value, f = both[:, 0].astype(np.int64), both[:, 1:], _features()
            if shared.value is not None:
                value = np.exp(_log_softmax(shared.value[f[seen]].sum(1))) * value.sum(1, keepdims=True)
            out, column = np.zeros(ROWS * CLASSES), np.arange(CLASSES)
            for i in range(f.shape[1]):
                out += np.bincount((f[seen, i][:, None] * CLASSES + column).ravel(), value.ravel(), len(out))
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary())], names=["v"])

        out = sum(np.frombuffer(r.v, np.float32).reshape(ROWS, CLASSES).astype(float) for r in parts.mapInArrow(run, "v binary").collect())
        shared.unpersist()
        return out

    try:
        observed = summed(None)
        for _ in range(STEPS):
            weight = weight + step(weight, observed, summed(weight))
    finally:
        forget(parts)
    return _log_softmax(weight[features].sum(1))


def _words(table: DataFrame, level: int) -> tuple[Lookup, np.ndarray, np.ndarray]:
    """(words from a level of counts on, their counts, their keys)."""
    got = table.filter(_level(F.col("c")) >= level).select("h", "c", "key").toArrow()
    h = got.column(0).to_numpy().view(np.uint64)
    order = np.argsort(h)
    return Lookup(h[order]), got.column(1).to_numpy()[order], got.column(2).to_numpy()[order].astype(np.int32)


def fit(train: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and the counts of all words."""
    return learn_from(train)[:2]


def learn_from(train: DataFrame) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model, the counts of all words, and the weights of pairs that the model doesn't hold, if there are any."""
    table, beside = count(train)
    classes = cluster(beside)
    find, counts, keys = _words(table, _commonest(table, "c", VOCABULARY, WORTH))
    commonest = np.sort(counts)[::-1][CONTEXTS : CONTEXTS + 1]
    vocabulary = Vocabulary(find, counts, classes[keys], max(CONTEXT, int(commonest[0]) + 1 if len(commonest) else 0))
    made = contexts(train, classes, vocabulary)
    cells = made.filter("kind = 0").select((F.col("code") / CLASSES).cast("long").alias("history"), (F.col("code") % CLASSES).alias("class"), "n")
    log_class = train_classes(cells)
    level = _commonest(made.filter("kind = 2"), "n", FEATURES)
    pairs, weight, groups, norm = _lookups(made.filter((F.col("kind") == 1) | (F.col("kind") == 2) & (_level(F.col("n")) >= level)))
    others = made.filter((F.col("kind") == 2) & (_level(F.col("n")) < level))
    if others.isEmpty():
        forget(made)
        others = None
    by_key = table.groupBy("key").agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("once"), F.count("*").alias("words")).collect()
    n, once, kinds = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_key:
        k = classes[r.key]
        n[k], once[k], kinds[k] = n[k] + r.n, once[k] + r.once, kinds[k] + r.words
    unseen = np.clip((once + 0.1) / (n + 1), 1e-9, 0.9)
    unseen[n == 0] = 1.0
    unseen[CLASSES - 1] = 1e-12 if n[CLASSES - 1] else 1.0
    least = _commonest(table, "c", FREQUENT)
    often, counts, _ = _words(table, least)
    release()
    p = np.exp(log_class)
    with np.errstate(divide="ignore"):
        share = np.where(n > 0, np.log10((1 - unseen) / np.maximum(n, 1)), 0.0)
    model = Model(classes, (log_class / np.log(10)).astype(np.float32), np.log10(p @ unseen).astype(np.float32), share, often, counts, least, int(n.sum()), int(kinds.sum()), vocabulary, pairs, weight, groups, norm)
    return model, table, others


def score(documents: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, learn, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(learn, F.lit(False)).alias("learn"))
    model, table, others = learn_from(docs.filter("learn").select("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    elsewhere: Callable[[np.ndarray], np.ndarray] | None = None if others is None else bloom(others, "code")
    parts = _parts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        scale = np.log10(m.total + 0.1 * (m.distinct + 1))
        held: list[tuple[np.ndarray, np.ndarray]] = []  # codes and rows of tokens whose pair has a weight elsewhere
        schema = None

        def dealt() -> pa.RecordBatch:
            code, row = (np.concatenate([p[i] for p in held]) for i in range(2))
            held.clear()
            got = _deal(1, code >> _WORD, code, row, parts)
            return pa.RecordBatch.from_arrays([*(pa.nulls(got.num_rows, t) for t in schema.types[:-3]), *got.columns], schema=schema)

        for b in slices(batches, "text"):
            texts = b.num_rows
            h, key, doc = tokens(words(b.column(1), NONSPACE))
            c = m.classes[key]
            history = histories(c, doc)
            seen = m.frequent(h)
            factor, out, code = m.context_factors(h, c, doc)
            known = m.log_class[history, c].astype(float) + m.log_share[c] + factor
            often = seen > 0
            add = lambda x, at: np.bincount(doc[at], x[at], texts).astype(float)  # noqa: E731  integers where nothing is added
            value = known.copy()
            value[often] += np.log10(seen[often])
            base = np.log10(seen + 0.1) - scale
            r = np.flatnonzero(~often)
            order = r[np.lexsort((h[r], doc[r]))]
            new = np.ones(len(order), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
            first = np.flatnonzero(new)
            sums = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
            offsets = pa.array(np.searchsorted(doc[order][first], np.arange(texts + 1)), pa.int32())
            many = lambda x: pa.ListArray.from_arrays(offsets, pa.array(x))
            if elsewhere is not None and (ok := np.flatnonzero(elsewhere(code))).size:
                held.append((code[ok], b.column(3).to_numpy()[doc[out[ok]]]))
            got = pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), pa.array(np.bincount(doc, minlength=texts)), pa.array(np.bincount(doc[often], minlength=texts)), pa.array(add(base, often)), pa.array(add(value, often)), many(h[order][first].view(np.int64)), many(sums(np.ones(len(order), np.int64))), many(sums(known[order])), many(sums(m.log_unseen[history[order]].astype(float))), pa.nulls(texts, pa.int32()), pa.nulls(texts, pa.int8()), pa.nulls(texts, pa.binary())],
                names=["doc_id", "learn", "row", "n_tokens", "n_known", "base", "value", "h", "n", "known", "unseen", "part", "kind", "data"],
            )
            schema = got.schema
            yield got
            if sum(len(p[0]) for p in held) > _BLOCK:
                yield dealt()
        if held:
            yield dealt()

    kinds = "doc_id long, learn boolean, row long, n_tokens long, n_known long, base double, value double, h array<long>, n array<long>, known array<double>, unseen array<double>"
    made = stored(docs.withColumn("row", F.monotonically_increasing_id()), "scores", run, f"{kinds}, {_DEALT}")  # rows of documents, and packed tokens
    part = made.filter("kind is null")
    rare = part.select("row", F.explode(F.arrays_zip("h", "n", "known", "unseen")).alias("x")).select("row", "x.*")
    if len(model.counts) < model.distinct:  # words beyond the frequent ones are looked up in a join
        rare = rare.join(table.filter(_level(F.col("c")) < model.least).select("h", "c"), "h", "left")
    else:
        rare = rare.withColumn("c", F.lit(None).cast("long"))
    scale = float(np.log10(model.total + 0.1 * (model.distinct + 1)))
    found = rare.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNull(), 0).otherwise(F.col("n"))).alias("k"),
        F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1)) - F.lit(scale))).alias("b"),
        F.sum(F.when(F.col("c").isNull(), F.col("unseen")).otherwise(F.col("known") + F.col("n") * F.log10("c"))).alias("v"),
    )
    if others is not None:
        found = found.join(_beyond(others, made.filter("kind is not null").select("part", "kind", "data"), parts), "row", "full")
    else:
        found = found.withColumn("x", F.lit(0.0))
    zero = lambda name, kind: F.coalesce(name, F.lit(0).cast(kind))
    return part.select("row", "doc_id", "learn", "n_tokens", "n_known", "base", "value").join(found, "row", "left").select("doc_id", "learn", "n_tokens", (F.col("n_known") + zero("k", "long")).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), (F.col("base") + zero("b", "double")).alias("base_score"), (F.col("value") + zero("v", "double") + zero("x", "double")).alias("score"))
