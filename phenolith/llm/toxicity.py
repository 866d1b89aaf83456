"""Toxicity by noisy-channel deobfuscation.

Words that may be disguised - digits, signs and separators in them, a letter
twice or more in a row, single characters set apart - are taken as noisy
observations: each sign may stand for the letters it resembles, a repeated
letter or a separator may be an insertion, and a space between single letters
may be real.  Viterbi decoding over that lattice under a character trigram model
gives the restored text.  The score is a logistic model of the words and word
beginnings of the text with its restored words put beside it.

What is learned: the character model, and the weights of at most ``FEATURES``
words and beginnings that are much commoner in toxic than in other texts, from
all labelled texts, texts that agree in two minimum hashes of their word triples
counted once.  The
character model holds the ``TRIGRAMS`` commonest trigrams of those texts; the others
count by their characters alone.  Weights are never negative, so a long clean text
gains nothing by its length.  The label, and no other column, is used.

A feature occurs in a 250th of the toxic texts or more, so there are 250 times as many
candidates as a toxic text has on average, at most: toxic texts are counted first, and all
texts are kept as places among the candidates.  Every gradient step goes over all of them,
in tasks, or on the driver if there are no more than ``LOCAL`` places of chosen features.

Defined results: null and empty texts get the score of a text without any
evidence; labels that are null, or neither 0 nor 1, are left out; a document
with several labels counts as toxic if any is 1; without training rows of both
classes every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.llm.kernel import LETTERS, NONSPACE, Words, grams, mix, slices, words
from phenolith.llm.runtime import forget, stored

FEATURES, TRIGRAMS, HEADS = 4096, 1 << 17, (4, 5, 6)
#: Places of chosen features that the driver takes, and texts whose places make a row of a table.
LOCAL, BLOCK = 1 << 22, 1 << 14
#: Labels that reach every task as pairs of numbers; more meet the texts in a shuffle.
LABELS = 1 << 22
#: Signs and the letters they may stand for.
RESEMBLES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "#": "h", "*": "aeiou", "?": "aeiou", "%": "aeiou", "&": "aeiou", "^": "a", "¡": "i", "§": "s", "¥": "y", "µ": "u",
}
SEPARATORS = set(" .-_~'`,:;/\\·•​*|+")
#: Costs in nats.
AS_READ, RESEMBLANCE, DROPPED, KEPT_SPACE, REPEAT = 0.02, 1.0, 0.3, 1.5, 0.4
_EDGE = re.compile(r"^[\s\"'().,;:?!\[\]{}<>|]+|[\s\"'().,;:?!\[\]{}<>|]+$")


class CharModel:
    """Trigrams with interpolation; ``~`` stands for characters seen too seldom."""

    def __init__(self, counts: dict[str, int]):
        self.tri: dict[str, int] = {}
        self.bi: dict[str, int] = {}
        self.uni: dict[str, int] = {}
        for g, n in counts.items():
            for table, key in ((self.tri, g), (self.tri, g[:2] + "\0"), (self.bi, g[1:]), (self.bi, g[1] + "\0"), (self.uni, g[2])):
                table[key] = table.get(key, 0) + n
        self.total = sum(self.uni.values()) or 1
        self.memo: dict[str, dict[str, float]] = {}

    def cost(self, context: str, c: str) -> float:
        known = self.memo.setdefault(context, {})
        found = known.get(c)
        if found is None:
            one = (self.uni.get(c, 0) + 0.5) / (self.total + 50)
            n2, n1 = self.tri.get(context + "\0", 0), self.bi.get(context[1] + "\0", 0)
            two = (self.bi.get(context[1] + c, 0) + 4 * one) / (n1 + 4)
            three = (self.tri.get(context + c, 0) + 4 * two) / (n2 + 4)
            found = known[c] = -math.log(three)
        return found


def trigrams(text: str) -> Iterator[str]:
    line = "  " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " "
    for i in range(len(line) - 2):
        yield line[i : i + 3]


_LETTER, _END = re.compile(r"[^\W\d_]"), "\ud800"  # no text holds a lone surrogate


def counted(texts: list[str]) -> Counter[str]:
    """How often each of ``trigrams`` occurs in the texts, by way of arrays of code points."""
    u = np.frombuffer((2 * _END + (2 * _END).join(texts) + _END).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    present = np.zeros(0x110000, bool)
    present[u] = True
    letters = [c for c in np.flatnonzero(present).tolist() if _LETTER.match(chr(c))]
    n, number = len(letters) + 1, np.zeros(0x110000, np.int64)  # 0 for what stands between words
    number[letters] = np.arange(1, n)
    x = number[u]
    keep = (x > 0) | (u == ord(_END))
    keep[1:] |= x[:-1] > 0  # one space after each word, two or more between texts
    x = x[keep]
    a, b, c = x[:-2], x[1:-1], x[2:]
    code = ((a * n + b) * n + c)[(b > 0) | (c > 0)]
    if n <= 128:
        code, total = np.flatnonzero(all_ := np.bincount(code)), all_[all_ > 0]
    else:
        code, total = np.unique(code, return_counts=True)
    sign = [" ", *map(chr, letters)]
    out = Counter({sign[g // n // n] + sign[g // n % n] + sign[g % n]: k for g, k in zip(code.tolist(), total.tolist(), strict=True)})
    if empty := sum(not _LETTER.search(t) for t in texts):
        out["   "] = empty
    return out


@lru_cache(4096)
def _readings(o: str, repeated: bool) -> tuple[tuple[str, float], ...]:
    """What a character may stand for, with the costs: itself, letters it resembles, nothing, a space."""
    options = [(o, AS_READ)] if o.isalpha() else []
    options += [(c, RESEMBLANCE) for c in RESEMBLES.get(o, "")]
    options += [("", DROPPED)] * (o in SEPARATORS) + [(" ", KEPT_SPACE)] * (o == " ") + [("", REPEAT)] * repeated
    return tuple(options or [(" ", KEPT_SPACE)])


def restore(span: str, model: CharModel) -> str:
    """The likeliest text behind a disguised span, by Viterbi; states are the last two characters."""
    best: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
    memo, before = model.memo, ""
    for o in span.lower():
        options, after = _readings(o, o == before), {}
        before = o
        for state, (cost, path) in best.items():
            last, known = state[1], memo.get(state, {})
            for c, price in options:
                if not c or c == " " == last:
                    to, total, back = state, cost + price, path
                else:
                    step = known.get(c)
                    to, total, back = last + c, cost + price + (model.cost(state, c) if step is None else step), (c, path)
                old = after.get(to)
                if old is None or total < old[0]:
                    after[to] = (total, back)
        best = after
    _, path = min(((cost + model.cost(s, " ") if s[1] != " " else cost, path) for s, (cost, path) in best.items()), key=lambda t: t[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)).strip()


_SIGN, _SEPARATOR = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[[ord(c) for c in RESEMBLES if c.isascii()]] = True
_SEPARATOR[[ord(c) for c in SEPARATORS if c.isascii() and c not in RESEMBLES]] = True
#: Characters of the tables that take several bytes, as those bytes.
_LONG = [c.encode() for c in sorted({*RESEMBLES, *SEPARATORS}) if not c.isascii()]
_LEAD = np.zeros(256, bool)
_LEAD[[c[0] for c in _LONG]] = True


def _long(data: np.ndarray) -> np.ndarray:
    """Whether a character of several bytes that the tables hold begins at each byte."""
    out = np.zeros(len(data), bool)
    at = np.flatnonzero(_LEAD[data])
    for c in _LONG if len(at) else []:
        here = at[at + len(c) <= len(data)]
        for j, byte in enumerate(c):
            here = here[data[here + j] == byte]
        out[here] = True
    return out


def _repeated(data: np.ndarray) -> np.ndarray:
    """Whether a letter of one to four bytes ends at each byte that stands a second time in a row in its word."""
    out = np.zeros(len(data), bool)
    out[1:] = (data[1:] == data[:-1]) & LETTERS[data[1:]] & (data[1:] < 128)
    lead = np.flatnonzero(data >= 0xC0)
    for size, low, high in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = lead[(data[lead] >= low) & (data[lead] < high) & (lead + 2 * size <= len(data))]
        for j in range(size):
            at = at[data[at + j] == data[at + size + j]]
        out[at + 2 * size - 1] = True
    return out


def disguised(w: Words) -> list[tuple[int, int]]:
    """Ranges of space-separated words that may be disguised, as (first, past the last).

    By the decoder's own tables: words with a character that resembles letters, with a
    separator, or with a letter twice in a row, and runs of single characters.  Left out
    are words that decode to what stands there: those whose only signs are separators
    of one byte around them, and those without anything that could be a letter.
    """
    if not len(w.hash):
        return []
    count = lambda flag: (c := np.concatenate(([0], np.cumsum(flag, dtype=np.int32))))[w.end] - c[w.start]
    data = w.data
    long, separator = _long(data), _SEPARATOR[data]
    letters, signs, longs, chars = count(LETTERS[data]), count(_SIGN[data]), count(long), count((data & 0xC0) != 0x80)
    other = np.append(np.flatnonzero(~separator), len(data))
    first, last = other[np.searchsorted(other, w.start)], other[np.maximum(np.searchsorted(other, w.end) - 1, 0)]
    sums = np.concatenate(([0], np.cumsum(separator, dtype=np.int32)))
    within = (first < w.end) & (sums[np.minimum(last, len(data))] > sums[np.minimum(first, len(data))])
    some = (letters > 0) | (signs > 0)
    begins = np.zeros(len(data), bool)
    begins[w.start] = True  # a text may begin with the byte that the one before ends with
    inner = some & (chars > 1) & ((signs > 0) | (longs > 0) | within | (count(_repeated(data) & ~begins) > 0))
    short = (chars == 1) & (some | (count(separator) > 0))
    run = np.flatnonzero(np.diff(np.concatenate(([0], short.astype(int), [0]))))
    spans = [(a, b) for a, b in zip(run[::2].tolist(), run[1::2].tolist(), strict=True) if b - a >= 3 and some[a:b].any()]
    spans += [(i, i + 1) for i in np.flatnonzero(inner).tolist()]
    ends = w.first[1:]
    out = []
    for a, b in spans:  # a run ends with its text
        while a < b:
            stop = b if b - a == 1 else min(b, int(ends[np.searchsorted(ends, a, "right")]))
            out.append((a, stop))
            a = stop
    return out


class Restorer:
    """Restored words of each text, where they differ from what stands there; spans seen before are remembered, 200,000 at most."""

    def __init__(self, model: CharModel):
        self.model, self.memo = model, {}

    def _restored(self, raw: str, one: bool) -> str:
        found = self.memo.get(raw)
        if found is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            span = _EDGE.sub("", raw) if one else raw
            whole = [restore(span, self.model)] if span else []
            if raw != span:  # a closing sign may belong to the word
                whole.append(restore(raw, self.model))
            plain = {raw, span} if span.isascii() else {raw}  # its words are in the text as it is
            found = self.memo[raw] = " ".join(x for x in dict.fromkeys(whole) if x not in plain)
        return found

    def __call__(self, w: Words) -> list[str]:
        out: list[list[str]] = [[] for _ in range(len(w.first) - 1)]
        spans = disguised(w)
        text = lambda a, b: b" ".join(w.bytes_of(i) for i in range(a, b)).decode("utf-8", "replace")
        for a, b in spans:
            if b - a > 1:
                out[int(np.searchsorted(w.first[1:], a, "right"))].append(self._restored(text(a, b), False))
        at = np.array([a for a, b in spans if b - a == 1], np.int64)
        _, first, same = np.unique(w.hash[at], return_index=True, return_inverse=True)
        words_ = [self._restored(text(a, a + 1), True) for a in at[first].tolist()]
        for k, doc in zip(same.tolist(), np.searchsorted(w.first[1:], at, "right").tolist(), strict=True):
            if words_[k]:
                out[doc].append(words_[k])
        return [" ".join(x) for x in out]


def evidence(texts: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit feature) of words and word beginnings; several columns count together."""
    owners, features = [], []
    for col in texts:
        w = words(col, LETTERS)
        doc = w.doc
        owners.append(doc)
        features.append(w.hash)
        for n in HEADS:
            at, h = w.head(n)
            owners.append(doc[at])
            features.append(h)
    return np.concatenate(owners), np.concatenate(features)


def _filter(keys: np.ndarray) -> np.ndarray:
    """Whether a key has each value of as many low bits as make keys sparse among them."""
    out = np.zeros(1 << max(16, (16 * len(keys)).bit_length()), bool)
    out[(keys & np.uint64(len(out) - 1)).astype(np.int64)] = True
    return out


def matches(keys: np.ndarray, some: np.ndarray, owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place among the sorted ``keys``), by text and place; ``some`` is the keys' filter."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.flatnonzero(some[(feature & np.uint64(len(some) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, feature[maybe]), len(keys) - 1)
    ok = keys[at] == feature[maybe]
    both = np.unique(owner[maybe][ok] * len(keys) + at[ok])
    return both // len(keys), both % len(keys)


class Model:
    def __init__(self, chars: CharModel, keys: np.ndarray, weight: np.ndarray, bias: float):
        self.chars, self.keys, self.weight, self.bias = chars, keys, weight, bias
        self.filter = _filter(keys)

    def scores(self, n: int, owner: np.ndarray, feature: np.ndarray) -> np.ndarray:
        z = np.full(n, self.bias)
        doc, at = matches(self.keys, self.filter, owner, feature)
        np.add.at(z, doc, self.weight[at])
        return 1 / (1 + np.exp(-z))


def fit(documents: DataFrame, labels: DataFrame) -> Model:
    """Learn from the rows of ``documents`` that have a label in ``labels``; all of these make the classes' shares."""
    spark = documents.sparkSession
    marked = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter("text is not null and text != ''")
    counts = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = Model(CharModel({}), np.zeros(0, np.uint64), np.zeros(0), -40.0)
    if set(counts) != {0, 1}:
        return nothing

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            w = words(b.column(1), NONSPACE)
            g = grams(w.hash, 3)
            sketch = [_sketch(g[a : max(a, e - 2)] if e - a > 2 else w.hash[a:e]) for a, e in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sketch, pa.binary()), b.column(1)], names=["toxic", "sketch", "text"])

    each = rows.join(F.broadcast(marked) if sum(counts.values()) <= LABELS else marked, "doc_id").select("toxic", "text").mapInArrow(sketched, "toxic int, sketch binary, text string")
    texts = stored(each.groupBy("toxic", "sketch").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("toxic", "text"), "training")  # the same of near copies in every run
    made = [texts]
    try:
        n = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if set(n) != {0, 1}:
            return nothing

        def chars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: Counter[str] = Counter()
            for b in slices(batches, "text"):
                seen.update(counted(b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["g", "n"])

        trigram = texts.select("text").mapInArrow(chars, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "g").limit(TRIGRAMS).collect()
        model = CharModel({r.g: r.n for r in trigram})
        shared = spark.sparkContext.broadcast(model)

        def features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            again = Restorer(shared.value)
            for b in slices(batches, "text"):
                yield b, *evidence([b.column(1), pa.array(again(words(b.column(1), NONSPACE)), pa.string())])

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple[np.ndarray, np.ndarray]] = []

            def out() -> pa.RecordBatch:
                f, inverse = np.unique(np.concatenate([p[0] for p in held]), return_inverse=True)
                t = np.bincount(inverse, np.concatenate([p[1] for p in held]), len(f)).astype(np.int64)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(t)], names=["f", "t"])

            for _, owner, feature in features(batches):
                f, inverse = np.unique(feature, return_inverse=True)
                held.append((f, np.bincount(np.unique(owner * len(f) + inverse) % len(f), minlength=len(f))))
                if sum(len(f) for f, _ in held) > 2_000_000:
                    yield out()
            if held:
                yield out()

        least = max(4.0, 0.004 * n[1])
        found = texts.filter("toxic = 1").mapInArrow(totals, "f long, t long").groupBy("f").agg(F.sum("t").alias("t")).filter(f"t >= {least}").select("f").toArrow()
        wanted = np.sort(found.column(0).to_numpy().view(np.uint64))
        small = spark.sparkContext.broadcast((wanted, _filter(wanted)))

        def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, owner, feature in features(batches):
                doc, at = matches(*small.value, owner, feature)
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(doc, at, b.num_rows)], names=["toxic", "at"])

        made.append(bags := stored(texts, "bags", bag, "toxic int, at array<int>"))
        one = bags.select("toxic", F.explode("at").alias("at")).groupBy("at").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
        lift = (F.col("t") + 0.5) / n[1] / ((F.col("c") + 0.5) / n[0])
        names = spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(wanted)), pa.int32()), "f": pa.array(wanted.view(np.int64))})) if len(wanted) else spark.createDataFrame([], "at int, f long")
        kept = one.filter(lift >= 6).join(names, "at").orderBy(F.desc("t"), "f").limit(FEATURES).collect()
        chosen = np.sort(np.array([r["at"] for r in kept], np.int64))  # in the order of the candidates, so of the features
        place = np.full(len(wanted), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        to = spark.sparkContext.broadcast(place)

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                    f = b.column(1)
                    owner, at = np.repeat(np.arange(b.num_rows), np.diff(f.offsets.to_numpy())), to.value[f.flatten().to_numpy()]
                    size = np.bincount(owner[at >= 0], minlength=b.num_rows)
                    columns = (b.column(0).to_numpy().astype(np.int8), size.astype(np.int32), at[at >= 0])
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=["y", "size", "at"])

        made.append(table := stored(bags, "places", blocks, "y binary, size binary, at binary"))
        weight, bias = logistic(table, len(chosen), n, counts[1] / (counts[0] + counts[1]))
        return Model(model, wanted[chosen], weight, bias)
    finally:
        forget(*made)


def _sketch(h: np.ndarray) -> bytes:
    """Two minimum hashes of a text's word triples, which near copies mostly share."""
    return b"".join(mix(h ^ np.uint64(seed)).min().tobytes() for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F)) if len(h) else b""


def _lists(owner: np.ndarray, value: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n owners, which come in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(value, pa.int32()))


def _gradient(blocks: Iterator[tuple[bytes, bytes, bytes]], w: np.ndarray, b: float, each: tuple[float, float]) -> np.ndarray:
    """Of the loss by each weight and, last, the bias, summed over blocks."""
    out = np.zeros(len(w) + 1)
    for y, size, at in blocks:
        y, size, at = np.frombuffer(y, np.int8), np.frombuffer(size, np.int32), np.frombuffer(at, np.int32)
        owner = np.repeat(np.arange(len(y)), size)
        r = (1 / (1 + np.exp(-(np.bincount(owner, w[at], len(y)) + b))) - y) * np.where(y == 1, each[1], each[0])
        out[:-1] += np.bincount(at, r[owner], len(w))
        out[-1] += r.sum()
    return out


def logistic(table: DataFrame, features: int, n: dict[int, int], prior: float, steps: int = 300, decay: float = 2e-6) -> tuple[np.ndarray, float]:
    """Weights of at least 0 by accelerated projected gradient over all blocks of places; rows count as if classes stood as in ``prior``."""
    each, sc = ((1 - prior) / n[0], prior / n[1]), table.sparkSession.sparkContext
    of: Callable[[np.ndarray, float], np.ndarray]
    if (table.agg(F.sum(F.octet_length("at") + F.octet_length("size"))).first()[0] or 0) <= 4 * LOCAL:
        blocks = [tuple(r) for r in table.collect()]
        of = lambda w, b: _gradient(blocks, w, b, each)
    else:

        def of(w: np.ndarray, b: float) -> np.ndarray:
            now = sc.broadcast((w, b))

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([_gradient(rows, *now.value, each).tobytes()], pa.binary())], names=["g"])

            out = sum(np.frombuffer(r.g) for r in table.mapInArrow(run, "g binary").collect())  # FEATURES numbers of each task
            now.unpersist()
            return out

    w, b = np.zeros(features), math.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        both = of(w, b)
        g, gb = both[:-1] + decay * w, float(both[-1])
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = np.maximum(0, w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9))
        b -= 0.1 * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    return w, b


def _scorer(model: Model):
    def make():
        again = Restorer(model.chars)

        def scored(col: pa.Array) -> tuple[np.ndarray, pa.Array]:
            restored = pa.array(again(words(col, NONSPACE)), pa.string())
            return model.scores(len(col), *evidence([col, restored])), restored

        return scored

    return make


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, restored) for every row: ``restored`` holds what disguised words stand for."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES weights and TRIGRAMS trigrams at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared.value)()
        for b in slices(batches, "text"):
            z, restored = scored(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z), restored], names=["doc_id", "score", "restored"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, restored string")


def keep_below(documents: DataFrame, model: Model, threshold: float) -> DataFrame:
    """The rows, whole and as they are, that score under ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared.value)()
        for b in slices(batches, "text"):
            yield b.filter(pa.array(scored(b.column(b.schema.get_field_index("text")))[0] < threshold))

    return documents.mapInArrow(run, documents.schema)
