"""Language identification with a byte convolutional network, in numpy.

A text is cut into windows of ``WINDOW`` bytes, the whole of it.  Filters of
several widths run over one-hot bytes (A-Z as a-z, and one class each for
digits and for other ASCII bytes), each filter's maximum over the window passes
a ramp, and a softmax layer gives the window's languages; a text's are the mean
of its windows' logits.  A filter over one-hot bytes is a sum of table rows, so
pairs of neighbours are looked up in one table of both.

It learns by Adam from a bounded sample of labelled windows, about ``PER_LANG`` a language: every window
of every labelled text is drawn, by a hash, at a rate from the language's number of windows.

Defined results: a null text, or one without any letter, is ``und`` with score
0; rows without a language are not learnt from; without any language all is
``und``; a language named ``und`` is learnt like any other; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenolith.llm.kernel import buffers, mix, slices

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
PER_LANG = 3600
_CLASS = np.zeros(256, np.int64)
_CLASS[48:58] = 1
_CLASS[65:91] = _CLASS[97:123] = np.arange(2, 28)
_CLASS[128:] = np.arange(28, 156)
CLASSES = 156
_LETTER = regex.compile(r"\p{L}")


def windows(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(windows of byte classes, text of each window)."""
    raw, off = buffers(col)
    size = np.diff(off)
    n = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), n)
    out = np.zeros(int(n.sum()) * WINDOW, np.uint8)
    first = (np.cumsum(n) - n) * WINDOW
    out[np.arange(len(raw)) - np.repeat(off[:-1], size) + np.repeat(first, size)] = _CLASS[raw]
    return out.reshape(-1, WINDOW), owner


class Net:
    def __init__(self, langs: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.taps = {w: (rng.normal(size=(w, CLASSES, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.bias = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (rng.normal(size=(len(WIDTHS) * FILTERS, len(langs))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def _pairs(self) -> dict[int, list[np.ndarray]]:
        """For each width, tables by neighbours: pairs, and a single tap where the width is odd."""
        return {w: [(t[i][:, None, :] + t[i + 1][None, :, :]).reshape(-1, FILTERS) for i in range(0, w - 1, 2)] + ([t[-1]] if w % 2 else []) for w, t in self.taps.items()}

    def pooled(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        one = x.astype(np.int32)
        pair = one[:, :-1] * CLASSES + one[:, 1:]
        tops, ats = [], []
        for w in WIDTHS:
            m = WINDOW - w + 1
            z = None
            for i, t in enumerate(tables[w]):
                at = pair[:, 2 * i : 2 * i + m] if 2 * i + 1 < w else one[:, w - 1 : w - 1 + m]
                part = np.take(t, at, axis=0)
                z = part if z is None else np.add(z, part, out=z)
            if where:
                at = z.argmax(1)
                ats.append(at)
                tops.append(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + self.bias[w])
            else:
                tops.append(z.max(1) + self.bias[w])
        return np.concatenate(tops, 1), ats

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 3e-3, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        share = np.bincount(y, minlength=len(self.langs)) / len(y)
        each = (1 / np.maximum(share, 1e-9) / np.count_nonzero(share))[y].astype(np.float32)
        params = [*self.taps.values(), *self.bias.values(), self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
                top, ats = self.pooled(x[at], self._pairs(), True)
                h = np.maximum(top, 0)
                p = _softmax(h @ self.out + self.out_bias)
                p[np.arange(len(at)), y[at]] -= 1
                d = p * (each[at] / len(at))[:, None]
                back = (d @ self.out.T) * (top > 0)
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.taps[w])
                    b = back[:, k * FILTERS : (k + 1) * FILTERS]
                    for o in range(w):
                        np.add.at(g[o], (x[at][np.arange(len(at))[:, None], ats[k] + o], np.arange(FILTERS)[None, :]), b)
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))] + [h.T @ d, d.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)

    def logits(self, x: np.ndarray, tables: dict[int, list[np.ndarray]], step: int = 256) -> np.ndarray:
        parts = [np.maximum(self.pooled(x[i : i + step], tables)[0], 0) @ self.out + self.out_bias for i in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.langs)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(documents: DataFrame) -> Net:
    """Learn from the text and lang of ``documents``."""
    rows = documents.select(F.col("doc_id"), F.col("text").cast("string"), F.col("lang").cast("string")).filter("lang is not null and text is not null and text != ''")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / WINDOW)).alias("n")).collect()}
    if not counts:
        return Net([])
    langs = sorted(counts)
    rate = {k: min(1.0, PER_LANG / counts[k]) for k in langs}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            x, owner = windows(b.column(1))
            n = np.bincount(owner, minlength=b.num_rows)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            share = np.array([rate[k] for k in b.column(0).to_pylist()])
            drawn = mix(b.column(2).to_numpy().view(np.uint64)[owner] + place.astype(np.uint64)) >> np.uint64(11)
            at = np.flatnonzero(drawn < share[owner] * (1 << 53))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(owner[at])), pa.array([r.tobytes() for r in x[at]], pa.binary())], names=["lang", "x"])

    sample = rows.select("lang", "text", F.xxhash64("doc_id", "text")).mapInArrow(run, "lang string, x binary").collect()  # about langs * PER_LANG windows
    sample.sort(key=lambda r: (r.lang, r.x))
    net = Net(langs)
    net.train(np.frombuffer(b"".join(bytes(r.x) for r in sample), np.uint8).reshape(-1, WINDOW), np.array([langs.index(r.lang) for r in sample]))
    return net


def identify(documents: DataFrame, net: Net) -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model._pairs()
        for b in slices(batches, "text"):
            x, owner = windows(b.column(1))
            n = b.num_rows
            pred, score = ["und"] * n, np.zeros(n)
            if model.langs and len(x):
                z = np.zeros((n, len(model.langs)))
                np.add.at(z, owner, model.logits(x, tables))
                p = _softmax(z / np.maximum(np.bincount(owner, minlength=n), 1)[:, None])
                plain = np.zeros(n, bool)
                plain[owner[((x >= 2) & (x < 28)).any(1)]] = True
                other = np.flatnonzero(~plain & (np.bincount(owner, minlength=n) > 0))
                for i in other.tolist():
                    plain[i] = _LETTER.search(b.column(1)[i].as_py()) is not None
                best = p.argmax(1)
                pred = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), plain.tolist(), strict=True)]
                score = np.where(plain, p.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double")
