"""Exact encoding with a merge-type SentencePiece model, by backtracking, and decoding.

An Aho-Corasick automaton over the pieces lists, for each position of a chunk,
the pieces that start there, longest first.  The encoder takes the longest one
that may follow its last piece; where none may, it takes the last piece back,
marks the position in a bit field and tries that piece's next shorter rival.
Two pieces may stand side by side if merging their characters anew gives just
those two; this is decided by undoing their merges.  A chunk is a run of spaces with the word behind it, cut further
where no piece holds the two characters side by side; chunks can't influence
one another and their ids are kept in a bounded cache.

Only models that leave texts as they are (identity rules, a space put in front,
byte fallback) are taken; others are refused.  Defined results: null is
encoded as an empty text, and an empty text gives begin and end ids alone;
decoding null gives null; ids beyond the vocabulary raise ``IndexError`` as the
library does.
"""

from __future__ import annotations

import codecs
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as proto

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
#: Chunks, and pairs of pieces, remembered by a task; a full cache is emptied.
CACHE = 1_000_000
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Model:
    def __init__(self, blob: bytes):
        model = proto.ModelProto()
        model.ParseFromString(blob)
        rules, spec = model.normalizer_spec, model.trainer_spec
        if spec.model_type != 2 or not spec.byte_fallback:
            raise ValueError("a merge-type model with byte fallback is needed")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces or spec.treat_whitespace_as_suffix:
            raise ValueError("a model with identity rules and a space in front is needed")
        if any(p.type not in (_NORMAL, _UNKNOWN, _CONTROL, _BYTE) for p in model.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.piece = [p.piece for p in model.pieces]
        self.rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.byte = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.bos, self.eos = (next(i for i, p in enumerate(model.pieces) if p.type == _CONTROL and p.piece == x) for x in (spec.bos_piece, spec.eos_piece))
        self.joined = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.single = {p for p in self.rank if len(p) == 1}
        crossing = any(SPACE in p[1:] and p.strip(SPACE) for p in self.rank)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.simple = not any("\n" in p for p in self.rank)
        longer = sorted((p for p in self.rank if len(p) > 1 and p.strip(SPACE)), key=lambda p: self.rank[p][0])
        self.blank = {len(p): i for p, (_, i) in self.rank.items() if not p.strip(SPACE)}
        last = {s for p, (s, _) in self.rank.items() if len(p) > 1 and not p.strip(SPACE)}
        if len({self.rank[p][0] for p in longer}) < len(longer) or len(last) > 1 or crossing or any(s <= self.rank[longer[-1]][0] for s in last):
            raise ValueError("scores must differ, but for pieces of spaces alone, which come last and stand alone")
        self.order = {p: k for k, p in enumerate(longer)}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p, (_, i) in self.rank.items():
            if len(p) == 1 or p in self.order and self.merged(p) == [p]:
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.out = [p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else bytes([int(p.piece[1:-1], 16)]) if p.type == _BYTE else " ⁇ ".encode() if p.type == _UNKNOWN else None for p in model.pieces]
        self.spaced = {i for i, p in enumerate(self.piece) if p[:1] == SPACE}

    def merged(self, s: str) -> list[str]:
        """Pieces by merging the best neighbours first, the leftmost of equals; halves of s are kept."""
        parts, order = list(s), self.order
        while len(parts) > 1:
            at, best = -1, 1 << 60
            for k in range(len(parts) - 1):
                r = order.get(parts[k] + parts[k + 1])
                if r is not None and r < best:
                    at, best = k, r
            if at < 0:
                break
            if len(parts) == 2:
                self.halves[s] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def beside(self, a: int, b: int) -> bool:
        """Whether merging the characters of a and b anew gives a and b: their last merges are
        undone, best rank last, until a merge across the border would have come before one
        of them, or only characters are left."""
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            found = self.pairs[key] = self._beside(self.piece[a], self.piece[b])
        return found

    def _beside(self, left: str, right: str) -> bool:
        limit, order, halves = 1 << 60, self.order, self.halves
        while True:
            across = order.get(left + right)
            if across is not None and across < limit:
                return False
            x, y = order.get(left, -1), order.get(right, -1)
            if x > y:
                limit, left = x, halves[left][1]
            elif y >= 0:
                limit, right = y + 1, halves[right][0]  # of equals, the leftmost is merged first
            else:
                return True

    def backtracked(self, s: str) -> list[int]:
        """Ids of a chunk whose characters are all pieces."""
        n = len(s)
        starts: list[list] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(s):
            starts[end - size + 1].append((size, i))
        path: list[tuple[int, int, int]] = []
        failed, at, k = 0, 0, len(starts[0]) - 1  # matches were found shortest first
        while at < n:
            here = starts[at]
            while k >= 0:
                size, i = here[k]
                if not failed >> (at + size) & 1 and (not path or self.beside(path[-1][2], i)):
                    break
                k -= 1
            if k >= 0:
                path.append((at, k, i))
                at += size
                k = len(starts[at]) - 1 if at < n else 0
            else:
                failed |= 1 << at
                at, k, _ = path.pop()
                k -= 1
        return [i for _, _, i in path]

    def _run(self, n: int) -> list[int]:
        """Ids of n spaces: their pieces are of one score, so the leftmost merge is always next."""
        sizes: list[int] = []
        for _ in range(n):
            sizes.append(1)
            while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.blank:
                sizes[-2:] = [sizes[-2] + sizes[-1]]
        return [self.blank[x] for x in sizes]

    def _cut(self, chunk: str) -> Iterator[str]:
        begin = 0
        for k in range(max(1, len(chunk) - len(chunk.lstrip(SPACE))), len(chunk)):
            if chunk[k - 1 : k + 1] not in self.joined:
                yield chunk[begin:k]
                begin = k
        yield chunk[begin:]

    def chunk_ids(self, chunk: str) -> bytes:
        found = self.known.get(chunk)
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            parts = list(self._cut(chunk))
            if len(parts) > 1:
                found = b"".join(map(self.chunk_ids, parts)) if len(parts) < 64 else b"".join(self._ids(p) for p in parts)
            else:
                found = self._ids(chunk)
            if len(chunk) <= 64:
                self.known[chunk] = found
        return found

    def _ids(self, part: str) -> bytes:
        if len(part) == 1 and part not in self.single:
            ids = [self.byte[b] for b in part.encode()]
        elif part[:2] == SPACE * 2:
            word = part.lstrip(SPACE)
            ids = self.backtracked(SPACE + word)
            ids = self._run(len(part) - len(word) - 1) + ids if ids[0] != self.blank[1] else self._run(len(part) - len(word)) + ids[1:]
        else:
            ids = self.backtracked(part)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """Little-endian 32-bit ids with begin and end."""
        begin, end = struct.pack("<I", self.bos), struct.pack("<I", self.eos)
        if not text:
            return begin + end
        text = SPACE + text.replace(" ", SPACE)
        get, one = self.known.get, self.chunk_ids
        if self.simple and SPACE * 2 not in text:
            pieces = text.replace(SPACE, " " + SPACE).replace("\n", " \n ").split(" ")[1:]
            return begin + b"".join([get(c) or one(c) for c in pieces if c]) + end
        return begin + b"".join([get(c) or one(c) for c in self.chunk.findall(text)]) + end

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids, as the library's decode(ids) gives it."""
        view = memoryview(ids).cast("I") if struct.pack("=I", 1) == struct.pack("<I", 1) else struct.unpack(f"<{len(ids) // 4}I", ids)
        inner = view[bool(len(view) and view[0] == self.bos) :]
        if len(inner) and inner[-1] == self.eos:
            inner = inner[:-1]
        skip = len(inner) > 0 and inner[0] in self.spaced
        try:
            return b"".join(map(self.out.__getitem__, inner))[skip:].decode()
        except (TypeError, UnicodeDecodeError):  # a control piece ends a run of bytes
            skip = next((i for i in inner if self.out[i] is not None), None) in self.spaced
            runs: list[list[bytes]] = [[]]
            for i in inner:
                if self.out[i] is None:
                    runs.append([])
                else:
                    runs[-1].append(self.out[i])
            return "".join(b"".join(x).decode("utf-8", "each_byte") for x in runs)[skip:]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])


def _put(b: pa.RecordBatch, name: str, col: pa.Array) -> pa.RecordBatch:
    keep = [i for i, n in enumerate(b.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), col], names=[*(b.schema.names[i] for i in keep), name])


def _row_chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def encode(df: DataFrame, model: bytes, *, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with a binary column of little-endian 32-bit ids; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a vocabulary file: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Model(shared.value)
        for b in _row_chunks(batches):
            yield _put(b, out, pa.array([sp.encode(x) for x in b.column(b.schema.get_field_index(text)).to_pylist()], pa.binary()))

    return df.mapInArrow(run, _with(df, out, T.BinaryType()))


def decode(df: DataFrame, model: bytes, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of its ids; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Model(shared.value)
        for b in _row_chunks(batches):
            yield _put(b, out, pa.array([None if x is None else sp.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string()))

    return df.mapInArrow(run, _with(df, out, T.StringType()))


def library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)
