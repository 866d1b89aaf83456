"""Token ids packed into rows of fixed length, best fit decreasing.

Each document's ids, closed by an end id, are cut into consecutive pieces of
at most ``length`` ids; nothing is dropped.  Pieces of a block, longest first,
go each into the open row with the least room that suffices; a segment tree over
room sizes finds it in a logarithm of the length.  A row of the result holds

* ``ids``: ``length`` little-endian ids (16 bits where the vocabulary allows it, else
  32), padded at the end: one row of the packed matrix;
* ``cu_seqlens``: cumulative lengths of its segments, from 0;
* ``positions``: as ``ids``, each place's position, which restarts at 0 with every segment;
* ``doc_ids`` and ``offsets``: each segment's document and its place in that document's ids.

``write_files`` puts the rows into binary matrix files with a manifest, ``read_files`` reads them.  Which pieces share a
row, and a row's number, depend on how documents are dealt to partitions; what the rows hold together doesn't.

A block holds up to ``block`` ids of one partition, which bounds a task's memory; a
document longer than that makes a block of its own.

Defined results: null and empty texts have the end id alone; repeated rows are
packed each; null ids of documents stay null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import base64
import contextlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "pack_id long, n_tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, offsets array<long>"
BLOCK = 1 << 21


class Room:
    """Open rows by the room they have left: a segment tree over room sizes."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.tree = bytearray(2 * self.base)  # whether a node has any open row below it
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, row: int) -> None:
        if not self.rows[room]:
            at = self.base + room
            while at and not self.tree[at]:
                self.tree[at] = 1
                at >>= 1
        self.rows[room].append(row)

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the least room that is at least ``need``."""
        tree, at = self.tree, self.base + need
        while not tree[at]:
            while at & 1:  # a right child: its parent has nothing further right
                at >>= 1
                if not at:
                    return None
            at += 1
            if not at & (at - 1):  # past the end of its level
                return None
        while at < self.base:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room = at - self.base
        row = self.rows[room].pop()
        if not self.rows[room]:
            tree[at] = 0
            at >>= 1
            while at and not (tree[2 * at] or tree[2 * at + 1]):
                tree[at] = 0
                at >>= 1
        return room, row


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Rows of pieces: best fit decreasing; equal sizes keep their order."""
    room, rows = Room(length), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = room.take(size)
        if found is None:
            left, row = length, len(rows)
            rows.append([])
        else:
            left, row = found
        rows[row].append(i)
        if left > size:
            room.add(left - size, row)
    return rows


def tiktoken_encoder(path: str, pattern: str) -> Callable[[], Callable[[str], list[int]]]:
    """A maker of encoders from a file of ranks; the file is read on the driver."""
    with open(path, "rb") as f:
        blob = f.read()

    def make() -> Callable[[str], list[int]]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines())}
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    return make


def pack(df: DataFrame, encoder: Callable[[], Callable[[str], list[int]]], *, vocabulary: int, end: int, pad: int, length: int = 2048, block: int = BLOCK, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``SCHEMA`` that hold all ids of all documents."""
    if length < 1:
        raise ValueError("length must be positive")
    kind = np.dtype("<u2" if max(vocabulary, end + 1, pad + 1, length) <= 1 << 16 else "<u4")

    def rows_of(docs: list[tuple[int | None, np.ndarray]], first: int) -> pa.RecordBatch:
        owner, start, size = [], [], []
        for d, (_, ids) in enumerate(docs):
            for at in range(0, len(ids), length):
                owner.append(d)
                start.append(at)
                size.append(min(length, len(ids) - at))
        rows = best_fit(np.array(size), length)
        packed, where, cu, ids_of, offsets, n = [], [], [], [], [], []
        ramp = np.arange(length, dtype=kind)
        for row in rows:
            line, place = np.full(length, pad, kind), np.zeros(length, kind)
            ends, at = [0], 0
            for p in row:
                line[at : at + size[p]] = docs[owner[p]][1][start[p] : start[p] + size[p]]
                place[at : at + size[p]] = ramp[: size[p]]
                at += size[p]
                ends.append(at)
            packed.append(line.tobytes())
            where.append(place.tobytes())
            cu.append(ends)
            n.append(at)
            ids_of.append([docs[owner[p]][0] for p in row])
            offsets.append([start[p] for p in row])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first, first + len(rows))), pa.array(n, pa.int32()), pa.array(packed, pa.binary()), pa.array(cu, pa.list_(pa.int32())), pa.array(where, pa.binary()), pa.array(ids_of, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64()))],
            names=["pack_id", "n_tokens", "ids", "cu_seqlens", "positions", "doc_ids", "offsets"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        first = TaskContext.get().partitionId() << 40
        docs: list[tuple[int | None, np.ndarray]] = []
        held = 0
        for b in batches:
            for i in range(b.num_rows):
                ids = encode(b.column(1)[i].as_py() or "")
                ids.append(end)
                docs.append((b.column(0)[i].as_py(), np.array(ids, kind)))
                held += len(ids)
                if held >= block:
                    yield (out := rows_of(docs, first))
                    first += out.num_rows
                    docs, held = [], 0
        if docs:
            yield rows_of(docs, first)

    return df.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, SCHEMA)


def unpack(packed: DataFrame, *, wide: bool = False) -> DataFrame:
    """(doc_id, offset, ids) of every segment, ids as an array: what the rows hold."""
    kind = "<u4" if wide else "<u2"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, offsets, parts = [], [], []
            for line, cu, d, o in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "offsets")), strict=True):
                ids = np.frombuffer(line, kind)
                docs += d
                offsets += o
                parts += [ids[x:y].astype(np.int32) for x, y in zip(cu[:-1], cu[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(offsets, pa.int64()), pa.array(parts, pa.list_(pa.int32()))], names=["doc_id", "offset", "ids"])

    return packed.mapInArrow(run, "doc_id long, offset long, ids array<int>")


def write_files(packed: DataFrame, folder: str, *, wide: bool = False) -> dict:
    """Binary files of the packed rows in ``folder`` (a path or URI that driver and executors share), and their manifest.

    Each task writes four files: ``.ids``, the matrix of ids row by row; ``.positions``, shaped alike;
    ``.cu_seqlens``, 32-bit cumulative lengths of each row's segments, one row after the other; and ``.bounds``, how
    many of them each row has.  They get their names when the job has ended, those of failed attempts go, and
    ``manifest.json`` (returned too) then lists the rows and the row length of each part.  No rows give no parts.
    """
    store, path = _store(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, rows, length = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0
        store, path = _store(folder)
        with contextlib.ExitStack() as open_:
            files = {}
            for b in batches:
                if b.num_rows and not files:
                    files = {k: open_.enter_context(store.open_output_stream(f"{path}/_{name}.{k}")) for k in PARTS}
                for k in ("ids", "positions"):
                    for v in b.column(b.schema.get_field_index(k)):
                        files[k].write(v.as_buffer())
                        length = len(v.as_buffer()) // (4 if wide else 2)
                cu = b.column(b.schema.get_field_index("cu_seqlens"))
                if b.num_rows:
                    files["cu_seqlens"].write(cu.flatten().to_numpy().astype("<u4").tobytes())
                    files["bounds"].write(np.diff(cu.offsets.to_numpy()).astype("<u4").tobytes())
                    rows += b.num_rows
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows]), pa.array([length], pa.int32())], names=["name", "rows", "length"])

    done = packed.select("ids", "positions", "cu_seqlens").mapInArrow(run, "name string, rows long, length int").collect()  # a row for each task
    for r in done:
        for k in PARTS:
            store.move(f"{path}/_{r.name}.{k}", f"{path}/{r.name}.{k}")
    manifest = {"bytes": 4 if wide else 2, "parts": [{"name": r.name, "rows": r.rows, "length": r.length} for r in sorted(done)]}
    for file in store.get_file_info(pafs.FileSelector(path)):
        if file.base_name.startswith("_part-"):
            store.delete_file(file.path)
    with store.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


PARTS = ("ids", "positions", "cu_seqlens", "bounds")


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def read_files(folder: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(matrix of ids, matrix of positions, bounds of each row) of each part that the manifest lists."""
    store, path = _store(folder)
    whole = lambda name: store.open_input_file(f"{path}/{name}").read()
    manifest = json.loads(whole("manifest.json"))
    for p in manifest["parts"]:
        ids, positions = (np.frombuffer(whole(f"{p['name']}.{k}"), f"<u{manifest['bytes']}").reshape(p["rows"], p["length"]) for k in ("ids", "positions"))
        cu, bounds = (np.frombuffer(whole(f"{p['name']}.{k}"), "<u4") for k in ("cu_seqlens", "bounds"))
        yield ids, positions, np.split(cu, np.cumsum(bounds)[:-1])
