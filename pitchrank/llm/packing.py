"""Packing documents into rows of equal length for training, best fit decreasing.

Documents longer than a row are split into pieces, each with its place in the document,
so nothing is lost. The pieces of a batch are taken longest first, and each goes to the
open row with the least room that still holds it. A segment tree over the amounts of
room, whose leaves count the open rows, finds that row in a logarithmic number of steps.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.textbytes import bounded, buffers

ROW = 4096
BATCH_TOKENS = 2 << 20  # tokens packed together; open rows at the end of a batch are written as they are
BYTE_END = 256          # end of text in byte ids

PACKED = T.StructType([
    T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.IntegerType()),
    T.StructField("cu_seqlens", T.ArrayType(T.IntegerType())), T.StructField("positions", T.BinaryType()),
    T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("doc_offsets", T.ArrayType(T.LongType())),
])


def byte_ids(docs: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``: ids (16 bits, little-endian) that are the text's UTF-8 bytes, and an end of text.

    A null text has null ids.
    """
    docs = bounded(docs).drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                column = part.column(text_col)
                data, off = buffers(column)
                ids = np.insert(data[:off[-1]].astype(np.uint16), off[1:], BYTE_END)
                off = (off + np.arange(len(off))) * 2
                nulls = column.is_null().to_pylist()
                raw = ids.tobytes()
                yield part.append_column(out, pa.array(
                    [None if n else raw[a:b] for a, b, n in zip(off[:-1], off[1:], nulls, strict=True)], pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def closed(docs: DataFrame, end: int, ids_col: str = "ids", width: str = "uint16") -> DataFrame:
    """``docs`` whose binary ids close with the id ``end``; null ids stay null."""
    mark = np.array([end], width).tobytes()
    return docs.withColumn(ids_col, F.concat(F.col(ids_col), F.lit(mark)))


class Room:
    """Open rows by the room they have left."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._change(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of the row with the least room of ``need`` or more."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not count[node]
        room = node - self.leaves
        self._change(room, -1)
        return self.rows[room].pop(), room

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(sizes: np.ndarray, row: int) -> np.ndarray:
    """Row of each piece (of 1 to ``row`` tokens), longest first, ties in order."""
    open_rows, out, rows = Room(row), np.zeros(len(sizes), np.int64), 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        if (found := open_rows.take(size)) is None:
            found = rows, row
            rows += 1
        out[i] = found[0]
        if found[1] > size:
            open_rows.add(found[1] - size, found[0])
    return out


def pack(docs: DataFrame, row: int = ROW, id_col: str = "doc_id", ids_col: str = "ids", pad: int = BYTE_END,
         width: str = "uint16", batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """Packed rows of ``row`` ids from the binary ids of documents.

    ``ids`` and ``positions`` are binary, ``row`` numbers of type ``width`` each:
    the ids, filled up with ``pad``, and each id's place in its piece, starting again from
    0 at each piece (and 0 in the filling). ``cu_seqlens`` has where the pieces end, from
    0 on; ``n_tokens`` is the last of them. ``doc_ids`` and ``doc_offsets`` say whose
    pieces they are and where in the document each begins, so documents can be put
    together again. Null and empty ids take no place. Rows of one id are packed
    separately; a null id stays null.

    Documents are packed within the partition they are in, ``batch_tokens`` at a time, so
    nothing is shuffled and memory is bounded by a batch and the longest document.
    """
    size = np.dtype(width).itemsize

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = [], 0
        for batch in batches:
            for doc, content in zip(batch.column(id_col).to_pylist(), batch.column(ids_col), strict=True):
                if content.as_py() is None:
                    continue
                ids = np.frombuffer(content.as_py(), width)
                held.append((doc, ids))
                tokens += len(ids)
                if tokens >= batch_tokens:
                    yield from packed(held)
                    held, tokens = [], 0
        yield from packed(held)

    def packed(held: list) -> Iterator[pa.RecordBatch]:
        lengths = np.array([len(ids) for _, ids in held], np.int64)
        pieces = -(-lengths // row)
        if not pieces.sum():
            return
        doc = np.repeat(np.arange(len(held)), pieces)
        offset = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * row
        sizes = np.minimum(lengths[doc] - offset, row)
        where = best_fit(sizes, row)
        order = np.argsort(where, kind="stable")
        flat = np.concatenate([ids for _, ids in held])
        source = (np.cumsum(lengths) - lengths)[doc] + offset
        sizes, source, where, doc, offset = (x[order] for x in (sizes, source, where, doc, offset))
        first = np.searchsorted(where, np.arange(where[-1] + 2))
        ends = np.cumsum(sizes)
        base = np.concatenate([[0], ends])[first]  # tokens before each row
        inner = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        target = np.repeat(where * row + ends - sizes - base[where], sizes) + inner
        matrix, places = np.full((len(first) - 1) * row, pad, width), np.zeros((len(first) - 1) * row, width)
        matrix[target] = flat[np.repeat(source, sizes) + inner]
        places[target] = inner
        names = [held[d][0] for d in doc.tolist()]
        for a in range(0, len(first) - 1, 256):  # a few rows at a time to Spark
            b = min(a + 256, len(first) - 1)
            rows = range(a, b)
            yield pa.RecordBatch.from_arrays([
                pa.array([matrix[r * row:(r + 1) * row].tobytes() for r in rows], pa.binary()),
                pa.array([int(base[r + 1] - base[r]) for r in rows], pa.int32()),
                pa.array([[0, *(ends[first[r]:first[r + 1]] - base[r]).tolist()] for r in rows], pa.list_(pa.int32())),
                pa.array([places[r * row:(r + 1) * row].tobytes() for r in rows], pa.binary()),
                pa.array([names[first[r]:first[r + 1]] for r in rows], pa.list_(pa.int64())),
                pa.array([offset[first[r]:first[r + 1]].tolist() for r in rows], pa.list_(pa.int64()))],
                names=PACKED.names)

    assert size * row < 1 << 31
    ready = bounded(docs).select(F.col(id_col).cast("long").alias(id_col), ids_col)
    return ready.mapInArrow(run, PACKED)


def write_matrix(packed: DataFrame, path: str, pad: int = BYTE_END, width: str = "uint16") -> None:
    """Writes the id matrix to flat files under ``path``, row after row, with one ``pad`` id closing each row."""
    mark = np.array([pad], width).tobytes().decode("latin-1")
    packed.select(F.col("ids").cast("string")).write.option("lineSep", mark).option(
        "encoding", "ISO-8859-1").text(path)
