"""Counting tokens in flat files of token ids that carry no index.

A file is nothing but ids of a fixed width; each document ends with a separator id. Files
are cut into blocks, and the separators of a block are found in one vectorised comparison.
What a block cannot know, how many documents ended before it and where the last of them
did, comes from a prefix scan over the blocks of its file; after it every document's
start, length and number are known.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.textbytes import bounded, slices

BLOCK_TOKENS = 1 << 19
# How texts are cut before byte pairs are merged (a fixed value of the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_pair_ids(docs: DataFrame, ranks_path: str, text_col: str = "text", out: str = "ids",
                  width: str = "uint16") -> DataFrame:
    """``docs`` with ``out``: the little-endian ids of each whole text; a null or empty text has none."""
    with open(ranks_path) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    docs = bounded(docs).drop(out)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in slices(batches, text_col, 2 << 20):
            ids = [np.array(encoder.encode_ordinary(t or ""), width).tobytes()
                   for t in part.column(text_col).to_pylist()]
            yield part.append_column(out, pa.array(ids, pa.binary()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.BinaryType())]))


def write_flat(rows: DataFrame, path: str, separator: int, width: str = "uint16", ids_col: str = "ids") -> None:
    """Writes binary ids to flat files under ``path``, one per partition, a separator after each row.

    The rows of a partition keep their order. Null ids count as none. The text writer puts the separator's bytes where a
    line would end, so the files hold ids only.
    """
    mark = np.array([separator], width).tobytes().decode("latin-1")
    flat = rows.select(F.coalesce(F.col(ids_col), F.lit(b"")).cast("string").alias("value"))
    flat.write.option("lineSep", mark).option("encoding", "ISO-8859-1").text(path)


DIGITS, DIGIT_BITS = 6, 13  # a null mark and five digits hold any 64-bit id in ids below 8192


def sign(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", width: str = "uint16") -> DataFrame:
    """``rows`` whose binary ids begin with the row's own id, written as ``DIGITS`` token ids.

    So a document can be told in a file that holds nothing but ids, wherever it was written.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(id_col)
            null = np.array(column.is_null().to_pylist(), bool)
            value = column.fill_null(0).to_numpy().astype(np.int64).view(np.uint64)
            shifts = np.arange(DIGITS - 1, dtype=np.uint64) * np.uint64(DIGIT_BITS)
            digits = (value[:, None] >> shifts) & np.uint64((1 << DIGIT_BITS) - 1)
            heads = np.concatenate([null[:, None], digits], axis=1).astype(width)
            ids = [h.tobytes() + (x or b"") for h, x in zip(heads, batch.column(ids_col).to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index(ids_col), ids_col, pa.array(ids, pa.binary()))

    rows = bounded(rows).withColumn(id_col, F.col(id_col).cast("long"))
    return rows.mapInArrow(run, rows.schema)


def signature(head: Column) -> Column:
    """The id that ``sign`` wrote, from the first ``DIGITS`` ids of a document."""
    parts = [F.shiftleft(F.get(head, F.lit(k + 1)).cast("long"), k * DIGIT_BITS) for k in range(DIGITS - 1)]
    return F.when(F.get(head, F.lit(0)) == 0, reduce(lambda a, b: a.bitwiseOR(b), parts))


def count_tokens(spark: SparkSession, path: str, separator: int, width: str = "uint16",
                 block_tokens: int = BLOCK_TOKENS, head: int = 0) -> DataFrame:
    """Documents of the flat files under ``path``: (file, document, start, n_tokens, head).

    ``document`` numbers the documents of a file from 0, ``start`` is the index of its
    first id, ``head`` has its first ids, ``head`` of them. The separator is not counted. A file may end without one; ids behind the
    last separator are a document then. Two separators in a row hold an empty document, an
    empty file has none. A file that ends within an id is refused. Files of any
    name are read, but those that Spark hides (names that begin with ``_`` or ``.``). One
    task reads one file as one value: files should be no larger than a task's memory, and
    2 GB or more are refused by Spark.
    """
    size = np.dtype(width).itemsize

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                if not content.as_buffer().size:
                    continue
                if content.as_buffer().size % size:
                    raise ValueError(f"{name} ends within an id")
                ids, begin = np.frombuffer(content.as_buffer(), width), 0
                for at in range(0, len(ids), block_tokens):
                    ends = np.flatnonzero(ids[at:at + block_tokens] == separator) + at
                    if at + block_tokens >= len(ids) and ids[-1] != separator:
                        ends = np.append(ends, len(ids))  # the last document, which has no separator
                    starts = np.append(begin, ends + 1)
                    begin = int(starts[-1])
                    heads = [ids[a:min(a + head, b)].tolist() for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name.as_py()]), pa.array([at], pa.int64()),
                         pa.array([ends.tolist()], pa.list_(pa.int64())),
                         pa.array([heads], pa.list_(pa.list_(pa.int32())))], names=["file", "block", "ends", "heads"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", "content")
    found = files.mapInArrow(blocks, "file string, block long, ends array<long>, heads array<array<int>>")
    # the scan: documents that ended before each block, and the last end before it
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = found.select(
        "file", "ends", "heads", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("done"),
        F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)).alias("last"))
    each = scanned.select("file", "done", F.posexplode(F.arrays_zip(
        F.concat(F.array("last"), F.col("ends")).alias("low"), F.col("ends").alias("high"), "heads")).alias("n", "it"))
    return each.where("it.high IS NOT NULL").select(
        "file", (F.col("done") + F.col("n")).alias("document"), (F.col("it.low") + 1).alias("start"),
        (F.col("it.high") - F.col("it.low") - 1).alias("n_tokens"), F.col("it.heads").alias("head"))
