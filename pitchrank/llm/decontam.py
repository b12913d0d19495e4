"""Finding benchmark items inside documents by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity to it, so signatures of
one length cannot find it. Documents are therefore partitioned by size: the class of a
document is the power of two its number of different shingles does not exceed, and its
MinHash signature has ``BINS`` times that many bins, each with the smallest shingle hash
that falls in it (one-permutation MinHash). Items get a signature for every class. As the
bins outnumber the shingles, an item's minimum is also the minimum of its bin in any
document that has the shingle, all but always, and one bin in common makes a candidate.

With ``s`` the wanted containment and ``q`` shingles in the item, at least ``s * q``
shingles are shared, and each shows up in the signature with a probability of at least
``exp(-1 / BINS)``. An item of eight shingles at 0.8 is missed with a probability below
``(1 - exp(-1/16)) ** 7``, about 3e-9; longer ones far less. Shorter items would be missed
more often, so all their shingles are looked up among all shingles of a document, and they
are always found. Candidates are verified by exact containment of all shingles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.textbytes import ALNUM, LOWER, U, bounded, buffers, find_words, shingles, slices, word_hashes

BINS = 16
FEW = 8                 # items of fewer shingles are looked up by all of them
ITEM_BYTES = 16 << 20  # text of the items that one pass over the documents looks for
HITS = T.ArrayType(T.StructType([
    T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.LongType()),
    T.StructField("n_shingles", T.LongType())]))


def find_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5,
               text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``hits``: the items contained in each document.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with ASCII
    letters in lower case. An item is contained if the document has at least ``threshold``
    of its different shingles of ``size`` words (all its words as one shingle if there are
    fewer). ``hits`` has an entry (item_id, n_shared, n_shingles) for each contained item,
    ordered by item id, and is empty for a null or empty text. Items without words are
    never contained; equal items are each reported, under a null id too. Every row of
    ``docs`` comes back once, other columns unchanged; a column named ``hits`` is replaced.

    Items are taken in blocks of a fixed amount of text, so memory does not grow with
    their number; each block is compared with all documents.
    """
    docs = bounded(docs).drop("hits")
    names = docs.columns
    for n, block in enumerate(_item_blocks(items, item_id, item_text, size)):
        docs = docs.withColumn(f"_hits{n}", F.lit(None).cast(HITS))
        if block is not None:
            docs = docs.mapInArrow(_search(block, threshold, size, text_col, f"_hits{n}"), docs.schema)
    found = [c for c in docs.columns if c not in names]
    merged = F.flatten(F.array(*[F.coalesce(c, F.array().cast(HITS)) for c in found]))
    return docs.select(*names, F.array_sort(merged).alias("hits"))


def _item_blocks(items: DataFrame, item_id: str, item_text: str, size: int) -> Iterator[dict | None]:
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = total // ITEM_BYTES + 1
    for n in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == n).toArrow()
        yield _signatures(rows, size)


def _signatures(rows: pa.Table, size: int) -> dict | None:
    """Shingles of each item and, for every size class, the minima of its bins."""
    words = find_words(*_lower(rows.column("text")), ALNUM)
    hashes, item = shingles(words, word_hashes(words), size)
    if not len(hashes):
        return None
    item, hashes = (x for x in np.unique(np.stack([item.astype(U), hashes]), axis=1))
    item = item.astype(np.int64)
    minima = {}
    for power in range(41):
        bin_of = hashes >> U(64 - _bits(power))
        first = np.ones(len(item), bool)
        first[1:] = (bin_of[1:] != bin_of[:-1]) | (item[1:] != item[:-1])
        minima[power] = np.unique(hashes[first])
    sizes = np.bincount(item, minlength=rows.num_rows)
    return {"ids": rows.column("id").to_pylist(), "sizes": sizes, "minima": minima, "hash": hashes, "item": item,
            "few": np.unique(hashes[sizes[item] < FEW]), "every": np.unique(hashes)}


def _bits(power: int) -> int:
    """Address bits of the bins of size class ``power``."""
    return power + BINS.bit_length() - 1


def _lower(column) -> tuple[np.ndarray, np.ndarray]:
    data, off = buffers(column)
    return LOWER[data], off


def _distinct(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes of each text, ordered by text and hash."""
    order = np.argsort(hashes)
    order = order[np.argsort(text[order], kind="stable")]
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def _search(block: dict, threshold: float, size: int, text_col: str, out: str):
    ids, sizes = block["ids"], block["sizes"]
    known = np.zeros(1 << 20, bool)  # a quick test that nearly all shingles fail
    every = block["every"]
    known[(every >> U(44)).astype(np.int64)] = True

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            words = find_words(*_lower(part.column(text_col)), ALNUM)
            hashes, text = shingles(words, word_hashes(words), size)
            seen = np.flatnonzero(known[(hashes >> U(44)).astype(np.int64)])
            seen = seen[every[np.minimum(np.searchsorted(every, hashes[seen]), len(every) - 1)] == hashes[seen]]
            # texts without a shingle of any item need no signature
            some = np.zeros(part.num_rows, bool)
            some[text[seen]] = True
            hashes, text = _distinct(hashes[some[text]], text[some[text]])
            count = np.bincount(text, minlength=part.num_rows)
            power = np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64)
            bin_of = hashes >> (U(64) - (power + _bits(0)).astype(U)[text])
            least = np.ones(len(text), bool)
            least[1:] = (bin_of[1:] != bin_of[:-1]) | (text[1:] != text[:-1])
            mine = np.flatnonzero(known[(hashes >> U(44)).astype(np.int64)])
            few = np.isin(hashes[mine], block["few"])
            mine, few = mine[least[mine] | few], few[least[mine] | few]
            hits: list[list] = [[] for _ in range(part.num_rows)]
            for doc in np.unique(text[mine]):
                own = slice(*np.searchsorted(text[mine], [doc, doc + 1]))
                its = hashes[mine[own]]
                if few[own].any() or np.isin(its, block["minima"][int(power[doc])]).any():
                    lo, hi = np.searchsorted(text, [doc, doc + 1])
                    hits[doc] = verify(its, hashes[lo:hi])
            column = pa.array(hits, pa.list_(pa.struct([(n, pa.int64()) for n in
                                                        ("item_id", "n_shared", "n_shingles")])))
            yield part.set_column(part.schema.get_field_index(out), out, column)

    def verify(seen: np.ndarray, every: np.ndarray) -> list[dict]:
        """Exact containment of the items that share one of the hashes ``seen``."""
        candidates = set(block["item"][np.isin(block["hash"], seen)].tolist())
        shared = np.bincount(block["item"][np.isin(block["hash"], every)], minlength=len(ids))
        return [{"item_id": ids[i], "n_shared": int(shared[i]), "n_shingles": int(sizes[i])}
                for i in sorted(candidates) if shared[i] >= threshold * sizes[i]]

    return run
