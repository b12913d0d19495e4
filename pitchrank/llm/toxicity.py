"""Toxicity by the nearest labelled examples, under exact TF-IDF cosine.

Texts become sparse vectors over terms that the labelled examples show to matter: words,
and beginnings of words (``PREFIXES`` letters), that toxic examples have far more often
than clean ones, by more than chance explains. Document frequencies are counted
over all documents.

The examples are held in a block-max inverted index: for every term the weights by block
of ``BLOCK`` examples, and the largest weight in each block. A query adds up, over its
terms, what each block could reach at most, and looks into blocks in falling order of
that bound until no further block can reach its k-th best similarity. So the k nearest
are exact. Their votes count by similarity.

Documents with the same vector are scored once. The number of examples is bounded
(``most_examples``), so the index is small, whatever the number of documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.llm.labels import pick_labels
from pitchrank.llm.textbytes import bounded, slices
from pitchrank.session import materialize

MOST_EXAMPLES = 20_000  # labelled rows learned from, at most
MOST_TERMS = 4_096
PREFIXES = (4, 5, 6, 7)
BLOCK = 64
NEIGHBOURS = 15
SMOOTHING = 0.25        # votes for the average share that every score starts from
CERTAIN = 5.0           # least deviation from chance, in standard errors,
RAISED = 3.0            # and least odds of a term's examples to be toxic, in average odds
WORD = re.compile(r"[^\W\d_]+")

_VECTOR = "terms array<int>, counts array<int>"


@dataclass
class Index:
    """Examples by their vectors, and the terms with their weights."""

    terms: dict[str, int]
    idf: np.ndarray
    first: np.ndarray      # where each term's postings begin, and one more
    example: np.ndarray    # postings by term, then example: the example
    weight: np.ndarray     # and the term's weight in it (vectors have length 1)
    block_first: np.ndarray  # where each term's blocks begin, and one more
    block: np.ndarray      # blocks by term: which block of examples,
    block_best: np.ndarray   # the largest weight in it,
    block_at: np.ndarray   # and where its postings begin, and one more
    toxic: np.ndarray      # per example: labelled rows that are toxic,
    total: np.ndarray      # and all of them (rows with one vector are one example)
    ids: np.ndarray        # smallest document id of each example
    prior: float           # share of toxic rows
    plain: float           # the same among rows without any of the terms


def term_counts(text: str | None, terms: dict[str, int] | None = None) -> Counter:
    """Words and word beginnings of a text in lower case; with ``terms``, only these, by number."""
    words = Counter(WORD.findall((text or "").lower()))
    out: Counter = Counter()
    for word, n in words.items():
        for name in (word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]):
            if terms is None:
                out[name] += n
            elif name in terms:
                out[terms[name]] += n
    return out


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", most_examples: int = MOST_EXAMPLES) -> Index:
    """Learns from ``docs`` (doc_id and text) with ``labels`` (doc_id, toxic 0 or 1).

    Document frequencies are those of all ``docs``. If more than ``most_examples``
    documents are labelled, a hash of their ids picks about that many. A document counts
    as toxic if one of several labels says so. Rows without a text, an id or a label teach
    nothing. With no examples at all, every score is one half.
    """
    bounded(docs)
    picked = pick_labels(labels, "toxic", most_examples)
    sample = materialize(docs.select("doc_id", F.col(text_col).alias("text")).where("text IS NOT NULL")
                         .join(F.broadcast(picked), "doc_id").repartition(max(1, most_examples // 500)), "examples")
    toxic_rows, all_rows = sample.agg(F.sum("toxic"), F.count("*")).first()
    prior = ((toxic_rows or 0) + 0.5) / (all_rows + 1)
    terms = _choose_terms(sample, toxic_rows or 0, all_rows)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_vectors(terms), _VECTOR)
    seen = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # at most MOST_TERMS
    n = docs.count()
    df = np.zeros(len(terms))
    for row in seen:
        df[row["term"]] = row["count"]
    idf = np.log((n + 1) / (df + 1)) + 1
    vectors = sample.select("doc_id", "toxic", "text").mapInArrow(_vectors(terms, "doc_id", "toxic"),
                                                                 f"doc_id long, toxic int, {_VECTOR}")
    examples = vectors.groupBy("terms", "counts").agg(
        F.min("doc_id").alias("doc_id"), F.sum("toxic").alias("toxic"), F.count("*").alias("total")).collect()
    empty = [e for e in examples if not e["terms"]]
    filled = sorted((e for e in examples if e["terms"]), key=lambda e: (e["terms"], e["counts"]))
    column = lambda name: np.array([e[name] or 0 for e in filled], np.int64)
    return Index(terms, idf, *_postings(filled, idf), column("toxic"), column("total"), column("doc_id"), prior,
                 (sum(e["toxic"] for e in empty) + 2 * prior) / (sum(e["total"] for e in empty) + 2))


def _postings(examples: list, idf: np.ndarray) -> tuple[np.ndarray, ...]:
    sizes = [len(e["terms"]) for e in examples]
    example = np.repeat(np.arange(len(examples)), sizes)
    none = [np.zeros(0)]
    term = np.concatenate([np.array(e["terms"]) for e in examples] or none).astype(np.int64)
    weight = np.concatenate([_weights(np.array(e["counts"]), idf[e["terms"]]) for e in examples] or none)
    order = np.lexsort((example, term))
    term, example, weight = term[order], example[order], weight[order]
    block = example // BLOCK
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
    at = np.flatnonzero(new)
    best = np.maximum.reduceat(weight, at) if len(at) else np.zeros(0)
    every = np.arange(len(idf) + 1)
    return (np.searchsorted(term, every), example, weight, np.searchsorted(term[at], every), block[at], best,
            np.append(at, len(term)))


def _choose_terms(sample: DataFrame, toxic_rows: int, all_rows: int) -> dict[str, int]:
    """The terms whose toxic share is furthest from the average, in standard errors."""
    if not all_rows:
        return {}

    def names(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            found = [(name, t) for text, t in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(),
                                                  strict=True) for name in term_counts(text)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()),
                                              pa.array([x[1] for x in found], pa.int32())], names=["term", "toxic"])

    share = (toxic_rows + 0.5) / (all_rows + 1)
    shares = sample.select("text", "toxic").mapInArrow(names, "term string, toxic int").groupBy("term").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("t"))
    error = F.sqrt(F.col("n") * share * (1 - share) + 1)
    scored = shares.withColumn("z", (F.col("t") - F.col("n") * share) / error).where(
        (F.col("z") >= CERTAIN) & (F.col("t") * (1 - share) >= (F.col("n") - F.col("t")) * RAISED * share))
    best = scored.orderBy(F.desc("z"), "term").limit(MOST_TERMS).collect()
    return {row["term"]: i for i, row in enumerate(best)}


def _weights(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weight = (1 + np.log(counts)) * idf
    return weight / np.sqrt((weight ** 2).sum())


def _vectors(terms: dict[str, int], *passed: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 2 << 20):
            found = [sorted(term_counts(text, terms).items()) for text in part.column("text").to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in passed], pa.array([[t for t, _ in x] for x in found], kind),
                 pa.array([[n for _, n in x] for x in found], kind)], names=[*passed, "terms", "counts"])

    return run


def nearest(index: Index, terms: np.ndarray, counts: np.ndarray, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar examples and their cosines; ties go to the example listed first."""
    query = _weights(counts, index.idf[terms])
    spans = [np.arange(index.block_first[t], index.block_first[t + 1]) for t in terms]
    place = np.concatenate(spans)
    reach = np.bincount(index.block[place], index.block_best[place] * np.repeat(query, [len(x) for x in spans]))
    asked = np.repeat(query, [len(x) for x in spans])
    by_block = np.argsort(index.block[place], kind="stable")
    cuts = np.searchsorted(index.block[place][by_block], np.arange(len(reach) + 1))
    similar, found = np.zeros(0), np.zeros(0, np.int64)
    for block in np.argsort(-reach, kind="stable"):
        if reach[block] <= 0 or (len(similar) == k and reach[block] < similar[-1] - 1e-9):
            break
        total = np.zeros(BLOCK)
        for i in by_block[cuts[block]:cuts[block + 1]]:
            a, b = index.block_at[place[i]], index.block_at[place[i] + 1]
            total[index.example[a:b] - block * BLOCK] += index.weight[a:b] * asked[i]
        some = np.flatnonzero(total)
        similar, found = np.concatenate([similar, total[some]]), np.concatenate([found, some + block * BLOCK])
        order = np.lexsort((found, -similar))[:k]
        similar, found = similar[order], found[order]
    return found, similar


def _vote(index: Index, terms: list[int], counts: list[int]) -> tuple[float, list[dict]]:
    if not terms:
        return index.plain, []
    found, similar = nearest(index, np.array(terms), np.array(counts))
    if not len(found):
        return index.prior, []
    weight = similar.astype(float) ** 2
    score = (weight * index.toxic[found]).sum() + SMOOTHING * index.prior
    score = float(score / ((weight * index.total[found]).sum() + SMOOTHING))
    return min(max(score, 0.0), 1.0), [
        {"doc_id": int(index.ids[i]), "similarity": float(s), "toxic_share": float(index.toxic[i] / index.total[i])}
        for i, s in zip(found[:3], similar[:3], strict=True)]


def score(docs: DataFrame, index: Index, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: likelier toxic) and ``evidence``.

    ``evidence`` lists up to three nearest examples with their similarity and share of
    toxic labels. A text without any of the terms, null and empty ones among them, gets
    the share of toxic rows among such examples. One row comes back for each row; columns
    named like an added one are replaced.
    """
    docs = bounded(docs).drop("score", "evidence")
    terms = index.terms

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple] = {}
        for part in slices(batches, text_col, 2 << 20):
            out = []
            for text in part.column(text_col).to_pylist():
                found = sorted(term_counts(text, terms).items())
                key = tuple(found)
                if key not in known:
                    if len(known) > 5_000:
                        known.clear()
                    known[key] = _vote(index, [t for t, _ in found], [n for _, n in found])
                out.append(known[key])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()),
                                       ("toxic_share", pa.float64())]))
            yield part.append_column("score", pa.array([s for s, _ in out], pa.float64())).append_column(
                "evidence", pa.array([e for _, e in out], kind))

    evidence = T.ArrayType(T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(
        "similarity", T.DoubleType()), T.StructField("toxic_share", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()),
                                              T.StructField("evidence", evidence)]))
