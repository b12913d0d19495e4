"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PARTS = 1 << 40


def pick(rows: DataFrame, most: int, id_col: str = "doc_id") -> DataFrame:
    """All rows if there are no more than ``most``, else those that a hash of the id picks, about 95 % of ``most``."""
    total = rows.count()
    if total <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(id_col), F.lit(_PARTS)) < int(0.95 * most / total * _PARTS))


def pick_labels(labels: DataFrame, label_col: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of about ``most`` ids at most, the larger label of an id; small enough to be broadcast."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(
        F.max(F.col(label_col).cast("int")).alias(label_col))
    return pick(known, most, id_col)
