"""Joining rows to a table with one row per key, without trusting the key sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchrank.session import materialize

BROADCAST_BYTES = 64 * 1024 * 1024


def weighed(df: DataFrame, name: str = "lookup") -> tuple[DataFrame, int]:
    """``df`` written and read back, and the size of its rows in memory.

    Rows and the bytes of text columns are counted while it is written, without a job of their own.
    """
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema
             if isinstance(f.dataType, T.StringType)]
    text = F.sum(reduce(lambda a, b: a + b, texts)) if texts else F.lit(0)
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), text.alias("chars")), name)
    found = seen.get
    return table, found["rows"] * (16 + 8 * len(df.columns)) + (found["chars"] or 0)


def lookup_join(df: DataFrame, lookup: DataFrame, keys: list[str], rows: str | None = None,
                how: str = "left", limit: int | None = None) -> DataFrame:
    """Join ``df`` to ``lookup`` (one row per key) by ``left``, ``inner`` or ``left_semi``.

    ``lookup[rows]`` is the number of rows of ``df`` a key has; it is dropped. Without it
    the rows are counted, but only if the lookup turns out too large to be broadcast. The
    lookup is written once and measured. Up to ``limit`` (64 MB) it is broadcast and
    ``df`` is not shuffled at all. Beyond that the hot keys are split off: those with more
    rows than an even share of a shuffle partition, so there are fewer of them than
    partitions. They are broadcast, and only rows of the remaining keys are shuffled,
    none of which can hold more than that share. Rows with a null key match nothing and
    are not shuffled either.
    """
    small, size = weighed(lookup)
    if size <= (BROADCAST_BYTES if limit is None else limit):
        return _join(df, small.drop(rows) if rows else small, keys, how, small=True)
    if rows is None:
        rows = "_rows_of_key"
        counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias(rows))
        small = materialize(small.join(counts, keys).select(*small.columns, rows), "lookup")

    total = small.agg(F.sum(rows)).first()[0] or 0
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = small.where(F.col(rows) * parts > F.lit(total))
    cold = small.where(F.coalesce(F.col(rows) * parts <= F.lit(total), F.lit(True)))
    no_null = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])

    keyed = df.where(no_null)
    rest = keyed.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    parts = [
        _join(keyed, hot.drop(rows), keys, "left_semi" if how == "left_semi" else "inner", small=True),
        _join(rest, cold.drop(rows), keys, how, small=False),
    ]
    if how == "left":
        added = {f.name: F.lit(None).cast(f.dataType) for f in small.schema
                 if f.name not in (*keys, rows)}
        parts.append(df.where(~no_null).withColumns(added))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _join(df: DataFrame, lookup: DataFrame, keys: list[str], how: str, small: bool) -> DataFrame:
    if how == "left_semi":
        lookup = lookup.select(*keys)
    joined = df.join(F.broadcast(lookup) if small else lookup, keys, how)
    # a join by name moves the keys to the front; keep the caller's column order
    added = [c for c in lookup.columns if c not in keys]
    return joined.select(*df.columns, *(added if how != "left_semi" else []))
