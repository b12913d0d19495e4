"""Standard scores within groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchrank import params as P
from pitchrank.operators.joins import lookup_join


def add_zscores(df: DataFrame, columns=P.ZSCORE_COLUMNS,
                keys=("pitch_type", "season")) -> DataFrame:
    """Add ``z_<column>``: distance from the group mean in sample deviations.

    A group without spread (one row, or one value) scores 0, its null values
    included; elsewhere null stays null. The groups are few and large, so their
    statistics are aggregated and joined back; a window would pull each whole group
    into one task.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    keys = list(keys)
    measures = []
    for c in present:
        measures += [F.avg(c).alias(f"_m_{c}"),
                     # equal values can leave a rounding residue in the deviation
                     F.when(F.min(c) < F.max(c), F.stddev_samp(c)).alias(f"_s_{c}")]
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *measures)

    def score(c):
        mean, sd = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        return F.when(sd > 0, (F.col(c) - mean) / sd).otherwise(F.lit(0.0))

    joined = lookup_join(df, stats, keys, "_rows")
    return (joined.withColumns({f"z_{c}": score(c) for c in present})
                  .select(*df.columns, *[f"z_{c}" for c in present]))
