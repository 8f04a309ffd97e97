"""Join with a table that is usually tiny but has no fixed bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conceptspark.session import cut_lineage

BROADCAST_ROWS = 100_000


def join_counted(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join ``df`` with per-key facts such as class quotas or cohort limits.

    The keys of such tables are few and skewed: shuffling ``df`` by them would gather a dominant class in one
    task. ``small`` is written and counted first; up to ``BROADCAST_ROWS`` rows it is broadcast and ``df`` stays where
    it is. Beyond that the join is shuffled and adaptive execution splits the skewed partitions.
    """
    small = cut_lineage(small)
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_ROWS else small, keys, how)
