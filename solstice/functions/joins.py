"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dim_join(fact: DataFrame, dim: DataFrame, on, how: str = "inner", *, bounded: bool = False) -> DataFrame:
    """Join a large side to a lookup side on named columns.

    ``bounded=True`` is for lookups whose row count is fixed by construction (months, seasons, grid
    cells, countries); these are broadcast. Anything else is a plain join: the adaptive planner
    broadcasts a side that turns out small and splits the tasks of a hot key.
    """
    on = [on] if isinstance(on, str) else list(on)
    return fact.join(F.broadcast(dim) if bounded else dim, on, how)


def spread(scan: DataFrame) -> DataFrame:
    """Give costly per-row work on a small table one partition per core.

    For plain scans: a table that already has as many partitions (any large one) is left as it is.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
