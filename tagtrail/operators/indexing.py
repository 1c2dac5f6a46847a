"""Global dense indexes (0..N-1 in a sort order)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

# monotonically_increasing_id holds the partition above and the row below this bit
ROW_BITS = 33


def dense_index(df: DataFrame, order: Sequence[str | F.Column], name: str = "idx") -> DataFrame:
    """Add ``name`` = 0-based position (bigint) of each row in ``order`` (which
    should be unique so the index is deterministic).

    Rows are range partitioned, sorted and written once with their place in
    their partition; the partitions' counts, one row each, give the offsets.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_place", F.monotonically_increasing_id())
    rows = cut_lineage(ranged, "dense_index").withColumn("_part", F.shiftright("_place", ROW_BITS))
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + place).select(*df.columns, name)
