"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MASK = (1 << 33) - 1


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with 1-based numbers in ``order``.

    With a checkpoint folder, rows are sorted by ranges, kept there, and numbered within each partition; only a count for
    each partition is gathered to offset them.  Without one (small local sessions) a plain window does.
    """
    if not df.sparkSession.sparkContext.getCheckpointDir():
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    placed = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftrightunsigned("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).orderBy("_part").collect()
    before, offsets = 0, []
    for row in counts:
        offsets.append((row["_part"], before))
        before += row["_n"]
    # A row for each partition, so it may be sent to every task.
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    numbered = placed.withColumn("_part", part).join(starts, "_part")
    return numbered.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(_MASK)) + 1).drop("_at", "_part", "_before")
