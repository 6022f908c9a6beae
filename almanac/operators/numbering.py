"""Global row numbers without bringing all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from almanac.storage import materialize

_ROW_BITS = 33  # monotonically_increasing_id: the partition above them, the row below


def numbered(df: DataFrame, order: Sequence[str], into: str = "place") -> DataFrame:
    """Adds ``into``: the 0-based place of each row in ``order``, which should leave no ties.

    Ranges of the order are numbered each by itself and offset by the rows before
    them. They are written before they are counted, as range boundaries come from a sample
    and another run of the plan could draw others.
    """
    mark = F.monotonically_increasing_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(ranged.withColumn("__p", F.shiftright(mark, _ROW_BITS)).withColumn("__i", mark.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))), "numbered")
    sizes = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("n"))
    later = sizes.select(F.col("__p").alias("p"), "n")
    before = sizes.select("__p").join(later, F.col("p") < F.col("__p"), "left").groupBy("__p").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(before), "__p").withColumn(into, F.col("__before") + F.col("__i")).select(*df.columns, into)
