"""Helpers that the corpus operators share: shared storage, table access, words."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac.storage import materialize, new_path, shared_dir, table

__all__ = ["materialize", "new_path", "numbered_alike", "shared_dir", "slices", "split_words", "table", "utf8"]

#: Alike rows that are numbered at one place.
ALIKE_ROWS = 4096


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; nothing for null."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def split_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() separates at exactly these six characters."""
    return utf8(text).split()


def slices(batches, rows: int = 1000):
    """Arrow batches cut into pieces, so that what Python makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def numbered_alike(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: rows alike in all columns are numbered from 0, so that no two results are alike.

    Alike rows are counted, map side first, the counts written, so that ``rows`` is read once, and rows made again from them; where there
    are more than ALIKE_ROWS, in runs of that many, dealt to all tasks. An empty table gives no rows.
    """
    names = rows.columns
    alike = materialize(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__n")), "alike")
    few = alike.filter(F.col("__n") <= ALIKE_ROWS).select(*names, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("copy"))
    runs = alike.filter(F.col("__n") > ALIKE_ROWS).select(*names, "__n", F.explode(F.expr(f"sequence(0L, __n - 1, {ALIKE_ROWS}L)")).alias("__from")).repartition(*names, "__from")
    many = runs.select(*names, F.explode(F.expr(f"sequence(__from, least(__n, __from + {ALIKE_ROWS}) - 1)")).alias("copy"))
    return few.unionByName(many)
