"""Landing as a stream: files of raw events arrive, repeats are dropped, each batch goes through the upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from almanac.operators.landing import RAW_KEY, upsert_ignore


def land_stream(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, watermark: tuple[str, str] | None = None, key=RAW_KEY) -> StreamingQuery:
    """Follow a folder of JSON lines and append new keys to the Parquet table at ``target``; ends when what is there has been read.

    With ``watermark`` (column, delay) repeats inside the delay are dropped in the
    stream's state already; the upsert drops those that come later.
    """
    rows = spark.readStream.schema(schema).json(folder)
    if watermark:
        rows = rows.withWatermark(*watermark).dropDuplicatesWithinWatermark([*key])

    def land(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        try:
            there = own.read.parquet(target)
        except AnalysisException:
            there = own.createDataFrame([], batch.schema)
        upsert_ignore(there, batch, key).write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
