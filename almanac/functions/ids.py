"""Stable ids from hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.text import empty
from almanac.operators.numbering import numbered


def _hex_long(c: Column, digits: int) -> Column:
    return F.conv(F.substring(c, 1, digits), 16, 10)


def event_id(url: Column, title: Column, date: Column) -> Column:
    """52 bits of the SHA-256 of the URL, or of title and date where there is none."""
    key = F.when(empty(url) != "", url).otherwise(F.concat(empty(title), F.lit("|"), empty(date)))
    return _hex_long(F.sha2(key, 256), 13).cast("long")


def group_id63(key: Column) -> Column:
    """The first eight bytes of the SHA-256 without their sign bit."""
    return (_hex_long(F.sha2(key, 256), 16).cast("decimal(20,0)") % F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def group_id31(key: Column) -> Column:
    """MD5 modulo 2 ** 31."""
    return _hex_long(F.substring(F.md5(key), 25, 8), 8).cast("long") % F.lit(2147483648)


def row_hash(*cols: str) -> Column:
    """SHA-256 of the named columns as JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(*sorted(cols))), 256)


def resolve_collisions(df: DataFrame, url: str, title: str, date: str, order: str) -> DataFrame:
    """Adds ``id``: the event id, hashed again with URL, title and 0-based place in ``order`` for rows whose id an earlier row has."""
    placed = numbered(df.withColumn("__h", event_id(F.col(url), F.col(title), F.col(date))), [order], "__at")
    firsts = placed.groupBy("__h").agg(F.min("__at").alias("__first"))
    again = F.concat_ws("|", empty(F.col(url)), empty(F.col(title)), F.col("__at").cast("string"))
    out = placed.join(firsts, "__h")
    return out.withColumn("id", F.when(F.col("__at") == F.col("__first"), F.col("__h")).otherwise(_hex_long(F.sha2(again, 256), 13).cast("long"))).select(*df.columns, "id")
