"""Gapless ranks over any number of rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize

ROWS_PER_BUCKET = 50_000
LEAST_BUCKETS = 256
KEY_BITS = 60


def bucket_count(rows: int) -> int:
    """Buckets of about ``ROWS_PER_BUCKET`` rows; never fewer than ``LEAST_BUCKETS``."""
    return max(LEAST_BUCKETS, -(-rows // ROWS_PER_BUCKET))


def shuffle_key(seed: int, *cols: Column) -> Column:
    """A pseudo-random integer of ``KEY_BITS`` bits, the same on every run and engine.
    Null counts as an empty text."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def key_bucket(key: Column, buckets: int) -> Column:
    """Equal ranges of a ``shuffle_key``, in its order."""
    return F.shiftright(F.shiftright(key, KEY_BITS - 32) * F.lit(buckets), 32)


def with_ranks(rows: DataFrame, group: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """Adds ``rank`` (from 0 within ``group``, by ``bucket``, then ``order``) and ``total``.

    Each bucket is numbered alone and moved by the rows of the buckets before it, so a
    group that holds most rows is spread over its buckets.  ``bucket`` must not fall
    where ``order`` rises.  Group columns must not be null.  Rows that tie in ``order``
    should be equal, as their order is open."""
    dealt = rows.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket")
    starts = dealt.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        *group, "_bucket",
        (F.sum("_n").over(before) - F.col("_n")).alias("_start"),
        F.sum("_n").over(Window.partitionBy(*group)).alias("total"))
    own = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return dealt.join(starts, [*group, "_bucket"]).withColumn(
        "rank", F.col("_start") + F.row_number().over(own) - 1).drop("_bucket", "_start")


def per_group(small: DataFrame, label: str) -> DataFrame:
    """A table with few rows per group, written, and sent to all tasks if its size allows:
    then no join deals the rows of a large group to one task."""
    return broadcast_if_small(materialize(small, label))


def first_by_key(rows: DataFrame, group: str, most: Column, ties: tuple[str, ...] = ()) -> DataFrame:
    """Of each ``group`` the ``most`` rows with the smallest ``key``, a ``shuffle_key``.

    Keys are evenly spread, so the number of different ones says below which key these rows
    lie, with a margin far wider than the error of that number; only rows below it are sorted."""
    counts = per_group(rows.groupBy(group).agg(F.approx_count_distinct("key", 0.05).alias("_of")), "group-sizes")
    near = rows.join(counts, group).withColumn("_most", most).filter(
        F.col("key") <= F.least(F.lit(1.0), (4 * F.col("_most") + 100) / F.col("_of")) * F.lit(float(2 ** KEY_BITS)))
    order = Window.partitionBy(group).orderBy("key", *ties)
    return near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= F.col("_most")).drop("_of", "_most", "_n")
