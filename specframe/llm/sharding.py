"""Shards that all hold the same mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .ranks import KEY_BITS, bucket_count, key_bucket, shuffle_key, with_ranks

ROW_OVERHEAD = 16


def stratum(source: Column) -> Column:
    """A source as a key that is never null: null is a stratum of its own."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def interleave(docs: DataFrame, shards: int, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, source, size, text_crc32, law, shard, slot, grown_shard)``, one row per row.

    Rows are ranked in seeded random order within their source.  Rank ``r`` of ``n`` gets
    the fraction ``(r + phase) / n``, where the phase is a seeded number of the source, so
    that small sources do not all meet at the same fractions.  All rows in the order of
    their fractions are cut into ``shards`` runs whose lengths differ by one at most, and
    every run holds each source in its share.  The method has no groups: equal texts are
    rows like any others.

    Nulls: a null source is a source of its own, a null text has no bytes and CRC 0, null
    IDs share a random key.  Equal rows take neighbouring places in any order.  Texts count
    by their bytes alone, however long.  An empty table gives no rows; other columns but
    those in ``keep`` are ignored."""
    total = docs.count()
    buckets = bucket_count(total)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       stratum(F.col("source")).alias("stratum"), shuffle_key(seed, F.col("doc_id")).alias("key"), *keep)
    ties = [F.col(c) for c in ("key", "doc_id", "text_crc32", "size")]
    ranked = with_ranks(rows, ["stratum"], key_bucket(F.col("key"), buckets), ties)
    phase = shuffle_key(seed, F.col("stratum")).cast("double") / F.lit(float(2 ** KEY_BITS))
    placed = materialize(ranked.withColumn("fraction", (F.col("rank") + phase) / F.col("total")).drop("rank", "total"), "fractions")
    along = F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1))
    cut = with_ranks(placed.withColumn("all", F.lit(0)), ["all"], along, [F.col("fraction"), F.col("stratum"), *ties])
    shard = F.expr(f"rank * {shards} div {max(1, total)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return cut.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *keep)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0) -> None:
    """The documents, whatever their IDs, as one folder per shard, whose files follow each
    other in slot order.  A shard of any size is spread over tasks by slot."""
    rows = materialize(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("place")), "rows")
    placed = interleave(rows.select("place", "row.doc_id", "row.source", "row.text"), shards, seed, ("place",))
    whole = rows.join(placed.select("place", "shard", "slot"), "place")
    ordered = whole.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
