"""SimHash near-duplicates: exact comparison of all fingerprints within a radius, in tiles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .batches import by_bytes
from .components import stars

SHINGLE, SEED, RADIUS, BITS = 4, 42, 4, 64
TILE = 4096
_CHUNK = 512
_HASHES = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' hashes, repeats counted, as a signed number."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII blanks count
    if not words:
        return 0
    parts = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(p), seed) for p in parts), dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _HASHES):
        ones += np.unpackbits(hashes[i:i + _HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: Column, column: str = "fp") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of ``text``, a long; null text has 0."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.withColumn(column, of(text))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp)``, one row per row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                values = [fingerprint(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def agreement_keys(n: int, radius: int = RADIUS, tile: int = TILE) -> list[list[tuple[int, int]]]:
    """Bit ranges ``(shift, width)`` such that fingerprints within ``radius`` are equal in
    all ranges of one key at least.

    ``radius + a`` blocks of bits leave ``a`` blocks untouched by ``radius`` changes, so
    there is a key for each choice of ``a`` blocks.  ``a`` and the bits used grow with the
    number of fingerprints, to keep about a tile of them behind a key value."""
    need = max(0, -(-n // tile) - 1).bit_length()
    if not need:
        return [[]]
    agree = next((a for a in (1, 2, 3) if a * (BITS // (radius + a)) >= need), 4)
    width = BITS // (radius + agree)
    need = min(need, agree * width)
    keys = []
    for chosen in combinations(range(radius + agree), agree):
        left, ranges = need, []
        for block in chosen:
            take = min(width, left)
            if take:
                ranges.append((block * width, take))
            left -= take
        keys.append(ranges)
    return keys


def _key(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    value = F.lit(0).cast("long")
    for shift, width in ranges:
        value = F.shiftleft(value, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
    return value


def links_within(values: np.ndarray, other: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(node, smaller node)`` that connect what pairs within ``radius`` connect.

    Both sides are sorted by population count and compared chunk by chunk with exclusive-or
    and bit counts; chunks whose population counts lie further apart than the radius are
    skipped.  Pairs go into a forest at once, so a dense tile gives a link per node."""
    def ordered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = np.bitwise_count(x)
        order = np.argsort(ones, kind="stable")
        return x[order], ones[order].astype(np.int64)

    a, ones_a = ordered(values)
    b, ones_b = (a, ones_a) if other is None else ordered(other)
    nodes = a if other is None else np.concatenate([a, b])
    base = 0 if other is None else len(a)
    root = np.arange(len(nodes))
    for i in range(0, len(a), _CHUNK):
        low, high = ones_a[i] - radius, ones_a[min(i + _CHUNK, len(a)) - 1] + radius
        start, stop = np.searchsorted(ones_b, low, "left"), np.searchsorted(ones_b, high, "right")
        if other is None:
            start = max(start, i)
        for j in range(start, stop, _CHUNK):
            end = min(j + _CHUNK, stop)
            x, y = np.nonzero(np.bitwise_count(a[i:i + _CHUNK, None] ^ b[None, j:end]) <= radius)
            x, y = x + i, y + j + base
            if other is None:
                x, y = x[x < y], y[x < y]
            while len(x):
                x, y = root[x], root[y]
                x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
                np.minimum.at(root, y, x)
                while not np.array_equal(root, up := root[root]):
                    root = up
    far = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[far], nodes[root[far]]


def near_links(distinct: DataFrame, n: int, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``radius``.

    ``distinct`` is a written table of ``n`` different fingerprints ``fp``.  Each goes to
    one bucket per agreement key.  Buckets above a tile are cut into tiles along the
    population count, and a fingerprint is sent to the pairs of its tile with every tile
    that holds counts within the radius of its own; every pair of tiles is one small
    group.  No pair within the radius is left out at any size."""
    keys = agreement_keys(n, radius, tile)
    rows = distinct.select("fp", F.bit_count("fp").cast("int").alias("ones"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("part"), _key(F.col("fp"), ranges).alias("value")) for k, ranges in enumerate(keys)])).alias("k")
    ).select("fp", "ones", "k.part", "k.value")
    # rows of a bucket by population count: where each count starts, at most 65 of them
    counts = rows.groupBy("part", "value", "ones").agg(F.count(F.lit(1)).alias("n"))
    shape = counts.groupBy("part", "value").agg(F.map_from_entries(F.collect_list(F.struct("ones", "n"))).alias("counts"))
    def below(ones: Column) -> Column:
        return F.aggregate(F.map_entries("counts"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] < ones, e["value"]).otherwise(0))

    ones = F.col("ones")
    at = below(ones) + F.pmod(F.xxhash64("fp"), F.element_at("counts", ones))
    tiled = rows.join(shape, ["part", "value"]).select(
        "fp", "part", "value", F.floor(at / tile).alias("own"), F.floor(below(ones - radius) / tile).alias("low"),
        F.floor((below(ones + radius + 1) - 1) / tile).alias("high"))
    sent = tiled.select("fp", "part", "value", "own", F.explode(F.sequence("low", "high")).alias("other"))
    pairs = sent.select("part", "value", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                        (F.col("own") <= F.col("other")).alias("left"), "fp")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, left = group["fp"].to_numpy().view(np.uint64), group["left"].to_numpy()
        one = group["x"].iat[0] == group["y"].iat[0]
        a, b = links_within(fp, None, radius) if one else links_within(fp[left], fp[~left], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return pairs.groupBy("part", "value", "x", "y").applyInPandas(compare, "a long, b long")


def component_labels(prints: DataFrame, id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``(fp, component_id)`` for every fingerprint of the written table ``prints``: the
    smallest ID whose fingerprint can be reached; null if no ID of the group is set."""
    nodes = materialize(prints.groupBy("fp").agg(F.min(id_column).alias("first")), "fingerprints")
    roots = stars(near_links(nodes.select("fp"), nodes.count(), radius), "links")
    labelled = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    labelled = materialize(labelled, "labels")
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return labelled.join(least, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row.

    Null and empty texts have fingerprint zero and are linked like any other.  Repeated
    rows share a component; a null ID is never a component's.  An empty table gives no
    rows; other columns are ignored."""
    prints = materialize(fingerprints(docs), "prints")
    return prints.join(component_labels(prints, radius=radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, with all their columns, less all but one of each component:
    the one with the smallest ID stays, of rows that share it the first as written; a row
    without an ID only where no row of its component has one."""
    packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    rows = materialize(with_fingerprints(packed, F.col("row.text")).withColumn("place", F.monotonically_increasing_id()), "rows")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place"))
    nodes = materialize(rows.groupBy("fp").agg(best.alias("first")), "fingerprints")
    roots = stars(near_links(nodes.select("fp"), nodes.count(), radius), "links")
    joined = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    kept = joined.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.place").alias("place"))
    return rows.join(kept, "place", "left_semi").select("row.*")
