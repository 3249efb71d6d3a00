"""Exact top-k by inner product over a bit-sliced index of quantised vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize

SCALE = 64
BLOCK, QUERY_BLOCK = 32_768, 512
LARGEST = 2.0 ** 63


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """``floor(scale * x)`` of every component; null if the vector or a component is null
    or not finite, or if a cell does not fit a long."""
    cells = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    usable = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) * scale < LARGEST, F.lit(False)))
    return F.when(usable, cells.cast("array<long>"))


class BitSlices:
    """The index of one block: rows as bits, one bitmap for each bit of each component.

    Components are shifted by their least value, so slices hold no signs; the shifted
    values of longs fit 64 bits without a sign."""

    def __init__(self, rows: np.ndarray):
        self.rows, (self.n, self.dims) = rows, rows.shape
        self.words = -(-self.n // 64)
        self.least = rows.min(axis=0) if self.n else np.zeros(self.dims, dtype=np.int64)
        shifted = rows.astype(np.uint64) - self.least.astype(np.uint64)
        self.widths = [int(w).bit_length() for w in shifted.max(axis=0)] if self.n else [0] * self.dims
        self.slices = [[self._pack(column >> np.uint64(k) & np.uint64(1)) for k in range(width)]
                       for column, width in zip(shifted.T, self.widths, strict=True)]
        self.inverse = [[~s for s in slices] for slices in self.slices]
        self.all = self._pack(np.ones(self.n, dtype=np.int64))

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, dtype=np.uint8)
        packed = np.packbits(bits.astype(bool), bitorder="little")
        out[:len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the bits of every row's score, less a number that all rows share.

        A negative weight takes the inverted slices.  Bitmaps of one place value are added
        three to two, sum here and carry one place up, until one is left in each place."""
        places: list[list[np.ndarray]] = []
        for weight, slices, inverse in zip(query.tolist(), self.slices, self.inverse, strict=True):
            rest, shift = abs(weight), 0
            chosen = slices if weight > 0 else inverse
            while rest:
                if rest & 1:
                    while len(places) < shift + len(chosen):
                        places.append([])
                    for k, bitmap in enumerate(chosen):
                        places[shift + k].append(bitmap)
                rest, shift = rest >> 1, shift + 1
        out, k = [], 0
        while k < len(places):
            waiting = places[k]
            if len(waiting) > 1 and k + 1 == len(places):
                places.append([])
            while len(waiting) > 2:
                a, b, c = waiting.pop(), waiting.pop(), waiting.pop()
                half = a ^ b
                waiting.insert(0, half ^ c)
                places[k + 1].append((a & b) | (half & c))
            if len(waiting) == 2:
                a, b = waiting
                places[k + 1].append(a & b)
                waiting = [a ^ b]
            out.append(waiting[0] if waiting else np.zeros(self.words, dtype=np.uint64))
            k += 1
        return out

    def top(self, query: np.ndarray, k: int, without: range = range(0)) -> np.ndarray:
        """Rows of the ``k`` highest scores, but for those in ``without``, ties to the first rows.

        From the most significant slice down, rows with the bit are taken while they fit;
        what still ties at the end is the boundary, and its first rows fill up."""
        alive = self.all.copy()
        if without:
            own = np.zeros(self.words * 64, np.int64)
            own[without.start:without.stop] = 1
            alive &= ~self._pack(own)
        taken, held = np.zeros(self.words, dtype=np.uint64), 0
        for bitmap in reversed(self.sums(query)):
            high = alive & bitmap
            n = int(np.bitwise_count(high).sum())
            if held + n > k:
                alive = high
            else:
                taken, held, alive = taken | high, held + n, alive & ~bitmap
        boundary = self._rows(alive)[:k - held]
        return np.concatenate([self._rows(taken), boundary])

    def _rows(self, bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _matrix(cells: pa.Array | pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(cells), dims), dtype=np.int64)
    for i, row in enumerate(cells):
        out[i, :len(row)] = row
    return out


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of rows with a query, exact; an error if one does not fit a long."""
    most = [float(np.abs(x.astype(float)).max(initial=0)) for x in (rows, query)]
    if most[0] * most[1] * max(1, len(query)) < 2 ** 62:
        return rows @ query
    exact = rows.astype(object) @ query.astype(object)
    if any(not -2 ** 63 <= v < 2 ** 63 for v in exact):
        raise OverflowError("an inner product among the results does not fit a long")
    return exact.astype(np.int64)


def exact_top(vectors: DataFrame, k: int, is_query: Column, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each ID of ``vectors (vec_id, q)`` that is a
    query the ``k`` rows of other IDs with the highest inner products, ties to the smaller ID.

    Rows go to blocks, queries to blocks of their own, both by a hash of the row; each block
    of queries meets each block of rows in a task of its own, which builds the bit-sliced
    index of its rows and returns ``k`` rows per query, and these are merged by query.
    Exact search compares all queries with all rows, so a row is sent once per block of
    queries; larger ``query_block`` sends less and makes longer tasks.
    Null IDs and vectors take no part; rows that share an ID are rows of their own, as
    candidates and, if it is a query, as questions under one number; shorter vectors are filled up with zeros.  An empty table gives no rows."""
    rows = materialize(vectors.filter("vec_id IS NOT NULL AND q IS NOT NULL").withColumn("place", F.monotonically_increasing_id()), "vectors")
    n, wanted = rows.count(), rows.filter(is_query).count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-wanted // query_block))
    spread = F.xxhash64("place")
    one = F.lit(1).cast("long")
    candidates = rows.select(F.pmod(spread, blocks).alias("b"), F.explode(F.sequence(one * 0, one * (query_blocks - 1))).alias("a"),
                             F.lit(False).alias("asks"), "vec_id", "q")
    queries = rows.filter(is_query).select(F.explode(F.sequence(one * 0, one * (blocks - 1))).alias("b"), F.pmod(spread, query_blocks).alias("a"),
                                           F.lit(True).alias("asks"), "vec_id", "q")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        dims = int(group["q"].str.len().max())
        asks = group["asks"].to_numpy()
        own, asked = group[~asks].sort_values("vec_id"), group[asks]
        ids, index = own["vec_id"].to_numpy(), BitSlices(_matrix(own["q"], dims))
        query_ids, found, scores = [], [], []
        for query_id, query in zip(asked["vec_id"].to_numpy(), _matrix(asked["q"], dims), strict=True):
            hits = index.top(query, k, range(*np.searchsorted(ids, [query_id, query_id + 1]).tolist()))
            query_ids.append(np.full(len(hits), query_id))
            found.append(ids[hits])
            scores.append(products(index.rows[hits], query))
        if not query_ids:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return pd.DataFrame({"query_id": np.concatenate(query_ids), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    found = candidates.unionByName(queries).groupBy("a", "b").applyInPandas(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
