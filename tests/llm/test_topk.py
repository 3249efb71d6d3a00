import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from specframe.llm import topk

SCHEMA = "vec_id long, embedding array<float>, q string"


def found(spark, rows, k=3, **sizes):
    df = spark.createDataFrame([(*r, "extra") for r in rows], SCHEMA).select("vec_id", topk.quantised(F.col("embedding")).alias("q"))
    out = topk.exact_top(df, k, F.col("vec_id") % 20 == 0, **sizes)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


def expected(rows, k=3):
    dims = max((len(v) for _, v in rows), default=0)
    vectors = {i: np.array([int(np.floor(np.float64(np.float32(x)) * 64)) for x in v] + [0] * (dims - len(v))) for i, v in rows}
    out = []
    for i in vectors:
        if i % 20 == 0:
            best = sorted((-int(vectors[i] @ v), j) for j, v in vectors.items() if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def test_like_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, [rnd.choice([rnd.gauss(0, 1), 0.0, -3.0]) for _ in range(rnd.choice([6, 6, 6, 5]))]) for i in range(-200, 400)]
    assert found(spark, rows, 5, block=70, query_block=9) == expected(rows, 5)
    assert found(spark, rows, 5) == expected(rows, 5)


def test_ties_and_copies(spark):
    rows = [(i, [1.0, -1.0]) for i in range(0, 300)]
    assert found(spark, rows, 4, block=64) == expected(rows, 4)
    assert found(spark, [(0, [0.0]), (1, [0.0])]) == [(0, 1, 1, 0)]


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf")]), (None, [9.0]),
            (7, [1e30]), (8, []), (0, [1.0, 2.0]), (20, None)]
    assert found(spark, rows, 9) == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 192), (0, 3, 8, 0), (0, 4, 8, 0)]
    assert found(spark, []) == [] and found(spark, [(0, [1.0])]) == []


def test_every_row_of_a_repeated_id(spark):
    rows = [(0, [5.0]), (1, [1.0]), (1, [5.0]), (2, [2.0])]
    assert found(spark, rows) == [(0, 1, 1, 320 * 320), (0, 2, 2, 320 * 128), (0, 3, 1, 320 * 64)]
    many = [(0, [1.0])] + [(7, [float(i % 5)]) for i in range(200)] + [(20, [3.0]), (20, [-1.0])]
    want = sorted(((q, -64 * 64 * int(x * y), j) for q, (x,) in many if q % 20 == 0 for j, (y,) in many if j != q))
    got = found(spark, many, 6, block=16, query_block=1)
    for q in (0, 20):
        mine = [(s, v) for i, _, v, s in got if i == q]
        assert mine == [(-s, v) for i, s, v in want if i == q][:6]


def test_large_components_take_part(spark):
    rows = [(i, [float(i % 7), 2.0 ** 18 * (i % 3), -1.0]) for i in range(60)] + [(100, [3e7, -3e7, 1.0]), (101, [2.0 ** 22, 1.0, 0.0]), (102, [3e7, 1.0, 0.0])]
    assert found(spark, rows) == expected(rows) and {i for i, *_ in expected(rows)} == {0, 20, 40, 100}
    assert found(spark, rows, 3, block=16, query_block=2) == expected(rows)
    ends = np.array([[-2 ** 63, 5], [2 ** 63 - 1024, -5], [0, 0]])
    assert list(topk.BitSlices(ends).top(np.array([2 ** 40, -3]), 2)) == [1, 2]
    with pytest.raises(OverflowError):
        topk.products(ends, np.array([2 ** 40, 0]))


def test_slices_add_up():
    rnd = np.random.default_rng(5)
    rows, query = rnd.integers(-50, 50, (130, 7)), np.array([3, -7, 0, 1, -1, 12, -30])
    index = topk.BitSlices(rows)
    total = sum(np.unpackbits(b.view(np.uint8), bitorder="little")[:130].astype(np.int64) << i for i, b in enumerate(index.sums(query)))
    assert len(set(total - rows @ query)) == 1
