import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specframe.llm import quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def slow_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def counts(df):
    return [tuple(r["b"]) for r in df.select(quality.base_counts(F.col("text")).alias("b")).collect()]


def test_base_counts(spark):
    texts = [None, "", " \n", "a b c d e a b c d e", "a " * 30, "x y z w v q x y z w v x y z w v", "l\nl\n l\n\n\nl", "#*$%&|<> é\x0b\x1c\x85\xa0日",
             "a b c d e f a b c d e f g h i j a b c d e", "\n\n", "a\r\nb\r\na\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert counts(df) == [slow_counts(t) for t in texts]


def test_base_counts_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").cache()
    assert counts(docs) == [slow_counts(r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def clean_and_junk(make_docs):
    rng, rows = np.random.default_rng(4), []
    for i in range(900):
        words = [("ab" * 9)[:int(n)] + str(k) for k, n in enumerate(rng.integers(1, 9, rng.integers(40, 300)))]
        if i % 10 == 0:
            words = [f"{w}$$$" if i % 20 else f"| {w}" for w in words]
        rows.append((i, " ".join(words), "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 7}"))
    return make_docs(rows)


def test_outliers_go_and_clean_rows_stay(spark, clean_and_junk):
    rows = quality.judge(clean_and_junk).collect()
    assert {r["doc_id"] for r in rows if not r["kept"]} == set(range(0, 900, 10))
    other = quality.judge(clean_and_junk.repartition(7)).collect()
    assert sorted(rows) == sorted(other)  # the same in any order of the rows


def slow_estimates(x, keys, start, units):
    """One round of means, scatters and their mixtures by numpy."""
    out = {}
    for lang, source in set(keys):
        def moments(select):
            mine = x[[i for i, k in enumerate(keys) if select(k)]]
            return len(mine), mine.mean(axis=0), mine.T @ mine / len(mine) - np.outer(mine.mean(axis=0), mine.mean(axis=0))

        (n, m, c), (nl, ml, cl), (_, ma, ca) = (moments(f) for f in (
            lambda k: k == (lang, source), lambda k: k[0] == lang, lambda k: True))
        mix = lambda own, above, n: (own * n + above * quality.PRIOR) / (n + quality.PRIOR)
        cov = mix(c, mix(cl, ca, nl), n)
        out[lang, source] = mix(m, mix(ml, ma, nl), n), cov + np.diag(np.diag(cov) * 1e-9 + units)
    return out


def test_estimates_like_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    cells = np.round(x * quality.UNIT).astype(int)
    keys = [(f"1l{i % 2}", f"1s{i % 5}") for i in range(300)]
    df = spark.createDataFrame([(*k, 0, *map(int, c)) for k, c in zip(keys, cells, strict=True)],
                               "lang_key string, source_key string, start int, " + ", ".join(f"{s} long" for s in quality.STATISTICS))
    floors = np.array([quality.FLOOR[s] ** 2 for s in quality.STATISTICS])
    want = slow_estimates(cells / quality.UNIT, keys, 0, floors)
    state = quality._estimates(quality._sums(df))
    got = df.join(state, quality._GROUP).select("lang_key", "source_key", "log_det", *quality.STATISTICS, quality.distance().alias("d")).collect()
    for r in got:
        mean, cov = want[r["lang_key"], r["source_key"]]
        gap = np.array([r[s] for s in quality.STATISTICS]) / quality.UNIT - mean
        assert r["d"] == pytest.approx(gap @ np.linalg.solve(cov, gap), rel=1e-6)
        assert r["log_det"] == pytest.approx(np.linalg.slogdet(cov)[1], rel=1e-6)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = quality.judge(odd_docs).collect()
    assert len(rows) == 9 and all(r["base_failed"] and not r["kept"] for r in rows)
    assert quality.judge(no_docs).collect() == []
    good = odd_docs.withColumn("text", F.concat(F.lit("one two three four five six seven eight nine ten "), F.coalesce("text", F.lit(""))))
    kept = quality.keep_good(good)
    assert kept.columns == odd_docs.columns and {r["doc_id"] for r in kept.collect()} >= {1, 2, 3, 5}
