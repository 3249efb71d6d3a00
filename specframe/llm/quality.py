"""Quality rules: counts of a text, and robust multivariate outliers among them."""

from __future__ import annotations

from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from ..runtime import broadcast_if_small, materialize
from .ranks import per_group

WINDOW = 5
BLANKS = r"[\x20\x09-\x0D]+"
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED_PERCENT = 10, 20

STATISTICS = ("word_length", "symbols", "dup_lines", "repeats")
#: Spread that a statistic has at least, so that a group without any symbol is no trap.
FLOOR = {"word_length": 0.03, "symbols": 0.25, "dup_lines": 0.5, "repeats": 0.15}
#: Statistics are whole numbers of this part of one, so their sums are exact in any order.
UNIT = 10_000
SUBSET = 0.75
PRIOR = 50
STEPS = 5
#: Quantiles of the chi-square distribution with four degrees of freedom: the median, and
#: that which one in a million exceeds.
CHI2_MEDIAN, CHI2_CUTOFF = 3.35669, 33.37684
_BINS = 64


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that occur twice: each repeated window adds its words that the
    next one does not hold."""
    def counted(order: Column) -> Column:
        same = lambda a, b: a["h"].eqNullSafe(b["h"]) & F.slice(words, a["i"] + 1, WINDOW).eqNullSafe(F.slice(words, b["i"] + 1, WINDOW))
        found = F.filter(order, lambda e, k: same(e, F.get(order, k - 1)) | same(e, F.get(order, k + 1)))
        starts = F.sort_array(F.transform(found, lambda e: e["i"]))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda i, k: F.least(F.coalesce(F.get(s, k + 1) - i, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), add))

    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(order, counted)).otherwise(F.lit(0))


def base_counts(text: Column) -> Column:
    """``struct<n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words>`` of a text;
    a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, BLANKS), "")
    windows = lambda w: F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(
            F.array().cast("array<bigint>"))
    of_words = let(words, lambda w: F.struct(F.size(w).alias("n"), let(windows(w), lambda h: _repeat_words(w, h)).alias("repeat")))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return let(of_words, lambda w: F.struct(
        w["n"].cast("long").alias("n_words"), F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"), w["repeat"].cast("long").alias("n_repeat_words")))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def statistics(mean_length: Column) -> list[Column]:
    """Transformed counts, in whole units.  Rates are those of the text with ``PRIOR`` more
    words of ``mean_length`` and no symbols, as a short text says little about its rate."""
    words, chars = F.col("n_words") + PRIOR, F.col("word_chars") + PRIOR * mean_length
    values = {
        "word_length": F.log(chars / words),
        "symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "dup_lines": F.log1p("n_dup_lines"),
        "repeats": F.sqrt(F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)))}
    return [F.round(values[s] * UNIT).cast("long").alias(s) for s in STATISTICS]


_PAIRS = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]
_GROUP = ["lang_key", "source_key", "start"]


def _sums(rows: DataFrame) -> DataFrame:
    """Number, sums and sums of products of each group's rows; whole numbers, so exact."""
    x = [F.col(s) for s in STATISTICS]
    return rows.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(v.cast("decimal(20,0)")).cast("double").alias(f"s{i}") for i, v in enumerate(x)],
        *[F.sum((x[i] * x[j]).cast("decimal(28,0)")).cast("double").alias(f"p{i}{j}") for i, j in _PAIRS])


def _estimates(sums: DataFrame) -> DataFrame:
    """Mean and scatter of each group, with ``PRIOR`` rows' weight of its language over all
    sources, and that of all languages, mixed in; with the inverse Cholesky factor and the
    logarithm of the determinant."""
    names = [c for c in sums.columns if c not in _GROUP]
    size = len(STATISTICS)
    out = sums
    for level, by in (("l", ["lang_key", "start"]), ("a", ["start"])):
        pool = Window.partitionBy(*by)
        out = out.select("*", *[F.sum(c).over(pool).alias(f"{level}_{c}") for c in names])

    def moments(prefix: str) -> tuple[list[Column], dict[tuple[int, int], Column]]:
        n = F.col(f"{prefix}n")
        mean = [F.col(f"{prefix}s{i}") / n / UNIT for i in range(size)]
        return mean, {(i, j): F.col(f"{prefix}p{i}{j}") / n / UNIT ** 2 - mean[i] * mean[j] for i, j in _PAIRS}

    (m, c), (ml, cl), (ma, ca) = (moments(p) for p in ("", "l_", "a_"))
    mix = lambda own, above, n: (own * n + above * PRIOR) / (n + PRIOR)
    n, nl = F.col("n"), F.col("l_n")
    out = out.select(
        *_GROUP, "n", *[mix(m[i], mix(ml[i], ma[i], nl), n).alias(f"m{i}") for i in range(size)],
        *[(mix(c[i, j], mix(cl[i, j], ca[i, j], nl), n) * (1.0 if i != j else 1.0 + 1e-9)
           + (FLOOR[STATISTICS[i]] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    return _factor(out)


def _factor(out: DataFrame) -> DataFrame:
    """Adds ``w_ij``, the inverse of the Cholesky factor of ``c_ij``, and ``log_det``."""
    size = len(STATISTICS)
    for j in range(size):
        done = reduce(add, [F.col(f"f{j}{k}") ** 2 for k in range(j)], F.lit(0.0))
        out = out.withColumn(f"f{j}{j}", F.sqrt(F.col(f"c{j}{j}") - done))
        out = out.select("*", *[((F.col(f"c{i}{j}") - reduce(add, [F.col(f"f{i}{k}") * F.col(f"f{j}{k}") for k in range(j)], F.lit(0.0)))
                                 / F.col(f"f{j}{j}")).alias(f"f{i}{j}") for i in range(j + 1, size)])
    for i in range(size):
        below = [(-reduce(add, [F.col(f"f{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)], F.lit(0.0)) / F.col(f"f{i}{i}")).alias(f"w{i}{j}")
                 for j in range(i)]
        out = out.select("*", *below, (1 / F.col(f"f{i}{i}")).alias(f"w{i}{i}"))
    return out.withColumn("log_det", 2 * F.log(reduce(mul, [F.col(f"f{i}{i}") for i in range(size)]))).drop(
        *[f"f{i}{j}" for i, j in _PAIRS])


def distance() -> Column:
    """Squared Mahalanobis distance of a row beside its group's estimate."""
    gap = [F.col(s) / UNIT - F.col(f"m{i}") for i, s in enumerate(STATISTICS)]
    return reduce(add, [reduce(add, [F.col(f"w{i}{j}") * gap[j] for j in range(i + 1)]) ** 2 for i in range(len(STATISTICS))])


def _bin(value: Column) -> Column:
    """Classes of positive values, about one percent wide."""
    return F.floor(F.log2(value + 1e-6) * _BINS)


def _quantile_bin(rows: DataFrame, share: float, name: str) -> DataFrame:
    """Of each group the first class of ``bin`` up to which ``share`` of its rows lie."""
    counts = rows.groupBy(*_GROUP, "bin").agg(F.count(F.lit(1)).alias("k"))
    one = Window.partitionBy(*_GROUP)
    return counts.select(*_GROUP, "bin", F.sum("k").over(one.orderBy("bin")).alias("up_to"), F.sum("k").over(one).alias("of")).filter(
        F.col("up_to") >= F.ceil(F.col("of") * share)).groupBy(*_GROUP).agg(F.min("bin").alias(name))


def _medians(rows: DataFrame) -> DataFrame:
    """A start that outliers cannot move: medians, and squared median deviations, of each
    statistic by itself, in classes of a hundredth."""
    long = rows.select(*_GROUP[:2], F.posexplode(F.array(*STATISTICS)).alias("k", "x")).withColumn("start", F.col("k"))
    class_ = (F.col("x") / (UNIT / 100)).cast("long")
    middle = _quantile_bin(long.withColumn("bin", class_), 0.5, "mid")
    off = long.join(per_group(middle, "middle"), _GROUP).withColumn("bin", F.abs(class_ - F.col("mid")))
    spread = _quantile_bin(off, 0.5, "dev")
    both = middle.join(spread, _GROUP).select(
        "lang_key", "source_key", "start", (F.col("mid") / 100).alias("mid"), (F.col("dev") / 100 * 1.4826).alias("dev"))
    size = len(STATISTICS)
    pick = lambda i, c: F.max(F.when(F.col("start") == i, F.col(c)))
    wide = both.groupBy("lang_key", "source_key").agg(*[pick(i, "mid").alias(f"m{i}") for i in range(size)], *[pick(i, "dev").alias(f"d{i}") for i in range(size)])
    return _factor(wide.select(
        "lang_key", "source_key", F.lit(1).alias("start"), *[f"m{i}" for i in range(size)],
        *[(F.col(f"d{i}") ** 2 + FLOOR[STATISTICS[i]] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]))


_ESTIMATE = [*_GROUP, *[f"m{i}" for i in range(len(STATISTICS))], *[f"w{i}{j}" for i, j in _PAIRS], "log_det"]


def fit(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """The minimum-covariance-determinant estimate of each ``(lang_key, source_key)`` from
    its rows of statistics, a written table.

    Two starts, all rows and medians, are taken through concentration steps: the
    ``SUBSET`` nearest rows of each group give the next mean and scatter, which never
    raises the determinant.  The start with the smaller determinant stays, scaled so that
    the median distance is that of a normal sample.  The number of steps is the same at
    every size; ``log_det`` moves no more after few of them."""
    rows = rows.select("lang_key", "source_key", *STATISTICS)
    both = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    state = materialize(_estimates(_sums(rows.withColumn("start", F.lit(0)))).select(*_ESTIMATE).unionByName(
        _medians(rows).select(*_ESTIMATE)), "start")
    for step in range(steps):
        measured = both.join(broadcast_if_small(state), _GROUP).select(*_GROUP, *STATISTICS, _bin(distance()).alias("bin"))
        near = measured.join(per_group(_quantile_bin(measured, SUBSET, "limit"), "limits"), _GROUP).filter("bin <= limit")
        moved = materialize(_estimates(_sums(near)).select(*_ESTIMATE), f"step-{step}")
        change = moved.join(state.select(*_GROUP, F.col("log_det").alias("was")), _GROUP).agg(
            F.max(F.abs(F.col("log_det") - F.col("was")))).first()[0]
        state = moved
        if change is None or change < 1e-9:
            break
    best = F.row_number().over(Window.partitionBy("lang_key", "source_key").orderBy("log_det", "start"))
    chosen = per_group(state.withColumn("place", best).filter("place = 1").drop("place"), "chosen")
    measured = rows.join(chosen.drop("start"), ["lang_key", "source_key"]).withColumn("start", F.lit(0)).withColumn("bin", _bin(distance()))
    middle = _quantile_bin(measured, 0.5, "mid").drop("start")
    # a group whose middle lies nearer than a normal sample's is held by the floors alone
    scale = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("mid") + 1) / _BINS) / CHI2_MEDIAN)
    return chosen.drop("start", "log_det").join(middle, ["lang_key", "source_key"]).withColumn("scale", scale).drop("mid")


def group_keys(lang: Column, source: Column) -> list[Column]:
    """Keys that are never null."""
    key = lambda c: F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c))
    return [key(lang).alias("lang_key"), key(source).alias("source_key")]


def verdicts(counted: DataFrame, cutoff: float = CHI2_CUTOFF) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to ``counted``, a written table with the base
    counts, ``lang_key`` and ``source_key``.  Rows that fail the base rules teach nothing."""
    rows = counted.withColumn("base_failed", base_failed())
    means = rows.filter("NOT base_failed").groupBy("lang_key").agg((F.sum("word_chars") / F.sum("n_words")).alias("mean_length"))
    measured = rows.join(per_group(means, "means"), "lang_key", "left").select(*rows.columns, *statistics(F.coalesce("mean_length", F.lit(1.0))))
    model = per_group(fit(materialize(measured.filter("NOT base_failed").select("lang_key", "source_key", *STATISTICS), "statistics")), "model")
    far = distance() / F.col("scale") > cutoff
    joined = measured.join(model, ["lang_key", "source_key"], "left")
    return joined.select(*rows.columns, (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept)``, one row per row.

    Null languages and sources are groups of their own; null texts have no words and fail.
    Repeated rows are judged alike.  An empty table gives no rows; other columns are ignored."""
    rows = docs.select("doc_id", *group_keys(F.col("lang"), F.col("source")), base_counts(F.col("text")).alias("base"))
    counted = materialize(rows.select("doc_id", "lang_key", "source_key", "base.*"), "counts")
    return verdicts(counted).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), *group_keys(F.col("lang"), F.col("source")), base_counts(F.col("text")).alias("base"))
    counted = materialize(rows.select("row", "lang_key", "source_key", "base.*"), "counts")
    return verdicts(counted).filter("kept").select("row.*")
