"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import first_by_key, shuffle_key

ORDER = 3
TRAIN_DOCS, TRAIN_CHARS = 400, 300_000
#: A sampled text teaches at most this part of its language's characters, so that very
#: long texts leave room for others.
STRETCHES = 20
UNKNOWN = "und"
_LETTER = r"\p{L}"


class ContextTree:
    """Byte counts of one language behind each context of up to ``order`` bytes.

    The counts are frozen after training.  A byte costs what it takes to name it behind
    the longest context that was seen: there its count over the total, or an escape to
    the next shorter context, and below all contexts one of 256 equal choices.  With
    ``d`` different bytes seen ``n`` times, the escape has ``d`` of ``n + d`` parts."""

    def __init__(self, order: int = ORDER):
        self.order, self.nodes = order, [{} for _ in range(order + 1)]

    def train(self, data: bytes) -> None:
        padded = bytes(self.order) + data
        for i in range(self.order, len(padded)):
            for k in range(self.order + 1):
                seen = self.nodes[k].setdefault(padded[i - k:i], {})
                seen[padded[i]] = seen.get(padded[i], 0) + 1

    def cost(self, context: bytes, byte: int) -> float:
        """Bits for ``byte`` behind ``context``, which has ``order`` bytes."""
        bits = 0.0
        for k in range(self.order, -1, -1):
            seen = self.nodes[k].get(context[self.order - k:])
            if seen is None:
                continue
            total = sum(seen.values()) + len(seen)
            if byte in seen:
                return bits - np.log2(seen[byte] / total)
            bits -= np.log2(len(seen) / total)
        return bits + 8.0


class Scorer:
    """Code lengths of whole texts in all languages.

    The cost of a byte depends on itself and three bytes before it, so each such run of
    four is looked up in a table that is filled when the run first occurs: first the place
    of the three, then that of the fourth.  The table is emptied when it is full; it holds
    what the trees say, so this changes no result."""

    ROWS = 1 << 16

    def __init__(self, trees: dict[str, ContextTree]):
        self.langs = sorted(trees)
        self.trees = [trees[lang] for lang in self.langs]
        self._empty()

    def _empty(self) -> None:
        self.heads = np.full(1 << 24, -1, dtype=np.int32)
        self.head_count = 0
        self.cells = np.full(1 << 20, -1, dtype=np.int32)
        self.costs = np.zeros((1 << 12, len(self.langs)))
        self.cost_count = 0

    def _places(self, runs: np.ndarray) -> np.ndarray:
        """Rows of ``costs`` for runs of four bytes; ``runs`` is at most ``ROWS`` long."""
        head = runs >> 8
        new = np.unique(head[self.heads[head] < 0])
        if self.head_count + len(new) > 1 << 17 or self.cost_count > 1 << 20:
            self._empty()
            new = np.unique(head)
        self.heads[new] = np.arange(self.head_count, self.head_count + len(new))
        self.head_count += len(new)
        if self.head_count * 256 > len(self.cells):
            self.cells = np.concatenate([self.cells, np.full(max(len(self.cells), self.head_count * 256 - len(self.cells)), -1, dtype=np.int32)])
        cell = self.heads[head].astype(np.int64) * 256 + (runs & 255)
        lacking = np.flatnonzero(self.cells[cell] < 0)
        if len(lacking):
            missing, at = np.unique(cell[lacking], return_index=True)
            self.cells[missing] = np.arange(self.cost_count, self.cost_count + len(missing))
            while self.cost_count + len(missing) > len(self.costs):
                self.costs = np.concatenate([self.costs, np.zeros_like(self.costs)])
            for place, run in zip(self.cells[missing].tolist(), runs[lacking[at]].tolist(), strict=True):
                context = (run >> 8).to_bytes(3, "big")
                self.costs[place] = [t.cost(context, run & 255) for t in self.trees]
            self.cost_count += len(missing)
        return self.cells[cell]

    def bits(self, text: str) -> np.ndarray:
        """Code length of a text in each language."""
        data = np.frombuffer(bytes(ORDER) + text.encode(), dtype=np.uint8).astype(np.int64)
        runs = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
        total = np.zeros(len(self.langs))
        for i in range(0, len(runs), self.ROWS):
            places = self._places(runs[i:i + self.ROWS])
            total += self.costs[places].sum(axis=0)
        return total

    def best(self, text: str) -> tuple[str, float]:
        """The language with the shortest code, and its share if all were equally likely
        before; ties go to the first name."""
        bits = self.bits(text)
        k = int(np.argmin(bits))
        return self.langs[k], float(1.0 / np.exp2(np.clip(bits[k] - bits, -1000, 0)).sum())


def crc_mod(doc_id: Column, n: int) -> Column:
    """Fold of a document; a null ID counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


@dataclass(frozen=True)
class LanguageModel:
    """Trees by language, sent to the executors."""

    key: str
    sent: Broadcast


_SCORERS: dict[str, Scorer] = {}


def _scorer(model: LanguageModel) -> Scorer:
    if model.key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.key] = Scorer(model.sent.value)
    return _SCORERS[model.key]


def _bounded(rows: DataFrame, docs_per_lang: int, chars_per_lang: int) -> DataFrame:
    """Of each language the first rows by ``key``, within both bounds but for the first row.
    No row may hold more than a small part of the characters, or it ends the sample early."""
    ties = ("chars", *[c for c in ("text",) if c in rows.columns])
    first = first_by_key(rows, "lang", F.lit(docs_per_lang), ties)
    order = Window.partitionBy("lang").orderBy("key", *ties)
    so_far = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("so_far", so_far).withColumn("n", F.row_number().over(order)).filter((F.col("n") == 1) | (F.col("so_far") <= chars_per_lang))


def train(labelled: DataFrame, docs_per_lang: int = TRAIN_DOCS, chars_per_lang: int = TRAIN_CHARS) -> LanguageModel:
    """A model from ``(doc_id, text, lang)``; rows with null text, language or ID teach nothing.

    The sample is bounded: of each language the first documents in a fixed random order of
    their IDs, at most ``docs_per_lang`` and ``chars_per_lang`` characters.  Of each text
    the first ``chars_per_lang / STRETCHES`` characters are used.  IDs are chosen before any
    text moves; repeated IDs stay within the bounds."""
    stretch = F.substring("text", 1, max(1, chars_per_lang // STRETCHES))
    rows = labelled.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select(
        "doc_id", "lang", F.length(stretch).alias("chars"), shuffle_key(0, F.col("doc_id")).alias("key"), stretch.alias("text"))
    chosen = _bounded(rows.drop("text"), docs_per_lang, chars_per_lang)
    ids = [r["doc_id"] for r in chosen.select("doc_id").distinct().collect()]
    trees: dict[str, ContextTree] = {}
    for r in _bounded(rows.filter(F.col("doc_id").isin(ids)), docs_per_lang, chars_per_lang).collect():
        trees.setdefault(r["lang"], ContextTree()).train(r["text"].encode())
    return LanguageModel(uuid.uuid4().hex, labelled.sparkSession.sparkContext.broadcast(trees))


def predict(text: Column, model: LanguageModel) -> Column:
    """``struct<lang_pred, score>``; ``und`` with score 0 for a text that is null, has no
    letter, or if the model knows no language."""
    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        scorer = _scorer(model)
        out = [scorer.best(t) if t and scorer.langs else (UNKNOWN, 0.0) for t in texts]
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return of(F.when(text.rlike(_LETTER), text))


def identify(docs: DataFrame, model: LanguageModel, folds: int = 3, held: int = 1) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, one row per row; repeated rows score alike,
    an empty table gives no rows, other columns are ignored."""
    out = docs.select("doc_id", (crc_mod(F.col("doc_id"), folds) == held).alias("held_out"), predict(F.col("text"), model).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text has a language with a score
    of ``least`` or more."""
    rows = docs.select(F.struct("*").alias("row"), predict(F.col("text"), model).alias("p"))
    return rows.filter((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") >= least)).select("row.*")
