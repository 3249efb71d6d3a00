"""Toxicity: a learned lexicon that also catches misspelled terms, weighed by context."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .batches import by_bytes
from .langid import crc_mod
from .ranks import first_by_key, shuffle_key

FOLDS = 5
#: Bounds of the training sample: labelled rows of either class.
TRAIN_TOXIC, TRAIN_CLEAN = 3000, 6000
LEAST_STEM, LONGEST_STEM, FUZZY_STEM = 3, 12, 5
LEAST_DOCS, LEAST_SIGNIFICANCE, LEAST_ODDS = 3, 25.0, 2.0
CONTEXT = 5
#: What a hit counts when it is misspelled, when it stands in quotation marks, and what
#: each other hit in its context window adds.
FUZZY, QUOTED, COMPANY = 0.8, 0.5, 0.25
END = "$"
_PUNCTUATION = ".,;:!?()[]{}\"'“”„«»‘’…-_*#<>|/\\"
_QUOTES = "\"“”„«»‘’'"
CACHE_ENTRIES = 500_000


def errors_allowed(term: str) -> int:
    """Edits that a whole word, or what a word starts with, may differ by.  Short stems are
    taken exactly; ``loose_terms`` tells which others must be."""
    if not term.endswith(END):
        return 1 if len(term) >= FUZZY_STEM else 0
    return 1 if len(term) <= 10 else 2


class Matcher:
    """Levenshtein automata of all terms, run over the trie of the lexicon at once.

    A state is a set of (trie node, edits so far).  A character moves along an edge that
    bears it, or costs one edit as a wrong, an extra or, before it, a missing character;
    with ``swaps``, two neighbours in the wrong order cost one edit too, and between them
    the state holds the node behind both and the character still to come.
    Sets and their moves are made when a text first needs them and kept, so words are
    read at one table lookup per character."""

    def __init__(self, terms: dict[str, int], swaps: bool = False):
        """``terms`` with the edits that each may differ by."""
        self.swaps = swaps
        self.children: list[dict[str, int]] = [{}]
        self.most, self.words, self.stems = [0], {}, {}
        for term, allowed in terms.items():
            node = 0
            for c in term.removesuffix(END):
                self.most[node] = max(self.most[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed)
            if term.endswith(END):
                self.words[node] = term, allowed
            else:
                self.stems[node] = term, allowed
        self.alphabet = {c for edges in self.children for c in edges}
        self.moves: dict[tuple[frozenset, str], frozenset] = {}
        self.start = self._closed({0: 0})

    def _closed(self, state: dict) -> frozenset:
        """Adds what is reached by skipping characters of terms."""
        waiting = list(state.items())
        while waiting:
            node, used = waiting.pop()
            if isinstance(node, tuple):
                continue
            for child in self.children[node].values():
                if used < self.most[child] and state.get(child, 99) > used + 1:
                    state[child] = used + 1
                    waiting.append((child, used + 1))
        return frozenset(state.items())

    def _move(self, state: frozenset, c: str) -> frozenset:
        after: dict[int | tuple[int, str], int] = {}

        def reach(node: int, used: int) -> None:
            if used <= self.most[node] or not used:
                after[node] = min(used, after.get(node, 99))

        for node, used in state:
            if isinstance(node, tuple):
                if node[1] == c:
                    reach(node[0], used)
                continue
            if node in self.stems and used <= self.stems[node][1]:
                reach(node, used)
            for edge, child in self.children[node].items():
                reach(child, used + (edge != c))
                behind = self.children[child].get(c)
                if self.swaps and edge != c and behind is not None and used < self.most[behind]:
                    after[behind, edge] = min(used + 1, after.get((behind, edge), 99))
            reach(node, used + 1)
        return self._closed(after)

    def matches(self, word: str) -> list[tuple[float, str]]:
        """All terms that a word is, each with strength 1, or less if misspelled."""
        state = self.start
        for c in word:
            key = state, c if c in self.alphabet else ""
            if key not in self.moves:
                self.moves[key] = self._move(*key)
            state = self.moves[key]
            if not state:
                return []
        out = []
        for node, used in state:
            ends = (self.words.get(node), self.stems.get(node))
            out += [(FUZZY ** used, term) for term, allowed in filter(None, ends) if used <= allowed]
        return out

    def find(self, word: str) -> tuple[float, str]:
        """The strongest match of a word; strength 0 for no hit."""
        return max(self.matches(word), default=(0.0, ""))


class _Hits(dict):
    """Hit strength by word as written."""

    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        out = self[word] = self.matcher.find(word.strip(_PUNCTUATION))[0]
        return out


def _quoted(words: list[str], i: int) -> bool:
    """Whether a mark opens within the window up to a word and one closes from it on."""
    before, after = words[max(0, i - CONTEXT):i + 1], words[i:i + CONTEXT + 1]
    return any(w[0] in _QUOTES for w in before) and any(w.rstrip(".,;:!?")[-1:] in _QUOTES for w in after if w.rstrip(".,;:!?"))


def features(text: str, hits: _Hits) -> tuple[float, float, float]:
    """What the hits add up to, the strongest in its context, and their share of words."""
    words = text.lower().split()
    strengths = list(map(hits.__getitem__, words))
    places = [i for i, s in enumerate(strengths) if s]
    if not places:
        return 0.0, 0.0, 0.0
    total = strongest = 0.0
    for k, i in enumerate(places):
        near = sum(1 for j in places[max(0, k - CONTEXT):k + CONTEXT + 1] if j != i and abs(j - i) <= CONTEXT)
        score = strengths[i] * (QUOTED if _quoted(words, i) else 1.0) * (1 + COMPANY * near)
        total, strongest = total + score, max(strongest, score)
    return math.log1p(total), strongest, math.sqrt(total / len(words))


def _terms(text: str) -> set[str]:
    """Whole words, marked by ``END``, and stems of a text."""
    words = {w.strip(_PUNCTUATION) for w in text.lower().split()}
    found = set()
    for word in words:
        if LEAST_STEM <= len(word) <= 40 and END not in word:
            found.add(word + END)
            found.update(word[:k] for k in range(LEAST_STEM, min(len(word), LONGEST_STEM) + 1))
    return found


def count_terms(sample: DataFrame) -> DataFrame:
    """``(term, toxic, clean)``: documents of either class that hold each term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                counts = (Counter(), Counter())
                for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    counts[toxic].update(_terms(text))
                terms = list(counts[0].keys() | counts[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), *[pa.array([counts[k][t] for t in terms], pa.int64()) for k in (1, 0)]],
                    names=["term", "toxic", "clean"])

    return sample.select("text", "toxic").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def significance(toxic: int, clean: int, all_toxic: int, all_clean: int) -> float:
    """Likelihood ratio of a term that favours toxic documents; 0 if it does not."""
    n, total = toxic + clean, all_toxic + all_clean
    if toxic * all_clean <= clean * all_toxic:
        return 0.0
    cells = ((toxic, n * all_toxic), (clean, n * all_clean), (all_toxic - toxic, (total - n) * all_toxic), (all_clean - clean, (total - n) * all_clean))
    out = sum(seen * math.log(seen * total / share) for seen, share in cells if seen)
    return 2 * out


def telling(term: str, counts: dict[str, tuple[int, int]], all_toxic: int, all_clean: int) -> float:
    """Likelihood ratio of a term that tells the classes apart, else 0."""
    toxic, clean = counts[term]
    odds = math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1))
    evidence = significance(toxic, clean, all_toxic, all_clean)
    return evidence if toxic >= LEAST_DOCS and odds >= LEAST_ODDS and evidence >= LEAST_SIGNIFICANCE else 0.0


def choose_terms(counts: dict[str, tuple[int, int]], all_toxic: int, all_clean: int) -> list[str]:
    """Terms that tell the classes apart.  A stem goes on as long as one longer term keeps
    nearly all its documents, and gives way to longer terms if one of them has the higher
    likelihood ratio; terms below a chosen stem are covered by it."""
    longer: dict[str, int] = {}
    for term, (toxic, _) in counts.items():
        longer[term[:-1]] = max(longer.get(term[:-1], 0), toxic)
    closed = {t: e for t in counts if (t.endswith(END) or longer.get(t, 0) < 0.95 * counts[t][0]) and (e := telling(t, counts, all_toxic, all_clean))}
    purer: dict[str, float] = {}
    for term, evidence in closed.items():
        for k in range(LEAST_STEM, len(term)):
            purer[term[:k]] = max(purer.get(term[:k], 0.0), evidence)
    stems = {t for t in closed if not t.endswith(END) and purer.get(t, 0.0) <= closed[t]}
    return sorted(t for t in closed if (t.endswith(END) or t in stems) and not any(
        t.removesuffix(END)[:k] in stems and t[:k] != t for k in range(LEAST_STEM, len(t))))


def with_words(terms: list[str], counts: dict[str, tuple[int, int]], all_toxic: int, all_clean: int) -> list[str]:
    """``terms`` and the telling whole words under their stems, which misspelled words may be near."""
    stems = {t for t in terms if not t.endswith(END)}
    words = {t for t in counts if t.endswith(END) and any(t[:k] in stems for k in range(LEAST_STEM, len(t))) and telling(t, counts, all_toxic, all_clean)}
    return sorted({*terms, *words})


def loose_terms(sample: DataFrame, terms: dict[str, int]) -> set[str]:
    """Terms that clean documents of the sample hold misspelled, in ``LEAST_DOCS`` or more
    of them: other words are too like them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, swaps=True)
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                hits = (matcher.matches(w.strip(_PUNCTUATION)) for w in set(text.lower().split()))
                found.update({term for near in hits if near and max(near)[0] < 1 for _, term in near})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    seen = sample.filter("toxic = 0").select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"] for r in seen.filter(F.col("n") >= LEAST_DOCS).collect()}


def logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 0.1, steps: int = 50) -> np.ndarray:
    """Weights and, last, intercept, which is not penalised; ``share`` is how much each row counts."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x.shape[1]), np.diag([penalty] * (x.shape[1] - 1) + [1e-9])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient, hessian = x.T @ (share * (p - y)) + ridge @ w, (x.T * (share * p * (1 - p) + 1e-9)) @ x + ridge
        move = np.linalg.solve(hessian, gradient)
        w = w - move * min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
        if np.abs(move).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    key: str
    terms: Broadcast
    weights: tuple[float, ...]


_HITS: dict[str, _Hits] = {}


def _hits(key: str, terms: Broadcast) -> _Hits:
    if key not in _HITS:
        _HITS.clear()
        _HITS[key] = _Hits(Matcher(terms.value, swaps=True))
    return _HITS[key]


def _measure(docs: DataFrame, key: str, terms: Broadcast, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs`` and the features of ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _hits(key, terms)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                found = [features(t, hits) if t else (0.0, 0.0, 0.0) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in columns], *[pa.array(v, pa.float64()) for v in zip(*found, strict=True)]],
                    names=[*columns, "x0", "x1", "x2"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([f"`{c}` {types[c]}" for c in columns] + ["x0 double", "x1 double", "x2 double"])
    return docs.select(*columns, "text").mapInArrow(run, schema)


def _marked(labels: DataFrame) -> DataFrame:
    return labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def _sample(docs: DataFrame, marked: DataFrame, toxic: int, clean: int) -> DataFrame:
    """Labelled texts, each once, within the bounds of both classes."""
    most = F.when(F.col("toxic") == 1, F.lit(toxic)).otherwise(F.lit(clean))
    ids = first_by_key(marked.withColumn("key", shuffle_key(0, F.col("doc_id"))), "toxic", most)
    texts = docs.filter("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return first_by_key(texts, "toxic", most, ("text",)).groupBy("text").agg(F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> ToxicityModel:
    """Lexicon and weights from ``docs (doc_id, text)`` and ``labels (doc_id, toxic)``.

    At most ``toxic`` and ``clean`` labelled documents of the classes are used, the first
    in a fixed random order of their IDs; equal texts count once.  Each class weighs as much
    as its share of all labels, so scores mean the same however much of it was used."""
    spark = docs.sparkSession
    marked = materialize(_marked(labels), "marked")
    every = Counter({r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    sample = materialize(_sample(docs, marked, toxic, clean), "toxicity")
    size = Counter({r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()})
    telling = count_terms(sample).filter((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") * size[0] > F.col("clean") * size[1]))
    counts = {r["term"]: (r["toxic"], r["clean"]) for r in telling.collect()}
    chosen = with_words(choose_terms(counts, size[1], size[0]), counts, size[1], size[0])
    terms, key = {t: errors_allowed(t) for t in chosen}, uuid.uuid4().hex
    terms |= dict.fromkeys(loose_terms(sample, terms), 0)
    sent = spark.sparkContext.broadcast(terms)
    rows = _measure(sample, key, sent, ["toxic"]).collect()
    if not size[0] or not size[1]:
        return ToxicityModel(key, sent, (0.0, 0.0, 0.0, -5.0 if not size[1] else 5.0))
    x = np.array([[r["x0"], r["x1"], r["x2"]] for r in rows])
    y = np.array([r["toxic"] for r in rows], dtype=float)
    one = every[1] / (every[0] + every[1]) * len(rows)
    share = np.where(y == 1, one / size[1], (len(rows) - one) / size[0])
    order = np.lexsort([*x.T, y])
    return ToxicityModel(key, sent, tuple(logistic(x[order], y[order], share[order]).tolist()))


def score(docs: DataFrame, model: ToxicityModel, folds: int = FOLDS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row.

    Null and empty texts have no hits and get the score of that.  Repeated rows score
    alike; an empty table gives no rows; other columns are ignored."""
    *w, bias = model.weights
    z = F.lit(bias) + sum(F.col(f"x{i}") * v for i, v in enumerate(w))
    return _measure(docs, model.key, model.terms, ["doc_id"]).select(
        "doc_id", (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))
