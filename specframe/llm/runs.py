"""Periodic runs of words: maximal repetitions, found on a Re-Pair grammar of the words."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import by_bytes

LEAST_LENGTH = 12
#: Boundaries and periods that are looked at together.
_TOGETHER = 1 << 20


@dataclass(frozen=True)
class Grammar:
    """Rules ``symbol -> left right`` for the symbols from ``terminals`` on, in the order
    they were made, and what is left of the sequence: one symbol and its place a row."""

    terminals: int
    left: list[int]
    right: list[int]
    symbols: list[int]
    places: list[int]


def re_pair(ids: np.ndarray, breaks: np.ndarray, terminals: int) -> Grammar:
    """Replaces the most frequent pair of neighbours by a new symbol, until none occurs twice.

    ``breaks`` marks places that no pair may start at (ends of stretches).  Of pairs with
    one frequency the oldest comes first, which keeps the derivation shallow.  A pair's places
    are complete when its last symbol is made and only get fewer, so counts are
    checked again when a pair's turn comes."""
    n = len(ids)
    symbols = ids.tolist()
    after = np.where(breaks, -1, np.arange(1, n + 1)).tolist()
    before = np.concatenate([[-1], np.where(breaks[:-1], -1, np.arange(n - 1))]).tolist() if n else []
    starts = np.flatnonzero(~breaks)
    pairs = ids[starts].astype(np.int64) << 32 | ids[starts + 1] if len(starts) else np.zeros(0, np.int64)
    order = np.argsort(pairs, kind="stable")
    ordered, where = pairs[order], starts[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, int)
    count = np.diff(np.concatenate([first, [len(ordered)]]))
    twice = count > 1
    waiting: dict[tuple[int, int], list[int]] = {}
    queue: list[tuple[int, int, tuple[int, int]]] = []
    for f, c in sorted(zip(first[twice].tolist(), count[twice].tolist(), strict=True), key=lambda fc: where[fc[0]]):
        pair = (int(ordered[f]) >> 32, int(ordered[f]) & 0xFFFFFFFF)
        waiting[pair] = where[f:f + c].tolist()
        queue.append((-c, len(queue), pair))
    heapify(queue)
    turn = len(queue)
    left: list[int] = []
    right: list[int] = []
    while queue:
        known, _, pair = heappop(queue)
        a, b = pair
        matching = [i for i in waiting[pair] if symbols[i] == a and after[i] >= 0 and symbols[after[i]] == b]
        live = matching
        if a == b:
            live, last = [], -1
            for i in matching:
                if i != last:
                    live.append(i)
                    last = after[i]
        if len(live) < 2:
            del waiting[pair]
            continue
        if len(live) < -known and queue and -queue[0][0] >= len(live):
            waiting[pair] = matching
            turn += 1
            heappush(queue, (-len(live), turn, pair))
            continue
        del waiting[pair]
        made = terminals + len(left)
        left.append(a)
        right.append(b)
        for i in live:
            j = after[i]
            symbols[i], symbols[j] = made, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
        fresh: dict[tuple[int, int], list[int]] = {}
        for i in live:
            h, k = before[i], after[i]
            if h >= 0:
                fresh.setdefault((symbols[h], made), []).append(h)
            if k >= 0 and symbols[k] != made:
                fresh.setdefault((made, symbols[k]), []).append(i)
        for new, at in fresh.items():
            if len(at) > 1:
                waiting[new] = at
                turn += 1
                heappush(queue, (-len(at), turn, new))
    rest = [i for i in range(n) if symbols[i] >= 0]
    return Grammar(terminals, left, right, [symbols[i] for i in rest], rest)


class _Repeats:
    """Names of all substrings whose length is a power of two: equal substrings of a stretch,
    and only these, have equal names.  ``end`` is where the stretch of each place ends."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray):
        self.begin, self.end, self.n = begin, end, len(ids)
        self.names = [ids.astype(np.int64)]
        longest = int((end - begin).max(initial=0))
        while 2 << (len(self.names) - 1) <= longest:
            half = 1 << (len(self.names) - 1)
            whole = np.flatnonzero(np.arange(self.n) + 2 * half <= end)
            name = np.full(self.n, -1, np.int64)
            old = self.names[-1]
            name[whole] = np.unique(old[whole] << 32 | old[whole + half], return_inverse=True)[1]
            self.names.append(name)

    def forward(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How far the words from ``i`` and from ``j > i`` on are equal, up to ``end``."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step = 1 << k
            fits = np.flatnonzero(j + step <= end)
            same = fits[self.names[k][i[fits]] == self.names[k][j[fits]]]
            i[same] += step
            j[same] += step
            out[same] += step
        return out

    def backward(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """How many words up to ``i`` and up to ``j > i`` (not included) are equal, from ``begin`` on."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            step = 1 << k
            fits = np.flatnonzero(i - step >= begin)
            same = fits[self.names[k][i[fits] - step] == self.names[k][j[fits] - step]]
            i[same] -= step
            j[same] -= step
            out[same] += step
        return out


def _crossing(repeats: _Repeats, grams: np.ndarray, window: int, boundary: np.ndarray, low: np.ndarray, high: np.ndarray,
              least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs ``(boundary number, start, end, period)`` within ``low`` to ``high`` that hold both
    words beside a boundary, each with its period or a multiple of it.

    A run has ``least - period`` or ``period`` words equal to those a period on, whichever is
    more: ``window`` at least, side by side.  So its period is the distance between
    two equal windows, of which one starts at most ``window`` places beside the boundary.
    ``grams`` names the window at each place (-1: none)."""
    place = np.flatnonzero(grams >= 0)
    order = place[np.argsort(grams[place], kind="stable")]
    rank = np.full(len(grams), -1)
    rank[order] = np.arange(len(order))
    ordered = grams[order]
    group_first = np.searchsorted(ordered, ordered, "left")
    group_last = np.searchsorted(ordered, ordered, "right")
    found = []

    def look(number: np.ndarray, at: np.ndarray, earlier: bool) -> None:
        """Pairs of the window at ``at`` with equal ones before or behind it."""
        inside = (at >= low[number]) & (at + window <= high[number])
        number, at = number[inside], at[inside]
        inside = rank[at] >= 0
        number, at = number[inside], at[inside]
        r = rank[at]
        begin, count = (group_first[r], r - group_first[r]) if earlier else (r + 1, group_last[r] - r - 1)
        cuts = np.searchsorted(np.cumsum(count), np.arange(_TOGETHER, count.sum() + _TOGETHER, _TOGETHER)) + 1
        done = 0
        for cut in [*cuts.tolist(), len(count)]:
            if cut <= done:
                continue
            c = count[done:cut]
            other = order[np.repeat(begin[done:cut], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
            b, t = np.repeat(number[done:cut], c), np.repeat(at[done:cut], c)
            q = t - other if earlier else other - t
            done = cut
            ok = (other >= low[b]) if earlier else (other + window <= high[b])
            b, q = b[ok], q[ok]
            ok = 2 * q <= high[b] - low[b]
            both = np.unique(b[ok] * base + q[ok])
            if len(both):
                found.append((both // base, both % base, earlier))

    numbers, base = np.arange(len(boundary)), len(grams) + 1
    for shift in range(window):
        look(numbers, boundary - shift, True)
        look(numbers, boundary - 1 - shift, False)
    out = []
    for b, q, earlier in found:
        x = boundary[b] - q if earlier else boundary[b]  # words from x on against words a period on
        ok = (x >= low[b]) & (x + q <= high[b])
        b, q, x = b[ok], q[ok], x[ok]
        start = x - repeats.backward(x, x + q, low[b])
        end = x + q + repeats.forward(x, x + q, high[b])
        ok = (end - start >= np.maximum(least, 2 * q)) & (start < boundary[b]) & (end > boundary[b])
        out.append(np.stack([b[ok], start[ok], end[ok], q[ok]]))
    return tuple(np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64))


def _repeated(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window's name at each place (-1 where its stretch ends before), and which places
    lie in a window that occurs again in the same stretch."""
    n = len(ids)
    grams = np.full(n, -1, np.int64)
    whole = np.flatnonzero(np.arange(n) + window <= end)
    covered = np.zeros(n, bool)
    if not len(whole):
        return grams, covered
    name = np.unique(begin[whole] << 32 | ids[whole], return_inverse=True)[1]
    for k in range(1, window):
        name = np.unique(name << 32 | ids[whole + k], return_inverse=True)[1]
    grams[whole] = name
    often = whole[np.bincount(name)[name] > 1]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + window, -1)
    return grams, np.cumsum(change[:n]) > 0


def find_runs(ids: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int = LEAST_LENGTH) -> np.ndarray:
    """Runs ``(start, end, period)`` of a sequence of numbers, by start; ``begin`` and ``end``
    bound the text of each place, and no run leaves its text.

    Words outside every repeated window of ``least / 2`` words are in no run, as a run repeats
    at least so many; they end the stretches that go into one grammar.  Each
    nonterminal's boundary, and each boundary of what is left, is searched once, within
    what the nonterminal derives; a run crosses the boundary of the smallest symbol that
    holds it.  The runs go to all places that derive the nonterminal; of those with one
    period that overlap by it the union stays, and of those with one extent the least period."""
    window = least // 2
    empty = np.zeros((0, 3), np.int64)
    grams, covered = _repeated(ids, begin, end, window)
    if not covered.any():
        return empty
    # stretches of covered words of one text, long enough for a run
    places = np.flatnonzero(covered)
    new = np.concatenate([[True], (places[1:] != places[:-1] + 1) | (begin[places[1:]] != begin[places[:-1]])])
    number = np.cumsum(new) - 1
    keep = np.bincount(number)[number] >= least
    places, number = places[keep], np.unique(number[keep], return_inverse=True)[1]
    if not len(places):
        return empty
    m = len(places)
    first = np.searchsorted(number, np.arange(number[-1] + 2))
    words, s_begin, s_end = np.unique(ids[places], return_inverse=True)[1].astype(np.int64), first[number], first[number + 1]
    terminals = int(words.max()) + 1
    grammar = re_pair(words, np.arange(m) + 1 == s_end, terminals)

    # where the symbols lie: all places that derive a symbol, from the last one made down
    width = [1] * terminals
    for a, b in zip(grammar.left, grammar.right, strict=True):
        width.append(width[a] + width[b])
    derived: dict[int, list[np.ndarray]] = {}
    rest, rest_places = np.array(grammar.symbols), np.array(grammar.places)
    order = np.argsort(rest, kind="stable")
    for symbol, at in zip(*_grouped(rest[order], rest_places[order]), strict=True):
        if width[symbol] >= least:
            derived[symbol] = [at]
    positions: dict[int, np.ndarray] = {}
    for symbol in range(terminals + len(grammar.left) - 1, terminals - 1, -1):
        if symbol not in derived:
            continue
        at = positions[symbol] = np.concatenate(derived.pop(symbol))
        a, b = grammar.left[symbol - terminals], grammar.right[symbol - terminals]
        if width[a] >= least:
            derived.setdefault(a, []).append(at)
        if width[b] >= least:
            derived.setdefault(b, []).append(at + width[a])

    symbols = list(positions)
    base = np.array([positions[s][0] for s in symbols], np.int64)
    cut = base + np.array([width[grammar.left[s - terminals]] for s in symbols], np.int64)
    stop = base + np.array([width[s] for s in symbols], np.int64)
    inner = rest_places[rest_places > s_begin[rest_places]]
    repeats = _Repeats(words, s_begin, s_end)
    named = np.full(m, -1, np.int64)
    fits = np.flatnonzero(np.arange(m) + window <= s_end)
    named[fits] = np.unique(s_begin[fits] << 32 | grams[places[fits]], return_inverse=True)[1]
    owner, start, finish, period = _crossing(
        repeats, named, window, np.concatenate([cut, inner]), np.concatenate([base, s_begin[inner]]),
        np.concatenate([stop, s_end[inner]]), least)

    # to all places that derive the symbol
    times = np.array([len(positions[s]) for s in symbols] + [1] * len(inner), np.int64)
    offsets = np.concatenate([positions[s] - positions[s][0] for s in symbols] + [np.zeros(len(inner), np.int64)])
    offset_first = np.cumsum(times) - times
    c = times[owner]
    step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
    moved = offsets[np.repeat(offset_first[owner], c) + step]
    runs = np.stack([np.repeat(start, c) + moved, np.repeat(finish, c) + moved, np.repeat(period, c)], axis=1)
    runs = _least_periods(_merged(runs))
    return np.stack([places[runs[:, 0]], places[runs[:, 1] - 1] + 1, runs[:, 2]], axis=1)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first].tolist(), np.split(values, first[1:])


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Of runs with one extent the one with the least period, by start, then period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)]) if len(runs) else np.zeros(0, bool)
    runs = runs[new]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _merged(runs: np.ndarray) -> np.ndarray:
    """Unions of the intervals with one period that overlap by the period."""
    if not len(runs):
        return runs
    start, end, period = runs[np.lexsort((runs[:, 1], runs[:, 0], runs[:, 2]))].T
    # the furthest end of the same period so far, by one running maximum over all periods
    far = np.maximum.accumulate(end + period * (int(end.max()) + 1)) - period * (int(end.max()) + 1)
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] + period[1:] > far[:-1])])
    first = np.flatnonzero(new)
    return np.stack([start[first], np.maximum.reduceat(end, first), period[first]], axis=1)


def collapsed(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` words stay: those in no run, or in the first period of all that hold them."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


def runs_of_words(texts: list[list[bytes]], least: int = LEAST_LENGTH) -> list[np.ndarray]:
    """The runs ``(start, end, period)`` of every list of words, from one grammar over all."""
    index = _Ids()
    sizes = np.array([len(t) for t in texts], np.int64)
    ids = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    last = np.cumsum(sizes)
    first = last - sizes
    runs = find_runs(ids, np.repeat(first, sizes), np.repeat(last, sizes), least)
    cuts = np.searchsorted(runs[:, 0], last)
    return [r - [f, f, 0] for r, f in zip(np.split(runs, cuts[:-1]), first.tolist(), strict=True)]


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of a text; of one text in ten, by its ID, the end repeats a stretch of it."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a:a + p]
    return words[:a] + (unit * (-(-(n - a) // len(unit))))[:n - a]


RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed binary"


def periodic_runs(docs: DataFrame, change: Callable[[list[bytes], int | None], list[bytes]] | None = None,
                  least: int = LEAST_LENGTH) -> DataFrame:
    """``(doc_id, runs, collapsed)``, one row per row of ``docs``.

    A run is a stretch of ``least`` words or more, and of two periods or more, that no
    neighbouring word extends; ``runs`` has start, length and least period of each, by start
    and period.  ``collapsed`` is the text less all words that a run holds behind its first
    period, joined by blanks.  ``change`` may alter a text's words first.
    Null and empty texts have no runs and collapse to an empty text; a text is one sequence
    however long it is, its memory grows in proportion to its words (times the logarithm of the
    longest repeated stretch); repeated rows and null IDs give rows of their own; an empty
    table gives no rows; other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                texts = [(t or b"").split() for t in part.column("text").cast(pa.binary()).to_pylist()]
                if change is not None:
                    texts = [change(words, doc_id) for words, doc_id in zip(texts, ids, strict=True)]
                found = runs_of_words(texts, least)
                kept = []
                for words, runs in zip(texts, found, strict=True):
                    if len(runs):
                        stay = collapsed(runs, len(words))
                        words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                    kept.append(b" ".join(words))
                rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
                ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1] - rows[:, 0]), pa.array(rows[:, 2])],
                                                   names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), items), pa.array(kept, pa.binary())],
                    names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RUNS)


def digests(found: DataFrame) -> DataFrame:
    """The longest run of each row (of equal ones the first) and digests of all that was found."""
    best = F.when(F.size("runs") > 0, F.element_at(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"])
                  .when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), 1))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                   r["period"].cast("string"), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
