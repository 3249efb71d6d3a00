"""Phrase collocations: n-gram counts over the chunks of a prefix-free parse."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize
from .batches import by_bytes
from .ranks import per_group

LONGEST, LEAST_COUNT, TOP = 5, 100, 2000
#: One word in so many ends a chunk, on average; a chunk without any ends at ``CUT`` words.
TRIGGER, CUT = 64, 4096
#: Bits of the filter of frequent phrases that all tasks get; its size does not grow.
FILTER_BITS = 27
NO_LANGUAGE = "und"
CACHE_ENTRIES = 800_000
#: Hashes that a task holds before it passes their counts on, and about as many phrases' hashes go to one task.
HELD, GROUP = 1 << 22, 1 << 20
BREAK = b"."
_LOWER = bytes(ord(".") if chr(b) in ",;:!?\n\x0b\x0c\r" else ord(" ") if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Counts travel in the low bits of a hash: 40 bits tell phrases apart, 24 hold their count.
_LOW = np.uint64((1 << 24) - 1)
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M[0]
    x = (x ^ (x >> np.uint64(29))) * _M[1]
    return x ^ (x >> np.uint64(32))


def tokens(text: bytes | None) -> list[bytes]:
    """Words, A-Z lower-cased, and ``BREAK`` where a piece ends.  No word equals ``BREAK``, as
    full stops end pieces."""
    return (text or b"").translate(_LOWER).replace(b".", b" . ").split()


def _eights(data: np.ndarray) -> np.ndarray:
    """At ``i`` the eight bytes that end before ``data[i]``; zeros stand around the data."""
    padded = np.concatenate([np.zeros(8, np.uint8), data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 9,), np.dtype("<u8"), padded, strides=(1,))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word: of its length and bytes up to 16 bytes, else of its XXH64."""
    eights, size = _eights(data), ends - starts
    left = (8 * np.maximum(8 - size, 0)).astype(np.uint64)
    head = eights[starts + 8] << left
    tail = np.where(size > 8, eights[ends], np.uint64(0))
    h = _mix(_mix(head + size.astype(np.uint64) * _M[1]) + tail * _M[2])
    for i in np.flatnonzero(size > 16).tolist():
        h[i] = _WORDS[data[starts[i]:ends[i]].tobytes()]
    return h


def parse(words: list[bytes], longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """Chunks of a text: their words, a blank behind each, and at how many of them phrases start.

    A chunk ends behind a word where the hash of the last eight bytes says so, and goes on for
    ``longest - 1`` words into the next one.  So every phrase lies whole in the chunk that
    its first word belongs to, and is counted there alone; equal stretches of text are
    cut alike, wherever they stand.  A text's last chunk ends in a ``BREAK``."""
    line = b" ".join([*words, BREAK, b""])
    data = np.frombuffer(line, np.uint8)
    ends = np.flatnonzero(data == 32)
    n = len(ends)
    cuts = np.flatnonzero(_mix(_eights(data)[ends]) % np.uint64(TRIGGER) == 0) + 1
    stops, start = [0], 0
    for end in [*cuts.tolist(), n]:
        while start < end:
            start = min(end, start + CUT)
            stops.append(start)
    places, at = np.concatenate([[0], ends + 1]), np.array(stops)
    begins, finals = places[at[:-1]].tolist(), places[np.minimum(n, at[1:] + longest - 1)].tolist()
    return [(line[a:b], own) for a, b, own in zip(begins, finals, np.diff(at).tolist(), strict=True)]


def dictionary(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """``(lang, chunk, own, freq, n)``: the distinct chunks of each language and how often they
    occur, from ``(text, lang)``; all ``n`` of a language add up to its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text"):
                count: Counter[tuple[str, bytes, int]] = Counter()
                total: Counter[str] = Counter()
                for text, lang in zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("lang").to_pylist(), strict=True):
                    words = tokens(text)
                    total[lang] += len(words) - words.count(BREAK)
                    count.update((lang, *c) for c in parse(words, longest))
                langs, chunks, owns = zip(*count, strict=True) if count else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(langs, pa.string()), pa.array(chunks, pa.binary()), pa.array(owns, pa.int32()), pa.array(count.values(), pa.int64()),
                     pa.array([total.pop(lang, 0) for lang in langs], pa.int64())],
                    names=["lang", "chunk", "own", "freq", "n"])

    rows = docs.select("text", F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"))
    return rows.mapInArrow(run, "lang string, chunk binary, own int, freq long, n long").groupBy("lang", "chunk", "own").agg(
        F.sum("freq").alias("freq"), F.sum("n").alias("n"))


class Filter:
    """A fixed number of bits, one for each hash of a phrase that is frequent.  It may let
    other phrases pass, whose exact counts then leave them out, and never stops a frequent one."""

    def __init__(self, spark: SparkSession, hashes: DataFrame, bits: int = FILTER_BITS):
        self.bits = bits
        slot = F.shiftrightunsigned("h", 64 - bits)
        words = hashes.select(F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(shiftrightunsigned(h, %d) & 63 as int))" % (64 - bits)).alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        table = np.zeros(1 << (bits - 6), np.int64)
        table[found["word"].to_numpy()] = found["bits"].to_numpy()
        self.sent = spark.sparkContext.broadcast(table.tobytes())

    def has(self, hashes: np.ndarray) -> np.ndarray:
        table = np.frombuffer(self.sent.value, np.uint64)
        slot = hashes >> np.uint64(64 - self.bits)
        return (table[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column's values, and where each value starts and the last one ends."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.binary())
    places = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[places[0]:places[-1]], places - places[0]


def _values(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    places = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(places.tobytes()), pa.py_buffer(data.tobytes())])


class _Chunks:
    """A batch of chunks by the hashes of their words, side by side: ``short`` has 32 bits of
    each word's hash, 0 for ``BREAK`` alone."""

    def __init__(self, part: pa.RecordBatch, short: np.ndarray, sizes: np.ndarray):
        self.short = short
        self.chunk = np.repeat(np.arange(len(sizes)), sizes)
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.own = np.arange(len(short)) - first < np.repeat(part.column("own").to_numpy().astype(np.int64), sizes)
        self.freq = part.column("freq").to_numpy()
        langs = part.column("lang").to_pylist()
        names = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
        self.lang_names = pa.array(list(names), pa.string())
        self.lang = np.array([names[x] for x in langs], np.int64)
        self.seeds = np.fromiter((xxhash.xxh64_intdigest(x, 1) for x in names), np.uint64, len(names))

    def phrases(self, filters: dict[int, Filter], longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size up to ``longest`` the places of the phrases, and their hashes: of those
        that pass the filter of their size, if there is one, and whose parts all pass theirs."""
        at = np.flatnonzero(self.short)
        h = _mix(self.seeds[self.lang[self.chunk[at]]] + self.short[at])
        for k in range(1, longest + 1):
            if k > 1:
                both = np.flatnonzero(at[1:] == at[:-1] + 1)
                at, h = at[both], h[both]
                h = _mix(h * _M[2] + self.short[at + k - 1])
            if k in filters:
                passed = filters[k].has(h)
                at, h = at[passed], h[passed]
            yield k, at, h


def _hashed(part: pa.RecordBatch) -> _Chunks:
    """Chunks by the hashes that stand beside them."""
    data, places = _flat(part.column("hashes"))
    return _Chunks(part, np.frombuffer(data.tobytes(), np.uint32), np.diff(places) // 4)


class _Words(_Chunks):
    """Chunks with their words, each from its start to the blank behind it."""

    def __init__(self, part: pa.RecordBatch):
        self.data, places = _flat(part.column("chunk"))
        self.ends = np.flatnonzero(self.data == 32)
        self.starts = np.concatenate([[0], self.ends + 1])[:-1]
        self.hashes = _hashes(self.data, self.starts, self.ends)
        breaks = (self.ends - self.starts == 1) & (self.data[self.starts] == BREAK[0])
        short = np.where(breaks, np.uint32(0), np.maximum(self.hashes.astype(np.uint32), np.uint32(1)))
        super().__init__(part, short, np.diff(np.searchsorted(self.ends, places)))


def _summed(packed: np.ndarray) -> np.ndarray:
    """Each hash once, with the sum of its counts, as far as the low bits hold it."""
    if not len(packed):
        return packed
    packed = np.sort(packed)
    h = packed & ~_LOW
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[first] | np.minimum(np.add.reduceat(packed & _LOW, first), _LOW)


def _packed(counts: np.ndarray) -> bytes:
    """Ascending hashes as differences, and counts, byte by byte, so that equal bytes meet."""
    steps = np.diff(counts >> np.uint64(24), prepend=np.uint64(0)) << np.uint64(24) | counts & _LOW
    return pa.Codec("zstd").compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def _unpacked(data: bytes, rows: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, 8 * rows, asbytes=True), np.uint8)
    steps = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum(steps >> np.uint64(24), dtype=np.uint64) << np.uint64(24) | steps & _LOW


def hash_counts(chunks: DataFrame, size: int, filters: dict[int, Filter], groups: int) -> DataFrame:
    """``(part, rows, counts)``: packed counts of the hashes of phrases of ``size`` words all parts
    of which pass ``filters``, dealt by their first bits to ``groups``, a power of two."""
    column, made = ("hashes", _hashed) if "hashes" in chunks.columns else ("chunk", _Words)
    bounds = np.array([k * ((1 << 64) // groups) for k in range(1, groups)], np.uint64)

    def deal(held: list[np.ndarray]) -> pa.RecordBatch:
        parts = np.split(counts := _summed(np.concatenate(held)), np.searchsorted(counts, bounds))
        filled = [(k, len(x), _packed(x)) for k, x in enumerate(parts) if len(x)]
        columns = zip(*filled, strict=True) if filled else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "rows", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        waiting = 0
        for batch in batches:
            for part in by_bytes(batch, column):
                work = made(part)
                *_, (_, at, h) = work.phrases(filters, size)
                mine = work.own[at]
                freq = np.minimum(work.freq[work.chunk[at[mine]]], int(_LOW)).astype(np.uint64)
                held.append(_summed(h[mine] & ~_LOW | freq))
                waiting += len(held[-1])
                if waiting > HELD:
                    yield deal(held)
                    held, waiting = [], 0
        if held:
            yield deal(held)

    return chunks.select("lang", "own", "freq", column).mapInArrow(run, "part int, rows int, counts binary")


def frequent_hashes(chunks: DataFrame, size: int, filters: dict[int, Filter], least: int, groups: int) -> DataFrame:
    """Hashes ``h`` of the phrases of ``size`` words whose counts reach ``least``, and of
    those that share 40 bits of a hash with others and reach it together; of phrases alone
    all parts of which pass ``filters``, as those of a frequent one do."""
    least = min(least, int(_LOW))

    def add(group: pa.Table) -> pa.Table:
        held = zip(group.column("counts").to_pylist(), group.column("rows").to_pylist(), strict=True)
        counts = _summed(np.concatenate([_unpacked(data, n) for data, n in held]))
        return pa.table({"h": pa.array((counts[counts & _LOW >= np.uint64(least)] & ~_LOW).view(np.int64))})

    return hash_counts(chunks, size, filters, groups).groupBy("part").applyInArrow(add, "h long")


def without_rare(chunks: DataFrame, frequent: Filter) -> DataFrame:
    """The chunks with a break in place of each stretch of words that are not frequent, as no
    frequent phrase holds one, and with ``hashes`` of what stays, 32 bits a word;
    chunks drop out if no phrase can start in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "chunk"):
                work, rows = _Words(part), part.num_rows
                (_, at, _), = work.phrases({1: frequent}, 1)
                keep = np.zeros(len(work.short), bool)
                keep[at] = True
                useful = np.bincount(work.chunk[keep & work.own], minlength=rows) > 0
                keep &= useful[work.chunk]
                cut = np.concatenate([[False], keep[:-1] & (work.chunk[1:] == work.chunk[:-1])])[:len(keep)] & ~keep
                stay = keep | cut
                data, bytes_kept = work.data.copy(), np.repeat(keep, work.ends - work.starts + 1)
                data[work.starts[cut]] = BREAK[0]
                bytes_kept[work.starts[cut]] = bytes_kept[work.ends[cut]] = True
                size = np.where(keep, work.ends - work.starts + 1, 2 * cut)
                taken = np.flatnonzero(useful)

                def per_chunk(values: np.ndarray) -> np.ndarray:
                    return np.bincount(work.chunk, values, rows).astype(np.int64)[taken]

                yield pa.RecordBatch.from_arrays(
                    [part.column("lang").take(pa.array(taken)), _values(data[bytes_kept], per_chunk(size)), pa.array(per_chunk(stay & work.own).astype(np.int32)),
                     part.column("freq").take(pa.array(taken)), _values(np.where(keep, work.short, np.uint32(0))[stay].view(np.uint8), per_chunk(4 * stay))],
                    names=["lang", "chunk", "own", "freq", "hashes"])

    return chunks.select("lang", "chunk", "own", "freq").mapInArrow(run, "lang string, chunk binary, own int, freq long, hashes binary")


def exact_counts(chunks: DataFrame, filters: dict[int, Filter], longest: int) -> DataFrame:
    """``(lang, phrase, words, f)``: how often phrases occur, by their full text, if they and
    all their parts pass the filters of their sizes; the longest ones have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "chunk"):
                work = _Words(part)
                for k, at, h in work.phrases(filters, longest):
                    mine = np.flatnonzero(work.own[at])
                    if not len(mine):
                        continue
                    mine = mine[np.argsort(h[mine])]
                    at, h = at[mine], h[mine]
                    lang = work.lang[work.chunk[at]]
                    new = (h[1:] != h[:-1]) | (lang[1:] != lang[:-1])
                    for i in range(k):  # words that differ under one hash make rows of their own
                        word = work.hashes[at + i]
                        new |= word[1:] != word[:-1]
                    first = np.flatnonzero(np.concatenate([[True], new]))
                    freq = np.add.reduceat(work.freq[work.chunk[at]], first)
                    starts, ends = work.starts[at[first]], work.ends[at[first] + k - 1]
                    size = ends - starts
                    texts = work.data[np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    yield pa.RecordBatch.from_arrays(
                        [work.lang_names.take(pa.array(lang[first])), _values(texts, size).cast(pa.string()), pa.array(np.full(len(first), k, np.int32)), pa.array(freq)],
                        names=["lang", "phrase", "words", "f"])

    found = chunks.select("lang", "chunk", "own", "freq").mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """``(lang, phrase, words, f)`` of all phrases up to ``longest`` words that occur ``least``
    times, and ``(lang, n)``, all words of a language; both written."""
    spark = docs.sparkSession
    chunks = materialize(dictionary(docs, longest), "chunks")
    totals = materialize(chunks.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = chunks.agg(F.sum("own")).first()[0] or 0
    groups = 1 << (words // GROUP).bit_length()
    filters: dict[int, Filter] = {}
    for k in range(1, longest):
        filters[k] = Filter(spark, frequent_hashes(chunks, k, filters, least, groups), bits)
        if k == 1:
            chunks = materialize(without_rare(chunks, filters[1]), "frequent-chunks")
    return materialize(exact_counts(chunks, filters, longest).filter(F.col("f") >= least), "phrases"), totals


def scored(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """Adds ``l``, ``r``, ``n`` and ``score`` of the lowest-scoring cut to the phrases of two words
    or more that no longer phrase holds as often.

    Both parts of a phrase occur at least as often as it does, so ``counts`` has them."""
    phrases = counts.filter("words > 1")
    parts = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("words") - size + 1), lambda at: F.array_join(F.slice(parts, at, size), " "))))
    held = phrases.filter("words > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    candidates = phrases.join(held, ["lang", "phrase"], "left").filter("inside IS NULL OR inside < f").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = candidates.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    parts = F.split("phrase", " ")
    cuts = cuts.withColumn("first", F.array_join(F.slice(parts, F.lit(1), F.col("k")), " ")).withColumn(
        "rest", F.array_join(F.slice(parts, F.col("k") + 1, F.col("words")), " "))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    rows = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(per_group(totals, "totals"), "lang")
    wide = {c: f"cast({c} as decimal(19,0))" for c in "anlr"}
    score = F.expr(f"(cast(1000 * {wide['a']} as decimal(22,0)) * cast(n as decimal(16,0))) div ({wide['l']} * {wide['r']})")
    rows = rows.withColumn("score", score.cast("long"))
    best = rows.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("cut"))
    return best.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP, bits: int = FILTER_BITS) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's best ``top`` phrases of
    two to ``longest`` words that occur ``least`` times.

    Ties in the score go to the more frequent phrase, then to the first in byte order.  A
    null language is ``und``; null and empty texts have no words; texts are whole at any length;
    repeated rows count as often as they stand; IDs are not read; an empty table gives no
    rows; other columns are ignored.  Scores must fit a long, word totals 16 digits."""
    counts, totals = phrase_counts(docs.select("text", "lang"), least, longest, bits)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored(counts, totals).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
