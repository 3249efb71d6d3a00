"""Token sequences of one length with little padding: minimum bin slack."""

from __future__ import annotations

import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ..runtime import materialize
from .batches import by_bytes, small_file
from .bpe import RUNS, CachedCoder, blanks_apart
from .ranks import bucket_count, key_bucket, shuffle_key, with_ranks

WINDOW = 1024
END_ID = 0
CACHE_ENTRIES = 800_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Byte-level models write a byte as the Latin-1 character of its number if that can be seen, the
#: others, in their order, as the characters from 256 on.
_SEEN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


@dataclass(frozen=True)
class TokenizerFile:
    """A tokenizer file sent to the executors."""

    key: str
    sent: object

    @staticmethod
    def of(spark: SparkSession, path: str) -> TokenizerFile:
        data = small_file(path)
        return TokenizerFile(hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data))


class _Coder(CachedCoder):
    """IDs of texts by the tokenizer, which is asked once for each distinct chunk."""

    def __init__(self, file: TokenizerFile):
        super().__init__(public_tokenizers.PATTERN, CACHE_ENTRIES)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel work
        self.tokenizer = Tokenizer.from_buffer(file.sent.value)
        self.marks: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _word(self, word: str) -> bytes:
        """IDs of one match of the pattern, by the tokenizer's model, which takes a character for
        each byte."""
        if not word.isascii():
            word = word.encode().decode("latin-1")
        return array("I", [t.id for t in self.tokenize(word.translate(_BYTE_CHARACTERS))]).tobytes()

    def _apart(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, prefix: str, chunks: list[str], known: dict[str, bytes]) -> None:
        """Letters, and letters behind a blank, are one match of the pattern."""
        known.update([(c, self._word(prefix + c)) for c in chunks if c.isalpha()])
        others = [c for c in chunks if not c.isalpha()]
        known.update(zip(others, self._apart([prefix + c for c in others]), strict=True))

    def mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            self.marks[mark] = self._apart([mark])[0]
        return self.marks[mark]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Whole texts, as the tokenizer's plain call.  It looks for its added tokens before
        anything else, so a text that holds the letters of one is left to it, as one is that
        cannot be cut before every blank."""
        plain = [not blanks_apart(t) and bool(RUNS.search(t)) or any(a in t for a in self.added) for t in texts]
        out = super().encode_all(["" if p else t for t, p in zip(texts, plain, strict=True)])
        for i, p in enumerate(plain):
            if p:
                out[i] = self._apart([texts[i]])[0]
        return out


_CODERS: dict[str, _Coder] = {}


def coder(file: TokenizerFile) -> _Coder:
    if file.key not in _CODERS:
        _CODERS[file.key] = _Coder(file)
    return _CODERS[file.key]


def cut_pieces(docs: DataFrame, tokenizer: TokenizerFile, window: int = WINDOW, end_id: int = END_ID,
               with_ids: bool = False) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens)``: whole windows of each document,
    then what is left of it; with ``ids`` (array<int>) on demand.

    A document's IDs are the tokenizer's and ``end_id``; a null text is empty, so every
    row gives a piece.  Repeated rows are documents like any others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, end = coder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            for part in by_bytes(batch, "text"):
                coded = [c + end for c in work.encode_all([t or "" for t in part.column("text").to_pylist()])]
                rows: list[tuple] = []
                ids: list[bytes] = []
                for doc_id, data in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                    n = len(data) // 4
                    for start in range(0, n, window):
                        piece = data[4 * start:4 * (start + window)]
                        rows.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
                        if with_ids:
                            ids.append(piece)
                columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in ids])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The lengths, with their numbers, that fill ``capacity`` best, the longest one there
    is among them.

    Subset sums are bits of one number: bit ``s`` is set if lengths so far can add up to
    ``s``.  Each length is added in powers of two up to its number; the highest reachable
    sum is traced back through the states before each addition."""
    longest = max(counts)
    chosen, free = {longest: 1}, capacity - longest
    reach, mask, steps = 1, (1 << free + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == longest), free // length)
        times = 1
        while left > 0:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= reach << length * take & mask
            left, times = left - take, times * 2
        if reach >> free & 1:
            break
    best = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            best -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


@dataclass(frozen=True)
class Run:
    """``times`` sequences alike: pieces of ``length`` from rank ``first_rank`` on, ``each``
    per sequence, side by side from ``offset`` on."""

    length: int
    first_rank: int
    each: int
    first_sequence: int
    offset: int


def plan(histogram: dict[int, int], capacity: int = WINDOW) -> list[Run]:
    """How to fill all sequences, from the number of pieces of each length alone.

    One filling is repeated as often as its lengths last, so the plan grows with the
    number of lengths, which ``capacity`` bounds, and not with the number of pieces."""
    left = {length: n for length, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    runs, sequences = [], 0
    while left:
        chosen = fill_window(left, capacity)
        times = min(left[length] // n for length, n in chosen.items())
        offset = 0
        for length, n in sorted(chosen.items(), reverse=True):
            runs.append(Run(length, used[length], n, sequences, offset))
            offset += length * n
            used[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequences += times
    return runs


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces``, a written table.

    The driver sees one count per length, at most ``window`` of them.  Pieces are ranked
    within their length, however many have it, and look their place up in the plan, a few
    thousand rows at most.  Sequences are padded to ``window``, except those that end at a
    power of two."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    key = shuffle_key(0, F.col("doc_id"), F.col("start"))
    ranked = with_ranks(pieces.withColumn("_key", key), ["length"], key_bucket(F.col("_key"), bucket_count(sum(counts.values()))),
                        [F.col(c) for c in ("_key", "doc_id", "start", "ids_crc32", "doc_tokens")])
    runs = sorted(plan(counts, window), key=lambda r: (r.length, r.first_rank))
    shift = 2 ** 45
    starts = np.array([r.length * shift + r.first_rank for r in runs], dtype=np.int64)
    first, each, sequence, offset = (np.array([getattr(r, k) for r in runs], dtype=np.int64)
                                     for k in ("first_rank", "each", "first_sequence", "offset"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        at = np.searchsorted(starts, n * shift + r, side="right") - 1
        r = r - first[at]
        return pd.DataFrame({"sequence_id": sequence[at] + r // each[at], "offset": offset[at] + r % each[at] * n})

    return ranked.withColumn("_at", place("length", "rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Documents to pieces in sequences, ``(doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset)``.

    Null texts are empty; null IDs and repeated rows are kept as they are; an empty table
    gives no rows; other columns are ignored."""
    file = TokenizerFile.of(docs.sparkSession, path)
    return pack(materialize(cut_pieces(docs, file, window, end_id), "pieces"), window)
