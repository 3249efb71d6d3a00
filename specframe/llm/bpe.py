"""Byte-level BPE: texts to token IDs by the ranks of a public vocabulary, and back."""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heappop, heappush
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import by_bytes, small_file

CACHE_ENTRIES, LONGEST_KEPT = 1_200_000, 64
_WORD = 256
_PAIR = 1 << 20
#: Words that share a queue: many enough for full buckets, few enough for the processor's caches.
_WORDS = 1000
MARKS = (".", ",", ";", ":", "!", "?")
#: A run of white space that a cut before each blank would divide.
RUNS = re.compile(r"(?<=\s) (?=\s|\Z)")
_TOGETHER = [*(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"), "  ", " \n", "\n ", "\n\n"]
#: A line break that is one of three blanks in a row, or of two at the end.
BREAKS = re.compile(r"\n(?:(?<=\s\n)(?=\s|\Z)|(?=\s\s|\s\Z)|(?<=\s\s\n))")


def blanks_apart(text: str) -> bool:
    """Whether blanks and line breaks are the only white space, none beside another or at the
    end; then there is nothing that ``RUNS`` or ``BREAKS`` could find."""
    return not (any(map(text.__contains__, _TOGETHER)) or text.endswith((" ", "\n")))


@contextmanager
def no_collection() -> Iterator[None]:
    """Without the search for cyclic garbage, of which coding makes none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class CachedCoder:
    """IDs, as little-endian 32-bit numbers, of texts that are cut into chunks whose IDs are known.

    ``first`` and ``rest`` keep the IDs of chunks as they stand and behind a blank; they
    lose their later half before they would hold over ``most`` chunks."""

    def __init__(self, pattern: str, most: int):
        self.pattern, self.most = regex.compile(pattern), most
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def learn(self, prefix: str, chunks: list[str], known: dict[str, bytes]) -> None:
        """Puts the IDs of each chunk behind ``prefix`` into ``known``."""
        raise NotImplementedError

    def mark(self, mark: str) -> bytes:
        """The IDs of a punctuation mark."""
        raise NotImplementedError

    def _coded(self, known: dict[str, bytes], prefix: str, lists: list[list[str]]) -> list[list[bytes]]:
        """The IDs of all chunks; new ones are learned, and kept unless they are long."""
        coded = [list(map(known.get, chunks)) for chunks in lists]
        open_ = [k for k, ids in enumerate(coded) if None in ids]
        new = {c for k in open_ for c, ids in zip(lists[k], coded[k], strict=True) if ids is None}
        if len(known) + len(new) > self.most:
            # frequent chunks came first
            for c in list(islice(known, self.most // 2, None)):
                del known[c]
        # the pattern ends a match between letters and a mark
        marked = [c for c in new if c[-1:] in MARKS and c[:-1].isalpha()]
        wanted = list({c[:-1] for c in marked}.difference(known).union(new).difference(marked))
        self.learn(prefix, wanted, known)
        marks = {mark: self.mark(mark) for mark in {c[-1] for c in marked}}
        for c in marked:
            known[c] = known[c[:-1]] + marks[c[-1]]
        for k in open_:
            coded[k] = [known[c] if ids is None else ids for c, ids in zip(lists[k], coded[k], strict=True)]
        for c in [c for some in (wanted, marked) for c in some if len(c) > LONGEST_KEPT]:
            del known[c]
        return coded

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """IDs of whole texts.

        No match of the pattern runs over a blank from the left, so a text may be cut
        before every blank, unless white space stands on both sides of one.  It may also be
        cut on both sides of each line break, unless that is one of three blanks in a row or of
        two at the end of the text."""
        with no_collection():
            return self._encode_all(texts)

    def _encode_all(self, texts: list[str]) -> list[bytes]:
        heads, tails, line_counts = [], [], []
        for text in texts:
            calm = blanks_apart(text)
            if not text or not calm and RUNS.search(text):
                heads.append(self.pattern.findall(text))
                tails.append([])
                line_counts.append(1)
                continue
            lines = [text] if not calm and BREAKS.search(text) else text.split("\n")
            for line in lines:
                head, *tail = line.split(" ")
                heads.append([head] if head else [])
                tails.append(tail)
            line_counts.append(len(lines))
        line_break = self.mark("\n")
        lines = [b"".join(head) + b"".join(tail) for head, tail in zip(
            self._coded(self.first, "", heads), self._coded(self.rest, " ", tails), strict=True)]
        ends = list(accumulate(line_counts))
        return [line_break.join(lines[e - n:e]) for e, n in zip(ends, line_counts, strict=True)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


class Encoder(CachedCoder):
    """Texts to IDs and back by the ranks of a vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str):
        super().__init__(pattern, CACHE_ENTRIES)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)])
        #: the token that two tokens make together
        self.pairs = {left * _PAIR + right: rank for token, rank in self.ranks.items() for cut in range(1, len(token))
                      if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None}
        self.byte_pairs = np.array([self.pairs.get(a * _PAIR + b, -1) for a in self.bytes.tolist() for b in self.bytes.tolist()])
        self.low = [0] * (len(tokens) // _WORD + 1)
        self.text = np.frombuffer(b"".join(tokens), np.uint8)
        self.widths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.widths) - self.widths

    def merge(self, words: list[bytes]) -> list[bytes]:
        """IDs of each word: merges by rising rank, leftmost first, until no neighbours make
        a token.

        The words' positions form linked lists and wait in buckets by the rank of the merge
        that starts there, smallest position first.  ``low`` has a bit for each rank in
        words of 256, ``top`` a bit for each word that is not zero, so the next rank is two
        find-first-set steps away, however many wait.  An entry is stale, and skipped,
        unless ``now`` has its rank at its position.  A merge that makes a pair of a smaller
        rank sends the search back to that rank at once."""
        data = np.frombuffer(b"".join(words), np.uint8)
        n, ends = len(data), np.cumsum([len(w) for w in words])
        ranks = np.full(n, -1, np.int64)
        ranks[:-1] = self.byte_pairs[data[:-1].astype(np.int64) * 256 + data[1:]]
        ranks[ends - 1] = -1
        following, preceding = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = preceding[ends[:-1]] = -1
        waiting = np.flatnonzero(ranks >= 0)
        waiting = waiting[np.argsort(ranks[waiting], kind="stable")]
        found, first = np.unique(ranks[waiting], return_index=True)
        low, pairs, top, buckets = self.low, self.pairs.get, 0, {}
        for rank, positions in zip(found.tolist(), np.split(waiting, first[1:]), strict=False):
            buckets[rank] = positions.tolist()
            low[rank >> 8] |= 1 << (rank & 255)
            top |= 1 << (rank >> 8)
        ids, now, after, before = self.bytes[data].tolist(), ranks.tolist(), following.tolist(), preceding.tolist()
        while top:
            place = (top & -top).bit_length() - 1
            rank = least = (place << 8) + (low[place] & -low[place]).bit_length() - 1
            bucket = buckets[rank]
            while bucket and least >= rank:
                i = heappop(bucket)
                if now[i] != rank:
                    continue
                j = after[i]
                ids[i], ids[j], now[i], now[j] = rank, -1, -1, -1
                k = after[i] = after[j]
                if k >= 0:
                    before[k] = i
                h = before[i]
                for x, y in ((i, k), (h, i)):
                    if x >= 0 and y >= 0:
                        made = now[x] = pairs(ids[x] * _PAIR + ids[y], -1)
                        if made >= 0:
                            if made in buckets:
                                heappush(buckets[made], x)
                            else:
                                buckets[made] = [x]
                                low[made >> 8] |= 1 << (made & 255)
                                top |= 1 << (made >> 8)
                            if made < least:
                                least = made
            if not bucket:
                del buckets[rank]
                low[place] ^= 1 << (rank & 255)
                if not low[place]:
                    top ^= 1 << place
        out = np.array(ids, np.int32)
        left = out >= 0
        upto = np.cumsum(left)[ends - 1].tolist()
        coded = out[left].tobytes()
        return [coded[4 * a:4 * b] for a, b in zip([0, *upto], upto, strict=False)]

    def learn(self, prefix: str, chunks: list[str], known: dict[str, bytes]) -> None:
        """Each match of the pattern by itself; letters, and letters behind a blank, are one match."""
        matches = [[(prefix + c).encode()] if c.isalpha() else [m.encode() for m in self.pattern.findall(prefix + c)] for c in chunks]
        whole, coded = self.ranks, {}
        new = list(dict.fromkeys(w for m in matches for w in m if w not in whole))
        for i in range(0, len(new), _WORDS):
            coded.update(zip(new[i:i + _WORDS], self.merge(new[i:i + _WORDS]), strict=True))
        known.update(zip(chunks, [b"".join([coded[w] if w in coded else whole[w].to_bytes(4, "little") for w in m]) for m in matches], strict=True))

    def mark(self, mark: str) -> bytes:
        return self.ranks[mark.encode()].to_bytes(4, "little")

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of IDs side by side, ``counts`` of them for each text, and where each
        text's bytes end."""
        widths = self.widths[ids]
        ends = np.cumsum(widths)
        at = np.repeat(self.starts[ids] - ends + widths, widths) + np.arange(int(widths.sum()))
        return self.text[at], np.concatenate([[0], ends])[np.cumsum(counts)]

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes()


class Vocabulary:
    """A vocabulary file for the executors; each worker builds its encoder once."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        data = small_file(path)
        self.key, self.pattern, self.sent = hashlib.sha256(data).hexdigest(), pattern, spark.sparkContext.broadcast(data)


_LOADED: dict[tuple[str, str], Encoder] = {}


def loaded(vocabulary: Vocabulary) -> Encoder:
    key = vocabulary.key, vocabulary.pattern
    if key not in _LOADED:
        _LOADED[key] = Encoder(vocabulary.sent.value, vocabulary.pattern)
    return _LOADED[key]


def _ids(coded: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))


def _texts(encoder: Encoder, ids: pa.ListArray) -> pa.Array:
    counts = np.diff(ids.offsets.to_numpy())
    text, ends = encoder.decode_all(ids.flatten().to_numpy(), counts)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(text))]).cast(pa.binary())


def encode(docs: DataFrame, vocabulary: Vocabulary, decoded: bool = False) -> DataFrame:
    """``(doc_id, ids)``, one row per row, in the order and with the repeats of ``docs``; with
    ``decoded``, what the IDs decode to, on demand.

    A null or empty text has no IDs.  Texts are whole and of any length; a long match of
    the pattern costs time as its length times the logarithm of it.  Of equal ranks in one
    match the leftmost is merged first.  An empty table gives no rows; other columns are
    ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(vocabulary)
        for batch in batches:
            for part in by_bytes(batch, "text"):
                ids = _ids(encoder.encode_all([t or "" for t in part.column("text").to_pylist()]))
                columns = [part.column("doc_id"), ids, *([_texts(encoder, ids)] if decoded else [])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", *(["decoded"] if decoded else [])])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(doc_id, ids, decoded)`` with the bytes that the IDs stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _texts(encoder, batch.column("ids"))], names=["doc_id", "ids", "decoded"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
