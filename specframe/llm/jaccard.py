"""N-gram Jaccard join: links between near-equal shingle sets, by blocked sparse products of
the document by n-gram incidence."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize
from .batches import by_bytes
from .components import forest, stars

SHINGLE = 3
#: Two sets link when their intersection is at least this share of their union.
SHARE = (9, 10)
#: Parts beyond those that differences can spoil; sets with more empty parts show these too.
SPARE = 3
TILE_ENTRIES, TILE_DOCS = 1 << 20, 1024
LARGEST = 1 << 40
CACHE_ENTRIES = 800_000
_ROWS, _LIGHT, _COLUMNS, _PAIRS = 512, 64, 1024, 1 << 21
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(33))) * _M[0]
    x = (x ^ (x >> np.uint64(29))) * _M[1]
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as rising 64-bit hashes.

    Words are what blanks of ASCII separate, A-Z lower-cased; a text of fewer words is one
    shingle; null and texts without words have none."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * _M[2] + hashes[k:k + len(out)])
    return np.unique(out)


def size_bands(share: tuple[int, int] = SHARE) -> list[int]:
    """Where bands of set sizes start, each about a third above the last.  Smaller sets than
    the first start link with equal sets alone."""
    num, den = share
    starts = [-(-num // (den - num))]
    while starts[-1] < LARGEST:
        starts.append(max(-(-starts[-1] * 4 // 3), starts[-1] * den // num + 1))
    return starts


def agreement_keys(shingles: np.ndarray, bands: list[int], share: tuple[int, int] = SHARE) -> np.ndarray:
    """Keys such that linked sets share one at least.

    A band holds the pairs whose smaller set starts in it.  Their sets differ in at most
    ``a (den - num) / num`` shingles, ``a`` the smaller size, so if shingles are dealt by hash
    to more parts than that, some part is the same in both sets; the key is the content
    of the part.  A set shows its empty parts only if it has more than ``SPARE`` of them:
    linked sets agree in more parts than that."""
    num, den = share
    n, keys = len(shingles), []
    own = bisect_right(bands, n) - 1
    for band in (own, own - 1):
        if band < 0 or n > (bands[band + 1] - 1) * den // num:
            continue
        parts = (bands[band + 1] - 1) * (den - num) // num + 1 + SPARE
        part = ((shingles >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        content = np.add.reduceat(_mix(shingles ^ _M[2]), first)
        names = part[first] + np.uint64(band << 40)
        keys.append(_mix(content + _mix(names + _M[1])))
        if parts - len(first) > SPARE:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first]) + np.uint64(band << 40)
            keys.append(_mix(_mix(empty + _M[1])))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for part in by_bytes(batch, "text"):
        yield part, part.column("text").cast(pa.binary()).to_pylist()


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def described(docs: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """``(doc_id, n, digest, label, keys)`` of every row: the set's size, its 16-byte digest
    (null without shingles), eight bytes of it as a number, and its agreement keys."""
    bands = size_bands(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch):
                sizes, digests, labels, keys = [], [], [], []
                for text in texts:
                    shingles = shingle_set(text, size)
                    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None
                    sizes.append(len(shingles))
                    digests.append(digest)
                    labels.append(int.from_bytes(digest[:8], "little", signed=True) if digest else None)
                    keys.append(agreement_keys(shingles, bands, share))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(labels, pa.int64()), _lists(keys)],
                    names=["doc_id", "n", "digest", "label", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, label long, keys array<long>")


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """``(digest, shingles)``: the sets as bytes, each at least once and at most once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, texts in _texts(batch):
                found = {}
                for text in texts:
                    data = shingle_set(text, size).tobytes()
                    digest = hashlib.blake2b(data, digest_size=16).digest()
                    if data and digest not in seen:
                        seen.add(digest)
                        found[digest] = data
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())],
                                                 names=["digest", "shingles"])

    return docs.mapInArrow(run, "digest binary, shingles binary")


def sharing(keyed: DataFrame, label: str = "sharing") -> DataFrame:
    """Edges ``(a, b)`` that connect all labels which share a key, from ``(label, keys)``.

    Rows are sorted by key and label over all tasks, and neighbours with one key make an
    edge, so a key gives one edge less than it has labels, and a key of very many rows
    lies in several tasks.  Each task also returns its first and last row, to join its end
    with the next task's start."""
    rows = keyed.select(F.explode("keys").alias("key"), "label").repartitionByRange("key", "label").sortWithinPartitions("key", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, key):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(key, pa.int64())], names=["a", "b", "key"])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, value = (batch.column(k).to_numpy() for k in (0, 1))
            if last is None:
                yield out([value[0]], [None], [key[0]])
            else:
                key, value = np.concatenate([[last[0]], key]), np.concatenate([[last[1]], value])
            at = np.flatnonzero((key[1:] == key[:-1]) & (value[1:] != value[:-1]))
            yield out(value[at], value[at + 1], [None] * len(at))
            last = key[-1], value[-1]
        if last is not None:
            yield out([last[1]], [None], [last[0]])

    found = materialize(rows.mapInArrow(run, "a long, b long, key long"), label)
    ends = found.filter("b IS NULL").select("a", F.lead("a").over(Window.partitionBy("key").orderBy("a")).alias("b"))
    return found.filter("b IS NOT NULL").select("a", "b").union(ends.filter("b IS NOT NULL"))


def _columns(sets: list[np.ndarray], salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(s) for s in sets]
    return np.concatenate([s ^ x for s, x in zip(sets, salt, strict=True)]), np.repeat(np.arange(len(sets)), sizes)


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, salt_left: np.ndarray, salt_right: np.ndarray | None,
           share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the links between two tiles of sets, or within one: places ``(x, y)``
    in ``left + right``.  Sets with different salts have no shingle in common.

    The incidence of left rows is multiplied with that of right rows, a block of rows and
    a block of n-grams at a time, and overlaps add up over the blocks.  n-grams in few
    right rows come first, as lists; before those in many, as dense blocks, rows
    of which no pair can reach its bound, from both sizes, any more are left out."""
    one = right is None
    others, salts = (left, salt_left) if one else (right, salt_right)
    values, row = _columns(left, salt_left)
    other_values, other_row = (values, row) if one else _columns(others, salts)
    names, place = np.unique(np.concatenate([values, other_values]), return_inverse=True)
    column, other = place[:len(values)], place[len(values):]
    on_right = np.bincount(other, minlength=len(names))
    useful = (on_right > 1) if one else (np.bincount(column, minlength=len(names)) > 0) & (on_right > 0)
    keep, other_keep = useful[column], useful[other]
    column, row, other, other_row = column[keep], row[keep], other[other_keep], other_row[other_keep]
    order = np.argsort(other, kind="stable")
    other, other_row = other[order], other_row[order]
    first = np.searchsorted(other, np.arange(len(names) + 1))
    heavy = on_right > _LIGHT
    heavy_name = np.cumsum(heavy) - 1
    n_left, n_right = len(left), len(others)
    size_left, size_right = (np.array([len(s) for s in part], np.int64) for part in (left, others))
    heavy_right = np.bincount(other_row[heavy[other]], minlength=n_right)
    num, den = share
    root = np.arange(n_left if one else n_left + n_right)
    starts = np.searchsorted(row, np.arange(0, n_left + _ROWS, _ROWS))
    dense_entries = heavy[other]
    dense_column, dense_row = heavy_name[other[dense_entries]], other_row[dense_entries]
    for block, low in enumerate(range(0, n_left, _ROWS)):
        rows = min(_ROWS, n_left - low)
        own, at = column[starts[block]:starts[block + 1]], row[starts[block]:starts[block + 1]] - low
        overlap = np.zeros(rows * n_right, np.int64)
        light = ~heavy[own]
        names_, rows_ = own[light], at[light]
        begin, count = first[names_], first[names_ + 1] - first[names_]
        cuts = np.searchsorted(np.cumsum(count), np.arange(_PAIRS, count.sum() + _PAIRS, _PAIRS), side="left")
        done = 0
        for cut in [*(cuts + 1), len(count)]:
            if cut > done:
                c = count[done:cut]
                step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                pairs = np.repeat(rows_[done:cut] * n_right, c) + other_row[np.repeat(begin[done:cut], c) + step]
                overlap += np.bincount(pairs, minlength=len(overlap))
                done = cut
        overlap = overlap.reshape(rows, n_right)
        # 100 x overlap >= 90 x union, for num and den of the share
        need = num * (size_left[low:low + rows, None] + size_right[None, :])
        rest = np.bincount(at[~light], minlength=rows)
        alive = np.flatnonzero(((overlap + np.minimum(rest[:, None], heavy_right[None, :])) * (num + den) >= need).any(axis=1) & (rest > 0))
        if len(alive):
            slot = np.full(rows, -1)
            slot[alive] = np.arange(len(alive))
            mine = ~light & (slot[at] >= 0)
            mine_column, mine_row = heavy_name[own[mine]], slot[at[mine]]
            for start in range(0, int(heavy.sum()), _COLUMNS):
                a_in = (mine_column >= start) & (mine_column < start + _COLUMNS)
                b_low, b_high = np.searchsorted(dense_column, [start, start + _COLUMNS])
                if a_in.any() and b_high > b_low:
                    a = np.zeros((len(alive), _COLUMNS), np.float32)
                    b = np.zeros((n_right, _COLUMNS), np.float32)
                    a[mine_row[a_in], mine_column[a_in] - start] = 1
                    b[dense_row[b_low:b_high], dense_column[b_low:b_high] - start] = 1
                    overlap[alive] += (a @ b.T).astype(np.int64)
        x, y = np.nonzero(overlap * (num + den) >= need)
        x = x + low
        if one:
            x, y = x[x < y], y[x < y]
        else:
            y = y + n_left
        root = forest(root, x, y)
    far = np.flatnonzero(root != np.arange(len(root)))
    return far, root[far]


def class_links(docs: DataFrame, classes: DataFrame, groups: DataFrame, size: int, share: tuple[int, int],
                tile_entries: int = TILE_ENTRIES, tile_docs: int = TILE_DOCS) -> DataFrame:
    """Links ``(a, b)`` between class numbers, a forest per tile.

    ``classes (class_no, digest, n, label)`` is written; ``groups (label, root)`` says which
    labels may link.  Small groups share tiles.  A large one is cut by size band and hash
    into tiles of bounded entries, and pairs of tiles of one band or of neighbouring bands
    meet, as sizes of linked sets differ by no more."""
    num, den = share
    bands = size_bands(share)
    starts = F.array(*[F.lit(b).cast("long") for b in bands])
    band = F.size(F.filter(starts, lambda b: b <= F.col("n"))) - 1
    members = materialize(classes.filter(F.col("n") >= bands[0]).join(groups, "label").select("class_no", "digest", "n", "root", band.alias("band")), "members")
    parts = members.groupBy("root", "band").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("entries"))
    tiles = F.ceil(F.greatest(F.col("docs") / tile_docs, F.col("entries") / tile_entries)).cast("int")
    parts = materialize(parts.select("root", "band", "docs", "entries", tiles.alias("tiles")), "parts")
    sums = parts.groupBy("root").agg(F.sum("docs").alias("docs"), F.sum("entries").alias("entries"),
                                     F.map_from_entries(F.collect_list(F.struct("band", "tiles"))).alias("tiles"))
    is_small = (F.col("docs") <= tile_docs) & (F.col("entries") <= tile_entries)
    sums = materialize(sums.select("root", "tiles", "docs", "entries", is_small.alias("small")), "groups")
    total = sums.filter("small").agg(F.sum("docs").alias("docs"), F.sum("entries").alias("entries")).first()
    shared = max(1, -(-2 * (total["docs"] or 0) // tile_docs), -(-2 * (total["entries"] or 0) // tile_entries))
    limit = F.element_at(starts, F.col("band") + 1) - 1
    near = (F.col("n") * num <= limit * den) & (F.col("band") > 0)  # may be the larger of a pair with the band below
    tiles_of = {shift: F.coalesce(F.element_at("tiles", F.col("band") + shift), F.lit(0)) for shift in (-1, 0, 1)}
    own = F.pmod(F.xxhash64("class_no"), F.greatest(tiles_of[0], F.lit(1))).cast("int")

    def met(shift: int, make) -> Column:
        count = tiles_of[shift]
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, make)

    def place(low, high, i, j, is_left):
        return F.struct(F.col("root").alias("root"), low.cast("int").alias("low"), high.cast("int").alias("high"),
                        i.cast("int").alias("i"), j.cast("int").alias("j"), is_left.alias("is_left"))

    b = F.col("band")
    spread = F.concat(met(0, lambda t: place(b, b, F.least(own, t), F.greatest(own, t), own <= t)),
                      met(1, lambda t: place(b, b + 1, own, t, F.lit(True))),
                      F.when(near, met(-1, lambda t: place(b - 1, b, t, own, F.lit(False)))).otherwise(F.array().cast(
                          "array<struct<root:bigint,low:int,high:int,i:int,j:int,is_left:boolean>>")))
    together = F.array(F.struct(F.pmod(F.xxhash64("root"), F.lit(shared)).alias("root"), F.lit(-1).alias("low"), F.lit(-1).alias("high"),
                                F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(True).alias("is_left")))
    placed = members.join(sums.select("root", "tiles", "small"), "root").select(
        "class_no", "digest", F.col("root").alias("salt"), F.explode(F.when(F.col("small"), together).otherwise(spread)).alias("at"))
    placed = placed.select("class_no", "digest", "salt", "at.*")
    needed = members.select("digest")
    sets = sets_of(docs, size).join(broadcast_if_small(needed), "digest", "left_semi").groupBy("digest").agg(F.first("shingles").alias("shingles"))

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["salt", "class_no"])
        one = group["low"].iat[0] == group["high"].iat[0] and group["i"].iat[0] == group["j"].iat[0]
        salt = _mix(group["salt"].to_numpy().view(np.uint64))
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        numbers = group["class_no"].to_numpy()
        if one:
            x, y = linked(sets, None, salt, None, share)
        else:
            left = group["is_left"].to_numpy()
            if left.all() or not left.any():
                return pd.DataFrame({"a": [], "b": []}).astype("int64")
            numbers = np.concatenate([numbers[left], numbers[~left]])
            x, y = linked([s for s, k in zip(sets, left, strict=True) if k], [s for s, k in zip(sets, left, strict=True) if not k],
                          salt[left], salt[~left], share)
        return pd.DataFrame({"a": numbers[x], "b": numbers[y]})

    return placed.join(sets, "digest").drop("digest").groupBy("root", "low", "high", "i", "j").applyInPandas(multiply, "a long, b long")


def similar(docs: DataFrame, size: int = SHINGLE, share: tuple[int, int] = SHARE,
            tile_entries: int = TILE_ENTRIES, tile_docs: int = TILE_DOCS) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row per row of ``docs``.

    Rows with equal sets are one class; classes link when their Jaccard similarity is
    ``share`` at least, exactly, and the component is the smallest ID that links reach.
    Shingles are told apart by 64-bit hashes.  Null texts and texts without words have no
    shingles, link with nothing and are their own component; a text of any length is one
    set; repeated rows share a component; a null ID is never a component's unless no row of
    it has one.  An empty table gives no rows; other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(described(docs, size, share), "shingles")
    groups = stars(sharing(rows.filter("n > 0").select("label", "keys")), "sharing")
    groups = materialize(groups.select(F.col("node").alias("label"), "root").union(
        groups.select("root", "root").distinct().select(F.col("root").alias("label"), "root")), "sharing-groups")
    classes = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("label").alias("label"))
    classes = materialize(classes.withColumn("class_no", F.monotonically_increasing_id()), "classes")
    links = class_links(docs, classes, groups, size, share, tile_entries, tile_docs)
    roots = stars(links, "set-links")
    named = classes.join(roots.select(F.col("node").alias("class_no"), "root"), "class_no", "left").select(
        "digest", "first", F.coalesce("root", "class_no").alias("root"))
    named = materialize(named, "set-roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("digest", "component_id")
    full = rows.filter("n > 0").join(labels, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.filter("n = 0").select("doc_id", "n", F.col("doc_id")))
