"""URL rules behind a sorted array of 64-bit digests that executors map into memory."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
PART_BYTES = 256 * 2 ** 20
ARRAYS = ("keys", "ends", "block", "texts")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


@dataclass(frozen=True)
class Index:
    """Files of one part of the rules, and the lengths of paths that occur in it."""

    name: str
    path_lengths: tuple[int, ...]


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def write_index(folder: str, rules: list[tuple[str, str]]) -> None:
    """Digests in ascending order; the full strings in the same order; their ends."""
    keyed = sorted((digest(rule), rule.encode(), verdict == "block") for rule, verdict in dict(rules).items())
    np.save(f"{folder}-keys.npy", np.array([k for k, _, _ in keyed], dtype=np.uint64))
    np.save(f"{folder}-ends.npy", np.cumsum([len(r) for _, r, _ in keyed], dtype=np.int64))
    np.save(f"{folder}-block.npy", np.array([b for _, _, b in keyed], dtype=bool))
    np.save(f"{folder}-texts.npy", np.frombuffer(b"".join(r for _, r, _ in keyed), dtype=np.uint8))


@lru_cache(maxsize=4)
def _opened(folder: str) -> tuple[np.ndarray, ...]:
    return tuple(np.load(f"{folder}-{k}.npy", mmap_mode="r") for k in ARRAYS)


def find(folder: str, candidates: list[str]) -> np.ndarray:
    """For each candidate the place of the equal rule, or -1.

    All digests are searched at once; a digest that is found counts only if the stored
    string is the candidate.  Rules with one digest lie side by side and are all read."""
    keys, ends, _, texts = _opened(folder)
    wanted = np.fromiter(map(digest, candidates), dtype=np.uint64, count=len(candidates))
    at = np.searchsorted(keys, wanted)
    found = np.full(len(candidates), -1, dtype=np.int64)
    inside = np.flatnonzero(at < len(keys))
    for i in inside[keys[at[inside]] == wanted[inside]]:
        k, text = int(at[i]), candidates[i].encode()
        while k < len(keys) and keys[k] == wanted[i]:
            if texts[(ends[k - 1] if k else 0):ends[k]].tobytes() == text:
                found[i] = k
                break
            k += 1
    return found


def _suffixes(host: str) -> list[str]:
    labels = host.split(".")
    return [".".join(labels[i:]) for i in range(len(labels))]


def build(spark: SparkSession, rules: DataFrame, part_bytes: int = PART_BYTES) -> list[Index]:
    """Index files for ``(host, path, verdict)`` rules, sent to the executors.

    Rules are cut by digest into parts of about ``part_bytes``; the driver holds one part
    at a time and every executor fetches each file once.  Of equal rules a block wins.
    Rules with a null host or path, with another verdict, or with a path that no url can
    have (not empty, and without a leading slash) are left out."""
    possible = F.col("verdict").isin("allow", "block") & (F.startswith("path", F.lit("/")) | (F.col("path") == ""))
    clean = rules.filter(possible).select(
        F.concat("host", "path").alias("rule"), F.length("path").alias("length"), "verdict").filter("rule IS NOT NULL AND rule != ''")
    one = clean.groupBy("rule", "length").agg(F.max("verdict").alias("verdict"))
    size = one.agg(F.sum(F.octet_length("rule") + 17)).first()[0] or 0
    parts = -(-size // part_bytes)
    root = tempfile.mkdtemp(prefix="spark-urls-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    made = []
    for part in range(parts):
        mine = one.filter(F.pmod(F.xxhash64("rule"), F.lit(parts)) == part).collect()
        name = f"rules-{uuid.uuid4().hex}"
        if not mine:
            continue
        write_index(f"{root}/{name}", [(r["rule"], r["verdict"]) for r in mine])
        for k in ARRAYS:
            spark.sparkContext.addFile(f"{root}/{name}-{k}.npy")
        made.append(Index(name, tuple(sorted({r["length"] for r in mine}))))
    return made


def _probe(index: Index):
    """The longest rule of this part and of the parts before it, for each host and path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = SparkFiles.get(index.name)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            owners, candidates = [], []
            for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
                for n in index.path_lengths:
                    if n <= len(path):
                        for suffix in _suffixes(host):
                            owners.append(i)
                            candidates.append(suffix + path[:n])
            distinct = list(dict.fromkeys(candidates))
            place = dict(zip(distinct, find(folder, distinct).tolist(), strict=True))
            best, block = batch.column("rule").to_pylist(), _opened(folder)[2]
            verdicts = batch.column("verdict").to_pylist()
            for i, text in zip(owners, candidates, strict=True):
                k = place[text]
                if k >= 0 and (best[i] is None or (len(text), text) > (len(best[i]), best[i])):
                    best[i], verdicts[i] = text, "block" if block[k] else "allow"
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(best, pa.string()), pa.array(verdicts, pa.string())], schema=batch.schema)
    return run


def judge(pages: DataFrame, index: list[Index], default: str = "allow") -> DataFrame:
    """``(page_id, host, path, rule, verdict)``, one row per row.

    A rule fits its host and all subdomains of it, where the path starts with the rule's.
    The rule with most characters wins; a url no rule fits keeps ``default``.  Null urls
    and urls without ``://`` have an empty host and path.  Repeated rows are judged alike;
    an empty table gives no rows, an empty index the default; other columns are ignored."""
    none = F.lit(None).cast("string")
    out = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                       none.alias("rule"), none.alias("verdict"))
    for part in index:
        out = out.mapInArrow(_probe(part), out.schema)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
