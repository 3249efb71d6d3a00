import random

import numpy as np
import pytest
import xxhash

from specframe.llm import simhash
from specframe.llm.components import stars


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate(
        dict.fromkeys([9, 10, 11, 12, 13], " ")).split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "ÄB Ab", "a b c d", "a b c d e f g", "x\x0by z\x1cq \xa0 r s t"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) & (2 ** 64 - 1) == slow_fingerprint(text)


def components(values, radius=4):
    """Smallest reachable place of each value, by comparing all pairs."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ a) <= radius) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


@pytest.fixture(scope="module")
def prints():
    """Chains, dense clusters and strangers."""
    rnd = random.Random(7)
    out = []
    for _ in range(60):
        at = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 30])):
            out.append(at)
            for _ in range(rnd.randint(0, 5)):
                at ^= 1 << rnd.randrange(64)
    return np.array(list(dict.fromkeys(out)), dtype=np.uint64)


@pytest.mark.parametrize("tile", [4096, 64, 8, 1])
def test_no_link_is_lost(spark, prints, tile):
    df = spark.createDataFrame([(int(v),) for v in prints.view(np.int64)], "fp long")
    links = simhash.near_links(df, len(prints), tile=tile)
    root = {r["node"]: r["root"] for r in stars(links).collect()}
    got = [root.get(int(v), int(v)) for v in prints.view(np.int64)]
    want = components(prints)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_keys_cover_all_changes():
    rnd = random.Random(1)
    for n in (10, 10 ** 5, 10 ** 8, 10 ** 10, 10 ** 13):
        keys = simhash.agreement_keys(n)
        for _ in range(300):
            changed = set(rnd.sample(range(64), 4))
            assert any(not any(b in range(shift, shift + width) for shift, width in ranges for b in changed) for ranges in keys)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == 9 and by_id[1]["fingerprint"] == by_id[2]["fingerprint"] == "0" * 16
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[3]["component_id"] == 1
    assert by_id[5]["component_id"] == 5 and by_id[None]["component_id"] is None
    assert simhash.near_duplicates(no_docs).collect() == []


def test_one_of_each_group_stays(spark, odd_docs, no_docs):
    kept = simhash.keep_representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [1, 4, 5, 7, 8, None]
    assert simhash.keep_representatives(no_docs).collect() == []


def test_stars_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(500)] + [(1000, 1000), (None, 3), (2000, 2001), (2001, 2000)]
    got = {r["node"]: r["root"] for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 501)}, 2001: 2000}
