import random
import re

import numpy as np
import pytest

from specframe.llm import jaccard


def slow_set(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    if len(words) < 3:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i:i + 3]) for i in range(len(words) - 2)}


def slow_components(rows):
    """Smallest reachable ID of every row, by comparing all pairs of sets."""
    sets = [slow_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i + 1, len(rows)):
            if a and 100 * len(a & sets[j]) >= 90 * len(a | sets[j]):
                root[find(j)] = find(i)
    best = {}
    for i, (doc_id, _) in enumerate(rows):
        best.setdefault(find(i), []).append(doc_id)
    return [(doc_id, len(sets[i]), min((d for d in best[find(i)] if d is not None), default=None)) for i, (doc_id, _) in enumerate(rows)]


def corpus(seed, groups=25):
    """Texts, and copies with a few words changed, cut or added, around the threshold."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Über", "日本", "THE"]
    rows = []
    passage = [rnd.choice(words) for _ in range(40)]
    for _ in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 9, 11, 12, 13, 14, 20, 60, 300]))]
        if rnd.random() < 0.4:
            base += passage
        for _ in range(rnd.choice([1, 1, 2, 5, 25])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3, 6])):
                at, kind = rnd.randrange(len(copy)), rnd.random()
                if kind < 0.4:
                    copy[at] = rnd.choice(words)
                elif kind < 0.7:
                    copy = copy[:len(copy) - rnd.randrange(1 + len(copy) // 10)]
                else:
                    copy += [rnd.choice(words)]
            rows.append((rnd.randrange(10 ** 6), rnd.choice([" ", "  ", "\n"]).join(copy)))
    rows.append((rows[0][0], rows[-1][1]))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [None, 7])
def test_all_links_are_found(spark, make_docs, tile):
    rows = corpus(3)
    docs = make_docs([(d, t, "en", "a") for d, t in rows]).repartition(4)
    limits = {} if tile is None else {"tile_docs": tile, "tile_entries": 400}
    got = sorted(tuple(r) for r in jaccard.similar(docs, **limits).collect())
    assert got == sorted(slow_components(rows))
    assert len({g[2] for g in got}) < 0.7 * len(got)


def test_linked_sets_share_a_key():
    bands, rnd, close = jaccard.size_bands(), random.Random(5), 0
    for _ in range(3000):
        n = rnd.choice([9, 10, 11, 12, 13, 17, 40, 100, 333])
        pool = np.unique(np.random.default_rng(rnd.getrandbits(32)).integers(0, 2 ** 63, n + 40).astype(np.uint64))
        a = pool[:n]
        gone, added = rnd.randrange(1 + n // 12), rnd.randrange(1 + n // 12)
        b = np.unique(np.concatenate([a[gone:], pool[n:n + added]]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            close += 1
            assert len(np.intersect1d(jaccard.agreement_keys(a, bands), jaccard.agreement_keys(b, bands)))
    assert close > 1000


def test_tiles_find_what_all_pairs_find(monkeypatch):
    monkeypatch.setattr(jaccard, "_LIGHT", 3)
    monkeypatch.setattr(jaccard, "_ROWS", 8)
    monkeypatch.setattr(jaccard, "_COLUMNS", 16)
    monkeypatch.setattr(jaccard, "_PAIRS", 50)
    rnd = np.random.default_rng(2)
    base = [rnd.integers(0, 2 ** 63, 30).astype(np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[rnd.random(30) > 0.03], rnd.integers(0, 2 ** 63, rnd.integers(0, 3)).astype(np.uint64)]))
            for b in base for _ in range(15)]
    salt = np.zeros(len(sets), np.uint64)

    def close(i, j):
        both = len(np.intersect1d(sets[i], sets[j]))
        return 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both)

    def components(n, pairs):
        root = np.arange(n)
        return jaccard.forest(root, np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)).tolist()

    n, cut = len(sets), 25
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if close(i, j)]
    got = jaccard.linked(sets, None, salt, None)
    assert components(n, list(zip(*got, strict=True))) == components(n, pairs)
    got = jaccard.linked(sets[:cut], sets[cut:], salt[:cut], salt[cut:])
    assert components(n, list(zip(*got, strict=True))) == components(n, [p for p in pairs if p[0] < cut <= p[1]])


def test_odd_rows(spark, odd_docs, no_docs):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar(odd_docs).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (None, 2, None), (7, 3, 7), (8, 1, 8)}
    assert jaccard.similar(odd_docs).count() == 9
    assert jaccard.similar(no_docs).collect() == []
