import random
import re
from collections import Counter

import numpy as np
import pytest

from specframe.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def slow(rows, least, longest, top):
    """All counts in dictionaries, from the definition."""
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i:i + k])] += 1
    candidates = {key: a for key, a in count.items() if a >= least and len(key[1]) > 1}
    dropped = {(lang, p[i:i + k]) for (lang, p), f in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1)
               if 100 * f >= 100 * count[lang, p[i:i + k]]}
    out = []
    for lang in sorted(total):
        rows = []
        for (where, p), a in candidates.items():
            if where == lang and (where, p) not in dropped:
                cuts = [(1000 * a * total[lang] // (count[lang, p[:k]] * count[lang, p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((-score, -a, " ".join(p).encode(), count[lang, p[:k]], count[lang, p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -score)
                for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return out


def corpus(seed, n=120):
    rnd = random.Random(seed)
    words = ["the", "of", "New", "York", "a", "b", "c", "Über", "日本", "x\x0by", "re-do", "é", "-"]
    weights = [20, 12, 6, 6, 5, 4, 3, 2, 2, 1, 1, 1, 1]
    lines = [" ".join(rnd.choices(words, weights, k=12)) for _ in range(5)]
    rows = []
    for _ in range(n):
        text = " ".join(rnd.choices(words, weights, k=rnd.randrange(0, 60)))
        for _ in range(rnd.randrange(3)):
            text += rnd.choice([". ", ", ", "\n", " ", "\t", ";;", "?!"]) + rnd.choice(lines)
        rows.append((text, rnd.choice(["en", "en", "de", None])))
    rows += [rows[0]] * 20 + [("the the " * 400, "en"), ("", "de"), (None, "de"), (" ..", "fr"), ("of " * 6 + ".", "und")]
    return rows


@pytest.mark.parametrize(("least", "longest", "top", "bits"), [(5, 5, 2000, 27), (5, 5, 10, 10), (2, 3, 50, 16), (40, 2, 7, 27)])
def test_all_phrases(spark, make_docs, monkeypatch, least, longest, top, bits):
    rows = corpus(1)
    docs = make_docs([(i, t, lang, "a") for i, (t, lang) in enumerate(rows)]).repartition(3)
    got = phrases.collocations(docs, least, longest, top, bits).collect()
    assert sorted(map(tuple, got)) == sorted(slow(rows, least, longest, top))
    assert len(got) > 5


def test_chunks_hold_every_phrase_once(monkeypatch):
    monkeypatch.setattr(phrases, "TRIGGER", 3)
    monkeypatch.setattr(phrases, "CUT", 7)
    for text, _ in corpus(2, 40):
        words = phrases.tokens((text or "").encode())
        want = Counter(tuple(words[i:i + k]) for k in range(1, 6) for i in range(len(words) - k + 1) if phrases.BREAK not in words[i:i + k])
        got = Counter()
        for chunk, own in phrases.parse(words):
            inside = chunk.split()
            got.update(tuple(inside[i:i + k]) for k in range(1, 6) for i in range(min(own, len(inside) - k + 1)) if phrases.BREAK not in inside[i:i + k])
        assert got == want


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big // 3)], "lang string, phrase string, words int, f long")
    totals = spark.createDataFrame([("en", 9 * big)], "lang string, n long")
    (row,) = phrases.scored(counts, totals).collect()
    assert row["score"] == 1000 * (big // 3) * (9 * big) // (big * (big - 1))


def test_odd_rows(spark, odd_docs, no_docs):
    got = sorted(map(tuple, phrases.collocations(odd_docs, least=2).collect()))
    want = slow([(r["text"], r["lang"]) for r in odd_docs.collect()], 2, 5, 2000)
    assert got == sorted(want) and ("en", 1, "plain words here", 2, 2, 2, 10, 5000) in got
    assert phrases.collocations(no_docs).collect() == []


def test_packed_counts(monkeypatch):
    rnd = np.random.default_rng(3)
    hashes = rnd.integers(0, 1 << 64, 5000, np.uint64) & ~phrases._LOW
    count = rnd.integers(1, 1000, 5000).astype(np.uint64)
    count[:3] = phrases._LOW - np.uint64(5)
    twice = phrases._summed(np.concatenate([hashes | count, hashes | count]))
    got = phrases._unpacked(phrases._packed(twice), len(twice))
    assert np.array_equal(got, twice) and len(got) == len(set(hashes.tolist()))
    want = dict(zip(hashes.tolist(), np.minimum(2 * count, phrases._LOW).tolist(), strict=True))
    assert {h: c for h, c in zip((got & ~phrases._LOW).tolist(), (got & phrases._LOW).tolist(), strict=True)} == want
    assert len(phrases._packed(twice)) < 8 * len(twice)
    assert phrases._unpacked(phrases._packed(twice[:0]), 0).tolist() == []


def test_hashes_of_words():
    words = [b"a" * n for n in range(1, 40)] + [b"ab", b"ba", b"\0", b"\0\0", b"abcdefgh\0", b"abcdefgh", "日本".encode(), b"x" * 16 + b"y" * 9, b"x" * 17 + b"y" * 8]
    data = np.frombuffer(b"".join(w + b" " for w in words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    h = phrases._hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(words)
    alone = [phrases._hashes(np.frombuffer(w + b" ", np.uint8), np.array([0]), np.array([len(w)]))[0] for w in words]
    assert h.tolist() == alone


def test_counts_are_dealt_to_several_parts(spark, make_docs, monkeypatch):
    monkeypatch.setattr(phrases, "GROUP", 100)
    monkeypatch.setattr(phrases, "HELD", 50)
    rows = corpus(4)
    docs = make_docs([(i, t, lang, "a") for i, (t, lang) in enumerate(rows)]).repartition(3)
    got = phrases.collocations(docs, 5, 5, 2000).collect()
    assert sorted(map(tuple, got)) == sorted(slow(rows, 5, 5, 2000))


def test_pairs_travel_in_few_rows(spark, make_docs):
    """A row holds the counts of many phrases, so rows do not grow with phrases."""
    rnd = random.Random(5)
    docs = make_docs([(i, " ".join(f"w{rnd.randrange(60)}" for _ in range(200)), "en", "a") for i in range(40)]).repartition(2)
    chunks = phrases.dictionary(docs)
    words = phrases.frequent_hashes(chunks, 1, {}, 5, 2)
    clean = phrases.without_rare(chunks, phrases.Filter(spark, words, 16)).coalesce(2)
    assert phrases.frequent_hashes(clean, 2, {}, 1, 4).count() > 3000
    assert phrases.hash_counts(clean, 2, {}, 4).count() <= 2 * 4
