import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specframe.llm import runs


def slow_runs(words, least=12):
    """All maximal repetitions with their least period, by trying every period."""
    out = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)  # periods rise
            i = j
    return sorted((s, e, q) for (s, e), q in out.items())


def slow_row(text, doc_id):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = slow_runs(words)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    best = min(((s - e, s, q) for s, e, q in found), default=None)
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *((best[1], -best[0], best[2], -1000 * best[0] // best[2]) if best else (None,) * 4),
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest())


def found(texts):
    got = runs.runs_of_words([[str(x).encode() for x in t] for t in texts])
    return [[tuple(r) for r in g.tolist()] for g in got]


letters = st.lists(st.integers(0, 2), max_size=120)
repeats = st.builds(lambda a, u, k, extra, b: a + (u * k)[:len(u) * k - extra % max(1, len(u))] + b,
                    letters, st.lists(st.integers(0, 6), max_size=30), st.integers(2, 9), st.integers(0, 30), letters)


@settings(max_examples=250, deadline=None)
@given(st.lists(st.one_of(letters, repeats), min_size=1, max_size=4))
def test_runs_of_random_words(texts):
    assert found(texts) == [slow_runs(t) for t in texts]


@pytest.mark.parametrize("word", [[0] * 1000, [0, 1] * 300, [0, 0, 1] * 100 + [0, 0], [0] * 11, [0] * 12, [], [0], list(range(6)) * 2, list(range(6)) * 2 + [0],
                                  list(range(5)) * 2, ([0] * 13 + [1]) * 9, list(range(100)) * 3])
def test_runs_of_regular_words(word):
    assert found([word]) == [slow_runs(word)]


def test_runs_of_self_similar_words():
    fibonacci, thue = [0], [0]
    last = [1]
    for _ in range(12):
        fibonacci, last = fibonacci + last, fibonacci
    for _ in range(9):
        thue = thue + [1 - x for x in thue]
    assert found([fibonacci, thue]) == [slow_runs(fibonacci), slow_runs(thue)]


def test_many_repeated_lines():
    rnd = random.Random(3)
    lines = [[rnd.randrange(50) for _ in range(8)] for _ in range(3)]
    text = [w for _ in range(150) for w in rnd.choice(lines)]
    assert found([text, text[:500], text]) == [slow_runs(t) for t in (text, text[:500], text)]


def test_grammar_derives_the_words():
    rnd = random.Random(1)
    for _ in range(50):
        words = [rnd.randrange(3) for _ in range(rnd.randrange(1, 200))]
        breaks = np.array([rnd.random() < 0.05 for _ in words])
        breaks[-1] = True
        grammar = runs.re_pair(np.array(words), breaks, 3)

        def derive(symbol, grammar=grammar):
            if symbol < grammar.terminals:
                return [symbol]
            k = symbol - grammar.terminals
            return derive(grammar.left[k]) + derive(grammar.right[k])

        assert [w for s in grammar.symbols for w in derive(s)] == words
        # no pair is left that occurs twice without overlap
        seen = {}
        for k in range(len(grammar.symbols) - 1):
            if not breaks[grammar.places[k + 1] - 1]:
                pair = (grammar.symbols[k], grammar.symbols[k + 1])
                assert pair not in seen or (seen[pair] == k - 1 and pair[0] == pair[1])
                seen.setdefault(pair, k)


def test_a_long_text():
    rnd = random.Random(9)
    unit = [rnd.randrange(5000) for _ in range(20_000)]
    text = [rnd.randrange(5000) for _ in range(30_000)] + (unit * 5)[:90_000] + [-1]
    assert [(s, e, q) for s, e, q in found([text])[0] if q > 100] == [(30_000, 120_000, 20_000)]


def test_rows(spark, make_docs, odd_docs, no_docs):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(0, 150))), "en", "a") for i in range(150)]
    got = runs.digests(runs.periodic_runs(make_docs(rows), runs.planted))
    assert sorted(tuple(r) for r in got.collect()) == sorted(slow_row(t, i) for i, t, _, _ in rows)
    odd = runs.digests(runs.periodic_runs(odd_docs, runs.planted)).collect()
    assert sorted(map(str, map(tuple, odd))) == sorted(str(slow_row(r["text"], r["doc_id"])) for r in odd_docs.collect())
    assert runs.periodic_runs(no_docs).collect() == []
