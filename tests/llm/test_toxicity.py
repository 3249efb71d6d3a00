from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from specframe.llm import langid, toxicity

TERMS = {"idiot$": 1, "scum$": 0, "worthless$": 2, "trash$": 1, "lowei": 0, "idle$": 1}


def distance(a, b):
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))
    return d(len(a), len(b))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("idotscumwrhleax1", max_size=11), st.sampled_from([t.strip("$") for t in TERMS]).flatmap(
    lambda t: st.tuples(st.just(t), st.integers(0, 9), st.text("idot1x", max_size=2), st.integers(0, 2)).map(
        lambda x: x[0][:x[1]] + x[2] + x[0][x[1] + x[3]:]))))
def test_automaton_like_edit_distance(word):
    want = 0.0
    for term, allowed in TERMS.items():
        if term.endswith("$"):
            edits = distance(word, term[:-1])
            want = max(want, toxicity.FUZZY ** edits if edits <= allowed else 0)
        elif word.startswith(term):
            want = 1.0
    assert matcher().find(word)[0] == pytest.approx(want)


@lru_cache(None)
def matcher():
    return toxicity.Matcher(TERMS)


def test_context():
    hits = toxicity._Hits(matcher())
    plain, quoted = toxicity.features("he is an idiot here", hits), toxicity.features('he said "you idiot" here', hits)
    crowd = toxicity.features("you idiot scum trash", hits)
    assert quoted[0] < plain[0] < crowd[0] and quoted[1] < plain[1] < crowd[1]
    assert toxicity.features("nothing here", hits) == (0.0, 0.0, 0.0)


def test_term_choice():
    counts = {"idi": (90, 0), "idio": (90, 0), "idiot": (90, 0), "idiot$": (89, 0), "the": (99, 900), "the$": (99, 900), "rare$": (2, 0),
              "low": (80, 0), "lowe": (80, 0), "lowea$": (30, 0), "loweb$": (50, 0)}
    assert toxicity.choose_terms(counts, 100, 1000) == ["idiot$", "lowe"]
    assert toxicity.significance(1, 10, 100, 1000) == 0 and toxicity.significance(20, 0, 100, 1000) > 80


def test_purer_words_win_over_a_stem():
    counts = {"stu": (95, 78), "stud$": (0, 78), **dict.fromkeys(("stup", "stupi", "stupid", "stupid$"), (87, 0))}
    assert toxicity.choose_terms(counts, 342, 2709) == ["stupid$"]
    counts = {"low": (80, 0), "lowe": (80, 0), "lowea$": (30, 0), "loweb$": (50, 0), "lower$": (1, 0)}
    chosen = toxicity.choose_terms(counts, 100, 1000)
    assert chosen == ["lowe"] and toxicity.with_words(chosen, counts, 100, 1000) == ["lowe", "lowea$", "loweb$"]


def swapped(a, b):
    """Edit distance in which two neighbours in the wrong order cost one edit."""
    @lru_cache(None)
    def d(i, j):
        if not i or not j:
            return i + j
        swap = d(i - 2, j - 2) + 1 if min(i, j) > 1 and a[i - 2:i] == b[j - 2:j][::-1] else 99
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]), swap)
    return d(len(a), len(b))


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["stupid", "worthless", "scum", "loweing"]).flatmap(lambda t: st.tuples(
    st.just(t), st.integers(0, 8), st.text("stupidlowe", max_size=2), st.integers(0, 2), st.integers(0, 8)).map(
        lambda x: (w := x[0][:x[1]] + x[2] + x[0][x[1] + x[3]:])[:x[4]] + w[x[4]:x[4] + 2][::-1] + w[x[4] + 2:])))
def test_swaps_and_misspelled_stems(word):
    terms, want = {"stupid$": 1, "worthless$": 2, "scum$": 1, "lowei": 1}, 0.0
    for term, allowed in terms.items():
        edits = swapped(word, term[:-1]) if term.endswith("$") else min(swapped(word[:k], term) for k in range(len(word) + 1))
        want = max(want, toxicity.FUZZY ** edits if edits <= allowed else 0)
    assert toxicity.Matcher(terms, swaps=True).find(word)[0] == pytest.approx(want)


def test_misspelled_words_of_a_family(spark, make_docs):
    words = ["stupid", "pathetic", "scum"]
    texts = [(i, f"a {(words if i % 2 else ['student', 'patent', 'stop'])[i % 3]} day {i}", "en", "s") for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(240)], "doc_id long, toxic int")
    model = toxicity.train(make_docs(texts), labels)
    more = ["a sutpid day", "a spupid day", "a ptahetic day", "a scvm day", "a studio day", "a path of day"]
    got = toxicity.score(make_docs([(k, text, "en", "s") for k, text in enumerate(more)]), model).collect()
    assert [r["predicted"] for r in sorted(got, key=lambda r: r["doc_id"])] == [1, 1, 1, 1, 0, 0]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    seen = langid.crc_mod(docs.doc_id, 5) != 0
    model = toxicity.train(docs.filter(seen), labels.filter(langid.crc_mod(labels.doc_id, 5) != 0))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [(truth[r["doc_id"]], r["predicted"]) for r in toxicity.score(docs, model).collect() if r["held_out"] and r["doc_id"] in truth]
    caught, wrong = [p for t, p in held if t == 1], [p for t, p in held if t == 0]
    assert sum(caught) >= 0.85 * len(caught) and sum(wrong) <= 0.01 * len(wrong)


def test_a_cut_sample_flags_as_much(spark):
    """With a third of the clean documents and all toxic ones, about as many are flagged."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    flagged = [toxicity.score(docs, toxicity.train(docs, labels, 3000, clean)).agg({"predicted": "sum"}).first()[0] for clean in (6000, 900)]
    assert abs(flagged[0] - flagged[1]) <= 0.06 * flagged[0], flagged


def test_odd_rows(spark, make_docs, odd_docs, no_docs):
    texts = [(i, f"some words number {i}" if i % 2 else f"some idiot number {i}", "en", "s") for i in range(100)]
    labels = spark.createDataFrame([(i, 1, 1 - i % 2) for i in range(100)] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(make_docs(texts), labels)
    more = make_docs([(100, "such an 1diot !", "en", "s"), (101, "a good day", "en", "s")])
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(more, model).collect()} == {100: 1, 101: 0}
    rows = toxicity.score(odd_docs, model).collect()
    assert len(rows) == 9 and all(r["predicted"] == 0 and 0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(no_docs, model).collect() == []
    assert all(r["predicted"] == 0 for r in toxicity.score(odd_docs, toxicity.train(no_docs, labels)).collect())
