import hashlib
import math

import numpy as np
import pytest

from specframe.llm import langid


def slow_bits(tree, text):
    """Code length by the definition: longest seen context, escapes, 256 equal choices."""
    data, total = bytes(3) + text.encode(), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            seen = tree.nodes[k].get(data[i - k:i])
            if not seen:
                continue
            n = sum(seen.values()) + len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / n)
                break
            total -= math.log2(len(seen) / n)
        else:
            total += 8
    return total


def test_code_lengths():
    trees = {lang: langid.ContextTree() for lang in ("a", "b")}
    trees["a"].train("the quick brown fox the lazy dog".encode())
    trees["b"].train("der schnelle braune Fuchs ÄÖÜ".encode())
    scorer = langid.Scorer(trees)
    for text in ("", "the", "Ä 日本 fox", "x" * 70_000 + "the dog"):
        assert np.allclose(scorer.bits(text), [slow_bits(trees[k], text) for k in ("a", "b")])
    assert scorer.best("the dog")[0] == "a" and scorer.best("")[0] == "a" and scorer.best("")[1] == 0.5


def test_full_tables_change_nothing():
    trees = {"a": langid.ContextTree()}
    trees["a"].train(b"some text of one language")
    scorer, fresh = langid.Scorer(trees), langid.Scorer(trees)
    scorer.cost_count = 1 << 21
    assert np.allclose(scorer.bits("another text"), fresh.bits("another text"))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(langid.crc_mod(docs.doc_id, 3) != 1))
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in langid.identify(docs, model).collect() if r["held_out"]]
    assert len(held) > 200 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in held)


@pytest.fixture(scope="module")
def small_model(make_docs):
    return langid.train(make_docs([(1, "the cat and the dog", "en", "s"), (2, "der Hund und die Katze", "de", "s"), (3, None, "fr", "s"),
                                   (4, "no language", None, "s"), (None, "no id", "xx", "s"), (1, "the cat and the dog", "en", "s")]))


def test_odd_rows(spark, small_model, odd_docs, no_docs):
    rows = langid.identify(odd_docs, small_model).collect()
    pred = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert len(rows) == 9 and pred[1] == pred[2] == pred[3] == pred[8] == "und" and pred[5] in ("de", "en")
    kept = langid.keep_identified(odd_docs, small_model, 0.5)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["4", "5", "5", "7", "None"]
    assert langid.identify(no_docs, small_model).collect() == []


def test_bounded_sample(spark, make_docs):
    docs = make_docs([(i, f"text {i}", "en" if i % 3 else "de", "s") for i in range(600)] + [(7, f"copy {i}", "en", "s") for i in range(300)])
    model = langid.train(docs, docs_per_lang=20, chars_per_lang=100)
    roots = {lang: sum(tree.nodes[0][b""].values()) for lang, tree in model.sent.value.items()}
    assert set(roots) == {"en", "de"} and all(0 < n <= 110 for n in roots.values())


def test_sample_fills_up_behind_a_very_long_text(spark, make_docs):
    order = sorted(range(60), key=lambda i: int(hashlib.md5(f"0:{i}".encode()).hexdigest()[:15], 16))
    texts = {i: "short text" for i in order} | {order[1]: "long " * 80_000, order[-1]: "the last one: zebra"}
    model = langid.train(make_docs([(i, text, "en", "s") for i, text in texts.items()]))
    tree = model.sent.value["en"]
    assert tree.nodes[3][b"ebr"] == {ord("a"): 1} and tree.nodes[3][b"sho"] == {ord("r"): 58}
    assert sum(tree.nodes[0][b""].values()) == 58 * 10 + 19 + langid.TRAIN_CHARS // langid.STRETCHES


def test_nothing_to_learn_from(spark, odd_docs, no_docs):
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}
