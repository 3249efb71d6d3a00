import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from specframe.llm import packing

from .conftest import ODD_TEXTS

PATH = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), min_size=1, max_size=5))
def test_best_filling(counts):
    """The longest length is there, and no choice of the others comes closer."""
    chosen = packing.fill_window(counts, 30)
    assert max(counts) in chosen and all(n <= counts[length] for length, n in chosen.items())
    sums = (sum(length * n for length, n in zip(counts, pick, strict=True)) for pick in product(*[range(n + 1) for n in counts.values()])
            if dict(zip(counts, pick, strict=True))[max(counts)])
    assert sum(length * n for length, n in chosen.items()) == max(s for s in sums if s <= 30)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=20))
def test_plan_places_every_piece_once(counts):
    used, runs = Counter(), packing.plan(counts, 64)
    starts = defaultdict(list)
    for r in runs:
        starts[r.length].append(r)
    filled = Counter()
    for length, n in counts.items():
        mine = sorted(starts[length], key=lambda r: r.first_rank)
        assert mine[0].first_rank == 0
        for r, after in zip(mine, [*mine[1:], None], strict=True):
            end = after.first_rank if after else n
            assert (end - r.first_rank) % r.each == 0
            for rank in range(r.first_rank, end):
                filled[r.first_sequence + (rank - r.first_rank) // r.each] += length
            used[length] += end - r.first_rank
    assert used == Counter(counts) and all(v <= 64 for v in filled.values())


def check_packed(rows, docs):
    tokenizer = Tokenizer.from_file(PATH)
    ids = {k: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        mine = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(mine)
        assert r["ids_crc32"] == zlib.crc32(np.array(mine[r["start"]:r["start"] + r["length"]], dtype="<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for group in sequences.values():
        at = 0
        for offset, length in sorted(group):
            assert offset == at
            at += length
        assert at <= 1024
    return ids, pieces, sequences


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "th", "ing", "é", "日本", "ß", "ñandú", "Ünï", "12", "!?", ".", "'s", "<|endoftext|>", "<|endof"]), max_size=12).map("".join),
                min_size=1, max_size=4))
def test_ids_of_the_plain_call(coder, texts):
    plain = Tokenizer.from_file(PATH)
    got = [np.frombuffer(c, "<u4").tolist() for c in coder.encode_all(texts)]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.fixture(scope="module")
def coder(spark):
    return packing.coder(packing.TokenizerFile.of(spark, PATH))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids, pieces, sequences = check_packed(packing.pack_documents(docs, PATH).collect(), texts)
    for k, mine in pieces.items():
        assert sorted(mine) == [(s, min(1024, len(ids[k]) - s)) for s in range(0, len(ids[k]), 1024)]
    assert pieces.keys() == texts.keys()
    assert len(sequences) <= 1.03 * sum(map(len, ids.values())) / 1024 + 2


def test_odd_rows(spark, odd_docs, no_docs):
    rows = packing.pack_documents(odd_docs, PATH).collect()
    texts = {doc_id: text for doc_id, text, _, _ in ODD_TEXTS}
    ids, pieces, _ = check_packed(rows, texts)
    assert len(pieces[5]) == 2 and pieces.keys() == texts.keys()  # both copies of the repeated row
    assert pieces[1] == [(0, 1)]
    assert packing.pack_documents(no_docs, PATH).collect() == []


def test_ids_of_pieces(spark, odd_docs):
    rows = packing.cut_pieces(odd_docs, packing.TokenizerFile.of(spark, PATH), with_ids=True).collect()
    assert all(zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] for r in rows)
