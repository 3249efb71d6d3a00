import zlib
from collections import Counter

from specframe.llm import sharding


def test_every_shard_has_the_mixture(spark, make_docs):
    docs = make_docs([(i, f"text {i % 7}", "en", "hot" if i % 3 else f"s{i % 11}") for i in range(4000)])
    rows = sharding.interleave(docs, 16).collect()
    assert len(rows) == 4000 and set(Counter(r["shard"] for r in rows).values()) == {250}
    for shard in range(16):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(250))
    whole = Counter(r["source"] for r in rows)
    for (shard, source), n in Counter((r["shard"], r["source"]) for r in rows).items():
        assert abs(n - whole[source] / 16) <= 3, (shard, source, n)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.interleave(odd_docs, 4).collect()
    assert sorted(Counter(r["shard"] for r in rows).values()) == [2, 2, 2, 3]
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[1]["size"] == 16 and by_id[1]["text_crc32"] == 0
    assert by_id[4]["size"] == 200_016 and by_id[4]["text_crc32"] == zlib.crc32(b"x" * 200_000)
    assert sharding.interleave(no_docs, 4).collect() == []


def test_written_shards_hold_every_row(spark, make_docs, odd_docs, tmp_path):
    more = odd_docs.unionByName(make_docs([(None, f"text {i}", "en", "a") for i in range(30)] + [(1, "other", "en", "b"), (1, "other", "en", "b")]))
    path = str(tmp_path / "shards")
    sharding.write_shards(more, path, 4)
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(more.columns).collect())) == sorted(map(str, more.collect()))
    for shard, n in Counter(r["shard"] for r in back.collect()).items():
        assert sorted(r["slot"] for r in back.filter(back.shard == shard).collect()) == list(range(n))
