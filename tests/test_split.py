"""Large documents cut at every place against a plain parser."""

import json
import random

import pytest

from specframe.sources import documents as D
from specframe.sources import split

HARD = ["{", "}", "[{", "\\", "\\\"", '"', '{"a": [1, {"b": "}"}]}', "a: [", "é\n", "", '": [', "\\\\"]


@pytest.fixture
def small_splits(spark, monkeypatch):
    monkeypatch.setattr(split, "UNITS", 7)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def value(rng, depth):
    kind = rng.randrange(5 if depth else 2)
    if kind == 0:
        return rng.choice(HARD)
    if kind == 1:
        return rng.choice([1, -2.5, True, None])
    if kind == 2:
        return [value(rng, depth - 1) for _ in range(rng.randrange(3))]
    return {rng.choice(HARD) + str(i): value(rng, depth - 1) for i in range(rng.randrange(4))}


def document(rng):
    item = lambda: {rng.choice(HARD) + str(i): value(rng, 2) for i in range(rng.randrange(4))}
    sections = {
        "version": rng.choice(HARD), "tools": ["a{", "b}"], "deep": [[1, [2]], ["x", "{"]], "stats": {"a": 1, "b": "}"},
        "list\\": [item() for _ in range(rng.randrange(6))], "nodes": [item() for _ in range(rng.randrange(6))],
        "elements": {rng.choice(HARD) + str(i): item() for i in range(rng.randrange(6))}, "none": [], "empty": {}}
    names = list(sections)
    rng.shuffle(names)
    return {n: sections[n] for n in names}


def test_random_documents(spark, tmp_path, small_splits):
    rng = random.Random(3)
    want = []
    for d in range(40):
        doc = document(rng)
        (tmp_path / f"d{d}.json").write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=d % 2 == 0))
        for section, items in doc.items():
            if isinstance(items, (list, dict)) and section not in ("tools", "deep", "stats"):
                pairs = enumerate(items) if isinstance(items, list) else items.items()
                want += [(f"d{d}", section, pos, key if isinstance(items, dict) else None, items[key]) for pos, (key, *_) in enumerate(pairs)]
    (tmp_path / "void.json").write_text("")
    (tmp_path / "scalar.json").write_text("[1, 2]")
    got = split.split_items(spark, str(tmp_path)).collect()
    text = lambda s: None if s is None else json.loads(f'"{s}"')
    assert len(want) > 150
    assert sorted((r.project_id, text(r.section), r.pos, str(text(r.key)), json.dumps(json.loads(r.item), sort_keys=True)) for r in got) == \
        sorted((p, s, n, str(k), json.dumps(x, sort_keys=True)) for p, s, n, k, x in want)


def test_same_tables_as_whole_documents(spark, tmp_path, small_splits):
    nodes = [{"id": f"n{i}", "kind": "function", "name": HARD[i % len(HARD)], "location": {"file": "a.py", "line": i}, "attrs": {"k": "{"}} for i in range(50)]
    (tmp_path / "p.x.json").write_text(json.dumps({"version": "1", "nodes": nodes, "edges": [{"source": "n1", "target": "n2", "kind": "calls"}] * 3}))
    rows = lambda df: sorted(map(str, df.collect()))
    for large, whole in zip(split.large_graph(split.split_items(spark, str(tmp_path))), D.read_graph(spark, str(tmp_path))):
        assert large.columns == whole.columns and rows(large) == rows(whole)
    assert spark.read.option("lineSep", "{").text(str(tmp_path)).rdd.getNumPartitions() > 5
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "p.json").write_text(json.dumps({"findings": [{"file": "a", "line": 1, "message": m, "compliance": {"pci_dss": ["{"]}} for m in HARD]}))
    assert rows(split.large_findings(split.split_items(spark, str(tmp_path / "f")))) == rows(D.read_findings(spark, str(tmp_path / "f"))[0])
