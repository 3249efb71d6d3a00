"""Readers and writers on real files."""

import json

from pyspark.sql import functions as F

from specframe.operators import graph, report
from specframe.operators.imports import classify, match_imports, route_choices, route_symbols
from specframe.plans import jobs
from specframe.sources import documents as D
from specframe.sources import manifests as M
from specframe.sources import rules as R
from specframe.sources import sinks

GRAPH = {
    "version": "0.9",
    "nodes": [
        {"id": "m", "kind": "module", "name": "util", "location": {"file": "/w/app/src/util.py", "line": 1, "column": 0}},
        {"id": "c", "kind": "class", "name": "Box", "scope": "m", "location": {"file": "/w/app/src/util.py", "line": 3}, "end_location": {"line": 20}},
        {"id": "f", "kind": "function", "name": "open", "scope": "c", "location": {"file": "/w/app/src/util.py", "line": 5}, "end_location": {"line": 9}},
        {"id": "g", "kind": "function", "name": "open", "scope": "c", "location": {"file": "/w/app/src/util.py", "line": 11}, "end_location": {"line": 15}},
        {"id": "i", "kind": "import", "name": "import cStringIO", "file": "/w/app/src/util.py", "line": 2, "attrs": {"module": "cStringIO", "names": ["StringIO"], "is_from": True}},
    ],
    "edges": [{"source": "m", "target": "c", "kind": "contains"}],
}


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_assemble_job(spark, tmp_path):
    write(tmp_path / "graphs" / "demo.json", GRAPH)
    write(tmp_path / "scan" / "demo.json", {"version": "1", "findings": [{"file": "util.py", "line": 12, "rule_id": "R", "severity": "High"}]})
    write(tmp_path / "audits" / "demo" / "a.json", {"version_of_tool": "2", "package": "lib", "ecosystem": "python", "summary": {"urgency": "critical"}})
    projects = spark.createDataFrame([("demo", "Demo", "src", "python", "3.11")], "project_id string, project_name string, source_root string, language string, source_version string")
    tables = jobs.assemble(spark, projects, str(tmp_path / "graphs"), now="2024-01-01T00:00:00+00:00",
                           finding_paths=str(tmp_path / "scan"), audit_paths=str(tmp_path / "audits" / "*"))
    ids = {r.element_id: r.parent for r in tables["elements"].collect()}
    assert ids == {"mod:util": None, "cls:util.Box": "mod:util", "fn:util.Box/open": "cls:util.Box", "fn:util.Box/open@11": "cls:util.Box"}
    assert tables["findings"].collect()[0].node_ref == "g"
    assert tables["dependencies"].collect()[0].urgency == "immediate"
    ref = tables["graph_ref"].collect()[0]
    assert (ref.path, ref.stats.nodes, ref.stats.functions, len(ref.sha256)) == ("demo.json", 5, 2, 64)
    assert tables["meta"].collect()[0].tools == {"builder": "0.9", "scanner": "1", "auditor": "2"}

    lines = report.review_document(tables)
    sinks.write_reviews(lines, str(tmp_path / "reviews"))
    parts = sorted((tmp_path / "reviews" / "project_id=demo").glob("part-*"))
    text = "".join(p.read_text() for p in parts).split("\n")
    assert text[0] == "# Spec: Demo" and "### Classes" in text and text.index("### Classes") < text.index("### Functions")
    assert "| Security findings | 1 | 1 high/critical |" in text
    numbered = sinks.read_reviews(spark, str(tmp_path / "reviews")).orderBy("number").collect()
    assert [r.text for r in numbered] == text[:-1] and [r.number for r in numbered] == list(range(len(text) - 1))
    sinks.write_specs(tables, str(tmp_path / "spec"))
    back = spark.read.json(str(tmp_path / "spec" / "section=elements"))
    assert back.count() == 4
    again = jobs.compare(tables["elements"].withColumn("contract", F.lit(None).cast(tables["elements"].schema["contract"].dataType)), tables["elements"])
    sinks.write_comparisons({k: again[k] for k in ("summary", "skipped")}, str(tmp_path / "cmp"))
    assert spark.read.json(str(tmp_path / "cmp" / "summary")).collect()[0].elements_compared == 0
    assert spark.read.json(str(tmp_path / "cmp" / "skipped")).count() == 4
    found = sinks.read_comparisons(spark, str(tmp_path / "cmp"), {"skipped": again["skipped"].schema})["skipped"]
    assert sorted(map(str, found.collect())) == sorted(map(str, again["skipped"].collect()))


def test_graph_without_nodes(spark, tmp_path):
    write(tmp_path / "x.json", {"edges": []})
    assert D.read_graph(spark, str(tmp_path), strict=False)[0].count() == 0
    try:
        D.read_graph(spark, str(tmp_path))[0].collect()
        raise AssertionError("no error")
    except Exception as exc:  # noqa: BLE001
        assert "has no 'nodes'" in str(exc)


def test_graph_lines(spark, tmp_path):
    nodes = "\n".join(json.dumps({"project_id": "p", "pos": i, "n": n}) for i, n in enumerate(GRAPH["nodes"]))
    edges = json.dumps({"project_id": "p", "pos": 0, "e": GRAPH["edges"][0]})
    write(tmp_path / "n.json", nodes)
    write(tmp_path / "e.json", edges)
    n, e = D.read_graph_lines(spark, str(tmp_path / "n.json"), str(tmp_path / "e.json"))
    assert graph.graph_stats(n, e).collect()[0][1:] == (5, 1, 1, 2)


def test_manifests_and_checksums(spark, tmp_path):
    write(tmp_path / "one" / "requirements.txt", "# c\n-r x\n\nflask>=2\nnumpy ; python_version>'3'\nx==1\n")
    write(tmp_path / "one" / "setup.cfg", "[options]\ninstall_requires =\n    six!=1\n")
    pom = "<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency><dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency></dependencies>"
    write(tmp_path / "one" / "pom.xml", f'<project xmlns="http://maven.apache.org/POM/4.0.0">{pom}</project>')
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(M.read_requirements(spark, str(tmp_path / "*" / "requirements.txt"))) == [("one", "flask"), ("one", "numpy"), ("one", "x")]
    assert rows(M.read_setup_cfg(spark, str(tmp_path / "*" / "setup.cfg"))) == [("one", "six")]
    assert rows(M.parse_pom(spark, str(tmp_path / "*" / "pom.xml"))) == [("one", "g:a")]
    import hashlib
    got = D.file_checksum(spark, str(tmp_path / "one" / "pom.xml")).collect()[0].sha256
    assert got == hashlib.sha256((tmp_path / "one" / "pom.xml").read_bytes()).hexdigest()


def test_packaged_rules(spark):
    for source, n, actions in (("py2to3", 40, {"rename": 24, "removed": 13, "split": 1, "choice": 2}), ("java8to17", 7, {"rename": 4, "removed": 3})):
        rules, _ = R.load_rules(spark, source)
        assert rules.count() == n
        assert {r.action: r["count"] for r in rules.groupBy("action").count().collect()} == actions
    rules, transforms = R.load_rules(spark, "py2to3")
    imports = spark.createDataFrame(
        [("p", "a.py", 1, "cStringIO", ["StringIO"]), ("p", "a.py", 2, "distutils.core", ["setup"]), ("p", "a.py", 3, "threading", []), ("p", "a.py", 4, "cPickle", [])],
        "project_id string, file string, line int, module string, names array<string>")
    found = classify(match_imports(imports, rules), rules, "3.11")
    assert {r.line: (r.rule_key, r.advisory) for r in found.collect()} == {1: ("cStringIO", False), 2: ("distutils", True), 4: ("cPickle", False)}
    routed = route_symbols(found, transforms)
    paths = {(r.line, r.new_path): r.needs_review for r in routed.collect()}
    assert paths == {(1, "io.BytesIO"): True, (1, "io.StringIO"): True, (2, "setuptools.setup"): False, (4, "pickle"): False}
    choice = route_choices(routed).collect()[0].alternatives
    assert [(a.new_path, a.condition) for a in choice] == [("io.BytesIO", "if handling bytes data"), ("io.StringIO", "if handling text data")]


def test_map_imports_heads_its_report(spark):
    imports = spark.createDataFrame([("p", "a.py", 1, "cPickle", ["dumps"]), ("p", "b.py", 2, "threading", [])], "project_id string, file string, line int, module string, names array<string>")
    tables = jobs.map_imports(spark, imports, "py2to3", "3.12")
    head = tables["metadata"].collect()[0].asDict(True)
    assert head == {"project_id": "p", "migration_pair": "py2to3", "source": {"language": "python", "version": "2.7"},
                    "target": {"language": "python", "version": "3.12"}, "codebase_path": None, "total_files_scanned": 2}
    assert [r.module for r in tables["findings"].collect()] == ["cPickle"]


def test_requirement_names_keep_their_letters(spark):
    """Blanks of ASCII go, also before a final U+0085; a v at either end stays."""
    lines = spark.createDataFrame([("p", v) for v in ("vllm>=1", " cv ", "\x0bx\x0b", "a \u0085", "b  ", "d\r")], "project_id string, value string")
    assert sorted(r.package for r in M.parse_requirements(lines).collect()) == ["a \u0085", "b  ", "cv", "d", "vllm", "x"]


def counted(spark, rows, schema):
    """Rows, and an accumulator of how often one of them was computed."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(pass_on, schema), seen


def test_specs_are_parsed_once(spark):
    spec = {"meta": {"project_name": "A\tB"}, "cpg_ref": {"stats": {"nodes": "x", "edges": 2}}, "security_findings": [{"file": "f", "line": "x"}, {}],
            "elements": {"a": {"name": "n", "contract": {}}, "b": {"contract": {"purpose": "p"}, "line": [1]}, "c": {"cö": 1}}, "usage_paths": 3,
            "ecosystem_dependencies": {"package": "one"}}
    texts = [json.dumps(spec).replace("\\t", "\t"), json.dumps(spec).replace('"contract"', '"\\u0063ontract"'), '{"meta": {', None]
    docs, seen = counted(spark, [(f"p{i}", t) for i, t in enumerate(texts)], "project_id string, doc string")
    tables = D.parse_specs(docs)
    rows = {k: sorted(v.collect(), key=lambda r: (r.project_id, r["pos"] if "pos" in r else 0)) for k, v in tables.items()}
    assert seen.value == len(texts)
    assert [r.project_name for r in rows["meta"]] == ["A\tB", "A\tB", None, None]
    assert [r.stats and r.stats.edges for r in rows["graph_ref"]] == [2, 2, None, None]
    assert [(r.element_id, r.contract_json, r.contract and r.contract.purpose) for r in rows["elements"]] == 2 * [("a", None, None), ("b", '{"purpose":"p"}', "p"), ("c", None, None)]
    assert [(r.seq, r.file) for r in rows["findings"] if r.project_id == "p0"] == [(0, "f"), (1, None)]
    assert not rows["usage_paths"] and [(r.seq, r.package) for r in rows["dependencies"]] == 2 * [(0, "one")]


def test_written_specs_are_computed_once(spark, tmp_path):
    paths, seen = counted(spark, [(f"p{i % 3}", i, f"u{i}") for i in range(30)], "project_id string, seq long, id string")
    sinks.write_specs({"usage_paths": paths}, str(tmp_path / "spec"))
    assert seen.value == 30
    back = sinks.read_spec_tables(spark, str(tmp_path / "spec"), {"usage_paths": paths.schema})["usage_paths"]
    assert sorted((r.project_id, r.seq, r.id) for r in back.collect()) == sorted((f"p{i % 3}", i, f"u{i}") for i in range(30))
