"""Readers on documents that Spark builds from the test tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import documents as D
from ..sources import manifests as M
from ..runtime import shared_folder
from ..sources.sinks import read_spec_tables, spec_lines, write_specs
from ..sources.split import large_elements, large_graph, split_items
from .registry import Tables, query

c = F.col


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def graph_docs(t: Tables) -> DataFrame:
    """A small code graph per customer: a module, a function, an import, one edge."""
    k, n = c("c_custkey"), c("c_nationkey")
    doc = _text(
        '{"tool": "1.', n, '", "nodes": [{"id": "m', k, '", "kind": "module", "name": "', c("c_name"),
        '", "location": {"file": "a/', k, '.py", "line": 1, "column": 2}}, {"id": "f', k, '", "kind": "function", "name": "f", "scope": "m', k,
        '", "file": "top.py", "line": 7, "location": {"file": "x", "line": ', n, ', "column": 3}, "end_line": 1, "end_location": {"line": ', n + 5,
        '}}, {"id": "i', k, '", "kind": "import", "name": "from x", "attrs": {"module": "os.', c("c_mktsegment"),
        '", "names": ["join", "split"], "is_from": true, "aliases": {"join": "j"}}}], "edges": [{"source": "m', k, '", "target": "f', k, '", "kind": "contains"}]}')
    return t.customer.select(_text("p", k).alias("project_id"), doc.alias("doc"))


@query("read_graph_nodes", """
SELECT 'p' || c_custkey AS project_id, 0 AS pos, 'm' || c_custkey AS id, 'module' AS kind, c_name AS name, NULL AS scope, 'a/' || c_custkey || '.py' AS file, 1 AS line, 2 AS "column", NULL AS end_line FROM customer
UNION ALL SELECT 'p' || c_custkey, 1, 'f' || c_custkey, 'function', 'f', 'm' || c_custkey, 'top.py', 7, 3, c_nationkey + 5 FROM customer
UNION ALL SELECT 'p' || c_custkey, 2, 'i' || c_custkey, 'import', 'from x', NULL, '', 0, 0, NULL FROM customer""")
def read_graph_nodes(t):
    return D.parse_graph(graph_docs(t))[0].drop("attrs")


@query("read_graph_edges", "SELECT 'p' || c_custkey AS project_id, 0 AS pos, 'm' || c_custkey AS src, 'f' || c_custkey AS dst, 'contains' AS kind FROM customer")
def read_graph_edges(t):
    return D.parse_graph(graph_docs(t))[1]


@query("graph_versions", "SELECT 'p' || c_custkey AS project_id, '1.' || c_nationkey AS builder_version FROM customer")
def graph_versions(t):
    return D.graph_versions(graph_docs(t), "tool")


@query("imports_from_nodes", """SELECT 'p' || c_custkey AS project_id, 2 AS pos, '' AS file, 0 AS line, 'os.' || c_mktsegment AS module, 'join,split' AS names, true AS is_from, 'j' AS alias FROM customer""")
def imports_from_nodes(t):
    return D.imports_from_nodes(D.parse_graph(graph_docs(t))[0]).select(
        "project_id", "pos", "file", "line", "module", F.array_join("names", ",").alias("names"), "is_from", F.try_element_at("aliases", F.lit("join")).alias("alias"))


def finding_docs(t: Tables) -> DataFrame:
    e, u = c("event_id"), c("user_id")
    some = _text('"findings": [{"file": "f', u, '.py", "line": ', e, ', "rule_id": "R", "severity": "', c("event_type"), '", "cwe_id": ', u,
                 ', "compliance": {"nist_800_53": ["AC-', u, '"], "other": [1]}}, {"file": "g", "line": 2, "rule_id": "S"}]')
    body = F.when(c("event_type") == "view", F.lit('"other": 1')).otherwise(some)
    return t.events.select(_text("e", e).alias("project_id"), _text('{"v": "', F.when(u > 50, u.cast("string")).otherwise(F.lit("")), '", ', body, "}").alias("doc"))


@query("read_findings", """
SELECT 'e' || event_id AS project_id, 0 AS seq, 'f' || user_id || '.py' AS file, event_id AS line, 'R' AS rule_id, event_type AS severity, CAST(user_id AS INT) AS cwe_id, 'AC-' || user_id AS nist FROM events WHERE event_type <> 'view'
UNION ALL SELECT 'e' || event_id, 1, 'g', 2, 'S', NULL, NULL, NULL FROM events WHERE event_type <> 'view'""")
def read_findings(t):
    return D.parse_findings(finding_docs(t), "v")[0].select(
        "project_id", "seq", "file", "line", "rule_id", "severity", "cwe_id", F.get("compliance.nist_800_53", F.lit(0)).alias("nist"))


@query("finding_versions", "SELECT 'e' || event_id AS project_id, CASE WHEN user_id > 50 THEN CAST(user_id AS VARCHAR) END AS version FROM events")
def finding_versions(t):
    return D.parse_findings(finding_docs(t), "v")[1]


def audit_docs(t: Tables) -> DataFrame:
    k = c("p_partkey")
    version = F.when(c("p_size") > 25, _text('{"version": "', c("p_size"), '"}')).otherwise(_text('"', c("p_size"), '"'))
    return t.part.select(
        c("p_brand").alias("project_id"), F.lpad(k.cast("string"), 12, "0").alias("path"),
        _text('{"tool": "', F.when(c("p_size") > 10, _text("v", k)).otherwise(F.lit("")), '", "package": "', c("p_name"), '", "ecosystem": "java", "version": ', version,
              ', "summary": {"urgency": "', c("p_type"), '"}, "cves": {"latest_cves": [{"id": "C', k, '", "severity": "low"}]}, "eol": {"eol": null, "eol_date": "2020"}}').alias("doc"))


@query("read_audits", """SELECT p_brand AS project_id, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS pos, p_name AS package, 'java' AS ecosystem,
  CASE WHEN p_size > 25 THEN '{"version":"' || p_size || '"}' ELSE CAST(p_size AS VARCHAR) END AS version, p_type AS urgency, 'C' || p_partkey AS cve, '2020' AS eol_date FROM part""")
def read_audits(t):
    return D.parse_audits(audit_docs(t), "tool").select(
        "project_id", "pos", "package", "ecosystem", F.replace("version", F.lit(" "), F.lit("")).alias("version"), "summary.urgency",
        F.get("cves.latest_cves", F.lit(0))["id"].alias("cve"), "eol.eol_date")


@query("first_audit_version", "SELECT p_brand AS project_id, arg_min('v' || p_partkey, p_partkey) FILTER (p_size > 10) AS version FROM part GROUP BY p_brand")
def first_audit_version(t):
    return D.first_version(D.parse_audits(audit_docs(t), "tool"))


@query("read_contexts", "SELECT 'c' || conv_id AS project_id, 't' || turn AS node_ref, 0 AS ord, role AS relationship, text FROM conversations UNION ALL SELECT 'c' || conv_id, 't' || turn, 1, 'callee', role FROM conversations")
def read_contexts(t):
    results = F.array(F.struct(c("role").alias("relationship"), "text"), F.struct(F.lit("callee").alias("relationship"), c("role").alias("text")))
    docs = t.conversations.select(_text("c", c("conv_id")).alias("project_id"), _text("t", c("turn")).alias("node_ref"),
                                  F.to_json(F.struct(F.struct(F.lit(1).alias("n")).alias("metadata"), results.alias("results"))).alias("doc"))
    return D.parse_contexts(docs)


def spec_docs(t: Tables) -> DataFrame:
    """A spec per order: two elements, one finding, one dependency, one path."""
    k = c("o_orderkey")
    meta = '"metadata": {"confidence": "high", "source": "human_input", "status": "confirmed"}'
    contract = F.when(c("o_orderstatus") == "F", _text('{"purpose": "', c("o_orderpriority"), '", "preconditions": ["a", "b"]}')).otherwise(F.lit("{}"))
    return t.spread("orders").select(_text("o", k).alias("project_id"), _text(
        '{"meta": {"project_name": "P', k, '", "spec_version": "0.1.0", "tools": {"x": "1"}}, "cpg_ref": {"path": "g.json", "stats": {"nodes": ', k, '}}, '
        '"elements": {"mod:z', k, '": {"hierarchy_level": "module", "node_ref": "z", "name": "Z", ', meta, '}, '
        '"cls:a', k, '": {"hierarchy_level": "class", "node_ref": "a", "name": "A", "parent": "mod:z', k, '", "line": ', c("o_custkey"), ', "contract": ', contract, ", ", meta, "}}, "
        '"security_findings": [{"file": "f", "line": ', c("o_custkey"), ', "rule_id": "R", "severity": "low", ', meta, "}], "
        '"ecosystem_dependencies": [{"package": "d', k, '", "ecosystem": "java", "cves": [{"id": "C", "severity": "LOW"}], ', meta, "}], "
        '"usage_paths": [{"id": "u", "name": "U", "nodes": ["a", "z"], ', meta, "}]}").alias("doc"))


_SPEC_ROWS = """
SELECT 'o' || o_orderkey AS project_id, 'meta' AS section, 0 AS pos, 'P' || o_orderkey AS key, '0.1.0' AS detail FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'graph_ref', 0, 'g.json', CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'elements', 0, 'mod:z' || o_orderkey, 'Z//' FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'elements', 1, 'cls:a' || o_orderkey, 'A/' || o_custkey || '/' || CASE WHEN o_orderstatus = 'F' THEN o_orderpriority || ':2' ELSE '' END FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'findings', 0, 'R', CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'dependencies', 0, 'd' || o_orderkey, 'C' FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'usage_paths', 0, 'u', 'a>z' FROM orders"""


@query("read_specs", _SPEC_ROWS)
def read_specs(t):
    return _spec_rows(D.parse_specs(spec_docs(t)))


def _spec_rows(s: dict) -> DataFrame:
    row = lambda df, name, pos, key, detail: df.select("project_id", F.lit(name).alias("section"), pos.cast("bigint").alias("pos"), key.alias("key"), detail.cast("string").alias("detail"))
    blank = lambda v: F.coalesce(v.cast("string"), F.lit(""))
    contract = blank(F.when(c("contract").isNotNull(), _text(c("contract.purpose"), ":", F.size("contract.preconditions"))))
    return reduce(DataFrame.unionByName, [
        row(s["meta"], "meta", F.lit(0), c("project_name"), c("spec_version")),
        row(s["graph_ref"], "graph_ref", F.lit(0), c("path"), c("stats.nodes")),
        row(s["elements"], "elements", c("pos"), c("element_id"), _text(c("name"), "/", blank(c("line")), "/", contract)),
        row(s["findings"], "findings", c("seq"), c("rule_id"), c("line")),
        row(s["dependencies"], "dependencies", c("seq"), c("package"), F.get("cves", F.lit(0))["id"]),
        row(s["usage_paths"], "usage_paths", c("seq"), c("id"), F.array_join("nodes", ">"))])


@query("spec_round_trip", _SPEC_ROWS)
def spec_round_trip(t):
    """All sections are written and read back."""
    path = f"{shared_folder(t.spark)}/specframe/specs-{uuid.uuid4().hex}"
    source = D.parse_specs(spec_docs(t))
    few = {k: v.withColumn("body_project", c("project_id")).withColumn("project_id", _text("g", F.crc32("project_id") % 4)) for k, v in source.items()}
    write_specs(few, path)
    back = read_spec_tables(t.spark, path, {k: v.schema for k, v in few.items()})
    return _spec_rows({k: v.withColumn("project_id", c("body_project")) for k, v in back.items()})


@query("spec_lines", """
SELECT 'o' || o_orderkey AS project_id, 'elements' AS section, 0 AS rank, 0 AS pos, 'mod:z' || o_orderkey AS key, 'Z' AS name, 'high' AS confidence FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'elements', 0, 1, 'cls:a' || o_orderkey, 'A', 'high' FROM orders
UNION ALL SELECT 'o' || o_orderkey, s, 0, 0, NULL, CASE s WHEN 'usage_paths' THEN 'U' END, CASE WHEN s NOT IN ('meta', 'graph_ref') THEN 'high' END
  FROM orders, (SELECT unnest(['meta', 'graph_ref', 'findings', 'dependencies', 'usage_paths']) AS s)""")
def write_spec_lines(t):
    return spec_lines(D.parse_specs(spec_docs(t))).withColumn("b", F.from_json("body", "name STRING, metadata STRUCT<confidence STRING>")).select(
        "project_id", "section", "rank", "pos", "key", "b.name", "b.metadata.confidence")


@query("parse_requirements", r"""
WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10))), E' \t\r\n\f\v') AS line FROM documents),
p AS (SELECT doc_id, trim(regexp_extract(line, '^[^><=!;]*'), E' \t\r\n\f\v') AS package FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '-'))
SELECT 'd' || doc_id AS project_id, package FROM p WHERE package <> ''""")
def parse_requirements(t):
    lines = t.spread("documents").select(_text("d", c("doc_id")).alias("project_id"), F.explode(F.split("text", "\n")).alias("value"))
    return M.parse_requirements(lines)


@query("parse_setup_cfg", """
SELECT 'p' || p_partkey AS project_id, p_name AS package FROM part UNION ALL SELECT 'p' || p_partkey, p_brand FROM part
UNION ALL SELECT 'p' || p_partkey, 'inline' FROM part WHERE p_size > 25""")
def parse_setup_cfg(t):
    docs = t.part.select(_text("p", c("p_partkey")).alias("project_id"), _text(
        "[metadata]\nname = x\ninstall_requires = wrong\n\n[options]\npackages = find:\ninstall_requires =", F.when(c("p_size") > 25, F.lit(" inline>=1")).otherwise(F.lit("")),
        "\n    ", c("p_name"), " >= 1.0\n    # note\n\n    ", c("p_brand"), "<2; python_version > '3'\n    =\nzip_safe = false\n\n[options.extras]\ninstall_requires = wrong\n").alias("doc"))
    return M.parse_setup_cfg(docs)


@query("parse_pom", """SELECT 'p' || p_partkey AS project_id, 'org.' || p_brand || ':' || p_type AS package FROM part
UNION ALL SELECT 'p' || p_partkey, 'org.run:' || p_type FROM part""")
def parse_pom(t):
    dep = lambda g, a, scope: _text("<dependency><groupId>", g, "</groupId><artifactId>", a, "</artifactId>", scope, "</dependency>")
    docs = t.part.select(_text("p", c("p_partkey")).alias("project_id"), _text(
        '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies>', dep(_text("org.", c("p_brand")), c("p_type"), F.lit("")),
        dep(F.lit("org.run"), c("p_type"), F.lit("<scope>runtime</scope>")), dep(F.lit("org.t"), c("p_type"), F.lit("<scope>test</scope>")),
        dep(F.lit("org.s"), c("p_type"), F.lit("<scope>provided</scope>")), "</dependencies></project>").alias("doc"))
    return M.parse_pom_docs(docs)


@query("checksums", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def checksums(t):
    return t.documents.select("doc_id", D.checksum(c("text")).alias("sha256"))


@query("stale_artifacts", """SELECT o_orderkey AS project_id, o_orderpriority AS artifact, coalesce(o_orderdate <= m, false) AS is_stale
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) - INTERVAL 60 DAY AS m FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def stale_artifacts(t):
    artifacts = t.orders.select(c("o_orderkey").alias("project_id"), c("o_orderpriority").alias("path"), c("o_orderdate").alias("modified"))
    sources = t.lineitem.select(c("l_orderkey").alias("project_id"), F.lit("s").alias("path"), (c("l_shipdate") - F.expr("INTERVAL 60 DAYS")).alias("modified"))
    return D.stale_artifacts(artifacts, sources)


def _documents(lines, label: str) -> str:
    """Write ``(project_id, ord, value)`` as one file per project; the files' folder."""
    path = f"{shared_folder(lines.sparkSession)}/specframe/{label}-{uuid.uuid4().hex}"
    lines.repartition("project_id").sortWithinPartitions("project_id", "ord").select("project_id", "value").write.partitionBy("project_id").text(path)
    return path


@query("large_documents", """
WITH n AS (SELECT 'n' || c_nationkey AS project_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS pos, * FROM customer),
e AS (SELECT 'n' || s_nationkey AS project_id, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos, * FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer))
SELECT project_id, 'nodes' AS section, pos, 'c' || c_custkey AS a, 'src/{' || c_mktsegment || '.py' AS b, c_name || '"}' AS c FROM n
UNION ALL SELECT project_id, 'edges', pos, 's' || s_suppkey, 'c{' || s_nationkey, '[' || s_name FROM e
UNION ALL SELECT project_id, 'elements', pos, 'cls:{' || c_name, 'c' || c_custkey, 'high' FROM n""")
def large_documents(t):
    """A document per nation is written, split at its braces and read."""
    project = lambda k: _text("n", c(k)).alias("project_id")
    line = lambda df, key, section, pos, text: df.select(project(key), F.struct(F.lit(section).alias("s"), pos.cast("long").alias("p")).alias("ord"), text.alias("value"))
    nations = t.customer.select("c_nationkey").distinct()
    suppliers = t.supplier.join(nations.withColumnRenamed("c_nationkey", "s_nationkey"), "s_nationkey", "left_semi")
    last = lambda k, by: F.lead(k).over(Window.partitionBy(by).orderBy(k)).isNull()
    comma = lambda k, by: F.when(last(k, by), F.lit("")).otherwise(F.lit(","))
    node = _text('{"id": "c', c("c_custkey"), '", "kind": "class", "name": "', c("c_name"), '\\"}", "location": {"file": "src/{', c("c_mktsegment"), '.py", "line": 1}}', comma("c_custkey", "c_nationkey"))
    edge = _text('{"source": "s', c("s_suppkey"), '", "target": "c{', c("s_nationkey"), '", "kind": "[', c("s_name"), '"}', comma("s_suppkey", "s_nationkey"))
    element = _text('"cls:{', c("c_name"), '": {"node_ref": "c', c("c_custkey"), '", "metadata": {"confidence": "high"}}', comma("c_custkey", "c_nationkey"))
    none = F.lit(0)
    path = _documents(line(nations, "c_nationkey", 0, none, F.lit('{"version": "1{", "stats": {"n": 1}, "nodes": [')).unionByName(
        line(t.customer, "c_nationkey", 1, c("c_custkey"), node)).unionByName(
        line(nations, "c_nationkey", 2, none, F.lit('], "edges": ['))).unionByName(line(suppliers, "s_nationkey", 3, c("s_suppkey"), edge)).unionByName(
        line(nations, "c_nationkey", 4, none, F.lit('], "elements": {'))).unionByName(line(t.customer, "c_nationkey", 5, c("c_custkey"), element)).unionByName(
        line(nations, "c_nationkey", 6, none, F.lit("}}"))), "documents")
    items = split_items(t.spark, path, F.regexp_extract("path", "project_id=([^/]*)", 1))
    nodes, edges = large_graph(items)
    elements = large_elements(items)
    shown = lambda df, section, *cols: df.select("project_id", F.lit(section).alias("section"), "pos", *[F.col(x).alias(n) for x, n in zip(cols, "abc")])
    return shown(nodes, "nodes", "id", "file", "name").unionByName(shown(edges, "edges", "src", "dst", "kind")).unionByName(
        shown(elements.withColumns({"ref": F.get_json_object("body", "$.node_ref"), "sure": F.get_json_object("body", "$.metadata.confidence")}), "elements", "element_id", "ref", "sure"))
