"""The review document on the test tables: a project per nation, customers as classes,
orders as findings, suppliers as packages, regions' nations as usage paths."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import report as J
from ..runtime import shared_folder
from ..sources.sinks import read_reviews, write_reviews
from .registry import Tables, query

c = F.col
NOW = "2024-05-01T00:00:00+00:00"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _project(key: str):
    return _text("n", c(key)).alias("project_id")


def nations(t: Tables) -> DataFrame:
    return t.nation.select(c("n_nationkey").alias("k"), c("n_name").alias("name"), c("n_regionkey").alias("r"))


def meta(rows: DataFrame) -> DataFrame:
    tools = F.when(c("r") > 1, F.create_map(F.lit("scan"), c("r").cast("string"), F.lit("audit"), F.lit("2")))
    return rows.select(
        _project("k"), c("name").alias("project_name"), F.lit("0.1.0").alias("spec_version"), F.lit("java").alias("source_language"),
        F.when(c("r") > 0, c("r").cast("string")).alias("source_version"), F.lit(NOW).alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"), tools.alias("tools"))


def graph_ref(rows: DataFrame) -> DataFrame:
    k = c("k").cast("bigint")
    stats = F.struct(k.alias("nodes"), (k + 1).alias("edges"), F.lit(None).cast("bigint").alias("files"), F.lit(3).cast("bigint").alias("functions"),
                     F.when(k > 5, k.cast("double") + F.when(k > 10, F.lit(0.5)).otherwise(F.lit(0.0))).alias("call_resolution_pct"))
    return rows.select(
        _project("k"), _text("g", k, ".json").alias("path"), F.sha2("name", 256).alias("sha256"), F.lit(NOW).alias("built_at"),
        F.when(k > 3, F.lit("0.9")).alias("builder_version"), F.when(k > 1, stats).alias("stats"))


def elements(t: Tables) -> DataFrame:
    k, b = c("c_custkey"), c("c_acctbal")
    seg = c("c_mktsegment")
    null = lambda f: F.lit(None).cast(S.struct(S.CONTRACT)[f].dataType)
    errors = F.array(F.struct(seg.alias("condition"), F.lit("fails").alias("behavior"), F.when(b > 7000, F.lit("fatal")).alias("severity")))
    trust = F.struct(F.lit("mixed").alias("input_trust"), F.lit(None).cast("string").alias("output_trust"), F.when(b > 8000, seg).alias("sanitization"))
    contract = F.struct(
        F.when(b > 5500, _text("serves ", seg)).alias("purpose"), F.array(seg, F.lit("open")).alias("preconditions"), null("postconditions").alias("postconditions"),
        F.when(b > 9000, F.array(F.lit("stable"))).alias("invariants"), null("side_effects").alias("side_effects"), errors.alias("error_conditions"),
        F.array(F.struct(F.lit("a").alias("from_state"), F.lit(None).cast("string").alias("to_state"), seg.alias("trigger"))).alias("state_transitions"),
        trust.alias("trust_boundary"), F.when(b > 6000, F.lit("safe")).alias("thread_safety"), F.lit("fast").alias("performance"))
    model = F.from_json(_text(
        '{"entities": [{"name": "', seg, '", "description": "d", "fields": [{"name": "id", "type": "int"}, {"name": "x", "constraints": "unique"}]}, {"name": "Y"}], '
        '"relationships": [{"from_entity": "', seg, '", "cardinality": "1:n"}], "lifecycle": "kept"}'), S.DATA_MODEL)
    status = F.when(b > 8000, F.lit("confirmed")).when(b > 4000, F.lit("needs_review")).when(b > 0, F.lit("extracted")).otherwise(F.lit("disputed"))
    return t.customer.select(
        _project("c_nationkey"), k.alias("pos"), _text("cls:c", k).alias("element_id"), F.when(b > 3000, F.lit("class")).otherwise(F.lit("module")).alias("hierarchy_level"),
        c("c_name").alias("name"), F.when(b > 1000, _text("src/", seg)).alias("file"), F.when(b > 2000, k).otherwise(F.lit(0)).cast("int").alias("line"),
        F.when(b > 5000, contract).alias("contract"), F.when(b < 1500, model).alias("data_model"), F.when(b < 500, F.lit("look")).alias("notes"),
        F.struct(F.lit("high").alias("confidence"), F.lit("human_input").alias("source"), status.alias("status"), F.when(b > 9000, F.lit("human")).alias("assigned_to"),
                 F.lit(None).cast("string").alias("updated_at"), F.lit(None).cast("string").alias("updated_by"), F.when(b < 100, F.lit("odd")).alias("notes")).alias("metadata"))


def findings(t: Tables) -> DataFrame:
    sev = F.when(c("o_orderpriority") == "1-URGENT", F.lit("critical")).when(c("o_orderpriority") == "2-HIGH", F.lit("high")).when(
        c("o_orderpriority") == "3-MEDIUM", F.lit("medium")).otherwise(F.lit("low"))
    return t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        _project("c_nationkey"), c("o_orderkey").alias("seq"), F.lit("f.py").alias("file"), c("o_custkey").alias("line"), c("o_orderstatus").alias("rule_id"), sev.alias("severity"),
        F.when(c("o_totalprice") > 100000, c("o_custkey").cast("int")).alias("cwe_id"), F.when(c("o_totalprice") > 200000, F.lit("Weak")).alias("cwe_name"),
        F.when(c("o_orderstatus") == "F", F.lit("m")).alias("message"), F.when(c("o_orderstatus") == "O", F.lit("fix")).alias("action"),
        F.struct(F.lit("extracted").alias("status")).alias("metadata"))


def dependencies(t: Tables) -> DataFrame:
    b = c("s_acctbal")
    cves = F.array(F.struct(c("s_name").alias("id"), F.lit("HIGH").alias("severity")), F.struct(F.lit("X").alias("id"), F.lit("LOW").alias("severity")))
    return t.supplier.select(
        _project("s_nationkey"), c("s_suppkey").alias("pos"), c("s_name").alias("package"), F.when(b > 5000, F.lit("1.0")).alias("latest_version"),
        F.when(b > 2000, cves).alias("cves"), F.when(b > 7000, F.lit("high")).alias("urgency"), F.struct(F.lit("extracted").alias("status")).alias("metadata"))


def usage_paths(t: Tables) -> DataFrame:
    return t.supplier.select(
        _project("s_nationkey"), c("s_suppkey").alias("seq"), _text("u", c("s_suppkey")).alias("id"), c("s_name").alias("name"),
        F.when(c("s_acctbal") > 4000, F.lit("text")).alias("description"), F.when(c("s_acctbal") > 6000, F.lit("call_chain")).alias("path_type"),
        F.array(F.lit("a"), c("s_name"), F.lit("z")).alias("nodes"), F.struct(F.lit("confirmed").alias("status")).alias("metadata"))


def _sql(rows: str, project: str, section: int, rank: str, pos: str, lines: list[str]) -> str:
    """Lines of ``rows`` as the document has them; a null line is left out, a list is several."""
    parts = ", ".join(x[1:] if x.startswith("*") else f"[{x}]" for x in lines)
    text = f"list_filter(flatten([{parts}]), lambda x: x IS NOT NULL)"
    return (f"SELECT project_id, section, rank, pos, CAST(unnest(range(0, len(l))) AS INT) AS ord, unnest(l) AS text FROM "
            f"(SELECT 'n' || {project} AS project_id, {section} AS section, CAST({rank} AS INT) AS rank, CAST({pos} AS BIGINT) AS pos, {text} AS l FROM {rows})")


def _opt(value: str, *parts: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN " + " || ".join(parts) + " END"


_TABLE = ["'| Field | Value |'", "'|-------|-------|'"]
_V = "n_nationkey"
_SQL = {}
_SQL["header"] = _sql("nation", _V, 1, "0", "NULL", [
    "'# Spec: ' || n_name", "''", *_TABLE, "'| Spec version | 0.1.0 |'",
    "'| Source language | java' || CASE WHEN n_regionkey > 0 THEN ' ' || n_regionkey ELSE '' END || ' |'", f"'| Created | {NOW} |'",
    "CASE WHEN n_regionkey > 1 THEN '| Tools | scan ' || n_regionkey || ', audit 2 |' END", "''", "'### CPG Reference'", "''", *_TABLE,
    f"'| Path | `g' || {_V} || '.json` |'", "'| SHA-256 | `' || left(sha256(n_name), 16) || '...` |'", f"CASE WHEN {_V} > 3 THEN '| Builder | 0.9 |' END", f"'| Built | {NOW} |'",
    f"CASE WHEN {_V} > 1 THEN '| Nodes | ' || {_V} || ' |' END", f"CASE WHEN {_V} > 1 THEN '| Edges | ' || ({_V} + 1) || ' |' END", f"CASE WHEN {_V} > 1 THEN '| Files | ? |' END",
    f"CASE WHEN {_V} > 1 THEN '| Functions | 3 |' END", f"CASE WHEN {_V} > 5 THEN '| Call resolution | ' || {_V} || CASE WHEN {_V} > 10 THEN '.5' ELSE '' END || '% |' END",
    "''", "'---'", "''"])
_SQL["dependencies"] = " UNION ALL ".join([
    _sql("(SELECT DISTINCT s_nationkey FROM supplier)", "s_nationkey", 2, "-1", "NULL", [
        "''", "'## Ecosystem Dependencies'", "''", "'| Package | Version | Latest | CVEs | Urgency | Status |'", "'|---------|---------|--------|------|---------|--------|'"]),
    _sql("(SELECT DISTINCT s_nationkey FROM supplier)", "s_nationkey", 2, "99", "NULL", ["''"]),
    _sql("supplier", "s_nationkey", 2, "0", "s_suppkey", [
        "'| ' || s_name || ' | ? | ' || CASE WHEN s_acctbal > 5000 THEN '1.0' ELSE '?' END || ' | ' || CASE WHEN s_acctbal > 2000 THEN s_name || ' (HIGH), X (LOW)' ELSE 'none' END "
        "|| ' | ' || CASE WHEN s_acctbal > 7000 THEN 'high' ELSE '-' END || ' | extracted |'"])])
_ORDERS = """(SELECT o.*, c_nationkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END AS r,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Critical' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium' ELSE 'Low' END AS title FROM orders o JOIN customer ON c_custkey = o_custkey)"""
_SQL["findings"] = " UNION ALL ".join([
    _sql(f"(SELECT DISTINCT c_nationkey FROM {_ORDERS})", "c_nationkey", 3, "-1", "NULL", ["''", "'## Security Findings'"]),
    _sql(f"(SELECT DISTINCT c_nationkey FROM {_ORDERS})", "c_nationkey", 3, "99", "NULL", ["''"]),
    _sql(f"(SELECT DISTINCT c_nationkey, r, title FROM {_ORDERS})", "c_nationkey", 3, "r", "NULL", [
        "''", "'### ' || title", "''", "'| Location | Rule | CWE | Message | Action | Status |'", "'|----------|------|-----|---------|--------|--------|'"]),
    _sql(_ORDERS, "c_nationkey", 3, "r", "o_orderkey", [
        "'| `f.py:' || o_custkey || '` | ' || o_orderstatus || ' | ' || CASE WHEN o_totalprice > 100000 AND o_custkey <> 0 THEN 'CWE-' || o_custkey || CASE WHEN o_totalprice > 200000 THEN ' (Weak)' ELSE '' END "
        "ELSE '-' END || ' | ' || CASE WHEN o_orderstatus = 'F' THEN 'm' ELSE '-' END || ' | ' || CASE WHEN o_orderstatus = 'O' THEN 'fix' ELSE '-' END || ' | extracted |'"])])
_CON = "c_acctbal > 5000"
_w = lambda cond, text: f"CASE WHEN {cond} THEN {text} END"
_SQL["elements"] = " UNION ALL ".join([
    _sql("nation", _V, 4, "-1", "NULL", ["''", "'## Elements'"]),
    _sql("(SELECT DISTINCT c_nationkey, c_acctbal > 3000 AS k FROM customer)", "c_nationkey", 4, "CASE WHEN k THEN 4 ELSE 3 END", "NULL",
         ["''", "CASE WHEN k THEN '### Classes' ELSE '### Modules' END", "''"]),
    _sql("(SELECT DISTINCT c_nationkey, c_acctbal > 3000 AS k FROM customer)", "c_nationkey", 4, "CASE WHEN k THEN 4 ELSE 3 END", "0", ["''"]).replace(", CAST(0 AS BIGINT) AS pos", ", -1 AS pos"),
    _sql("customer", "c_nationkey", 4, "CASE WHEN c_acctbal > 3000 THEN 4 ELSE 3 END", "c_custkey", [
        "''", "'#### ' || c_name", "''",
        "'`cls:c' || c_custkey || '`' || CASE WHEN c_acctbal > 1000 THEN ' -- `src/' || c_mktsegment || CASE WHEN c_acctbal > 2000 AND c_custkey <> 0 THEN ':' || c_custkey ELSE '' END || '`' ELSE '' END",
        "''", "'| Confidence | Source | Status | Assigned to |'", "'|------------|--------|--------|-------------|'",
        "'| high | human_input | ' || CASE WHEN c_acctbal > 8000 THEN 'confirmed' WHEN c_acctbal > 4000 THEN 'needs_review' WHEN c_acctbal > 0 THEN 'extracted' ELSE 'disputed' END || ' | ' "
        "|| CASE WHEN c_acctbal > 9000 THEN 'human' ELSE '-' END || ' |'",
        _w(_CON, "''"), _w(_CON, "'**Contract**'"), _w(_CON, "''"), _w("c_acctbal > 5500", "'- **Purpose:** serves ' || c_mktsegment"),
        _w(_CON, "'- **Preconditions:**'"), _w(_CON, "'  - ' || c_mktsegment"), _w(_CON, "'  - open'"),
        _w("c_acctbal > 9000", "'- **Invariants:**'"), _w("c_acctbal > 9000", "'  - stable'"),
        _w(_CON, "'- **Error conditions:**'"), _w(_CON, "'  - ' || c_mktsegment || ' -- fails' || CASE WHEN c_acctbal > 7000 THEN ' (fatal)' ELSE '' END"),
        _w(_CON, "'- **State transitions:**'"), _w(_CON, "'  - a -> ? (' || c_mktsegment || ')'"),
        _w(_CON, "'- **Trust boundary:** input=mixed, output=?' || CASE WHEN c_acctbal > 8000 THEN ', sanitization: ' || c_mktsegment ELSE '' END"),
        _w("c_acctbal > 6000", "'- **Thread safety:** safe'"), _w(_CON, "'- **Performance:** fast'"),
        *[_w("c_acctbal < 1500", x) for x in (
            "''", "'**Data Model**'", "'- **' || c_mktsegment || '**: d'", "'  - `id`: int'", "'  - `x` (unique)'", "'- **Y**'", "''", "'*Relationships:*'",
            "'- ' || c_mktsegment || ' -> ? [1:n]'", "''", "'*Lifecycle:* kept'")],
        _w("c_acctbal < 500", "''"), _w("c_acctbal < 500", "'**Notes:** look'"), _w("c_acctbal < 100", "''"), _w("c_acctbal < 100", "'**Review notes:** odd'"), "''", "'---'"])])
_SQL["usage_paths"] = " UNION ALL ".join([
    _sql("(SELECT DISTINCT s_nationkey FROM supplier)", "s_nationkey", 5, "-1", "NULL", ["''", "'## Usage Paths'", "''"]),
    _sql("(SELECT DISTINCT s_nationkey FROM supplier)", "s_nationkey", 5, "99", "NULL", ["''"]),
    _sql("supplier", "s_nationkey", 5, "0", "s_suppkey", [
        "''", "'### ' || s_name", "''", _w("s_acctbal > 4000", "'text'"), _w("s_acctbal > 4000", "''"), "''", *_TABLE, "'| ID | `u' || s_suppkey || '` |'",
        _w("s_acctbal > 6000", "'| Type | call_chain |'"), "'| Status | confirmed |'", "''", "'**Nodes:** `a` -> `' || s_name || '` -> `z`'", "''"])])
_COUNTS = f"""(SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS e,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 8000) AS a, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 4000 AND c_acctbal <= 8000) AS b,
  (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0 AND c_acctbal <= 4000) AS x, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal <= 0) AS d,
  (SELECT count(*) FROM {_ORDERS} WHERE c_nationkey = n_nationkey) AS f, (SELECT count(*) FROM {_ORDERS} WHERE c_nationkey = n_nationkey AND r <= 2) AS hc,
  (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 2000) AS w FROM nation)"""
_SQL["summary"] = _sql(_COUNTS, _V, 6, "0", "NULL", [
    "''", "'---'", "''", "'## Review Summary'", "''", "'| Category | Count | Breakdown |'", "'|----------|-------|-----------|'",
    "'| Elements | ' || e || ' | ' || a || ' confirmed, ' || b || ' needs_review, ' || x || ' extracted' || CASE WHEN d > 0 THEN ', ' || d || ' disputed' ELSE '' END || ' |'",
    _w("f > 0", "'| Security findings | ' || f || ' | ' || hc || ' high/critical |'"), _w("s > 0", "'| Dependencies | ' || s || ' | ' || w || ' with CVEs |'")])


def _shown(df: DataFrame) -> DataFrame:
    """Closing lines of a level sort behind all elements; here their position shows as -1."""
    pos = F.when(c("pos.rank") == 2147483647, F.lit(-1)).otherwise(c("pos.pos")).cast("bigint")
    return df.select("project_id", "section", "rank", pos.alias("pos"), "ord", "text")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


@query("review_header", _SQL["header"].replace(
    "FROM nation)", "FROM (SELECT c_custkey AS n_nationkey, c_name AS n_name, c_nationkey AS n_regionkey FROM customer))"))
def review_header(t):
    rows = t.customer.select(c("c_custkey").alias("k"), c("c_name").alias("name"), c("c_nationkey").alias("r"))
    return _shown(J.header_lines(meta(rows), graph_ref(rows)))


@query("review_dependencies", _SQL["dependencies"])
def review_dependencies(t):
    return _shown(_union(J.dependency_lines(dependencies(t))))


@query("review_findings", _SQL["findings"])
def review_findings(t):
    return _shown(_union(J.finding_lines(findings(t))))


@query("review_elements", _SQL["elements"])
def review_elements(t):
    return _shown(_union(J.element_lines(elements(t), meta(nations(t)).select("project_id"))))


@query("review_usage_paths", _SQL["usage_paths"])
def review_usage_paths(t):
    return _shown(_union(J.usage_path_lines(usage_paths(t))))


@query("review_summary", _SQL["summary"])
def review_summary(t):
    return _shown(J.summary_lines(meta(nations(t)).select("project_id"), elements(t), findings(t), dependencies(t)))


@query("review_document", " UNION ALL ".join(_SQL.values()))
def review_document(t):
    return _shown(_document(t))


def _document(t: Tables) -> DataFrame:
    return J.review_document({
        "meta": meta(nations(t)), "graph_ref": graph_ref(nations(t)), "elements": elements(t), "findings": findings(t), "dependencies": dependencies(t), "usage_paths": usage_paths(t)})


@query("review_files", f"""SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY section, rank, pos IS NOT DISTINCT FROM -1, pos NULLS FIRST, ord) - 1 AS number, text
  FROM ({" UNION ALL ".join(_SQL.values())})""")
def review_files(t):
    """Reviews are written as files and read back in order."""
    path = f"{shared_folder(t.spark)}/specframe/reviews-{uuid.uuid4().hex}"
    write_reviews(_document(t), path)
    return read_reviews(t.spark, path)


@query("findings_by_severity", f"SELECT 'n' || c_nationkey AS project_id, o_orderkey AS seq, r AS rank FROM {_ORDERS}")
def findings_by_severity(t):
    return J.findings_by_severity(findings(t)).select("project_id", "seq", "rank")


@query("elements_by_level", "SELECT 'n' || c_nationkey AS project_id, 'cls:c' || c_custkey AS element_id, CASE WHEN c_acctbal > 3000 THEN 4 ELSE 3 END AS rank FROM customer")
def elements_by_level(t):
    return J.elements_by_level(elements(t)).select("project_id", "element_id", "rank")


@query("status_breakdown", f"SELECT 'n' || n_nationkey AS project_id, e AS elements, x AS extracted, b AS needs_review, a AS confirmed, d AS disputed FROM {_COUNTS} WHERE e > 0")
def status_breakdown(t):
    return J.status_breakdown(elements(t))


@query("severe_findings", f"SELECT 'n' || n_nationkey AS project_id, f AS findings, hc AS high_critical FROM {_COUNTS} WHERE f > 0")
def severe_findings(t):
    return J.severe_findings(findings(t))


@query("vulnerable_dependencies", f"SELECT 'n' || n_nationkey AS project_id, s AS dependencies, w AS with_cves FROM {_COUNTS} WHERE s > 0")
def vulnerable_dependencies(t):
    return J.vulnerable_dependencies(dependencies(t))
