"""The review document, as ordered lines.

``(project_id, section, rank, pos, ord, text)``: sorted by these columns, the lines of
a project are its Markdown document.  Every row makes its own lines where it is, so a
project of any size is never gathered; counts are map-side aggregates.

Fixed values: the headings, table heads and field labels in the functions below are
those of the review document and stand where its lines are made.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..runtime import deal
from .graph import P

HEADER, DEPENDENCIES, FINDINGS, ELEMENTS, PATHS, SUMMARY = range(1, 7)
FIRST, LAST = -1, 99
ORDER = ["section", "rank", "pos", "ord"]
_POS = "STRUCT<rank:INT,pos:BIGINT,name:STRING>"


# -- counts and groups (also useful as tables) -----------------------------

def findings_by_severity(findings: DataFrame) -> DataFrame:
    """Findings with the rank of their severity, critical first."""
    return findings.withColumn("rank", X.rank_of(K.FINDING_SEVERITIES, F.col("severity"))).filter("rank IS NOT NULL")


def elements_by_level(elements: DataFrame) -> DataFrame:
    return elements.withColumn("rank", X.rank_of(K.HIERARCHY, F.col("hierarchy_level"))).filter("rank IS NOT NULL")


def status_breakdown(elements: DataFrame) -> DataFrame:
    """Elements per review status."""
    status = F.col("metadata.status")
    return elements.groupBy(P).agg(
        F.count(F.lit(1)).alias("elements"), *[F.count_if(status == s).alias(s) for s in K.STATUSES])


def severe_findings(findings: DataFrame) -> DataFrame:
    """Findings and how many are high or critical; projects without findings have no row."""
    return findings.groupBy(P).agg(
        F.count(F.lit(1)).alias("findings"), F.count_if(F.col("severity").isin("critical", "high")).alias("high_critical"))


def vulnerable_dependencies(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy(P).agg(
        F.count(F.lit(1)).alias("dependencies"), F.count_if(F.size("cves") > 0).alias("with_cves"))


# -- line helpers ----------------------------------------------------------

def _c(*parts) -> Column:
    """Parts joined; a null part is empty, so a line never vanishes for one of them."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _if(value: Column, *parts) -> Column:
    """The parts joined when ``value`` is not empty, else null."""
    return F.when(X.truthy(value.cast("string")).isNotNull(), _c(*parts))


def _or(value: Column, default: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def _blank(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _lines(df: DataFrame, section: int, rank, pos, *lines) -> DataFrame:
    """Rows of ``df`` to lines.  A line is text, a column, or several (``_many``); null
    lines are left out."""
    parts = [F.array(F.lit(x)) if isinstance(x, str) else x.column if isinstance(x, _Several) else F.array(x) for x in lines]
    text = F.filter(F.concat(*parts), lambda t: t.isNotNull())
    rank = F.lit(rank) if isinstance(rank, int) else rank
    pos = F.lit(None).cast(_POS) if pos is None else pos
    return df.select(P, F.lit(section).alias("section"), rank.cast("int").alias("rank"), pos.alias("pos"),
                     F.posexplode(text).alias("ord", "text"))


@dataclass(frozen=True)
class _Several:
    column: Column


def _many(items: Column) -> _Several:
    """An array of lines; a null array is no lines."""
    return _Several(F.coalesce(items, F.array().cast("array<string>")))


def _pos(df: DataFrame, column: str) -> Column:
    """The order of a row: a number, a text (such as a path), or rank and number."""
    kind, col = df.schema[column].dataType.typeName(), F.col(column)
    rank, number, name = F.lit(0), F.lit(0), F.lit(None)
    if kind == "struct":
        rank, number = col["rank"], col["pos"]
    elif kind == "string":
        name = col
    else:
        number = col
    return F.struct(rank.cast("int").alias("rank"), number.cast("bigint").alias("pos"), name.cast("string").alias("name"))


def _bullets(title: str, items: Column) -> _Several:
    filled = F.concat(F.array(F.lit(f"- **{title}:**")), F.transform(items, lambda i: _c("  - ", i)))
    return _many(F.when(F.size(items) > 0, filled))


# -- blocks ----------------------------------------------------------------

def cve_list(cves: Column) -> Column:
    shown = F.array_join(F.transform(cves, lambda c: _c(c["id"], " (", c["severity"], ")")), ", ")
    return F.when(F.size(cves) > 0, shown).otherwise(F.lit("none"))


def dependency_row(df: DataFrame) -> Column:
    used = F.col("version_in_use") if "version_in_use" in df.columns else F.lit(None)
    return _c("| ", F.col("package"), " | ", _or(used, "?"), " | ", _or(F.col("latest_version"), "?"), " | ",
              cve_list(F.col("cves")), " | ", _or(F.col("urgency"), "-"), " | ", F.col("metadata.status"), " |")


def header_lines(meta: DataFrame, graph_ref: DataFrame, builder: str = "Builder") -> DataFrame:
    m, g, s = meta.alias("m"), graph_ref.alias("g"), F.col("stats")
    row = lambda name, value: _if(value, f"| {name} | ", value.cast("string"), " |")
    tools = F.array_join(F.transform(F.map_entries("tools"), lambda e: _c(e["key"], " ", e["value"])), ", ")
    stat = lambda name, f: F.when(s.isNotNull(), _c(f"| {name} | ", _or(s[f], "?"), " |"))
    pct = F.regexp_replace(s["call_resolution_pct"].cast("string"), r"\.0$", "")
    return _lines(
        m.join(g, P, "left"), HEADER, 0, None,
        _c("# Spec: ", _blank(F.col("project_name"))), "", "| Field | Value |", "|-------|-------|",
        _c("| Spec version | ", _blank(F.col("spec_version")), " |"),
        _if(F.col("source_language"), "| Source language | ", F.col("source_language"),
            _blank(_if(F.col("source_version"), " ", F.col("source_version"))), " |"),
        row("Created", F.col("created_at")), row("Updated", F.col("updated_at")),
        F.when(F.size("tools") > 0, _c("| Tools | ", tools, " |")),
        "", "### CPG Reference", "", "| Field | Value |", "|-------|-------|",
        _c("| Path | `", _blank(F.col("path")), "` |"),
        _if(F.col("sha256"), "| SHA-256 | `", F.substring("sha256", 1, 16), "...` |"),
        row(builder, F.col("builder_version")), row("Built", F.col("built_at")),
        stat("Nodes", "nodes"), stat("Edges", "edges"), stat("Files", "files"), stat("Functions", "functions"),
        F.when(s["call_resolution_pct"].isNotNull(), _c("| Call resolution | ", pct, "% |")),
        "", "---", "")


def _heading(df: DataFrame, section: int, *lines: str) -> list[DataFrame]:
    """Opening lines of a section, and its closing blank line, where it has rows."""
    some = df.select(P).distinct()
    return [_lines(some, section, FIRST, None, *lines), _lines(some, section, LAST, None, "")]


def dependency_lines(dependencies: DataFrame) -> list[DataFrame]:
    rows = _lines(dependencies, DEPENDENCIES, 0, _pos(dependencies, "pos" if "pos" in dependencies.columns else "seq"),
                  dependency_row(dependencies))
    return _heading(dependencies, DEPENDENCIES, "", "## Ecosystem Dependencies", "",
                    "| Package | Version | Latest | CVEs | Urgency | Status |",
                    "|---------|---------|--------|------|---------|--------|") + [rows]


def finding_row() -> Column:
    c = F.col
    name = _blank(_if(c("cwe_name"), " (", c("cwe_name"), ")"))
    cwe = F.when(F.coalesce(c("cwe_id"), F.lit(0)) != 0, _c("CWE-", c("cwe_id").cast("string"), name)).otherwise(F.lit("-"))
    return _c("| `", c("file"), ":", c("line").cast("string"), "` | ", c("rule_id"), " | ", cwe, " | ",
              _or(c("message"), "-"), " | ", _or(c("action"), "-"), " | ", c("metadata.status"), " |")


def finding_lines(findings: DataFrame) -> list[DataFrame]:
    ranked = findings_by_severity(findings)
    rows = _lines(ranked, FINDINGS, F.col("rank"), _pos(findings, "seq"), finding_row())
    levels = _lines(ranked.select(P, "rank", "severity").distinct(), FINDINGS, F.col("rank"), None,
                    "", _c("### ", F.initcap("severity")), "",
                    "| Location | Rule | CWE | Message | Action | Status |",
                    "|----------|------|-----|---------|--------|--------|")
    return _heading(findings, FINDINGS, "", "## Security Findings") + [levels, rows]


def contract_lines(c: Column) -> list:
    e_line = lambda e: _c("  - ", e["condition"], " -- ", e["behavior"],
                                F.coalesce(F.concat(F.lit(" ("), X.truthy(e["severity"]), F.lit(")")), F.lit("")))
    t_line = lambda t: F.concat(F.lit("  - "), _or(t["from_state"], "?"), F.lit(" -> "), _or(t["to_state"], "?"),
                                F.coalesce(F.concat(F.lit(" ("), X.truthy(t["trigger"]), F.lit(")")), F.lit("")))
    block = lambda title, items, fn: _many(F.when(F.size(items) > 0, F.concat(
        F.array(F.lit(f"- **{title}:**")), F.transform(items, fn))))
    tb = c["trust_boundary"]
    has = c.isNotNull()
    return [
        F.when(has, F.lit("")), F.when(has, F.lit("**Contract**")), F.when(has, F.lit("")),
        _if(c["purpose"], "- **Purpose:** ", c["purpose"]),
        _bullets("Preconditions", c["preconditions"]), _bullets("Postconditions", c["postconditions"]),
        _bullets("Invariants", c["invariants"]), _bullets("Side effects", c["side_effects"]),
        block("Error conditions", c["error_conditions"], e_line),
        block("State transitions", c["state_transitions"], t_line),
        F.when(tb.isNotNull(), _c("- **Trust boundary:** input=", _or(tb["input_trust"], "?"), ", output=",
                                  _or(tb["output_trust"], "?"), _blank(_if(tb["sanitization"], ", sanitization: ", tb["sanitization"])))),
        _if(c["thread_safety"], "- **Thread safety:** ", c["thread_safety"]),
        _if(c["performance"], "- **Performance:** ", c["performance"])]


def data_model_lines(d: Column) -> list:
    opt = lambda v, a, b="": F.coalesce(F.concat(F.lit(a), X.truthy(v), F.lit(b)), F.lit(""))
    field = lambda f: _c("  - `", f["name"], "`", opt(f["type"], ": "), opt(f["constraints"], " (", ")"))
    entity = lambda e: F.concat(
        F.array(_c("- **", e["name"], "**", opt(e["description"], ": "))),
        F.coalesce(F.transform(e["fields"], field), F.array().cast("array<string>")))
    relation = lambda r: F.concat(F.lit("- "), _or(r["from_entity"], "?"), F.lit(" -> "), _or(r["to_entity"], "?"),
                                  opt(r["cardinality"], " [", "]"), opt(r["description"], ": "))
    related = F.size(d["relationships"]) > 0
    return [
        F.when(d.isNotNull(), F.lit("")), F.when(d.isNotNull(), F.lit("**Data Model**")),
        _many(F.flatten(F.transform(d["entities"], entity))),
        F.when(related, F.lit("")), F.when(related, F.lit("*Relationships:*")),
        _many(F.transform(d["relationships"], relation)),
        _if(d["lifecycle"], ""), _if(d["lifecycle"], "*Lifecycle:* ", d["lifecycle"])]


def element_lines(elements: DataFrame, projects: DataFrame) -> list[DataFrame]:
    c = F.col
    ranked = elements_by_level(elements)
    meta_fields = elements.schema["metadata"].dataType.fieldNames()
    meta = lambda f: c(f"metadata.{f}") if f in meta_fields else F.lit(None).cast("string")
    where = _blank(_if(c("file"), " -- `", c("file"), F.when(F.coalesce(c("line"), F.lit(0)) != 0, _c(":", c("line").cast("string"))).otherwise(F.lit("")), "`"))
    model = data_model_lines(c("data_model")) if "data_model" in elements.columns else []
    notes = [_if(c("notes"), ""), _if(c("notes"), "**Notes:** ", c("notes"))] if "notes" in elements.columns else []
    body = _lines(
        deal(ranked, "pos", P), ELEMENTS, c("rank"), _pos(elements, "pos"),
        "", _c("#### ", c("name")), "", _c("`", c("element_id"), "`", where), "",
        "| Confidence | Source | Status | Assigned to |", "|------------|--------|--------|-------------|",
        _c("| ", c("metadata.confidence"), " | ", c("metadata.source"), " | ", c("metadata.status"), " | ", _or(meta("assigned_to"), "-"), " |"),
        *contract_lines(c("contract")), *model, *notes,
        _if(meta("notes"), ""), _if(meta("notes"), "**Review notes:** ", meta("notes")), "", "---")
    levels = ranked.select(P, "rank", "hierarchy_level").distinct()
    opening = _lines(levels, ELEMENTS, c("rank"), None, "", _c("### ", X.plural_heading(c("hierarchy_level"))), "")
    last = F.struct(F.lit(2147483647).alias("rank"), F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("name"))
    closing = _lines(levels, ELEMENTS, c("rank"), last, "")
    return [_lines(projects, ELEMENTS, FIRST, None, "", "## Elements"), opening, body, closing]


def usage_path_lines(paths: DataFrame) -> list[DataFrame]:
    c = F.col
    nodes = F.array_join(F.transform("nodes", lambda n: _c("`", n, "`")), " -> ")
    body = _lines(
        paths, PATHS, 0, _pos(paths, "seq"), "", _c("### ", c("name")), "", _if(c("description"), c("description")),
        _if(c("description"), ""), "", "| Field | Value |", "|-------|-------|", _c("| ID | `", c("id"), "` |"),
        _if(c("path_type"), "| Type | ", c("path_type"), " |"), _c("| Status | ", c("metadata.status"), " |"), "",
        _c("**Nodes:** ", nodes), "")
    return _heading(paths, PATHS, "", "## Usage Paths", "") + [body]


def summary_lines(projects: DataFrame, elements: DataFrame, findings: DataFrame | None = None,
                  dependencies: DataFrame | None = None) -> DataFrame:
    c = F.col
    wide = projects.join(status_breakdown(elements), P, "left")
    n = lambda name: F.coalesce(c(name), F.lit(0)).cast("string")
    rows = [_c("| Elements | ", n("elements"), " | ", n("confirmed"), " confirmed, ", n("needs_review"), " needs_review, ",
               n("extracted"), " extracted", F.when(c("disputed") > 0, _c(", ", n("disputed"), " disputed")).otherwise(F.lit("")), " |")]
    if findings is not None:
        wide = wide.join(severe_findings(findings), P, "left")
        rows.append(_if(c("findings"), "| Security findings | ", n("findings"), " | ", n("high_critical"), " high/critical |"))
    if dependencies is not None:
        wide = wide.join(vulnerable_dependencies(dependencies), P, "left")
        rows.append(_if(c("dependencies"), "| Dependencies | ", n("dependencies"), " | ", n("with_cves"), " with CVEs |"))
    return _lines(wide, SUMMARY, 0, None, "", "---", "", "## Review Summary", "", "| Category | Count | Breakdown |",
                  "|----------|-------|-----------|", *rows)


def review_document(tables: dict[str, DataFrame], builder: str = "Builder") -> DataFrame:
    """All lines of all projects' review documents, in ``ORDER`` per project."""
    projects = tables["meta"].select(P)
    parts = [header_lines(tables["meta"], tables["graph_ref"], builder)]
    if "dependencies" in tables:
        parts += dependency_lines(tables["dependencies"])
    if "findings" in tables:
        parts += finding_lines(tables["findings"])
    parts += element_lines(tables["elements"], projects)
    if "usage_paths" in tables:
        parts += usage_path_lines(tables["usage_paths"])
    parts.append(summary_lines(projects, tables["elements"], tables.get("findings"), tables.get("dependencies")))
    return reduce(DataFrame.unionByName, parts)
