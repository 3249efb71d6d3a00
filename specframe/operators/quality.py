"""Table constraints and the violation rows they produce.

A constraint looks at one row and says whether it is broken and why.  All constraints
of a table are evaluated in one projection, so checking costs one scan and no shuffle.
Violations never fail a job.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .graph import P


@dataclass(frozen=True)
class Constraint:
    path: str          # below the row's own path
    rule: str
    broken: Column     # null counts as not broken
    message: Column


def _shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def required(column: str, path: str | None = None) -> Constraint:
    """The field must be there."""
    return Constraint(column if path is None else path, "required", F.col(column).isNull(),
                      F.lit(f"'{column.split('.')[-1]}' is a required property"))


def one_of(column: str, values: Iterable[str], path: str | None = None) -> Constraint:
    """An existing value must be in the list."""
    values = list(values)
    return Constraint(column if path is None else path, "enum", ~F.col(column).isin(values),
                      F.concat(F.lit("'"), _shown(F.col(column)), F.lit(f"' is not one of {values}")))


def constant(column: str, value: str, path: str | None = None) -> Constraint:
    return Constraint(column if path is None else path, "const", F.col(column) != value,
                      F.concat(F.lit(f"'{value}' was expected, got '"), _shown(F.col(column)), F.lit("'")))


def of_type(column: str, type_name: str, path: str | None = None) -> Constraint:
    """A value still held as text must read as ``type_name`` (a Spark type)."""
    return Constraint(column if path is None else path, "type", F.col(column).isNotNull() & F.col(column).try_cast(type_name).isNull(),
                      F.concat(F.lit("'"), _shown(F.col(column)), F.lit(f"' is not of type {type_name}")))


def known_keys(column: str, allowed: Iterable[str], path: str | None = None) -> Constraint:
    """An object, as JSON text or a map, must hold no other keys."""
    allowed = list(allowed)
    keys = F.json_object_keys(column)
    extra = F.array_sort(F.array_except(keys, F.array(*[F.lit(a) for a in allowed])))
    return Constraint(column if path is None else path, "unknown_key", F.size(extra) > 0,
                      F.concat(F.lit("unexpected keys: "), F.array_join(extra, ", ")))


def in_range(column: str, low: float, high: float, path: str | None = None) -> Constraint:
    return Constraint(column if path is None else path, "range", ~F.col(column).between(low, high),
                      F.concat(_shown(F.col(column)), F.lit(f" is not between {low} and {high}")))


def violations(df: DataFrame, constraints: Iterable[Constraint], row_path: Column | None = None) -> DataFrame:
    """``(project_id, path, rule, message)`` for every broken constraint of every row.

    ``row_path`` names the row; the path of a violation is that name and the field
    joined by a dot, or ``(root)`` when both are empty."""
    prefix = F.lit(None).cast("string") if row_path is None else F.nullif(row_path, F.lit(""))
    found = F.filter(F.array(*[
        F.when(c.broken, F.struct(
            F.coalesce(F.nullif(F.concat_ws(".", prefix, F.nullif(F.lit(c.path), F.lit(""))), F.lit("")), F.lit("(root)")).alias("path"),
            F.lit(c.rule).alias("rule"), c.message.alias("message")))
        for c in constraints]), lambda v: v.isNotNull())
    return df.select(P, F.explode(found).alias("v")).select(P, "v.*")


def metadata_constraints(column: str = "metadata") -> list[Constraint]:
    return [
        required(f"{column}.confidence"), required(f"{column}.source"), required(f"{column}.status"),
        one_of(f"{column}.confidence", K.CONFIDENCE), one_of(f"{column}.source", K.SOURCES),
        one_of(f"{column}.status", K.STATUSES), one_of(f"{column}.assigned_to", K.ASSIGNEES)]


def _timestamp(column: str) -> Constraint:
    return of_type(column, "timestamp")


def meta_constraints() -> list[Constraint]:
    return [required("project_name"), required("spec_version"), constant("spec_version", K.SPEC_VERSION),
            _timestamp("created_at"), _timestamp("updated_at")]


def graph_ref_constraints() -> list[Constraint]:
    return [required("path"), in_range("stats.call_resolution_pct", 0, 100), _timestamp("built_at")]


def element_constraints() -> list[Constraint]:
    trust = "contract.trust_boundary"
    bad_error = F.filter("contract.error_conditions", lambda e: e["condition"].isNull() | e["behavior"].isNull())
    bad_level = F.filter("contract.error_conditions",
                         lambda e: e["severity"].isNotNull() & ~e["severity"].isin(*K.ERROR_SEVERITIES))
    return [
        required("hierarchy_level"), required("node_ref"), required("name"),
        one_of("hierarchy_level", K.HIERARCHY), *metadata_constraints(),
        one_of(f"{trust}.input_trust", K.TRUST_LEVELS), one_of(f"{trust}.output_trust", K.TRUST_LEVELS),
        Constraint("contract.error_conditions", "required", F.size(bad_error) > 0,
                   F.lit("an error condition lacks its condition or behavior")),
        Constraint("contract.error_conditions", "enum", F.size(bad_level) > 0,
                   F.concat(F.lit("unknown severities: "), F.array_join(F.transform(bad_level, lambda e: e["severity"]), ", ")))]


def finding_constraints() -> list[Constraint]:
    return [required("file"), required("line"), required("rule_id"), required("severity"),
            one_of("severity", K.FINDING_SEVERITIES), one_of("action", K.FINDING_ACTIONS), *metadata_constraints()]


def dependency_constraints() -> list[Constraint]:
    levels = list(K.CVE_SEVERITY.values())
    bad = F.filter("cves", lambda c: c["id"].isNull() | c["severity"].isNull() | ~c["severity"].isin(*levels))
    return [required("package"), required("ecosystem"), one_of("urgency", K.URGENCIES),
            one_of("eol.confidence", K.CONFIDENCE), *metadata_constraints(),
            Constraint("cves", "enum", F.size(bad) > 0, F.lit("a vulnerability lacks its id or a known severity"))]


def usage_path_constraints() -> list[Constraint]:
    return [required("id"), required("name"), required("nodes"), one_of("path_type", K.PATH_TYPES), *metadata_constraints()]


# The keys each object of a spec document may have.
ALLOWED_KEYS = {
    "": ("meta", "cpg_ref", "ecosystem_dependencies", "security_findings", "elements", "usage_paths"),
    "meta": ("project_name", "spec_version", "source_language", "source_version", "created_at", "updated_at", "tools"),
    "element": ("hierarchy_level", "node_ref", "name", "parent", "file", "line", "contract", "data_model", "notes", "metadata"),
    "contract": K.CONTRACT_FIELDS,
    "metadata": ("confidence", "source", "status", "assigned_to", "updated_at", "updated_by", "notes"),
}


def spec_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """All violations of the given spec tables."""
    checks = {
        "meta": (meta_constraints, F.lit("meta")),
        "graph_ref": (graph_ref_constraints, F.lit("cpg_ref")),
        "elements": (element_constraints, F.concat(F.lit("elements."), F.col("element_id"))),
        "findings": (finding_constraints, F.concat(F.lit("security_findings."), F.col("seq").cast("string"))),
        "dependencies": (dependency_constraints, F.concat(F.lit("ecosystem_dependencies."), F.col("package"))),
        "usage_paths": (usage_path_constraints, F.concat(F.lit("usage_paths."), F.col("id"))),
    }
    out = None
    for name, (make, path) in checks.items():
        if name in tables:
            part = violations(tables[name], make(), path)
            out = part if out is None else out.unionByName(part)
    return out


def document_violations(docs: DataFrame) -> DataFrame:
    """Checks that need the raw documents: top-level, element, contract and provenance
    keys, and integer lines."""
    def part(df: DataFrame, column: str, kind: str, path: Column) -> DataFrame:
        return violations(df, [known_keys(column, ALLOWED_KEYS[kind], "")], path)

    root = docs.select(P, "doc", F.get_json_object("doc", "$.meta").alias("meta"))
    bodies = docs.select(P, F.explode(F.from_json(
        F.get_json_object("doc", "$.elements"), "map<string,string>")).alias("element_id", "body")).select(
        P, F.concat(F.lit("elements."), F.col("element_id")).alias("at"), "body",
        F.get_json_object("body", "$.contract").alias("contract"),
        F.get_json_object("body", "$.metadata").alias("metadata"),
        F.get_json_object("body", "$.line").alias("line"))
    top = violations(root, [required_key("doc", k) for k in ("meta", "cpg_ref", "elements")])
    return (
        top.unionByName(part(root, "doc", "", F.lit(""))).unionByName(part(root, "meta", "meta", F.lit("meta")))
        .unionByName(part(bodies, "body", "element", F.col("at")))
        .unionByName(part(bodies, "contract", "contract", F.concat("at", F.lit(".contract"))))
        .unionByName(part(bodies, "metadata", "metadata", F.concat("at", F.lit(".metadata"))))
        .unionByName(violations(bodies, [of_type("line", "int")], F.col("at"))))


def required_key(column: str, key: str) -> Constraint:
    return Constraint("", "required", F.get_json_object(column, "$." + key).isNull(),
                      F.lit(f"'{key}' is a required property"))
