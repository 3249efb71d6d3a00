"""Spark types of the tables (every table also carries ``project_id``)."""

from pyspark.sql import types as T

METADATA = "confidence STRING, source STRING, status STRING, assigned_to STRING, " \
           "updated_at STRING, updated_by STRING, notes STRING"
ERROR_CONDITION = "condition STRING, behavior STRING, severity STRING"
TRANSITION = "from_state STRING, to_state STRING, trigger STRING"
TRUST = "input_trust STRING, output_trust STRING, sanitization STRING"
CONTRACT = (
    "purpose STRING, preconditions ARRAY<STRING>, postconditions ARRAY<STRING>, "
    "invariants ARRAY<STRING>, side_effects ARRAY<STRING>, "
    f"error_conditions ARRAY<STRUCT<{ERROR_CONDITION}>>, "
    f"state_transitions ARRAY<STRUCT<{TRANSITION}>>, "
    f"trust_boundary STRUCT<{TRUST}>, thread_safety STRING, performance STRING"
)
DATA_MODEL = (
    "entities ARRAY<STRUCT<name STRING, description STRING, "
    "fields ARRAY<STRUCT<name STRING, type STRING, constraints STRING>>>>, "
    "relationships ARRAY<STRUCT<from_entity STRING, to_entity STRING, "
    "cardinality STRING, description STRING>>, lifecycle STRING"
)
COMPLIANCE = (
    "owasp_asvs ARRAY<STRUCT<id STRING, title STRING, level STRING>>, "
    "nist_800_53 ARRAY<STRING>, "
    "asd_stig ARRAY<STRUCT<id STRING, cat STRING, title STRING>>, "
    "pci_dss ARRAY<STRING>"
)
CVE = "id STRING, severity STRING, summary STRING, affects_versions STRING"
EOL = "is_eol BOOLEAN, eol_date STRING, confidence STRING"

# Input feeds: what the JSON documents hold, before normalization.
GRAPH_NODE = (
    "id STRING, kind STRING, name STRING, scope STRING, file STRING, line INT, "
    "column INT, location STRUCT<file STRING, line INT, column INT>, "
    "end_location STRUCT<line INT>, attrs MAP<STRING,STRING>"
)
GRAPH_EDGE = "source STRING, target STRING, src STRING, dst STRING, kind STRING"
GRAPH_DOC = f"nodes ARRAY<STRUCT<{GRAPH_NODE}>>, edges ARRAY<STRUCT<{GRAPH_EDGE}>>"

RAW_FINDING = (
    "file STRING, line BIGINT, rule_id STRING, severity STRING, derived_severity STRING, "
    "column INT, message STRING, cwe_id INT, cwe_name STRING, remediation STRING, "
    f"action STRING, location STRING, compliance STRUCT<{COMPLIANCE}>"
)
FINDINGS_DOC = f"findings ARRAY<STRUCT<{RAW_FINDING}>>"

RAW_CVE = "id STRING, cve_id STRING, severity STRING, summary STRING, description STRING"
AUDIT_DOC = (
    "package STRING, ecosystem STRING, version STRING, "
    "summary STRUCT<latest_version STRING, recommendation STRING, upgrade_path STRING, "
    "urgency STRING>, "
    f"cves STRUCT<versions_cves ARRAY<STRUCT<{RAW_CVE}>>, latest_cves ARRAY<STRUCT<{RAW_CVE}>>>, "
    "eol STRUCT<eol BOOLEAN, eol_date STRING, confidence STRING>"
)
CONTEXT_DOC = "results ARRAY<STRUCT<relationship STRING, text STRING>>"

# Spec documents.
ELEMENT_BODY = (
    "hierarchy_level STRING, node_ref STRING, name STRING, parent STRING, file STRING, "
    f"line INT, contract STRUCT<{CONTRACT}>, data_model STRUCT<{DATA_MODEL}>, "
    f"notes STRING, metadata STRUCT<{METADATA}>"
)
FINDING = (
    "node_ref STRING, file STRING, line BIGINT, column INT, rule_id STRING, message STRING, "
    f"severity STRING, cwe_id INT, cwe_name STRING, compliance STRUCT<{COMPLIANCE}>, "
    f"remediation STRING, action STRING, metadata STRUCT<{METADATA}>"
)
DEPENDENCY = (
    "package STRING, ecosystem STRING, version_in_use STRING, latest_version STRING, "
    f"cves ARRAY<STRUCT<{CVE}>>, eol STRUCT<{EOL}>, recommendation STRING, urgency STRING, "
    f"metadata STRUCT<{METADATA}>"
)
USAGE_PATH = (
    "id STRING, name STRING, description STRING, path_type STRING, nodes ARRAY<STRING>, "
    f"metadata STRUCT<{METADATA}>"
)
SPEC_META = (
    "project_name STRING, spec_version STRING, source_language STRING, source_version STRING, "
    "created_at STRING, updated_at STRING, tools MAP<STRING,STRING>"
)
GRAPH_REF = (
    "path STRING, sha256 STRING, built_at STRING, builder_version STRING, "
    "stats STRUCT<nodes BIGINT, edges BIGINT, files BIGINT, functions BIGINT, "
    "call_resolution_pct DOUBLE>"
)

RULES = (
    "mapping_id STRING, rule_key STRING, action STRING, target_module STRING, "
    "removed_in STRING, description STRING, notes STRING, install STRING, "
    "replacements ARRAY<STRUCT<library STRING, install STRING, notes STRING>>"
)
RULE_TRANSFORMS = (
    "mapping_id STRING, rule_key STRING, ord INT, library STRING, from_import STRING, "
    "to_import STRING, condition STRING, notes STRING"
)


def struct(ddl: str) -> T.StructType:
    """Parse a column list such as the constants above into a ``StructType``."""
    return T.StructType.fromDDL(ddl)
