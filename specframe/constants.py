"""Fixed values of the data contract.

Everything here is data that decides results: word lists, enumerations,
lookup tables, patterns and text fragments.  No logic lives in this module.
"""

# -- fixed values: keyword extraction -------------------------------------
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "must", "that", "this", "it", "its", "not", "no", "if", "then", "each", "any", "all",
    "also", "than", "into", "via", "per", "whether", "only", "when",
)
KEYWORD_PATTERN = "[a-z]{3,}"  # maximal runs of letters longer than two

# -- fixed values: element identity ---------------------------------------
RELEVANT_KINDS = ("module", "class", "function")
KIND_RANK = {"module": 0, "class": 1, "function": 2}
SPEC_VERSION = "0.1.0"

# -- fixed values: provenance ---------------------------------------------
CONFIDENCE = ("high", "medium", "low")
SOURCES = ("static_analysis", "llm_inference", "human_input", "test_evidence")
STATUSES = ("extracted", "needs_review", "confirmed", "disputed")
ASSIGNEES = ("agent", "human", "domain_expert")
SCANNED = {"confidence": "high", "source": "static_analysis", "status": "extracted"}
INFERRED = {"confidence": "medium", "source": "llm_inference", "status": "needs_review"}
UPDATED_BY_PREFIX = "extract-contracts/"

# -- fixed values: findings -----------------------------------------------
FINDING_SEVERITIES = ("critical", "high", "medium", "low", "info")
FINDING_ACTIONS = ("fix", "review", "accept", "defer")
COMPLIANCE_FRAMEWORKS = ("owasp_asvs", "nist_800_53", "asd_stig", "pci_dss")
FINDINGS_HEADER = "Relevant security findings:"

# -- fixed values: dependencies -------------------------------------------
URGENCY = {
    "immediate": "immediate",
    "critical": "immediate",
    "high": "high",
    "medium": "medium",
    "low": "low",
    "none": "none",
}
URGENCIES = ("immediate", "high", "medium", "low", "none")
CVE_SEVERITY = {"critical": "CRITICAL", "high": "HIGH", "medium": "MEDIUM", "low": "LOW"}
CVE_SEVERITY_DEFAULT = "MEDIUM"
MAX_RECOMMENDATION = 500
CVE_HEADER = "Known CVEs for this codebase:"

# -- fixed values: contracts ----------------------------------------------
CONTRACT_FIELDS = (
    "purpose", "preconditions", "postconditions", "invariants", "side_effects",
    "error_conditions", "state_transitions", "trust_boundary", "thread_safety",
    "performance",
)
TEXT_ARRAY_FIELDS = ("preconditions", "postconditions", "invariants", "side_effects")
COVERAGE_FIELDS = TEXT_ARRAY_FIELDS + ("error_conditions",)
TRUST_KEYS = ("input_trust", "output_trust", "sanitization")
TRUST_LEVELS = ("trusted", "untrusted", "mixed", "n/a")
TRUST_DEFAULT = "mixed"
ERROR_SEVERITIES = ("fatal", "recoverable", "advisory")
EXCERPT_PURPOSE = 200
EXCERPT_ITEM = 120
SANITIZATION_MATCH_PCT = 40

# -- fixed values: spec documents -----------------------------------------
HIERARCHY = ("system", "subsystem", "module", "class", "function")
PATH_TYPES = ("call_chain", "request_flow", "event_propagation", "data_flow")

# What a spec document may hold: the keys of every closed object with the form of each
# value.  "[x]" is an array of x, "{x}" an object with free keys and values x; a name is
# another object of this table, a list of values below, or a plain form.
SPEC_OBJECTS = {
    "spec": {"meta": "meta", "cpg_ref": "graph_ref", "ecosystem_dependencies": "[dependency]",
             "security_findings": "[finding]", "elements": "{element}", "usage_paths": "[usage_path]"},
    "meta": {"project_name": "string", "spec_version": "spec_version", "source_language": "string", "source_version": "string",
             "created_at": "string", "updated_at": "string", "tools": "{string}"},
    "graph_ref": {"path": "string", "sha256": "string", "built_at": "string", "stats": "graph_stats"},
    "graph_stats": {"nodes": "integer", "edges": "integer", "files": "integer", "functions": "integer",
                    "call_resolution_pct": "percentage"},
    "metadata": {"confidence": "confidence", "source": "source", "status": "status", "assigned_to": "assignee",
                 "updated_at": "string", "updated_by": "string", "notes": "string"},
    "dependency": {"package": "string", "ecosystem": "string", "version_in_use": "string", "latest_version": "string",
                   "cves": "[cve]", "eol": "eol", "recommendation": "string", "urgency": "urgency", "metadata": "metadata"},
    "cve": {"id": "string", "severity": "cve_severity", "summary": "string", "affects_versions": "string"},
    "eol": {"is_eol": "boolean or null", "eol_date": "string or null", "confidence": "confidence"},
    "finding": {"node_ref": "string", "file": "string", "line": "integer", "column": "integer", "rule_id": "string",
                "message": "string", "severity": "finding_severity", "cwe_id": "integer", "cwe_name": "string",
                "compliance": "compliance", "remediation": "string", "action": "action", "metadata": "metadata"},
    "compliance": {"owasp_asvs": "[asvs_item]", "nist_800_53": "[string]", "asd_stig": "[stig_item]", "pci_dss": "[string]"},
    "asvs_item": {"id": "string", "title": "string", "level": "string"},
    "stig_item": {"id": "string", "cat": "string", "title": "string"},
    "element": {"hierarchy_level": "hierarchy_level", "node_ref": "string", "name": "string", "parent": "string",
                "file": "string", "line": "integer", "contract": "contract", "data_model": "data_model", "notes": "string",
                "metadata": "metadata"},
    "contract": {"purpose": "string", "preconditions": "[string]", "postconditions": "[string]", "invariants": "[string]",
                 "side_effects": "[string]", "error_conditions": "[error_condition]", "state_transitions": "[transition]",
                 "trust_boundary": "trust_boundary", "thread_safety": "string", "performance": "string"},
    "error_condition": {"condition": "string", "behavior": "string", "severity": "error_severity"},
    "transition": {"from_state": "string", "to_state": "string", "trigger": "string"},
    "trust_boundary": {"input_trust": "trust_level", "output_trust": "trust_level", "sanitization": "string"},
    "data_model": {"entities": "[entity]", "relationships": "[relationship]", "lifecycle": "string"},
    "entity": {"name": "string", "description": "string", "fields": "[entity_field]"},
    "entity_field": {"name": "string", "type": "string", "constraints": "string"},
    "relationship": {"from_entity": "string", "to_entity": "string", "cardinality": "string", "description": "string"},
    "usage_path": {"id": "string", "name": "string", "description": "string", "path_type": "path_type", "nodes": "[string]",
                   "metadata": "metadata"},
}
SPEC_REQUIRED = {
    "spec": ("meta", "cpg_ref", "elements"),
    "meta": ("project_name", "spec_version"),
    "graph_ref": ("path",),
    "metadata": ("confidence", "source", "status"),
    "dependency": ("package", "ecosystem", "metadata"),
    "cve": ("id", "severity"),
    "finding": ("file", "line", "rule_id", "severity", "metadata"),
    "element": ("hierarchy_level", "node_ref", "name", "metadata"),
    "error_condition": ("condition", "behavior"),
    "entity": ("name",),
    "usage_path": ("id", "name", "nodes", "metadata"),
}
SPEC_VALUES = {
    "spec_version": (SPEC_VERSION,), "confidence": CONFIDENCE, "source": SOURCES, "status": STATUSES, "assignee": ASSIGNEES,
    "urgency": URGENCIES, "cve_severity": tuple(CVE_SEVERITY.values()), "finding_severity": FINDING_SEVERITIES,
    "action": FINDING_ACTIONS, "hierarchy_level": HIERARCHY, "error_severity": ERROR_SEVERITIES, "trust_level": TRUST_LEVELS,
    "path_type": PATH_TYPES,
}

# -- fixed values: prompts ------------------------------------------------
NO_SOURCE = "(source not available)"
NO_CONTEXT = "(no additional structural context)"
MAX_GROUP_SIZE = 6
PROMPT_SINGLE_OPENING = "Extract the behavioral contract for the following {level}."
PROMPT_SINGLE_CLOSING = "Respond with a single JSON object containing the contract fields."
PROMPT_CLASS_OPENING = "Extract behavioral contracts for the following class and its methods."
PROMPT_CLASS_CLOSING = (
    "Respond with a JSON object where each key is an element ID and each value is "
    "the contract for that element."
)
PROMPT_FINDINGS_LEAD = "IMPORTANT — "
PROMPT_FINDINGS_RULE = (
    "You MUST incorporate these findings into the contract's error_conditions and "
    "trust_boundary fields."
)
CODE_FENCE = "```"

# -- fixed values: import replacement -------------------------------------
RULE_ACTIONS = ("rename", "removed", "split", "choice")
NO_INSTALL = "N/A"
