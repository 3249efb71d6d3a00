"""Rule tables for import replacement.

A rule file describes one migration.  It is a configuration file of a few dozen
entries, so it is parsed on the driver; the operators still check the size of the
resulting tables before they broadcast them.
"""

from __future__ import annotations

import json
from importlib import resources
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .. import schemas as S


def _load(source: str) -> dict:
    """A packaged migration id, or the path of a YAML or JSON rule file."""
    path = Path(source)
    if path.suffix not in (".yaml", ".yml", ".json"):
        path = Path(str(resources.files(__package__))) / "rules" / f"{source}.yaml"
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as exc:
        raise RuntimeError("YAML rule files need PyYAML; JSON files work without it") from exc
    return yaml.safe_load(text)


def migration(source: str) -> dict:
    """Header of a rule file: ids, languages, versions and the match strategy."""
    doc = _load(source)
    head = doc["migration"]
    return {
        "mapping_id": head["id"],
        "source_language": head["source"].get("language"),
        "source_version": str(head["source"]["version"]),
        "target_language": head["target"].get("language"),
        "target_version": str(head["target"]["version"]),
        "match_strategy": doc["match_strategy"],
        "description": head.get("description"),
    }


def _transforms(value, library=None):
    """Symbol transforms are a mapping or a list of records, told apart by type."""
    if isinstance(value, dict):
        value = [{"from_import": k, "to_import": v} for k, v in value.items()]
    return [(library, t["from_import"], t["to_import"], t.get("condition"), t.get("notes"))
            for t in value or []]


def load_rules(spark: SparkSession, sources) -> tuple[DataFrame, DataFrame]:
    """``rules`` and ``rule_transforms`` of the given migrations."""
    sources = [sources] if isinstance(sources, str) else sources
    rules, transforms = [], []
    for source in sources:
        doc = _load(source)
        mapping_id = doc["migration"]["id"]
        for key, r in doc["mappings"].items():
            replacements = r.get("replacements") or []
            rules.append((
                mapping_id, key, r["action"], r.get("target_module"),
                str(r["removed_in"]) if "removed_in" in r else None, r.get("description"),
                r.get("notes"), r.get("install"),
                [(x.get("library"), x.get("install"), x.get("notes")) for x in replacements],
            ))
            found = _transforms(r.get("import_transforms"))
            for x in replacements:
                found += _transforms(x.get("import_transforms"), x.get("library"))
            transforms += [(mapping_id, key, i, *t) for i, t in enumerate(found)]
    return (spark.createDataFrame(rules, S.struct(S.RULES)),
            spark.createDataFrame(transforms, S.struct(S.RULE_TRANSFORMS)))
