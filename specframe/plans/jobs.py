"""Whole jobs: assemble, prepare and ingest extraction, compare, map imports."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import compare as H
from ..operators import deps, findings, graph, imports, selection
from ..operators import prompts as G
from ..operators import responses as A
from ..operators.graph import P
from ..runtime import materialize
from ..sources import documents as D
from ..sources import rules as R
from ..streaming.resumable import existing, resumable_apply


def assemble(spark: SparkSession, projects: DataFrame, graph_paths, now: str, finding_paths=None, audit_paths=None,
             version_key: str = "version", audit_version_key: str = "version_of_tool",
             tool_names: tuple[str, str, str] = ("builder", "scanner", "auditor"), strict: bool = False) -> dict[str, DataFrame]:
    """Graphs, findings and audits of many projects to spec tables.

    ``projects``: ``(project_id, project_name, source_root, language, source_version)``.
    Findings and dependencies are only present when their inputs are given."""
    docs = D.read_documents(spark, graph_paths)
    nodes, edges = (materialize(df, label) for df, label in zip(D.parse_graph(docs), ("nodes", "edges")))
    versions = docs.select(P, F.get_json_object("doc", "$." + version_key).alias("version"))
    tools = versions.select(P, F.lit(tool_names[0]).alias("tool"), "version")
    tables = {"elements": materialize(graph.build_elements(nodes, projects.select(P, "source_root", "language"), strict=strict), "elements")}
    if finding_paths is not None:
        raw, version = D.read_findings(spark, finding_paths, version_key)
        tables["findings"] = findings.map_findings(raw, nodes)
        tools = tools.unionByName(version.select(P, F.lit(tool_names[1]).alias("tool"), "version"))
    if audit_paths is not None:
        audits = D.read_audits(spark, audit_paths, audit_version_key)
        tables["dependencies"] = deps.map_audits(audits)
        tools = tools.unionByName(D.first_version(audits).select(P, F.lit(tool_names[2]).alias("tool"), "version"))
    stats = graph.graph_stats(nodes, edges)
    tables["graph_ref"] = docs.select(
        P, N.basename(F.col("path")).alias("path"), D.checksum(F.col("doc")).alias("sha256"), F.lit(now).alias("built_at"),
        F.coalesce(F.get_json_object("doc", "$." + version_key), F.lit("unknown")).alias("builder_version")
    ).join(stats, P, "left").select(P, "path", "sha256", "built_at", "builder_version", F.struct(
        "nodes", "edges", "files", "functions", F.lit(None).cast("double").alias("call_resolution_pct")).alias("stats"))
    tables["meta"] = graph.spec_meta(projects, tools, now)
    return tables


def plan_extraction(elements: DataFrame, scope: str | None = None, max_group_size: int = selection.K.MAX_GROUP_SIZE,
                    skip_existing: bool = False, keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Units of work in scope, with the columns ``keep`` of their elements, and the counts a dry run shows."""
    scoped = materialize(selection.filter_scope(elements, scope), "scope") if scope else elements
    every = selection.group_elements(scoped, max_group_size, keep=keep)
    groups = selection.group_elements(scoped, max_group_size, skip_existing, keep) if skip_existing else every
    return groups, selection.extraction_plan(every, groups)


def build_prompts(groups: DataFrame, tables: dict[str, DataFrame], contexts: DataFrame) -> DataFrame:
    """The prompt table of planned units."""
    return G.prompts(groups, tables["elements"], contexts, tables["findings"], tables["dependencies"])


def extract(tables: dict[str, DataFrame], contexts: DataFrame, fn: Callable[[str], str], path: str, model: str, now: str,
            scope: str | None = None, skip_existing: bool = False, batches: int = 1, retries: int = 2,
            wait_seconds: float = 5.0) -> dict[str, DataFrame]:
    """Plan, ask ``fn`` for each unit, parse, and merge; safe to stop and run again.

    ``path`` holds every contract that was found, and below ``-failed`` the messages of elements
    without one, of every run.  A unit of which elements are missing is asked again by the
    next run; contracts found before stay as they are.  Returns the merged ``elements``, the
    ``plan``, and ``outcomes`` and ``errors`` of this and earlier runs: an element counts
    once, and one that is still missing has its last run's message."""
    groups, plan = plan_extraction(tables["elements"], scope, skip_existing=skip_existing, keep=G.UNIT_FIELDS)
    spark = groups.sparkSession
    element = [P, "group_id", "element_id"]
    earlier = existing(spark, f"{path}-failed")
    first_run = earlier is None and existing(spark, path) is None
    run = 1 if earlier is None else 1 + (earlier.agg(F.max("run").alias("run")).first()["run"] or 0)

    def answer(todo: DataFrame) -> DataFrame:
        # pending units are written without their texts, which are made as they are asked
        prompts = G.fill_prompts(todo, contexts, tables["findings"], tables["dependencies"])
        parsed = materialize(A.parse_responses(G.batch_infer(prompts, fn, retries, wait_seconds)).withColumn("run", F.lit(run)), "parsed")
        parsed.filter("NOT found").write.mode("append").option("compression", "zstd").parquet(f"{path}-failed")
        return parsed.filter("found")

    def still_open(units: DataFrame, found: DataFrame) -> DataFrame:
        """Units that lack an element; what was found is a list no longer than the unit's."""
        have = found.groupBy("group_id", P).agg(F.collect_set("element_id").alias("have"))
        lacking = F.array_except("all_ids", F.coalesce("have", F.array().cast("array<string>")))
        return units.join(have, ["group_id", P], "left").filter(F.size(lacking) > 0).drop("have")

    def once(rows: DataFrame, which: Callable[..., Column]) -> DataFrame:
        """Of each element the row of one run; rows of one run are the same."""
        rest = [c for c in rows.columns if c not in element]
        return rows.groupBy(*element).agg(which(F.struct(*rest), "run").alias("r")).select(*element, *[f"r.{c}" for c in rest])

    found = resumable_apply(G.prompt_units(groups, tables["elements"]), answer, path, [P, "group_id"], batches, still_open)
    failed = spark.read.parquet(f"{path}-failed")
    if not first_run:  # which asked every unit once
        found = materialize(once(found, F.min_by), "found")
        failed = once(failed, F.max_by).join(found.select(*element), element, "left_anti")
    totals, errors = A.run_outcomes(found.unionByName(failed))
    return {"elements": A.merge_contracts(tables["elements"], found, model, now), "plan": plan, "outcomes": totals, "errors": errors}


def compare(extracted: DataFrame, reference: DataFrame, id_map: DataFrame | None = None) -> dict[str, DataFrame]:
    """Comparisons, their summary, and the elements without a reference."""
    if id_map is None:
        mapped = extracted.withColumn("reference_id", F.col("element_id"))
    else:
        mapped = H.map_ids(extracted, id_map)
    pairs, skipped = H.pair_contracts(mapped, reference)
    compared = materialize(H.compare_elements(pairs), "comparisons")
    return {"comparisons": compared, "summary": H.summary(compared), "skipped": skipped}


def map_imports(spark: SparkSession, statements: DataFrame, migration: str, target_version: str | None = None) -> dict[str, DataFrame]:
    """All replacement tables of one migration; ``metadata`` is the block that heads the
    structured report (``imports.replacement_tables``)."""
    head = R.migration(migration)
    rules, transforms = R.load_rules(spark, migration)
    found = materialize(imports.classify(
        imports.match_imports(statements, rules, head["match_strategy"]), rules, target_version or head["target_version"]), "replacements")
    routed = imports.route_symbols(found, transforms)
    return {
        "metadata": imports.replacement_tables(statements, found, {**head, "target_version": target_version or head["target_version"]})["metadata"],
        "findings": imports.replacement_findings(found), "symbols": routed, "choices": imports.route_choices(routed),
        "summary": imports.replacement_summary(statements, found), "manual_review": imports.manual_review(statements, found),
        "new_dependencies": imports.new_dependencies(found), "report": imports.replacement_report(found),
        "checks": imports.replacement_checks(statements, found, routed)}
