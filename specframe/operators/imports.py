"""Import replacement: match imports with migration rules, classify, route symbols.

``imports``: ``(project_id, file, line, module, names, is_from, …)``; a row is one
import statement, named by ``import_id`` when the caller supplies one, else by
project, file, line and module.  ``rules`` and ``transforms`` hold one migration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import names as N
from ..functions import text as X
from ..runtime import broadcast_if_small
from .graph import P


def match_imports(imports: DataFrame, rules: DataFrame, strategy: str = "exact",
                  boundary: str = "literal", deny: tuple[str, ...] = ()) -> DataFrame:
    """Every matching import with its rule key and the matched length.

    ``exact``: the module, else its longest dotted parent that is a key.
    ``prefix``: the longest key the module starts with; ``boundary='segment'`` lets a
    key end only at a dot, and modules below a ``deny`` entry never match.

    Modules repeat a lot, so candidates are made per distinct module: its dotted
    parents, or its beginnings of every length.  The candidate join is an equality join on
    text, never a nested loop."""
    keys = rules.select(F.col("rule_key")).distinct()
    modules = imports.select("module").filter("module IS NOT NULL").distinct()
    if strategy == "exact":
        parts = F.split("module", "[.]")
        cuts = modules.select("module", F.explode(F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, 1, n), "."))).alias("rule_key"))
    elif strategy == "prefix":
        whole = F.length("module")
        cuts = modules.select("module", F.explode(F.when(whole > 0, F.sequence(F.lit(1), whole))).alias("n")).select(
            "module", F.expr("left(module, n)").alias("rule_key"))
        if boundary == "segment":
            rest = F.expr("substring(module, length(rule_key) + 1, 1)")
            cuts = cuts.filter(rest.isin("", "."))
    else:
        raise ValueError(f"unknown match strategy {strategy!r}")
    for prefix in deny:
        cuts = cuts.filter(~((F.col("module") == prefix) | F.startswith("module", F.lit(prefix + "."))))
    best = cuts.join(broadcast_if_small(keys), "rule_key").groupBy("module").agg(
        F.max(F.struct(F.length("rule_key").alias("matched_length"), "rule_key")).alias("m")
    ).select("module", "m.rule_key", "m.matched_length")
    return imports.join(best, "module")


def is_advisory(action: Column, removed_in: Column, target_version: Column | str) -> Column:
    """Removed only in a version above the target: still works there."""
    target = F.lit(target_version) if isinstance(target_version, str) else target_version
    return F.coalesce((action == "removed") & N.version_before(target, removed_in),
                      F.lit(False))


def classify(matches: DataFrame, rules: DataFrame, target_version: Column | str) -> DataFrame:
    """Matches with their rule's action, target, notes, replacements and advisory flag."""
    rule = rules.select("rule_key", "action", "target_module", "removed_in", "description", "notes",
                        "install", "replacements")
    return matches.join(broadcast_if_small(rule), "rule_key").withColumn(
        "advisory", is_advisory(F.col("action"), F.col("removed_in"), target_version)
    ).withColumn("notes", F.coalesce("notes", "description"))


def route_symbols(classified: DataFrame, transforms: DataFrame) -> DataFrame:
    """New paths per imported name: one row per alternative, in rule order.

    A transform is keyed by ``module.name`` or by a bare module, which serves
    statements that name nothing and names without an entry of their own.  A renamed
    module without an entry keeps the name below its target.  Several alternatives,
    or none, need review."""
    named = classified.select("*", F.explode_outer("names").alias("name")).withColumn(
        "symbol", F.concat_ws(".", "module", "name"))
    t = transforms.select(
        "rule_key", F.col("from_import").alias("symbol"), "ord", "to_import", "condition",
        F.col("library").alias("via"), F.col("notes").alias("route_notes"))
    t = broadcast_if_small(t)
    bare = t.select("rule_key", F.col("symbol").alias("module"), F.col("to_import").alias("module_to"),
                    F.col("ord").alias("module_ord"))
    routed = named.join(t, ["rule_key", "symbol"], "left").join(bare, ["rule_key", "module"], "left")
    below = lambda head: F.concat_ws(".", head, F.col("name"))
    new_path = F.coalesce(
        F.col("to_import"),
        F.when(F.col("module_to").isNotNull(), below(F.col("module_to"))),
        F.when(F.col("action") == "rename", below(F.col("target_module"))))
    return routed.select(
        *[c for c in classified.columns], "name", F.coalesce("ord", "module_ord").alias("ord"),
        new_path.alias("new_path"), "condition", "via",
        ((F.col("action") == "choice") | new_path.isNull()).alias("needs_review"))


def route_choices(routed: DataFrame) -> DataFrame:
    """Imports whose replacement depends on usage, all alternatives kept in order."""
    key = [P, "file", "line", "module", "name"]
    alternative = F.struct("ord", "new_path", "condition")
    return routed.filter(F.col("action") == "choice").groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_set(alternative)), lambda a: F.struct(
            a["new_path"].alias("new_path"), a["condition"].alias("condition"))).alias("alternatives"))


def replacement_findings(classified: DataFrame) -> DataFrame:
    return classified.select(P, "file", "line", "module", "names", "action", "target_module", "notes", "advisory")


def replacement_summary(imports: DataFrame, classified: DataFrame) -> DataFrame:
    """``(project_id, item, n)``: imports and files scanned, matches, matches by action."""
    base = imports.groupBy(P).agg(
        F.count(F.lit(1)).alias("total_imports_scanned"), F.count_distinct("file").alias("total_files_scanned"))
    rows = base.select(P, F.explode(F.array(*[
        F.struct(F.lit(c).alias("item"), F.col(c).alias("n"))
        for c in ("total_imports_scanned", "total_files_scanned")])).alias("x")).select(P, "x.*")
    acts = classified.rollup(P, "action").count().filter(f"{P} IS NOT NULL").select(
        P, F.coalesce(F.concat(F.lit("by_action."), F.col("action")), F.lit("matches")).alias("item"),
        F.col("count").alias("n"))
    return rows.unionByName(acts)


def unmatched_imports(imports: DataFrame, matches: DataFrame) -> DataFrame:
    """Imports no rule speaks about; decided per distinct module."""
    return imports.join(matches.select("module").distinct(), "module", "left_anti")


def manual_review(imports: DataFrame, classified: DataFrame) -> DataFrame:
    """``(project_id, file, line, module, reason)``: choices and unmatched imports."""
    cols = [P, "file", "line", "module"]
    return classified.filter("action = 'choice'").select(*cols, F.lit("choice").alias("reason")).unionByName(
        unmatched_imports(imports, classified).select(*cols, F.lit("unmatched").alias("reason")))


def new_dependencies(classified: DataFrame) -> DataFrame:
    """Distinct libraries and install hints that the matched rules ask for."""
    per_rule = classified.select(P, "rule_key", "install", "replacements").dropDuplicates([P, "rule_key"])
    hints = per_rule.select(P, F.lit(None).cast("string").alias("library"), "install").unionByName(
        per_rule.select(P, F.explode("replacements").alias("r")).select(P, "r.library", "r.install"))
    return hints.filter(F.col("install").isNotNull() & (F.col("install") != K.NO_INSTALL)).distinct()


def replacement_report(classified: DataFrame) -> DataFrame:
    """Report lines, grouped by action: ``(project_id, action_rank, file, line, module, text)``;
    each group's heading has a null file."""
    rank = X.rank_of(K.RULE_ACTIONS, F.col("action"))
    body = classified.select(
        P, rank.alias("action_rank"), "file", F.col("line").cast("bigint").alias("line"), "module",
        F.concat(F.lit("- `"), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit("` "),
                 F.col("module"),
                 F.coalesce(F.concat(F.lit(" -> "), F.col("target_module")), F.lit("")),
                 F.when(F.col("advisory"), F.lit(" (advisory)")).otherwise(F.lit("")),
                 F.coalesce(F.concat(F.lit(": "), F.col("notes")), F.lit(""))).alias("text"))
    head = classified.groupBy(P, "action").count().select(
        P, rank.alias("action_rank"), F.lit(None).cast("string").alias("file"),
        F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("string").alias("module"),
        F.concat(F.lit("## "), F.initcap("action"), F.lit(" ("), F.col("count").cast("string"), F.lit(")"))
        .alias("text"))
    return head.unionByName(body)


def replacement_tables(imports: DataFrame, classified: DataFrame, head: dict, codebase_path: Column | None = None) -> dict[str, DataFrame]:
    """The structured report as tables for ``write_specs``: ``metadata`` and ``summary`` with
    one row per project that has imports, ``findings`` in the order of files and lines.
    ``head`` is the migration's header."""
    side = lambda name: F.struct(
        F.lit(head[f"{name}_language"]).cast("string").alias("language"), F.lit(head[f"{name}_version"]).cast("string").alias("version")).alias(name)
    path = F.lit(None).cast("string") if codebase_path is None else codebase_path
    scanned = imports.groupBy(P).agg(
        F.count(F.lit(1)).alias("total_imports_scanned"), F.count_distinct("file").alias("total_files_scanned"))
    acts = classified.groupBy(P, "action").agg(F.count(F.lit(1)).alias("n")).groupBy(P).agg(
        F.sum("n").alias("matches"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("action", "n")))).alias("by_action"))
    return {
        "metadata": scanned.select(P, F.lit(head["mapping_id"]).alias("migration_pair"), side("source"), side("target"),
                                   path.alias("codebase_path"), "total_files_scanned"),
        "findings": replacement_findings(classified).withColumn(
            "seq", F.concat_ws(":", "file", F.lpad(F.col("line").cast("string"), 10, "0"), "module")),
        "summary": scanned.join(acts, P, "left").select(
            P, "total_imports_scanned", F.coalesce("matches", F.lit(0)).cast("bigint").alias("matches"),
            F.coalesce("by_action", F.create_map().cast("map<string,bigint>")).alias("by_action"))}


def replacement_checks(imports: DataFrame, classified: DataFrame, routed: DataFrame) -> DataFrame:
    """Acceptance checks, ``(project_id, check, failures)``: no action without a
    recommendation, no choice without an alternative, and matched plus unmatched imports
    equal the imports scanned.  ``routed`` comes from ``route_symbols``."""
    advice = F.col("target_module").isNotNull() | (F.size("replacements") > 0)
    got = classified.groupBy(P).agg(
        F.count(F.lit(1)).alias("matched"),
        F.count_if(F.col("action").isin("rename", "removed") & ~F.coalesce(advice, F.lit(False))).alias("without_advice"),
        F.count_if(~F.col("action").isin(*K.RULE_ACTIONS)).alias("unknown_action"))
    choices = routed.filter("action = 'choice'").groupBy(P, "file", "line", "module", "name").agg(F.count("new_path").alias("n"))
    bare = choices.filter("n = 0").groupBy(P).agg(F.count(F.lit(1)).alias("bare"))
    total = imports.groupBy(P).agg(F.count(F.lit(1)).alias("total"))
    left = unmatched_imports(imports, classified).groupBy(P).agg(F.count(F.lit(1)).alias("unmatched"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    wide = total.join(got, P, "left").join(left, P, "left").join(bare, P, "left").select(
        P, F.abs(zero("total") - zero("matched") - zero("unmatched")).alias("imports_not_accounted_for"),
        zero("without_advice").alias("without_recommendation"), zero("unknown_action").alias("unknown_action"),
        zero("bare").alias("choices_without_alternatives"))
    names = [c for c in wide.columns if c != P]
    return wide.select(P, F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("failures")) for c in names])).alias("x")
    ).select(P, "x.*")
