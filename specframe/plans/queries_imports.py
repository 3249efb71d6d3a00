"""Import replacement on the test tables: a page is an import of its reversed host."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import imports as E
from ..runtime import shared_folder
from ..sources import rules as R
from ..sources.sinks import read_spec_tables, write_specs
from .registry import Tables, query

c = F.col

# (key, action, target, removed in, notes, install, replacements)
RULES = [
    ("com.example", "rename", "com.sample", None, "base", None, []),
    ("com.example.th", "removed", None, "3.12", "short", None, [("lib-th", "get lib-th", None), ("std", "N/A", None)]),
    ("com.example.therou", "rename", "com.sample.therou", None, None, "get therou", []),
    ("net.example", "choice", None, None, "either", None, []),
    ("net.example.m", "removed", None, "4", None, None, [("lib-m", "get lib-m", None)]),
    ("org.example", "split", None, None, "parts", None, []),
    ("org.example.thonth", "removed", None, "4", None, None, []),  # no advice
]
# (key, position, from, to, condition)
TRANSFORMS = [
    ("com.example", 0, "com.example.therin.en", "com.sample.english", None),
    ("net.example", 0, "net.example.tiontion.en", "net.a.en", "if bytes"),
    ("net.example", 1, "net.example.tiontion.en", "net.b.en", "if text"),
    ("net.example", 2, "net.example.thhin", "net.c", None),
    ("org.example", 0, "org.example.thther.en", "org.x.en", None),
]


def rules(t: Tables) -> tuple[DataFrame, DataFrame]:
    r = [("web", k, a, tm, rem, None, n, i, reps) for k, a, tm, rem, n, i, reps in RULES]
    x = [("web", k, o, None, f, to, cond, None) for k, o, f, to, cond in TRANSFORMS]
    return t.spark.createDataFrame(r, S.struct(S.RULES)), t.spark.createDataFrame(x, S.struct(S.RULE_TRANSFORMS))


def imports(t: Tables) -> DataFrame:
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    return t.pages.select(
        F.when(F.startswith("url", F.lit("https")), F.lit("secure")).otherwise(F.lit("plain")).alias("project_id"),
        F.concat(F.regexp_extract("url", "^https?://[^/]+/([^/]*)", 1), F.lit(".py")).alias("file"), c("page_id").cast("int").alias("line"),
        F.array_join(F.reverse(F.split(host, "[.]")), ".").alias("module"),
        F.when(F.contains("url", F.lit("#")), F.array().cast("array<string>")).otherwise(
            F.array(F.regexp_extract("url", "^https?://[^/]+/([^/]*)", 1), F.lit("all"))).alias("names"))


_VALUES = ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" for v in (k, a, tm, rem, n, i)) + f", [{', '.join(repr(x[1]) for x in reps)}]::VARCHAR[], "
    f"[{', '.join(repr(x[0]) for x in reps)}]::VARCHAR[])" for k, a, tm, rem, n, i, reps in RULES)
_TVALUES = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in x) + ")" for x in TRANSFORMS)
_IMPORTS = f"""
imp AS (SELECT CASE WHEN starts_with(url, 'https') THEN 'secure' ELSE 'plain' END AS project_id, regexp_extract(url, '^https?://[^/]+/([^/]*)', 1) || '.py' AS file,
  CAST(page_id AS INT) AS line, array_to_string(list_reverse(string_split(regexp_extract(url, '^https?://([^/]+)', 1), '.')), '.') AS module,
  CASE WHEN contains(url, '#') THEN []::VARCHAR[] ELSE [regexp_extract(url, '^https?://[^/]+/([^/]*)', 1), 'all'] END AS names FROM pages),
rules AS (SELECT * FROM (VALUES {_VALUES}) r(rule_key, action, target_module, removed_in, notes, install, installs, libs)),
tr AS (SELECT * FROM (VALUES {_TVALUES}) r(rule_key, ord, from_import, to_import, condition))"""


def _matched(condition: str, name: str = "m") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT imp.*, r.*, row_number() OVER (PARTITION BY line ORDER BY length(rule_key) DESC) AS rn
  FROM imp JOIN rules r ON {condition}) WHERE rn = 1)"""


_EXACT = "module = rule_key OR starts_with(module, rule_key || '.')"
_PREFIX = "starts_with(module, rule_key)"
_SEGMENT = "(module = rule_key OR starts_with(module, rule_key || '.')) AND NOT (module = 'com.example.therou' OR starts_with(module, 'com.example.therou.'))"


def _match_columns(df):
    return df.select("line", "module", "rule_key", "matched_length")


_MATCH = "SELECT line, module, rule_key, CAST(length(rule_key) AS INT) AS matched_length FROM m"


@query("match_imports_exact", f"WITH {_IMPORTS}, {_matched(_EXACT)} {_MATCH}")
def match_imports_exact(t):
    return _match_columns(E.match_imports(imports(t), rules(t)[0]))


@query("match_imports_prefix", f"WITH {_IMPORTS}, {_matched(_PREFIX)} {_MATCH}")
def match_imports_prefix(t):
    return _match_columns(E.match_imports(imports(t), rules(t)[0], "prefix"))


@query("match_imports_segment", f"WITH {_IMPORTS}, {_matched(_SEGMENT)} {_MATCH}")
def match_imports_segment(t):
    return _match_columns(E.match_imports(imports(t), rules(t)[0], "prefix", "segment", ("com.example.therou",)))


def classified(t: Tables) -> DataFrame:
    r, _ = rules(t)
    return E.classify(E.match_imports(imports(t), r, "prefix"), r, "3.9")


_CLASSIFIED = f"""{_IMPORTS}, {_matched(_PREFIX)},
k AS (SELECT *, action = 'removed' AS advisory FROM m)"""


@query("version_gate", """
SELECT p_partkey, p_size < 12 AS advisory FROM part""")
def version_gate(t):
    target = F.concat(F.lit("3."), c("p_size").cast("string"))
    return t.part.select("p_partkey", E.is_advisory(F.lit("removed"), F.lit("3.12.0"), target).alias("advisory"))


@query("classify_imports", f"WITH {_CLASSIFIED} SELECT line, module, action, target_module, notes, advisory FROM k")
def classify_imports(t):
    return classified(t).select("line", "module", "action", "target_module", "notes", "advisory")


@query("replacement_findings", f"""WITH {_CLASSIFIED} SELECT project_id, file, line, module, array_to_string(names, ',') AS names, action, target_module, notes, advisory FROM k""")
def replacement_findings(t):
    return E.replacement_findings(classified(t)).withColumn("names", F.array_join("names", ","))


_ROUTED = f"""{_CLASSIFIED},
nm AS (SELECT *, CASE WHEN len(names) = 0 THEN NULL ELSE unnest(names) END AS name FROM k WHERE len(names) > 0 UNION ALL SELECT *, NULL FROM k WHERE len(names) = 0),
routed AS (SELECT nm.*, coalesce(a.ord, b.ord) AS o, coalesce(a.to_import, CASE WHEN b.to_import IS NOT NULL THEN concat_ws('.', b.to_import, name) END,
    CASE WHEN action = 'rename' THEN concat_ws('.', target_module, name) END) AS new_path, a.condition
  FROM nm LEFT JOIN tr a ON a.rule_key = nm.rule_key AND a.from_import = concat_ws('.', module, name) LEFT JOIN tr b ON b.rule_key = nm.rule_key AND b.from_import = module)"""
_ROUTED = _ROUTED.replace("SELECT *, CASE WHEN len(names) = 0 THEN NULL ELSE unnest(names) END AS name FROM k WHERE len(names) > 0", "SELECT *, unnest(names) AS name FROM k WHERE len(names) > 0")


def routed(t: Tables) -> DataFrame:
    return E.route_symbols(classified(t), rules(t)[1])


@query("route_symbols", f"WITH {_ROUTED} SELECT line, name, CAST(o AS INT) AS ord, new_path, condition, action = 'choice' OR new_path IS NULL AS needs_review FROM routed")
def route_symbols(t):
    return routed(t).select("line", "name", "ord", "new_path", "condition", "needs_review")


@query("route_choices", f"""WITH {_ROUTED} SELECT line, name, string_agg(DISTINCT coalesce(o, -1) || ':' || coalesce(new_path, '?') || '/' || coalesce(condition, ''), ';' ORDER BY coalesce(o, -1) || ':' || coalesce(new_path, '?') || '/' || coalesce(condition, '')) AS alternatives,
  FROM routed WHERE action = 'choice' GROUP BY line, name""".replace("alternatives,\n", "alternatives\n").replace("coalesce(o, -1) || ':' || ", ""))
def route_choices(t):
    alt = F.transform("alternatives", lambda a: F.concat(F.coalesce(a["new_path"], F.lit("?")), F.lit("/"), F.coalesce(a["condition"], F.lit(""))))
    return E.route_choices(routed(t)).select("line", "name", F.array_join(F.array_sort(alt), ";").alias("alternatives"))


@query("replacement_summary", f"""WITH {_CLASSIFIED} SELECT project_id, 'total_imports_scanned' AS item, count(*) AS n FROM imp GROUP BY 1
  UNION ALL SELECT project_id, 'total_files_scanned', count(DISTINCT file) FROM imp GROUP BY 1 UNION ALL SELECT project_id, 'matches', count(*) FROM k GROUP BY 1
  UNION ALL SELECT project_id, 'by_action.' || action, count(*) FROM k GROUP BY 1, 2""")
def replacement_summary(t):
    return E.replacement_summary(imports(t), classified(t))


@query("manual_review", f"""WITH {_CLASSIFIED} SELECT project_id, file, line, module, 'choice' AS reason FROM k WHERE action = 'choice'
  UNION ALL SELECT project_id, file, line, module, 'unmatched' FROM imp WHERE line NOT IN (SELECT line FROM k)""")
def manual_review(t):
    return E.manual_review(imports(t), classified(t))


@query("new_dependencies", f"""WITH {_CLASSIFIED} SELECT DISTINCT project_id, NULL AS library, install FROM k WHERE install IS NOT NULL
  UNION SELECT DISTINCT project_id, unnest(libs), unnest(installs) FROM k WHERE len(libs) > 0 EXCEPT SELECT project_id, 'std', 'N/A' FROM k""")
def new_dependencies(t):
    return E.new_dependencies(classified(t))


_RANK = "CASE action WHEN 'rename' THEN 1 WHEN 'removed' THEN 2 WHEN 'split' THEN 3 ELSE 4 END"


@query("replacement_report", f"""WITH {_CLASSIFIED}
SELECT project_id, {_RANK} AS action_rank, file, CAST(line AS BIGINT) AS line, module, '- `' || file || ':' || line || '` ' || module || coalesce(' -> ' || target_module, '')
  || CASE WHEN advisory THEN ' (advisory)' ELSE '' END || coalesce(': ' || notes, '') AS text FROM k
UNION ALL SELECT project_id, {_RANK}, NULL, NULL, NULL, '## ' || upper(action[1]) || substr(action, 2) || ' (' || count(*) || ')' FROM k GROUP BY project_id, action""")
def replacement_report(t):
    return E.replacement_report(classified(t))


@query("replacement_files", f"""WITH {_CLASSIFIED}, p AS (SELECT project_id, count(*) AS n, count(DISTINCT file) AS f FROM imp GROUP BY 1),
md AS (SELECT project_id, unnest(['migration_pair', 'source', 'target', 'codebase_path', 'total_files_scanned']) AS item,
  unnest(['web', 'python 2.7', 'python 3.9', '/code/' || project_id, CAST(f AS VARCHAR)]) AS value FROM p)
SELECT project_id, 'metadata' AS section, item, value FROM md
UNION ALL SELECT project_id, 'summary', 'total_imports_scanned', CAST(n AS VARCHAR) FROM p
UNION ALL SELECT project_id, 'summary', 'matches', CAST((SELECT count(*) FROM k WHERE k.project_id = p.project_id) AS VARCHAR) FROM p
UNION ALL SELECT project_id, 'summary', action, CAST(count(*) AS VARCHAR) FROM k GROUP BY project_id, action
UNION ALL SELECT project_id, 'findings', file || ':' || lpad(CAST(line AS VARCHAR), 10, '0') || ':' || module, line || ' ' || array_to_string(names, ',') || ' ' || action || ' ' ||
  coalesce(target_module, '-') || ' ' || coalesce(notes, '-') || ' ' || advisory FROM k""")
def replacement_files(t):
    """The structured report is written and read back."""
    head = {"mapping_id": "web", "source_language": "python", "source_version": "2.7", "target_language": "python", "target_version": "3.9"}
    tables = E.replacement_tables(imports(t), classified(t), head, F.concat(F.lit("/code/"), "project_id"))
    path = f"{shared_folder(t.spark)}/specframe/replacements-{uuid.uuid4().hex}"
    write_specs(tables, path)
    back = read_spec_tables(t.spark, path, {name: df.schema for name, df in tables.items()})
    pair = lambda name, value: F.struct(F.lit(name).alias("item"), value.cast("string").alias("value"))
    rows = lambda section, items: back[section].select("project_id", F.lit(section).alias("section"), F.explode(items).alias("x")).select("project_id", "section", "x.*")
    shown = lambda *cols: F.concat_ws(" ", *[F.coalesce(c(x).cast("string"), F.lit("-")) if isinstance(x, str) else x for x in cols])
    return rows("metadata", F.array(
        pair("migration_pair", c("migration_pair")), pair("source", shown("source.language", "source.version")), pair("target", shown("target.language", "target.version")),
        pair("codebase_path", c("codebase_path")), pair("total_files_scanned", c("total_files_scanned")))).unionByName(
        rows("summary", F.concat(F.array(pair("total_imports_scanned", c("total_imports_scanned")), pair("matches", c("matches"))), F.transform(
            F.map_entries("by_action"), lambda e: F.struct(e["key"].alias("item"), e["value"].cast("string").alias("value")))))).unionByName(
        rows("findings", F.array(F.struct(c("seq").alias("item"), shown("line", F.array_join("names", ","), "action", "target_module", "notes", "advisory").alias("value")))))


@query("replacement_checks", f"""WITH {_ROUTED}, p AS (SELECT DISTINCT project_id FROM imp),
bare AS (SELECT project_id, file, line, module, name FROM routed WHERE action = 'choice' GROUP BY ALL HAVING count(new_path) = 0)
SELECT project_id, 'imports_not_accounted_for' AS "check", 0 AS failures FROM p UNION ALL SELECT project_id, 'unknown_action', 0 FROM p
UNION ALL SELECT project_id, 'without_recommendation', (SELECT count(*) FROM k WHERE k.project_id = p.project_id AND action IN ('rename', 'removed') AND target_module IS NULL AND len(libs) = 0) FROM p
UNION ALL SELECT project_id, 'choices_without_alternatives', (SELECT count(*) FROM bare WHERE bare.project_id = p.project_id) FROM p""")
def replacement_checks(t):
    return E.replacement_checks(imports(t), classified(t), routed(t))


# -- the packaged rules, on imports spelled with the rule keys --------------------

def _packaged_sql(source: str, target: str, tail: str) -> str:
    doc = R._load(source)
    rows = ", ".join(f"('{k}', '{r['action']}', " + (f"'{r['target_module']}'" if "target_module" in r else "NULL") + ", "
                     + (f"'{r['removed_in']}'" if "removed_in" in r else "NULL") + ")" for k, r in doc["mappings"].items())
    exact = doc["match_strategy"] == "exact"
    on = "module = rule_key OR starts_with(module, rule_key || '.')" if exact else "starts_with(module, rule_key)"
    parts = list(doc["mappings"])
    names = ", ".join(f"'{k}'" for k in parts)
    older = f"string_split(removed_in, '.')[1]::INT * 1000 + coalesce(string_split(removed_in, '.')[2], '0')::INT > {target}"
    return f"""
WITH imp AS (SELECT p_partkey, [{names}][1 + p_size % {len(parts)}] || CASE WHEN p_retailprice > 950 THEN '{tail}' ELSE '' END AS module FROM part),
r AS (SELECT * FROM (VALUES {rows}) v(rule_key, action, target_module, removed_in)),
m AS (SELECT p_partkey, module, rule_key, action, target_module, action = 'removed' AND {older} AS advisory,
  row_number() OVER (PARTITION BY p_partkey ORDER BY length(rule_key) DESC) AS rn FROM imp JOIN r ON {on})
SELECT p_partkey, module, rule_key, action, target_module, coalesce(advisory, false) AS advisory FROM m WHERE rn = 1"""


def _packaged(t: Tables, source: str, tail: str) -> DataFrame:
    head = R.migration(source)
    r, _ = R.load_rules(t.spark, source)
    keys = list(R._load(source)["mappings"])
    module = F.element_at(F.array(*[F.lit(k) for k in keys]), 1 + c("p_size") % len(keys))
    imp = t.part.select(F.lit("p").alias("project_id"), "p_partkey", F.concat(
        module, F.when(c("p_retailprice") > 950, F.lit(tail)).otherwise(F.lit(""))).alias("module"))
    found = E.classify(E.match_imports(imp, r, head["match_strategy"]), r, head["target_version"])
    return found.select("p_partkey", "module", "rule_key", "action", "target_module", "advisory")


@query("python_migration", _packaged_sql("py2to3", "3011", ".sub"))
def python_migration(t):
    return _packaged(t, "py2to3", ".sub")


@query("java_migration", _packaged_sql("java8to17", "17000", "x"))
def java_migration(t):
    return _packaged(t, "java8to17", "x")
