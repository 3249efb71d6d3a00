"""Findings and dependency operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators import deps, findings
from .registry import Tables, query

c = F.col


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _seconds(ts: str):
    """Seconds since 1970 of a timestamp without time zone."""
    return (F.datediff(ts, F.lit("1970-01-01")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
            + F.second(ts).cast("bigint"))


# -- findings: a user's sign-ups are functions of one day, all other events are findings --

def functions(t: Tables) -> DataFrame:
    start = _seconds("ts")
    return t.events.filter("event_type = 'signup'").select(
        F.lit("site").alias("project_id"), F.lit("function").alias("kind"), c("event_id").alias("pos"),
        _text("f", c("event_id")).alias("id"), _text("lib/u", c("user_id"), ".py").alias("file"), start.alias("line"),
        F.when(c("value") > 5, start + (c("value") * 10000).cast("bigint")).alias("end_line"))


def raw_findings(t: Tables) -> DataFrame:
    """Other events as raw scanner findings, with odd severities and actions."""
    level = F.when(c("value") > 20, F.lit("HIGH")).when(c("value") > 10, F.lit("Medium")).when(c("value") > 3, F.lit("severe"))
    ids = F.array(F.struct(_text("V", c("user_id")).alias("id"), F.lit("t").alias("title"), F.lit("1").alias("level")))
    full = S.struct(S.COMPLIANCE)
    comp = F.struct(
        F.when(c("value") > 30, ids).cast(full["owasp_asvs"].dataType).alias("owasp_asvs"),
        F.when(c("value") > 20, F.array(F.lit("AC-1"))).otherwise(F.array().cast("array<string>")).alias("nist_800_53"),
        F.lit(None).cast(full["asd_stig"].dataType).alias("asd_stig"), F.lit(None).cast("array<string>").alias("pci_dss"))
    return t.events.filter("event_type <> 'signup'").select(
        F.lit("site").alias("project_id"), c("event_id").alias("seq"), _text("src/app/u", c("user_id"), ".py").alias("file"),
        _seconds("ts").alias("line"), _text("R", c("user_id")).alias("rule_id"), level.alias("severity"),
        F.when(c("value") > 25, F.lit("")).when(c("value") > 22, F.lit("Critical")).alias("derived_severity"),
        c("user_id").cast("int").alias("column"), F.when(c("value") > 2, c("props")).otherwise(F.lit("")).alias("message"),
        F.when(c("value") > 15, c("user_id").cast("int")).alias("cwe_id"), F.when(c("value") > 16, F.lit("Weak")).alias("cwe_name"),
        F.lit("").alias("remediation"), F.when(c("value") > 12, F.lit("fix")).otherwise(F.lit("ignore")).alias("action"), comp.alias("compliance"))


_FUNC = """
fn AS (SELECT event_id AS pos, 'f' || event_id AS id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s,
   CASE WHEN value > 5 THEN CAST(floor(epoch(ts)) AS BIGINT) + CAST(trunc(value * 10000) AS BIGINT) END AS e FROM events WHERE event_type = 'signup'),
fd AS (SELECT event_id AS seq, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS line, value, props FROM events WHERE event_type <> 'signup'),
enc AS (SELECT seq, coalesce(arg_min(id, (s, pos)) FILTER (line <= e), arg_max(id, (s, pos))) AS node_ref
   FROM fd LEFT JOIN fn ON fn.user_id = fd.user_id AND s <= line GROUP BY seq)"""


@query("enclosing_function", f"WITH {_FUNC} SELECT seq, node_ref FROM enc")
def enclosing_function(t):
    return findings.enclosing_function(raw_findings(t), functions(t)).select("seq", "node_ref")


_SEV = """CASE WHEN lower(coalesce(nullif(derived, ''), sev, 'info')) IN ('critical', 'high', 'medium', 'low', 'info')
   THEN lower(coalesce(nullif(derived, ''), sev, 'info')) ELSE 'info' END"""


@query("normalize_severity", f"""
WITH x AS (SELECT o_orderkey, substr(o_orderpriority, 3) AS sev, CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'Critical' END AS derived FROM orders)
SELECT o_orderkey, {_SEV} AS severity FROM x""")
def normalize_severity(t):
    derived = F.when(c("o_orderstatus") == "F", F.lit("")).when(c("o_orderstatus") == "P", F.lit("Critical"))
    return t.orders.select("o_orderkey", findings.normalize_severity(derived, F.substring("o_orderpriority", 3, 20)).alias("severity"))


_MAPPED = f"""
mapped AS (SELECT seq, user_id, line, value, {_SEV} AS severity, CASE WHEN value > 2 THEN nullif(props, '') END AS message,
   CASE WHEN value > 15 THEN CAST(user_id AS INT) END AS cwe_id, CASE WHEN value > 16 THEN 'Weak' END AS cwe_name,
   CASE WHEN value > 12 THEN 'fix' END AS action FROM (SELECT *, CASE WHEN value > 20 THEN 'HIGH' WHEN value > 10 THEN 'Medium' WHEN value > 3 THEN 'severe' END AS sev,
   CASE WHEN value > 25 THEN '' WHEN value > 22 THEN 'Critical' END AS derived FROM fd))"""


@query("map_findings", f"""WITH {_FUNC}, {_MAPPED}
SELECT seq, 'src/app/u' || user_id || '.py' AS file, line, 'R' || user_id AS rule_id, severity, CAST(user_id AS INT) AS "column", message, cwe_id, cwe_name,
  CAST(NULL AS VARCHAR) AS remediation, action, node_ref, CASE WHEN value > 30 THEN 'V' || user_id END AS asvs, CASE WHEN value > 20 THEN 'AC-1' END AS nist,
  value > 20 AS has_compliance FROM mapped JOIN enc USING (seq)""")
def map_findings(t):
    m = findings.map_findings(raw_findings(t), functions(t))
    return m.select("seq", "file", "line", "rule_id", "severity", "column", "message", "cwe_id", "cwe_name", "remediation", "action", "node_ref",
                    F.get("compliance.owasp_asvs", F.lit(0))["id"].alias("asvs"), F.get("compliance.nist_800_53", F.lit(0)).alias("nist"),
                    c("compliance").isNotNull().alias("has_compliance"))


# -- files: paths of pages, and their last segments as short finding paths ------

def _page_path():
    return F.regexp_extract("url", r"^https?://[^/]+(/.*)$", 1)


def page_files(t: Tables) -> DataFrame:
    return t.pages.select(F.regexp_extract("url", r"\.(\w+)/", 1).alias("project_id"), "page_id", _page_path().alias("file"))


def page_findings(t: Tables) -> DataFrame:
    path = _page_path()
    return t.pages.select(
        F.regexp_extract("url", r"\.(\w+)/", 1).alias("project_id"), c("page_id").alias("seq"),
        F.when(F.startswith("url", F.lit("https")), F.substring_index(path, "/", -1)).otherwise(_text("/x", path)).alias("file"),
        F.when(F.endswith("url", F.lit("/")), F.lit(None)).otherwise(F.lit("W1")).alias("rule_id"),
        F.when(F.contains("url", F.lit("utm")), F.lit("low")).alias("severity"), c("url").alias("message"))


_PAGES = r"""
pg AS (SELECT page_id, url, regexp_extract(url, '\.(\w+)/', 1) AS project_id, regexp_extract(url, '^https?://[^/]+(/.*)$', 1) AS file FROM pages),
ff AS (SELECT project_id, page_id AS seq, url, CASE WHEN starts_with(url, 'https') THEN split_part(file, '/', -1) ELSE '/x' || file END AS f FROM pg),
pairs AS (SELECT DISTINCT a.project_id, a.file, b.f FROM (SELECT DISTINCT project_id, file FROM pg) a JOIN (SELECT DISTINCT project_id, f FROM ff) b
  ON a.project_id = b.project_id AND (a.file = b.f OR suffix(a.file, b.f) OR suffix(b.f, a.file)) WHERE a.file <> '' AND b.f <> ''),
hits AS (SELECT p.project_id, p.file, ff.seq, ff.url FROM pairs p JOIN ff ON ff.project_id = p.project_id AND ff.f = p.f)"""


@query("findings_for_file", f"WITH {_PAGES} SELECT project_id, file, seq FROM hits")
def findings_for_file(t):
    return findings.findings_for_file(page_files(t), page_findings(t))


@query("findings_by_location", f"""WITH {_PAGES}, lc AS (SELECT project_id, seq, CASE WHEN seq % 7 > 0 THEN 'at ' || url || ':' || seq END AS location FROM ff)
SELECT project_id, file, seq FROM hits
UNION SELECT a.project_id, a.file, seq FROM (SELECT DISTINCT project_id, file FROM pg WHERE file <> '') a JOIN lc ON lc.project_id = a.project_id AND contains(location, a.file)""")
def findings_by_location(t):
    """Locations are sentences around an address; its path, and paths within it, are files."""
    location = F.when(c("seq") % 7 > 0, _text("at ", c("message"), ":", c("seq")))
    return findings.findings_for_file(page_files(t), page_findings(t).withColumn("location", location), by_location=True)


@query("findings_section", f"""WITH {_PAGES}
SELECT project_id, file, seq AS ord, '- ' || CASE WHEN suffix(url, '/') THEN 'unknown' ELSE 'W1' END || ': ' || CASE WHEN suffix(url, '/') THEN '' ELSE 'W1' END
  || ' (severity: ' || CASE WHEN contains(url, 'utm') THEN 'low' ELSE 'unknown' END || ') — ' || url AS text FROM hits
UNION ALL SELECT DISTINCT project_id, file, -1, 'Relevant security findings:' FROM hits""")
def findings_section(t):
    f = page_findings(t)
    return findings.findings_section(findings.findings_for_file(page_files(t), f), f)


# -- dependencies: parts as audited packages ----------------------------------

def raw_audits(t: Tables) -> DataFrame:
    cve = "struct<id:string,cve_id:string,severity:string,summary:string,description:string>"
    s = lambda v: F.lit(None).cast("string") if v is None else v
    entry = lambda i, j, sev, summ, desc: F.struct(
        s(i).alias("id"), s(j).alias("cve_id"), s(sev).alias("severity"), s(summ).alias("summary"), s(desc).alias("description")).cast(cve)
    first = F.array(entry(_text("CVE-", c("p_partkey")), None, F.when(c("p_size") > 30, F.lit("Critical")).otherwise(c("p_type")), c("p_name"), F.lit("d")))
    second = F.array(entry(_text("CVE-", c("p_partkey")), None, F.when(c("p_size") > 30, F.lit("Critical")).otherwise(c("p_type")), c("p_name"), F.lit("d")),
                     entry(None, F.when(c("p_size") > 40, c("p_brand")), F.lit("low"), F.lit(""), c("p_type")))
    return t.part.select(
        c("p_brand").alias("project_id"), c("p_partkey").alias("pos"), _text(c("p_name"), "-", c("p_partkey")).alias("package"), F.lit("java").alias("ecosystem"),
        F.when(c("p_size") > 40, _text('{"version": "', c("p_size"), '.1"}')).when(c("p_size") > 30, F.lit('{"version": ""}')).when(
            c("p_size") > 20, F.lit("9.9")).alias("version"),
        F.struct(F.when(c("p_size") > 10, _text(c("p_size"), ".0")).otherwise(F.lit("")).alias("latest_version"),
                 F.when(c("p_size") > 25, F.repeat(c("p_name"), c("p_size") * 2)).otherwise(F.lit("")).alias("recommendation"),
                 c("p_type").alias("upgrade_path"),
                 F.when(c("p_type") == "PROMO", F.lit("Critical")).when(c("p_type") == "SMALL", F.lit("LOW")).otherwise(c("p_type")).alias("urgency")).alias("summary"),
        F.struct(F.when(c("p_size") > 15, first).alias("versions_cves"), F.when(c("p_size") > 25, second).alias("latest_cves")).alias("cves"),
        F.struct(F.when(c("p_size") > 35, c("p_size") > 40).alias("eol"), F.when(c("p_size") > 38, F.lit("2024-01-01")).alias("eol_date"),
                 F.when(c("p_size") > 33, F.when(c("p_type") == "PROMO", F.lit("high")).otherwise(F.lit("sure"))).alias("confidence")).alias("eol"))


def dependencies(t: Tables) -> DataFrame:
    return deps.map_audits(raw_audits(t))


_CVES = """
cve AS (SELECT p_brand AS project_id, p_partkey AS pos, unnest(CASE WHEN p_size > 25 THEN [0, 1, 2] ELSE [0] END) AS ord, * FROM part WHERE p_size > 15),
cves AS (SELECT project_id, pos, ord, CASE WHEN ord < 2 THEN 'CVE-' || p_partkey WHEN p_size > 40 THEN p_brand ELSE 'unknown' END AS id,
  CASE WHEN ord = 2 THEN 'LOW' WHEN p_size > 30 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, CASE WHEN ord = 2 THEN p_type ELSE p_name END AS summary FROM cve)"""
_DEPS = f"""{_CVES},
deps AS (SELECT p_brand AS project_id, p_partkey AS pos, p_name || '-' || p_partkey AS package,
  CASE WHEN p_size > 40 THEN p_size || '.1' WHEN p_size > 10 THEN p_size || '.0' END AS latest_version,
  (SELECT string_agg(id || ' (' || severity || ')', ', ' ORDER BY ord) FROM cves WHERE cves.pos = p_partkey) AS cves,
  CASE WHEN p_size > 35 THEN p_size > 40 END AS is_eol, CASE WHEN p_size > 38 THEN '2024-01-01' END AS eol_date,
  CASE WHEN p_size > 33 AND p_type = 'PROMO' THEN 'high' END AS eol_confidence,
  CASE WHEN p_size > 25 THEN CASE WHEN length(repeat(p_name, p_size * 2)) > 500 THEN left(repeat(p_name, p_size * 2), 497) || '...' ELSE repeat(p_name, p_size * 2) END ELSE p_type END AS recommendation,
  CASE p_type WHEN 'PROMO' THEN 'immediate' WHEN 'SMALL' THEN 'low' WHEN 'MEDIUM' THEN 'medium' END AS urgency FROM part)"""


@query("map_audits", f"WITH {_DEPS} SELECT project_id, pos, package, 'java' AS ecosystem, latest_version, cves, is_eol, eol_date, eol_confidence, recommendation, urgency FROM deps")
def map_audits(t):
    shown = F.transform("cves", lambda v: F.concat(v["id"], F.lit(" ("), v["severity"], F.lit(")")))
    return dependencies(t).select("project_id", "pos", "package", "ecosystem", "latest_version", F.array_join(shown, ", ").alias("cves"),
                                  "eol.is_eol", "eol.eol_date", c("eol.confidence").alias("eol_confidence"), "recommendation", "urgency")


@query("cve_details", f"WITH {_CVES} SELECT project_id, pos, ord, id, severity, summary FROM cves")
def cve_details(t):
    return dependencies(t).select("project_id", "pos", F.posexplode("cves").alias("ord", "v")).select("project_id", "pos", "ord", "v.id", "v.severity", "v.summary")


@query("recommendations", """SELECT doc_id, given, CASE WHEN length(t) > 500 THEN left(t, 497) || '...' ELSE t END AS recommendation
  FROM (SELECT doc_id, true AS given, coalesce(nullif(text, ''), source) AS t FROM documents UNION ALL SELECT doc_id, false, source FROM documents)""")
def recommendations(t):
    return t.documents.select("doc_id", "source", F.inline(F.array(
        F.struct(F.lit(True).alias("given"), c("text").alias("said")), F.struct(F.lit(False).alias("given"), F.lit("").alias("said"))))
    ).select("doc_id", "given", deps.recommendation(c("said"), c("source")).alias("recommendation"))


@query("urgency", """SELECT o_orderkey, CASE lower(substr(o_orderpriority, 3)) WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' END AS urgency FROM orders""")
def urgency(t):
    return t.orders.select("o_orderkey", deps.urgency(F.substring("o_orderpriority", 3, 20)).alias("urgency"))


@query("cve_section", f"""WITH {_CVES} SELECT project_id, pos, ord, '- ' || id || ' (' || severity || '): ' || summary AS text FROM cves
  UNION ALL SELECT DISTINCT project_id, NULL, -1, 'Known CVEs for this codebase:' FROM cves""")
def cve_section(t):
    return deps.cve_section(dependencies(t))
