"""Comparison operators on the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X
from ..operators import compare as H
from ..runtime import shared_folder
from ..sources.sinks import read_comparisons, write_comparisons
from .registry import Tables, query, sql_keywords, sql_need, sql_overlap

KW = sql_keywords


def _items(t: Tables):
    return (t.benchmark.select(F.col("item_id").alias("ref_id"), "text"),
            t.spread("documents").select(F.col("doc_id").alias("ext_id"), "text"))


_COVERS = f"""
WITH r AS (SELECT item_id AS ref_id, {KW('text')} AS rk FROM benchmark),
     e AS (SELECT doc_id AS ext_id, {KW('text')} AS ek FROM documents),
     rw AS (SELECT ref_id, len(rk) AS n, unnest(rk) AS w FROM r),
     ew AS (SELECT ext_id, unnest(ek) AS w FROM e),
     c AS (SELECT ref_id, ext_id, any_value(n) AS n, count(*) AS overlap FROM rw JOIN ew USING (w) GROUP BY ALL)
SELECT ref_id, ext_id, CAST(overlap AS INT) AS overlap, CAST(n AS INT) AS n FROM c WHERE overlap >= {sql_need('n')}"""
_COVERS = _COVERS.replace("GROUP BY ALL", "GROUP BY ref_id, ext_id")


@query("covers", _COVERS)
def covers(t):
    return H.covers(*_items(t))


@query("covers_shuffled", _COVERS)
def covers_shuffled(t):
    """The path for a reference side too large to broadcast."""
    return H.covers(*_items(t), max_broadcast=0)


@query("keyword_coverage", f"""
WITH c AS ({_COVERS})
SELECT item_id AS ref_id, CAST(len({KW('text')}) AS INT) AS n_keywords, count(c.ext_id) AS covering,
       coalesce(max(c.overlap), 0) AS best_overlap, count(c.ext_id) > 0 AS covered,
       len({KW('text')}) = 0 AS no_keywords
FROM benchmark LEFT JOIN c ON c.ref_id = item_id GROUP BY item_id, text""")
def keyword_coverage(t):
    return H.coverage_counts(*_items(t))


@query("document_keywords", f"""
SELECT doc_id, CAST(len(k) AS INT) AS n_keywords, array_to_string(list_sort(k), ' ') AS keywords
FROM (SELECT doc_id, {KW('text')} AS k FROM documents)""")
def document_keywords(t):
    k = H.keywords(F.col("text"))
    return t.spread("documents").select("doc_id", F.size(k).alias("n_keywords"), F.array_join(F.array_sort(k), " ").alias("keywords"))


@query("item_texts", """
SELECT p_partkey, p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) AS item FROM part""")
def item_texts(t):
    return t.part.select("p_partkey", X.item_text(
        F.struct("p_name", "p_brand", "p_size"), ("p_name", "p_brand", "p_size")).alias("item"))


def _turns(t: Tables):
    """Each turn with the one that follows it; the last one with an empty text."""
    c = t.spread("conversations")
    ref = c.select("conv_id", "turn", F.col("text").alias("ref"))
    ext = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ext"))
    return ref.join(ext, ["conv_id", "turn"], "left").withColumn("ext", F.coalesce("ext", F.lit("")))


_TURNS = """turns AS (SELECT u.conv_id, u.turn, u.text AS ref, coalesce(a.text, '') AS ext FROM conversations u
    LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)"""


@query("purpose_overlap", f"""
WITH {_TURNS}, k AS (SELECT *, {KW('ref')} AS rk, {KW('ext')} AS ek FROM turns)
SELECT conv_id, turn, CAST({sql_overlap('ek', 'rk')} AS INT) AS overlap, CAST(len(rk) AS INT) AS total,
       round(CASE WHEN len(rk) > 0 THEN {sql_overlap('ek', 'rk')} / len(rk) * 100 ELSE 0 END, 6) AS pct,
       left(ref, 200) AS reference, left(ext, 200) AS extracted FROM k""")
def purpose_overlap(t):
    return _turns(t).select("conv_id", "turn", H.purpose_overlap(F.col("ext"), F.col("ref")).alias("p")).select(
        "conv_id", "turn", "p.overlap", "p.total", F.round("p.pct", 6).alias("pct"), "p.reference", "p.extracted")


@query("array_field_coverage", f"""
WITH {_TURNS},
 a AS (SELECT conv_id, turn, regexp_split_to_array(ref, '[.\n]+') AS refs,
              list_transform(regexp_split_to_array(ext, '[.\n]+'), lambda x: {KW('x')}) AS exts FROM turns),
 i AS (SELECT conv_id, turn, exts, unnest(range(1, len(refs) + 1)) AS pos, refs FROM a),
 j AS (SELECT conv_id, turn, exts, pos, refs[pos] AS item, {KW('refs[pos]')} AS rk FROM i),
 f AS (SELECT conv_id, turn, pos, item, len(rk) > 0 AND len(list_filter(exts,
         lambda e: len(list_intersect(rk, e)) >= greatest(1, len(rk) // 3))) > 0 AS hit FROM j)
SELECT conv_id, turn, CAST(count(*) FILTER (hit) AS INT) AS matched, CAST(count(*) AS INT) AS total,
       coalesce(string_agg(left(item, 120), '|' ORDER BY pos) FILTER (NOT hit), '') AS uncovered
FROM f GROUP BY conv_id, turn""")
def array_field_coverage(t):
    parts = lambda c: F.split(c, "[.\n]+")
    return _turns(t).select("conv_id", "turn", H.array_coverage(parts(F.col("ext")), parts(F.col("ref"))).alias("c")).select(
        "conv_id", "turn", "c.matched", "c.total", F.array_join("c.uncovered", "|").alias("uncovered"))


# -- contracts of orders (reference) and of their line items (extracted) ------

def _order_contracts(t: Tables):
    """Reference contracts from orders; low-priority orders have none."""
    priority = F.lower(F.substring("o_orderpriority", 3, 20))
    status = F.col("o_orderstatus")
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    errors = F.array(F.struct(
        text("priority ", priority).alias("condition"), text("held in status ", F.lower(status)).alias("behavior"),
        F.when(status == "F", F.lit("fatal")).when(status == "P", F.lit("advisory")).alias("severity")))
    trust = F.struct(
        F.when(status == "F", F.lit("trusted")).when(status == "O", F.lit("untrusted")).alias("input_trust"),
        F.when(F.col("o_totalprice") > 200000, F.lit("mixed")).otherwise(F.lit("trusted")).alias("output_trust"),
        text("checks customer priority ", priority).alias("sanitization"))
    null = lambda f: F.lit(None).cast(S.struct(S.CONTRACT)[f].dataType)
    contract = F.struct(
        text("delivers order with priority ", priority).alias("purpose"),
        F.when(status == "F", F.array(F.lit("customer exists"), text("priority is ", priority))).alias("preconditions"),
        null("postconditions").alias("postconditions"), null("invariants").alias("invariants"),
        null("side_effects").alias("side_effects"),
        F.when(status != "O", errors).alias("error_conditions"), null("state_transitions").alias("state_transitions"),
        F.when(status.isin("F", "P"), trust).alias("trust_boundary"),
        F.when(priority == "urgent", F.lit("safe")).alias("thread_safety"), null("performance").alias("performance"))
    return t.orders.select(
        F.lit("shop").alias("project_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("element_id"),
        F.when(priority != "low", contract).alias("contract"))


def _line_contracts(t: Tables):
    """Extracted contracts from aggregates of each order's lines."""
    agg = t.spread("lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"),
        F.max("l_quantity").alias("q"), F.min("l_linestatus").alias("ls"))
    c = F.col
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    null = lambda f: F.lit(None).cast(S.struct(S.CONTRACT)[f].dataType)
    size = F.when(c("q") > 40, F.lit("urgent")).otherwise(F.lit("medium"))
    errors = F.array(F.struct(
        text(size, " quantity").alias("condition"), F.lit("status held").alias("behavior"),
        F.when(c("lo") == "A", F.lit("fatal")).when(c("lo") == "N", F.lit("advisory")).alias("severity")))
    trust = F.struct(
        F.when(c("lo") == "A", F.lit("trusted")).when(c("lo") == "N", F.lit("mixed")).alias("input_trust"),
        F.when(c("hi") == "R", F.lit("mixed")).otherwise(F.lit("trusted")).alias("output_trust"),
        F.when(c("n") > 2, text("checks ", size)).alias("sanitization"))
    contract = F.struct(
        F.when(c("n") > 1, text("order lines delivers ", size)).alias("purpose"),
        F.when(c("ls") == "F", F.array(text("priority ", size))).alias("preconditions"),
        null("postconditions").alias("postconditions"), null("invariants").alias("invariants"),
        F.when(c("hi") == "N", F.array(F.lit("writes lines"))).alias("side_effects"),
        F.when(c("n") > 3, errors).alias("error_conditions"), null("state_transitions").alias("state_transitions"),
        F.when(c("n") > 1, trust).alias("trust_boundary"),
        F.when(c("n") > 5, F.lit("safe")).alias("thread_safety"), null("performance").alias("performance"))
    return agg.select(
        F.lit("shop").alias("project_id"),
        F.concat(F.when(c("lo") == "R", F.lit("x")).otherwise(F.lit("o")), c("l_orderkey").cast("string")).alias("element_id"),
        contract.alias("contract"))


def _id_map(t: Tables):
    """Map entries ``xN=oN``, half of them padded, some without an equals sign."""
    k = F.col("o_orderkey").cast("string")
    return H.parse_id_map(t.orders.select(
        F.col("o_orderkey").alias("ord"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("x"), k)).when(
            F.col("o_orderstatus") == "O", F.concat(F.lit(" x"), k, F.lit(" = o"), k, F.lit(" "))).otherwise(
            F.concat(F.lit("x"), k, F.lit("=o"), k)).alias("entry")))


_ID_MAP = """id_map AS (SELECT 'x' || o_orderkey AS element_id, 'o' || o_orderkey AS reference_id
    FROM orders WHERE o_orderstatus <> 'P')"""
_ORDER = f"""
ref AS (SELECT 'o' || o_orderkey AS reference_id, lower(substr(o_orderpriority, 3)) AS pr, o_orderstatus AS st, o_totalprice AS tp
        FROM orders WHERE lower(substr(o_orderpriority, 3)) <> 'low'),
agg AS (SELECT l_orderkey, count(*) AS n, min(l_returnflag) AS lo, max(l_returnflag) AS hi, max(l_quantity) AS q,
               min(l_linestatus) AS ls FROM lineitem GROUP BY l_orderkey),
ext0 AS (SELECT CASE WHEN lo = 'R' THEN 'x' ELSE 'o' END || l_orderkey AS element_id, n, lo, hi, ls,
               CASE WHEN q > 40 THEN 'urgent' ELSE 'medium' END AS sz FROM agg),
ext AS (SELECT e.*, coalesce(m.reference_id, e.element_id) AS reference_id FROM ext0 e LEFT JOIN id_map m USING (element_id)),
pairs AS (SELECT * FROM ext JOIN ref USING (reference_id)),
facts AS (SELECT element_id, reference_id,
  'delivers order with priority ' || pr AS r_purpose, CASE WHEN n > 1 THEN 'order lines delivers ' || sz END AS e_purpose,
  CASE WHEN st = 'F' THEN ['customer exists', 'priority is ' || pr] END AS r_pre, CASE WHEN ls = 'F' THEN ['priority ' || sz] END AS e_pre,
  CASE WHEN hi = 'N' THEN ['writes lines'] END AS e_side,
  CASE WHEN st <> 'O' THEN 'priority ' || pr || ' held in status ' || lower(st) END AS r_err_base,
  CASE WHEN st = 'F' THEN 'fatal' WHEN st = 'P' THEN 'advisory' END AS r_sev,
  CASE WHEN n > 3 THEN sz || ' quantity status held' END AS e_err_base,
  CASE WHEN lo = 'A' THEN 'fatal' WHEN lo = 'N' THEN 'advisory' END AS e_sev,
  st IN ('F', 'P') AS r_has_trust, n > 1 AS e_has_trust,
  CASE WHEN st = 'F' THEN 'trusted' WHEN st = 'O' THEN 'untrusted' END AS r_in, CASE WHEN n > 1 THEN CASE WHEN lo = 'A' THEN 'trusted' WHEN lo = 'N' THEN 'mixed' END END AS e_in,
  CASE WHEN tp > 200000 THEN 'mixed' ELSE 'trusted' END AS r_out, CASE WHEN n > 1 THEN CASE WHEN hi = 'R' THEN 'mixed' ELSE 'trusted' END END AS e_out,
  'checks customer priority ' || pr AS r_san, CASE WHEN n > 2 THEN 'checks ' || sz END AS e_san,
  CASE WHEN pr = 'urgent' THEN 'safe' END AS r_safe, CASE WHEN n > 5 THEN 'safe' END AS e_safe FROM pairs)"""
_PAIRS = f"WITH {_ID_MAP}, {_ORDER}"


def _pairs(t: Tables):
    return H.pair_contracts(H.map_ids(_line_contracts(t), _id_map(t)), _order_contracts(t))


def _compared(t: Tables):
    return H.compare_elements(_pairs(t)[0])


@query("id_mapping", f"""WITH {_ID_MAP}
SELECT e.element_id, coalesce(m.reference_id, e.element_id) AS reference_id FROM (
  SELECT CASE WHEN min(l_returnflag) = 'R' THEN 'x' ELSE 'o' END || l_orderkey AS element_id FROM lineitem GROUP BY l_orderkey) e
LEFT JOIN id_map m USING (element_id)""")
def id_mapping(t):
    return H.map_ids(_line_contracts(t).select("element_id"), _id_map(t))


@query("contract_pairs", f"{_PAIRS} SELECT element_id, reference_id, e_purpose, r_purpose FROM facts")
def contract_pairs(t):
    return _pairs(t)[0].select("element_id", "reference_id", F.col("ext.purpose").alias("e_purpose"), F.col("ref.purpose").alias("r_purpose"))


@query("skipped_elements", f"{_PAIRS} SELECT element_id FROM ext WHERE reference_id NOT IN (SELECT reference_id FROM ref)")
def skipped_elements(t):
    return _pairs(t)[1].select("element_id")


_FIELDS = """
r_f AS (SELECT element_id, list_filter(['purpose', CASE WHEN r_pre IS NOT NULL THEN 'preconditions' END,
    CASE WHEN r_err_base IS NOT NULL THEN 'error_conditions' END, CASE WHEN r_has_trust THEN 'trust_boundary' END,
    CASE WHEN r_safe IS NOT NULL THEN 'thread_safety' END], lambda x: x IS NOT NULL) AS rf,
  list_filter([CASE WHEN e_purpose IS NOT NULL THEN 'purpose' END, CASE WHEN e_pre IS NOT NULL THEN 'preconditions' END,
    CASE WHEN e_side IS NOT NULL THEN 'side_effects' END, CASE WHEN e_err_base IS NOT NULL THEN 'error_conditions' END,
    CASE WHEN e_has_trust THEN 'trust_boundary' END, CASE WHEN e_safe IS NOT NULL THEN 'thread_safety' END],
    lambda x: x IS NOT NULL) AS ef FROM facts),
fields AS (SELECT element_id, list_sort(list_intersect(rf, ef)) AS matched,
    list_sort(list_filter(rf, lambda x: NOT list_contains(ef, x))) AS missing,
    list_sort(list_filter(ef, lambda x: NOT list_contains(rf, x))) AS extra FROM r_f)"""


@query("field_set_diff", f"""{_PAIRS}, {_FIELDS} SELECT element_id, array_to_string(matched, ',') AS matched,
    array_to_string(missing, ',') AS missing, array_to_string(extra, ',') AS extra FROM fields""")
def field_set_diff(t):
    join = lambda f: F.array_join(f"fields.{f}", ",").alias(f)
    return _compared(t).select("element_id", join("matched"), join("missing"), join("extra"))


def _covered(ref: str, ext: str) -> str:
    rk, ek = KW(ref), KW(ext)
    return f"(len({rk}) > 0 AND {sql_overlap(ek, rk)} >= {sql_need(f'len({rk})')})"


_R_ERR = "concat_ws(' ', r_err_base, r_sev)"
_E_ERR = "concat_ws(' ', e_err_base, e_sev)"
_DETAILS = f"""
pre AS (SELECT element_id, 'preconditions' AS field, unnest(r_pre) AS item, e_pre, e_pre IS NULL AS field_missing FROM facts WHERE r_pre IS NOT NULL),
pre_hit AS (SELECT *, NOT field_missing AND {_covered('item', 'e_pre[1]')} AS hit FROM pre),
details AS (
  SELECT element_id, field, CAST(count(*) FILTER (hit) AS INT) AS matched, CAST(count(*) AS INT) AS total, field_missing,
         CASE WHEN field_missing THEN '' ELSE coalesce(string_agg(item, '|' ORDER BY item) FILTER (NOT hit), '') END AS uncovered
  FROM pre_hit GROUP BY element_id, field, field_missing
  UNION ALL
  SELECT element_id, 'error_conditions', CAST(CASE WHEN e_err_base IS NOT NULL AND {_covered(_R_ERR, _E_ERR)} THEN 1 ELSE 0 END AS INT), 1,
         e_err_base IS NULL, CASE WHEN e_err_base IS NULL OR {_covered(_R_ERR, _E_ERR)} THEN '' ELSE {_R_ERR} END
  FROM facts WHERE r_err_base IS NOT NULL)"""


@query("comparison_details", f"{_PAIRS}, {_DETAILS} SELECT element_id, field, matched, total, field_missing, uncovered FROM details")
def comparison_details(t):
    return H.comparison_details(_compared(t)).select(
        "element_id", "field", "matched", "total", "field_missing", F.array_join(F.array_sort("uncovered"), "|").alias("uncovered"))


_TRUST = f"""
tr AS (SELECT element_id, unnest([
   {{'k': 'input_trust', 's': CASE WHEN r_in IS NULL AND e_in IS NULL THEN NULL WHEN r_in IS NULL THEN 'EXTRA' WHEN e_in IS NULL THEN 'MISSING'
      WHEN r_in = e_in THEN 'MATCH' ELSE 'MISMATCH (''' || e_in || ''' vs ref ''' || r_in || ''')' END}},
   {{'k': 'output_trust', 's': CASE WHEN e_out IS NULL THEN 'MISSING' WHEN r_out = e_out THEN 'MATCH'
      ELSE 'MISMATCH (''' || e_out || ''' vs ref ''' || r_out || ''')' END}},
   {{'k': 'sanitization', 's': CASE WHEN e_san IS NULL THEN 'MISSING' WHEN {sql_overlap(KW('e_san'), KW('r_san'))} / len({KW('r_san')}) * 100 >= 40
      THEN 'MATCH' ELSE 'PARTIAL' END}}]) AS x FROM facts WHERE r_has_trust),
trust AS (SELECT element_id, x.k AS key, x.s AS status FROM tr WHERE x.s IS NOT NULL)"""


@query("trust_comparison", f"{_PAIRS}, {_TRUST} SELECT element_id, key, status FROM trust")
def trust_comparison(t):
    return _compared(t).select("element_id", F.explode("trust").alias("x")).select("element_id", "x.key", "x.status")


@query("severity_levels", f"""{_PAIRS} SELECT element_id, coalesce(r_sev, '') AS reference, coalesce(e_sev, '') AS extracted,
    r_sev IS NOT DISTINCT FROM e_sev AS match FROM facts WHERE r_err_base IS NOT NULL AND e_err_base IS NOT NULL""")
def severity_levels(t):
    return _compared(t).filter("severities IS NOT NULL").select(
        "element_id", F.array_join("severities.reference", ",").alias("reference"),
        F.array_join("severities.extracted", ",").alias("extracted"), "severities.match")


_PURPOSE = f"""purpose AS (SELECT element_id, r_purpose, e_purpose, {sql_overlap(KW('e_purpose'), KW('r_purpose'))} AS o,
    len({KW('r_purpose')}) AS n FROM facts WHERE e_purpose IS NOT NULL)"""
_SUMMARY = f"""
s1 AS (SELECT count(*) AS elements_compared, avg(len(matched) / (len(matched) + len(missing)) * 100) AS a FROM fields),
s2 AS (SELECT avg(o / n * 100) AS b FROM purpose WHERE n > 0),
s3 AS (SELECT count(*) FILTER (matched = total) AS full_error_coverage, count(*) AS elements_with_error_conditions FROM details WHERE field = 'error_conditions'),
s4 AS (SELECT count(*) FILTER (m) AS trust_boundary_match FROM (SELECT bool_and(status = 'MATCH') AS m FROM trust GROUP BY element_id)),
s5 AS (SELECT count(*) AS elements_with_trust_boundary FROM facts WHERE r_has_trust),
summary AS (SELECT elements_compared, round(a, 6) AS avg_field_coverage_pct, round(b, 6) AS avg_purpose_overlap_pct, full_error_coverage,
    elements_with_error_conditions, trust_boundary_match, elements_with_trust_boundary FROM s1, s2, s3, s4, s5)"""


@query("comparison_summary", f"{_PAIRS}, {_FIELDS}, {_DETAILS}, {_TRUST}, {_PURPOSE}, {_SUMMARY} SELECT * FROM summary")
def comparison_summary(t):
    s = H.summary(_compared(t))
    return s.withColumns({c: F.round(c, 6) for c in ("avg_field_coverage_pct", "avg_purpose_overlap_pct")})


_TEXT = f"""
lines AS (
  SELECT element_id, 0 AS a, 0 AS b, '=== ' || element_id || ' ===' || CASE WHEN reference_id <> element_id THEN ' (mapped to ' || reference_id || ')' ELSE '' END AS t FROM facts
  UNION ALL SELECT element_id, 1, 0, '  Matched fields:  ' || CASE WHEN len(matched) = 0 THEN '(none)' ELSE array_to_string(matched, ', ') END FROM fields
  UNION ALL SELECT element_id, 2, 0, '  Missing fields:  ' || array_to_string(missing, ', ') FROM fields WHERE len(missing) > 0
  UNION ALL SELECT element_id, 3, 0, '  Extra fields:    ' || array_to_string(extra, ', ') FROM fields WHERE len(extra) > 0
  UNION ALL SELECT element_id, 4, 0, '' FROM facts
  UNION ALL SELECT element_id, 5, unnest([0, 1, 2, 3, 4]), unnest(['  purpose:', '    REFERENCE: "' || r_purpose || '"', '    EXTRACTED: "' || e_purpose || '"',
     '    Keywords overlap: ' || o || '/' || n || ' (' || CAST(round_even(o / n * 100, 0) AS BIGINT) || '%)', '']) FROM purpose
  UNION ALL SELECT element_id, CASE field WHEN 'preconditions' THEN 6 ELSE 7 END, unnest(range(0, 2 + len(u) + 1)), unnest(list_concat(
     ['  ' || field || ':', '    ' || matched || '/' || total || ' covered' || CASE WHEN field_missing THEN ' (field missing)' ELSE '' END],
     list_concat(list_transform(u, lambda x: '      missing: "' || x || '"'), ['']))) FROM (
       SELECT *, CASE WHEN uncovered = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(uncovered, '|') END AS u FROM details)
  UNION ALL SELECT element_id, 8, 0, '  trust_boundary:' FROM facts WHERE r_has_trust
  UNION ALL SELECT element_id, 8, CASE key WHEN 'input_trust' THEN 1 WHEN 'output_trust' THEN 2 ELSE 3 END, '    ' || key || '=' || status FROM trust
  UNION ALL SELECT element_id, 8, 9, '' FROM facts WHERE r_has_trust
  UNION ALL SELECT element_id, 9, unnest([0, 1, 2]), unnest(['  error_severity_levels:', '    ' || CASE WHEN r_sev IS NOT DISTINCT FROM e_sev THEN 'MATCH' ELSE 'MISMATCH' END
     || ' — ref: [' || coalesce('''' || r_sev || '''', '') || '], extracted: [' || coalesce('''' || e_sev || '''', '') || ']', ''])
     FROM facts WHERE r_err_base IS NOT NULL AND e_err_base IS NOT NULL)"""


@query("comparison_text", f"""{_PAIRS}, {_FIELDS}, {_DETAILS}, {_TRUST}, {_PURPOSE}, {_TEXT}
SELECT element_id, CAST(row_number() OVER (PARTITION BY element_id ORDER BY a, b) - 1 AS INT) AS ord, t AS text FROM lines""")
def comparison_text(t):
    return H.comparison_text(_compared(t)).select("element_id", "ord", "text")


@query("comparison_files", f"""{_PAIRS}, {_FIELDS}, {_DETAILS}, {_TRUST}, {_PURPOSE}, {_TEXT}
SELECT element_id, CAST(row_number() OVER (PARTITION BY element_id ORDER BY a, b) - 1 AS INT) AS ord, t AS text FROM lines
UNION ALL SELECT element_id, -1, 'skipped' FROM ext WHERE reference_id NOT IN (SELECT reference_id FROM ref)""")
def comparison_files(t):
    """Comparisons and skipped elements are written, read back and shown."""
    path = f"{shared_folder(t.spark)}/specframe/comparisons-{uuid.uuid4().hex}"
    pairs, skipped = _pairs(t)
    tables = {"comparisons": H.compare_elements(pairs), "skipped": skipped}
    write_comparisons(tables, path)
    back = read_comparisons(t.spark, path, {name: df.schema for name, df in tables.items()})
    return H.comparison_text(back["comparisons"]).select("element_id", "ord", "text").unionByName(
        back["skipped"].select("element_id", F.lit(-1).alias("ord"), F.lit("skipped").alias("text")))


@query("comparison_summary_text", f"""{_PAIRS}, {_FIELDS}, {_DETAILS}, {_TRUST}, {_PURPOSE}, {_SUMMARY}
SELECT unnest([0, 1, 2, 3, 4, 5]) AS ord, unnest(['Summary:', '  Elements compared: ' || elements_compared,
  '  Avg field coverage: ' || CAST(round_even(avg_field_coverage_pct, 0) AS BIGINT) || '%',
  '  Avg keyword overlap (purpose): ' || CAST(round_even(avg_purpose_overlap_pct, 0) AS BIGINT) || '%',
  '  Elements with all error_conditions: ' || full_error_coverage || '/' || elements_with_error_conditions,
  '  Elements with matching trust_boundary: ' || trust_boundary_match || '/' || elements_with_trust_boundary]) AS text FROM summary""")
def comparison_summary_text(t):
    return H.summary_text(H.summary(_compared(t)))
