"""Prompt, response and quality operators on the test tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..operators import prompts as G
from ..operators import quality as Q
from ..operators import responses as R
from ..operators import selection
from ..operators.documents import check_documents
from ..runtime import shared_folder
from . import jobs
from .queries_graph import LINE_POS, _GROUPS, line_pos, order_elements
from .registry import Tables, query

c = F.col
NOW = "2024-05-01T00:00:00+00:00"


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def contexts(t: Tables) -> DataFrame:
    """Conversations as retrieved context: assistant turns are hits."""
    return t.conversations.select(
        F.lit("shop").alias("project_id"), _text("c", c("conv_id")).alias("node_ref"), c("turn").alias("ord"),
        F.when(c("role") == "assistant", F.lit("hit")).otherwise(c("role")).alias("relationship"), "text")


_CONTEXT = f"""
cx AS (SELECT conv_id, turn, role = 'assistant' AS hit, text FROM conversations WHERE text <> ''),
ctx AS (SELECT 'c' || conv_id AS node_ref, coalesce(arg_max(text, turn) FILTER (hit), arg_min(text, turn)) AS src,
  coalesce((SELECT string_agg(y.text, E'\\n\\n' ORDER BY y.turn) FROM cx y WHERE y.conv_id = cx.conv_id AND NOT y.hit AND y.turn > (SELECT min(turn) FROM cx z WHERE z.conv_id = cx.conv_id)),
   '{K.NO_CONTEXT}') AS rel FROM cx GROUP BY conv_id)"""


@query("split_context", f"WITH {_CONTEXT} SELECT node_ref, src AS source_code, rel AS structural_context FROM ctx")
def split_context(t):
    return G.split_context(contexts(t)).select("node_ref", "source_code", "structural_context")


@query("related_contexts", """SELECT 'c' || conv_id AS node_ref, turn AS ord, text FROM conversations c WHERE role <> 'assistant' AND turn > (SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id)""")
def related_contexts(t):
    return G.related_contexts(contexts(t)).select("node_ref", "ord", "text")


def prompt_inputs(t: Tables):
    """Units from orders and lines, findings from suppliers, one package per nation."""
    e = order_elements(
        t, (_text("src/c", c("o_custkey"), ".py").alias("file"), c("o_custkey").cast("int").alias("line"), _text("c", c("o_custkey")).alias("node_ref")),
        (_text("src/s", c("l_suppkey"), ".py").alias("file"), F.when(c("l_tax") > 0.02, c("l_linenumber")).alias("line"),
         _text("c", c("l_partkey")).alias("node_ref")))
    findings = t.supplier.select(
        F.lit("shop").alias("project_id"), c("s_suppkey").alias("seq"), _text("/s", c("s_suppkey"), ".py").alias("file"), F.lit("R1").alias("rule_id"),
        F.lit("low").alias("severity"), c("s_name").alias("message"))
    deps = t.nation.select(
        F.lit("shop").alias("project_id"), c("n_nationkey").alias("pos"),
        F.array(F.struct(c("n_name").alias("id"), F.lit("HIGH").alias("severity"), F.lit("s").alias("summary"))).alias("cves"))
    return selection.group_elements(e), e, findings, deps


_PROMPT = f"""
pl AS (SELECT 'cls:o' || o_orderkey AS element_id, 'class' AS lvl, 'src/c' || o_custkey || '.py' AS file, CAST(o_custkey AS INT) AS line, 'c' || o_custkey AS node_ref, NULL AS supp FROM orders
  UNION ALL SELECT 'fn:l' || {LINE_POS}, 'function', 'src/s' || l_suppkey || '.py', CASE WHEN l_tax > 0.02 THEN l_linenumber END, 'c' || l_partkey, l_suppkey FROM lineitem),
cve AS (SELECT 'Known CVEs for this codebase:' || E'\\n' || string_agg('- ' || n_name || ' (HIGH): s', E'\\n' ORDER BY n_nationkey) AS cves FROM nation),
body AS (SELECT g.*, pl.*, coalesce(src, '{K.NO_SOURCE}') AS source, coalesce(rel, '{K.NO_CONTEXT}') AS structure,
   CASE WHEN s_suppkey IS NOT NULL THEN 'Relevant security findings:' || E'\\n- R1: R1 (severity: low) — ' || s_name || E'\\n\\n' ELSE '' END || cves AS section
  FROM grp g JOIN pl ON pl.element_id = g.group_id LEFT JOIN ctx USING (node_ref) LEFT JOIN supplier ON s_suppkey = supp, cve),
prm AS (SELECT group_id, everyone, CASE type WHEN 'class' THEN '{K.PROMPT_CLASS_OPENING}' || E'\\n\\nElements:\\n  - ' || replace(everyone, ',', E'\\n  - ') || E'\\n'
   ELSE 'Extract the behavioral contract for the following ' || lvl || E'.\\n\\nElement: ' || group_id || E'\\nFile: ' || file || E'\\nLine: ' || coalesce(CAST(line AS VARCHAR), 'unknown') || E'\\n' END
  || E'\\nSource code:\\n```\\n' || source || E'\\n```\\n\\nStructural context:\\n' || structure || E'\\n\\nIMPORTANT — ' || section
  || E'\\n\\nYou MUST incorporate these findings into the contract''s error_conditions and trust_boundary fields.\\n\\n'
  || CASE type WHEN 'class' THEN '{K.PROMPT_CLASS_CLOSING}' ELSE '{K.PROMPT_SINGLE_CLOSING}' END AS prompt FROM body)"""


@query("prompts", f"WITH {_GROUPS}, {_CONTEXT}, {_PROMPT} SELECT group_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS INT) AS chars, everyone AS expected FROM prm")
def prompts(t):
    groups, elements, findings, deps = prompt_inputs(t)
    return G.prompts(groups, elements, contexts(t), findings, deps).select(
        "group_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").alias("chars"), F.array_join("expected_ids", ",").alias("expected"))


def _contracts(prompt: str) -> str:
    """An answer to any prompt: the prompt's length as the purpose of each element."""
    lines = prompt.split("\n")
    purpose = {"purpose": f"n{len(prompt)}"}
    if lines[0] != K.PROMPT_CLASS_OPENING:
        return json.dumps(purpose)
    first = lines.index("Elements:") + 1
    return json.dumps({line[4:]: purpose for line in lines[first:lines.index("", first)]})


def _sometimes(prompt: str) -> str:
    """The same, but most prompts fail or get half an answer."""
    if len(prompt) % 3 == 0:
        raise ValueError("busy")
    return _contracts(prompt)[:-1] if len(prompt) % 3 == 1 else _contracts(prompt)


@query("extraction_job", f"""WITH {_GROUPS}, {_CONTEXT}, {_PROMPT}
SELECT unnest(string_split(everyone, ',')) AS element_id, 'n' || length(prompt) AS purpose, 'medium/needs_review' AS provenance FROM prm""")
def extraction_job(t):
    """Two runs: most units fail in the first, and all are complete after the second."""
    groups, elements, findings, deps = prompt_inputs(t)
    tables = {"elements": elements.withColumn("contract", F.lit(None).cast(S.struct(S.CONTRACT))).withColumn(
        "metadata", F.lit(None).cast(S.struct(S.METADATA))), "findings": findings, "dependencies": deps}
    path = f"{shared_folder(t.spark)}/specframe/answers-{uuid.uuid4().hex}"
    jobs.extract(tables, contexts(t), _sometimes, path, "m1", NOW)
    done = jobs.extract(tables, contexts(t), _contracts, path, "m1", NOW, batches=2)
    return done["elements"].select("element_id", "contract.purpose", F.concat_ws("/", "metadata.confidence", "metadata.status").alias("provenance"))


def _mostly(prompt: str) -> str:
    """Answers to class groups lack the last element."""
    answer = json.loads(_contracts(prompt))
    return json.dumps(dict(list(answer.items())[:-1])) if prompt.startswith(K.PROMPT_CLASS_OPENING) else json.dumps(answer)


@query("extraction_job_partial", f"""WITH {_GROUPS}, {_CONTEXT}, {_PROMPT},
el AS (SELECT prompt, string_split(everyone, ',') AS ids, unnest(string_split(everyone, ',')) AS element_id FROM prm),
lost AS (SELECT *, length(prompt) % 3 <> 2 AND starts_with(prompt, '{K.PROMPT_CLASS_OPENING}') AND element_id = ids[-1] AS gone FROM el)
SELECT element_id, CASE WHEN NOT gone THEN 'n' || length(prompt) END AS purpose, CASE WHEN gone THEN '' ELSE 'medium/needs_review' END AS provenance,
  count(*) FILTER (gone) OVER () AS failures, count(*) FILTER (NOT gone) OVER () AS successes FROM lost""")
def extraction_job_partial(t):
    """Two runs after which class groups lack an element: the contracts of the others stay."""
    groups, elements, findings, deps = prompt_inputs(t)
    tables = {"elements": elements.withColumn("contract", F.lit(None).cast(S.struct(S.CONTRACT))).withColumn(
        "metadata", F.lit(None).cast(S.struct(S.METADATA))), "findings": findings, "dependencies": deps}
    path = f"{shared_folder(t.spark)}/specframe/answers-{uuid.uuid4().hex}"
    jobs.extract(tables, contexts(t), _sometimes, path, "m1", NOW)
    done = jobs.extract(tables, contexts(t), _mostly, path, "m1", NOW)
    return done["elements"].join(done["outcomes"].select("project_id", "failures", "successes"), "project_id").select(
        "element_id", "contract.purpose", F.concat_ws("/", "metadata.confidence", "metadata.status").alias("provenance"), "failures", "successes")


def _answer(prompt: str) -> str:
    if "\n" not in prompt:
        raise ValueError("one line")
    return '{"purpose": "' + str(len(prompt)) + '"}'


def document_responses(t: Tables) -> DataFrame:
    g = _text("d", c("doc_id"))
    p = t.spread("documents").select(
        F.lit("docs").alias("project_id"), g.alias("group_id"), F.lit("single").alias("type"), F.array(g).alias("expected_ids"),
        c("text").alias("prompt"), F.lit(None).cast("string").alias("error"))
    return G.batch_infer(p, _answer)


@query("batch_infer", """SELECT 'd' || doc_id AS group_id, CASE WHEN contains(text, chr(10)) THEN '{"purpose": "' || length(text) || '"}' END AS raw,
  CASE WHEN NOT contains(text, chr(10)) THEN 'one line' END AS error FROM documents""")
def batch_infer(t):
    return document_responses(t).select("group_id", "raw", "error")


# -- responses: events as single answers, orders as answers for a class group ----

def event_responses(t: Tables) -> DataFrame:
    u = c("user_id")
    raw = F.when(c("event_type") == "click", _text(
        '```json\n{"purpose": "click ', u, '", "preconditions": "user ', u, '", "unknown": 1, "thread_safety": null}\n```')).when(
        c("event_type") == "view", _text(
            '  {"preconditions": ["plain", {"k": ', u, ', "z": "", "a": "text"}, 7], "postconditions": {"x": "one", "y": "", "w": "two"}, "invariants": 5} \n')).when(
        c("event_type") == "error", _text("not json ", u)).when(
        c("event_type") == "signup", _text('{"trust_boundary": {"input_trust": "root", "output_trust": "trusted", "sanitization": null}, "purpose": "sign ', u, '"}')).otherwise(
        _text('```{"error_conditions": [{"condition": "c', u, '", "behavior": "b", "severity": "fatal", "class": "X"}, "skip", {"condition": "d", "severity": "odd"}], '
              '"state_transitions": [{"from_state": "a", "to_state": "b"}], "purpose": "old", "purpose": "new"}```'))
    g = _text("e", c("event_id"))
    return t.spread("events").select(F.lit("site").alias("project_id"), g.alias("group_id"), F.lit("single").alias("type"), F.array(g).alias("expected_ids"),
                           raw.alias("raw"), F.lit(None).cast("string").alias("error"))


def order_responses(t: Tables) -> DataFrame:
    k = _text("o", c("o_orderkey"))
    both = _text('{"', k, '": {"purpose": "', c("o_orderpriority"), '"}, "', k, '/m": {"side_effects": ["writes"]}, "zzz": {}}')
    one = _text('{"', k, '": {"purpose": "', c("o_orderpriority"), '"}}')
    bad = _text('{"', k, '": {"purpose": "x"}, "', k, '/m": "text"}')
    raw = F.when(c("o_orderstatus") == "F", both).when(c("o_orderstatus") == "O", one).otherwise(bad)
    raw = F.when(c("o_orderpriority") == "5-LOW", F.lit("[1, 2]")).otherwise(raw)
    return t.spread("orders").select(F.lit("shop").alias("project_id"), k.alias("group_id"), F.lit("class").alias("type"), F.array(k, _text(k, "/m")).alias("expected_ids"),
                           raw.alias("raw"), F.lit(None).cast("string").alias("error"))


_PARSED = """
pe AS (SELECT 'site' AS project_id, 'e' || event_id AS element_id, event_type <> 'error' AS found,
  CASE event_type WHEN 'click' THEN 'click ' || user_id WHEN 'signup' THEN 'sign ' || user_id WHEN 'purchase' THEN 'new' END AS purpose,
  CASE event_type WHEN 'click' THEN 'user ' || user_id WHEN 'view' THEN 'plain|' || CASE WHEN user_id <> 0 THEN user_id || ': ' ELSE '' END || 'text|7' END AS preconditions,
  CASE event_type WHEN 'view' THEN 'x: one|w: two' END AS postconditions, CASE event_type WHEN 'view' THEN '5' END AS invariants, NULL AS side_effects,
  CASE event_type WHEN 'signup' THEN 'mixed/trusted/-' END AS trust, CASE event_type WHEN 'purchase' THEN 'c' || user_id || ',b,fatal|d,-,-' END AS errors,
  CASE event_type WHEN 'purchase' THEN 'a>b' END AS transitions, CASE event_type WHEN 'error' THEN 'e' || event_id || ': response is not JSON' END AS error FROM events),
po AS (SELECT 'shop' AS project_id, 'o' || o_orderkey || m AS element_id, CASE WHEN o_orderpriority = '5-LOW' THEN false WHEN o_orderstatus = 'F' THEN true WHEN o_orderstatus = 'O' THEN m = '' ELSE false END AS found,
  CASE WHEN m = '' AND o_orderstatus IN ('F', 'O') AND o_orderpriority <> '5-LOW' THEN o_orderpriority END AS purpose, NULL AS preconditions, NULL AS postconditions, NULL AS invariants,
  CASE WHEN m = '/m' AND o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN 'writes' END AS side_effects, NULL AS trust, NULL AS errors, NULL AS transitions,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'o' || o_orderkey || m || ': missing from class group response' WHEN o_orderstatus = 'P' THEN 'o' || o_orderkey || ': contract is not an object'
    WHEN o_orderstatus = 'O' AND m = '/m' THEN 'o' || o_orderkey || m || ': missing from class group response' END AS error
  FROM orders, (VALUES (''), ('/m')) v(m)),
parsed AS (SELECT * FROM pe UNION ALL SELECT * FROM po)"""


def parsed(t: Tables) -> DataFrame:
    return R.parse_responses(event_responses(t).unionByName(order_responses(t)))


def _flat(contract: str = "contract"):
    f = lambda x: c(f"{contract}.{x}")
    dash = lambda v: F.coalesce(v, F.lit("-"))
    return [
        f("purpose").alias("purpose"), *[F.array_join(f(x), "|").alias(x) for x in K.TEXT_ARRAY_FIELDS],
        F.when(f("trust_boundary").isNotNull(), F.concat_ws("/", dash(f("trust_boundary.input_trust")), dash(f("trust_boundary.output_trust")), dash(f("trust_boundary.sanitization")))).alias("trust"),
        F.array_join(F.transform(f("error_conditions"), lambda e: F.concat_ws(",", dash(e["condition"]), dash(e["behavior"]), dash(e["severity"]))), "|").alias("errors"),
        F.array_join(F.transform(f("state_transitions"), lambda s: F.concat_ws(">", s["from_state"], s["to_state"])), "|").alias("transitions")]


@query("parse_responses", f"WITH {_PARSED} SELECT element_id, found, purpose, preconditions, postconditions, invariants, side_effects, trust, errors, transitions, error FROM parsed")
def parse_responses(t):
    return parsed(t).select("element_id", "found", *_flat(), "error")


@query("run_outcomes", f"WITH {_PARSED} SELECT project_id, count(*) FILTER (found) AS successes, count(*) FILTER (NOT found) AS failures FROM parsed GROUP BY project_id")
def run_outcomes(t):
    return R.run_outcomes(parsed(t))[0]


@query("run_errors", f"WITH {_PARSED} SELECT DISTINCT error FROM parsed WHERE error IS NOT NULL")
def run_errors(t):
    return R.run_outcomes(parsed(t))[1].select("error")


def response_elements(t: Tables) -> DataFrame:
    """Elements the responses speak about, and some they do not."""
    row = lambda df, project, eid: df.select(F.lit(project).alias("project_id"), eid.alias("element_id"))
    ids = row(t.events, "site", _text("e", c("event_id"))).unionByName(row(t.orders, "shop", _text("o", c("o_orderkey")))).unionByName(
        row(t.customer, "shop", _text("c", c("c_custkey"))))
    old = F.when(F.startswith("element_id", F.lit("c")), F.from_json(F.lit('{"purpose": "kept"}'), S.CONTRACT))
    meta = F.struct(*[F.lit(v).alias(k) for k, v in K.SCANNED.items()])
    return ids.select("project_id", "element_id", old.alias("contract"), meta.alias("metadata"))


_MERGED = f"""
all_e AS (SELECT 'site' AS project_id, 'e' || event_id AS element_id, NULL AS kept FROM events UNION ALL SELECT 'shop', 'o' || o_orderkey, NULL FROM orders UNION ALL SELECT 'shop', 'c' || c_custkey, 'kept' FROM customer),
merged AS (SELECT a.project_id, a.element_id, coalesce(p.found, false) AS hit, CASE WHEN coalesce(p.found, false) THEN p.purpose ELSE kept END AS purpose FROM all_e a LEFT JOIN parsed p USING (element_id))"""


@query("merge_contracts", f"""WITH {_PARSED}, {_MERGED} SELECT element_id, purpose, CASE WHEN hit THEN 'medium/llm_inference/needs_review' ELSE 'high/static_analysis/extracted' END AS provenance,
  CASE WHEN hit THEN 'extract-contracts/m1' END AS updated_by, CASE WHEN hit THEN '{NOW}' END AS updated_at FROM merged""")
def merge_contracts(t):
    return R.merge_contracts(response_elements(t), parsed(t), "m1", NOW).select(
        "element_id", "contract.purpose", F.concat_ws("/", "metadata.confidence", "metadata.source", "metadata.status").alias("provenance"), "metadata.updated_by", "metadata.updated_at")


@query("enrichment_checks", f"""WITH {_PARSED}, {_MERGED}, s AS (SELECT project_id, count(*) FILTER (NOT starts_with(element_id, 'c') AND coalesce(purpose, '') = '') AS a,
   count(*) FILTER (NOT starts_with(element_id, 'c') AND NOT hit) AS b FROM merged GROUP BY project_id)
SELECT project_id, 'purpose_missing' AS "check", a AS failures FROM s UNION ALL SELECT project_id, 'wrong_provenance', b FROM s UNION ALL SELECT project_id, 'changed_out_of_scope', 0 FROM s""")
def enrichment_checks(t):
    before = response_elements(t)
    after = R.merge_contracts(before, parsed(t), "m1", NOW)
    return R.enrichment_checks(before, after, before.filter(~F.startswith("element_id", F.lit("c"))))


# -- quality ---------------------------------------------------------------

@query("document_violations", """
WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT 'docs' AS project_id, 'd' || doc_id || '.quality' AS path, 'required' AS rule, '''quality'' is a required property' AS message FROM d WHERE quality IS NULL
UNION ALL SELECT 'docs', 'd' || doc_id || '.lang', 'enum', '''' || lang || ''' is not one of [''en'', ''fr'']' FROM d WHERE lang NOT IN ('en', 'fr')
UNION ALL SELECT 'docs', 'd' || doc_id || '.source', 'const', '''src0'' was expected, got ''' || source || '''' FROM d WHERE source <> 'src0'
UNION ALL SELECT 'docs', 'd' || doc_id || '.n_chars', 'range', n_chars || ' is not between 100 and 3000' FROM d WHERE NOT n_chars BETWEEN 100 AND 3000
UNION ALL SELECT 'docs', 'd' || doc_id || '.toxic', 'enum', '''' || toxic || ''' is not one of [0]' FROM d WHERE toxic <> 0""")
def document_violations(t):
    docs = t.documents.join(t.labels, "doc_id", "left").withColumn("project_id", F.lit("docs"))
    return Q.violations(docs, [
        Q.required("quality"), Q.one_of("lang", ["en", "fr"]), Q.constant("source", "src0"), Q.in_range("n_chars", 100, 3000), Q.one_of("toxic", [0])],
        _text("d", c("doc_id")))


@query("event_violations", """
SELECT 'site' AS project_id, '(root)' AS path, 'unknown_key' AS rule, 'unexpected keys: k' AS message FROM events
UNION ALL SELECT 'site', 'event_type', 'type', '''' || event_type || ''' is not of type int' FROM events""")
def event_violations(t):
    return Q.violations(t.events.withColumn("project_id", F.lit("site")), [
        Q.known_keys("props", ["x"], ""), Q.of_type("event_type", "int"), Q.of_type("props", "string")])


@query("spec_violations", """
WITH m AS (SELECT o_orderkey, o_orderstatus AS s, o_orderpriority AS p FROM orders)
SELECT 'o' || o_orderkey AS project_id, 'meta.spec_version' AS path, 'const' AS rule, '''0.1.0'' was expected, got ''' || s || '''' AS message FROM m
UNION ALL SELECT 'o' || o_orderkey, 'elements.e' || o_orderkey || '.hierarchy_level', 'enum', '''' || s || ''' is not one of [''system'', ''subsystem'', ''module'', ''class'', ''function'']' FROM m
UNION ALL SELECT 'o' || o_orderkey, 'elements.e' || o_orderkey || '.node_ref', 'required', '''node_ref'' is a required property' FROM m WHERE s = 'P'
UNION ALL SELECT 'o' || o_orderkey, 'elements.e' || o_orderkey || '.metadata.status', 'required', '''status'' is a required property' FROM m WHERE p = '5-LOW'
UNION ALL SELECT 'o' || o_orderkey, 'elements.e' || o_orderkey || '.contract.error_conditions', 'enum', 'unknown severities: ' || s FROM m""")
def spec_violations(t):
    k = c("o_orderkey")
    project = _text("o", k).alias("project_id")
    meta = t.orders.select(project, F.lit("x").alias("project_name"), c("o_orderstatus").alias("spec_version"), F.lit(NOW).alias("created_at"), F.lit(None).cast("string").alias("updated_at"))
    contract = F.from_json(_text('{"error_conditions": [{"condition": "c", "behavior": "b", "severity": "', c("o_orderstatus"), '"}]}'), S.CONTRACT)
    status = F.when(c("o_orderpriority") != "5-LOW", F.lit("confirmed"))
    elements = t.orders.select(
        project, _text("e", k).alias("element_id"), c("o_orderstatus").alias("hierarchy_level"), F.when(c("o_orderstatus") != "P", F.lit("n")).alias("node_ref"), F.lit("x").alias("name"),
        contract.alias("contract"), F.struct(F.lit("high").alias("confidence"), F.lit("human_input").alias("source"), status.alias("status"), F.lit("agent").alias("assigned_to")).alias("metadata"))
    return Q.spec_violations({"meta": meta, "elements": elements})


@query("raw_spec_violations", """
SELECT 'o' || o_orderkey AS project_id, '(root)' AS path, 'required' AS rule, '''cpg_ref'' is a required property' AS message FROM orders
UNION ALL SELECT 'o' || o_orderkey, '(root)', 'unknown_key', 'unexpected keys: extra' FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'elements.e.contract', 'unknown_key', 'unexpected keys: ' || o_orderstatus FROM orders
UNION ALL SELECT 'o' || o_orderkey, 'elements.e.line', 'type', '''' || o_orderpriority || ''' is not of type int' FROM orders""")
def raw_spec_violations(t):
    docs = t.orders.select(_text("o", c("o_orderkey")).alias("project_id"), _text(
        '{"meta": {"project_name": "x"}, "extra": 1, "elements": {"e": {"name": "n", "line": "', c("o_orderpriority"), '", "contract": {"', c("o_orderstatus"), '": 1}, "metadata": {"status": "x"}}}}').alias("doc"))
    return Q.document_violations(docs)


_M = '{"confidence": "high", "source": "human_input", "status": "confirmed"'
_BROKEN_DOC = (
    '{"S": 1, "meta": {"project_name": "x", "spec_version": "T", "S": 1}, "cpg_ref": {"path": "p", "S": 1, "stats": {"nodes": 1.0, "call_resolution_pct": N, "S": 1}},'
    ' "ecosystem_dependencies": [{"package": "a", "ecosystem": "b", "metadata": ' + _M + '}}, {"package": "a", "ecosystem": "b", "S": 1, "metadata": ' + _M + '},'
    ' "cves": [{"id": "C", "severity": "HIGH"}, {"id": "D", "severity": "T", "S": 1}], "eol": {"is_eol": null, "confidence": null, "S": 1}}],'
    ' "security_findings": [{"file": "f", "line": L, "rule_id": "r", "severity": "high", "S": 1, "metadata": ' + _M + '},'
    ' "compliance": {"S": 1, "owasp_asvs": [{"id": "1"}, {"S": 1}], "asd_stig": [{"S": 1}], "pci_dss": ["x", N]}}],'
    ' "elements": {"e.K": {"hierarchy_level": "class", "node_ref": "n", "name": "x", "S": 1, "metadata": ' + _M + ', "S": 1},'
    ' "contract": {"S": 1, "error_conditions": [{"condition": "c", "behavior": "b"}, {"condition": "c", "S": 1}], "state_transitions": [{"S": 1}], "trust_boundary": {"input_trust": "T", "S": 1}},'
    ' "data_model": {"S": 1, "entities": [{"name": "a", "S": 1, "fields": [{}, {"S": 1}]}, {}], "relationships": [{"S": 1}]}}},'
    ' "usage_paths": [{"id": "u", "name": "x", "nodes": N, "S": 1, "metadata": ' + _M + '}}]}')
_CLOSED = [
    "(root)", "meta", "cpg_ref", "cpg_ref.stats", "ecosystem_dependencies.1", "ecosystem_dependencies.1.cves.1", "ecosystem_dependencies.1.eol", "security_findings.0",
    "security_findings.0.compliance", "security_findings.0.compliance.owasp_asvs.1", "security_findings.0.compliance.asd_stig.0", "elements.e.K", "elements.e.K.metadata",
    "elements.e.K.contract", "elements.e.K.contract.error_conditions.1", "elements.e.K.contract.state_transitions.0", "elements.e.K.contract.trust_boundary",
    "elements.e.K.data_model", "elements.e.K.data_model.entities.0", "elements.e.K.data_model.entities.0.fields.1", "elements.e.K.data_model.relationships.0", "usage_paths.0"]


@query("all_spec_violations", f"""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS t, CAST(o_orderkey % 150 AS VARCHAR) AS n,
  CASE o_orderstatus WHEN 'P' THEN '"' || o_orderpriority || '"' ELSE o_orderkey || '.5' END AS l FROM orders)
SELECT 'o' || k AS project_id, replace(p, 'K', CAST(k AS VARCHAR)) AS path, 'unknown_key' AS rule, 'unexpected keys: ' || s AS message FROM o, (SELECT unnest({_CLOSED}) AS p)
UNION ALL SELECT 'o' || k, 'meta.spec_version', 'const', '''0.1.0'' was expected, got ''' || t || '''' FROM o
UNION ALL SELECT 'o' || k, 'cpg_ref.stats.call_resolution_pct', 'range', n || ' is not between 0 and 100' FROM o WHERE k % 150 > 100
UNION ALL SELECT 'o' || k, 'security_findings.0.line', 'type', '''' || trim(l, '"') || ''' is not of type integer' FROM o
UNION ALL SELECT 'o' || k, 'security_findings.0.compliance.pci_dss.1', 'type', '''' || n || ''' is not of type string' FROM o
UNION ALL SELECT 'o' || k, 'usage_paths.0.nodes', 'type', '''' || n || ''' is not of type array' FROM o
UNION ALL SELECT 'o' || k, 'elements.e.' || k || '.contract.error_conditions.1', 'required', '''behavior'' is a required property' FROM o
UNION ALL SELECT 'o' || k, 'elements.e.' || k || '.data_model.entities.1', 'required', '''name'' is a required property' FROM o
UNION ALL SELECT 'o' || k, 'ecosystem_dependencies.1.cves.1.severity', 'enum', '''' || t || ''' is not one of [''CRITICAL'', ''HIGH'', ''MEDIUM'', ''LOW'']' FROM o
UNION ALL SELECT 'o' || k, 'ecosystem_dependencies.1.eol.confidence', 'enum', '''null'' is not one of [''high'', ''medium'', ''low'']' FROM o
UNION ALL SELECT 'o' || k, 'elements.e.' || k || '.contract.trust_boundary.input_trust', 'enum', '''' || t || ''' is not one of [''trusted'', ''untrusted'', ''mixed'', ''n/a'']' FROM o""")
def all_spec_violations(t):
    """One document per order that breaks every closed object."""
    number = F.when(c("o_orderstatus") == "P", _text('"', c("o_orderpriority"), '"')).otherwise(_text(c("o_orderkey"), ".5"))
    doc = F.lit(_BROKEN_DOC)
    for mark, value in (('"S"', _text('"', c("o_orderstatus"), '"')), ('"T"', _text('"', c("o_orderpriority"), '"')), ("e.K", _text("e.", c("o_orderkey"))),
                        (": N", _text(": ", c("o_orderkey") % 150)), (", N", _text(", ", c("o_orderkey") % 150)), (": L", _text(": ", number))):
        doc = F.replace(doc, F.lit(mark), value)
    return check_documents(t.spread("orders").select(_text("o", c("o_orderkey")).alias("project_id"), doc.alias("doc")))
