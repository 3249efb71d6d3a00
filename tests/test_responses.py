"""Odd responses, provenance, prompts, and resumable runs."""

import json

import pytest
from pyspark.sql import functions as F

from specframe import schemas as S
from specframe.operators import prompts as G
from specframe.operators import responses as R
from specframe.operators import selection
from specframe.operators.blocks import assemble_text
from specframe.streaming.resumable import existing, resumable_apply, resumable_stream

RESPONSE = "project_id string, group_id string, type string, expected_ids array<string>, raw string, error string"


def parse(spark, raw, kind="single", ids=("a",), error=None):
    df = spark.createDataFrame([("p", ids[0], kind, list(ids), raw, error)], RESPONSE)
    return {r.element_id: r for r in R.parse_responses(df).collect()}


def contract(spark, value):
    r = parse(spark, value if isinstance(value, str) else json.dumps(value))["a"]
    return r.contract.asDict(recursive=True) if r.contract else None


def test_fences(spark):
    for raw in ('```json\n{"purpose": "x"}\n```', '```{"purpose": "x"}```', ' {"purpose": "x"}\n'):
        assert contract(spark, raw)["purpose"] == "x"


def test_failures(spark):
    assert parse(spark, "no json")["a"].error == "a: response is not JSON"
    assert parse(spark, "[1]")["a"].error == "a: contract is not an object"
    assert parse(spark, None, error="timeout")["a"].error == "a: timeout"
    both = parse(spark, '{"a": {"purpose": "x"}}', "class", ("a", "b"))
    assert both["a"].found and both["b"].error == "b: missing from class group response"
    assert not any(r.found for r in parse(spark, '{"a": {}, "b": 3}', "class", ("a", "b")).values())
    assert all(r.error.endswith("missing from class group response") for r in parse(spark, "[]", "class", ("a", "b")).values())


def test_one_value_and_nothing_else(spark):
    for raw in ('{"purpose": "x"} Hope this helps!', '{"purpose": "a"}{"purpose": "b"}', '{"purpose": "x"', '{},{}', '{}],[', '1,"v":2', ""):
        assert parse(spark, raw)["a"].error == "a: response is not JSON", raw


def test_text_that_looks_empty_is_kept(spark):
    c = contract(spark, {"preconditions": {"retries": "0", "none": 0, "off": False, "list": [], "text": "[]"},
                         "postconditions": [{"field": "flag", "value": "false"}, {"field": "flag", "value": False}, {"n": 0}]})
    assert c["preconditions"] == ["retries: 0", "text: []"]
    assert c["postconditions"] == ["flag: false", "flag", '{"n": 0}'.replace(" ", "")]


def test_polymorphic_fields(spark):
    c = contract(spark, {
        "purpose": "p", "preconditions": "one", "postconditions": ["a", {"x": "u", "y": "", "z": "v"}, 3], "invariants": {"k": "v", "e": ""},
        "side_effects": 5, "thread_safety": None, "extra": 1, "error_conditions": [{"condition": "c", "behavior": "b", "severity": "bad", "more": 1}, "text"],
        "trust_boundary": {"input_trust": ["x"], "output_trust": "n/a"}, "state_transitions": [{"from_state": "a", "to_state": "b", "trigger": "t"}]})
    assert c["preconditions"] == ["one"] and c["postconditions"] == ["a", "u: v", "3"]
    assert c["invariants"] == ["k: v"] and c["side_effects"] == ["5"] and c["thread_safety"] is None
    assert c["error_conditions"] == [{"condition": "c", "behavior": "b", "severity": None}]
    assert c["trust_boundary"] == {"input_trust": "mixed", "output_trust": "n/a", "sanitization": None}
    assert c["state_transitions"] == [{"from_state": "a", "to_state": "b", "trigger": "t"}]
    assert contract(spark, "{}") is None and contract(spark, {"other": 1}) is None


def test_last_duplicate_key_counts(spark):
    assert contract(spark, '{"purpose": "a", "purpose": "b"}')["purpose"] == "b"


def test_batch_infer_retries(spark, tmp_path):
    seen = str(tmp_path / "calls")

    def flaky(prompt):
        with open(seen, "a") as f:
            f.write("x")
        raise ConnectionError("down")

    df = spark.createDataFrame([("p", "a", "single", ["a"], "hello", None)], "project_id string, group_id string, type string, expected_ids array<string>, prompt string, error string")
    got = G.batch_infer(df, flaky, retries=2, wait_seconds=0.01).collect()
    assert [(r.raw, r.error) for r in got] == [(None, "down")] and open(seen).read() == "xxx"


def test_text_of_any_size_comes_out_whole(spark):
    lines = spark.createDataFrame([("a", i, str(i) * 400_000) for i in range(9, -1, -1)] + [("b", 0, "y")], "k string, ord int, text string")
    got = {r.k: r.text for r in assemble_text(lines, ["k"], ["ord"]).collect()}
    assert got == {"a": "\n".join(str(i) * 400_000 for i in range(10)), "b": "y"}


def test_context_rules(spark):
    rows = [("p", "n", 0, "caller", "first"), ("p", "n", 1, "hit", ""), ("p", "n", 2, "hit", "h1"), ("p", "n", 3, "callee", "c"), ("p", "n", 4, "hit", "h2"),
            ("p", "m", 0, "caller", "only"), ("p", "e", 0, "hit", "")]
    df = spark.createDataFrame(rows, "project_id string, node_ref string, ord long, relationship string, text string")
    got = {r.node_ref: (r.source_code, r.structural_context) for r in G.split_context(df).collect()}
    assert got == {"n": ("h2", "c"), "m": ("only", "(no additional structural context)"), "e": ("(source not available)", "(no additional structural context)")}


def test_resume(spark, tmp_path):
    work = spark.range(10).withColumn("k", F.col("id").cast("string"))
    path = str(tmp_path / "results")
    half = lambda df: df.filter("id < 5")
    assert resumable_apply(work, half, path, ["k"], batches=3).count() == 5
    assert resumable_apply(work, lambda df: df, path, ["k"]).count() == 10
    assert resumable_apply(work, lambda df: df, path, ["k"]).count() == 10


def test_resume_takes_only_a_missing_path_for_no_results(spark, tmp_path):
    broken = tmp_path / "results"
    broken.mkdir()
    (broken / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        resumable_apply(spark.range(3).withColumn("k", F.col("id").cast("string")), lambda df: df, str(broken), ["k"]).count()
    assert existing(spark, str(tmp_path / "none")) is None


def test_resume_stream(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        resumable_stream(source, lambda df: df, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_schema_of_contract(spark):
    assert [f.name for f in S.struct(S.CONTRACT)][:2] == ["purpose", "preconditions"]


def test_found_elements_are_parsed_once(spark):
    """Asking for found elements alone does not search the responses before and after they are exploded."""
    df = spark.createDataFrame([("p", "a", "single", ["a"], '{"purpose": "x"}', None)], RESPONSE)
    plan = R.parse_responses(df.repartition(2)).filter("found")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan.split("Generate", 1)[1]


def test_a_text_cannot_bring_its_own_end(spark):
    texts = ['{}', '{},"h0"', '{},"h"],["', '[1', '1],[2', ' 5 ', '']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.ok for r in df.select(R.is_one_json(F.col("t")).alias("ok")).collect()] == [True, False, False, False, False, True, False]


def prompt_tables(spark):
    groups = spark.createDataFrame([("p", f"g{i}", "single", None, [], [f"g{i}"]) for i in range(6)],
                                   "project_id string, group_id string, type string, class_id string, member_ids array<string>, all_ids array<string>")
    elements = spark.createDataFrame([("p", f"g{i}", "function", None if i == 5 else f"src/f{i % 2}.py", i, f"n{i % 3}") for i in range(6)],
                                     "project_id string, element_id string, hierarchy_level string, file string, line int, node_ref string")
    contexts = spark.createDataFrame([("p", "n0", 0, "hit", "code"), ("p", "n0", 1, "user", "more"), ("p", "n1", 0, "user", "only")],
                                     "project_id string, node_ref string, ord int, relationship string, text string")
    findings = spark.createDataFrame([("p", 1, "/f1.py", "R", "low", "m")], "project_id string, seq int, file string, rule_id string, severity string, message string")
    deps = spark.createDataFrame([("p", 0, [("C", "HIGH", "s")])], "project_id string, pos int, cves array<struct<id:string,severity:string,summary:string>>")
    return groups, elements, contexts, findings, deps


def test_prompts_deal_units_only_for_many_texts(spark, monkeypatch):
    """Few texts are sent to the units; many are joined by shuffles, with the same prompts."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    small = G.prompts(*prompt_tables(spark))
    assert plan(small).count("rightHint=(strategy=broadcast)") == 3
    monkeypatch.setattr(G, "FEW_CONTEXTS", 0)
    monkeypatch.setattr(G, "FEW_FINDINGS", 0)
    large = G.prompts(*prompt_tables(spark))
    assert plan(large).count("rightHint=(strategy=broadcast)") == 1
    rows = sorted(map(tuple, small.select("group_id", "prompt").collect()))
    assert rows == sorted(map(tuple, large.select("group_id", "prompt").collect())) and len(rows) == 6
    assert "code" in rows[0][1] and "more" in rows[0][1] and "R: R (severity: low)" in rows[1][1] and "R: R" not in rows[0][1]


def test_units_carry_only_what_prompts_need(spark, monkeypatch):
    written = {}
    monkeypatch.setattr(G, "materialize", lambda df, label: written.setdefault(label, df))
    G.prompts(*prompt_tables(spark))
    assert not {"member_ids", "class_id"} & set(written["prompt-units"].columns)


def test_pending_units_are_written_without_prompts(spark, tmp_path, monkeypatch):
    """Units are named and found again without their texts and without a look-up of their elements;
    a unit that lacks an element is asked again, a whole one is not."""
    from specframe.plans import jobs
    from specframe.streaming import resumable
    rows = [("p", "cls:a", 0, "class", None, "src/a.py", 1, "n0"), ("p", "fn:a/x", 1, "function", "cls:a", "src/x.py", 2, "n1"),
            ("p", "fn:a/y", 2, "function", "cls:a", "src/y.py", 3, "n1"), ("p", "fn:z", 3, "function", "mod:m", "src/z.py", None, "n2"), ("p", "mod:m", 4, "module", None, None, 1, "n0")]
    elements = spark.createDataFrame(rows, "project_id string, element_id string, pos int, hierarchy_level string, parent string, file string, line int, node_ref string")
    groups, plain = (selection.group_elements(elements.withColumn("contract", F.lit(None).cast("string")), keep=k) for k in (G.UNIT_FIELDS, ()))
    tables = prompt_tables(spark)[2:]
    text = lambda df: sorted(map(tuple, df.select("group_id", "prompt", "expected_ids").collect()))
    assert plain.columns == groups.columns[:6] and "file" not in plain.columns
    assert text(G.prompts(groups, elements, *tables)) == text(G.prompts(plain, elements, *tables)) and groups.count() == 3

    written = {}
    monkeypatch.setattr(resumable, "materialize", lambda df, label, inner=resumable.materialize: written.setdefault(label, []).append(inner(df, label)) or written[label][-1])
    spec = {"elements": elements.withColumns({"contract": F.lit(None).cast(S.struct(S.CONTRACT)), "metadata": F.lit(None).cast(S.struct(S.METADATA))}),
            "findings": tables[1], "dependencies": tables[2]}
    half = lambda prompt: json.dumps({"cls:a": {"purpose": "1"}, "fn:a/x": {"purpose": "1"}} if "  - cls:a" in prompt else {"purpose": "1"})
    whole = lambda prompt: json.dumps({e: {"purpose": "2"} for e in ("cls:a", "fn:a/x", "fn:a/y")})
    done = jobs.extract(spec, tables[0], half, str(tmp_path / "run"), "m", "now")
    assert done["outcomes"].collect()[0].asDict() == {"project_id": "p", "successes": 4, "failures": 1}
    done = jobs.extract(spec, tables[0], whole, str(tmp_path / "run"), "m", "now")
    assert done["outcomes"].collect()[0].asDict() == {"project_id": "p", "successes": 5, "failures": 0}
    assert {r.element_id: r.contract.purpose for r in done["elements"].collect()} == {"cls:a": "1", "fn:a/x": "1", "fn:a/y": "2", "fn:z": "1", "mod:m": "1"}
    assert [df.count() for df in written["pending"]] == [3, 1] and all("prompt" not in df.columns for df in written["pending"])
