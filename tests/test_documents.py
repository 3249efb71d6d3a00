"""Faults of whole documents, stated by hand and against a plain recursion."""

import json
import random

from specframe import constants as K
from specframe.operators.documents import check_documents

GOOD = {"confidence": "high", "source": "human_input", "status": "confirmed"}


def faults(spark, docs, **options):
    df = spark.createDataFrame(docs, "project_id string, doc string, path string, s string")
    out = check_documents(df, **options)
    assert out.columns == ["project_id", "path", "rule", "message"]
    return sorted(tuple(r) for r in out.collect())


def test_stated_cases(spark):
    spec = {"meta": {"project_name": "x", "spec_version": "0.1.0"}, "cpg_ref": {"path": "p"}, "elements": {}}
    docs = {
        "null": None, "empty": "", "cut": "{", "list": "[]", "twice": '{"meta": {}, "meta": {}}', "fine": json.dumps(spec),
        "builder": json.dumps({**spec, "cpg_ref": {"path": "p", "builder": "1"}}),
        "numbers": json.dumps({**spec, "cpg_ref": {"path": None, "stats": {"nodes": 2.0, "edges": 2.5, "files": True, "call_resolution_pct": -1}}}),
        "long": json.dumps({**spec, "usage_paths": [{"id": "u", "name": "x" * 3_000_000, "nodes": ["n"] * 50_000 + [1], "metadata": GOOD}]}),
    }
    no_object = lambda name, shown="null": (name, "(root)", "type", f"'{shown}' is not of type object")
    assert faults(spark, [(k, v, "x", "y") for k, v in docs.items()], version_key="builder") == sorted([
        no_object("null"), no_object("empty"), no_object("cut"), no_object("twice"), no_object("list", "[]"),
        ("numbers", "cpg_ref.path", "type", "'null' is not of type string"), ("numbers", "cpg_ref.stats.edges", "type", "'2.5' is not of type integer"),
        ("numbers", "cpg_ref.stats.files", "type", "'true' is not of type integer"),
        ("numbers", "cpg_ref.stats.call_resolution_pct", "range", "-1 is not between 0 and 100"),
        ("long", "usage_paths.0.nodes.50000", "type", "'1' is not of type string")])
    assert faults(spark, [("b", docs["builder"], "x", "y")]) == [("b", "cpg_ref", "unknown_key", "unexpected keys: builder")]
    assert faults(spark, []) == []


def expected(value, form, path):
    """(path, rule) of every fault below one value."""
    at = path or "(root)"
    is_number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if form in K.SPEC_VALUES:
        if value not in K.SPEC_VALUES[form]:
            yield at, "const" if form == "spec_version" else "enum"
    elif form in K.SPEC_OBJECTS:
        if not isinstance(value, dict):
            yield at, "type"
            return
        keys = K.SPEC_OBJECTS[form]
        for _ in set(K.SPEC_REQUIRED.get(form, ())) - set(value):
            yield at, "required"
        if set(value) - set(keys):
            yield at, "unknown_key"
        for key in set(value) & set(keys):
            yield from expected(value[key], keys[key], f"{path}.{key}" if path else key)
    elif form[0] in "[{":
        if not isinstance(value, list if form[0] == "[" else dict):
            yield at, "type"
            return
        for key, item in enumerate(value) if form[0] == "[" else value.items():
            yield from expected(item, form[1:-1], f"{path}.{key}")
    elif form == "percentage":
        if not is_number:
            yield at, "type"
        elif not 0 <= value <= 100:
            yield at, "range"
    else:
        fine = {"string": isinstance(value, str), "integer": is_number and value % 1 == 0, "boolean": isinstance(value, bool)}
        if not (fine[form.split()[0]] or (value is None and form.endswith("null"))):
            yield at, "type"


def made_up(rng, form):
    """A value of a form, now and then a wrong one."""
    if rng.random() < 0.06:
        return rng.choice([None, 1, 1.5, "x", True, [], {}, [1], {"a": {}}])
    if form in K.SPEC_VALUES:
        return rng.choice(K.SPEC_VALUES[form])
    if form in K.SPEC_OBJECTS:
        out = {k: made_up(rng, v) for k, v in K.SPEC_OBJECTS[form].items() if rng.random() < 0.8}
        return out | ({"other": 1, "a key.with dot": None} if rng.random() < 0.1 else {})
    if form[0] == "[":
        return [made_up(rng, form[1:-1]) for _ in range(rng.randrange(3))]
    if form[0] == "{":
        return {f"k.{i}": made_up(rng, form[1:-1]) for i in range(rng.randrange(3))}
    return {"string": "text", "integer": rng.choice([3, -4, 2.0, 10 ** 25]), "boolean": False, "percentage": rng.choice([0, 100, 100.5, 50.25])}[form.split()[0]]


def test_random_documents(spark):
    rng = random.Random(5)
    docs = {f"d{i}": made_up(rng, "spec") for i in range(300)}
    want = sorted((p, *fault) for p, doc in docs.items() for fault in expected(doc, "spec", ""))
    got = faults(spark, [(p, json.dumps(doc), None, None) for p, doc in docs.items()])
    assert len(want) > 1000 and {w[2] for w in want} == {"type", "required", "unknown_key", "enum", "const", "range"}
    assert [g[:3] for g in got] == want


def test_shown_values(spark):
    """Values in messages, as Spark casts them, and texts that are no JSON."""
    shown = lambda value: f'{{"meta": {value}, "cpg_ref": {{"path": "p"}}, "elements": {{}}}}'
    want = {
        "2.50": "2.5", "2.0": "2", "1e5": "100000.0", "12345678.9e0": "1.23456789E7", "1E-7": "1.0E-7", "-0.0": "0", "1.5e400": "Infinity",
        "1" * 30: "1" * 30, "1234567890" * 4 + "123": "1.2345678901234567E42", "0.00000001": "0.00000001", "true": "true", '"a\\u001fb\\n"': "a\x1fb\n", '"\\ud800x"': "?x",
        '[1.50, null, {"b": "\\u001f\\\\u00ab/\\"", "a": -1e3}]': '[1.5,null,{"a":-1000.0,"b":"\\u001F\\\\u00ab/\\""}]',
        "[" * 900 + "]" * 900: "[" * 900 + "]" * 900}
    docs = [(k[:50] + str(len(k)), shown(k), "x", "y") for k in want]
    assert faults(spark, docs) == sorted((k[:50] + str(len(k)), "meta", "type", f"'{v}' is not of type object") for k, v in want.items())
    broken = ['{"meta": NaN}', '{"a": 01}', "{'a': 1}", '{"a": 1,}', " {}", '{"a": "\t"}']
    assert faults(spark, [(b, b, "x", "y") for b in broken]) == sorted((b, "(root)", "type", "'null' is not of type object") for b in broken)


def test_documents_are_walked_once(spark):
    """One pass over the documents: no level of theirs is exploded."""
    df = spark.createDataFrame([("a", "{}")], "project_id string, doc string")
    plan = check_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Generate" not in plan and "Exchange" not in plan


def test_tables_between_steps_are_small(spark, tmp_path):
    from specframe.streaming.resumable import resumable_apply
    work = spark.createDataFrame([("a", "text")], "id string, prompt string")
    out = resumable_apply(work, lambda todo: todo, str(tmp_path / "run"), ["id"])
    assert [tuple(r) for r in out.collect()] == [("a", "text")] and all(".zstd." in f for f in out.inputFiles())
