"""Violations of whole spec documents, found by one walk over the parsed JSON.

A document is parsed once and walked once, where its scan's task reads it, so nothing is
shuffled.  The walk follows the forms, so it goes no deeper than they do; values without a
fault leave nothing behind.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from .graph import P

# Numbers with at most so many digits, and decimals, are exact.
_DIGITS = 38
_KIND = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", Decimal: "number", float: "number"}
_ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(k): "\\" + v for k, v in zip('"\\\b\f\n\r\t', '"\\bfnrt')}
# Values in messages may be nested as deep as the parser goes.
_NESTING = 20_000
# Faults, and characters in them, that are handed on at once.
_ROWS, _CHARS = 50_000, 16_000_000


def _forms(version_key: str | None) -> dict[str, dict]:
    """Every form by its name."""
    objects = dict(K.SPEC_OBJECTS)
    if version_key:
        objects["graph_ref"] = {**objects["graph_ref"], version_key: "string"}
    forms = {name: {"base": "object", "closed": True, "keys": keys, "required": list(K.SPEC_REQUIRED.get(name, ()))}
             for name, keys in objects.items()}
    forms |= {name: {"base": "any", "accepted": list(values), "rule": "enum" if len(values) > 1 else "const"}
              for name, values in K.SPEC_VALUES.items()}
    forms["percentage"] = {"base": "number", "rule": "range"}
    for name in {v for keys in objects.values() for v in keys.values()} - set(forms):
        if name[0] in "[{":
            forms[name] = {"base": "array" if name[0] == "[" else "object", "item": name[1:-1]}
        else:
            forms[name] = {"base": name.removesuffix(" or null"), "nullable": name.endswith(" or null")}
    for form in list(forms.values()):
        if form.get("item") and form["item"] not in forms:
            forms[form["item"]] = {"base": form["item"]}
    return forms


def _object(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("repeated key")
    return found


def _integer(text: str) -> int | float | str:
    return int(text) if len(text.lstrip("-")) <= _DIGITS else _real(text + "e0")


def _real(text: str) -> Decimal | float | str:
    """Exact without an exponent; what no double holds is its name."""
    if "e" not in text and "E" not in text:
        exact = Decimal(text)
        _, digits, exponent = exact.as_tuple()
        if max(len(digits), -exponent) <= _DIGITS:
            return exact
    value = float(text)
    return ("-Infinity" if value < 0 else "Infinity") if value in (float("inf"), -float("inf")) else value


def _no_constant(text: str):
    raise ValueError(text)


def _parser() -> Callable[[str | None], object]:
    """A document's value; None if it is no JSON."""
    decoder = json.JSONDecoder(object_pairs_hook=_object, parse_int=_integer, parse_float=_real, parse_constant=_no_constant)

    def parse(doc: str | None) -> object:
        try:
            return None if doc is None else decoder.raw_decode(doc.lstrip(" \t\r\n"))[0]
        except (ValueError, RecursionError):
            return None
    return parse


def _number(value: int | Decimal | float) -> str:
    """Doubles in the notation of Spark's casts; decimals without needless zeros."""
    if isinstance(value, int):
        return str(value)
    if isinstance(value, Decimal):
        plain = format(value, "f")
        return (plain.rstrip("0").rstrip(".") if "." in plain else plain) if value else "0"
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return repr(value)
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    kept = "".join(map(str, digits)).rstrip("0") or "0"
    return f"{'-' if sign else ''}{kept[0]}.{kept[1:] or '0'}E{exponent + len(digits) - 1}"


def _quoted(text: str) -> str:
    return f'"{text.translate(_ESCAPES)}"'


def _shown(value: object) -> str:
    """A value in a message: a string as it is, anything else as JSON with sorted keys."""
    return value if isinstance(value, str) else _json(value)


def _json(value: object) -> str:
    kind = _KIND.get(type(value))
    if kind == "object":
        entries = sorted(value.items(), key=lambda e: e[0].encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join([f"{_quoted(k)}:{_json(v)}" for k, v in entries]) + "}"
    if kind == "array":
        return "[" + ",".join([_json(v) for v in value]) + "]"
    if kind == "string":
        return _quoted(value)
    if kind == "boolean":
        return "true" if value else "false"
    return "null" if kind is None else _number(value)


def _texts(values: tuple[str, ...], kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except UnicodeEncodeError:  # half a surrogate pair has no UTF-8 form
        return pa.array([v.encode("utf-8", "replace").decode() for v in values], kind)


def _check(forms: dict[str, dict], name: str, value: object, path: str, add: Callable) -> None:
    """Hand ``(path, rule, message)`` of every fault of a value, and of all below it, to ``add``."""
    form = forms[name]
    base, kind = form["base"], _KIND.get(type(value))
    if not (base in ("any", kind) or (base == "integer" and kind == "number" and float(value) % 1 == 0)
            or (kind is None and form.get("nullable"))):
        add((path, "type", f"'{_shown(value)}' is not of type {base}"))
    elif base == "object":
        keys, closed = form.get("keys"), form.get("closed")
        for key in form.get("required", ()):
            if key not in value:
                add((path, "required", f"'{key}' is a required property"))
        if closed:
            extra = value.keys() - keys.keys()
            if extra:
                add((path, "unknown_key", f"unexpected keys: {', '.join(sorted(extra))}"))
        for key, below in value.items():
            wanted = keys.get(key) if closed else form["item"]
            if wanted and not (wanted == "string" and type(below) is str):
                _check(forms, wanted, below, f"{path}.{key}" if path else key, add)
    elif base == "array":
        for i, below in enumerate(value):
            _check(forms, form["item"], below, f"{path}.{i}", add)
    elif base == "any":
        accepted = form["accepted"]
        if not (kind == "string" and value in accepted):
            add((path, form["rule"], f"'{accepted[0]}' was expected, got '{_shown(value)}'" if form["rule"] == "const" else
                 f"'{_shown(value)}' is not one of [{', '.join(f"'{a}'" for a in accepted)}]"))
    elif form.get("rule") == "range" and not 0 <= float(value) <= 100:
        add((path, "range", f"{_shown(value)} is not between 0 and 100"))


def check_documents(docs: DataFrame, version_key: str | None = None) -> DataFrame:
    """``(project_id, path, rule, message)`` for every fault of every document
    ``(project_id, doc)``: missing and unknown keys, types, listed values, the spec version
    and ranges, in all objects at any depth.

    The path joins keys and item numbers by dots, ``(root)`` for the document itself.  A
    key that is there with the value null is there; null is a fault unless its form allows
    it.  A document that is null, empty or no JSON (repeated keys included) is one fault
    of the root.  ``version_key`` names one more text key of the graph reference, the
    builder's version.  Other columns of ``docs`` are not looked at."""
    forms = _forms(version_key)
    texts = [T.StructField(n, T.StringType()) for n in ("path", "rule", "message")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), _NESTING))
        parse = _parser()
        for batch in batches:
            projects, text = batch.column(0), batch.schema.field(1).type

            def made(rows: list[int], found: list[tuple]) -> pa.RecordBatch:
                columns = [projects.take(pa.array(rows, pa.int32())), *[_texts(c, text) for c in zip(*found)]]
                return pa.RecordBatch.from_arrays(columns, [P, "path", "rule", "message"])

            rows, found, chars = [], [], 0
            for row, doc in enumerate(batch.column(1)):
                before = len(found)
                _check(forms, "spec", parse(doc.as_py()), "", found.append)
                rows += [row] * (len(found) - before)
                chars += sum(len(message) for _, _, message in found[before:])
                if len(found) >= _ROWS or chars >= _CHARS:
                    yield made(rows, found)
                    rows, found, chars = [], [], 0
            if found:
                yield made(rows, found)

    return docs.select(P, F.col("doc").cast("string").alias("doc")).mapInArrow(
        run, T.StructType([T.StructField(P, docs.schema[P].dataType), *texts])).select(
        P, F.when(F.col("path") == "", F.lit("(root)")).otherwise(F.col("path")).alias("path"), "rule", "message")
