"""Scoring extracted contracts against reference contracts.

Contract pairs have ``(project_id, element_id, reference_id, ext, ref)`` with two
contract structs; a field that is null counts as absent.  All per-pair measures are
columns, so a comparison is one pass over the pairs with no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as X
from ..functions.text import keyword_overlap, keywords  # noqa: F401  (part of this module's interface)
from ..runtime import BROADCAST_ROWS, broadcast_if_small, is_small, materialize
from .graph import P

ERROR_FIELDS = ("condition", "behavior", "severity")
_COVERAGE = "array<struct<field:string,coverage:struct<matched:int,total:int,uncovered:array<string>,field_missing:boolean>>>"


# -- coverage at corpus scale ----------------------------------------------

def _rare_keywords(items: DataFrame, frequencies: DataFrame) -> DataFrame:
    """``(ref_id, word)``: per item, the keywords to look candidates up by.

    Two sets that share ``t`` of the ``n`` reference keywords share one of any
    ``n-t+1`` of them, so the rarest ``n-t+1`` suffice (prefix filtering for
    set-overlap joins).  Rarity decides the number of candidates, never the result."""
    words = items.select("ref_id", "n", F.explode("ref_kw").alias("word")).join(frequencies, "word", "left")
    ranked = words.groupBy("ref_id", "n").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("freq", F.lit(0)).alias("freq"), "word"))).alias("ranked"))
    rare = F.slice("ranked", F.lit(1), F.col("n") - X.cover_threshold(F.col("n")) + 1)
    return ranked.select("ref_id", F.explode(rare).alias("r")).select("ref_id", "r.word")


def covers(ref_items: DataFrame, ext_items: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Which items cover which: ``(ref_id, ext_id, overlap, n)``, qualifying pairs only.

    ``ref_items`` ``(ref_id, text)``, ``ext_items`` ``(ext_id, text)``.  Reference keywords
    within the bound travel to the items: texts are read once and never shuffled, and
    only co-occurrence counts, combined per item on the map side, are exchanged (not
    even those when the items are bucketed by ``ext_id``).  A larger reference side is
    looked up by its rarest keywords.  Of the texts, which are read once, only keywords that
    a reference has are written, and candidates are compared by those alone."""
    items = ref_items.select("ref_id", keywords(F.col("text")).alias("ref_kw")).select(
        "*", F.size("ref_kw").alias("n")).filter("n > 0")
    ext = ext_items.select("ext_id", keywords(F.col("text")).alias("ext_kw"))
    # the outer form keeps the optimizer from tokenizing twice to drop empty texts first
    words = ext.select("ext_id", F.explode_outer("ext_kw").alias("word"))
    index = items.select("ref_id", "n", F.explode("ref_kw").alias("word"))
    enough = F.col("overlap") >= X.cover_threshold(F.col("n"))
    if is_small(index, max_broadcast):
        return words.join(F.broadcast(index), "word").groupBy("ref_id", "ext_id", "n").agg(
            F.count(F.lit(1)).cast("int").alias("overlap")).filter(enough).select("ref_id", "ext_id", "overlap", "n")
    vocabulary = index.select("word").distinct()
    words = materialize(words.join(broadcast_if_small(vocabulary), "word", "left_semi"), "cover-words")
    known = words.groupBy("ext_id").agg(F.collect_list("word").alias("ext_kw"))
    rare = _rare_keywords(items, words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")))
    # dealt by text alone, so pairs meet their text's keywords where they are
    candidates = words.join(rare, "word").select("ref_id", "ext_id").repartition("ext_id").distinct()
    return candidates.join(known, "ext_id").join(items, "ref_id").select(
        "ref_id", "ext_id", X.overlap_size(F.col("ext_kw"), F.col("ref_kw")).alias("overlap"), "n").filter(enough)


def coverage_counts(ref_items: DataFrame, ext_items: DataFrame, max_broadcast: int = BROADCAST_ROWS) -> DataFrame:
    """Every reference item with its keyword count, covering items and flags."""
    n = covers(ref_items, ext_items, max_broadcast).groupBy("ref_id").agg(
        F.count(F.lit(1)).alias("covering"), F.max("overlap").alias("best_overlap"))
    return ref_items.select("ref_id", F.size(keywords(F.col("text"))).alias("n_keywords")).join(
        n, "ref_id", "left").select(
        "ref_id", "n_keywords", F.coalesce("covering", F.lit(0)).cast("bigint").alias("covering"),
        F.coalesce("best_overlap", F.lit(0)).alias("best_overlap"),
        F.col("covering").isNotNull().alias("covered"), (F.col("n_keywords") == 0).alias("no_keywords"))


# -- pairing ---------------------------------------------------------------

def parse_id_map(entries: DataFrame) -> DataFrame:
    """``key=value`` strings in column ``entry`` (with their order in ``ord``) to
    ``(element_id, reference_id)``; entries without ``=`` are ignored, the last entry
    of a key counts.  Few entries make a map that joins broadcast; they are counted before
    they are grouped, so a large map is not computed twice."""
    at = F.instr("entry", "=")
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    found = entries.filter(at > 0).groupBy(strip(F.expr("left(entry, instr(entry, '=') - 1)")).alias("element_id")).agg(
        F.max_by(strip(F.expr("substring(entry, instr(entry, '=') + 1)")), "ord").alias("reference_id"))
    return F.broadcast(found) if is_small(entries) else found


def map_ids(ext: DataFrame, id_map: DataFrame) -> DataFrame:
    """Extracted elements with the reference ID they map to, their own by default."""
    renamed = id_map.withColumnRenamed("reference_id", "mapped")
    return ext.join(renamed, "element_id", "left").withColumn(
        "reference_id", F.coalesce("mapped", "element_id")).drop("mapped")


def pair_contracts(ext: DataFrame, ref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs with a non-empty reference contract, and the elements skipped for want of
    one.  ``ext`` comes from ``map_ids``; both sides have a ``contract`` struct."""
    gold = ref.filter("contract IS NOT NULL").select(
        P, F.col("element_id").alias("reference_id"), F.col("contract").alias("ref"))
    sides = ext.select(P, "element_id", "reference_id", F.col("contract").alias("ext"))
    pairs = sides.join(gold, [P, "reference_id"])
    skipped = sides.join(gold, [P, "reference_id"], "left_anti").select(P, "element_id")
    return pairs, skipped


# -- per-pair measures -----------------------------------------------------

# Lambda functions are evaluated node by node, with all that they are applied to, while the rest of
# a projection is compiled; so nulls are taken out by array_except and flatten where that will do.

def field_set_diff(ext: str = "ext", ref: str = "ref") -> Column:
    """struct(matched, missing, extra): sorted field names."""
    def names(which) -> Column:
        has = lambda side, f: F.col(f"{side}.{f}").isNotNull()
        found = F.array(*[F.when(which(has(ext, f), has(ref, f)), F.lit(f)) for f in sorted(K.CONTRACT_FIELDS)])
        return F.array_except(found, F.array(F.lit(None).cast("string")))

    return F.struct(
        names(lambda e, r: e & r).alias("matched"), names(lambda e, r: r & ~e).alias("missing"),
        names(lambda e, r: e & ~r).alias("extra"))


def purpose_overlap(ext: Column, ref: Column) -> Column:
    """Keyword overlap of two purposes with excerpts; null unless both exist."""
    return F.when(ext.isNotNull() & ref.isNotNull(), X.let(keyword_overlap(ext, ref), lambda o: F.struct(
        o["overlap"].alias("overlap"), o["total"].alias("total"),
        X.percent(o["overlap"], o["total"]).alias("pct"),
        F.substring(ref, 1, K.EXCERPT_PURPOSE).alias("reference"),
        F.substring(ext, 1, K.EXCERPT_PURPOSE).alias("extracted"))))


def item_covered(ref_keywords: Column, ext_keywords: Column) -> Column:
    """Does any item, given as an array of keyword arrays, cover these keywords?"""
    return (F.size(ref_keywords) > 0) & F.exists(
        ext_keywords, lambda e: X.overlap_size(e, ref_keywords) >= X.cover_threshold(F.size(ref_keywords)))


def _texts(items: Column, error: bool) -> Column:
    return F.transform(items, lambda i: X.item_text(i, ERROR_FIELDS)) if error else items


def array_coverage(ext_texts: Column, ref_texts: Column) -> Column:
    """struct(matched, total, uncovered excerpts, field_missing) for two arrays of texts;
    null when the reference has none."""
    prepared = F.struct(
        F.transform(ref_texts, lambda r: F.struct(r.alias("text"), keywords(r).alias("kw"))).alias("refs"),
        F.transform(ext_texts, keywords).alias("exts"))
    no_text = F.array().cast("array<string>")

    def measure(s: Column) -> Column:
        left_over = F.filter(s["refs"], lambda r: ~F.coalesce(item_covered(r["kw"], s["exts"]), F.lit(False)))
        return X.let(left_over, lambda o: F.struct(
            (F.size(s["refs"]) - F.size(o)).alias("matched"), F.size(s["refs"]).alias("total"),
            F.when(s["exts"].isNull(), no_text).otherwise(
                F.transform(o, lambda r: F.substring(r["text"], 1, K.EXCERPT_ITEM))).alias("uncovered"),
            s["exts"].isNull().alias("field_missing")))

    return F.when(ref_texts.isNotNull(), X.let(prepared, measure))


def array_field_coverage(ext: str = "ext", ref: str = "ref") -> Column:
    """One entry per array field the reference has: its name and coverage."""
    none = F.array().cast(_COVERAGE)

    def entry(f: str) -> Column:
        refs, exts = (_texts(F.col(f"{side}.{f}"), f == "error_conditions") for side in (ref, ext))
        return F.when(F.col(f"{ref}.{f}").isNotNull(), F.array(F.struct(
            F.lit(f).alias("field"), array_coverage(exts, refs).alias("coverage")))).otherwise(none)

    return F.concat(*[entry(f) for f in K.COVERAGE_FIELDS])


def compare_trust(ext: Column, ref: Column) -> Column:
    """Status per trust key, keys absent on both sides left out; null when the
    reference has no trust boundary."""
    def status(key: str) -> Column:
        e, r = ext[key], ref[key]
        if key == "sanitization":
            share = X.let(keyword_overlap(e, r), lambda o: X.percent(o["overlap"], o["total"]))
            same = F.when(share >= K.SANITIZATION_MATCH_PCT, F.lit("MATCH")).otherwise(F.lit("PARTIAL"))
        else:
            same = F.when(e == r, F.lit("MATCH")).otherwise(
                F.concat(F.lit("MISMATCH ('"), e, F.lit("' vs ref '"), r, F.lit("')")))
        return F.when(r.isNull(), F.lit("EXTRA")).when(e.isNull(), F.lit("MISSING")).otherwise(same)

    none = F.array().cast("array<struct<key:string,status:string>>")

    def entry(key: str) -> Column:
        there = ref[key].isNotNull() | ext[key].isNotNull()
        return F.when(there, F.array(F.struct(F.lit(key).alias("key"), status(key).alias("status")))).otherwise(none)

    return F.when(ref.isNotNull(), F.concat(*[entry(k) for k in K.TRUST_KEYS]))


def severity_levels(ext: Column, ref: Column) -> Column:
    """Distinct severities on both sides and whether they agree, a missing severity
    counting as one; null unless both sides have error conditions."""
    levels = lambda items: F.array_distinct(F.transform(items, lambda i: i["severity"]))
    shown = lambda items: F.sort_array(F.array_except(levels(items), F.array(F.lit(None).cast("string"), F.lit(""))))
    key = lambda items: F.sort_array(F.array_distinct(F.transform(items, lambda i: F.coalesce(i["severity"], F.lit("\u0000")))))
    return F.when(ext.isNotNull() & ref.isNotNull(), F.struct(
        shown(ref).alias("reference"), shown(ext).alias("extracted"), (key(ref) == key(ext)).alias("match")))


def compare_elements(pairs: DataFrame) -> DataFrame:
    """All measures of every pair in one projection."""
    return pairs.select(
        P, "element_id", "reference_id", field_set_diff().alias("fields"),
        purpose_overlap(F.col("ext.purpose"), F.col("ref.purpose")).alias("purpose"),
        array_field_coverage().alias("coverage"),
        compare_trust(F.col("ext.trust_boundary"), F.col("ref.trust_boundary")).alias("trust"),
        severity_levels(F.col("ext.error_conditions"), F.col("ref.error_conditions")).alias("severities"))


def comparison_details(comparisons: DataFrame) -> DataFrame:
    """Long form of the array coverage: one row per pair and field."""
    return comparisons.select(P, "element_id", F.explode("coverage").alias("c")).select(
        P, "element_id", "c.field", "c.coverage.matched", "c.coverage.total", "c.coverage.field_missing",
        "c.coverage.uncovered")


def summary(comparisons: DataFrame) -> DataFrame:
    """One row over all pairs; zeros when there are none."""
    matched, missing = F.size("fields.matched"), F.size("fields.missing")
    errors = F.filter("coverage", lambda c: c["field"] == "error_conditions")
    has_errors = F.size(errors) > 0
    e = F.try_element_at(errors, F.lit(1))["coverage"]
    all_match = (F.size("trust") > 0) & F.forall("trust", lambda t: t["status"] == "MATCH")
    return comparisons.agg(
        F.count(F.lit(1)).alias("elements_compared"),
        F.coalesce(F.avg(F.when(matched + missing > 0, matched / (matched + missing) * 100)), F.lit(0.0)).alias("avg_field_coverage_pct"),
        F.coalesce(F.avg(F.when(F.col("purpose.total") > 0, F.col("purpose.overlap") / F.col("purpose.total") * 100)), F.lit(0.0)).alias("avg_purpose_overlap_pct"),
        F.count_if(has_errors & (e["matched"] == e["total"])).alias("full_error_coverage"),
        F.count_if(has_errors).alias("elements_with_error_conditions"),
        F.count_if(F.col("trust").isNotNull() & all_match).alias("trust_boundary_match"),
        F.count_if(F.col("trust").isNotNull()).alias("elements_with_trust_boundary"))


def whole_percent(value: Column) -> Column:
    """A percentage without decimals, halves to the even digit."""
    return F.concat(F.bround(value, 0).cast("bigint").cast("string"), F.lit("%"))


# The labels and line forms of the two texts below.
def comparison_text(comparisons: DataFrame) -> DataFrame:
    """Report lines per pair, ``(project_id, element_id, ord, text)``."""
    c = F.col
    join = lambda a: F.array_join(a, ", ")
    quoted = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "), F.lit("]"))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.array().cast("array<string>")
    some = lambda cond, *parts: F.when(cond, F.array(line(*parts))).otherwise(none)

    head = F.concat(
        F.array(
            line("=== ", c("element_id"), " ===", F.when(
                c("reference_id") != c("element_id"), line(" (mapped to ", c("reference_id"), ")")).otherwise(F.lit(""))),
            line("  Matched fields:  ", F.coalesce(X.truthy(join("fields.matched")), F.lit("(none)")))),
        some(F.size("fields.missing") > 0, "  Missing fields:  ", join("fields.missing")),
        some(F.size("fields.extra") > 0, "  Extra fields:    ", join("fields.extra")),
        F.array(F.lit("")))
    p = c("purpose")
    purpose = F.when(p.isNotNull(), F.array(
        F.lit("  purpose:"), line("    REFERENCE: \"", p["reference"], "\""), line("    EXTRACTED: \"", p["extracted"], "\""),
        line("    Keywords overlap: ", p["overlap"].cast("string"), "/", p["total"].cast("string"), " (", whole_percent(p["pct"]), ")"),
        F.lit("")))

    def field_lines(f: Column) -> Column:
        v = f["coverage"]
        ratio = line("    ", v["matched"].cast("string"), "/", v["total"].cast("string"), " covered",
                     F.when(v["field_missing"], F.lit(" (field missing)")).otherwise(F.lit("")))
        return F.concat(F.array(line("  ", f["field"], ":"), ratio),
                        F.transform(v["uncovered"], lambda u: line("      missing: \"", u, "\"")), F.array(F.lit("")))

    arrays = F.flatten(F.transform("coverage", field_lines))
    trust = F.when(c("trust").isNotNull(), F.concat(
        F.array(F.lit("  trust_boundary:")), F.transform("trust", lambda t: line("    ", t["key"], "=", t["status"])), F.array(F.lit(""))))
    s = c("severities")
    levels = F.when(s.isNotNull(), F.array(
        F.lit("  error_severity_levels:"),
        line("    ", F.when(s["match"], F.lit("MATCH")).otherwise(F.lit("MISMATCH")), " — ref: ", quoted(s["reference"]),
             ", extracted: ", quoted(s["extracted"])), F.lit("")))
    lines = F.concat(head, *[F.coalesce(x, none) for x in (purpose, arrays, trust, levels)])
    # made before they are exploded: a generator would evaluate them node by node
    made = comparisons.select(P, "element_id", lines.alias("lines"))
    return made.select(P, "element_id", F.posexplode(F.filter("lines", lambda t: t.isNotNull())).alias("ord", "text"))


def summary_text(summary_row: DataFrame) -> DataFrame:
    """The closing block of the report, ``(ord, text)``."""
    n = F.col("elements_compared")
    of = lambda a, b: F.concat(F.col(a).cast("string"), F.lit("/"), F.col(b).cast("string"))
    more = n > 0
    lines = F.filter(F.array(
        F.lit("Summary:"), F.concat(F.lit("  Elements compared: "), n.cast("string")),
        F.when(more, F.concat(F.lit("  Avg field coverage: "), whole_percent(F.col("avg_field_coverage_pct")))),
        F.when(more, F.concat(F.lit("  Avg keyword overlap (purpose): "), whole_percent(F.col("avg_purpose_overlap_pct")))),
        F.when(more, F.concat(F.lit("  Elements with all error_conditions: "), of("full_error_coverage", "elements_with_error_conditions"))),
        F.when(more, F.concat(F.lit("  Elements with matching trust_boundary: "), of("trust_boundary_match", "elements_with_trust_boundary"))),
    ), lambda t: t.isNotNull())
    return summary_row.select(F.posexplode(lines).alias("ord", "text"))
