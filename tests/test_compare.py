from specframe import schemas as S
from specframe.operators import compare as H
from specframe.plans import load_queries


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_made_before_they_are_exploded(spark):
    plan = optimized(load_queries()[0]["comparison_text"](spark, "/root/testdata/sf0.001"))
    generators = [line for line in plan.splitlines() if "Generate posexplode" in line]
    assert generators and not any("concat(" in line for line in generators)


def test_keywords_hash_no_stopwords(spark):
    plan = optimized(spark.range(1).select(H.keywords(H.F.lit("x").substr(H.F.lit(1), H.F.col("id").cast("int"))).alias("k")))
    assert "array_except" not in plan and "INSET" in plan


def test_mapping_ids_does_not_compute_the_map_first(spark):
    entries = spark.createDataFrame([(1, "a=b"), (2, " a = c "), (3, "none")], "ord int, entry string")
    ext = spark.createDataFrame([("a",), ("x",)], "element_id string")
    id_map = H.parse_id_map(entries)
    assert "rightHint=(strategy=broadcast)" in optimized(H.map_ids(ext, id_map))
    spark.sparkContext.setJobGroup("map-ids", "")
    mapped = H.map_ids(ext, id_map)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("map-ids")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
    assert sorted(map(tuple, mapped.select("element_id", "reference_id").collect())) == [("a", "c"), ("x", "x")]


def test_null_items_and_levels(spark):
    contract = S.struct(S.CONTRACT).simpleString()
    names = S.struct(S.CONTRACT).names
    make = lambda **kw: tuple(kw.get(n) for n in names)
    ext = make(purpose="the alpha", preconditions=["alpha beta"], error_conditions=[("c", None, None), ("d", "b", "")], trust_boundary=(None, "mixed", None))
    ref = make(purpose="alpha", preconditions=[None, "The Alpha the alpha", "gamma"], error_conditions=[("c", "b", "fatal"), ("e", "b", None)],
               trust_boundary=("trusted", "mixed", None), performance="fast")
    pairs = spark.createDataFrame([("p", "e", "e", ext, ref)], f"project_id string, element_id string, reference_id string, ext {contract}, ref {contract}")
    (row,) = H.compare_elements(pairs).collect()
    assert row["fields"].matched == ["error_conditions", "preconditions", "purpose", "trust_boundary"]
    assert (row["fields"].missing, row["fields"].extra) == (["performance"], [])
    assert [(c.field, c.coverage.matched, c.coverage.total, c.coverage.uncovered) for c in row["coverage"]] == [
        ("preconditions", 1, 3, [None, "gamma"]), ("error_conditions", 0, 2, ["c b fatal", "e b"])]
    assert [tuple(t) for t in row["trust"]] == [("input_trust", "MISSING"), ("output_trust", "MATCH")]
    assert tuple(row["severities"]) == (["fatal"], [], False)
    text = [t for _, t in sorted((r["ord"], r["text"]) for r in H.comparison_text(H.compare_elements(pairs)).collect())]
    assert '      missing: "gamma"' in text and None not in text and sum("missing: " in t for t in text) == 3


def test_shuffled_cover_reads_texts_once(spark):
    refs = spark.createDataFrame([("r", "alpha beta gamma delta epsilon zeta"), ("s", "the")], "ref_id string, text string")
    texts = spark.createDataFrame([("a", "Beta zeta!"), ("b", "alpha"), ("c", None), ("d", "")], "ext_id string, text string")
    found = H.covers(refs, texts, max_broadcast=0)
    assert [tuple(r) for r in found.collect()] == [("r", "a", 2, 6)]
    assert not any("ext_id" in line and "regexp_extract_all" in line for line in optimized(found).splitlines())
