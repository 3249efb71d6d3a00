"""Review lines of rows with missing parts, and versions of any length."""

from pyspark.sql import functions as F

from specframe import schemas as S
from specframe.functions import names as N
from specframe.operators import report as J
from specframe.sources import sinks


def text(frames):
    return [r["text"] for f in frames for r in f.collect()]


def test_rows_with_null_parts_stay(spark):
    deps = spark.sql("""SELECT 'p' AS project_id, 1L AS pos, CAST(NULL AS STRING) AS package, CAST(NULL AS STRING) AS latest_version,
        array(named_struct('id', 'CVE-1', 'severity', CAST(NULL AS STRING), 'summary', '')) AS cves, CAST(NULL AS STRING) AS urgency,
        named_struct('status', CAST(NULL AS STRING)) AS metadata""")
    assert "|  | ? | ? | CVE-1 () | - |  |" in text(J.dependency_lines(deps))
    finding = spark.sql("""SELECT 'p' AS project_id, 1L AS seq, 'a.py' AS file, CAST(NULL AS INT) AS line, CAST(NULL AS STRING) AS rule_id, 'high' AS severity,
        CAST(NULL AS INT) AS cwe_id, CAST(NULL AS STRING) AS cwe_name, CAST(NULL AS STRING) AS message, CAST(NULL AS STRING) AS action,
        named_struct('status', CAST(NULL AS STRING)) AS metadata""")
    assert "| `a.py:` |  | - | - | - |  |" in text(J.finding_lines(finding))
    contract = F.from_json(F.lit('{"error_conditions": [{"condition": "c"}, {"behavior": "b", "severity": "fatal"}]}'), S.CONTRACT)
    shown = J._lines(spark.range(1).select(F.lit("p").alias("project_id"), contract.alias("c")), 0, 0, None, *J.contract_lines(F.col("c")))
    assert [r["text"] for r in shown.orderBy("ord").collect()][-3:] == ["- **Error conditions:**", "  - c -- ", "  -  -- b (fatal)"]


def test_versions_of_any_length(spark):
    cases = [("3", "3.0", False), ("3.9", "3.10", True), ("20240101123456", "20240101123457", True), ("1.0.0.0.0.0.0.0.1", "1.0.0.0.0.0.0.0.2", True),
             ("007", "7", False), ("2.x", "2.1", True), ("10", "9", False), ("", "0", False), (None, "1", False)]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    got = [r[0] for r in df.select(N.version_before(F.col("a"), F.col("b"))).collect()]
    assert got == [want for *_, want in cases]


def test_elements_of_one_file_are_dealt(spark):
    """Each element makes many lines, so a small file of elements is spread before."""
    elements = spark.sql("""SELECT 'p' AS project_id, id AS pos, concat('e', id) AS element_id, 'class' AS hierarchy_level, 'n' AS name, 'f' AS file, 1 AS line,
        CAST(NULL AS STRING) AS notes, named_struct('confidence', 'high', 'source', 's', 'status', 'confirmed') AS metadata FROM range(0, 400, 1, 1)""")
    elements = elements.withColumn("contract", F.from_json(F.lit('{"purpose": "x"}'), S.CONTRACT))
    _, _, body, _ = J.element_lines(elements, spark.range(1).select(F.lit("p").alias("project_id")))
    by_task = body.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 1 and sum(r["count"] for r in by_task) == body.count()
    assert max(r["count"] for r in by_task) < body.count() / 2


def test_review_lines_are_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    lines = spark.sql("SELECT 'p' AS project_id, id AS pos, concat('l', id) AS text FROM range(0, 5000, 1, 4)").mapInArrow(run, "project_id string, pos long, text string")
    sinks.write_reviews(lines, str(tmp_path / "reviews"))
    got = [(r["number"], r["text"]) for r in sinks.read_reviews(spark, str(tmp_path / "reviews")).orderBy("number").collect()]
    assert got == [(i, f"l{i}") for i in range(5000)] and made.value == 5000
