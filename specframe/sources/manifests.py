"""Package names from dependency manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .documents import read_documents

# A requirement's name ends at the first comparator or marker.
_NAME = r"^[^><=!;]*"
_TEST_SCOPES = ("test", "provided")


def _package(line: Column) -> Column:
    return F.trim(F.regexp_extract(line, _NAME, 0))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def parse_requirements(lines: DataFrame) -> DataFrame:
    """``(project_id, value)`` requirement lines to package names; comments,
    options and blank lines are left out."""
    line = _stripped(F.col("value"))
    return lines.select("project_id", line.alias("line")).filter(
        (F.col("line") != "") & ~F.startswith("line", F.lit("#")) & ~F.startswith("line", F.lit("-"))
    ).select("project_id", _stripped(_package(F.col("line"))).alias("package")).filter("package != ''")


def parse_setup_cfg(docs: DataFrame) -> DataFrame:
    """``(project_id, doc)`` ini files: names in ``[options] install_requires``."""
    section = F.regexp_extract("doc", r"(?:^|\n)\[options\][^\n]*\n((?:(?!\[)[^\n]*(?:\n|$))*)", 1)
    value = F.regexp_extract(
        section, r"(?:^|\n)install_requires[ \t]*[=:]([^\n]*(?:\n(?:[ \t][^\n]*|(?=\n|$)))*)", 1)
    return docs.select("project_id", F.explode(F.split(value, "\n")).alias("line")).filter(
        ~_stripped(F.col("line")).rlike("^[#;]")
    ).select("project_id", _stripped(_package(_stripped(F.col("line")))).alias("package")).filter("package != ''")


_POM_DEPENDENCY = "groupId STRING, artifactId STRING, scope STRING"


def pom_packages(deps: DataFrame) -> DataFrame:
    """``(project_id, groupId, artifactId, scope)`` to ``group:artifact`` names."""
    return deps.filter(
        F.col("groupId").isNotNull() & F.col("artifactId").isNotNull()
        & ~F.coalesce(F.col("scope"), F.lit("compile")).isin(*_TEST_SCOPES)
    ).select("project_id", F.concat_ws(":", "groupId", "artifactId").alias("package"))


def parse_pom(spark: SparkSession, paths, project: Column | None = None) -> DataFrame:
    """Packages of Maven files, test and provided scopes left out."""
    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    deps = spark.read.format("xml").option("rowTag", "dependency").schema(_POM_DEPENDENCY).load(paths)
    return pom_packages(deps.select(
        (folder if project is None else project).alias("project_id"), "groupId", "artifactId", "scope"))


def parse_pom_docs(docs: DataFrame) -> DataFrame:
    """The same from Maven documents already held in a column ``doc``."""
    item = F.explode(F.regexp_extract_all("doc", F.lit(r"(?s)<dependency>.*?</dependency>"), F.lit(0)))
    parsed = docs.select("project_id", item.alias("x")).select(
        "project_id", F.from_xml("x", _POM_DEPENDENCY).alias("d"))
    return pom_packages(parsed.select("project_id", "d.*"))


def read_requirements(spark: SparkSession, paths, project: Column | None = None) -> DataFrame:
    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    return parse_requirements(spark.read.text(paths).select(
        (folder if project is None else project).alias("project_id"), "value"))


def read_setup_cfg(spark: SparkSession, paths) -> DataFrame:
    folder = F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    return parse_setup_cfg(read_documents(spark, paths, folder))
