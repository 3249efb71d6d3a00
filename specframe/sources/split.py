"""Large JSON documents, read by many tasks.

A document ``{"section": [{...}, ...], "other": {"key": {...}, ...}, ...}`` is split
wherever a brace opens, so Spark reads any byte range of it on its own.  Whether a piece
starts inside a string, how deep it lies and how many items came before are running sums:
within a stretch of the document over its pieces, across stretches over one row each.
Pieces cut at a brace inside a string are joined again first, so all others start outside.
No task sees a whole document; only an item, and a string, must fit into one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import names as N
from ..runtime import broadcast_if_small, materialize
from .documents import _edge_columns, _node_columns

UNITS = 1 << 16  # pieces of one stretch
_LABEL = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"\s*:\s*(\[?)\s*$'  # a key, and the bracket if an array follows


def _plain(text: Column) -> Column:
    """Text without escaped characters, so every quote opens or closes a string."""
    return F.regexp_replace(text, r"(?s)\\.", "")


def _outside(plain: Column, inside: Column | None = None) -> Column:
    """What of ``plain`` lies outside strings."""
    whole = plain if inside is None else F.concat(F.when(inside, F.lit('"')).otherwise(F.lit("")), plain)
    return F.regexp_replace(whole, r'(?s)"[^"]*("|$)', "")


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _before(value: Column, stretch: list[str], order: str) -> Column:
    """Sum over the earlier rows of the stretch."""
    here = Window.partitionBy(*stretch).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(here), F.lit(0))


def _through_end(text: Column, depth: Column) -> Column:
    """``text`` through the brace that ends the item, null if it goes on; ``depth`` is
    where the text starts."""
    pieces = F.split(text, r"\}")
    state = F.struct(F.lit(False).alias("inside"), depth.cast("long").alias("depth"), F.lit(0).alias("kept"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        plain = _plain(piece)
        outside = _outside(plain, a["inside"])
        inside = a["inside"] != (_count(plain, '"') % 2 == 1)
        below = a["depth"] + _count(outside, "[") - _count(outside, "]") - F.when(inside, 0).otherwise(1)
        return F.when(a["done"], a).otherwise(F.struct(
            inside.alias("inside"), below.cast("long").alias("depth"), (a["kept"] + 1).alias("kept"), (~inside & (below == 2)).alias("done")))

    end = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), state, step)
    return F.when(end["done"], F.concat(F.array_join(F.slice(pieces, F.lit(1), end["kept"]), "}"), F.lit("}")))


def _units(spark: SparkSession, paths) -> DataFrame:
    """``(path, unit, text)``: what stands before the first brace of a document (unit 1) and
    behind every brace outside strings, in order."""
    split = ["path", "block"]
    pieces = materialize(spark.read.option("lineSep", "{").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("text")), "split-text")
    pieces = pieces.withColumn("quotes", _count(_plain(F.col("text")), '"'))
    pieces = pieces.withColumn("odd", _before(F.col("quotes"), split, "row") % 2 == 1)
    # a split does not know whether it starts inside a string: it counts the units of both cases
    counts = pieces.groupBy(*split).agg(F.sum("quotes").alias("quotes"), F.count_if("odd").alias("odd"), F.count_if(~F.col("odd")).alias("even"))
    counts = counts.withColumn("inside", _before(F.col("quotes"), ["path"], "block") % 2 == 1)
    starts = counts.select(*split, "inside", _before(F.when(F.col("inside"), F.col("odd")).otherwise(F.col("even")), ["path"], "block").alias("units"))
    here = Window.partitionBy(*split).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    outside = (F.col("odd") == F.col("inside")).cast("int")
    numbered = pieces.join(broadcast_if_small(materialize(starts, "splits")), split).select(
        "path", "block", "row", "text", (F.col("units") + F.sum(outside).over(here)).alias("unit"))
    return numbered.groupBy("path", "unit").agg(F.sort_array(F.collect_list(F.struct("block", "row", "text"))).alias("pieces")).select(
        "path", "unit", F.array_join("pieces.text", "{").alias("text"))


def split_items(spark: SparkSession, paths, project: Column | None = None) -> DataFrame:
    """``(project_id, path, section, pos, key, item)``: every object that is an item of an
    array or a value of an object at the top of a document, as JSON text.

    ``pos`` counts from 0 in the section; ``key`` is the item's key in an object, null in
    an array.  Both are as the document writes them, escapes included.  The project is the file's base name up to the first dot unless ``project``
    gives another column of ``path``.  Sections without objects, other values at the top
    and files that are empty or hold no object give no rows."""
    stretch = ["path", "stretch"]
    by_stretch = Window.partitionBy(*stretch).orderBy("unit")
    by_path = Window.partitionBy("path").orderBy("stretch")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = by_stretch.rowsBetween(Window.unboundedPreceding, 0)

    outside = _outside(_plain(F.col("text")))
    opened = (F.col("unit") > 1).cast("int")
    units = materialize(_units(spark, paths).select(
        "path", F.floor(F.col("unit") / UNITS).alias("stretch"), "unit", "text", (opened + _count(outside, "[") - _count(outside, "]}")).alias("change"),
        F.struct(F.when(F.col("text").rlike(_LABEL), F.struct(
            F.regexp_extract("text", _LABEL, 1).alias("key"), F.regexp_extract("text", _LABEL, 2).alias("bracket"))).alias("label")).alias("tail")), "split-units")
    starts = units.groupBy(*stretch).agg(F.sum("change").alias("change"), F.max_by("tail", "unit").alias("tail")).select(
        *stretch, _before(F.col("change"), ["path"], "stretch").alias("start"), F.lag("tail").over(by_path).alias("last_tail"))
    at = units.join(broadcast_if_small(materialize(starts, "stretches")), stretch).withColumns({
        "depth": F.col("start") + _before(F.col("change"), stretch, "unit"),
        "label": F.coalesce(F.lag("tail").over(by_stretch), F.col("last_tail"))["label"]})

    level = F.col("depth") + opened  # just behind the brace
    is_item = (opened == 1) & (level == 3)
    in_array = F.col("label.bracket") == "["
    at = materialize(at.select(
        *stretch, "unit", "text", is_item.alias("is_item"), (is_item | (F.col("depth") >= 3)).alias("in_item"),
        F.when(((opened == 1) & (level == 2)) | (is_item & in_array), F.struct(
            F.col("label.key").alias("name"), F.coalesce(in_array, F.lit(False)).alias("array"))).alias("section"),
        F.when(is_item, F.col("label.key")).alias("key"),
        F.when(_count(F.col("text"), "]}") >= level - 2, _through_end(F.col("text"), level)).alias("end")), "split-pieces")

    # which item a piece belongs to, and which section an item
    carried = at.groupBy(*stretch).agg(
        F.count_if("is_item").alias("items"), F.max_by("section", F.when(F.col("section").isNotNull(), F.col("unit"))).alias("section")).select(
        *stretch, _before(F.col("items"), ["path"], "stretch").alias("items_before"), F.last("section", True).over(ahead(by_path)).alias("section_before"))
    at = at.join(broadcast_if_small(materialize(carried, "stretches")), stretch).withColumns({
        "section": F.coalesce(F.last("section", True).over(so_far), F.col("section_before")),
        "number": F.col("items_before") + F.sum(F.col("is_item").cast("long")).over(so_far)})
    parts = at.filter("in_item AND number > 0").groupBy("path", "number").agg(
        F.sort_array(F.collect_list(F.struct("unit", "text", "end", "section", "key"))).alias("parts"))
    # the parts through the first that ends the item, joined by the braces they were split at
    last = F.array_position(F.transform("parts", lambda p: p["end"].isNotNull()), True).cast("int")
    whole = F.concat(F.lit("{"), F.array_join(F.transform(F.slice("parts", F.lit(1), last), lambda p: F.coalesce(p["end"], p["text"])), "{"))
    first = F.col("parts")[0]
    items = materialize(parts.filter(last > 0).select(
        "path", "number", first["section"]["name"].alias("section"), F.when(~first["section"]["array"], first["key"]).alias("key"), whole.alias("item")), "items")
    begins = broadcast_if_small(items.groupBy("path", "section").agg(F.min("number").alias("begin")))
    project = F.substring_index(N.basename(F.col("path")), ".", 1) if project is None else project
    return items.join(begins, ["path", "section"]).select(
        project.alias("project_id"), "path", "section", (F.col("number") - F.col("begin")).alias("pos"), "key", "item")


def _section(items: DataFrame, name: str, ddl: str) -> DataFrame:
    return items.filter(F.col("section") == name).select("project_id", "pos", F.from_json("item", ddl).alias("x"))


def large_graph(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of split documents, as ``read_graph(strict=False)`` gives them."""
    return (_section(items, "nodes", S.GRAPH_NODE).select("project_id", "pos", *_node_columns("x")),
            _section(items, "edges", S.GRAPH_EDGE).select("project_id", "pos", *_edge_columns("x")))


def large_findings(items: DataFrame) -> DataFrame:
    """Raw findings of split documents, as ``read_findings`` gives them."""
    return _section(items, "findings", S.RAW_FINDING).select("project_id", F.col("pos").alias("seq"), "x.*")


def large_elements(items: DataFrame) -> DataFrame:
    """``(project_id, pos, element_id, body)`` of the elements of split spec documents."""
    return items.filter(F.col("section") == "elements").select(
        "project_id", "pos", F.from_json(F.concat(F.lit('["'), "key", F.lit('"]')), "array<string>")[0].alias("element_id"), F.col("item").alias("body"))
