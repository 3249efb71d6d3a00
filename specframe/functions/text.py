"""Column functions on prose: keywords, overlap, excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K


def keywords(text: Column) -> Column:
    """Distinct significant lowercase words, in order of first appearance."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(K.KEYWORD_PATTERN), F.lit(0))
    # not array_except, which hashes all stopwords anew for every text
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(*K.STOPWORDS))


def overlap_size(ext_keywords: Column, ref_keywords: Column) -> Column:
    return F.size(F.array_intersect(ref_keywords, ext_keywords))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def keyword_overlap(ext: Column, ref: Column) -> Column:
    """struct(overlap, total): reference keywords found in ``ext``, and their number."""
    both = F.struct(keywords(ref).alias("r"), keywords(ext).alias("e"))
    return let(both, lambda k: F.struct(
        overlap_size(k["e"], k["r"]).alias("overlap"), F.size(k["r"]).alias("total")))


def cover_threshold(n_keywords: Column) -> Column:
    """Shared keywords needed before one item covers another: a third, at least one."""
    return F.greatest(F.lit(1), F.floor(n_keywords / 3).cast("int"))


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def item_text(item: Column, fields: tuple[str, ...] | None = None) -> Column:
    """Flatten one item to text: a string as is, a struct's values joined by blanks."""
    if fields is None:
        return item.cast("string")
    return F.concat_ws(" ", *[item[f].cast("string") for f in fields])


def truthy(text: Column) -> Column:
    """The string, or null when it is empty."""
    return F.nullif(text, F.lit(""))


def truncated(text: Column, limit: int) -> Column:
    """At most ``limit`` characters; longer text ends in three dots."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))
    ).otherwise(text)


def lookup(table: dict[str, str], key: Column) -> Column:
    """Look ``key`` up in a small fixed table; null when it is not there."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def rank_of(values: tuple[str, ...], col: Column) -> Column:
    """Position of ``col`` in a fixed order; null when unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in values]), col), F.lit(0)).cast("int")


def plural_heading(level: Column) -> Column:
    return F.concat(F.initcap(level), F.when(level == "class", F.lit("es")).otherwise(F.lit("s")))
