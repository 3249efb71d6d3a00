"""Column functions on file paths, qualified names and versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# A last extension, unless everything before it in the base name is dots.
_EXTENSION = r"^((?:.*/)?\.*[^/.][^/]*)\.[^/.]*$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def source_prefix(file: Column, source_root: Column) -> Column:
    """The part of ``file`` up to and including the source root; null if absent."""
    root = F.rtrim(source_root, F.lit("/"))
    inner = F.concat(F.lit("/"), root, F.lit("/"))
    at = F.instr(file, inner)
    return (
        F.when(at > 0, F.left(file, at + F.length(inner) - 1))
        .when(F.startswith(file, F.concat(root, F.lit("/"))), F.concat(root, F.lit("/")))
    )


def qualified_name(file: Column, prefix: Column, language: Column) -> Column:
    """Dotted module name of a file below ``prefix``; null for files outside it."""
    rel = F.substr(file, F.length(prefix) + 1)
    python = language == "python"
    named = let(F.regexp_replace(rel, _EXTENSION, "$1"), lambda base: (
        F.when(python & (base == "__init__"), basename(F.rtrim(prefix, F.lit("/"))))
        .when(python & F.endswith(base, F.lit("/__init__")),
              F.left(base, F.length(base) - len("/__init__")))
        .otherwise(base)))
    return F.when(F.startswith(file, prefix), F.replace(named, F.lit("/"), F.lit(".")))


def project_root(prefix: Column, source_root: Column) -> Column:
    """``prefix`` without its trailing source root; empty when nothing is left."""
    root = F.trim(source_root, F.lit("/"))
    bare = F.rtrim(prefix, F.lit("/"))
    head = F.left(bare, F.length(bare) - F.length(root))
    return (
        F.when(~F.endswith(bare, root), prefix)
        .when(head.isin("", "/"), F.lit(""))
        .otherwise(F.concat(F.rtrim(head, F.lit("/")), F.lit("/")))
    )


def relative_file(file: Column, prefix: Column, source_root: Column) -> Column:
    """``file`` relative to the project root; unchanged when outside it."""
    root = project_root(prefix, source_root)
    return F.when(F.startswith(file, root), F.substr(file, F.length(root) + 1)).otherwise(file)


def last_part(qualified: Column) -> Column:
    return F.substring_index(qualified, ".", -1)


def after_colon(element_id: Column) -> Column:
    """The part of an element ID after its first colon."""
    return F.substr(element_id, F.instr(element_id, ":") + 1)


def version_parts(version: Column) -> Column:
    """Numeric parts of a dotted version as ``(digits, text)`` without leading zeros, which
    compare like numbers of any length.  A part that starts with no digit is zero."""
    def part(p: Column) -> Column:
        return let(F.regexp_extract(p, r"^0*(\d*)", 1), lambda d: F.struct(F.length(d).alias("digits"), d.alias("text")))

    return F.transform(F.split(version, "[.]"), part)


def version_before(a: Column, b: Column) -> Column:
    """Whether version ``a`` is below ``b``; the shorter one is filled up with zeros, so
    ``3`` equals ``3.0``."""
    def filled(parts: Column, n: Column) -> Column:
        zero = F.struct(F.lit(0).alias("digits"), F.lit("").alias("text"))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(parts, i), zero))

    both = F.struct(version_parts(a).alias("a"), version_parts(b).alias("b"))
    return let(both, lambda v: let(F.greatest(F.size(v["a"]), F.size(v["b"])), lambda n: (
        filled(v["a"], n) < filled(v["b"], n)) & a.isNotNull() & b.isNotNull()))
