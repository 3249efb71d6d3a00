"""Code-graph structure: statistics, names, parents, element IDs, elements.

Every operator takes tables of many projects and keys on ``project_id``.  A single
project may hold most rows, so nothing here is grouped by project alone except
aggregates that combine on the map side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as S
from ..functions import names as N
from ..runtime import broadcast_if_small, is_small, materialize

P = "project_id"


def _order() -> Column:
    """Processing order: modules, then classes, then functions, each in input order."""
    rank = F.lit(len(K.KIND_RANK))
    for name, value in K.KIND_RANK.items():
        rank = F.when(F.col("kind") == name, value).otherwise(rank)
    return F.struct(rank.alias("rank"), F.col("pos"))


def spread_nulls(key: str, unique: str) -> Column:
    """``key``, or a value that joins with nothing: keeps the rows without a key of a
    left join from all hashing into one partition."""
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(unique)))


def join_by_end(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """An equality join on the project and ``key``, a text that mostly begins as the others do:
    it is sorted by its end, where it differs, and before the project."""
    end = F.reverse(key).alias("end")
    rest = [c for c in left.columns if c != key], [c for c in right.columns if c != key]
    return left.select(*rest[0], end).join(right.select(*rest[1], end), ["end", P], how).withColumn(key, F.reverse("end")).drop("end")


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, distinct non-empty files and functions per project."""
    n = nodes.groupBy(P).agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_distinct(F.nullif("file", F.lit(""))).alias("files"),
        F.count_if(F.col("kind") == "function").alias("functions"),
    )
    e = edges.groupBy(P).agg(F.count(F.lit(1)).alias("edges"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return n.join(e, P, "full").select(P, zero("nodes"), zero("edges"), zero("files"), zero("functions"))


def source_root_prefix(nodes: DataFrame, source_root: Column | str) -> DataFrame:
    """Per project, the source-root prefix of the first node that shows one; null
    (an error row) when no file lies below the root.

    ``source_root`` is a value for all projects or a column of ``nodes``."""
    root = F.lit(source_root) if isinstance(source_root, str) else source_root
    prefix = N.source_prefix(F.col("file"), root)
    # a minimum per prefix is hashed; the first of all nodes would be sorted out
    return nodes.select(P, "pos", prefix.alias("prefix")).groupBy(P, "prefix").agg(F.min("pos").alias("pos")).groupBy(P).agg(
        F.min_by("prefix", F.when(F.col("prefix").isNotNull(), F.col("pos"))).alias("prefix"))


_NODE = ["id", "kind", "name", "file", "line", "pos"]


def link_parents(nodes: DataFrame, kinds=K.RELEVANT_KINDS, details: bool = True) -> DataFrame:
    """Nodes of ``kinds`` with their nearest enclosing node of those kinds.

    Adds ``parent_id``, ``depth`` and the parent's kind, file and order; without
    ``details`` the rows are ``(project_id, id, parent_id, depth)`` alone.  One join on
    the scope settles almost all nodes.  Only nodes in scopes of other kinds need more:
    ``_enclosing`` follows those scopes, once each however many nodes lie in them.
    Unknown scopes and cycles give no parent."""
    hit = F.col("kind").isin(*kinds)
    target = nodes.select(
        P, F.col("id").alias("at"), hit.alias("at_hit"), F.when(~F.coalesce(hit, F.lit(False)), F.nullif("scope", F.lit(""))).alias("next"),
        (F.when(hit, F.struct("kind", "file", _order().alias("ord"))) if details else F.lit(None).cast("int")).alias("seen"))
    have = [c for c in _NODE if c in nodes.columns] if details else ["id"]
    first = materialize(
        nodes.filter(hit).withColumn("to", F.nullif("scope", F.lit(""))).withColumn("at", spread_nulls("to", "id"))
        .transform(join_by_end, target, "at", "left").select(P, *have, "at", "at_hit", "next", "seen"), "linked")
    direct = first.filter("at_hit IS NULL OR at_hit").select(
        P, *have, F.when(F.col("at_hit"), F.col("at")).alias("parent_id"), F.when(F.col("at_hit"), F.lit(1)).alias("depth"), "seen")
    far = first.filter("NOT at_hit")
    if not far.isEmpty():
        far = far.drop("seen").join(_enclosing(target), [P, "at"], "left").withColumn("depth", F.col("hops") + 1)
    else:
        far = far.withColumn("parent_id", F.lit(None).cast("string")).withColumn("depth", F.lit(None).cast("int"))
    linked = direct.unionByName(far.select(direct.columns))
    return linked.drop("seen") if not details else linked.select(
        P, *have, "parent_id", "depth", F.col("seen.kind").alias("p_kind"), F.col("seen.file").alias("p_file"), F.col("seen.ord").alias("p_ord"))


def _enclosing(target: DataFrame) -> DataFrame:
    """``(project_id, at, parent_id, hops, seen)`` for the nodes that are no hit themselves and lie
    in one, by pointer doubling.

    Every open node points ``hops`` scopes up.  A round replaces its pointer by the one of
    the node it points to, or takes that node's parent if it has one, so a chain of
    depth d ends after log d rounds.  A node whose chain ends nowhere drops out.  Along a
    chain that ends there is a node at every distance, so a round that settles none leaves
    cycles alone, and what leads into them."""
    open_ = target.filter("NOT at_hit AND next IS NOT NULL").select(P, "at", "next")
    up = target.select(P, F.col("at").alias("next"), F.col("at_hit").alias("next_hit"), F.col("next").alias("beyond"), "seen")
    state = materialize(broadcast_if_small(open_).join(up, [P, "next"]).filter("next_hit OR beyond IS NOT NULL").select(
        P, "at", "next", F.when(F.col("next_hit"), F.col("next")).alias("parent_id"), F.lit(1).alias("hops"), "seen"), "scopes")
    settled = []
    while True:
        settled.append(state.filter("parent_id IS NOT NULL"))
        waiting = state.filter("parent_id IS NULL")
        if settled[-1].isEmpty() or waiting.isEmpty():
            return reduce(DataFrame.unionByName, settled).drop("next")
        known = reduce(DataFrame.unionByName, [*settled, waiting]).select(
            P, F.col("at").alias("next"), F.col("next").alias("beyond"), F.col("parent_id").alias("found"), F.col("hops").alias("more"), "seen")
        state = materialize(waiting.drop("seen").join(known, [P, "next"]).select(
            P, "at", F.col("beyond").alias("next"), F.col("found").alias("parent_id"), (F.col("hops") + F.col("more")).alias("hops"), "seen"), "scopes")


def resolve_parent(nodes: DataFrame, kinds=K.RELEVANT_KINDS) -> DataFrame:
    """``(project_id, id, parent_id, depth)`` for every node of ``kinds``."""
    return link_parents(nodes, kinds, details=False)


def element_ids(nodes: DataFrame, parents: DataFrame, prefixes: DataFrame,
                strict: bool = False) -> DataFrame:
    """Deterministic hierarchical IDs, ``(project_id, id, element_id, is_collision)``.

    ``parents`` comes from ``resolve_parent``; ``prefixes`` has ``(project_id, prefix,
    language)``.  Files outside the prefix are left out, or stop the job with
    ``strict=True``."""
    seen = nodes.select(P, F.col("id").alias("up"), F.col("kind").alias("p_kind"), F.col("file").alias("p_file"), _order().alias("p_ord"))
    linked = materialize(
        nodes.filter(F.col("kind").isin(*K.RELEVANT_KINDS)).select(P, *_NODE)
        .transform(join_by_end, parents.select(P, "id", "parent_id"), "id", "left")
        .withColumn("up", spread_nulls("parent_id", "id")).transform(join_by_end, seen, "up", "left").drop("up"), "linked")
    return assign_ids(linked, prefixes, strict, once=True).select(P, "id", "element_id", "is_collision")


def assign_ids(linked: DataFrame, prefixes: DataFrame, strict: bool = False, once: bool = False) -> DataFrame:
    """IDs for the rows of ``link_parents``; adds ``element_id``, ``is_collision``, ``ord`` and
    ``p_eid``, the parent's ID where the parent comes earlier.

    An ID depends on the final ID of an earlier parent and on whether an earlier node
    took it, in which case it gets ``@line``.  IDs of different kinds never meet, and
    parents of an earlier kind are final, so each kind is settled in turn, in one pass
    unless its nodes lie in each other.  Those take rounds of *join with the parents of
    the last round, then first taker per ID* over what may have changed: both look
    backwards only, so the rounds reach the one fixed point.

    A caller that reads the rows a single time says so by ``once``: IDs of the last kind,
    mostly the bulk of all nodes, are then not written before."""
    prefix = F.col("prefix")
    named = linked.join(broadcast_if_small(prefixes.select(P, "prefix", "language")), P)
    inside = F.startswith(F.col("file"), prefix)
    if strict:
        inside = F.when(inside, True).otherwise(F.raise_error(
            F.concat(F.lit("file outside the source root: "), F.col("file"))).cast("boolean"))
    named = named.filter(inside).withColumn(
        "reads", F.coalesce((F.col("p_ord") < _order()) & (F.col("kind") != "module"), F.lit(False))).drop("p_ord")

    finished: list[DataFrame] = []
    for kind in K.RELEVANT_KINDS:
        mine = named.filter(F.col("kind") == kind)
        in_kind = F.coalesce(F.col("reads") & (F.col("p_kind") == kind), F.lit(False))
        outer = mine.filter(~in_kind).withColumn("in_kind", F.lit(False))
        none = F.lit(None).cast("string").alias("p_eid")
        if finished:
            above = reduce(DataFrame.unionByName, finished).select(P, F.col("id").alias("up"), F.col("element_id").alias("p_eid"))
            key = F.when(F.col("reads"), F.col("parent_id"))
            outer = join_by_end(outer.withColumn("key", key).withColumn("up", spread_nulls("key", "id")), above, "up", "left").drop("key", "up")
        else:
            outer = outer.select("*", none)
        inner = mine.filter(in_kind).select("*", F.lit(True).alias("in_kind"), none)
        finished.append(_settle(outer.drop("reads"), inner.drop("reads"), kind, once and kind == K.RELEVANT_KINDS[-1]))
    return reduce(DataFrame.unionByName, finished).withColumn("ord", _order())


def _settle(outer: DataFrame, inner: DataFrame, kind: str, once: bool) -> DataFrame:
    """Final IDs of the nodes of one kind, by delta iteration.

    One pass gives every node an ID from the parents known so far.  ``inner`` nodes lie in one
    of the same kind: they start from the ID that it has among the ``outer`` ones alone, which
    is the final one unless an inner node took it before.  After that a round
    looks only at nodes below a parent whose ID changed, and at nodes whose ID is one that a
    changed node took, takes now or took before.  What changes is laid over the one written
    table of all nodes; that is written anew only when much of it is out of date."""
    own, of_parent = (N.qualified_name(F.col(f), F.col("prefix"), F.col("language")) for f in ("file", "p_file"))

    def based_on_parents(rows: DataFrame, label: str) -> DataFrame:
        # names of files are costly and only few nodes need them
        named = rows.withColumn("path_name", F.when(F.col("in_kind") | F.col("p_eid").isNull(), F.coalesce(of_parent, own)))
        return materialize(named.withColumn("base_id", _base_id(kind, own)).drop("p_file", "prefix", "language"), f"{label}-{kind}")

    based = based_on_parents(outer, "bases")
    nested = not inner.isEmpty()
    if nested:
        guessed = materialize(_take(based, kind)[0].withColumnRenamed("element_id", "guess").drop("is_collision"), f"guess-{kind}")
        above = guessed.select(P, F.col("id").alias("parent_id"), F.col("guess").alias("p_eid"))
        started = based_on_parents(join_by_end(inner.drop("p_eid"), above, "parent_id", "left"), "inner")
        based = guessed.unionByName(started.withColumn("guess", F.lit(None).cast("string")))
    state, few = _take(based, kind)
    # parents in the same kind, or names that look like a suffixed ID, need more rounds
    settled = not nested and based.filter(F.col("base_id").rlike(_SUFFIXED)).isEmpty()
    if settled and (few or once):
        return state
    state = materialize(state, f"ids-{kind}")
    if settled:
        return state
    # what the inner nodes took for their parents' IDs: those of outer nodes, and none of inner ones
    used = F.col("element_id")
    if nested:
        deep = not started.filter("p_eid IS NULL").isEmpty()
        used = F.when(~F.col("in_kind"), F.col("guess")).otherwise(F.lit(None) if deep else used)
    delta = state.select("*", used.alias("old_id"), F.lit(False).alias("old_collision"))
    state = state.drop("guess")
    columns, rows = state.columns, state.count()
    overlay, current = None, state
    while True:
        delta = materialize(_changes(current, delta, kind, columns), f"delta-{kind}")
        if delta.isEmpty():
            return current
        ids, news = broadcast_if_small(delta.select(P, "id")), delta.select(*columns)
        overlay = materialize(news if overlay is None else overlay.join(ids, [P, "id"], "left_anti").unionByName(news), f"overlay-{kind}")
        current = state.join(broadcast_if_small(overlay.select(P, "id")), [P, "id"], "left_anti").unionByName(overlay)
        if overlay.count() * 4 > rows:
            overlay, state = None, materialize(current, f"ids-{kind}")
            current = state


def _take(based: DataFrame, kind: str) -> tuple[DataFrame, bool]:
    """Nodes with ``element_id`` and ``is_collision`` by the first taker of each ``base_id``, and
    whether few IDs occur twice.

    Those are looked for among hashes, and only nodes with a repeated hash are compared by
    text; if they are few, no node is moved."""
    collides = F.coalesce(F.col("first") < F.col("pos"), F.lit(False))
    mark = F.xxhash64(P, "base_id")
    twice = materialize(based.groupBy(mark.alias("mark")).count().filter("count > 1").select("mark"), f"twice-{kind}")
    few = is_small(twice)
    doubtful = based.withColumn("mark", mark).join(F.broadcast(twice), "mark", "left_semi") if few else based
    repeated = doubtful.groupBy(P, "base_id").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("takers")).filter("takers > 1").drop("takers")
    if few:
        with_first = based.join(F.broadcast(materialize(repeated, f"repeated-{kind}")), [P, "base_id"], "left")
    else:
        with_first = join_by_end(based, repeated, "base_id", "left")
    return _with_id(with_first.withColumn("is_collision", collides).drop("first")), few


_SUFFIXED = r"@-?\d+$"


def _changes(current: DataFrame, delta: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The rows that a round changes, with ``old_id`` and ``old_collision``, from the rows that the
    last round changed.

    The IDs seen before a node are the bases of all earlier nodes and the suffixed IDs
    of earlier collisions."""
    renamed = delta.filter("NOT old_id <=> element_id").select(P, F.col("id").alias("parent_id"), F.col("element_id").alias("new_p"))
    moved = materialize(
        current.filter("in_kind").join(broadcast_if_small(renamed), [P, "parent_id"]).filter("NOT p_eid <=> new_p")
        .withColumn("old_base", F.col("base_id")).withColumn("p_eid", F.col("new_p")).drop("new_p")
        .withColumn("base_id", _base_id(kind)).select(*columns, "old_base"), f"moved-{kind}")
    taken = F.when(F.col("is_collision"), F.array("old_base", "base_id", _suffixed("old_base"), _suffixed("base_id"))).otherwise(F.array("old_base", "base_id"))
    keys = moved.select(P, F.explode(taken).alias("base_id"))
    # a suffixed ID meets nodes again only where a base looks like one
    if not (current.filter(F.col("base_id").rlike(_SUFFIXED)).isEmpty() and moved.filter(F.col("base_id").rlike(_SUFFIXED)).isEmpty()):
        keys = keys.union(delta.filter("old_collision != is_collision").select(P, _suffixed("base_id")))
    keys = broadcast_if_small(materialize(keys.distinct(), f"keys-{kind}"))
    after = current.withColumn("was_moved", F.lit(False)).join(broadcast_if_small(moved.select(P, "id")), [P, "id"], "left_anti").unionByName(
        moved.drop("old_base").withColumn("was_moved", F.lit(True)))
    takes = F.explode(F.when(F.col("is_collision"), F.array("base_id", _suffixed("base_id"))).otherwise(F.array("base_id")))
    first = after.select(P, takes.alias("base_id"), "pos").join(keys, [P, "base_id"], "left_semi").groupBy(P, "base_id").agg(F.min("pos").alias("first"))
    checked = after.join(keys, [P, "base_id"], "left_semi").withColumnsRenamed({"element_id": "old_id", "is_collision": "old_collision"}).join(first, [P, "base_id"])
    return _with_id(checked.withColumn("is_collision", F.col("first") < F.col("pos"))).filter(
        "was_moved OR is_collision != old_collision").select(*columns, "old_id", "old_collision")


def _base_id(kind: str, own: Column | None = None) -> Column:
    """IDs from the parents' IDs, before collisions.  ``own`` is the name of a node's file,
    which no node below one of its own kind needs."""
    scope = F.coalesce(N.after_colon(F.col("p_eid")), F.col("path_name"))
    if kind == "module":
        return F.concat(F.lit("mod:"), own)
    if kind == "class":
        inner = F.concat(scope, F.lit("."), F.col("name"))
        own_file = F.when(F.col("p_kind") == "module", N.last_part(own) == F.col("name")) if own is not None else F.lit(False)
        return F.concat(F.lit("cls:"), F.when(own_file, own if own is not None else inner).otherwise(inner))
    return F.concat(F.lit("fn:"), scope, F.lit("/"), F.col("name"))


def _suffixed(base: str) -> Column:
    return F.concat(F.col(base), F.lit("@"), F.col("line").cast("string"))


def _with_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("element_id", F.when(F.col("is_collision"), _suffixed("base_id")).otherwise(F.col("base_id")))


def scanned_metadata() -> Column:
    """Provenance of everything that comes straight from a scan."""
    return F.struct(*[F.lit(v).alias(k) for k, v in K.SCANNED.items()])


def _prefixes(nodes: DataFrame, projects: DataFrame, strict: bool) -> DataFrame:
    roots = broadcast_if_small(projects.select(P, "source_root"))
    prefixes = source_root_prefix(nodes.select(P, "pos", "file").join(roots, P), F.col("source_root"))
    if strict:
        prefixes = prefixes.withColumn("prefix", F.coalesce("prefix", F.raise_error(
            F.concat(F.lit("no file below the source root of "), F.col(P)))))
    return materialize(prefixes.join(projects, P), "prefixes")


def _shareable() -> Column:
    """Only suffixed IDs, or IDs that look like one, can belong to several nodes."""
    return F.col("is_collision") | F.col("element_id").rlike(_SUFFIXED)


def build_elements(nodes: DataFrame, projects: DataFrame, strict: bool = False) -> DataFrame:
    """One element per module, class and function.

    ``projects`` has ``(project_id, source_root, language)``.  Two nodes may still
    share an ID after the suffix: the later one's fields win, at the earlier one's
    position."""
    known = _prefixes(nodes, projects, strict)
    named = assign_ids(link_parents(nodes), known, strict)
    # where the parent comes later its ID was no input, so it is looked up here
    later = F.col("parent_id").isNotNull() & (F.col("kind") != "module") & F.col("p_eid").isNull()
    kinds = [r.p_kind for r in named.filter(later).select("p_kind").distinct().collect()]  # at most three
    ids = named.filter(F.col("kind").isin(*kinds)).select(P, F.col("id").alias("parent_id"), F.col("element_id").alias("late_eid"))
    linked = named.filter(~later).withColumn("late_eid", F.lit(None).cast("string")).unionByName(
        named.filter(later).join(ids, [P, "parent_id"], "left"))
    rows = linked.join(broadcast_if_small(known.select(P, "prefix", "source_root")), P).select(
        P, "element_id", F.col("ord").alias("pos"), "is_collision", F.col("kind").alias("hierarchy_level"),
        F.col("id").alias("node_ref"), "name", F.coalesce("p_eid", "late_eid").alias("parent"),
        N.relative_file(F.col("file"), F.col("prefix"), F.col("source_root")).alias("file"), "line")
    fields = ["hierarchy_level", "node_ref", "name", "parent", "file", "line"]
    suspect = _shareable()
    shared = rows.filter(suspect).groupBy(P, "element_id").agg(
        F.min("pos").alias("pos"), F.max_by(F.struct(*fields), "pos").alias("r")
    ).select(P, "element_id", "pos", *[F.col(f"r.{f}").alias(f) for f in fields])
    return rows.filter(~suspect).drop("is_collision").unionByName(shared).withColumn(
        "contract", F.lit(None).cast(S.struct(S.CONTRACT))).withColumn("metadata", scanned_metadata())


def element_counts(elements: DataFrame, findings: DataFrame | None = None,
                   dependencies: DataFrame | None = None) -> DataFrame:
    """Elements by level with a total, plus findings and dependencies per project."""
    return _counts(elements.groupBy(P, "hierarchy_level").agg(F.count(F.lit(1)).alias("n")), findings, dependencies)


def inventory_counts(nodes: DataFrame, projects: DataFrame, findings: DataFrame | None = None,
                     dependencies: DataFrame | None = None, strict: bool = False) -> DataFrame:
    """``element_counts`` of what ``build_elements`` makes of the nodes.  Their IDs are all
    assigned, but no other field of an element is looked up, moved or written; an ID of
    several nodes counts once, at the level of the last of them."""
    ids = assign_ids(link_parents(nodes), _prefixes(nodes, projects, strict), strict, once=True)
    rank = F.col("ord.rank")
    level = F.lit(None).cast("string")
    for kind, value in K.KIND_RANK.items():
        level = F.when(F.col("rank") == value, kind).otherwise(level)
    per_id = ids.withColumn("shared", _shareable()).filter("shared IS NOT NULL").groupBy(
        P, "shared", F.when(F.col("shared"), F.col("element_id")).alias("element_id"), F.when(~F.col("shared"), rank).alias("alone")
    ).agg(F.max(rank).alias("rank"), F.count(F.lit(1)).alias("n"))
    return _counts(per_id.groupBy(P, level.alias("hierarchy_level")).agg(F.sum(F.when(F.col("shared"), 1).otherwise(F.col("n"))).alias("n")), findings, dependencies)


def _counts(levels: DataFrame, findings: DataFrame | None, dependencies: DataFrame | None) -> DataFrame:
    counts = levels.rollup(P, "hierarchy_level").agg(F.sum("n").alias("n")).filter(f"{P} IS NOT NULL").select(
        P, F.coalesce("hierarchy_level", F.lit("total")).alias("item"), "n")
    for name, df in (("findings", findings), ("dependencies", dependencies)):
        if df is not None:
            counts = counts.unionByName(df.groupBy(P).count().select(
                P, F.lit(name).alias("item"), F.col("count").alias("n")))
    return counts


def skeleton_checks(nodes: DataFrame, elements: DataFrame) -> DataFrame:
    """Acceptance checks of a freshly built inventory, ``(project_id, check, failures)``."""
    wrong = F.lit(False)
    for k, v in K.SCANNED.items():
        wrong = wrong | ~F.col(f"metadata.{k}").eqNullSafe(F.lit(v))
    number = lambda cond: cond.cast("bigint")
    zero = F.lit(0).cast("bigint")
    # one pass over both tables: rows of a node and of its element meet by ID
    rows = nodes.filter(F.col("kind").isin(*K.RELEVANT_KINDS)).select(
        P, "id", F.lit(1).cast("bigint").alias("nodes"), zero.alias("elements"), zero.alias("wrong"), zero.alias("filled")
    ).unionByName(elements.select(
        P, F.col("node_ref").alias("id"), zero.alias("nodes"), F.lit(1).cast("bigint").alias("elements"),
        number(wrong).alias("wrong"), number(F.col("contract").isNotNull()).alias("filled")))
    by_id = rows.groupBy(P, "id").agg(*[F.sum(c).alias(c) for c in ("nodes", "elements", "wrong", "filled")])
    alone = (F.col("elements") == 0) | F.col("id").isNull() | F.col(P).isNull()
    wide = by_id.filter((F.col("elements") > 0) | alone).groupBy(P).agg(
        F.sum(F.when(alone, F.col("nodes")).otherwise(0)).alias("nodes_without_element"),
        F.sum("wrong").alias("wrong_provenance"), F.sum("filled").alias("contract_not_empty"))
    checks = ["nodes_without_element", "wrong_provenance", "contract_not_empty"]
    return wide.select(P, F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("failures"))
        for c in checks])).alias("x")).select(P, "x.*")


def stats_checks(nodes: DataFrame, edges: DataFrame, graph_ref: DataFrame) -> DataFrame:
    """Acceptance check of the recorded statistics, ``(project_id, check, failures)``: how many
    of the four counters differ from the graph.  A counter that is not recorded differs; a
    project without a graph counts as zeros."""
    names = ["nodes", "edges", "files", "functions"]
    recorded = graph_ref.select(P, F.col("stats").alias("recorded"))
    both = graph_stats(nodes, edges).join(recorded, P, "full")
    differ = [F.coalesce(F.col(n), F.lit(0)).eqNullSafe(F.col(f"recorded.{n}")) for n in names]
    return both.select(P, F.lit("stats_differ").alias("check"), sum(F.when(d, 0).otherwise(1) for d in differ).cast("bigint").alias("failures"))


def spec_meta(projects: DataFrame, tools: DataFrame, now: str) -> DataFrame:
    """Meta rows.  ``projects``: ``(project_id, project_name, language, source_version)``;
    ``tools``: ``(project_id, tool, version)``, rows without a version ignored."""
    known = tools.filter("version IS NOT NULL AND version != ''").groupBy(P).agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("tool", "version")))).alias("tools"))
    return projects.join(known, P, "left").select(
        P, "project_name", F.lit(K.SPEC_VERSION).alias("spec_version"),
        F.col("language").alias("source_language"),
        F.nullif("source_version", F.lit("")).alias("source_version"),
        F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"), "tools")
