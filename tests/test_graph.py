"""Parents, IDs and elements: graphs worked by hand, and what must hold on random ones."""

import random

import pytest

from specframe.operators import extras
from specframe.operators import graph as G

NODE = ("project_id string, pos long, id string, kind string, name string, scope string, file string, line int")
KINDS = ("module", "class", "function")


def frame(spark, rows):
    return spark.createDataFrame(rows, NODE)


def ids_of(spark, rows, prefix="src/"):
    """(project, node) -> (element ID, is collision), and (project, node) -> parent node."""
    nodes = frame(spark, rows)
    parents = G.resolve_parent(nodes)
    prefixes = spark.createDataFrame([(p, prefix, "python") for p in sorted({r[0] for r in rows})], "project_id string, prefix string, language string")
    ids = {(r.project_id, r.id): (r.element_id, r.is_collision) for r in G.element_ids(nodes, parents, prefixes).collect()}
    return ids, {(r.project_id, r.id): r.parent_id for r in parents.collect()}


def test_ids_worked_by_hand(spark):
    rows = [
        ("p", 0, "m", "module", "shop", None, "src/shop.py", 1),
        ("p", 1, "i", "module", "pkg", None, "src/pkg/__init__.py", 1),
        ("p", 2, "c", "class", "shop", "m", "src/shop.py", 3),       # named like its file
        ("p", 3, "d", "class", "Cart", "m", "src/shop.py", 9),
        ("p", 4, "n", "class", "Line", "d", "src/shop.py", 11),
        ("p", 5, "f", "function", "total", "d", "src/shop.py", 20),
        ("p", 6, "g", "function", "total", "d", "src/shop.py", 30),  # the name is taken
        ("p", 7, "h", "function", "inner", "g", "src/shop.py", 31),  # below a suffixed ID
        ("p", 8, "b", "block", "if", "f", "src/shop.py", 22),
        ("p", 9, "k", "function", "late", "b", "src/shop.py", 23),   # the block is passed over
        ("p", 10, "o", "function", "free", "gone", "src/pkg/__init__.py", 2),
        ("q", 0, "m", "module", "shop", None, "src/shop.py", 1),     # projects do not meet
    ]
    ids, parents = ids_of(spark, rows)
    assert {k[1]: v[0] for k, v in ids.items() if k[0] == "p"} == {
        "m": "mod:shop", "i": "mod:pkg", "c": "cls:shop", "d": "cls:shop.Cart", "n": "cls:shop.Cart.Line",
        "f": "fn:shop.Cart/total", "g": "fn:shop.Cart/total@30", "h": "fn:shop.Cart/total@30/inner",
        "k": "fn:shop.Cart/total/late", "o": "fn:pkg/free"}
    assert ids["q", "m"] == ("mod:shop", False) and [k[1] for k, v in ids.items() if v[1]] == ["g"]
    assert parents["p", "k"] == "f" and parents["p", "o"] is None and parents["p", "n"] == "d"


def test_a_parent_that_comes_later_lends_its_path(spark):
    rows = [("p", 0, "inner", "class", "In", "outer", "src/a.py", 2), ("p", 1, "outer", "class", "Out", "m", "src/b.py", 1),
            ("p", 2, "m", "module", "b", None, "src/b.py", 1)]
    ids, _ = ids_of(spark, rows)
    assert {k[1]: v[0] for k, v in ids.items()} == {"m": "mod:b", "inner": "cls:b.In", "outer": "cls:b.Out"}


def random_rows(rng, project):
    n = rng.randint(3, 40)
    files = ["src/a.py", "src/a/__init__.py", "src/b/a.py"]
    rows = []
    for i in range(n):
        kind = rng.choice(["module", "class", "class", "function", "function", "block"])
        scope = f"n{rng.randrange(n)}" if rng.random() < 0.8 else rng.choice([None, "gone"])
        name = rng.choice(["a", "b", "a@1"])
        rows.append((project, i, f"n{i}", kind, name, scope, rng.choice(files), rng.randint(1, 3)))
    return rows


def test_invariants_of_random_graphs(spark):
    rng = random.Random(7)
    projects = {f"p{i}": random_rows(rng, f"p{i}") for i in range(60)}
    rows = [r for mine in projects.values() for r in mine]
    ids, parents = ids_of(spark, rows)
    by_node = {(r[0], r[2]): r for r in rows}
    order = {k: (KINDS.index(by_node[k][3]), by_node[k][1]) for k in ids}
    assert ids.keys() == parents.keys() == {k for k, r in by_node.items() if r[3] in KINDS}
    seen = set()
    for key in sorted(ids, key=lambda k: (k[0], order[k])):
        (project, node), (element_id, collision) = key, ids[key]
        line = by_node[key][7]
        assert collision == element_id.endswith(f"@{line}") or "@1" in by_node[key][4]
        assert collision or (project, element_id) not in seen
        seen.add((project, element_id))
        up = parents[key]
        if up is not None:
            assert by_node[project, up][3] in KINDS
            if order[project, up] < order[key] and by_node[key][3] == "function":
                assert element_id.startswith("fn:" + ids[project, up][0].split(":", 1)[1] + "/")
        scope = by_node.get((project, by_node[key][5]))
        if scope is not None and scope[3] in KINDS:
            assert up == scope[2]
    # nodes in one block have one parent
    for p, mine in projects.items():
        for block in (r for r in mine if r[3] == "block"):
            assert len({parents[p, r[2]] for r in mine if r[5] == block[2] and r[3] in KINDS}) <= 1

    # an ID does not depend on nodes after it that are no scope of its own or of an earlier node
    last = {p: max((k for k in ids if k[0] == p), key=order.get, default=None) for p in projects}
    fewer = [(*r[:3], "gone", *r[4:]) if (r[0], r[2]) == last[r[0]] else r for r in rows]
    again, parents_again = ids_of(spark, fewer)
    touched = {}
    for k in again:
        if parents_again[k] != parents[k] or last[k[0]][1] in _above(by_node, k):
            touched[k[0]] = min(touched.get(k[0], order[k]), order[k])
    untouched = [k for k in again if k[0] not in touched or order[k] < touched[k[0]]]
    assert len(untouched) > 500 and all(again[k] == ids[k] for k in untouched)


def _above(by_node, key):
    """Scopes of a node, up to the first repeat."""
    project, node = key
    out = set()
    while (project, node) in by_node and node not in out:
        out.add(node)
        node = by_node[project, node][5]
    return out


def test_elements_keep_the_last_of_equal_ids(spark):
    rows = [("p", 0, "m", "module", "a", None, "src/a.py", 1), ("p", 1, "f", "function", "f", "m", "src/a.py", 4),
            ("p", 2, "g", "function", "f", "m", "src/a.py", 7), ("p", 3, "h", "function", "f", "m", "src/a.py", 7)]
    meta = spark.createDataFrame([("p", "src", "python")], "project_id string, source_root string, language string")
    got = {r.element_id: (r.node_ref, r.parent) for r in G.build_elements(frame(spark, rows), meta).collect()}
    assert got == {"mod:a": ("m", None), "fn:a/f": ("f", "mod:a"), "fn:a/f@7": ("h", "mod:a")}


def test_file_outside_the_root(spark):
    nodes = frame(spark, [("p", 0, "m", "module", "m", None, "src/m.py", 1), ("p", 1, "x", "class", "X", "m", "lib/x.py", 1)])
    meta = spark.createDataFrame([("p", "src", "python")], "project_id string, source_root string, language string")
    assert [r.element_id for r in G.build_elements(nodes, meta).collect()] == ["mod:m"]
    with pytest.raises(Exception, match="outside the source root"):
        G.build_elements(nodes, meta, strict=True).collect()


def test_no_source_root(spark):
    nodes = frame(spark, [("p", 0, "m", "module", "m", None, "lib/m.py", 1)])
    assert G.source_root_prefix(nodes, "src").collect()[0].prefix is None
    meta = spark.createDataFrame([("p", "src", "python")], "project_id string, source_root string, language string")
    with pytest.raises(Exception, match="source root"):
        G.build_elements(nodes, meta, strict=True).collect()


def test_chains_take_few_rounds(spark, monkeypatch):
    rows = [("p", i, f"b{i}", "block", "b", f"b{i - 1}" if i else "m", "src/m.py", 1) for i in range(1000)]
    rows += [("p", 1000 + i, f"f{i}", "function", "f", f"b{i}", "src/m.py", i) for i in (0, 1, 2, 511, 512, 999)]
    written = []
    monkeypatch.setattr(G, "materialize", lambda df, label, inner=G.materialize: written.append(label) or inner(df, label))
    got = {r.id: (r.parent_id, r.depth) for r in G.resolve_parent(frame(spark, [*rows, ("p", 2000, "m", "module", "m", None, "src/m.py", 1)])).collect()}
    assert got == {"m": (None, None), **{f"f{i}": ("m", i + 2) for i in (0, 1, 2, 511, 512, 999)}}
    assert written.count("scopes") <= 11


def test_late_changes_touch_few_rows(spark, monkeypatch):
    """Classes nested three deep and collisions among their children: only rows below a changed
    parent, or with an ID that a changed row took, are worked on again."""
    rows = [("p", 0, "m", "module", "m", None, "src/m.py", 1)]
    rows += [("p", i, f"t{i}", "class", f"T{i}", "m", "src/m.py", i) for i in range(1, 400)]
    rows += [("p", 400, "x", "class", "T1", "m", "src/m.py", 9), ("p", 401, "y", "class", "Y", "x", "src/m.py", 10), ("p", 402, "z", "class", "Z", "y", "src/m.py", 11),
             ("p", 403, "w", "class", "T1@9", "m", "src/m.py", 12)]
    sizes = []
    monkeypatch.setattr(G, "materialize", lambda df, label, inner=G.materialize: (lambda out: sizes.append((label, out.count())) or out)(inner(df, label)))
    got = ids_of(spark, rows)[0]
    assert [got["p", k] for k in "xyzw"] == [("cls:m.T1@9", True), ("cls:m.T1@9.Y", False), ("cls:m.T1@9.Y.Z", False), ("cls:m.T1@9@12", True)]
    later = [n for label, n in sizes if label.startswith(("delta", "moved", "overlay"))]
    assert later and max(later) <= 4 and [label for label, _ in sizes].count("ids-class") == 1


def test_long_scope_chain_and_cycle(spark):
    chain = [("p", i, f"b{i}", "block", "b", f"b{i - 1}" if i else "m", "src/m.py", 1) for i in range(75)]
    loop = [("p", 130, "x", "block", "b", "y", "", 1), ("p", 131, "y", "block", "b", "x", "", 1), ("p", 132, "g", "function", "g", "x", "src/m.py", 1)]
    nodes = frame(spark, [("p", 150, "m", "module", "m", None, "src/m.py", 1), ("p", 151, "f", "function", "f", "b74", "src/m.py", 1), *chain, *loop])
    got = {r.id: (r.parent_id, r.depth) for r in G.resolve_parent(nodes).collect()}
    assert got == {"m": (None, None), "f": ("m", 76), "g": (None, None)}


def test_few_repeated_ids_move_no_rows(spark, monkeypatch):
    """Nodes are written once a kind while few IDs occur twice, and IDs are those of the rounds."""
    nodes = [("p", 0, "m", "module", "m", "", "src/m.py", 1), ("p", 1, "c", "class", "C", "m", "src/m.py", 2), ("p", 2, "d", "class", "C", "m", "src/m.py", 5)] + [
        ("p", 3 + i, f"f{i}", "function", f"n{i % 9}", "cd"[i % 2], "src/m.py", 10 + i) for i in range(20)]
    df = spark.createDataFrame(nodes, "project_id string, pos long, id string, kind string, name string, scope string, file string, line int")
    prefixes = spark.createDataFrame([("p", "src/", "python")], "project_id string, prefix string, language string")
    written, write = [], G.materialize
    monkeypatch.setattr(G, "materialize", lambda rows, label: written.append(label) or write(rows, label))
    got = {r.id: (r.element_id, r.is_collision) for r in G.assign_ids(G.link_parents(df), prefixes).collect()}
    assert got["c"] == ("cls:m.C", False) and got["d"] == ("cls:m.C@5", True)
    assert got["f0"] == ("fn:m.C/n0", False) and got["f18"] == ("fn:m.C/n0@28", True) and got["f9"] == ("fn:m.C@5/n0", False)
    assert "bases-function" in written and not {"ids-class", "ids-function"} & set(written)
    monkeypatch.setattr(G, "is_small", lambda rows: False)
    again = G.assign_ids(G.link_parents(df), prefixes).collect()
    assert got == {r.id: (r.element_id, r.is_collision) for r in again} and "ids-function" in written


NESTED = [("p", 0, "m", "module", "m", None, "src/m.py", 1)] + [
    ("p", 1 + i, f"o{i}", "class", f"O{i % 20}", "m", "src/m.py", i) for i in range(40)] + [
    ("p", 100 + i, f"i{i}", "class", "I", f"o{i % 40}", "src/m.py", 50 + i) for i in range(80)] + [
    ("p", 200 + i, f"f{i}", "function", "f", f"i{i % 80}", "src/m.py", i % 3) for i in range(400)]


def test_nested_classes_start_from_the_ids_above(spark, monkeypatch):
    """Classes in classes need no second round, whether the outer ones collide or not, and rows that
    are read once are not written again."""
    sizes = {}
    monkeypatch.setattr(G, "is_small", lambda *rows: False)
    monkeypatch.setattr(G, "materialize", lambda df, label, inner=G.materialize: (lambda out: sizes.setdefault(label, out.count()) < 0 or out)(inner(df, label)))
    got = ids_of(spark, NESTED)[0]
    assert got["p", "o0"] == ("cls:m.O0", False) and got["p", "o20"] == ("cls:m.O0@20", True)
    assert got["p", "i20"] == ("cls:m.O0@20.I", False) and got["p", "i60"] == ("cls:m.O0@20.I@110", True)
    assert got["p", "f60"] == ("fn:m.O0@20.I@110/f", False) and got["p", "f140"] == ("fn:m.O0@20.I@110/f@2", True)
    assert sizes["moved-class"] == sizes["delta-class"] == 0 and "bases-function" in sizes and "ids-function" not in sizes


def test_inventory_counts_without_elements(spark, monkeypatch):
    """As many as there are elements, IDs of several nodes counted once, from IDs alone."""
    rows = [*NESTED, ("q", 0, "m", "module", "m", None, "src/m.py", 1), ("q", 1, "x", "block", "b", "m", "src/m.py", 1), ("r", 0, "x", "block", "b", None, "src/m.py", 1)]
    meta = spark.createDataFrame([(p, "src", "python") for p in "pqr"], "project_id string, source_root string, language string")
    nodes, found = frame(spark, rows), spark.createDataFrame([("p",), ("s",)], "project_id string")
    elements = G.build_elements(nodes, meta)
    want = {(r.project_id, r.item): r.n for r in G.element_counts(elements, found).collect()}
    written = []
    monkeypatch.setattr(G, "is_small", lambda *rows: False)
    monkeypatch.setattr(G, "materialize", lambda df, label, inner=G.materialize: written.append(label) or inner(df, label))
    got = {(r.project_id, r.item): r.n for r in G.inventory_counts(nodes, meta, found).collect()}
    assert got == want and got["p", "total"] == elements.filter("project_id = 'p'").count() < 521 and got["s", "findings"] == 1
    assert "ids-function" not in written


def test_nodes_without_an_id_have_no_element(spark):
    nodes = spark.createDataFrame([("p", None, "class"), ("p", "a", "class"), ("p", "b", "class"), ("q", "a", "class"), ("r", "x", "package")], "project_id string, id string, kind string")
    elements = spark.createDataFrame([("p", None, 1), ("p", "a", None), ("p", "a", 2)], "project_id string, node_ref string, contract int").withColumn(
        "metadata", G.scanned_metadata())
    got = {(r.project_id, r.check): r.failures for r in G.skeleton_checks(nodes, elements).collect()}
    assert got == {("p", "nodes_without_element"): 2, ("p", "wrong_provenance"): 0, ("p", "contract_not_empty"): 2,
                   ("q", "nodes_without_element"): 1, ("q", "wrong_provenance"): 0, ("q", "contract_not_empty"): 0}


@pytest.mark.parametrize("direction", ["out", "in", "both"])
def test_k_hop_of_repeated_edges(spark, monkeypatch, direction):
    """Cycles, loops and edges that stand several times, against breadth first search; edges
    are not shuffled only to drop repeated ones."""
    rng = random.Random(7)
    rows = [(p, f"n{rng.randrange(25)}", f"n{rng.randrange(25)}") for p in "ab" for _ in range(40)]
    rows += rows[:30] * 3 + [("a", "n1", "n1"), ("a", "n1", None), ("b", None, "n1")]
    seeds = [("a", "n1"), ("a", "n1"), ("a", "n2"), ("b", "n1"), ("b", "gone")]
    plans = {}
    write = extras.materialize
    monkeypatch.setattr(extras, "materialize", lambda df, label: plans.setdefault(label, df) is None or write(df, label))
    got = extras.k_hop(spark.createDataFrame(rows, "project_id string, src string, dst string"), spark.createDataFrame(seeds, "project_id string, id string"), 3, direction)
    assert got.columns == ["project_id", "seed", "id", "hops"]
    assert "Aggregate" not in plans["steps"]._jdf.queryExecution().optimizedPlan().toString()
    steps = {(p, a, b) for p, a, b in rows} if direction == "out" else {(p, b, a) for p, a, b in rows}
    if direction == "both":
        steps |= {(p, a, b) for p, a, b in rows}
    want = set()
    for p, seed in set(seeds):
        seen, frontier = {seed: 0}, {seed}
        for hop in range(1, 4):
            frontier = {b for q, a, b in steps if q == p and a is not None and a in frontier and b not in seen}
            seen |= dict.fromkeys(frontier, hop)
        want |= {(p, seed, node, hop) for node, hop in seen.items()}
    found = [tuple(r) for r in got.collect()]
    assert len([r for r in found if r[2] is not None]) == len({r for r in found if r[2] is not None})
    assert {r for r in found if r[2] is not None} == {r for r in want if r[2] is not None}
