import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.operators import nested

DOC = st.recursive(
    st.none() | st.booleans() | st.integers(-9, 9) | st.text(max_size=3),
    lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("abc", min_size=1, max_size=2), c, max_size=3),
    max_leaves=12,
)


def brute(x, path="", inside="", element=False):
    """(path, parent) of non-null array elements, by recursion."""
    if element and x is not None:
        yield path, inside
    below = path if element else inside
    if isinstance(x, dict):
        for k, v in x.items():
            yield from brute(v, f"{path}.{k}" if path else k, below)
    if isinstance(x, list):
        for i, v in enumerate(x):
            yield from brute(v, f"{path}[{i}]", below, True)


@settings(max_examples=150, deadline=None)
@given(DOC)
def test_walk_against_recursion(doc):
    nodes = list(nested.labelled(doc))
    assert sorted((n[4], n[5]) for n in nodes if n[6] and n[3] != "null") == sorted(brute(doc))
    assert sorted(n[0] for n in nodes) == sorted(n[1] for n in nodes) == list(range(len(nodes)))
    for a in nodes:  # interval containment is descent
        for b in nodes:
            if a is not b and b[4].startswith(a[4]) and a[4] and b[4][len(a[4])] in ".[":
                assert b[0] > a[0] and b[1] < a[1]


def test_load_and_shapes(spark):
    rows = [
        (1, '{"a":{"b":[1,null,{"c":[5]}]}}'),
        (2, json.dumps('["x"]')),
        (3, "n/a"),
        (4, None),
        (5, ""),
        (6, '[[1,2],[],"\\ud800"]'),
        (7, '{"a": 1'),
        (1, '{"a":{"b":[1,null,{"c":[5]}]}}'),
        (8, "[" * 3000 + "]" * 3000),
    ]
    df = spark.createDataFrame(rows, "id bigint, details string").selectExpr("*", "1 as pre", "2 as node_path")
    nodes = nested.label_nodes(df, "id", "details", "t")
    got = sorted((r.row_id, r.node_path, r.parent_path) for r in nested.elements(nodes.where("row_id <> 8")).collect())
    one = [(1, "a.b[0]", ""), (1, "a.b[2]", ""), (1, "a.b[2].c[0]", "a.b[2]")]
    assert got == sorted(
        one * 2 + [(2, "[0]", "")] + [(6, "[0]", ""), (6, "[0][0]", "[0]"), (6, "[0][1]", "[0]"), (6, "[1]", ""), (6, "[2]", "")]
    )
    tables = nested.node_tables(nodes.where("row_id = 2"))
    assert {k: t.count() for k, t in tables.items()} == {"objects": 0, "arrays": 1, "values": 1}
    below = nested.inside(nodes.where("row_id = 6 and node_path = '[0]'"), nodes.where("kind = 'value'"))
    assert below.count() == 2
    assert nested.elements(nested.label_nodes(df.limit(0), "id", "details", "t")).count() == 0


def test_parents_come_from_the_intervals(monkeypatch):
    doc = {"a": [{"b": [1, [2]]}]}
    right = [(n[4], n[5]) for n in nested.labelled(doc)]
    assert ("a[0].b[1][0]", "a[0].b[1]") in right and ("a[0].b[1]", "a[0]") in right
    monkeypatch.setattr(nested, "enclosing", lambda nodes: [-1] * len(nodes))
    assert [(n[4], n[5]) for n in nested.labelled(doc)] != right
