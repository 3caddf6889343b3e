"""Nested JSON fields to flat tables, with interval labels for parent-child links.

Every node of a document (object, array, plain value) gets a pre-order and a
post-order number by one depth-first walk. A node lies inside another exactly
if its pre-order number is larger and its post-order number smaller, so a
descendant query is a range comparison within one row and needs no path
matching; the parent of a node is found the same way. Documents are independent: the walk is a map over rows, without a
shuffle; only the links between node tables are joins, on (table, row).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODES = (
    "source_table string, row_id bigint, pre bigint, post bigint, depth int, kind string, node_path string,"
    " parent_path string, is_element boolean, key string, value string"
)


def load(field: str | None) -> Any:
    """The document of a field, read once more if it is a JSON string that itself holds JSON.

    None for null, blank or damaged fields, and for a string without JSON in it.
    """
    if not field:
        return None
    try:
        if "\\ud" in field or "\\uD" in field:  # lone surrogates cannot be stored as text
            field = json.dumps(json.loads(field), ensure_ascii=False).encode("utf-8", "replace").decode()
        doc = json.loads(field)
        if isinstance(doc, str):
            doc = json.loads(doc)
    except (ValueError, RecursionError):
        return None
    return doc


def _kind(value: Any) -> str:
    if isinstance(value, dict):
        return "object"
    if isinstance(value, list):
        return "array"
    return "value" if value is not None else "null"


def walk(doc: Any) -> Iterator[tuple]:
    """(pre, post, depth, kind, path, is array element, key, value) of every node.

    An explicit stack: nesting depth is bounded by the text, not by Python's
    recursion limit. Nodes come out in post-order, which is when their second
    number is known.
    """
    pre = post = 0
    # node: value, path, is element, key, depth, pre, children
    stack = [[doc, "", False, None, 0, 0, None]]
    while stack:
        node = stack[-1]
        value, path, is_element, key, depth = node[:5]
        if node[6] is None:
            node[5] = pre
            pre += 1
            if isinstance(value, dict):
                node[6] = iter([[v, f"{path}.{k}" if path else k, False, k, depth + 1, 0, None] for k, v in value.items()])
            elif isinstance(value, list):
                node[6] = iter([[v, f"{path}[{i}]", True, None, depth + 1, 0, None] for i, v in enumerate(value)])
            else:
                node[6] = iter(())
        child = next(node[6], None)
        if child is not None:
            stack.append(child)
            continue
        stack.pop()
        kind = _kind(value)
        plain = None if kind != "value" else value if isinstance(value, str) else json.dumps(value)
        yield node[5], post, depth, kind, path, is_element, key, plain
        post += 1


def enclosing(nodes: list[tuple[int, int, bool]]) -> list[int]:
    """For nodes (pre, post, is element) in pre-order: the place of the nearest element around each, -1 without one.

    A structural join by interval labels alone: an element holds a node that
    comes later in pre-order and earlier in post-order. The elements open at a
    node lie on a stack; those whose post-order number is smaller have ended.
    """
    out = []
    open_: list[int] = []
    for i, (_pre, post, is_element) in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] < post:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        if is_element:
            open_.append(i)
    return out


def labelled(doc: Any) -> Iterator[tuple]:
    """The nodes of a document in pre-order, in NODES' columns from `pre` on: parent paths come from the intervals."""
    nodes = sorted(walk(doc), key=lambda n: n[0])
    around = enclosing([(pre, post, is_element) for pre, post, _, _, _, is_element, _, _ in nodes])
    for (pre, post, depth, kind, path, is_element, key, plain), i in zip(nodes, around):
        yield pre, post, depth, kind, path, nodes[i][4] if i >= 0 else "", is_element, key, plain


def label_nodes(df: DataFrame, row_id: str, field: str, source_table: str) -> DataFrame:
    """One row per node of the field's documents, with its interval labels.

    Null, blank and damaged fields give nothing. A JSON null is a node of kind
    ``null``; positions in arrays count nulls. A repeated key keeps its last
    value, as JSON readers do. Rows stored twice give their nodes twice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cols = [], [[] for _ in range(9)]

            def flush() -> pa.RecordBatch:
                n = len(ids)
                arrays = [
                    pa.array([source_table] * n, pa.string()),
                    pa.array(ids, pa.int64()),
                    *(
                        pa.array(c, t)
                        for c, t in zip(
                            cols,
                            (pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 3, pa.bool_(), *[pa.string()] * 2),
                        )
                    ),
                ]
                return pa.record_batch(arrays, names=[x.split()[0] for x in NODES.split(", ")])

            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                doc = load(text)
                if doc is None:
                    continue
                for node in labelled(doc):
                    ids.append(rid)
                    for c, v in zip(cols, node):
                        c.append(v)
                if len(ids) >= 50_000:  # bounds the worker's memory, whatever the fields hold
                    yield flush()
                    ids, cols = [], [[] for _ in range(9)]
            if ids:
                yield flush()

    return (
        df.where(F.col(field).isNotNull())
        .select(F.col(row_id).cast("bigint"), F.col(field).cast("string"))
        .mapInArrow(run, NODES)
    )


def elements(nodes: DataFrame) -> DataFrame:
    """The non-null array elements: (source_table, row_id, node_path, parent_path)."""
    return nodes.where("is_element and kind <> 'null'").select("source_table", "row_id", "node_path", "parent_path")


def node_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """One table per kind of node: objects, arrays and values, keyed by (source_table, row_id, pre)."""
    keys = ("source_table", "row_id", "pre", "post", "depth", "node_path", "parent_path", "is_element", "key")
    return {
        "objects": nodes.where("kind = 'object'").select(*keys),
        "arrays": nodes.where("kind = 'array'").select(*keys),
        "values": nodes.where("kind = 'value'").select(*keys, "value"),
    }


def inside(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Pairs (outer, inner) of nodes of one row in which the inner lies within the outer, by interval containment."""
    o = outer.select("source_table", "row_id", *(F.col(c).alias(f"outer_{c}") for c in ("pre", "post", "node_path")))
    i = inner.select("source_table", "row_id", *(F.col(c).alias(f"inner_{c}") for c in ("pre", "post", "node_path")))
    return o.join(i, ["source_table", "row_id"]).where("inner_pre > outer_pre and inner_post < outer_post")
