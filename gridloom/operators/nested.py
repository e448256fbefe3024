"""Deeply nested graph cells as flat related tables (problem 3).

A cell is JSON text ``{type, graph: {nodes, edges, graph}}``; an edge can hold
a ``subgraph`` that is again a cell. Nested ``transform`` calls attach the
ancestors' keys and positions, ``flatten`` combines the levels and one
``inline`` per target table (networks, nodes, edges) emits the rows.

One projection reaches ``LEVELS`` levels of subgraphs. What lies deeper comes out
of it as pending cells, which the same projection takes up again until none is
left, so that any depth is covered.

Cells that the variant parser refuses but Python's reads (a repeated key, of which the last holds, or a number that is not
finite, which becomes null) are written anew and taken up like pending ones; only they pass through Python.

Defined results for odd input: cells that are null, blank or not readable as
JSON give no row, nor do those nested over about 1,000 lists and objects deep; null entries of the lists give no row but are counted in the
positions; missing lists count as empty; a missing end id is null; cells that
are text inside JSON are read, over up to three wrappings. Extra columns are not read.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut

LEVELS = 4
_TEXT = "string"


def _get(value: str, path: str, kind: str = _TEXT) -> str:
    return f"try_variant_get({value}, '{path}', '{kind}')"


def _first(value: str, *paths: str) -> str:
    return f"coalesce({', '.join(_get(value, p) for p in paths)})"


def _list(cell: str, what: str) -> str:
    """A list of the cell, of which the ``graph`` member can be text inside JSON."""
    return f"coalesce({_get(cell, f'$.graph.{what}', 'array<variant>')}, array())"


def _attr(entry: str, name: str, kind: str = _TEXT) -> str:
    paths = (f"$[1].{name}", f"$.attrs.{name}", f"$[2].{name}", f"$[3].{name}", f"$.{name}")
    return "coalesce(" + ", ".join(_get(entry, p, kind) for p in paths) + ")"


def _subcell(entry: str) -> str:
    """The cell below an edge as a variant: an object, or text that holds one."""
    # an object's member is reached directly; for text the string is parsed (twice for text within text)
    held = _attr(entry, "subgraph", "variant")
    return f"(case when {_attr(entry, 'subgraph.graph', 'variant')} is not null then {held} else {_reparsed(_attr(entry, 'subgraph'))} end)"


def _reparsed(text: str) -> str:
    once = f"try_parse_json({text})"
    return f"(case when ltrim({text}) like '\"%' then try_parse_json({_get(once, '$')}) else {once} end)"


def _u(e: str) -> str:
    return _first(e, "$[0][0]", "$.source", "$.u", "$[0]")


def _v(e: str) -> str:
    return f"(case when {_get(e, '$[0][0]')} is not null then {_get(e, '$[0][1]')} else {_first(e, '$.target', '$.v', '$[1]')} end)"


def _edge(e: str, i: str, path: str) -> str:
    here = f"concat({path}, cast({i} as string))"
    return (
        f"named_struct('parent', nullif(trim(trailing '/' from {path}), ''), 'path', {here}, 'position', {i}, 'a', {_u(e)}, 'b', {_v(e)}, "
        f"'key', {_first(e, '$[0][2]', '$.key')}, 'length', {_attr(e, 'length', 'double')}, 'prob', {_attr(e, 'prob', 'double')}, "
        f"'geometry', {_attr(e, 'geometry')}, 'pending', cast(null as string))"
    )


def _node(e: str, i: str, path: str) -> str:
    return (
        f"named_struct('parent', nullif(trim(trailing '/' from {path}), ''), 'position', {i}, 'node', coalesce({_first(e, '$[0]', '$.id')}, {_get(e, '$')}), "
        f"'x', coalesce({_attr(e, 'pos[0]', 'double')}, {_attr(e, 'pos.x', 'double')}), 'y', coalesce({_attr(e, 'pos[1]', 'double')}, {_attr(e, 'pos.y', 'double')}), "
        f"'weight', {_attr(e, 'weight', 'double')}, 'is_source', {_attr(e, 'is_source', 'boolean')}, 'loads', {_attr(e, 'loads')}, "
        f"'path', {path}, 'pending', cast(null as string))"
    )


def _network(cell: str, path: str) -> str:
    return (
        f"named_struct('parent', nullif(trim(trailing '/' from {path}), ''), 'type', {_get(cell, '$.type')}, 'n_nodes', size({_list(cell, 'nodes')}), "
        f"'n_edges', size({_list(cell, 'edges')}), 'attributes', {_get(cell, '$.graph.graph')}, 'path', {path}, 'pending', cast(null as string))"
    )


_EMPTY = {
    "edges": "named_struct('parent', cast(null as string), 'path', {path}, 'position', cast(null as int), 'a', cast(null as string), 'b', cast(null as string), 'key', cast(null as string), 'length', cast(null as double), 'prob', cast(null as double), 'geometry', cast(null as string), 'pending', {pending})",
    "nodes": "named_struct('parent', cast(null as string), 'position', cast(null as int), 'node', cast(null as string), 'x', cast(null as double), 'y', cast(null as double), 'weight', cast(null as double), 'is_source', cast(null as boolean), 'loads', cast(null as string), 'path', {path}, 'pending', {pending})",
    "networks": "named_struct('parent', cast(null as string), 'type', cast(null as string), 'n_nodes', cast(null as int), 'n_edges', cast(null as int), 'attributes', cast(null as string), 'path', {path}, 'pending', {pending})",
}


def _some(e: str) -> str:
    return f"({e} is not null and not is_variant_null({e}))"


def _rows(cell: str, path: str, table: str, level: int, levels: int) -> str:
    """SQL array of the rows of ``table`` in ``cell`` and, level by level, in its subgraphs.

    ``path`` is the SQL text of the positions above, ending in ``/`` or empty.
    """
    e, i, c = f"e{level}", f"i{level}", f"c{level}"
    edges = _list(c, "edges")
    below_path = f"concat({path}, cast({i} as string), '/')"
    if level + 1 < levels:
        below = _rows(_subcell(e), below_path, table, level + 1, levels)
    else:
        pending = _EMPTY[table].format(path=below_path, pending=f"cast({_subcell(e)} as string)")
        below = f"filter(array({pending}), z -> z.pending is not null)"
    if table == "edges":
        deep = f"flatten(transform({edges}, ({e}, {i}) -> if({_some(e)}, concat(array({_edge(e, i, path)}), {below}), cast(array() as {_TYPES[table]}))))"
        return f"coalesce(element_at(transform(array({cell}), {c} -> {deep}), 1), cast(array() as {_TYPES[table]}))"
    if table == "nodes":
        n, j = f"n{level}", f"j{level}"
        here = f"flatten(transform({_list(c, 'nodes')}, ({n}, {j}) -> if({_some(n)}, array({_node(n, j, path)}), cast(array() as {_TYPES[table]}))))"
    else:
        here = f"if({c} is null or is_variant_null({c}), cast(array() as {_TYPES[table]}), array({_network(c, path)}))"
    deep = f"flatten(transform({edges}, ({e}, {i}) -> if({_some(e)}, {below}, cast(array() as {_TYPES[table]}))))"
    return f"coalesce(element_at(transform(array({cell}), {c} -> concat({here}, {deep})), 1), cast(array() as {_TYPES[table]}))"


_TYPES = {
    "edges": "array<struct<parent:string,path:string,position:int,a:string,b:string,key:string,length:double,prob:double,geometry:string,pending:string>>",
    "nodes": "array<struct<parent:string,position:int,node:string,x:double,y:double,weight:double,is_source:boolean,loads:string,path:string,pending:string>>",
    "networks": "array<struct<parent:string,type:string,n_nodes:int,n_edges:int,attributes:string,path:string,pending:string>>",
}


def _cells(networks: DataFrame, roots: tuple[str, ...]) -> DataFrame:
    stacked = networks.select("rec_id", F.explode(F.array(*[F.struct(F.lit(r).alias("root"), F.col(r).cast("string").alias("text")) for r in roots])).alias("c"))
    return stacked.select("rec_id", "c.root", F.lit("").alias("path"), "c.text").where("text is not null")


def _finite(value: object) -> object:
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


def _anew(column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[str | None] = []
            for text in b.column(column).to_pylist():
                try:
                    value = json.loads(text)
                    for _ in range(3):
                        value = json.loads(value) if isinstance(value, str) else value
                    texts.append(json.dumps(_finite(value)))
                except (ValueError, RecursionError):
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(column)], pa.array(texts, pa.string())], names=b.schema.names)

    return run


def flatten(networks: DataFrame, target: str, roots: tuple[str, ...] = ("graph", "optimal_network"), levels: int = LEVELS) -> DataFrame:
    """Rows of ``target`` (``networks``, ``nodes`` or ``edges``) at any depth.

    Every row has ``rec_id`` and ``root`` of its record, and ``parent``: the path
    of the edge whose subgraph it lies in, null at the top.
    """
    cells, done, first = _cells(networks, roots), None, True
    refused = _EMPTY[target].format(path="above", pending="text").replace("'parent', cast(null as string)", "'parent', 'refused'")
    while True:
        parsed = cells.select("rec_id", "root", F.col("path").alias("above"), "text", F.expr(_reparsed("text")).alias("once"))
        parsed = parsed.select("rec_id", "root", "above", "text", F.expr(f"case when {_get('once', '$.graph', 'variant')} is not null then once else {_reparsed(_get('once', '$'))} end").alias("cell"), F.col("once").isNull().alias("bad"))
        # a pass's rows are written once: the pending cells are read from there, not parsed again
        every = _rows("cell", "above", target, 0, levels)
        every = f"if(bad and trim(text) <> '', array({refused}), {every})" if first else every
        rows = cut(parsed.select("rec_id", "root", F.expr(f"inline({every})")))
        flat = rows.where("pending is null").drop("pending")
        done = flat if done is None else done.unionByName(flat)
        left = rows.where("pending is not null").select("rec_id", "root", "path", "parent", F.col("pending").alias("text"))
        if left.isEmpty():
            return done
        deeper = left.where("parent is distinct from 'refused'").drop("parent")
        if first:
            kind = left.schema["rec_id"].dataType.simpleString()
            again = left.where("parent = 'refused'").drop("parent").mapInArrow(_anew(3), f"rec_id {kind}, root string, path string, text string")
            deeper = deeper.unionByName(again.where("text is not null"))
        cells, first = deeper, False


def edge_ends(networks: DataFrame) -> DataFrame:
    """``rec_id, root, path, u, v``: each edge at any depth with its end ids, the smaller text in ``u``."""
    e = flatten(networks, "edges")
    return e.select("rec_id", "root", "path", F.when(F.col("b") < F.col("a"), F.col("b")).otherwise(F.col("a")).alias("u"), F.when(F.col("b") < F.col("a"), F.col("a")).otherwise(F.col("b")).alias("v")).distinct()
