"""Schemas that drift between files (problem 2).

Lines of JSON files are loaded as maps from path to value with raw types, path-type
statistics are aggregated per file, consecutive files of a stream are compared,
and the runs come out as one typed table with the casts that failed.

Parsing, kinds, statistics and typed columns stay in the JVM (variants). Python sees two things only:
the lines that the variant parser refuses (a repeated key, a number that is not finite; the last of repeated
keys holds), and the values of fields that end or begin with a file, which are brought to one form to be compared.

Defined results for odd input:

* null, blank, cut-off lines and lines that are no JSON object give no entries,
  but their file still takes its place in the stream;
* ``null`` and ``[]`` are no values; null elements of an array have no kind;
* a run without ``run_id`` counts for fields and kinds, not for renames or the table of runs;
* repeated lines change nothing; of a run written differently twice in one file,
  every version must agree for a rename, and the later line holds in the table of runs;
* files written at the same moment follow each other by ``file_id``;
* numbers that are not finite count as numbers and as equal; a whole number of over 38 digits counts as its double;
* the JSON text of an object has its members in order of name, a number no zeros at its end;
* an empty table gives empty results; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut

_ID = re.compile(r"[A-Za-z]?(-?\d+)\Z")
_LIST = re.compile(r"\s*[;,|]\s*")


# --- one form of a value, for comparison only ------------------------------------


def kind_of(value: object) -> str | None:
    """Raw type of a JSON value; an array carries the set of its elements' kinds."""
    if value is None or value == []:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    inner = {"array" if isinstance(x, list) else kind_of(x) for x in value if x is not None}
    return f"array<{','.join(sorted(inner))}>"


def _number(value: int | float) -> int | float | str:
    if isinstance(value, float):
        if math.isfinite(value) and value == int(value):
            return int(value)
        return value if math.isfinite(value) else repr(value)
    return value


def _graph(nodes: list, edges: list) -> dict:
    text = lambda x: json.dumps(x, sort_keys=True)
    return {"edges": sorted(map(content_of, edges), key=text), "nodes": sorted(map(content_of, nodes), key=text)}


def content_of(value: object) -> object:
    """One form for the forms in which the same content is written; it is compared, never stored as the value.

    Numbers as text, JSON as text, lists of ids as text or as the keys of an
    object, single values in lists, and graphs as cell or as pair of lists.
    """
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return _number(value)
    if isinstance(value, str):
        text = value.strip()
        if text[:1] in ("{", "[", '"') or text in ("true", "false"):
            try:
                return content_of(json.loads(text))
            except (ValueError, RecursionError):
                return text
        try:
            return _number(int(text) if re.fullmatch(r"[+-]?\d{1,400}", text) else float(text)) if re.match(r"[+-]?[\d.]", text) else _named(text)
        except ValueError:
            return _named(text)
    if isinstance(value, dict):
        inner = value.get("graph")
        if isinstance(inner, str):
            inner = content_of(inner)
        cell = inner if isinstance(inner, dict) else value
        if isinstance(cell.get("nodes"), list) and isinstance(cell.get("edges"), list):
            return _graph(cell["nodes"], cell["edges"])
        ids = [_ID.match(k) for k in value]
        if value and all(ids) and all(v in (1, True) for v in value.values()):
            return _ids([int(m.group(1)) for m in ids])
        return {k: content_of(v) for k, v in sorted(value.items())}
    if len(value) == 2 and all(isinstance(x, list) for x in value) and all(isinstance(x, list) for part in value for x in part) and all(x and isinstance(x[0], list) for x in value[1]) and not any(x and isinstance(x[0], list) for x in value[0]):
        return _graph(*value)
    items = [content_of(x) for x in value]
    if items and all(isinstance(x, int) and not isinstance(x, bool) for x in items):
        return _ids(items)
    return items[0] if len(items) == 1 and not isinstance(items[0], (dict, list)) else items


def _ids(items: list[int]) -> object:
    return items[0] if len(items) == 1 else sorted(items)


def _named(text: str) -> object:
    parts = [_ID.match(x) for x in _LIST.split(text)] if text else []
    return _ids([int(m.group(1)) for m in parts]) if parts and all(parts) else text


def canonical(value: object) -> str:
    return json.dumps(content_of(value), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _digests(texts: pd.Series) -> pd.Series:
    one = lambda t: hashlib.blake2b(canonical(json.loads(t)).encode("utf-8", "replace"), digest_size=16).digest()
    return texts.map(one)


# --- path-value maps ----------------------------------------------------------------

_FIELDS = "map<string,variant>"
#: Closes the list that a line is read in, so that text after the record is seen.
_END = 8123749812374


def _fields(body: str) -> Column:
    """The record of a line as a map; null where the parser refuses the line, or where it is no object."""
    whole = f"try_parse_json(concat('[', {body}, ',{_END}]'))"
    return F.expr(f"transform(array({whole}), w -> case when try_variant_get(w, '$[1]', 'bigint') = {_END} and try_variant_get(w, '$[2]', 'string') is null then try_variant_get(w, '$[0]', '{_FIELDS}') end)[0]")


def _base(schema: str) -> str:
    numbers = " or ".join(f"{schema} like '{t}%'" for t in ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"))
    return f"case when {numbers} then 'number' when {schema} like 'STRING%' then 'string' when {schema} like 'BOOLEAN%' then 'boolean' when {schema} like 'OBJECT%' then 'object' when {schema} like 'ARRAY%' then 'array' end"


def _kind(value: str, schema: str) -> Column:
    """As :func:`kind_of`, of a variant and its ``schema_of_variant``."""
    items = f"cast({value} as array<variant>)"
    mixed = f"array_join(array_sort(array_distinct(array_compact(transform({items}, x -> transform(array(schema_of_variant(x)), s -> {_base('s')})[0])))), ',')"
    return F.expr(
        f"case when {schema} = 'ARRAY<VOID>' then if(size({items}) = 0, null, 'array<>') when {schema} = 'ARRAY<VARIANT>' then concat('array<', {mixed}, '>') "
        f"when {schema} like 'ARRAY<%' then concat('array<', {_base(f'substring({schema}, 7)')}, '>') else {_base(schema)} end"
    )


def _bare(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("stream_id").cast("bigint"), F.col("file_id").cast("bigint"), F.col("line_no").cast("bigint"), F.col("body").cast("string")).where("trim(body) <> ''")


def _plain(value: object) -> object:
    """Numbers that are not finite as one that the variant parser takes."""
    if isinstance(value, float) and not math.isfinite(value):
        return math.inf
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines that the variant parser refused, written anew where they are JSON objects for Python."""
    for b in batches:
        texts: list[str | None] = []
        for body in b.column(3).to_pylist():
            try:
                record = json.loads(body)
                texts.append(json.dumps(_plain(record)).replace("Infinity", "1e999") if isinstance(record, dict) else None)
            except (ValueError, RecursionError):
                texts.append(None)
        yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array(texts, pa.string())], names=["stream_id", "file_id", "line_no", "body"])


class Records:
    """The lines as path-value maps, and what their fields are in each file.

    One scan parses every line and aggregates ``stats``: ``stream_id, file_id, path, kinds, n_values``. Refused
    lines come out of the same scan, so that only they pass through Python.
    """

    def __init__(self, lines: DataFrame, run_field: str = "run_id"):
        self.lines, self.run_field = _bare(lines), run_field
        # values without kind are left out after the cut: a filter on the kind would be worked out twice
        counted = cut(self._kinds(self.lines)).where("kind is not null")
        again = counted.where("path is null").select("stream_id", "file_id", "line_no", F.col("kind").alias("body"))
        self.refused = cut(again.mapInArrow(_again, "stream_id bigint, file_id bigint, line_no bigint, body string").where("body is not null"))
        self.some_refused = not self.refused.isEmpty()
        known = counted.where("path is not null").select("stream_id", "file_id", "path", "kind", "n")
        if self.some_refused:
            known = known.unionByName(self._kinds(self.refused).where("kind is not null and path is not null").select("stream_id", "file_id", "path", "kind", "n"))
        self.stats = known.groupBy("stream_id", "file_id", "path").agg(F.concat_ws("|", F.array_sort(F.collect_set("kind"))).alias("kinds"), F.sum("n").alias("n_values"))

    def _kinds(self, rows: DataFrame) -> DataFrame:
        """``stream_id, file_id, line_no, path, kind, n``; a refused line has its text as kind, and no path, a value that is none no kind."""
        parsed = rows.withColumn("fields", _fields("body"))
        each = parsed.select("stream_id", "file_id", "line_no", F.when(F.col("fields").isNull(), F.col("body")).alias("body"), F.explode_outer("fields").alias("path", "v"))
        named = each.where((F.col("path") != self.run_field) | F.col("path").isNull()).withColumn("schema", F.schema_of_variant("v"))
        kinds = named.select("stream_id", "file_id", F.when(F.col("path").isNull(), F.col("line_no")).alias("line_no"), "path", F.coalesce("body", _kind("v", "schema")).alias("kind"))
        return kinds.groupBy("stream_id", "file_id", "line_no", "path", "kind").agg(F.count("*").alias("n"))

    def values(self, wanted: DataFrame | None = None) -> DataFrame:
        """``stream_id, file_id, line_no, run_id, path, value``: each value as JSON text, of runs with an id.

        With ``wanted`` (``stream_id, file_id, paths``) only those files' lines are parsed, and only those fields come out.
        """
        rows = self.lines.unionByName(self.refused) if self.some_refused else self.lines
        if wanted is not None:
            rows = rows.join(wanted, ["stream_id", "file_id"])
        run = f"fields['{self.run_field}']"
        run_id = F.expr(f"case when schema_of_variant({run}) in ('STRING', 'VOID') then try_variant_get({run}, '$', 'string') else to_json({run}) end")
        parsed = rows.withColumn("fields", _fields("body"))
        # everything is left out within the map: a filter on what is made of the fields would parse the lines twice
        some = "not is_variant_null(v) and (try_variant_get(v, '$[0]', 'variant') is not null or try_variant_get(v, '$', 'array<variant>') is null)"
        named = "" if wanted is None else "array_contains(paths, k) and "
        held = F.expr(f"case when {run} is not null and not is_variant_null({run}) then map_filter(fields, (k, v) -> k <> '{self.run_field}' and {named}{some}) end")
        each = parsed.select("stream_id", "file_id", "line_no", run_id.alias("run_id"), F.explode(held).alias("path", "v"))
        return each.select("stream_id", "file_id", "line_no", "run_id", "path", F.to_json("v").alias("value"))


def file_order(lines: DataFrame) -> DataFrame:
    """``stream_id, file_id, seq``: the place of each file in its stream, from 1."""
    files = lines.groupBy(F.col("stream_id").cast("bigint").alias("stream_id"), F.col("file_id").cast("bigint").alias("file_id")).agg(F.min("written_at").alias("written_at"))
    return files.select("stream_id", "file_id", F.row_number().over(Window.partitionBy("stream_id").orderBy("written_at", "file_id")).alias("seq"))


# --- changes from file to file ---------------------------------------------------------


def _compare(stats: DataFrame, files: DataFrame) -> DataFrame:
    """``stream_id, seq, file_id, prev_id, path, kinds, old_kinds`` of all files but the first of a stream."""
    following = Window.partitionBy("stream_id").orderBy("seq")
    steps = files.withColumn("prev_id", F.lag("file_id").over(following)).withColumn("next_id", F.lead("file_id").over(following))
    # each statistic counts once for its own file and once for the file after it
    sides = stats.join(steps, ["stream_id", "file_id"]).select(
        "stream_id",
        "path",
        F.explode(
            F.array(
                F.struct(F.col("file_id").alias("file_id"), F.col("kinds").alias("kinds"), F.lit(None).cast("string").alias("old_kinds")),
                F.struct(F.col("next_id").alias("file_id"), F.lit(None).cast("string").alias("kinds"), F.col("kinds").alias("old_kinds")),
            )
        ).alias("side"),
    )
    both = sides.where("side.file_id is not null").groupBy("stream_id", F.col("side.file_id").alias("file_id"), "path").agg(F.max("side.kinds").alias("kinds"), F.max("side.old_kinds").alias("old_kinds"))
    return both.join(steps.where("prev_id is not null").select("stream_id", "file_id", "prev_id"), ["stream_id", "file_id"])


def renames(records: Records, compared: DataFrame) -> DataFrame:
    """``stream_id, file_id, old_path, new_path``: ended and begun fields with the same content in all shared runs.

    Only files with an ended and a begun field are read again, and only those fields.
    Candidates come from an equi-join on run and content, so no pairs of fields
    are enumerated; each is then held against all runs with values in both files.
    """
    ended, begun = F.col("kinds").isNull(), F.col("old_kinds").isNull()
    moving = compared.where(ended | begun)
    mixed = moving.groupBy("stream_id", "file_id").agg(F.bool_or(ended).alias("e"), F.bool_or(begun).alias("b")).where("e and b").select("stream_id", "file_id")
    sides = cut(moving.join(mixed, ["stream_id", "file_id"]).select("stream_id", F.col("file_id").alias("at"), F.when(ended, F.col("prev_id")).otherwise(F.col("file_id")).alias("file_id"), "path", ended.alias("is_old")))
    wanted = sides.groupBy("stream_id", "file_id").agg(F.collect_set("path").alias("paths"))
    digest = F.pandas_udf(_digests, "binary")
    values = records.values(wanted).select("stream_id", "file_id", "run_id", "path", digest("value").alias("digest"))
    # one row for each step, run and field; a run written differently twice has two digests and agrees with none
    sided = values.join(sides, ["stream_id", "file_id", "path"])
    one = cut(sided.repartition("stream_id", "at", "run_id").groupBy("stream_id", "at", "run_id", "path", "is_old").agg(F.min("digest").alias("digest"), F.max("digest").alias("other")))
    versions = one.select("stream_id", "at", "run_id", "path", "is_old", F.explode(F.array_distinct(F.array("digest", "other"))).alias("digest"))
    old, new = versions.where("is_old").drop("is_old").withColumnRenamed("path", "old_path"), versions.where("not is_old").drop("is_old").withColumnRenamed("path", "new_path")
    candidates = old.join(new, ["stream_id", "at", "run_id", "digest"]).select("stream_id", "at", "old_path", "new_path").distinct()
    side = lambda is_old, name, tail: one.where(F.col("is_old") == is_old).select("stream_id", "at", "run_id", F.col("path").alias(name), F.col("digest").alias(f"low{tail}"), F.col("other").alias(f"high{tail}"))
    held = candidates.join(side(True, "old_path", 1), ["stream_id", "at", "old_path"]).join(side(False, "new_path", 2), ["stream_id", "at", "new_path", "run_id"])
    same = (F.col("low1") == F.col("low2")) & (F.col("low1") == F.col("high1")) & (F.col("low2") == F.col("high2"))
    agreed = held.groupBy("stream_id", "at", "old_path", "new_path").agg(F.bool_and(same).alias("same"))
    return agreed.where("same").select("stream_id", F.col("at").alias("file_id"), "old_path", "new_path")


def changes(lines: DataFrame) -> DataFrame:
    """The report: ``stream_id, file_id, field, change, old_field, old_kinds, kinds``.

    ``change`` is ``added``, ``removed``, ``renamed`` or ``retyped``; a field can
    be renamed and retyped by the same file.
    """
    records = Records(lines)
    compared = cut(_compare(records.stats, file_order(lines)))
    moved = cut(renames(records, compared))
    to_old = moved.groupBy("stream_id", "file_id", F.col("new_path").alias("path")).agg(F.min("old_path").alias("old_path"))
    gone = moved.select("stream_id", "file_id", F.col("old_path").alias("path")).distinct()
    none = F.lit(None).cast("string")

    def rows(df: DataFrame, change: str, old_field: Column) -> DataFrame:
        return df.select("stream_id", "file_id", F.col("path").alias("field"), F.lit(change).alias("change"), old_field.alias("old_field"), "old_kinds", "kinds")

    begun, ended = compared.where("old_kinds is null"), compared.where("kinds is null")
    renamed = begun.drop("old_kinds").join(to_old, ["stream_id", "file_id", "path"]).join(ended.select("stream_id", "file_id", F.col("path").alias("old_path"), "old_kinds"), ["stream_id", "file_id", "old_path"])
    return (
        rows(begun.join(to_old, ["stream_id", "file_id", "path"], "left_anti"), "added", none)
        .unionByName(rows(ended.join(gone, ["stream_id", "file_id", "path"], "left_anti"), "removed", none))
        .unionByName(rows(renamed, "renamed", F.col("old_path")))
        .unionByName(rows(renamed.where("kinds <> old_kinds"), "retyped", F.col("old_path")))
        .unionByName(rows(compared.where("kinds <> old_kinds"), "retyped", none))
    )


# --- the consistent table of runs --------------------------------------------------------

#: Columns of the table of runs and their kinds; besides SQL types, ``graph`` (a cell in one form) and ``ids`` (a list of whole numbers).
RUN_COLUMNS = {"graph": "graph", "sources": "ids", "n": "bigint", "p": "array<double>", "rho": "double", "trial": "bigint", "saidi": "double"}


def _alike(name: Column) -> Column:
    """A name without letter case, marks and plural."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), "(?<=..)s$", "")


def aliases(moved: DataFrame, names: DataFrame, targets: list[str], match_names: bool = True, agreed_elsewhere: bool = False) -> DataFrame:
    """``stream_id, path, target``: the column that each field name of a stream stands for.

    ``moved`` (``stream_id, old_path, new_path``) are the stream's renames, ``names`` (``stream_id, path``) its fields. A column's own
    name stands for it, with ``match_names`` also names that differ in letter case, marks or plural only; renames of
    the same stream are followed from there in both directions until a round finds no new name. The nearest
    column wins, then the one with the most renames, then the last by name.

    With ``agreed_elsewhere``, a name without meaning in its own stream takes the one that renames gave it in
    other streams, if all of those agree.
    """
    spark = moved.sparkSession
    links = moved.select("stream_id", F.col("old_path").alias("a"), F.col("new_path").alias("b"))
    links = cut(links.unionByName(links.select("stream_id", F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("stream_id", "a", "b").agg(F.count("*").alias("n")))
    wanted = F.broadcast(spark.createDataFrame([(t,) for t in targets], "target string"))
    fields = names.select("stream_id", "path").distinct()
    exact = fields.join(wanted, F.col("path") == F.col("target")).select("stream_id", "path", "target")
    if match_names:
        near = fields.join(wanted, (_alike(F.col("path")) == _alike(F.col("target")))).groupBy("stream_id", "path").agg(F.min("target").alias("target"))
        exact = exact.unionByName(near.join(exact, ["stream_id", "path"], "left_anti"))
    known = latest = cut(exact)
    while True:
        reached = links.join(latest.withColumnRenamed("path", "a"), ["stream_id", "a"]).groupBy("stream_id", "b", "target").agg(F.sum("n").alias("n"))
        best = reached.groupBy("stream_id", F.col("b").alias("path")).agg(F.max_by("target", F.struct(F.col("n"), F.col("target"))).alias("target"))
        latest = cut(best.join(known, ["stream_id", "path"], "left_anti"))
        if latest.isEmpty():
            break
        known = cut(known.unionByName(latest))
    if agreed_elsewhere:
        agreed = known.groupBy("path").agg(F.min("target").alias("target"), F.max("target").alias("other")).where("target = other").drop("other")
        known = known.unionByName(fields.join(known, ["stream_id", "path"], "left_anti").join(agreed, "path").select("stream_id", "path", "target"))
    return known


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _opened(v: str) -> str:
    """A variant whose text is again JSON, opened (over two wrappings)."""
    once = lambda x: f"(case when schema_of_variant({x}) = 'STRING' and ltrim(try_variant_get({x}, '$', 'string')) rlike '^[\\\\[{{\"]' then coalesce(try_parse_json(try_variant_get({x}, '$', 'string')), {x}) else {x} end)"
    return _let(once(v), "o1", once("o1"))


def _scalar(v: str, kind: str) -> str:
    """A number (or other SQL type) from a variant; null where that would change it, as for 4.7 as a whole number or ``true`` as a number."""
    typed, text = f"try_variant_get({v}, '$', '{kind}')", f"trim(try_variant_get({v}, '$', 'string'))"
    if kind in ("string", "boolean"):
        return typed
    typed = f"if(schema_of_variant({v}) = 'STRING', try_cast({text} as {kind}), {typed})"
    exact = f"cast({typed} as double) = try_cast({text} as double)" if kind in ("bigint", "int") else "true"
    return f"case when schema_of_variant({v}) <> 'BOOLEAN' and {exact} then {typed} end"


def _items(v: str, ids: bool) -> str:
    """The elements of a list, of text that lists them, or of an object whose keys they are (``{"4": 1}``, in order of number)."""
    text = f"try_variant_get({v}, '$', 'string')"
    split = f"transform(split(trim({text}), '\\\\s*[;,|]\\\\s*'), z -> cast(z as variant))"
    keys = f"map_keys(cast({v} as {_FIELDS}))"
    key_number = lambda k: f"try_cast(regexp_extract({k}, '^[A-Za-z]?(-?[0-9]+)$', 1) as bigint)"
    listed = f"transform(array_sort({keys}, (l, r) -> int(sign({key_number('l')} - {key_number('r')}))), z -> cast(z as variant))"
    by_object = f"when schema_of_variant({v}) like 'OBJECT%' and forall({keys}, k -> {key_number('k')} is not null) then {listed}" if ids else ""
    return f"case when schema_of_variant({v}) like 'ARRAY%' then cast({v} as array<variant>) when schema_of_variant({v}) = 'STRING' then {split} {by_object} else array({v}) end"


def _typed(raw: str, kind: str) -> tuple[Column, Column]:
    """``(value, failed)`` of the JSON text in column ``raw``."""
    opened = _let(f"try_parse_json({raw})", "v0", _opened("v0"))
    if kind == "graph":
        # the cell, its members alone, or a pair of lists
        lists = lambda c: f"case when try_variant_get({c}, '$.nodes', 'array<variant>') is not null and try_variant_get({c}, '$.edges', 'array<variant>') is not null then named_struct('n', try_variant_get({c}, '$.nodes', 'variant'), 'e', try_variant_get({c}, '$.edges', 'variant')) end"
        inner = _let("try_variant_get(v, '$.graph', 'variant')", "g0", _let(_opened("g0"), "g", lists("g")))
        pair = "case when try_variant_get(v, '$[0]', 'array<variant>') is not null and try_variant_get(v, '$[1]', 'array<variant>') is not null and try_variant_get(v, '$[2]', 'variant') is null then named_struct('n', try_variant_get(v, '$[0]', 'variant'), 'e', try_variant_get(v, '$[1]', 'variant')) end"
        cell = "concat('{\"type\":', coalesce(to_json(try_variant_get(v, '$.type', 'variant')), '\"Graph\"'), ',\"graph\":{\"nodes\":', to_json(c.n), ',\"edges\":', to_json(c.e), '}}')"
        value = F.expr(_let(opened, "v", _let(f"coalesce({inner}, {lists('v')}, {pair})", "c", f"case when c is not null then {cell} end")))
        return value, value.isNull()
    if kind == "ids" or kind.startswith("array<"):
        element = "bigint" if kind == "ids" else kind[6:-1]
        plain = "z" if kind != "ids" else "case when schema_of_variant(z) = 'STRING' then cast(regexp_replace(trim(try_variant_get(z, '$', 'string')), '^[A-Za-z](?=-?[0-9]+$)', '') as variant) else z end"
        one = f"named_struct('x', {_let(plain, 'y', _scalar('y', element))}, 'bad', not is_variant_null(z))"
        pairs = _let(opened, "v", f"transform({_items('v', kind == 'ids')}, z -> {one})")
        value = F.expr(_let(pairs, "q", "transform(q, z -> z.x)"))
        failed = F.expr(_let(pairs, "q", "q is null or exists(q, z -> z.bad and z.x is null)"))
        return value, failed
    if kind == "string":
        value = F.expr(f"case when {raw} like '\"%' then try_variant_get(try_parse_json({raw}), '$', 'string') else {raw} end")
        return value, value.isNull()
    single = "case when schema_of_variant(v) like 'ARRAY%' and size(cast(v as array<variant>)) = 1 then try_variant_get(v, '$[0]', 'variant') else v end"
    value = F.expr(_let(opened, "v", _let(single, "y", _scalar("y", kind))))
    return value, value.isNull()


def runs(lines: DataFrame, columns: dict[str, str] | None = None, match_names: bool = True, agreed_elsewhere: bool = False) -> DataFrame:
    """One row per stream and run: typed columns, ``extras`` by field name, and the casts that failed.

    Of the values that a run has in several files, the one of the last file holds, there of the last line, of several names for one column
    the column's own. Values keep their order and text: ``extras`` has JSON text, a text column the text itself; a graph comes
    out as a cell whatever its form, ids from a list, from text or from the keys of an object, single values as
    lists where the column is one. ``failed`` has ``field, value, target``: the name as written, the JSON text and the kind of column.
    """
    columns = columns or RUN_COLUMNS
    records = Records(lines)
    files = cut(file_order(lines))
    stats = cut(records.stats)
    compared = cut(_compare(stats, files))
    known = aliases(cut(renames(records, compared)), stats, list(columns), match_names, agreed_elsewhere)
    named = records.values().join(files, ["stream_id", "file_id"]).join(known, ["stream_id", "path"], "left")
    place = F.struct("seq", "line_no", (F.col("path") == F.col("target")).alias("own"), "path", "value")
    last = named.groupBy("stream_id", "run_id", F.coalesce("target", "path").alias("field"), F.col("target").isNotNull().alias("typed")).agg(F.max(place).alias("m"))
    is_column = lambda c: F.col("typed") & (F.col("field") == c)
    wide = last.groupBy("stream_id", "run_id").agg(
        *[F.max(F.when(is_column(c), F.struct("m.value", "m.path"))).alias(f"raw_{c}") for c in columns],
        F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("typed"), F.struct("field", "m.value"))))).alias("extras"),
    )
    out, failed = [], []
    for c, kind in columns.items():
        value, bad = _typed(f"`raw_{c}`.value", kind)
        there = F.col(f"raw_{c}").isNotNull()
        out.append(F.when(there, value).alias(c))
        failed.append(F.when(there & bad, F.struct(F.col(f"raw_{c}.path").alias("field"), F.col(f"raw_{c}.value").alias("value"), F.lit(kind).alias("target"))))
    return wide.select("stream_id", "run_id", *out, "extras", F.array_compact(F.array(*failed)).alias("failed"))
