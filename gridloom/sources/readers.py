"""Readers and writers of network files as DataFrames of nodes and edges.

Every reader takes a path or a folder and returns tables keyed by ``file``; lines are
parsed by built-in functions, nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import nested


def files(spark: SparkSession, folder: str, extension: str, without: str | None = None) -> DataFrame:
    """Paths of a folder's files with an extension, leaving out names that contain ``without``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{extension}").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found if without is None else found.where(~F.element_at(F.split("path", "/"), -1).contains(without))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line_no, line``: every file's lines in order; a file is read by one task, as order needs it."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r\n|\n|\r")).alias("line_no", "line"))


def _sections(rows: DataFrame) -> DataFrame:
    """Lines with the last ``[SECTION]`` before them; comments, blank lines and headings left out."""
    head = F.regexp_extract("line", r"^\s*\[(\w+)\]", 1)
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("section", F.last(F.when(head != "", F.upper(head)), ignorenulls=True).over(w))
    body = F.trim(F.regexp_replace("line", r";.*$", ""))
    return marked.withColumn("body", body).where((head == "") & (F.col("body") != "")).withColumn("f", F.split("body", r"\s+"))


def _f(i: int, kind: str = "string") -> Column:
    value = F.get("f", F.lit(i))
    return value if kind == "string" else value.try_cast(kind)


def read_inp(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Water networks: ``(nodes, edges)``. Weights are positive demands, reservoirs and tanks the sources."""
    s = _sections(lines(spark, path))
    demands = s.where("section = 'DEMANDS'").groupBy("file", _f(0).alias("label")).agg(F.max_by(_f(1, "double"), "line_no").alias("later"))
    places = s.where("section = 'COORDINATES'").select("file", _f(0).alias("label"), _f(1, "double").alias("x"), _f(2, "double").alias("y"))
    nodes = s.where("section in ('JUNCTIONS', 'RESERVOIRS', 'TANKS')").select("file", "line_no", _f(0).alias("label"), _f(1, "double").alias("elevation"), F.when(F.col("section") == "JUNCTIONS", _f(2, "double")).alias("demand"), (F.col("section") != "JUNCTIONS").alias("is_source"))
    nodes = nodes.join(demands, ["file", "label"], "left").join(places, ["file", "label"], "left")
    weight = F.greatest(F.coalesce("later", "demand", F.lit(0.0)), F.lit(0.0))
    number = (F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1).cast("bigint")
    nodes = nodes.select("file", number.alias("node"), "label", weight.alias("weight"), "x", "y", "elevation", "is_source")
    edges = s.where("section in ('PIPES', 'PUMPS', 'VALVES')").select("file", F.lower("section").alias("type"), _f(0).alias("edge"), _f(1).alias("u"), _f(2).alias("v"), F.when(F.col("section") == "PIPES", _f(3, "double")).alias("length"), F.when(F.col("section") == "PIPES", _f(4, "double")).alias("diameter"), F.when(F.col("section") == "PIPES", _f(5, "double")).alias("roughness"))
    return nodes, edges


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Communication networks: ``(nodes, edges)`` of GML files."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def blocks(name: str) -> DataFrame:
        return whole.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(rf"(?s)\b{name}\s*\[(.*?)\n\s*\]"), F.lit(1))).alias("position", "b"))

    def held(key: str) -> Column:
        text = F.regexp_extract("b", rf'(?m)^\s*{key}\s+(?:"([^"]*)"|(\S+))', 0)
        return F.when(text != "", F.regexp_replace(F.trim(F.regexp_replace(text, rf"(?m)^\s*{key}\s+", "")), '^"|"$', ""))

    nodes = blocks("node").select("file", held("id").cast("bigint").alias("node"), held("label").alias("label"), held("Longitude").try_cast("double").alias("x"), held("Latitude").try_cast("double").alias("y"), held("Country").alias("country"), (F.coalesce(held("Internal").try_cast("int"), F.lit(1)) == 1).alias("internal"))
    edges = blocks("edge").select("file", "position", held("source").cast("bigint").alias("u"), held("target").cast("bigint").alias("v"))
    return nodes, edges


def read_dss(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Power networks: ``(nodes, edges)`` from Buscoords, Lines, Loads and Master files of a folder.

    The last load of a bus counts; buses without coordinates are left out; the circuit's bus is the source.
    """
    bus = lambda c: F.lower(F.split_part(c, F.lit("."), F.lit(1)))
    option = lambda key: F.regexp_extract("line", rf"(?i)\b{key}\s*=\s*\(?([^\s)]+)", 1)
    name = F.element_at(F.split("file", "/"), -1)
    rows = lines(spark, folder).where(~F.ltrim("line").startswith("!")).withColumn("name", F.lower(name))
    here = F.regexp_replace("file", r"/[^/]*$", "")
    rows = rows.withColumn("folder", here)
    fields = F.split(F.trim(F.regexp_replace("line", ",", " ")), r"\s+")
    coords = rows.where("name like 'buscoord%'").withColumn("f", fields).select("folder", F.lower(_f(0)).alias("label"), _f(1, "double").alias("x"), _f(2, "double").alias("y")).where("x is not null and y is not null")
    loads = rows.where("name like 'load%' and line rlike '(?i)new\\\\s+load\\\\.'").select("folder", bus(option("bus1")).alias("label"), "line_no", option("kW").try_cast("double").alias("kw"))
    last = loads.groupBy("folder", "label").agg(F.max_by("kw", "line_no").alias("weight"))
    source = rows.where("name like 'master%' and line rlike '(?i)bus1\\\\s*='").select("folder", bus(option("bus1")).alias("label"), F.lit(True).alias("src")).distinct()
    nodes = coords.dropDuplicates(["folder", "label"]).join(last, ["folder", "label"], "left").join(source, ["folder", "label"], "left").select("folder", "label", F.coalesce("weight", F.lit(0.0)).alias("weight"), "x", "y", F.coalesce("src", F.lit(False)).alias("is_source"))
    found = rows.where("name like 'line%' and line rlike '(?i)new\\\\s+line\\\\.'").select("folder", F.regexp_extract("line", r"(?i)new\s+line\.(\S+)", 1).alias("edge"), bus(option("bus1")).alias("u"), bus(option("bus2")).alias("v"), option("Length").try_cast("double").alias("length"))
    keep = nodes.select("folder", "label")
    edges = found.join(keep.withColumnRenamed("label", "u"), ["folder", "u"], "left_semi").join(keep.withColumnRenamed("label", "v"), ["folder", "v"], "left_semi").where("u <> v")
    return nodes, edges


def read_nxjson(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines whose fields are scalars, arrays or graph cells: ``file, line_no, row variant``; unreadable lines are left out."""
    return lines(spark, path).select("file", "line_no", F.try_parse_json("line").alias("row")).where("row is not null")


def cells(rows: DataFrame, field: str, target: str) -> DataFrame:
    """Networks, nodes or edges of the graph cell in ``field`` of :func:`read_nxjson`; ``rec_id`` is file and line."""
    as_records = rows.select(F.concat_ws("#", "file", "line_no").alias("rec_id"), F.try_variant_get("row", f"$.{field}", "string").alias(field))
    return nested.flatten(as_records, target, roots=(field,))


def read_legacy(spark: SparkSession, path: str, target: str) -> DataFrame:
    """A file that is one JSON text holding JSON: networks, nodes or edges of its graph cell."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("rec_id"), F.col("value").alias("cell"))
    return nested.flatten(whole, target, roots=("cell",))


def write_nxjson(df: DataFrame, path: str) -> None:
    """One JSON object per row."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def graph_cell(nodes: DataFrame, edges: DataFrame, kind: str = "Graph") -> DataFrame:
    """``graph_id, cell``: nodes (``graph_id, node``) and edges (``graph_id, u, v``) as JSON cells, other columns as attributes."""
    attrs = lambda df, *not_these: F.to_json(F.struct(*[c for c in df.columns if c not in not_these])) if set(df.columns) - set(not_these) else F.lit("{}")
    n = nodes.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("["), F.to_json(F.array("node")).substr(F.lit(2), F.length(F.to_json(F.array("node"))) - 2), F.lit(","), attrs(nodes, "graph_id", "node"), F.lit("]")))), ",").alias("n"))
    e = edges.groupBy("graph_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("["), F.to_json(F.array("u", "v")), F.lit(","), attrs(edges, "graph_id", "u", "v"), F.lit("]")))), ",").alias("e"))
    return n.join(e, "graph_id", "left").select("graph_id", F.concat(F.lit(f'{{"type":"{kind}","graph":{{"nodes":['), "n", F.lit('],"edges":['), F.coalesce("e", F.lit("")), F.lit('],"graph":[]}}')).alias("cell"))


def read_csv_tidy(spark: SparkSession, path: str) -> DataFrame:
    """CSV with padded cells: names and values trimmed, blanks null, the empty column of a trailing comma dropped."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    names = {c: c.strip() for c in raw.columns}
    kept = [c for c, n in names.items() if n and not n.startswith("_c")]
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(names[c]) for c in kept])


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """``file, feature_no, geometry, properties``: each feature of a collection, or the file itself where it is one feature or a bare geometry.

    ``geometry`` is JSON text as :mod:`gridloom.operators.spatial` takes it; files that are no JSON are left out.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")).where("v is not null")
    listed = F.coalesce(F.expr("try_variant_get(v, '$.features', 'array<variant>')"), F.array("v"))
    rows = whole.select("file", F.posexplode(listed).alias("feature_no", "f"))
    inner = F.coalesce(F.try_variant_get("f", "$.geometry", "string"), F.when(F.try_variant_get("f", "$.type", "string") != "Feature", F.expr("to_json(f)")))
    return rows.select("file", "feature_no", inner.alias("geometry"), F.try_variant_get("f", "$.properties", "string").alias("properties"))


def write_csv(df: DataFrame, path: str) -> None:
    """Rows with a heading; arrays, maps and structs as JSON text."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_legacy(cells: DataFrame, path: str) -> None:
    """Graph cells (``cell``) as JSON text within JSON, as :func:`read_legacy` takes it; a file for each partition."""
    cells.select(F.substring(F.to_json(F.array("cell")), 2, 1_000_000_000).alias("t")).select(F.expr("substring(t, 1, length(t) - 1)").alias("value")).write.mode("overwrite").text(path)


def missing_only(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` that an earlier run did not write yet."""
    return wanted.join(have.select(*keys), keys, "left_anti")
