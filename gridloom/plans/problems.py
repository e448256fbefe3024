"""The queries of the general problems 2 to 5 over their whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import nested, orphans, schema_drift, spatial
from gridloom.plans.network_queries import CELLS
from gridloom.session import spread_out, table

NEAR_METRES = 25.0


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "sweep_files").select("stream_id", "file_id", "written_at", "line_no", "body"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(_lines(spark, sf_dir)).select("file_id", "field", "change").distinct()


def p2_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.changes(_lines(spark, sf_dir))


def p2_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.runs(_lines(spark, sf_dir))


def p2_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of runs as rows: each value of a typed column or of ``extras`` with its place, as number or as text."""
    t = schema_drift.runs(_lines(spark, sf_dir))
    none = F.lit(None)

    def rows(values: Column, field: str, number: bool) -> Column:
        entry = lambda x, i: F.struct(F.lit(field).alias("field"), F.lit(True).alias("typed"), i.cast("bigint").alias("pos"), (x if number else none).cast("double").alias("num"), (none if number else x).cast("string").alias("txt"))
        return F.coalesce(F.transform(values, entry), F.array())

    single = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    parts = [rows(single(c) if kind in ("bigint", "double", "graph") else F.col(c), c, kind != "graph") for c, kind in schema_drift.RUN_COLUMNS.items()]
    rest = F.expr("""flatten(transform(map_entries(extras), e -> transform(transform(array(try_parse_json(e.value)), v -> if(schema_of_variant(v) like 'ARRAY%', cast(v as array<variant>), array(v)))[0],
        (x, i) -> named_struct('field', e.key, 'typed', false, 'pos', cast(i as bigint), 'num', if(schema_of_variant(x) rlike '^(BIGINT|DECIMAL|DOUBLE)', try_variant_get(x, '$', 'double'), null), 'txt', if(schema_of_variant(x) rlike '^(BIGINT|DECIMAL|DOUBLE)', null, try_variant_get(x, '$', 'string'))))))""")
    return t.select("stream_id", "run_id", F.inline(F.concat(*parts, rest)))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.edge_ends(spread_out(table(spark, sf_dir, "networks").select("rec_id", "graph", "optimal_network")))


def _tracker(spark: SparkSession, sf_dir: str) -> orphans.OrphanTracker:
    refs = orphans.references_of(table(spark, sf_dir, "capacitors"), "capacitors", "cap_id", ["node"])
    refs = refs.unionByName(orphans.references_of(table(spark, sf_dir, "voltage_regulators"), "voltage_regulators", "reg_id", ["node_a", "node_b"]))
    return orphans.track(orphans.parents_of(table(spark, sf_dir, "nodes")), refs)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir).open().select("ref_table", "ref_id", "field", "kind").distinct()


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir).counts()


def p4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tracker(spark, sf_dir).snapshots().drop("as_of")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "nodes").select(F.col("node_id").alias("id"), F.col("pos.x").alias("x"), F.col("pos.y").alias("y"))
    regions = table(spark, sf_dir, "boxes").select(F.col("box_id").alias("id"), F.col("geometry").alias("shape"))
    return spatial.near_and_in(points, regions, NEAR_METRES)


QUERIES = {f.__name__: f for f in (p2_found, p2_changes, p2_runs, p2_values, p3_found, p4_found, p4_counts, p4_snapshots, p5_found)}


_ORPHANS = """WITH nd AS (SELECT DISTINCT graph_id, lower(trim(label, chr(32) || chr(9) || chr(10) || chr(13))) AS k, created_at, deleted_at FROM nodes WHERE label IS NOT NULL AND graph_id IS NOT NULL),
rf AS (SELECT DISTINCT * FROM (SELECT 'capacitors' AS ref_table, cap_id AS ref_id, 'node' AS field, graph_id, node AS label, recorded_at FROM capacitors
 UNION ALL SELECT 'voltage_regulators', reg_id, 'node_a', graph_id, node_a, recorded_at FROM voltage_regulators
 UNION ALL SELECT 'voltage_regulators', reg_id, 'node_b', graph_id, node_b, recorded_at FROM voltage_regulators)),
rk AS (SELECT ref_table, ref_id, field, graph_id, lower(trim(label, chr(32) || chr(9) || chr(10) || chr(13))) AS k, recorded_at FROM rf WHERE label IS NOT NULL),
j AS (SELECT ref_table, ref_id, field, recorded_at, count(nd.k) AS n, bool_or(created_at <= recorded_at AND (deleted_at IS NULL OR recorded_at < deleted_at)) AS valid, bool_and(created_at > recorded_at) AS late
 FROM rk LEFT JOIN nd ON nd.graph_id = rk.graph_id AND nd.k = rk.k WHERE rk.k <> '' GROUP BY ref_table, ref_id, field, recorded_at),
op AS (SELECT ref_table, ref_id, field, recorded_at, CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS kind FROM j WHERE valid IS DISTINCT FROM true)"""

_SNAPSHOTS = _ORPHANS.replace("FROM nodes", "FROM nodes_upto").replace("FROM capacitors", "FROM capacitors_upto").replace("FROM voltage_regulators", "FROM regulators_upto")


def _after(batch: int, batches: int = 3) -> str:
    """Orphans by what had arrived after a batch."""
    arrived = f"loaded_at IS NOT NULL AND epoch_us(loaded_at) < (SELECT lo + (hi - lo) * {batch} // {batches} FROM span)" if batch < batches else "true"
    spans = "span AS (SELECT epoch_us(min(loaded_at)) AS lo, epoch_us(max(loaded_at)) AS hi FROM (SELECT loaded_at FROM nodes WHERE trim(label) <> '' AND graph_id IS NOT NULL UNION ALL SELECT loaded_at FROM capacitors WHERE trim(node) <> '' UNION ALL SELECT loaded_at FROM voltage_regulators WHERE trim(node_a) <> '' OR trim(node_b) <> ''))"
    upto = ", ".join(f"{name}_upto AS (SELECT * FROM {table} WHERE {arrived})" for name, table in (("nodes", "nodes"), ("capacitors", "capacitors"), ("regulators", "voltage_regulators")))
    rest = _SNAPSHOTS.removeprefix("WITH ")
    return f"SELECT * FROM (WITH {spans}, {upto}, {rest} SELECT CAST({batch} AS BIGINT) AS batch, ref_table, field, kind, strftime(recorded_at, '%Y-%m') AS month, count(*) AS orphans FROM op GROUP BY 1, 2, 3, 4, 5)"


_JSON_KIND = "CASE WHEN {t} IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'DOUBLE') THEN 'number' WHEN {t} = 'VARCHAR' THEN 'string' WHEN {t} = 'NULL' THEN NULL ELSE lower({t}) END"

_DRIFT = f"""WITH RECURSIVE ln AS (SELECT stream_id, file_id, line_no, CAST(body AS JSON) AS j FROM sweep_files WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
fl AS (SELECT stream_id, file_id, row_number() OVER (PARTITION BY stream_id ORDER BY w, file_id) AS seq FROM (SELECT stream_id, file_id, min(written_at) AS w FROM sweep_files GROUP BY stream_id, file_id)),
sp AS (SELECT stream_id, file_id, lag(file_id) OVER (PARTITION BY stream_id ORDER BY seq) AS prev_id FROM fl),
vl AS (SELECT stream_id, file_id, line_no, run_id, path, v, json_type(v) AS t FROM (SELECT stream_id, file_id, line_no, j ->> '$.run_id' AS run_id, path, json_extract(j, '$."' || path || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS path FROM ln) WHERE path <> 'run_id') WHERE json_type(v) <> 'NULL' AND CAST(v AS VARCHAR) <> '[]'),
kd AS (SELECT stream_id, file_id, path, CASE WHEN t = 'ARRAY' THEN 'array<' || array_to_string(list_sort(list_distinct(list_filter(list_transform(from_json(v, '["JSON"]'), lambda x: {_JSON_KIND.format(t='json_type(x)')}), lambda k: k IS NOT NULL))), ',') || '>' ELSE {_JSON_KIND.format(t='t')} END AS kind FROM vl),
fs AS (SELECT stream_id, file_id, path, string_agg(DISTINCT kind, '|' ORDER BY kind) AS kinds FROM kd GROUP BY stream_id, file_id, path),
cp AS (SELECT stream_id, file_id, prev_id, path, max(kinds) AS kinds, max(old_kinds) AS old_kinds FROM (
 SELECT stream_id, file_id, prev_id, path, kinds, NULL AS old_kinds FROM sp JOIN fs USING (stream_id, file_id) WHERE prev_id IS NOT NULL
 UNION ALL SELECT sp.stream_id, sp.file_id, prev_id, path, NULL, kinds FROM sp JOIN fs ON fs.stream_id = sp.stream_id AND fs.file_id = prev_id) GROUP BY stream_id, file_id, prev_id, path),
op AS (SELECT *, CASE WHEN t = 'VARCHAR' AND json_valid(v ->> '$') AND regexp_matches(v ->> '$', '^\\s*[\\[{{"]') THEN CAST(v ->> '$' AS JSON) ELSE v END AS w FROM vl),
gr AS (SELECT *, coalesce(w -> '$.graph.nodes', w -> '$.nodes', CASE WHEN json_type(w -> '$[0]') = 'ARRAY' AND json_type(w -> '$[1]') = 'ARRAY' AND json_array_length(w) = 2 THEN w -> '$[0]' END) AS nodes,
 coalesce(w -> '$.graph.edges', w -> '$.edges', CASE WHEN json_type(w -> '$[0]') = 'ARRAY' AND json_type(w -> '$[1]') = 'ARRAY' AND json_array_length(w) = 2 THEN w -> '$[1]' END) AS edges,
 CASE json_type(w) WHEN 'ARRAY' THEN list_transform(from_json(w, '["JSON"]'), lambda x: x ->> '$') WHEN 'VARCHAR' THEN string_split_regex(trim(w ->> '$'), '\\s*[;,|]\\s*')
 WHEN 'OBJECT' THEN CASE WHEN len(list_filter(json_keys(w), lambda k: NOT regexp_full_match(k, '[A-Za-z]?-?\\d+'))) = 0 THEN list_transform(list_sort(list_transform(json_keys(w), lambda k: CAST(regexp_extract(k, '-?\\d+') AS BIGINT))), lambda k: CAST(k AS VARCHAR)) END ELSE [w ->> '$'] END AS items FROM op),
cn AS (SELECT *, CASE WHEN nodes IS NOT NULL AND edges IS NOT NULL THEN 'graph ' || regexp_replace(CAST(list_sort(list_transform(from_json(nodes, '["JSON"]'), lambda x: CAST(x AS VARCHAR))) AS VARCHAR) || CAST(list_sort(list_transform(from_json(edges, '["JSON"]'), lambda x: CAST(x AS VARCHAR))) AS VARCHAR), '\\.0([,\\]}}])', '\\1', 'g')
 WHEN items IS NULL THEN CAST(w AS VARCHAR) WHEN len(list_filter(items, lambda x: NOT regexp_full_match(x, '[A-Za-z]?-?\\d+(\\.0)?'))) = 0 THEN CAST(list_sort(list_transform(items, lambda x: CAST(regexp_extract(x, '-?\\d+') AS HUGEINT))) AS VARCHAR)
 ELSE CAST(list_transform(items, lambda x: coalesce(CAST(TRY_CAST(x AS DOUBLE) AS VARCHAR), x)) AS VARCHAR) END AS content FROM gr),
ov AS (SELECT stream_id, cp.file_id, run_id, path, min(content) AS c1, max(content) AS c2 FROM cp JOIN cn USING (stream_id, path) WHERE cn.file_id = prev_id AND kinds IS NULL AND run_id IS NOT NULL GROUP BY ALL),
nv AS (SELECT stream_id, cp.file_id, run_id, path, min(content) AS c1, max(content) AS c2 FROM cp JOIN cn USING (stream_id, path) WHERE cn.file_id = cp.file_id AND old_kinds IS NULL AND run_id IS NOT NULL GROUP BY ALL),
rn AS (SELECT stream_id, file_id, ov.path AS old_path, nv.path AS new_path FROM ov JOIN nv USING (stream_id, file_id, run_id) GROUP BY ALL HAVING bool_and(ov.c1 = nv.c1 AND ov.c1 = ov.c2 AND nv.c1 = nv.c2)),
mv AS (SELECT b.stream_id, b.file_id, b.path, r.old_path, o.old_kinds, b.kinds FROM cp b JOIN (SELECT stream_id, file_id, new_path, min(old_path) AS old_path FROM rn GROUP BY ALL) r ON r.stream_id = b.stream_id AND r.file_id = b.file_id AND r.new_path = b.path AND b.old_kinds IS NULL JOIN cp o ON o.stream_id = b.stream_id AND o.file_id = b.file_id AND o.path = r.old_path),
ch AS (SELECT stream_id, file_id, path AS field, 'added' AS change, NULL AS old_field, old_kinds, kinds FROM cp WHERE old_kinds IS NULL AND NOT EXISTS (SELECT 1 FROM rn WHERE rn.stream_id = cp.stream_id AND rn.file_id = cp.file_id AND new_path = path)
 UNION ALL SELECT stream_id, file_id, path, 'removed', NULL, old_kinds, kinds FROM cp WHERE kinds IS NULL AND NOT EXISTS (SELECT 1 FROM rn WHERE rn.stream_id = cp.stream_id AND rn.file_id = cp.file_id AND old_path = path)
 UNION ALL SELECT stream_id, file_id, path, 'renamed', old_path, old_kinds, kinds FROM mv UNION ALL SELECT stream_id, file_id, path, 'retyped', old_path, old_kinds, kinds FROM mv WHERE kinds <> old_kinds
 UNION ALL SELECT stream_id, file_id, path, 'retyped', NULL, old_kinds, kinds FROM cp WHERE kinds <> old_kinds)"""

_ALIKE = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]', '', 'g'), '(..)s$', '\\1')"

_VALUES = f"""{_DRIFT},
tg AS (SELECT unnest({list(schema_drift.RUN_COLUMNS)}) AS target),
nm AS (SELECT DISTINCT stream_id, path FROM fs),
ma AS (SELECT stream_id, path, target, path = target AS own FROM nm JOIN tg ON {_ALIKE.format('path')} = {_ALIKE.format('target')}),
lk AS (SELECT stream_id, old_path AS a, new_path AS b FROM rn UNION SELECT stream_id, new_path, old_path FROM rn),
al(stream_id, path, target, step) AS (SELECT stream_id, path, target, 0 FROM ma UNION SELECT al.stream_id, b, target, step + 1 FROM al JOIN lk ON lk.stream_id = al.stream_id AND a = path WHERE step < 40 AND NOT EXISTS (SELECT 1 FROM ma WHERE ma.stream_id = lk.stream_id AND ma.path = b)),
kn AS (SELECT stream_id, path, arg_min(target, step) AS target FROM al GROUP BY stream_id, path),
la AS (SELECT stream_id, run_id, coalesce(target, path) AS field, target IS NOT NULL AS typed, arg_max(struct_pack(v := v, w := w, t := t, nodes := nodes, edges := edges, items := items), row(seq, line_no, path = coalesce(target, ''), path)) AS m
 FROM gr JOIN fl USING (stream_id, file_id) LEFT JOIN kn USING (stream_id, path) WHERE run_id IS NOT NULL GROUP BY ALL),
ty AS (SELECT stream_id, run_id, field, typed, 0 AS pos, NULL AS num, '{{"type":' || coalesce(m.w -> '$.type', '"Graph"') || ',"graph":{{"nodes":' || m.nodes || ',"edges":' || m.edges || '}}}}' AS txt, false AS plain FROM la WHERE typed AND field = 'graph'
 UNION ALL SELECT stream_id, run_id, field, typed, unnest(range(len(m.items))), unnest(list_transform(m.items, lambda x: TRY_CAST(regexp_replace(x, '^[A-Za-z]', '') AS DOUBLE))), NULL, false FROM la WHERE typed AND field <> 'graph'
 UNION ALL SELECT stream_id, run_id, field, typed, unnest(range(len(x))), unnest(list_transform(x, lambda y: CASE WHEN json_type(y) IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(y AS DOUBLE) END)), unnest(list_transform(x, lambda y: CASE WHEN json_type(y) = 'OBJECT' AND json_extract(y, '$.graph.graph') IS NOT NULL THEN '{{"graph":{{"edges":' || (json_extract(y, '$.graph.edges')) || ',"graph":' || (json_extract(y, '$.graph.graph')) || ',"nodes":' || (json_extract(y, '$.graph.nodes')) || '}},"type":' || (json_extract(y, '$.type')) || '}}' WHEN json_type(y) NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN y ->> '$' END)), unnest(list_transform(x, lambda y: json_type(y) = 'VARCHAR'))
 FROM (SELECT *, CASE WHEN m.t = 'ARRAY' THEN from_json(m.v, '["JSON"]') ELSE [m.v] END AS x FROM la WHERE NOT typed))"""

_P2 = {
    "p2_found": f"{_DRIFT} SELECT DISTINCT file_id, field, change FROM ch",
    "p2_changes": f"{_DRIFT} SELECT * FROM ch",
    "p2_values": f"{_VALUES} SELECT stream_id, run_id, field, typed, CAST(pos AS BIGINT) AS pos, num, CASE WHEN plain THEN txt ELSE regexp_replace(txt, '\\.0([,\\]}}])', '\\1', 'g') END AS txt FROM ty",
}

_NEAR = """WITH RECURSIVE ps AS (SELECT DISTINCT node_id AS id, pos.x AS x, pos.y AS y, radians(pos.x) AS lo, radians(pos.y) AS la FROM nodes WHERE node_id IS NOT NULL AND pos.x BETWEEN -180 AND 180 AND pos.y BETWEEN -90 AND 90 AND NOT (pos.x = 0 AND pos.y = 0)),
gj(box_id, part, j) AS (SELECT box_id, '', CASE WHEN json_valid(geometry) THEN CAST(geometry AS JSON) END FROM boxes WHERE geometry IS NOT NULL
 UNION ALL SELECT box_id, part || '/' || i, x FROM (SELECT box_id, part, unnest(ch) AS x, unnest(range(len(ch))) AS i FROM (SELECT box_id, part, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j ->> '$') THEN [CAST(j ->> '$' AS JSON)] END
  WHEN json_type(j) = 'OBJECT' AND ((j ->> '$.type') = 'Feature' OR ((j ->> '$.type') IS NULL AND (j -> '$.geometry') IS NOT NULL)) THEN [j -> '$.geometry']
  WHEN json_type(j) = 'OBJECT' AND ((j ->> '$.type') = 'FeatureCollection' OR ((j ->> '$.type') IS NULL AND (j -> '$.features') IS NOT NULL)) THEN from_json(j -> '$.features', '["JSON"]')
  WHEN json_type(j) = 'OBJECT' AND ((j ->> '$.type') = 'GeometryCollection' OR ((j ->> '$.type') IS NULL AND (j -> '$.geometries') IS NOT NULL)) THEN from_json(j -> '$.geometries', '["JSON"]')
  WHEN json_type(j) = 'OBJECT' AND ((j ->> '$.type') IS NULL OR (j ->> '$.type') IN ('Polygon', 'MultiPolygon')) THEN [j -> '$.coordinates']
  WHEN json_type(j) = 'ARRAY' AND json_type((j -> '$[0][0][0][0]')) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN from_json(j, '["JSON"]') END AS ch FROM gj))),
pg AS (SELECT box_id, part, j FROM gj WHERE json_type(j) = 'ARRAY' AND json_type((j -> '$[0][0][0]')) IN ('DOUBLE', 'UBIGINT', 'BIGINT')),
rg AS (SELECT box_id, part, unnest(range(len(rs))) AS ring, unnest(rs) AS r FROM (SELECT box_id, part, from_json(j, '["JSON"]') AS rs FROM pg)),
pt AS (SELECT box_id, part, ring, unnest(range(len(q))) AS k, unnest(q) AS q FROM (SELECT box_id, part, ring, from_json(r, '["JSON"]') AS q FROM rg)),
xy AS (SELECT box_id, part, ring, k, CAST((q -> '$[0]') AS DOUBLE) AS ax, CAST((q -> '$[1]') AS DOUBLE) AS ay FROM pt),
sd AS (SELECT *, coalesce(lead(ax) OVER w, first_value(ax) OVER w) AS bx, coalesce(lead(ay) OVER w, first_value(ay) OVER w) AS b_y FROM xy WINDOW w AS (PARTITION BY box_id, part, ring ORDER BY k)),
ar AS (SELECT box_id, part, ring FROM sd GROUP BY box_id, part, ring HAVING count(*) >= 3 AND abs(sum((ax - 5) * (b_y - 5) - (bx - 5) * (ay - 5))) > 1e-12),
cr AS (SELECT ps.id, box_id, part, ring FROM sd JOIN ar USING (box_id, part, ring) JOIN ps ON (ay > y) <> (b_y > y) AND x < (bx - ax) * (y - ay) / (b_y - ay) + ax GROUP BY ps.id, box_id, part, ring HAVING count(*) % 2 = 1),
bo AS (SELECT id, box_id FROM cr GROUP BY id, box_id, part HAVING min(ring) = 0 AND max(ring) = 0),
nr AS (SELECT a.id AS id_a, b.id AS id_b FROM ps a JOIN ps b ON a.id < b.id AND b.y BETWEEN a.y - 0.0003 AND a.y + 0.0003 WHERE 2 * 6371008.8 * asin(least(1, sqrt(sin((b.la - a.la) / 2) ** 2 + cos(a.la) * cos(b.la) * sin((b.lo - a.lo) / 2) ** 2))) <= 25)
SELECT DISTINCT 'near' AS kind, id_a, id_b FROM nr UNION ALL SELECT DISTINCT 'in', id, box_id FROM bo"""


SQL = {
    "p5_found": _NEAR,
    **_P2,
    "p3_found": f"WITH RECURSIVE {CELLS} SELECT DISTINCT rec_id, root, path, least(a, b) AS u, greatest(a, b) AS v FROM ed",
    "p4_found": f"{_ORPHANS} SELECT ref_table, ref_id, field, kind FROM op",
    "p4_snapshots": " UNION ALL ".join(map(_after, (1, 2, 3))),
    "p4_counts": f"{_ORPHANS} SELECT ref_table, field, kind, strftime(recorded_at, '%Y-%m') AS month, count(*) AS orphans FROM op GROUP BY 1, 2, 3, 4",
}
