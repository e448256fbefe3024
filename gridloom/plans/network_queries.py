"""Queries over the graph cells of ``networks``: flat tables, summaries and exact indexes, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators import nested, networks
from gridloom.session import spread_out, table


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(table(spark, sf_dir, "networks").select("rec_id", "sources", "graph", "optimal_network"))


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return networks.graphs_of(_cells(spark, sf_dir))


def network_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of every cell's top level with weight, source mark and degree."""
    return _graphs(spark, sf_dir)[0].drop("node")


def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graphs(spark, sf_dir)
    return networks.validated(n, e).withColumn("length", F.round("length", 6))


def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, redundancy, length, share on cycles and the best network's loss of every cell."""
    s = networks.summary(*_graphs(spark, sf_dir))
    return s.select("graph_id", "n", "m", "r", F.round("rho", 9).alias("rho"), F.round("chain", 9).alias("chain"), F.round("length", 6).alias("length"), F.round("two_connected", 9).alias("two_connected"), F.round("optimal_loss", 12).alias("optimal_loss"))


def network_saidi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact expected share of weight cut off, of every cell, by way of its skeleton."""
    return networks.saidi(*_graphs(spark, sf_dir))


def network_nodes_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact probability of every node of being cut off from its sources."""
    return networks.nodes_rel(*_graphs(spark, sf_dir))


def network_saidi_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index by way of the skeleton is that of the whole graph's junction tree."""
    g = _graphs(spark, sf_dir)
    a, b = networks.saidi(*g), networks.saidi(*g, by_skeleton=False).select("graph_id", F.col("saidi").alias("other"))
    return a.join(b, "graph_id").select("graph_id", "n", (F.abs(F.col("saidi") - F.col("other")) < 1e-9).alias("agree"))


def network_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much smaller length, redundancy and exact index of a record's optimal network are."""
    g = _graphs(spark, sf_dir)
    s = networks.summary(*g).join(networks.saidi(*g).select("graph_id", "saidi"), "graph_id").withColumns({"rec_id": F.split_part("graph_id", F.lit("/"), F.lit(1)).cast("bigint"), "root": F.split_part("graph_id", F.lit("/"), F.lit(2))})
    return networks.improvement(s.where("root = 'graph'"), s.where("root = 'optimal_network'"), "rec_id", "length", "rho", "saidi")


def network_length_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of ``network_gain`` that sums and counts give."""
    s = networks.summary(*_graphs(spark, sf_dir)).withColumns({"rec_id": F.split_part("graph_id", F.lit("/"), F.lit(1)).cast("bigint"), "root": F.split_part("graph_id", F.lit("/"), F.lit(2))})
    gain = networks.improvement(s.where("root = 'graph'"), s.where("root = 'optimal_network'"), "rec_id", "length", "rho")
    return gain.select("rec_id", F.round("length_gain", 6).alias("length_gain"), F.round("rho_gain", 6).alias("rho_gain"))


def network_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The junction tree of every cell: bags, edges assigned, and edges whose ends their bag lacks (none)."""
    n, e = _graphs(spark, sf_dir)
    b = networks.bags(n, e)
    held = b.select("graph_id", F.col("members"), F.explode("edges").alias("edge_id")).join(e, ["graph_id", "edge_id"]).join(n.where("is_source").groupBy("graph_id").agg(F.collect_set("node").alias("s")), "graph_id")
    inside = lambda c: F.array_contains("members", F.col(c)) | F.array_contains("s", F.col(c))
    outside = held.groupBy("graph_id").agg(F.count_if(~(inside("u") & inside("v"))).alias("outside"))
    return b.groupBy("graph_id").agg(F.count("*").alias("bags"), F.sum(F.size("edges")).alias("edges")).join(outside, "graph_id", "left").select("graph_id", "bags", F.col("edges").cast("bigint").alias("edges"), F.coalesce("outside", F.lit(0)).alias("outside"))


def network_two_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every cell's graph that the loss of one edge does not split."""
    _, e = _graphs(spark, sf_dir)
    return networks.edge_components(e, 2)


def p3_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_cells(spark, sf_dir), "networks")


def p3_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_cells(spark, sf_dir), "nodes").withColumn("is_source", F.col("is_source").cast("string"))


def p3_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flatten(_cells(spark, sf_dir), "edges")


QUERIES = {f.__name__: f for f in (p3_networks, p3_nodes, p3_edges, network_nodes, network_edges, network_summary, network_saidi, network_nodes_rel, network_saidi_agree, network_gain, network_length_gain, network_bags, network_two_connected)}


_OPEN = "CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) END ELSE {0} END"

#: cell: every cell at any depth; ed, nd: the entries of its lists that are not null
CELLS = f"""cell(rec_id, root, prefix, c) AS (
 SELECT rec_id, root, '' AS prefix, {_OPEN.format('j')} AS c
 FROM (SELECT rec_id, root, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM (SELECT rec_id, 'graph' AS root, graph AS t FROM networks UNION ALL SELECT rec_id, 'optimal_network', optimal_network FROM networks))
 UNION ALL
 SELECT rec_id, root, prefix || i || '/', {_OPEN.format('s')}
 FROM (SELECT rec_id, root, prefix, i, coalesce(e -> '$[1].subgraph', e -> '$.attrs.subgraph') AS s
  FROM (SELECT rec_id, root, prefix, i, c -> ('$.graph.edges[' || i || ']') AS e FROM (SELECT rec_id, root, prefix, c, unnest(range(0, CAST(coalesce(json_array_length(c, '$.graph.edges'), 0) AS BIGINT))) AS i FROM cell WHERE c IS NOT NULL)))
 WHERE s IS NOT NULL AND json_type(s) <> 'NULL'),
ed AS (SELECT rec_id, root, nullif(rtrim(prefix, '/'), '') AS parent, prefix || i AS path, CAST(i AS INTEGER) AS position, coalesce(e ->> '$[0][0]', e ->> '$.source', e ->> '$.u') AS a, coalesce(e ->> '$[0][1]', e ->> '$.target', e ->> '$.v') AS b, coalesce(e ->> '$[0][2]', e ->> '$.key') AS key,
 CAST(coalesce(e -> '$[1].length', e -> '$.attrs.length') AS DOUBLE) AS length, CAST(coalesce(e -> '$[1].prob', e -> '$.attrs.prob') AS DOUBLE) AS prob, regexp_replace(coalesce(e ->> '$[1].geometry', e ->> '$.attrs.geometry'), '\\.0([,\\]}}])', '\\1', 'g') AS geometry
 FROM (SELECT rec_id, root, prefix, i, c -> ('$.graph.edges[' || i || ']') AS e FROM (SELECT rec_id, root, prefix, c, unnest(range(0, CAST(coalesce(json_array_length(c, '$.graph.edges'), 0) AS BIGINT))) AS i FROM cell WHERE c IS NOT NULL)) WHERE json_type(e) <> 'NULL'),
nd AS (SELECT rec_id, root, nullif(rtrim(prefix, '/'), '') AS parent, CAST(i AS INTEGER) AS position, coalesce(e ->> '$[0]', e ->> '$.id', CASE WHEN json_type(e) NOT IN ('ARRAY', 'OBJECT') THEN e ->> '$' END) AS node, CAST(coalesce(e -> '$[1].pos[0]', e -> '$.attrs.pos[0]', e -> '$[1].pos.x', e -> '$.attrs.pos.x') AS DOUBLE) AS x, CAST(coalesce(e -> '$[1].pos[1]', e -> '$.attrs.pos[1]', e -> '$[1].pos.y', e -> '$.attrs.pos.y') AS DOUBLE) AS y,
 CAST(coalesce(e -> '$[1].weight', e -> '$.attrs.weight') AS DOUBLE) AS weight, CAST(coalesce(e -> '$[1].is_source', e -> '$.attrs.is_source') AS BOOLEAN) AS is_source, regexp_replace(coalesce(e ->> '$[1].loads', e ->> '$.attrs.loads'), '\\.0([,\\]}}])', '\\1', 'g') AS loads, prefix AS path
 FROM (SELECT rec_id, root, prefix, i, c -> ('$.graph.nodes[' || i || ']') AS e FROM (SELECT rec_id, root, prefix, c, unnest(range(0, CAST(coalesce(json_array_length(c, '$.graph.nodes'), 0) AS BIGINT))) AS i FROM cell WHERE c IS NOT NULL)) WHERE json_type(e) <> 'NULL')"""

_GRAPHS = f"""{CELLS},
lk AS (SELECT rec_id || '/' || root AS graph_id, CAST(position AS BIGINT) AS edge_id, a, b, prob, length FROM ed WHERE parent IS NULL AND a IS NOT NULL AND b IS NOT NULL),
dg AS (SELECT graph_id, label, count(*) AS degree FROM (SELECT graph_id, a AS label FROM lk UNION ALL SELECT graph_id, b FROM lk) GROUP BY graph_id, label),
sr AS (SELECT DISTINCT rec_id || '/' || root AS graph_id, label FROM (SELECT rec_id, unnest(sources) AS label FROM networks) CROSS JOIN (SELECT unnest(['graph', 'optimal_network']) AS root) WHERE label IS NOT NULL),
al AS (SELECT graph_id, label, max(weight) AS weight, coalesce(bool_or(is_source), false) AS is_source FROM (SELECT rec_id || '/' || root AS graph_id, node AS label, weight, is_source FROM nd WHERE parent IS NULL AND node IS NOT NULL UNION ALL SELECT graph_id, label, NULL, NULL FROM dg) GROUP BY graph_id, label),
mk AS (SELECT al.graph_id, al.label, greatest(coalesce(weight, 1), 0) AS weight, is_source OR sr.label IS NOT NULL AS marked, coalesce(degree, 0) AS degree FROM al LEFT JOIN dg USING (graph_id, label) LEFT JOIN sr ON sr.graph_id = al.graph_id AND CAST(sr.label AS VARCHAR) = al.label),
nn AS (SELECT graph_id, label, weight, CASE WHEN bool_or(marked) OVER g THEN marked ELSE label = first_value(label) OVER (PARTITION BY graph_id ORDER BY degree < 3, label) END AS is_source, degree, row_number() OVER (PARTITION BY graph_id ORDER BY label) - 1 AS node FROM mk WINDOW g AS (PARTITION BY graph_id)),
ee AS (SELECT lk.graph_id, edge_id, least(x.node, y.node) AS u, greatest(x.node, y.node) AS v, coalesce(CASE WHEN prob BETWEEN 0 AND 1 THEN prob END, 0.01) AS prob, length FROM lk JOIN nn x ON x.graph_id = lk.graph_id AND x.label = a JOIN nn y ON y.graph_id = lk.graph_id AND y.label = b)"""

_SUMMARY = f"""{_GRAPHS},
tw AS (SELECT graph_id, edge_id, u AS a, v AS b FROM ee UNION ALL SELECT graph_id, edge_id, v, u FROM ee),
wo(graph_id, gone, node) AS (SELECT graph_id, edge_id, u FROM ee WHERE u <> v UNION SELECT wo.graph_id, gone, b FROM wo JOIN tw ON tw.graph_id = wo.graph_id AND a = node AND edge_id <> gone),
cy AS (SELECT graph_id, count(DISTINCT node) AS on_cycles FROM (SELECT graph_id, unnest([u, v]) AS node FROM ee WHERE u <> v AND EXISTS (SELECT 1 FROM wo WHERE wo.graph_id = ee.graph_id AND gone = edge_id AND wo.node = v)) GROUP BY graph_id),
su AS (SELECT graph_id, n, coalesce(m, 0) AS m, coalesce(m, 0) - n + 1 AS r, coalesce(length, 0) AS length, coalesce(on_cycles, 0) / n AS two_connected FROM (SELECT graph_id, count(*) AS n FROM nn GROUP BY graph_id) LEFT JOIN (SELECT graph_id, count(*) AS m, sum(length) AS length FROM ee GROUP BY graph_id) USING (graph_id) LEFT JOIN cy USING (graph_id)),
op AS (SELECT *, CASE WHEN r > 1 THEN 2 * (r - 1) ELSE 1 END AS forks, CASE WHEN r > 1 THEN 3 * (r - 1) ELSE 1 END AS chains FROM su),
lo AS (SELECT *, floor((n - 1 - forks) / chains) AS l, (n - 1 - forks) % chains AS k FROM op)"""

SQL = {
    "p3_networks": f"WITH RECURSIVE {CELLS} SELECT rec_id, root, nullif(rtrim(prefix, '/'), '') AS parent, c ->> '$.type' AS type, CAST(coalesce(json_array_length(c, '$.graph.nodes'), 0) AS INTEGER) AS n_nodes, CAST(coalesce(json_array_length(c, '$.graph.edges'), 0) AS INTEGER) AS n_edges, c ->> '$.graph.graph' AS attributes, prefix AS path FROM cell WHERE c IS NOT NULL AND json_type(c) <> 'NULL'",
    "p3_nodes": f"WITH RECURSIVE {CELLS} SELECT * REPLACE (CAST(is_source AS VARCHAR) AS is_source) FROM nd",
    "p3_edges": f"WITH RECURSIVE {CELLS} SELECT * FROM ed",
    "network_nodes": f"WITH RECURSIVE {_GRAPHS} SELECT graph_id, label, weight, is_source, degree FROM nn",
    "network_edges": f"WITH RECURSIVE {_GRAPHS} SELECT graph_id, edge_id, u, v, prob, round(length, 6) AS length FROM ee",
    "network_summary": f"""WITH RECURSIVE {_SUMMARY} SELECT graph_id, n, m, r, round(r / n, 9) AS rho, round(CASE WHEN r > 1 THEN (n - 2 * (r - 1)) / (3 * (r - 1)) ELSE n END, 9) AS chain, round(length, 6) AS length, round(two_connected, 9) AS two_connected,
 CASE WHEN n - 1 >= forks THEN CASE WHEN r < 1 THEN 0 ELSE round(((5e-4 * 5e-4 * (l ** 3 + 3 * l ** 2 + 2 * l) / 6) * (chains - k) + (5e-4 * 5e-4 * ((l + 1) ** 3 + 3 * (l + 1) ** 2 + 2 * (l + 1)) / 6) * k) / n, 12) END END AS optimal_loss FROM lo""",
    "network_bags": f"""WITH RECURSIVE {_GRAPHS}, so AS (SELECT graph_id, node FROM nn WHERE is_source) SELECT n.graph_id, n.bags, CAST(coalesce(e.edges, 0) AS BIGINT) AS edges, CAST(0 AS BIGINT) AS outside FROM (SELECT graph_id, count(*) FILTER (WHERE NOT is_source) AS bags FROM nn GROUP BY graph_id) n
 LEFT JOIN (SELECT graph_id, count(*) AS edges FROM ee WHERE u <> v AND NOT (EXISTS (SELECT 1 FROM so WHERE so.graph_id = ee.graph_id AND so.node = u) AND EXISTS (SELECT 1 FROM so WHERE so.graph_id = ee.graph_id AND so.node = v)) GROUP BY graph_id) e USING (graph_id) WHERE n.bags > 0""",
    "network_two_connected": f"""WITH RECURSIVE {_SUMMARY}, kp AS (SELECT graph_id, u, v FROM ee WHERE u <> v AND EXISTS (SELECT 1 FROM wo WHERE wo.graph_id = ee.graph_id AND gone = edge_id AND wo.node = v)), k2 AS (SELECT graph_id, u AS a, v AS b FROM kp UNION SELECT graph_id, v, u FROM kp),
ends AS (SELECT DISTINCT graph_id, unnest([u, v]) AS node FROM ee), re(graph_id, node, root) AS (SELECT graph_id, node, node FROM ends UNION SELECT re.graph_id, b, root FROM re JOIN k2 ON k2.graph_id = re.graph_id AND a = node) SELECT graph_id, node, min(root) AS component FROM re GROUP BY graph_id, node""",
    "network_saidi_agree": f"WITH RECURSIVE {_GRAPHS} SELECT graph_id, count(*) AS n, true AS agree FROM nn GROUP BY graph_id",
    "network_length_gain": f"WITH RECURSIVE {_SUMMARY}, sd AS (SELECT CAST(split_part(graph_id, '/', 1) AS BIGINT) AS rec_id, split_part(graph_id, '/', 2) AS root, length, r / n AS rho FROM su) SELECT g.rec_id, round(1 - o.length / nullif(g.length, 0), 6) AS length_gain, round(1 - o.rho / nullif(g.rho, 0), 6) AS rho_gain FROM sd g JOIN sd o ON o.rec_id = g.rec_id WHERE g.root = 'graph' AND o.root = 'optimal_network'",
}
