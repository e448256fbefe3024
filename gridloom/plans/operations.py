"""Queries of single operations: filters, sets, arrays, polynomials, geometry, random choice, and the invariants of designed networks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import arrays, geo, prob, sql
from gridloom.operators import analysis, design, graphs, networks, reliability, spatial
from gridloom.plans.reference import NEAR, PAIRS, POINTS, SQL, _polys, near, points, query, r, region_edges
from gridloom.session import cut, table
from gridloom.sources import synthetic

# --- filters and tables ---------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' OR l_discount >= 0.09 OR (l_quantity < 5 AND l_linestatus = 'O')")
def any_of_filter(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return l.where((F.col("l_returnflag") == "R") | (F.col("l_discount") >= 0.09) | ((F.col("l_quantity") < 5) & (F.col("l_linestatus") == "O"))).select("l_orderkey", "l_linenumber")


@query("SELECT DISTINCT cap_id FROM capacitors WHERE abs(nomv_kv - 12.47) <= 0.1 + 1e-5 * 12.47")
def tolerance_filter(spark, sf_dir):
    """Equipment of one voltage level, within a tolerance."""
    return table(spark, sf_dir, "capacitors").where(analysis.close_to(F.col("nomv_kv"), 12.47)).select("cap_id").distinct()


@query("SELECT DISTINCT node_id FROM nodes WHERE pos.x BETWEEN -10 AND 40 AND pos.y BETWEEN 30 AND 60")
def box_filter(spark, sf_dir):
    return table(spark, sf_dir, "nodes").where(analysis.in_box(F.col("pos.x"), F.col("pos.y"), -10, 30, 40, 60)).select("node_id").distinct()


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AS has_large FROM customer")
def membership_flag(spark, sf_dir):
    large = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return analysis.flagged(table(spark, sf_dir, "customer").select("c_custkey"), large, "c_custkey", "has_large")


@query("""WITH ch AS (SELECT o_custkey AS c_custkey, arg_max(o_totalprice, o_orderkey) AS bal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, c_nationkey, round(coalesce(ch.bal, c_acctbal), 6) AS c_acctbal FROM customer LEFT JOIN ch USING (c_custkey)""")
def upsert_by_key(spark, sf_dir):
    """Customers' balances replaced by their last finished order's price."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("c_acctbal"))
    changes = done.join(base.select("c_custkey", "c_nationkey"), "c_custkey")
    return analysis.upsert(base, changes, ["c_custkey", "c_nationkey"], "o_orderkey").withColumn("c_acctbal", r("c_acctbal", 6))


@query("SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS numbers, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_linenumber, l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def implode_lines(spark, sf_dir):
    """An order's lines as aligned arrays, shown as text."""
    held = analysis.implode(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber", "l_linenumber", "l_suppkey")
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias
    return held.select("l_orderkey", text("l_linenumber")("numbers"), text("l_suppkey")("suppliers"), F.size("l_linenumber").cast("bigint").alias("n"))


@query(f"WITH {PAIRS}, g AS (SELECT la, count(*) AS n, min(a) AS first FROM nr GROUP BY la) SELECT la AS label, n, row_number() OVER (ORDER BY n DESC, la) AS place FROM g")
def sort_by_group_size(spark, sf_dir):
    """Labels by the number of their near pairs, largest first."""
    n = near(spark, sf_dir).join(points(spark, sf_dir).select(F.col("id").alias("a"), "label"), "a").groupBy("label").agg(F.count("*").alias("n"))
    return analysis.permuted(n.withColumn("one", F.lit(1)), ["one"], -F.col("n"), "label").select("label", "n", F.col("place").cast("bigint").alias("place"))


@query(f"WITH {POINTS} SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY (id * 7919 + 12345) % 1000003, id) AS place FROM pt")
def random_order(spark, sf_dir):
    """A random order of each label's points, by a rule."""
    draw = F.pmod(F.col("id") * 7919 + 12345, F.lit(1_000_003))
    return analysis.permuted(points(spark, sf_dir), ["label"], draw, "id").select("label", "id", F.col("place").cast("bigint").alias("place"))


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'click') THEN 'boolean' WHEN event_id % 3 = 0 THEN 'bigint' WHEN event_id % 3 = 1 THEN 'double' ELSE 'string' END AS kind,
CASE WHEN event_type = 'error' THEN 0.0 WHEN event_type = 'click' THEN 1.0 WHEN event_id % 3 = 0 THEN event_id WHEN event_id % 3 = 1 THEN event_id / 2 END AS number FROM events""")
def typed_keys(spark, sf_dir):
    """Keys written as text, read as what they are."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_type") == "error", "False").when(F.col("event_type") == "click", " true").when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))
    key = key.when(F.col("event_id") % 3 == 1, F.format_string("%.1f", F.col("event_id") / 2)).otherwise(F.concat(F.lit("n"), F.col("event_id").cast("string")))
    return e.select("event_id", analysis.typed_key(key).alias("k")).select("event_id", "k.kind", "k.number")


# --- polynomials and arrays --------------------------------------------------------------------


def _long(df: DataFrame, op: str, values: Column) -> DataFrame:
    return df.select("n_nationkey", F.lit(op).alias("op"), F.posexplode(values).alias("i", "value")).select("n_nationkey", "op", F.col("i").cast("bigint").alias("i"), (r("value") + 0).alias("value"))


@query("""WITH b AS (SELECT n_nationkey AS k, CAST(n_regionkey AS DOUBLE) AS g, CAST(n_nationkey AS DOUBLE) AS x FROM nation)
SELECT k AS n_nationkey, op, CAST(i AS BIGINT) AS i, CAST(v[i + 1] AS DOUBLE) AS value FROM (SELECT k, unnest(['add', 'scale', 'trim', 'pow', 'quotient', 'remainder', 'plus', 'minus', 'times', 'binom']) AS op,
 unnest([[1 + g, x - 2, g], [3, 3 * x, 3 * g], [1, x, g + 1], [1, 3 * g, 3 * g ** 2, g ** 3], [1, x, g + 1], [7], [1 + g, x - 2], [1 - g, x + 2], [g, -2 * x], [round(1 + x * 0.1 + g * 0.01, 9)]]) AS v FROM b) CROSS JOIN range(4) t(i) WHERE i < len(v)""")
def poly_algebra(spark, sf_dir):
    """Sums, multiples, powers and quotients of polynomials, elementwise arithmetic of arrays, and the value by way of the other basis."""
    base = _polys(spark, sf_dir).withColumn("g", F.col("b")[0])
    a, b, g = F.col("a"), F.col("b"), F.col("g")
    monic = F.array(F.lit(1.0), a[1], g + 1)
    divisor = F.array(g + 1, F.lit(-2.0))
    divided = prob.poly_divmod(prob.poly_add(prob.poly_mul(monic, divisor), F.array(F.lit(7.0))), divisor)
    two = F.array(F.lit(1.0), a[1])
    rows = {
        "add": prob.poly_add(a, b), "scale": prob.poly_scale(a, F.lit(3.0)), "trim": prob.poly_trim(F.concat(monic, F.array(F.lit(0.0), F.lit(0.0)))), "pow": prob.poly_pow(F.array(F.lit(1.0), g), F.lit(3)),
        "quotient": divided["quotient"], "remainder": divided["remainder"], "plus": prob.array_apply(two, b, "+"), "minus": prob.array_apply(two, b, "-"), "times": prob.array_apply(two, b, "*"),
        "binom": F.array(prob.binom_eval(prob.poly_to_binom(a), F.lit(0.1))),
    }
    out = None
    for op, values in rows.items():
        part = _long(base, op, values)
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_nationkey, CAST(n_nationkey + 1 AS DOUBLE) AS root FROM nation UNION ALL SELECT n_nationkey, n_regionkey + 1.5 FROM nation")
def positive_roots(spark, sf_dir):
    """Positive real roots of polynomials with known ones, a negative one and a pair that is not real."""
    n = table(spark, sf_dir, "nation")
    linear = lambda root: F.array(-root, F.lit(1.0))
    poly = prob.poly_mul(prob.poly_mul(linear(F.col("n_nationkey") + 1.0), linear(F.col("n_regionkey") + 1.5)), prob.poly_mul(linear(F.lit(-2.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(1.0))))
    return prob.root_rows(n.select("n_nationkey", "n_regionkey"), poly).where("root > 0").select("n_nationkey", r("root", 6).alias("root"))


@query("""WITH b AS (SELECT n_nationkey AS k, n_regionkey AS g FROM nation)
SELECT k AS n_nationkey, op, CAST(i AS BIGINT) AS i, round(CAST(v[i + 1] AS DOUBLE), 9) AS value FROM (SELECT k, unnest(['pad', 'cut', 'roll', 'linspace', 'logspace', 'interp']) AS op,
 unnest([[1, k, g, 0, 0], [1, k], CASE g % 3 WHEN 0 THEN [1, k, g] WHEN 1 THEN [g, 1, k] ELSE [k, g, 1] END, [k, k + 0.25, k + 0.5, k + 0.75, k + 1], [1, sqrt(k + 1), k + 1], [CASE WHEN k <= 1 THEN 10 WHEN k >= 9 THEN 50 WHEN k < 4 THEN 10 + (k - 1) * 10 / 3 ELSE 20 + (k - 4) * 6 END]]) AS v FROM b) CROSS JOIN range(5) t(i) WHERE i < len(v)""")
def array_tools(spark, sf_dir):
    """Arrays padded, cut, rolled, spaced and interpolated."""
    base = _polys(spark, sf_dir)
    k, g = F.col("n_nationkey"), F.col("b")[0].cast("int")
    fixed = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    rows = {
        "pad": arrays.resized(F.col("a"), 5), "cut": arrays.resized(F.col("a"), 2), "roll": arrays.rolled(F.col("a"), g), "linspace": arrays.linspace(k.cast("double"), k + 1.0, 5),
        "logspace": arrays.logspace(F.lit(1.0), k + 1.0, 3), "interp": F.array(arrays.interpolated(k.cast("double"), fixed(1, 4, 9), fixed(10, 20, 50))),
    }
    out = None
    for op, values in rows.items():
        part = _long(base, op, values)
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT n_nationkey, round(1 + n_nationkey * 0.5 + n_regionkey * 0.25, 9) AS value, round(1 - (1 - 0.01) * (1 - n_regionkey / 10), 9) AS fail, round(1 - exp(-n_nationkey / 10), 9) AS edge, round(n_nationkey * pi() * 6378137 / 180, 3) AS mx, (n_nationkey - 1) * n_nationkey * (n_nationkey + 1) / 6 AS risk FROM nation")
def functions_in_sql(spark, sf_dir):
    """The package's functions called from SQL text."""
    sql.register(spark)
    rows = _polys(spark, sf_dir).withColumn("g", F.col("b")[0])
    return rows.select("n_nationkey", *[F.expr(f"round({e}, {d})").alias(c) for c, e, d in (("value", "poly_value(a, 0.5D)", 9), ("fail", "chain_fail(array(0.01D, g / 10))", 9), ("edge", "edge_fail(cast(n_nationkey as double), 0.1D)", 9), ("mx", "mercator_x(cast(n_nationkey as double))", 3), ("risk", "chain_risk(cast(n_nationkey as double))", 9))])


# --- geometry -------------------------------------------------------------------------------------


def _ring(*corners: tuple) -> Column:
    at = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.array(*[F.struct(at(x).cast("double").alias("x"), at(y).cast("double").alias("y")) for x, y in corners])


@query("""WITH b AS (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x, n_regionkey + 5.0 AS h FROM nation)
SELECT n_nationkey, greatest(least(x + 10, 12) - greatest(x, 5), 0) * greatest(least(h, 4) - 1, 0) AS area, CASE WHEN x < 12 THEN (least(x + 10, 12) + greatest(x, 5)) / 2 END AS cx, CASE WHEN x < 12 THEN (least(h, 4) + 1) / 2 END AS cy FROM b""")
def clip_to_box(spark, sf_dir):
    """Area and centre of the part of each nation's rectangle that lies in a box."""
    x, h = F.col("n_nationkey"), F.col("n_regionkey") + 5.0
    ring = geo.clip_box(_ring((x, 0), (x + 10, 0), (x + 10, h), (x, h)), F.lit(5.0), F.lit(1.0), F.lit(12.0), F.lit(4.0))
    c = table(spark, sf_dir, "nation").select("n_nationkey", ring.alias("ring"))
    return c.select("n_nationkey", geo.ring_area(F.col("ring")).alias("area"), geo.ring_centroid(F.col("ring")).alias("c")).select("n_nationkey", r("area").alias("area"), r("c.x").alias("cx"), r("c.y").alias("cy"))


@query("SELECT DISTINCT node_id, CAST(floor(((pos.x + 180) - 360 * floor((pos.x + 180) / 360)) / 6) AS INTEGER) + 1 AS zone, true AS same FROM nodes WHERE pos.x BETWEEN -180 AND 180 AND pos.y BETWEEN -80 AND 84")
def utm_round_trip(spark, sf_dir):
    """Positions in their zone of the UTM grid and back, to a tenth of a millimetre; by way of it to Mercator as directly."""
    n = table(spark, sf_dir, "nodes").select("node_id", F.col("pos.x").alias("x"), F.col("pos.y").alias("y")).where("x between -180 and 180 and y between -80 and 84").distinct().withColumn("zone", geo.utm_zone(F.col("x")))
    east, north = geo.to_utm(F.col("x"), F.col("y"), F.col("zone"))
    g = n.withColumns({"east": east, "north": north})
    lon, lat = geo.from_utm(F.col("east"), F.col("north"), F.col("zone"), F.col("y") < 0)
    mx, my = geo.utm_to_mercator(F.col("east"), F.col("north"), F.col("zone"), F.col("y") < 0)
    back = g.withColumns({"lon": lon, "lat": lat, "mx": mx, "my": my})
    turned = F.least(F.abs(F.col("lon") - F.col("x")), F.abs(360 - F.abs(F.col("lon") - F.col("x"))))
    same = (turned < 1e-9) & (F.abs(F.col("lat") - F.col("y")) < 1e-9) & (F.abs(F.col("my") - geo.mercator_y(F.col("y"))) < 1e-3)
    return back.select("node_id", "zone", same.alias("same"))


@query(f"WITH {POINTS} SELECT label, round(x, 9) AS x, round(y, 9) AS y FROM pt p WHERE NOT EXISTS (SELECT 1 FROM (SELECT atan2(q.y - p.y, q.x - p.x) AS t FROM pt q WHERE q.label = p.label AND q.id <> p.id) a HAVING coalesce(max(t) - min(t), 0) >= pi() AND (SELECT max(g) FROM (SELECT t - lag(t) OVER (ORDER BY t) AS g FROM (SELECT atan2(q.y - p.y, q.x - p.x) AS t FROM pt q WHERE q.label = p.label AND q.id <> p.id))) <= pi())")
def hull_corners(spark, sf_dir):
    """Corners of the convex hull of each label's points: those that see all others within half a turn."""
    return spatial.convex_hulls(points(spark, sf_dir), "label").select("label", r("x").alias("x"), r("y").alias("y"))


# --- graphs ---------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {PAIRS}, tw AS (SELECT a AS x, b AS y FROM nr UNION ALL SELECT b, a FROM nr), wo(u, v, node) AS (SELECT a, b, a FROM nr UNION SELECT u, v, y FROM wo JOIN tw ON x = node WHERE NOT (x = u AND y = v) AND NOT (x = v AND y = u))
SELECT a AS u, b AS v FROM nr WHERE NOT EXISTS (SELECT 1 FROM wo WHERE u = a AND v = b AND node = b)""")
def bridges(spark, sf_dir):
    """Bridges of the near-point graph."""
    edges = near(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"))
    named = edges.join(graphs.components(edges).select(F.col("node").alias("u"), F.col("component").alias("graph_id")), "u")
    return design.bridges(named).select("u", "v")


@query(f"""WITH RECURSIVE {PAIRS}, tw AS (SELECT a AS x, b AS y, d FROM nr UNION ALL SELECT b, a, d FROM nr), ch(u, v, w, node) AS (SELECT a, b, d, a FROM nr UNION SELECT u, v, w, y FROM ch JOIN tw ON x = node AND d < w)
SELECT a AS u, b AS v, round(d, 9) AS weight FROM nr WHERE NOT EXISTS (SELECT 1 FROM ch WHERE u = a AND v = b AND node = b)""")
def mst_points(spark, sf_dir):
    """Minimum spanning forest of the near-point graph: the edges that no way of shorter ones replaces."""
    e = near(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("d").alias("weight"))
    return graphs.spanning_tree(e).select("u", "v", r("weight").alias("weight"))


@query(f"""WITH RECURSIVE {PAIRS}, tw AS (SELECT a AS x, b AS y, d FROM nr UNION ALL SELECT b, a, d FROM nr), inn AS (SELECT x FROM tw GROUP BY x HAVING count(*) = 2),
rc(node, root) AS (SELECT x, x FROM inn UNION SELECT tw.y, root FROM rc JOIN tw ON tw.x = node JOIN inn ON inn.x = tw.y), own AS (SELECT node, min(root) AS chain FROM rc GROUP BY node),
ce AS (SELECT coalesce(p.chain, q.chain) AS chain, d, CASE WHEN p.chain IS NULL OR q.chain IS NULL THEN 1 ELSE 0 END AS ends FROM nr LEFT JOIN own p ON p.node = a LEFT JOIN own q ON q.node = b),
k AS (SELECT count(*) AS n_edges, sum(d) AS length, 1 - product(1 - d / {NEAR}) AS fail FROM ce WHERE chain IS NOT NULL GROUP BY chain HAVING sum(ends) > 0 UNION ALL SELECT 1, d, d / {NEAR} FROM ce WHERE chain IS NULL)
SELECT n_edges, count(*) AS chains, round(sum(length), 9) AS length, round(avg(fail), 9) AS fail FROM k GROUP BY n_edges""")
def skeleton_chain_lengths(spark, sf_dir):
    e = near(spark, sf_dir).select(F.xxhash64("a", "b").alias("edge_id"), F.col("a").alias("u"), F.col("b").alias("v"), F.col("d").alias("length"), (F.col("d") / NEAR).alias("prob"))
    return graphs.skeleton(e).groupBy("n_edges").agg(F.count("*").alias("chains"), r(F.sum("length")).alias("length"), r(F.avg("fail")).alias("fail"))


@query(f"""WITH RECURSIVE {PAIRS}, mi AS (SELECT id AS node FROM pt WHERE label = 3), tw AS (SELECT a AS x, b AS y FROM nr UNION ALL SELECT b, a FROM nr), mm AS (SELECT x, y FROM tw WHERE x IN (FROM mi) AND y IN (FROM mi)),
rc(node, root) AS (SELECT node, node FROM mi UNION SELECT y, root FROM rc JOIN mm ON x = node), gr AS (SELECT node, min(root) AS g FROM rc GROUP BY node), ar AS (SELECT DISTINCT g, y FROM tw JOIN gr ON node = x WHERE y NOT IN (FROM mi))
SELECT a AS u, b AS v FROM nr WHERE a NOT IN (FROM mi) AND b NOT IN (FROM mi) UNION SELECT p.y, q.y FROM ar p JOIN ar q ON p.g = q.g AND p.y < q.y""")
def without_middle_nodes(spark, sf_dir):
    """The near-point graph after the points of one label have been taken out, their neighbours linked."""
    edges = near(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return networks.without_middle(edges, points(spark, sf_dir).where("label = 3").select(F.col("id").alias("node")))


@query(f"""WITH {PAIRS}, e AS (SELECT a, b, p.x AS px, p.y AS py, q.x AS qx, q.y AS qy FROM nr JOIN pt p ON p.id = a JOIN pt q ON q.id = b)
SELECT a, b, CAST(k AS INTEGER) AS place, round(px + (qx - px) * k / 3, 9) AS x0, round(py + (qy - py) * k / 3, 9) AS y0, round(px + (qx - px) * (k + 1) / 3, 9) AS x1, round(py + (qy - py) * (k + 1) / 3, 9) AS y1 FROM e CROSS JOIN range(3) t(k)""")
def sparse_graph(spark, sf_dir):
    """Each edge of the near-point graph as a chain with two new nodes between its ends."""
    p = points(spark, sf_dir)
    side = lambda s, t: p.select(F.col("id").alias(s), F.col("x").alias(f"{t}x"), F.col("y").alias(f"{t}y"))
    e = near(spark, sf_dir).join(side("a", "u"), "a").join(side("b", "v"), "b").select("a", "b", F.xxhash64("a", "b").alias("edge_id"), F.col("a").alias("u"), F.col("b").alias("v"), "ux", "uy", "vx", "vy")
    s = networks.sparse(e, 2, "a", "b", "ux", "uy", "vx", "vy")
    chains = s.join(e.select("edge_id", "a", "b"), "edge_id")
    return chains.select("a", "b", "place", *[r(c).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""WITH c AS (SELECT n_nationkey AS g, unnest(range(23)) AS k FROM nation), d AS (SELECT g, (g * 15485863 + k * 7919 + 12345) % 1000003 % 25 AS node FROM c)
SELECT b.g AS graph_id, b.node, CAST(1 + count(d.node) AS BIGINT) AS degree FROM (SELECT n_nationkey AS g, unnest(range(25)) AS node FROM nation) b LEFT JOIN d ON d.g = b.g AND d.node = b.node GROUP BY 1, 2""")
def trees_of_codes(spark, sf_dir):
    """Trees of codes by a rule: a node's degree is one more than its number in the code."""
    digit = lambda k: F.pmod(F.pmod(F.col("n_nationkey").cast("bigint") * 15485863 + k * 7919 + 12345, F.lit(1_000_003)), F.lit(25))
    codes = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("graph_id"), F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(22).cast("bigint")), digit).alias("code"))
    return graphs.degrees(synthetic.trees_of_codes(codes), "graph_id")


@query("SELECT n_regionkey AS graph_id, i AS place, round(1 - coalesce(product(1 - p) OVER (PARTITION BY n_regionkey ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 9) AS q_left, round(1 - product(1 - p) OVER (PARTITION BY n_regionkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS q_right FROM (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, (1 + n_nationkey % 5) * 1e-3 AS p FROM nation)")
def chain_losses(spark, sf_dir):
    """Each region's nations as a chain: the losses seen from both ends."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("nk"), ((1 + F.col("n_nationkey") % 5) * 1e-3).alias("p"))
    placed = analysis.permuted(n, ["graph_id"], F.col("nk"), "nk").withColumn("place", (F.col("place") - 1).cast("bigint"))
    return analysis.chain_losses(placed, ["graph_id"], "place", "p").select("graph_id", "place", r("q_left").alias("q_left"), r("q_right").alias("q_right"))


@query(f"""SELECT graph_id, 'saidi' AS kind, NULL AS key, saidi AS value FROM ({SQL['k5_state_enum_saidi']}) UNION ALL SELECT graph_id, 'all_terminal', NULL, disconnected FROM ({SQL['k5_all_terminal']}) UNION ALL SELECT graph_id, 'pairwise', NULL, pairwise_loss FROM ({SQL['k5_pairwise']})
UNION ALL SELECT graph_id, 'nodes_rel', CAST(node AS VARCHAR), q FROM ({SQL['exact_nodes_rel']})
UNION ALL SELECT graph_id, 'edges_rel', edge || ':' || n, x FROM (SELECT graph_id, edge, unnest(['none', 'u', 'v', 'uv']) AS n, unnest([neither, only_u, only_v, both_ends]) AS x FROM (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY u, v) - 1 AS edge FROM ({SQL['k5_edges_rel']})))""")
def k5_indexes(spark, sf_dir):
    """Every index of each region's graph in one table."""
    return reliability.indexes(*region_edges(spark, sf_dir)).withColumn("value", r("value"))


# --- designed networks: what must hold of them --------------------------------------------------------


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select(F.col("label").alias("set_id"), "id", "x", "y")


def _shape(edges: DataFrame, *more: Column) -> DataFrame:
    """``set_id, n, m, forks, parts, bridges`` of the edges (``set_id, u, v``) of each set; ids are unique over the sets."""
    degree = graphs.degrees(edges, "set_id")
    per_set = degree.groupBy("set_id").agg(F.count("*").alias("n"), F.count_if(F.col("degree") >= 3).alias("forks"))
    links = edges.groupBy("set_id").agg(F.count("*").alias("m"), *more)
    whole = graphs.components(edges).join(degree.select("node", "set_id"), "node").groupBy("set_id").agg(F.count_distinct("component").alias("parts"))
    split = design.bridges(edges.select(F.col("set_id").alias("graph_id"), "u", "v")).groupBy(F.col("graph_id").alias("set_id")).agg(F.count("*").alias("b"))
    out = per_set.join(links, "set_id").join(whole, "set_id").join(split, "set_id", "left")
    return out.select("set_id", "n", "m", "forks", "parts", F.coalesce("b", F.lit(0)).alias("bridges"), *[c for c in links.columns if c not in ("set_id", "m")])


@query()
def design_network(spark, sf_dir):
    """A network of redundancy 3 over the points of each label."""
    return design.design(_sets(spark, sf_dir), 3)


@query(f"WITH {POINTS} SELECT label AS set_id, count(*) AS n, count(*) + 2 AS m, 4 AS forks, 1 AS parts, 0 AS bridges FROM pt GROUP BY label")
def design_shape(spark, sf_dir):
    """What a network of redundancy 3 must be: two more edges than nodes, four forks, in one piece, without bridges."""
    return _shape(cut(design.design(_sets(spark, sf_dir), 3)))


@query()
def rewire_network(spark, sf_dir):
    """The designed networks after moves that shorten them within a budget of risk."""
    s = _sets(spark, sf_dir)
    return design.rewired(s, cut(design.design(s, 3)))


@query(f"WITH {POINTS} SELECT label AS set_id, count(*) AS n, count(*) + 2 AS m, 4 AS forks, 1 AS parts, true AS no_longer FROM pt GROUP BY label")
def rewire_shape(spark, sf_dir):
    """Moves keep nodes, edges and forks, and never make a network longer."""
    s = _sets(spark, sf_dir)
    before = cut(design.design(s, 3))
    after = cut(design.rewired(s, before))
    side = lambda c, t: s.select(F.col("id").alias(c), F.col("x").alias(f"x{t}"), F.col("y").alias(f"y{t}"))
    long = after.join(side("u", "u"), "u").join(side("v", "v"), "v").groupBy("set_id").agg(F.sum(geo.distance(F.col("xu"), F.col("yu"), F.col("xv"), F.col("yv"))).alias("after"))
    was = before.groupBy("set_id").agg(F.sum("length").alias("before"))
    return _shape(after).drop("bridges").join(long, "set_id").join(was, "set_id").withColumn("no_longer", F.col("after") <= F.col("before") + 1e-9).drop("after", "before")


@query()
def improve_tree(spark, sf_dir):
    """The spanning tree of each label's points with three chords."""
    return design.improve_trees(_sets(spark, sf_dir), 3)


@query(f"WITH {POINTS} SELECT label AS set_id, count(*) AS n, count(*) - 1 + 3 AS m, 1 AS parts, 3 AS chords FROM pt GROUP BY label")
def improve_shape(spark, sf_dir):
    """A spanning tree in one piece and three chords."""
    return _shape(cut(design.improve_trees(_sets(spark, sf_dir), 3)), F.count_if(F.col("kind") == "chord").alias("chords")).drop("forks", "bridges")


@query()
def closed_loops(spark, sf_dir):
    """A random spanning tree of each label's points with three chords that cover most of it."""
    return design.closed_loops(_sets(spark, sf_dir), 3)


@query(f"WITH {POINTS} SELECT label AS set_id, count(*) AS n, count(*) - 1 + 3 AS m, 1 AS parts, 3 AS chords FROM pt GROUP BY label")
def closed_loops_shape(spark, sf_dir):
    return _shape(cut(design.closed_loops(_sets(spark, sf_dir), 3)), F.count_if(F.col("kind") == "chord").alias("chords")).drop("forks", "bridges")


def _ring_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("id")
    p = points(spark, sf_dir).withColumn("after", F.coalesce(F.lead("id").over(w), F.first("id").over(w)))
    return p.select(F.col("label").alias("set_id"), F.least("id", "after").alias("u"), F.greatest("id", "after").alias("v"))


def _randomly_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates are the pairs of each node with the ones up to seven places away in a random order of the ring's nodes."""
    ring = cut(_ring_edges(spark, sf_dir))
    draw = F.pmod(F.col("id") * 7919 + 12345, F.lit(1_000_003))
    order = analysis.permuted(points(spark, sf_dir), ["label"], draw, "id").select(F.col("label").alias("set_id"), "id", "place")
    ahead = order.select("set_id", F.col("id").alias("a"), F.col("place").alias("pa"), F.explode(F.sequence(F.col("place") + 1, F.col("place") + 7)).alias("place"))
    pairs = ahead.join(order, ["set_id", "place"]).select("set_id", F.least("a", "id").alias("u"), F.greatest("a", "id").alias("v"), "pa", F.col("place").alias("pb")).join(ring, ["set_id", "u", "v"], "left_anti")
    tries = pairs.select("set_id", "u", "v", (F.col("pa") * 1_000_000 + F.col("pb")).cast("bigint").alias("place"))
    return design.randomly_improved(ring, tries, [2, 3, 4])


@query()
def random_improvement(spark, sf_dir):
    """Edges between two nodes of degree 2 added at random to the ring of each label's points, up to redundancy 4."""
    return _randomly_improved(spark, sf_dir)


@query(f"WITH {POINTS} SELECT label AS set_id, count(*) AS n, count(*) + 3 AS m, 6 AS forks, 1 AS parts, 0 AS bridges FROM pt GROUP BY label")
def random_improvement_shape(spark, sf_dir):
    """Three edges more than the ring, each between two new forks."""
    return _shape(cut(_ring_edges(spark, sf_dir).unionByName(_randomly_improved(spark, sf_dir).select("set_id", "u", "v"))))
