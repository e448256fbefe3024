"""Queries of the network operators over the whole driver tables, each with its SQL.

Graphs are views of the tables: the supply tree root - region - nation - customer,
the ring of nations, one complete graph per region, the near-point graph of the embeddings,
and the bipartite graph of suppliers and parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import geo, prob
from gridloom.operators import analysis, design, graphs, reliability, simulation
from gridloom.session import cut, table
from gridloom.streaming import windows

QUERIES: dict = {}
SQL: dict[str, str] = {}

NEAR = 0.02
RATE = 3.0


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def r(c: Column | str, digits: int = 9) -> Column:
    return F.round(c, digits)


# --- views -----------------------------------------------------------------------------


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as leaves of the tree: weight ``w`` and probability ``q`` of being cut off from the root."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    up = (1 - (F.col("n_regionkey") + 1) * 5e-4) * (1 - (1 + F.col("n_nationkey") % 5) * 1e-3) * (1 - (1 + F.col("c_custkey") % 7) * 1e-4)
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey", (F.greatest("c_acctbal", F.lit(0.0)) + 1).alias("w"), (1 - up).alias("q"))


LEAVES = """leaf AS (SELECT c_custkey, n_nationkey, n_regionkey, greatest(c_acctbal, 0) + 1 AS w,
 1 - (1 - (n_regionkey + 1) * 5e-4) * (1 - (1 + n_nationkey % 5) * 1e-3) * (1 - (1 + c_custkey % 7) * 1e-4) AS q
 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), ((1 + F.col("n_nationkey") % 5) * 1e-3).alias("p"))


def region_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The complete graph of each region's nations; nodes by their place in the region, from 0."""
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("graph_id"), F.col("n_nationkey").alias("nk"), (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1).cast("bigint").alias("i"))
    a, b = n.select("graph_id", F.col("nk").alias("ka"), F.col("i").alias("u")), n.select("graph_id", F.col("nk").alias("kb"), F.col("i").alias("v"))
    e = a.join(b, "graph_id").where("u < v").withColumn("prob", (1 + (F.col("ka") + 2 * F.col("kb")) % 5) * 1e-2)
    e = e.withColumn("edge_id", F.row_number().over(Window.partitionBy("graph_id").orderBy("u", "v")) - 1)
    nodes = n.select("graph_id", F.col("i").alias("node"), (F.col("nk") + 1).cast("double").alias("weight"), (F.col("i") == 0).alias("is_source"))
    return nodes, e.select("graph_id", "edge_id", "u", "v", "prob")


STATES = """idx AS (SELECT n_nationkey nk, n_regionkey g, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i FROM nation),
e AS (SELECT a.g, a.i AS u, b.i AS v, (1 + (a.nk + 2 * b.nk) % 5) * 1e-2 AS p, row_number() OVER (PARTITION BY a.g ORDER BY a.i, b.i) - 1 AS eid
 FROM idx a JOIN idx b ON a.g = b.g AND a.i < b.i),
s AS (SELECT g, CAST(t.state AS BIGINT) AS state FROM (SELECT DISTINCT g FROM idx) CROSS JOIN range(1024) t(state)),
pr AS (SELECT g, state, product(CASE WHEN (state >> eid) & 1 = 1 THEN 1 - p ELSE p END) AS prob FROM s JOIN e USING (g) GROUP BY g, state),
m0 AS (SELECT s.g, state, i AS st, CAST(1 << i AS BIGINT) AS mask FROM s JOIN idx USING (g)),
""" + "".join(
    f"""m{k + 1} AS (SELECT g, state, st, bit_or(mask | CASE WHEN (state >> eid) & 1 = 1 AND ((mask >> u) & 1 = 1 OR (mask >> v) & 1 = 1) THEN (1 << u) | (1 << v) ELSE 0 END) AS mask
 FROM m{k} JOIN e USING (g) GROUP BY g, state, st),
"""
    for k in range(4)
)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").cast("bigint").alias("label"))


POINTS = "pt AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(label AS BIGINT) AS label FROM embeddings)"


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.range_pairs(points(spark, sf_dir), NEAR)


PAIRS = f"{POINTS}, nr AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pt a JOIN pt b ON a.id < b.id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= {NEAR})"
CENTERS = f"{POINTS}, ce AS (SELECT label AS id, avg(x) AS x, avg(y) AS y, count(*) AS n FROM pt GROUP BY label)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("id", "label")
    return near(spark, sf_dir).join(p.withColumnsRenamed({"id": "a", "label": "la"}), "a").join(p.withColumnsRenamed({"id": "b", "label": "lb"}), "b")


def centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy(F.col("label").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))


def center_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = centers(spark, sf_dir)
    a, b = c.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("n").alias("na")), c.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("nb"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("d", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))


# --- tree, ring and path -------------------------------------------------------------------


@query(f"WITH {LEAVES} SELECT n_nationkey, round(sum(w * q) / sum(w), 9) AS saidi, count(*) AS n_leaves FROM leaf GROUP BY n_nationkey")
def tree_saidi(spark, sf_dir):
    return leaves(spark, sf_dir).groupBy("n_nationkey").agg(r(F.sum(F.col("w") * F.col("q")) / F.sum("w")).alias("saidi"), F.count("*").alias("n_leaves"))


@query(f"WITH {LEAVES} SELECT c_custkey, round(q, 9) AS q FROM leaf")
def tree_nodes_rel(spark, sf_dir):
    return leaves(spark, sf_dir).select("c_custkey", r("q").alias("q"))


@query("""WITH d AS (SELECT 1 AS d FROM region UNION ALL SELECT 2 FROM nation UNION ALL SELECT 3 FROM customer)
SELECT power, round(sum(CASE power WHEN 0 THEN 0 WHEN 1 THEN d WHEN 2 THEN -d * (d - 1) / 2.0 ELSE d * (d - 1) * (d - 2) / 6.0 END) / count(*), 9) AS coef FROM d CROSS JOIN range(4) t(power) GROUP BY power""")
def tree_poly_coeffs(spark, sf_dir):
    depth = lambda t, d: table(spark, sf_dir, t).select(F.lit(d).alias("d"))
    d = depth("region", 1).unionByName(depth("nation", 2)).unionByName(depth("customer", 3))
    up = F.array(F.lit(1.0), F.lit(-1.0))
    q = d.select(prob.poly_sub(F.array(F.lit(1.0)), F.aggregate(F.sequence(F.lit(1), F.col("d")), F.array(F.lit(1.0)), lambda acc, _: prob.poly_mul(acc, up))).alias("q"))
    total = d.select(F.count("*").alias("n"))
    powers = q.select(F.posexplode("q").alias("power", "c")).groupBy("power").agg(F.sum("c").alias("c"))
    return powers.crossJoin(F.broadcast(total)).select(F.col("power").cast("bigint").alias("power"), r(F.col("c") / F.col("n")).alias("coef"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey), n AS (SELECT n_nationkey, n_regionkey, 1 + coalesce(n, 0) AS size FROM nation LEFT JOIN c ON k = n_nationkey)
SELECT 'nation' AS level, n_nationkey AS id, size FROM n UNION ALL SELECT 'region', n_regionkey, CAST(1 + sum(size) AS BIGINT) FROM n GROUP BY n_regionkey""")
def tree_subtree_sizes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = table(spark, sf_dir, "nation").join(c, "n_nationkey", "left").select("n_nationkey", "n_regionkey", (1 + F.coalesce("n", F.lit(0))).alias("size"))
    regions = n.groupBy(F.col("n_regionkey").alias("id")).agg((1 + F.sum("size")).alias("size"))
    return n.select(F.lit("nation").alias("level"), F.col("n_nationkey").alias("id"), "size").unionByName(regions.select(F.lit("region").alias("level"), "id", "size"))


@query("SELECT (SELECT count(*) FROM region) + 2 * (SELECT count(*) FROM nation) + 3 * count(*) AS total_depth, round(((SELECT count(*) FROM region) + 2 * (SELECT count(*) FROM nation) + 3 * count(*)) / (count(*) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region)), 9) AS avg_depth FROM customer")
def tree_depth_avg(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).withColumn("d", F.lit(d)) for t, d in (("region", 1), ("nation", 2), ("customer", 3))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.agg(F.sum(F.col("n") * F.col("d")).alias("total_depth"), r(F.sum(F.col("n") * F.col("d")) / F.sum("n")).alias("avg_depth"))


RING = "rg AS (SELECT n_nationkey AS node, (1 + n_nationkey % 5) * 1e-3 AS p FROM nation)"


@query(f"""WITH {RING}, w AS (SELECT node, product(1 - p) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, product(1 - p) OVER (ORDER BY node ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rt FROM rg)
SELECT node, round(1 - coalesce(l, 1), 9) AS q_left, round(1 - rt, 9) AS q_right, round((1 - coalesce(l, 1)) * (1 - rt), 12) AS loss FROM w""")
def ring_two_source_loss(spark, sf_dir):
    """Ring with its first node as source: a node is lost when both ways to it are cut."""
    w = Window.orderBy("node")
    left = F.coalesce(F.product(1 - F.col("p")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    right = F.product(1 - F.col("p")).over(w.rowsBetween(0, Window.unboundedFollowing))
    return ring(spark, sf_dir).select("node", (1 - left).alias("l"), (1 - right).alias("rt")).select("node", r("l").alias("q_left"), r("rt").alias("q_right"), r(F.col("l") * F.col("rt"), 12).alias("loss"))


@query(f"WITH {RING} SELECT node, round(1 - product(1 - p) OVER (ORDER BY node ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS loss FROM rg")
def path_one_source_loss(spark, sf_dir):
    w = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, 0)
    return ring(spark, sf_dir).select("node", r(1 - F.product(1 - F.col("p")).over(w)).alias("loss"))


# --- exact reliability -----------------------------------------------------------------------


@query(f"WITH {STATES} x AS (SELECT 1) SELECT m4.g AS graph_id, round(sum(prob * w.w) / max(t.w), 9) AS saidi FROM m4 JOIN pr USING (g, state) JOIN (SELECT g, i, nk + 1.0 AS w FROM idx WHERE i > 0) w ON w.g = m4.g AND (mask >> w.i) & 1 = 0 JOIN (SELECT g, sum(nk + 1.0) AS w FROM idx WHERE i > 0 GROUP BY g) t ON t.g = m4.g WHERE st = 0 GROUP BY m4.g")
def k5_state_enum_saidi(spark, sf_dir):
    return reliability.saidi_exact(*region_edges(spark, sf_dir)).select("graph_id", r("saidi").alias("saidi"))


@query(f"WITH {STATES} x AS (SELECT 1) SELECT g AS graph_id, round(sum(prob), 9) AS disconnected FROM m4 JOIN pr USING (g, state) WHERE st = 0 AND mask <> 31 GROUP BY g")
def k5_all_terminal(spark, sf_dir):
    return reliability.all_terminal(*region_edges(spark, sf_dir)).select("graph_id", r("disconnected").alias("disconnected"))


@query(f"WITH {STATES} x AS (SELECT 1), c AS (SELECT g, state, sum(bit_count(mask) - 1) / 2 AS pairs FROM m4 GROUP BY g, state) SELECT g AS graph_id, round(1 - sum(prob * pairs) / 10, 9) AS pairwise_loss FROM c JOIN pr USING (g, state) GROUP BY g")
def k5_pairwise(spark, sf_dir):
    return reliability.pairwise(*region_edges(spark, sf_dir)).select("graph_id", r("pairwise_loss").alias("pairwise_loss"))


@query(f"""WITH {STATES} x AS (SELECT 1), k AS (SELECT e.g, e.u, e.v, prob / e.p AS q, (mask >> e.u) & 1 AS ru, (mask >> e.v) & 1 AS rv FROM m4 JOIN pr USING (g, state) JOIN e ON e.g = m4.g WHERE st = 0 AND (m4.state >> e.eid) & 1 = 0)
SELECT g AS graph_id, u, v, round(sum(CASE WHEN ru + rv = 0 THEN q ELSE 0 END), 9) AS neither, round(sum(CASE WHEN ru = 1 AND rv = 0 THEN q ELSE 0 END), 9) AS only_u, round(sum(CASE WHEN ru = 0 AND rv = 1 THEN q ELSE 0 END), 9) AS only_v, round(sum(CASE WHEN ru + rv = 2 THEN q ELSE 0 END), 9) AS both_ends FROM k GROUP BY g, u, v""")
def k5_edges_rel(spark, sf_dir):
    """Which ends of an edge the source reaches without that edge."""
    return reliability.edges_rel(*region_edges(spark, sf_dir)).select("graph_id", "u", "v", *[r(c).alias(c) for c in ("neither", "only_u", "only_v", "both_ends")])


@query(f"WITH {STATES} x AS (SELECT 1) SELECT m4.g AS graph_id, i AS node, round(sum(CASE WHEN (mask >> i) & 1 = 0 THEN prob ELSE 0 END), 9) AS q FROM m4 JOIN pr USING (g, state) JOIN idx ON idx.g = m4.g WHERE st = 0 GROUP BY m4.g, i")
def exact_nodes_rel(spark, sf_dir):
    """The frontier kernel, one group per graph."""
    nodes, edges = region_edges(spark, sf_dir)
    return reliability.exact(nodes, edges).select("graph_id", "node", r(F.col("q")[0]).alias("q"))


@query(f"""WITH {STATES} x AS (SELECT 1), f AS (SELECT state, 10 - bit_count(state) AS down FROM (SELECT DISTINCT state FROM s)),
k AS (SELECT m4.g, i, down, count(*) AS c FROM m4 JOIN f USING (state) JOIN idx ON idx.g = m4.g WHERE st = 0 AND (mask >> i) & 1 = 0 GROUP BY m4.g, i, down),
b AS (SELECT g, i, p, round(sum(c * p ** down * (1 - p) ** (10 - down)), 9) AS q FROM k CROSS JOIN (SELECT unnest([1e-2, 1e-1, 5e-1]) AS p) GROUP BY g, i, p)
SELECT g AS graph_id, i AS node, p, q FROM b""")
def exact_over_p(spark, sf_dir):
    """All edges fail with p, for several p at once."""
    grid = [1e-2, 1e-1, 5e-1]
    nodes, edges = region_edges(spark, sf_dir)
    q = reliability.exact(nodes, edges, p_grid=grid).where("node > 0")
    return q.select("graph_id", "node", F.posexplode("q").alias("k", "v")).select("graph_id", "node", F.array(*map(F.lit, grid))[F.col("k")].alias("p"), r("v").alias("q"))


@query(f"""WITH {STATES} x AS (SELECT 1), f AS (SELECT state, 10 - bit_count(state) AS down FROM (SELECT DISTINCT state FROM s)),
k AS (SELECT m4.g, i, down, sum(CASE WHEN (mask >> i) & 1 = 0 THEN 1 ELSE 0 END) AS c FROM m4 JOIN f USING (state) JOIN idx ON idx.g = m4.g WHERE st = 0 GROUP BY m4.g, i, down),
t AS (SELECT g, i, down + j AS power, c * (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * factorial(CAST(10 - down AS INTEGER)) / (factorial(CAST(j AS INTEGER)) * factorial(CAST(10 - down - j AS INTEGER))) AS x FROM k CROSS JOIN range(0, 11) r(j) WHERE j <= 10 - down)
SELECT g AS graph_id, i AS node, CAST(power AS BIGINT) AS power, round(CAST(sum(x) AS DOUBLE), 6) + 0 AS coef FROM t GROUP BY g, i, power""")
def exact_polynomial(spark, sf_dir):
    """Coefficients in p of each node's probability, all powers."""
    nodes, edges = region_edges(spark, sf_dir)
    every = reliability.exact(nodes, edges, polynomial=True).select("graph_id", "node", F.posexplode("q").alias("power", "coef"))
    return every.select("graph_id", "node", F.col("power").cast("bigint").alias("power"), (r("coef", 6) + 0).alias("coef"))


# --- graphs ----------------------------------------------------------------------------------


@query("""WITH b AS (SELECT DISTINCT s_nationkey, l_suppkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
SELECT s_nationkey, n, m, m - n + 1 AS r, round((m - n + 1) / n, 9) AS rho FROM (SELECT s_nationkey, count(DISTINCT l_suppkey) + count(DISTINCT l_partkey) AS n, count(*) AS m FROM b GROUP BY s_nationkey)""")
def graph_summary_nmr(spark, sf_dir):
    """Nodes, edges and redundancy of each nation's supplier-part graph."""
    l, s = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    b = l.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    suppliers = b.groupBy("s_nationkey", "l_suppkey").agg(F.count("*").alias("k")).groupBy("s_nationkey").agg(F.sum("k").alias("m"), F.count("*").alias("n1"))
    parts = b.select("s_nationkey", "l_partkey").distinct().groupBy("s_nationkey").agg(F.count("*").alias("n2"))
    nodes = suppliers.join(parts, "s_nationkey").withColumn("n", F.col("n1") + F.col("n2"))
    return nodes.select("s_nationkey", "n", "m", (F.col("m") - F.col("n") + 1).alias("r"), r((F.col("m") - F.col("n") + 1) / F.col("n")).alias("rho"))


@query("""WITH b AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) SELECT side, degree, count(*) AS n FROM (SELECT 'supplier' AS side, count(*) AS degree FROM b GROUP BY l_suppkey UNION ALL SELECT 'part', count(*) FROM b GROUP BY l_partkey) GROUP BY side, degree""")
def degree_distribution(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    side = lambda c, name: b.groupBy(c).agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n")).withColumn("side", F.lit(name))
    return side("l_suppkey", "supplier").unionByName(side("l_partkey", "part")).select("side", "degree", "n")


REACH = f"{PAIRS}, two AS (SELECT a AS node, b AS other FROM nr UNION ALL SELECT b, a FROM nr), rc(node, root) AS (SELECT id, id FROM pt UNION SELECT other, root FROM rc JOIN two USING (node)), co AS (SELECT node, min(root) AS component FROM rc GROUP BY node)"


@query(f"WITH RECURSIVE {REACH} SELECT node, component FROM co")
def components(spark, sf_dir):
    p = points(spark, sf_dir)
    return graphs.components(near(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v")), p.select(F.col("id").alias("node")))


@query(f"""WITH RECURSIVE {REACH}, bf(node, depth) AS (SELECT DISTINCT component, 0 FROM co JOIN two USING (node) UNION SELECT other, depth + 1 FROM bf JOIN two USING (node) WHERE depth < (SELECT max(n) FROM (SELECT count(*) AS n FROM co GROUP BY component)))
SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM bf GROUP BY node""")
def bfs_depth(spark, sf_dir):
    """Depth of each point from the smallest of its component."""
    edges = near(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = graphs.components(edges).select(F.col("component").alias("node")).distinct()
    return graphs.bfs(edges, roots)


@query(f"WITH {PAIRS} SELECT a, b FROM nr WHERE la < 5 AND lb < 5")
def induced_subgraph(spark, sf_dir):
    """The near-point graph between the points of the lower half of the labels."""
    p = points(spark, sf_dir)
    edges = near(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return graphs.induced(edges, p.where("label < 5").select(F.col("id").alias("node"))).select(F.col("u").alias("a"), F.col("v").alias("b"))


@query(f"WITH {PAIRS} SELECT x.label AS a, y.label AS b FROM (SELECT DISTINCT label FROM pt) x JOIN (SELECT DISTINCT label FROM pt) y ON x.label < y.label WHERE NOT EXISTS (SELECT 1 FROM nr WHERE d <= 2e-3 AND least(la, lb) = x.label AND greatest(la, lb) = y.label)")
def anti_join_nonedges(spark, sf_dir):
    """Pairs of labels without points closer than a tenth of the radius."""
    labels = points(spark, sf_dir).select("label").distinct()
    pairs = labels.select(F.col("label").alias("a")).join(labels.select(F.col("label").alias("b")), F.col("a") < F.col("b"))
    there = labelled(spark, sf_dir).where("d <= 2e-3").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    return pairs.join(there, ["a", "b"], "left_anti")


@query(f"WITH {PAIRS} SELECT least(la, lb) AS u, greatest(la, lb) AS v, count(*) AS n_edges, round(product(d / {NEAR}), 9) AS prob FROM nr GROUP BY 1, 2")
def parallel_merge_product(spark, sf_dir):
    e = labelled(spark, sf_dir).select(F.col("la").alias("u"), F.col("lb").alias("v"), (F.col("d") / NEAR).alias("prob"))
    return graphs.merge_parallel(e).select("u", "v", "n_edges", r("prob").alias("prob"))


@query(f"WITH {PAIRS}, c AS (SELECT CASE WHEN la < 2 THEN -1 ELSE a END AS u, CASE WHEN lb < 2 THEN -1 ELSE b END AS v FROM nr) SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS n FROM c WHERE u <> v GROUP BY 1, 2")
def contract_sources(spark, sf_dir):
    """Points of the first two labels become one source."""
    p = points(spark, sf_dir)
    edges = near(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return graphs.contract(edges, p.where("label < 2").select(F.col("id").alias("node")), F.lit(-1).cast("bigint")).groupBy("u", "v").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, count(*) AS n_edges, round(1 - product(1 - l_discount / 10), 9) AS fail FROM lineitem GROUP BY l_orderkey")
def chain_fail_prob(spark, sf_dir):
    """An order as a chain of its lines."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_edges"), r(1 - F.product(1 - F.col("l_discount") / 10)).alias("fail"))


@query(f"WITH {PAIRS} SELECT a, b, round(1 - exp(-d * {RATE}), 9) AS prob FROM nr")
def edge_len_prob_rate(spark, sf_dir):
    return near(spark, sf_dir).select("a", "b", r(1 - F.exp(-F.col("d") * RATE)).alias("prob"))


@query(f"WITH {PAIRS} SELECT la AS label, count(*) AS n_edges, true AS solved FROM nr GROUP BY la")
def edge_prob_solve_rate(spark, sf_dir):
    """The rate at which a label's edges fail with 1 per cent on average, checked against the edges."""
    e = labelled(spark, sf_dir).select(F.col("la").alias("label"), "d")
    rates = analysis.solve_rate(e, "label", "d", 0.01)
    return e.join(rates, "label").groupBy("label").agg(F.count("*").alias("n_edges"), (F.abs(F.avg(1 - F.exp(-F.col("d") * F.col("rate"))) - 0.01) < 1e-6).alias("solved"))


@query(f"WITH {PAIRS} SELECT count(*) AS n_edges, round(sum(d), 9) AS weight FROM nr")
def total_weight(spark, sf_dir):
    return near(spark, sf_dir).agg(F.count("*").alias("n_edges"), r(F.sum("d")).alias("weight"))


STEPS = f"{POINTS}, st AS (SELECT label, id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny, lead(id) OVER w IS NOT NULL AS inner_step FROM pt WINDOW w AS (PARTITION BY label ORDER BY id))"


def _steps(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("label").orderBy("id")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w))
    return points(spark, sf_dir).withColumns({"nx": nxt("x"), "ny": nxt("y"), "inner_step": F.lead("id").over(w).isNotNull()}).withColumn("d", geo.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")))


@query(f"WITH {STEPS} SELECT label, count(*) AS n, round(sum(sqrt((x - nx) ** 2 + (y - ny) ** 2)), 9) AS length FROM st GROUP BY label")
def tour_length(spark, sf_dir):
    """The closed tour of each label's points in order of id."""
    return _steps(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), r(F.sum("d")).alias("length"))


@query(f"WITH {STEPS}, c AS (SELECT label, sum(sqrt((x - nx) ** 2 + (y - ny) ** 2)) * sqrt(count(*) + 1 - 2) AS s FROM st WHERE inner_step GROUP BY label) SELECT round(stddev_pop(s), 9) AS sigma, count(*) AS chains FROM c")
def effective_sigma(spark, sf_dir):
    c = _steps(spark, sf_dir).where("inner_step").groupBy("label").agg((F.sum("d") * F.sqrt(F.count("*") + 1 - 2)).alias("s"))
    return c.agg(r(F.stddev_pop("s")).alias("sigma"), F.count("*").alias("chains"))


@query(f"WITH {POINTS} SELECT label, count(*) AS l, (count(*) - 1) * count(*) * (count(*) + 1) / 6 AS risk FROM pt GROUP BY label")
def inter_risk(spark, sf_dir):
    n = F.count("*")
    return points(spark, sf_dir).groupBy("label").agg(n.alias("l"), ((n - 1) * n * (n + 1) / 6).alias("risk"))


#: Positions of a chain that one row gives at a time.
POSITIONS = 1 << 16


@query(f"""WITH {POINTS}, c AS (SELECT label, count(*) AS l FROM pt GROUP BY label), h AS (SELECT sum((l - 1) * l * (l + 1) / 6) AS h0 FROM c), m AS (SELECT x.label AS chain_from, y.label AS chain_to, x.l AS l1, y.l AS l2, unnest(range(1, y.l)) AS i FROM c x JOIN c y ON x.label <> y.label)
SELECT chain_from, chain_to, i, round((((l2 - i - 1) * (l2 - i) * (l2 - i + 1) - (l2 - 1) * l2 * (l2 + 1) + (l1 + i - 1) * (l1 + i) * (l1 + i + 1) - (l1 - 1) * l1 * (l1 + 1)) / 6) / h0, 9) AS d_risk FROM m CROSS JOIN h""")
def rewire_candidates(spark, sf_dir):
    """Change of risk for every move between two chains, i from 1 to one less than the second chain's length.

    Long chains are divided, so that no row holds more than ``POSITIONS`` positions and one pair is spread over tasks.
    """
    pairs = _chain_pairs(spark, sf_dir).where("l2 > 1")
    parts = pairs.withColumn("i0", F.explode(F.expr(f"sequence(1L, l2 - 1, {POSITIONS}L)"))).repartition("chain_from", "chain_to", "i0")
    return _moved_risk(parts.withColumn("i", F.explode(F.expr(f"sequence(i0, least(i0 + {POSITIONS - 1}, l2 - 1))"))))


def _chain_pairs(spark, sf_dir) -> DataFrame:
    """Ordered pairs of labels as chains with their lengths, and the risk ``h0`` of all chains."""
    c = points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("l"))
    total = c.agg(F.sum(_risk(F.col("l"))).alias("h0"))
    a, b = c.select(F.col("label").alias("chain_from"), F.col("l").alias("l1")), c.select(F.col("label").alias("chain_to"), F.col("l").alias("l2"))
    return a.join(b, F.col("chain_from") != F.col("chain_to")).crossJoin(F.broadcast(total))


def _risk(x: Column) -> Column:
    return (x - 1) * x * (x + 1) / 6


def _moved_risk(moves: DataFrame) -> DataFrame:
    i, l1, l2 = F.col("i"), F.col("l1"), F.col("l2")
    return moves.select("chain_from", "chain_to", "i", r((_risk(l2 - i) - _risk(l2) + _risk(l1 + i) - _risk(l1)) / F.col("h0")).alias("d_risk"))


FORMULA = """SELECT n, r, round(((5e-4 * 5e-4 * (l ** 3 + 3 * l ** 2 + 2 * l) / 6) * (chains - k) + (5e-4 * 5e-4 * ((l + 1) ** 3 + 3 * (l + 1) ** 2 + 2 * (l + 1)) / 6) * k) / n, 12) AS loss FROM (
SELECT n, r, chains, CAST(floor((n - 1 - forks) / chains) AS DOUBLE) AS l, (n - 1 - forks) % chains AS k FROM (
SELECT DISTINCT n, r, CASE WHEN r > 1 THEN 2 * (r - 1) ELSE 1 END AS forks, CASE WHEN r > 1 THEN 3 * (r - 1) ELSE 1 END AS chains FROM sweep WHERE r >= 1) WHERE n - 1 >= forks)"""


@query(FORMULA)
def closed_form_optimal(spark, sf_dir):
    """Loss of the best network of each size and redundancy that the sweeps have, where it has room for the forks."""
    s = table(spark, sf_dir, "sweep").select("n", "r").distinct().where("r >= 1 and n - 1 >= if(r > 1, 2 * (r - 1), 1)")
    return s.select("n", "r", r(analysis.optimal_expression(F.col("n"), F.col("r"), 5e-4), 12).alias("loss"))


# --- points ----------------------------------------------------------------------------------


@query(f"WITH {CENTERS} SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9) AS d FROM ce a JOIN ce b ON a.id < b.id")
def pairwise_distance(spark, sf_dir):
    return center_pairs(spark, sf_dir).select("a", "b", r("d").alias("d"))


@query(f"WITH {PAIRS} SELECT a, b, round(d, 9) AS d FROM nr")
def range_join_pairs(spark, sf_dir):
    return near(spark, sf_dir).select("a", "b", r("d").alias("d"))


@query(f"WITH {CENTERS} SELECT pt.id AS a, arg_min(ce.id, sqrt((pt.x - ce.x) ** 2 + (pt.y - ce.y) ** 2)) AS b, round(min(sqrt((pt.x - ce.x) ** 2 + (pt.y - ce.y) ** 2)), 9) AS d FROM pt CROSS JOIN ce GROUP BY pt.id")
def nearest_join(spark, sf_dir):
    return graphs.nearest(points(spark, sf_dir), centers(spark, sf_dir), 0.05).select("a", "b", r("d").alias("d"))


@query(f"WITH {CENTERS}, f AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM ce a CROSS JOIN ce b) SELECT a, b FROM f WHERE a < b AND d < (SELECT quantile_cont(d, 0.4) FROM f)")
def quantile_edges(spark, sf_dir):
    """Pairs closer than a quantile of the full distance matrix, zeros of its diagonal included."""
    pairs = center_pairs(spark, sf_dir).select("a", "b", "d")
    full = pairs.select("d").unionAll(pairs.select("d")).unionAll(centers(spark, sf_dir).select(F.lit(0.0).alias("d")))
    return pairs.crossJoin(F.broadcast(full.agg(F.percentile("d", 0.4).alias("q")))).where("d < q").select("a", "b")


MINIMAX = f"{CENTERS}, w0 AS (SELECT a.id AS a, b.id AS b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w FROM ce a JOIN ce b ON a.id <> b.id), " + ", ".join(
    f"w{k + 1} AS (SELECT a, b, min(w) AS w FROM (SELECT a, b, w FROM w{k} UNION ALL SELECT p.a, q.b, greatest(p.w, q.w) FROM w{k} p JOIN w{k} q ON p.b = q.a WHERE p.a <> q.b) GROUP BY a, b)" for k in range(4)
)


@query(f"WITH {MINIMAX} SELECT w0.a, w0.b, round(w0.w, 9) AS w FROM w0 JOIN w4 ON w0.a = w4.a AND w0.b = w4.b WHERE w0.a < w0.b AND w0.w <= w4.w")
def mst_weight(spark, sf_dir):
    """Minimum spanning tree of the labels' centers: the edges no detour undercuts."""
    e = center_pairs(spark, sf_dir).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("d").alias("weight"))
    return graphs.spanning_tree(e).select(F.col("u").alias("a"), F.col("v").alias("b"), r("weight").alias("w"))


@query("""WITH c AS (SELECT n_nationkey AS k, n_regionkey AS g, 1 + count(c_custkey) AS s FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), rs AS (SELECT g, 1 + sum(s) AS s FROM c GROUP BY g)
SELECT x.k AS a, y.k AS b, CAST(x.s + y.s + CASE WHEN x.g <> y.g THEN rx.s + ry.s ELSE 0 END AS BIGINT) AS benefit FROM c x JOIN c y ON x.k < y.k JOIN rs rx ON rx.g = x.g JOIN rs ry ON ry.g = y.g""")
def chord_coverage(spark, sf_dir):
    """Benefit of a chord between two nations: the sizes of the subtrees below the tree edges that it closes into a cycle."""
    sizes = tree_subtree_sizes(spark, sf_dir)
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("g")).join(sizes.where("level = 'nation'"), "id")
    n = n.select("id", "g", "size").join(sizes.where("level = 'region'").select(F.col("id").alias("g"), F.col("size").alias("rs")), "g")
    side = lambda s: n.select(F.col("id").alias(s), F.col("g").alias(f"g{s}"), F.col("size").alias(f"s{s}"), F.col("rs").alias(f"r{s}"))
    return side("a").join(side("b"), F.col("a") < F.col("b")).select("a", "b", (F.col("sa") + F.col("sb") + F.when(F.col("ga") != F.col("gb"), F.col("ra") + F.col("rb")).otherwise(0)).alias("benefit"))


@query(f"WITH {CENTERS} SELECT u.id AS u, v.id AS v, c.id AS center, round(sqrt((u.x - c.x) ** 2 + (u.y - c.y) ** 2) + sqrt((v.x - c.x) ** 2 + (v.y - c.y) ** 2), 9) AS weight FROM ce u JOIN ce v ON u.id < v.id JOIN ce c ON c.id <> u.id AND c.id <> v.id")
def trip_weights(spark, sf_dir):
    """Way from fork to fork over a chain's center; labels are few and stay so."""
    c = centers(spark, sf_dir).select(F.col("id").alias("center"), "x", "y")
    t = center_pairs(spark, sf_dir).join(c, (F.col("center") != F.col("a")) & (F.col("center") != F.col("b")))
    way = geo.distance(F.col("ax"), F.col("ay"), F.col("x"), F.col("y")) + geo.distance(F.col("bx"), F.col("by"), F.col("x"), F.col("y"))
    return t.select(F.col("a").alias("u"), F.col("b").alias("v"), "center", r(way).alias("weight"))


@query(f"WITH {POINTS}, n AS (SELECT count(*) AS n FROM pt), k AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT label FROM pt)) SELECT label, n // k + CASE WHEN i < n % k THEN 1 ELSE 0 END AS target FROM k CROSS JOIN n")
def balanced_targets(spark, sf_dir):
    """Cluster sizes that differ by one at most."""
    p = points(spark, sf_dir)
    sizes = p.groupBy("label").agg(F.count("*").alias("c"))
    every = Window.partitionBy()
    k = sizes.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("i"), F.count("*").over(every).alias("k"), F.sum("c").over(every).alias("n"))
    return k.select("label", (F.floor(F.col("n") / F.col("k")) + F.when(F.col("i") < F.col("n") % F.col("k"), 1).otherwise(0)).alias("target"))


@query(f"WITH {CENTERS} SELECT pt.id AS point, ce.id AS center, round((pt.x - ce.x) ** 2 + (pt.y - ce.y) ** 2, 9) AS d2 FROM pt CROSS JOIN ce")
def squared_distance(spark, sf_dir):
    """Every point against every center: the cost matrix of the clustering. The centers, one for each label, are broadcast; over 100,000 are an error."""
    few = F.when(F.count("*") > 100_000, F.raise_error(F.lit("too many centers")))
    held = centers(spark, sf_dir)
    held.agg(few.alias("x")).collect()
    c = held.select(F.collect_list(F.struct(F.col("id").alias("center"), F.col("x").alias("cx"), F.col("y").alias("cy"))).alias("c"))
    m = points(spark, sf_dir).crossJoin(F.broadcast(c)).select(F.col("id").alias("point"), "x", "y", F.inline("c"))
    return m.select("point", "center", r((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2).alias("d2"))


@query(f"WITH {POINTS} SELECT id, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE 0 END, 9) AS scaled FROM pt WINDOW w AS (PARTITION BY label)")
def minmax_scale(spark, sf_dir):
    p = points(spark, sf_dir)
    b = p.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return p.join(b, "label").select("id", r(F.when(F.col("hi") > F.col("lo"), (F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)).alias("scaled"))


@query("SELECT node_id, round(pos.x * pi() * 6378137 / 180, 3) AS mx, round(ln(tan(pi() / 4 + pos.y * pi() / 360)) * 6378137, 3) AS my FROM (SELECT DISTINCT node_id, pos FROM nodes) WHERE pos.x BETWEEN -180 AND 180 AND pos.y BETWEEN -85 AND 85")
def mercator(spark, sf_dir):
    n = table(spark, sf_dir, "nodes").select("node_id", F.col("pos.x").alias("x"), F.col("pos.y").alias("y")).where("x between -180 and 180 and y between -85 and 85").distinct()
    return n.select("node_id", r(geo.mercator_x(F.col("x")), 3).alias("mx"), r(geo.mercator_y(F.col("y")), 3).alias("my"))


@query(f"WITH {POINTS} SELECT id FROM pt WHERE abs(x) + abs(y) < 0.1")
def point_in_polygon(spark, sf_dir):
    """Points in a square that stands on its corner."""
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.1, 0.0), (0.0, 0.1), (-0.1, 0.0), (0.0, -0.1))])
    return points(spark, sf_dir).where(geo.in_ring(F.col("x"), F.col("y"), square)).select("id")


# --- sweeps and series -----------------------------------------------------------------------

EXPLODED = "ex AS (SELECT * FROM (SELECT sweep_id, graph_id, n, m, r, trial, unnest(p) AS p, unnest(rel) AS f FROM sweep) WHERE isfinite(p) AND isfinite(f))"


def _exploded(spark, sf_dir):
    return analysis.explode_pairs(table(spark, sf_dir, "sweep"), "sweep_id", "graph_id", "n", "m", "r", "trial")


@query(f"WITH {EXPLODED} SELECT n, m, r, p, round(avg(f), 12) AS f, count(*) AS trials FROM ex GROUP BY n, m, r, p")
def explode_mean(spark, sf_dir):
    return _exploded(spark, sf_dir).groupBy("n", "m", "r", "p").agg(r(F.avg("f"), 12).alias("f"), F.count("*").alias("trials"))


def _crossing_sql(source: str, keys: str, x: str, skip: int = 0) -> str:
    return f"""{source}, o AS (SELECT {keys}, {x} AS x, f - p AS y, row_number() OVER w AS rn, lag(CASE WHEN rn0 > {skip} THEN {x} END) OVER w AS x1, lag(CASE WHEN rn0 > {skip} THEN f - p END) OVER w AS y1
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {x}) AS rn0 FROM src) WINDOW w AS (PARTITION BY {keys} ORDER BY {x}))
SELECT {keys}, round(arg_min(CASE WHEN abs(y - y1) < 1e-15 THEN (x1 + x) / 2 ELSE x1 - y1 * (x - x1) / (y - y1) END, x), 9) AS crossing FROM o WHERE sign(y1) <> sign(y) AND rn > {skip} GROUP BY {keys}"""


@query(_crossing_sql(f"WITH {EXPLODED}, src AS (SELECT sweep_id, p, avg(f) AS f FROM ex GROUP BY sweep_id, p)", "sweep_id", "p", 1))
def find_pc(spark, sf_dir):
    """Where F crosses p along p, for each sweep; the first row is left out."""
    rows = _exploded(spark, sf_dir).groupBy("sweep_id", "p").agg(F.avg("f").alias("f")).withColumn("p1", F.col("p"))
    return analysis.crossing(rows, ["sweep_id"], "p1", "f", "p", skip=1).select("sweep_id", r("crossing").alias("crossing"))


SERIES = "WITH sr AS (SELECT graph_id, p, r, avg(saidi) AS f FROM (SELECT DISTINCT * FROM series) WHERE isfinite(p) AND isfinite(saidi) AND saidi >= 0 GROUP BY graph_id, p, r), src AS (SELECT graph_id, p AS pk, p, CAST(r AS DOUBLE) AS r, f FROM sr)"


def _clean_series(spark, sf_dir):
    """Measured rows of ``series``, repeats once. What the queries do not use is held as a digest, so that little is shuffled."""
    s = table(spark, sf_dir, "series")
    used = ["row_id", "graph_id", "r", "p", "t", "saidi"]
    rest = F.xxhash64(*[c for c in s.columns if c not in used]).alias("rest")
    return s.where(analysis.finite("p", "saidi") & (F.col("saidi") >= 0)).select(*used, rest).distinct().drop("rest")


@query(_crossing_sql(SERIES, "graph_id, pk", "r"))
def find_rc(spark, sf_dir):
    """Where F crosses p along the redundancy, for each graph and p."""
    rows = _clean_series(spark, sf_dir).groupBy("graph_id", "p", "r").agg(F.avg("saidi").alias("f")).select("graph_id", F.col("p").alias("pk"), "p", F.col("r").cast("double").alias("r"), "f")
    return analysis.crossing(rows, ["graph_id", "pk"], "r", "f", "p").select("graph_id", "pk", r("crossing").alias("crossing"))


@query(_crossing_sql(f"WITH {EXPLODED}, src AS (SELECT r, round(p, 3) AS pk, CAST(n AS DOUBLE) AS n, avg(p) AS p, avg(f) AS f FROM ex GROUP BY r, round(p, 3), n)", "r, pk", "n").replace("9) AS crossing", "6) AS crossing"))
def find_nc(spark, sf_dir):
    """Where F crosses p along the size, for each redundancy and p to three digits."""
    rows = _exploded(spark, sf_dir).groupBy("r", r("p", 3).alias("pk"), F.col("n").cast("double").alias("n")).agg(F.avg("p").alias("p"), F.avg("f").alias("f"))
    return analysis.crossing(rows, ["r", "pk"], "n", "f", "p").select("r", "pk", r("crossing", 6).alias("crossing"))


@query(f"WITH {EXPLODED} SELECT graph_id, round(sum(f) / sum(p * p), 4) AS b2, count(*) AS n_rows FROM ex GROUP BY graph_id")
def ratio_fit(spark, sf_dir):
    return analysis.ratio_fit(_exploded(spark, sf_dir), ["graph_id"]).select("graph_id", r("b2", 4).alias("b2"), "n_rows")


@query(f"WITH {EXPLODED}, b AS (SELECT n, sum(p * p) / sum(f) AS pc FROM ex GROUP BY n HAVING sum(f) > 0) SELECT round(exp(avg(ln(pc) + 2 * ln(n))), 6) AS c, count(*) AS sizes FROM b")
def geo_mean_fit(spark, sf_dir):
    b = analysis.ratio_fit(_exploded(spark, sf_dir), ["n"]).where("b2 > 0")
    return b.agg(r(F.exp(F.avg(F.log("pc") + 2 * F.log("n"))), 6).alias("c"), F.count("*").alias("sizes"))


@query(f"""WITH {EXPLODED}, o AS (SELECT r, n, p, f, row_number() OVER (PARTITION BY r, n ORDER BY p, f) AS k FROM ex), g AS (SELECT r, n, 1 / avg(f / (p * p)) AS pc, 1.0 / (n * n) AS pred FROM o WHERE k > 5 AND p > 0 GROUP BY r, n HAVING avg(f / (p * p)) > 0)
SELECT r, n, round(pc, 9) AS pc, round(pred * avg(pc / pred) OVER (PARTITION BY r), 9) AS fitted FROM g""")
def pc_group_fit(spark, sf_dir):
    """Critical p per redundancy and size without the five lowest p, and the power law scaled to it."""
    o = _exploded(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("r", "n").orderBy("p", "f")))
    mean = F.avg(F.col("f") / (F.col("p") * F.col("p")))
    g = o.where("k > 5 and p > 0").groupBy("r", "n").agg(mean.alias("mean")).where("mean > 0").select("r", "n", (1 / F.col("mean")).alias("pc"), (F.lit(1.0) / (F.col("n") * F.col("n"))).alias("pred"))
    scale = g.groupBy("r").agg(F.avg(F.col("pc") / F.col("pred")).alias("scale"))
    return g.join(scale, "r").select("r", "n", r("pc").alias("pc"), r(F.col("pred") * F.col("scale")).alias("fitted"))


@query("WITH s AS (SELECT DISTINCT * FROM series) SELECT row_id, rank() OVER w + (count(*) OVER (PARTITION BY graph_id, saidi) - 1) / 2.0 AS avg_rank FROM s WHERE isfinite(saidi) AND saidi >= 0 AND isfinite(p) WINDOW w AS (PARTITION BY graph_id ORDER BY saidi)")
def avg_rank(spark, sf_dir):
    s = _clean_series(spark, sf_dir).select("row_id", "graph_id", "saidi")
    return analysis.average_rank(s, "graph_id", "saidi").select("row_id", "avg_rank")


@query("WITH s AS (SELECT DISTINCT * FROM series WHERE isfinite(saidi) AND isfinite(p) AND saidi >= 0) SELECT graph_id, r, p, arg_max(saidi, row(t, row_id)) AS last_saidi, max(t) AS t FROM s GROUP BY graph_id, r, p")
def last_per_group(spark, sf_dir):
    s = _clean_series(spark, sf_dir)
    return s.groupBy("graph_id", "r", "p").agg(F.max_by("saidi", F.struct("t", "row_id")).alias("last_saidi"), F.max("t").alias("t"))


@query("""WITH v AS (SELECT graph_id, r, p, t, avg(saidi) AS v FROM (SELECT DISTINCT * FROM series) WHERE isfinite(saidi) AND isfinite(p) AND saidi >= 0 AND t >= 0 GROUP BY graph_id, r, p, t),
z AS (SELECT graph_id, r, p, t, v FROM v WHERE t > 0 UNION ALL SELECT DISTINCT graph_id, r, p, 0, 0 FROM v),
s AS (SELECT *, lead(t) OVER w AS t2, lead(v) OVER w AS v2, max(t) OVER (PARTITION BY graph_id, r, p) AS t_end FROM z WINDOW w AS (PARTITION BY graph_id, r, p ORDER BY t)),
g AS (SELECT graph_id, r, p, unnest(range(0, CAST(ceil(t_end / 30) AS BIGINT) + 1)) * 30.0 AS tt FROM (SELECT DISTINCT graph_id, r, p, t_end FROM s))
SELECT g.graph_id, g.r, g.p, CAST(tt AS DOUBLE) AS t, round(CASE WHEN t2 IS NULL THEN v ELSE v + (tt - s.t) / (t2 - s.t) * (v2 - v) END, 12) AS value
FROM g JOIN s ON s.graph_id = g.graph_id AND s.r = g.r AND s.p = g.p AND tt >= s.t AND (t2 IS NULL OR tt < t2)""")
def resample_grid(spark, sf_dir):
    """Each graph's index every 30 days, for each redundancy and p."""
    s = _clean_series(spark, sf_dir).where("t >= 0").select("graph_id", "r", "p", "t", F.col("saidi").alias("value"))
    return analysis.resample(s, ["graph_id", "r", "p"], 30.0).select("graph_id", "r", "p", "t", r("value", 12).alias("value"))


@query("SELECT sweep_id, round(1 - r / m, 9) AS r_gain, round(1 - (n - 1) / m, 9) AS tree_gain FROM (SELECT DISTINCT sweep_id, n, m, r FROM sweep) WHERE m > 0")
def ratio_columns(spark, sf_dir):
    s = table(spark, sf_dir, "sweep").select("sweep_id", "n", "m", "r").distinct().where("m > 0")
    return s.select("sweep_id", r(1 - F.col("r") / F.col("m")).alias("r_gain"), r(1 - (F.col("n") - 1) / F.col("m")).alias("tree_gain"))


# --- renewal processes -------------------------------------------------------------------------

STEP = "st AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS down, epoch_us(ts) / 1e6 AS t0, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1e6 AS t1 FROM events)"


def _renewal(spark, sf_dir):
    return analysis.renewal(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query(f"WITH {STEP} SELECT user_id, round(sum(down * (t1 - t0)) / sum(t1 - t0), 9) AS loss FROM st WHERE t1 IS NOT NULL GROUP BY user_id HAVING sum(t1 - t0) > 0")
def renewal_loss(spark, sf_dir):
    s = _renewal(spark, sf_dir).where("t1 is not null").groupBy("user_id").agg(F.sum(F.col("down") * (F.col("t1") - F.col("t0"))).alias("d"), F.sum(F.col("t1") - F.col("t0")).alias("t"))
    return s.where("t > 0").select("user_id", r(F.col("d") / F.col("t")).alias("loss"))


@query(f"WITH {STEP}, c AS (SELECT user_id, event_id, sum(down * (t1 - t0)) OVER w AS lost, t1 - min(t0) OVER (PARTITION BY user_id) AS t FROM st WHERE t1 IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY t0, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, round(CASE WHEN t > 0 THEN lost / t ELSE 0 END, 6) AS mean_loss FROM c")
def renewal_cumulative(spark, sf_dir):
    """Running share of time that a user was down, at the end of each step."""
    s = _renewal(spark, sf_dir).where("t1 is not null")
    w = Window.partitionBy("user_id").orderBy("t0", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    c = s.select("user_id", "event_id", F.sum(F.col("down") * (F.col("t1") - F.col("t0"))).over(w).alias("lost"), (F.col("t1") - F.min("t0").over(Window.partitionBy("user_id"))).alias("t"))
    return c.select("user_id", "event_id", r(F.when(F.col("t") > 0, F.col("lost") / F.col("t")).otherwise(0.0), 6).alias("mean_loss"))


@query(f"WITH {STEP}, c AS (SELECT user_id, down, lag(down) OVER (PARTITION BY user_id ORDER BY t0, event_id) AS before FROM st) SELECT user_id, count(*) FILTER (WHERE before IS NULL OR before <> down) AS changes FROM c GROUP BY user_id")
def renewal_changes(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("t0", "event_id")
    c = _renewal(spark, sf_dir).withColumn("before", F.lag("down").over(w))
    return c.groupBy("user_id").agg(F.count_if(F.col("before").isNull() | (F.col("before") != F.col("down"))).alias("changes"))


@query("""WITH k AS (SELECT n_nationkey AS edge, CAST(k AS BIGINT) AS k, 1e-3 * (1 + n_nationkey % 5) AS p FROM nation CROSS JOIN range(1, 41) t(k)),
d AS (SELECT edge, k, -ln(1 - ((edge * 7919 + k * 104729 + 12345) % 1000003 + 0.5) / 1000003) * CASE WHEN k % 2 = 1 THEN 0.5 / p ELSE 0.5 / (1 - p) END AS dt FROM k)
SELECT edge, k, round(sum(dt) OVER (PARTITION BY edge ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS t, k % 2 = 0 AS up FROM d""")
def simulate_events_lcg(spark, sf_dir):
    """Alternating up and down times of each edge, exponential by inversion of an arithmetic generator."""
    e = ring(spark, sf_dir).select(F.col("node").cast("bigint").alias("edge"), "p", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(40).cast("bigint"))).alias("k"))
    u = ((F.col("edge") * 7919 + F.col("k") * 104729 + 12345) % 1000003 + 0.5) / 1000003
    dt = -F.log(1 - u) * F.when(F.col("k") % 2 == 1, 0.5 / F.col("p")).otherwise(0.5 / (1 - F.col("p")))
    w = Window.partitionBy("edge").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return e.withColumn("dt", dt).select("edge", "k", r(F.sum("dt").over(w), 6).alias("t"), (F.col("k") % 2 == 0).alias("up"))


# --- algebra -----------------------------------------------------------------------------------


def _polys(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", F.array(F.lit(1.0), F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).alias("a"), F.array(F.col("n_regionkey").cast("double"), F.lit(-2.0)).alias("b"))


@query("""WITH a AS (SELECT n_nationkey, 1.0 AS a0, n_nationkey AS a1, n_regionkey AS a2, n_regionkey AS b0, -2.0 AS b1 FROM nation) SELECT n_nationkey, CAST(power AS BIGINT) AS power, CAST(CASE power WHEN 0 THEN a0 * b0 WHEN 1 THEN a0 * b1 + a1 * b0 WHEN 2 THEN a1 * b1 + a2 * b0 ELSE a2 * b1 END AS DOUBLE) AS coef FROM a CROSS JOIN range(4) t(power)""")
def poly_mul(spark, sf_dir):
    m = _polys(spark, sf_dir).select("n_nationkey", F.posexplode(prob.poly_mul(F.col("a"), F.col("b"))).alias("power", "coef"))
    return m.select("n_nationkey", F.col("power").cast("bigint").alias("power"), "coef")


@query("SELECT n_nationkey, round(1 + n_nationkey * 1e-2 + n_regionkey * 1e-2 * 1e-2, 9) AS value FROM nation")
def poly_eval(spark, sf_dir):
    return _polys(spark, sf_dir).select("n_nationkey", r(prob.poly_eval(F.col("a"), F.lit(1e-2))).alias("value"))


@query("SELECT n_nationkey, CAST(i AS BIGINT) AS i, CAST(CASE i WHEN 0 THEN 1 WHEN 1 THEN 2 + n_nationkey ELSE 1 + n_nationkey + n_regionkey END AS DOUBLE) AS coef FROM nation CROSS JOIN range(3) t(i)")
def poly_to_binom(spark, sf_dir):
    b = _polys(spark, sf_dir).select("n_nationkey", F.posexplode(prob.poly_to_binom(F.col("a"))).alias("i", "coef"))
    return b.select("n_nationkey", F.col("i").cast("bigint").alias("i"), "coef")


def _edge_partitions(spark, sf_dir) -> DataFrame:
    """Every edge of each region as a partition table: its two ends linked, or nothing."""
    _, e = region_edges(spark, sf_dir)
    mask = F.expr("shiftleft(1L, int(u)) | shiftleft(1L, int(v))")
    both = F.array(F.struct(F.array(mask).alias("part"), (1 - F.col("prob")).alias("q")), F.struct(F.array().cast("array<bigint>").alias("part"), F.col("prob").alias("q")))
    return cut(e.select("graph_id", F.col("edge_id").alias("k"), F.inline(both)))


def _whole_product(spark, sf_dir) -> DataFrame:
    """The partitions of each region's whole graph, one edge after the other."""
    t = _edge_partitions(spark, sf_dir)
    whole = t.where("k = 0").select("graph_id", "part", "q")
    for k in range(1, (t.agg(F.max("k")).first()[0] or 0) + 1):
        following = t.where(F.col("k") == k).select("graph_id", F.col("part").alias("p2"), F.col("q").alias("q2"))
        none = F.array().cast("array<bigint>")
        merged = whole.join(following, "graph_id", "left").select("graph_id", prob.blocks_merge(F.col("part"), F.coalesce("p2", none)).alias("part"), (F.col("q") * F.coalesce("q2", F.lit(1.0))).alias("q"))
        whole = merged.groupBy("graph_id", "part").agg(F.sum("q").alias("q"))
    return cut(whole)


PARTITIONS = f"""WITH {STATES} b AS (SELECT DISTINCT g, state, mask FROM m4 WHERE bit_count(mask) > 1), n AS (SELECT g, 1 | (1 << max(i)) AS ends FROM idx GROUP BY g),
pa AS (SELECT s.g, s.state, coalesce(string_agg(CAST(mask AS VARCHAR), ',' ORDER BY mask), '') AS part, coalesce(bool_or(mask & ends = ends), false) AS linked, any_value(ends) AS ends FROM s JOIN n USING (g) LEFT JOIN b ON b.g = s.g AND b.state = s.state GROUP BY s.g, s.state)"""


@query(f"{PARTITIONS} SELECT g AS graph_id, part, round(sum(prob), 9) AS q FROM pa JOIN pr USING (g, state) GROUP BY g, part")
def partition_product(spark, sf_dir):
    """The partitions of all nations of a region by all its edges."""
    return _whole_product(spark, sf_dir).select("graph_id", F.array_join(F.col("part").cast("array<string>"), ",").alias("part"), r("q").alias("q"))


@query(f"{PARTITIONS} SELECT g AS graph_id, CASE WHEN linked THEN CAST(ends AS VARCHAR) ELSE '' END AS part, round(sum(prob), 9) AS q FROM pa JOIN pr USING (g, state) GROUP BY 1, 2")
def partition_project(spark, sf_dir):
    """The whole graph's partitions cut down to its first and last node."""
    nodes, _ = region_edges(spark, sf_dir)
    ends = nodes.groupBy("graph_id").agg(F.expr("1L | shiftleft(1L, int(max(node)))").alias("ends"))
    both = _whole_product(spark, sf_dir).join(ends, "graph_id").select("graph_id", prob.blocks_project(F.col("part"), F.col("ends")).alias("part"), "q")
    return both.groupBy("graph_id", "part").agg(F.sum("q").alias("q")).select("graph_id", F.array_join(F.col("part").cast("array<string>"), ",").alias("part"), r("q").alias("q"))


# --- cells, text, unions, streams ----------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("""WITH v AS (SELECT p_partkey, p_retailprice AS x, floor(log10(p_retailprice)) AS e FROM part WHERE p_retailprice > 0), d AS (SELECT p_partkey, e, round(x / 10 ** e, 1) AS m FROM v)
SELECT p_partkey, CASE WHEN m >= 10 THEN '1.0e' || CAST(CAST(e + 1 AS BIGINT) AS VARCHAR) ELSE printf('%.1f', m) || 'e' || CAST(CAST(e AS BIGINT) AS VARCHAR) END AS price FROM d""")
def string_format_scientific(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_retailprice > 0").select("p_partkey", geo.scientific(F.col("p_retailprice")).alias("price"))


@query("""SELECT 'capacitor' AS kind, cap_id AS id, graph_id, trim(code) AS code, trim(feeder) AS feeder, size_kvar, CAST(NULL AS DOUBLE) AS tap_pu FROM (SELECT DISTINCT * FROM capacitors)
UNION ALL SELECT 'regulator', reg_id, graph_id, trim(code), trim(feeder), NULL, tap_pu FROM (SELECT DISTINCT * FROM voltage_regulators)""")
def union_networks(spark, sf_dir):
    """Equipment of two kinds as one table; padding removed, missing columns null."""
    tidy = lambda df, kind, key, *more: df.distinct().select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "graph_id", F.trim("code").alias("code"), F.trim("feeder").alias("feeder"), *more)
    return tidy(table(spark, sf_dir, "capacitors"), "capacitor", "cap_id", "size_kvar").unionByName(tidy(table(spark, sf_dir, "voltage_regulators"), "regulator", "reg_id", "tap_pu"), allowMissingColumns=True)


@query("SELECT CAST(user_id AS BIGINT) AS user_id, round(sum(CASE WHEN down = 1 THEN t1 - t0 ELSE 0 END), 5) AS lost FROM (SELECT user_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS down, epoch_us(ts) / 1e6 AS t0, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), epoch_us(ts)) / 1e6 AS t1 FROM events) GROUP BY user_id")
def stream_down_time(spark, sf_dir):
    """Down time per user kept up as streaming state; the last row of each user counts."""
    out = windows.run_once(windows.down_time(windows.arrivals(spark, sf_dir)), "update")
    return out.groupBy("user_id").agg(r(F.max_by("lost", F.struct("t", "batch")), 5).alias("lost"))


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    """Daily windows kept up as streaming state; the last version of each window counts."""
    out = windows.run_once(windows.tumbling_counts(windows.arrivals(spark, sf_dir)), "update")
    last = out.groupBy(F.col("window.start").cast("timestamp_ntz").alias("day"), "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("s"))
    return last.select("day", "event_type", "s.n", r("s.total", 6).alias("total"))


# --- simulation and design -----------------------------------------------------------------------

HORIZON, CYCLE = 365.0, 0.5


def _lcg(graph: str) -> str:
    return f"((({graph}) * 15485863 + eid * 7919 + k * 104729 + 12345) % 1000003 + 0.5) / 1000003"


#: steps of the simulated regions: t0, t1 and the state between them, all edges up at the start
STEPS_OF_STATES = f"""{STATES} ev AS (SELECT g, eid, sum(-ln({_lcg('g')}) * CASE WHEN k % 2 = 1 THEN {CYCLE} / p ELSE {CYCLE} / (1 - p) END) OVER (PARTITION BY g, eid ORDER BY k ROWS UNBOUNDED PRECEDING) AS t FROM e CROSS JOIN range(1, 300) r(k)),
ate AS (SELECT g, t, eid, CAST(1 << eid AS BIGINT) AS bit FROM ev WHERE t < {HORIZON} UNION ALL SELECT DISTINCT g, 0, -1, 0 FROM idx),
sp AS (SELECT g, t AS t0, lead(t, 1, {HORIZON}) OVER w AS t1, xor(1023, bit_xor(bit) OVER w) AS state FROM ate WINDOW w AS (PARTITION BY g ORDER BY t, eid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ws AS (SELECT m4.g, state, sum(CASE WHEN i > 0 AND (mask >> i) & 1 = 0 THEN nk + 1.0 ELSE 0 END) / sum(CASE WHEN i > 0 THEN nk + 1.0 ELSE 0 END) AS lost FROM m4 JOIN idx ON idx.g = m4.g WHERE st = 0 GROUP BY m4.g, state),
wp AS (SELECT g, state, 1 - sum(bit_count(mask) - 1) / 2 / 10 AS lost FROM m4 GROUP BY g, state)"""


def _simulated(spark, sf_dir, measure):
    nodes, edges = region_edges(spark, sf_dir)
    return simulation.simulate(nodes.select("graph_id", "node", "weight"), edges, HORIZON, CYCLE, measure, draw=simulation.arithmetic)


def _mean(steps: DataFrame) -> DataFrame:
    return simulation.mean_loss(steps).select("graph_id", r("loss").alias("loss"), "changes")


@query(f"WITH {STEPS_OF_STATES} SELECT g AS graph_id, round(sum(lost * (t1 - t0)) / sum(t1 - t0), 9) AS loss, count(*) AS changes FROM sp JOIN ws USING (g, state) GROUP BY g")
def sim_saidi(spark, sf_dir):
    """Simulated share of weight cut off over a year, per region."""
    return _mean(_simulated(spark, sf_dir, "saidi"))


@query(f"WITH {STEPS_OF_STATES} SELECT g AS graph_id, round(sum(lost * (t1 - t0)) / sum(t1 - t0), 9) AS loss, count(*) AS changes FROM sp JOIN wp USING (g, state) GROUP BY g")
def sim_pairwise(spark, sf_dir):
    return _mean(_simulated(spark, sf_dir, "pairwise"))


@query(f"WITH {STEPS_OF_STATES} SELECT g AS graph_id, round(t1, 6) AS t, round(sum(lost * (t1 - t0)) OVER (PARTITION BY g ORDER BY t0 ROWS UNBOUNDED PRECEDING) / t1, 9) AS value FROM sp JOIN ws USING (g, state)")
def sim_cumulative(spark, sf_dir):
    return simulation.cumulative(_simulated(spark, sf_dir, "saidi")).select("graph_id", r("t", 6).alias("t"), r("value").alias("value"))


REPAIR, STEP, P_SWEEP = 2.0, 5.0, [0.02, 0.1]


@query(f"""WITH {STATES} pg AS (SELECT unnest({P_SWEEP}) AS pp, unnest([0, 1]) AS pi),
ev AS (SELECT g, pp, eid, sum(-ln({_lcg('g * 2 + pi')}) * CASE WHEN k % 2 = 1 THEN {REPAIR} * (1 - pp) / pp ELSE {REPAIR} END) OVER (PARTITION BY g, pp, eid ORDER BY k ROWS UNBOUNDED PRECEDING) AS t FROM e CROSS JOIN pg CROSS JOIN range(1, 300) r(k)),
ate AS (SELECT g, pp, t, eid, CAST(1 << eid AS BIGINT) AS bit FROM ev WHERE t < {HORIZON} UNION ALL SELECT DISTINCT g, pp, 0, -1, 0 FROM idx CROSS JOIN pg),
sp AS (SELECT g, pp, t AS t0, lead(t, 1, {HORIZON}) OVER w AS t1, xor(1023, bit_xor(bit) OVER w) AS state FROM ate WINDOW w AS (PARTITION BY g, pp ORDER BY t, eid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ws AS (SELECT g, state, (5 - bit_count(mask)) / 4 AS lost FROM m4 WHERE st = 0)
SELECT g AS graph_id, pp AS p, n * {STEP} AS t, lost AS saidi FROM sp JOIN ws USING (g, state) JOIN range(0, 73) q(n) ON n * {STEP} >= t0 AND n * {STEP} < t1""")
def sim_sampled(spark, sf_dir):
    """The share of nodes cut off every five days of a year, for two probabilities."""
    nodes, edges = region_edges(spark, sf_dir)
    return simulation.sampled(nodes, edges, P_SWEEP, REPAIR, HORIZON, STEP, draw=simulation.arithmetic)
