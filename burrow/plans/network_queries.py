"""Graph operators and route efficiency."""

from __future__ import annotations

from pyspark.sql import functions as F

from burrow.operators import graph as GR
from burrow.operators import paths as P
from burrow.operators.efficiency import route_scores
from burrow.plans.frame_queries import rounded
from burrow.plans.path_queries import ERROR, PURCHASE, _error_to_purchase, _gappy, _KEPT, paths_sql
from burrow.plans.registry import query
from burrow.plans.standins import frames, table
from burrow.session import materialise

def g0():
    """Name of the one graph of a query."""
    return F.lit("g")


# -- topologies; one maze per nation, its size from the nation's keys -------------

@query("g1_binary_tree", """
WITH s AS (SELECT c_custkey AS k, 2 + c_custkey % 4 AS h FROM customer),
spots AS (SELECT k, h, l, i FROM s, range(0, 6) a(l), range(0, 32) b(i) WHERE l < h AND i < 2 ** l)
SELECT 'm' || k AS graph_id, CAST(CAST(l - 1 || '' || i // 2 AS BIGINT) AS VARCHAR) AS u, CAST(CAST(l || '' || i AS BIGINT) AS VARCHAR) AS v, CAST(1.0 AS DOUBLE) AS weight
FROM spots WHERE l > 0""")
def g1_binary_tree(spark, sf_dir):
    k = F.col("c_custkey")
    specs = table(spark, sf_dir, "customer").select(F.concat(F.lit("m"), k).alias("graph_id"), (2 + k % 4).cast("int").alias("height"))
    return GR.binary_tree(specs)[1]


@query("g1_dual_root_tree", """
WITH s AS (SELECT s_suppkey AS k, side, CASE side WHEN 'L' THEN 1 + s_suppkey % 4 ELSE 1 + s_nationkey % 3 END AS h FROM supplier, (VALUES ('L'), ('R')) t(side)),
spots AS (SELECT k, side, l, i FROM s, range(0, 5) a(l), range(0, 16) b(i) WHERE l < h AND i < 2 ** l)
SELECT 'm' || k AS graph_id, CASE WHEN l = 0 THEN side || '0' ELSE side || l || i END AS node_id, CAST(l AS INTEGER) AS level,
  CASE side WHEN 'L' THEN 'left' ELSE 'right' END AS tree FROM spots""")
def g1_dual_root_tree(spark, sf_dir):
    specs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), "s_suppkey").alias("graph_id"),
        (1 + F.col("s_suppkey") % 4).cast("int").alias("left_height"),
        (1 + F.col("s_nationkey") % 3).cast("int").alias("right_height"),
    )
    return GR.dual_root_tree(specs)[0].withColumn("level", F.col("level").cast("int"))


@query("g1_star", """
WITH s AS (SELECT s_suppkey AS k, 3 + s_suppkey % 5 AS n, s_nationkey % 2 = 0 AS ring FROM supplier),
e AS (SELECT k, 0 AS a, i AS b FROM s, range(1, 8) r(i) WHERE i <= n UNION
      SELECT k, i, CASE WHEN i < n THEN i + 1 ELSE 1 END FROM s, range(1, 8) r(i) WHERE i <= n AND ring)
SELECT 'm' || k AS graph_id, CAST(least(a, b) AS VARCHAR) AS u, CAST(greatest(a, b) AS VARCHAR) AS v FROM e""")
def g1_star(spark, sf_dir):
    specs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), "s_suppkey").alias("graph_id"),
        (3 + F.col("s_suppkey") % 5).alias("n"),
        (F.col("s_nationkey") % 2 == 0).alias("ring"),
    )
    return GR.star(specs)[1].drop("weight")


@query("g1_complete_graph", """
WITH s AS (SELECT s_suppkey AS k, 2 + s_suppkey % 7 AS n FROM supplier)
SELECT 'm' || k AS graph_id, CAST(i AS VARCHAR) AS u, CAST(j AS VARCHAR) AS v FROM s, range(0, 9) a(i), range(0, 9) b(j) WHERE i < j AND j < n""")
def g1_complete_graph(spark, sf_dir):
    specs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), "s_suppkey").alias("graph_id"), (2 + F.col("s_suppkey") % 7).alias("n")
    )
    return GR.complete_graph(specs)[1].drop("weight")


@query("g2_grid", """
WITH s AS (SELECT s_suppkey AS k, 2 + s_suppkey % 4 AS nr, 2 + s_nationkey % 5 AS nc, CASE WHEN s_suppkey % 3 = 0 THEN 8 ELSE 4 END AS con, s_suppkey % 2 = 0 AS per FROM supplier),
p AS (SELECT * FROM s, range(0, 5) a(r), range(0, 6) b(c) WHERE r < nr AND c < nc),
e AS (SELECT a.k, a.r AS r1, a.c AS c1, b.r AS r2, b.c AS c2 FROM p a JOIN p b ON b.k = a.k AND (a.r, a.c) < (b.r, b.c)
  AND CASE WHEN a.per AND a.nr > 2 THEN least(abs(a.r - b.r), a.nr - abs(a.r - b.r)) ELSE abs(a.r - b.r) END
    + CASE WHEN a.per AND a.nc > 2 THEN least(abs(a.c - b.c), a.nc - abs(a.c - b.c)) ELSE abs(a.c - b.c) END = 1
  UNION
  SELECT a.k, a.r, a.c, b.r, b.c FROM p a JOIN p b ON b.k = a.k AND (a.r, a.c) < (b.r, b.c) AND a.con = 8
  AND CASE WHEN a.per THEN least(abs(a.r - b.r), a.nr - abs(a.r - b.r)) ELSE abs(a.r - b.r) END = 1
  AND CASE WHEN a.per THEN least(abs(a.c - b.c), a.nc - abs(a.c - b.c)) ELSE abs(a.c - b.c) END = 1)
SELECT 'm' || k AS graph_id, r1 || ',' || c1 AS u, r2 || ',' || c2 AS v FROM e""")
def g2_grid(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    specs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), k).alias("graph_id"),
        (2 + k % 4).alias("rows"),
        (2 + n % 5).cast("bigint").alias("cols"),
        F.when(k % 3 == 0, 8).otherwise(4).alias("connectivity"),
        (k % 2 == 0).alias("periodic"),
    )
    return GR.grid_graph(specs)[1].drop("weight")


@query("g2_hierarchy", """
WITH s AS (SELECT s_suppkey AS k, [2 + s_suppkey % 3, 1 + s_suppkey % 6, 5 + s_nationkey % 4] AS z, CASE WHEN s_suppkey % 2 = 0 THEN 2 END AS b FROM supplier),
e AS (SELECT k, l, p, c FROM s, range(1, 3) a(l), range(0, 8) q(p), range(0, 9) d(c)
  WHERE p < z[l] AND c < z[l + 1] AND CASE WHEN b IS NULL THEN c >= CAST(floor(p * (z[l + 1] / z[l])) AS BIGINT) AND c < CAST(floor((p + 1) * (z[l + 1] / z[l])) AS BIGINT)
    ELSE c // b = p END)
SELECT 'm' || k AS graph_id, 'L' || (l - 1) || 'N' || p AS u, 'L' || l || 'N' || c AS v FROM e""")
def g2_hierarchy(spark, sf_dir):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    sizes = F.array((2 + k % 3).cast("int"), (1 + k % 6).cast("int"), (5 + n % 4).cast("int"))
    specs = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), k).alias("graph_id"), sizes.alias("sizes"), F.when(k % 2 == 0, 2).alias("branching")
    )
    return GR.hierarchy(specs)[1].drop("weight")


@query("g2_adjacency_matrix", """
WITH m AS (SELECT vec_id AS k, i, j, round(embedding[8 * i + j + 1], 1) AS w FROM embeddings, range(0, 8) a(i), range(0, 8) b(j))
SELECT 'm' || k AS graph_id, CAST(least(i, j) AS VARCHAR) AS u, CAST(greatest(i, j) AS VARCHAR) AS v FROM m WHERE w <> 0 GROUP BY ALL""")
def g2_adjacency_matrix(spark, sf_dir):
    cell = F.transform("embedding", lambda v: F.round(v.cast("double"), 1))
    rows = F.array(*[F.slice(cell, 8 * i + 1, 8) for i in range(8)])
    specs = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), "vec_id").alias("graph_id"), rows.alias("matrix"))
    return GR.from_adjacency(specs)[1].drop("weight")


# -- graphs in the tables -------------------------------------------------------

_TRADE = """links AS (
  SELECT 'R' || n_regionkey AS u, 'N' || n_nationkey AS v, CAST(1.0 + n_nationkey AS DOUBLE) AS weight FROM nation
  UNION ALL SELECT 'N' || s_nationkey, 'S' || s_suppkey, abs(s_acctbal) FROM supplier
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, abs(c_acctbal) FROM customer),
arcs AS (SELECT u, v, weight FROM links UNION ALL SELECT v, u, weight FROM links),
points AS (SELECT u AS node_id FROM arcs UNION SELECT v FROM arcs)"""


def trade(spark, sf_dir):
    """Regions, nations, suppliers and customers as a forest, a tree per region."""

    def named(prefix, key):
        return F.concat(F.lit(prefix), F.col(key))

    parts = [
        table(spark, sf_dir, "nation").select(
            named("R", "n_regionkey").alias("u"), named("N", "n_nationkey").alias("v"), (1.0 + F.col("n_nationkey")).alias("weight")
        ),
        table(spark, sf_dir, "supplier").select(
            named("N", "s_nationkey").alias("u"), named("S", "s_suppkey").alias("v"), F.abs("s_acctbal").alias("weight")
        ),
        table(spark, sf_dir, "customer").select(
            named("N", "c_nationkey").alias("u"), named("C", "c_custkey").alias("v"), F.abs("c_acctbal").alias("weight")
        ),
    ]
    edges = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return edges.select(g0().alias("graph_id"), "u", "v", "weight")


_SALES = """sales AS (SELECT 'S' || l_suppkey AS u, 'P' || l_partkey AS v, min(l_extendedprice) AS weight FROM lineitem GROUP BY 1, 2),
sarcs AS (SELECT u, v, weight FROM sales UNION ALL SELECT v, u, weight FROM sales)"""


def sales(spark, sf_dir):
    """Suppliers and the parts they sold, weighted by the lowest price."""
    # Numbers are grouped and named afterwards: a name is three times as long in a shuffle.
    sold = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.min("l_extendedprice").alias("weight"))
    return sold.select(
        g0().alias("graph_id"), F.concat(F.lit("S"), "l_suppkey").alias("u"), F.concat(F.lit("P"), "l_partkey").alias("v"), "weight"
    )


def trade_nodes(spark, sf_dir):
    return GR.from_edge_list(trade(spark, sf_dir))[0]


@query("g2_edge_list", f"WITH {_TRADE} SELECT least(u, v) AS u, greatest(u, v) AS v, round(weight, 6) AS weight FROM links")
def g2_edge_list(spark, sf_dir):
    return rounded(GR.from_edge_list(trade(spark, sf_dir))[1].drop("graph_id"), 6, "weight")


@query("g3_counts", f"WITH {_TRADE} SELECT (SELECT count(*) FROM points) AS num_nodes, (SELECT count(*) FROM links) AS num_edges")
def g3_counts(spark, sf_dir):
    return GR.counts(trade_nodes(spark, sf_dir), trade(spark, sf_dir)).drop("graph_id")


@query("g3_degrees", f"WITH {_SALES} SELECT u AS node_id, count(*) AS degree FROM sarcs GROUP BY u")
def g3_degrees(spark, sf_dir):
    edges = sales(spark, sf_dir)
    nodes = GR.both_ways(edges).select("graph_id", F.col("u").alias("node_id")).distinct()
    return GR.degrees(nodes, edges).drop("graph_id")


@query("g3_neighbours", f"WITH {_TRADE} SELECT u AS node_id, v AS neighbour FROM arcs WHERE u IN (SELECT 'N' || n_nationkey FROM nation)")
def g3_neighbours(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(g0().alias("graph_id"), F.concat(F.lit("N"), "n_nationkey").alias("node_id"))
    return GR.neighbours(wanted, trade(spark, sf_dir)).drop("graph_id")


@query("g3_membership", f"""WITH {_TRADE}, asked AS (SELECT 'C' || o_custkey AS v, 'N' || o_orderkey % 25 AS u, 'C' || o_orderkey AS node_id FROM orders)
SELECT a.node_id, a.u, a.v, p.node_id IS NOT NULL AS has_node, l.u IS NOT NULL AS has_edge
FROM asked a LEFT JOIN points p ON p.node_id = a.node_id LEFT JOIN links l ON l.u = a.u AND l.v = a.v""")
def g3_membership(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(
        g0().alias("graph_id"),
        F.concat(F.lit("C"), "o_custkey").alias("v"),
        F.concat(F.lit("N"), F.col("o_orderkey") % 25).alias("u"),
        F.concat(F.lit("C"), "o_orderkey").alias("node_id"),
    )
    edges = trade(spark, sf_dir)
    with_nodes = GR.has_nodes(asked, GR.from_edge_list(edges)[0]).withColumnRenamed("present", "has_node")
    # Asked the other way round: an edge has no direction.
    turned = with_nodes.withColumns({"u": F.col("v"), "v": F.col("u")})
    found = GR.has_edges(turned, edges).withColumnRenamed("present", "has_edge")
    return found.select("node_id", F.col("v").alias("u"), F.col("u").alias("v"), "has_node", "has_edge")


@query("g3_node_data", "SELECT 'C' || c_custkey AS node_id, c_mktsegment AS segment, c_acctbal AS balance FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def g3_node_data(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(
        g0().alias("graph_id"), F.concat(F.lit("C"), "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(g0().alias("graph_id"), F.concat(F.lit("C"), "o_custkey").alias("node_id"))
    return nodes.join(wanted.distinct(), ["graph_id", "node_id"], "left_semi").drop("graph_id")


@query("g3_subgraph", f"""WITH {_SALES}, chosen AS (SELECT 'S' || s_suppkey AS n FROM supplier WHERE s_acctbal > 0 UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_size > 20)
SELECT u, v FROM sales WHERE u IN (SELECT n FROM chosen) AND v IN (SELECT n FROM chosen)""")
def g3_subgraph(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("S"), "s_suppkey").alias("node_id"))
    large = table(spark, sf_dir, "part").where("p_size > 20").select(F.concat(F.lit("P"), "p_partkey").alias("node_id"))
    chosen = rich.unionByName(large).withColumn("graph_id", g0())
    return GR.subgraph(chosen, sales(spark, sf_dir)).select("u", "v")


# Breadth first with the distances of all revisits, cut off past the farthest node.
_BFS = """bfs(node, distance) AS (
  SELECT 'S0', 0 UNION SELECT a.v, b.distance + 1 FROM bfs b JOIN sarcs a ON a.u = b.node WHERE b.distance < 6),
near AS (SELECT node, min(distance) AS distance FROM bfs GROUP BY node)"""


@query("g4_shortest_paths", f"""WITH RECURSIVE {_SALES}, {_BFS}
SELECT n.node, CAST(n.distance AS INTEGER) AS distance, (SELECT min(a.u) FROM sarcs a JOIN near m ON m.node = a.u WHERE a.v = n.node AND m.distance = n.distance - 1) AS parent FROM near n""")
def g4_shortest_paths(spark, sf_dir):
    return GR.shortest_paths(sales(spark, sf_dir), _from_s0(spark)).select("node", "distance", "parent")


def _from_s0(spark):
    return spark.range(1).select(g0().alias("graph_id"), F.lit("S0").alias("source"))


@query("g4_shortest_paths_from_all_regions", f"""WITH RECURSIVE {_TRADE}, way(source, node, distance, parent) AS (
  SELECT 'R' || r_regionkey, 'R' || r_regionkey, 0, CAST(NULL AS VARCHAR) FROM region
  UNION ALL SELECT w.source, a.v, w.distance + 1, w.node FROM way w JOIN arcs a ON a.u = w.node AND a.v IS DISTINCT FROM w.parent)
SELECT source, node, CAST(distance AS INTEGER) AS distance, parent FROM way""")
def g4_shortest_paths_from_all_regions(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(g0().alias("graph_id"), F.concat(F.lit("R"), "r_regionkey").alias("source"))
    return GR.shortest_paths(trade(spark, sf_dir), roots).drop("graph_id")


@query("g4_weighted_paths", f"""WITH RECURSIVE {_TRADE}, way(source, node, distance, parent) AS (
  SELECT 'R' || r_regionkey, 'R' || r_regionkey, CAST(0 AS DOUBLE), CAST(NULL AS VARCHAR) FROM region
  UNION ALL SELECT w.source, a.v, w.distance + a.weight, w.node FROM way w JOIN arcs a ON a.u = w.node AND a.v IS DISTINCT FROM w.parent)
SELECT source, node, round(distance, 4) AS distance, parent FROM way""")
def g4_weighted_paths(spark, sf_dir):
    roots = table(spark, sf_dir, "region").select(g0().alias("graph_id"), F.concat(F.lit("R"), "r_regionkey").alias("source"))
    return rounded(GR.weighted_paths(trade(spark, sf_dir), roots).drop("graph_id"), 4, "distance")


@query("g4_path_length", f"""WITH RECURSIVE {_SALES}, {_BFS}
SELECT 'P' || p_partkey AS target, coalesce(CAST(distance AS DOUBLE), CAST('inf' AS DOUBLE)) AS length FROM part LEFT JOIN near ON node = 'P' || p_partkey""")
def g4_path_length(spark, sf_dir):
    reached = GR.shortest_paths(sales(spark, sf_dir), _from_s0(spark))
    pairs = table(spark, sf_dir, "part").select(g0().alias("graph_id"), F.lit("S0").alias("source"), F.concat(F.lit("P"), "p_partkey").alias("target"))
    return GR.path_lengths(pairs, reached).select("target", "length")


@query("g4_shortest_path_nodes", f"""WITH RECURSIVE {_TRADE}, way(node, path, parent) AS (
  SELECT 'R0', 'R0', CAST(NULL AS VARCHAR) UNION ALL SELECT a.v, w.path || '>' || a.v, w.node FROM way w JOIN arcs a ON a.u = w.node AND a.v IS DISTINCT FROM w.parent)
SELECT node AS target, path FROM way WHERE node IN (SELECT 'C' || c_custkey FROM customer)""")
def g4_shortest_path_nodes(spark, sf_dir):
    root = spark.range(1).select(g0().alias("graph_id"), F.lit("R0").alias("source"))
    reached = GR.shortest_paths(trade(spark, sf_dir), root)
    pairs = table(spark, sf_dir, "customer").select(g0().alias("graph_id"), F.lit("R0").alias("source"), F.concat(F.lit("C"), "c_custkey").alias("target"))
    return GR.path_nodes(pairs, reached).select("target", F.array_join("path", ">").alias("path"))


@query("g4_all_shortest_paths", f"""WITH RECURSIVE {_SALES}, {_BFS}, way(node, path, distance) AS (
  SELECT 'S0', 'S0', 0 UNION ALL SELECT a.v, w.path || '>' || a.v, w.distance + 1 FROM way w JOIN sarcs a ON a.u = w.node JOIN near n ON n.node = a.v AND n.distance = w.distance + 1)
SELECT node AS target, count(*) AS paths, min(path) AS first_path FROM way GROUP BY node""")
def g4_all_shortest_paths(spark, sf_dir):
    edges = materialise(sales(spark, sf_dir).select("graph_id", "u", "v"), "sales")
    reached = GR.shortest_paths(edges, _from_s0(spark), simple=True)
    pairs = reached.select("graph_id", "source", F.col("node").alias("target"))
    every = GR.path_nodes(pairs, reached, edges).select("target", F.array_join("path", ">").alias("path"))
    return every.groupBy("target").agg(F.count("*").alias("paths"), F.min("path").alias("first_path"))


@query("g5_components", f"""WITH {_TRADE}, home AS (
  SELECT 'R' || r_regionkey AS node_id, r_regionkey AS r FROM region UNION ALL SELECT 'N' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'S' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey
  UNION ALL SELECT 'C' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT h.node_id, min(h.node_id) OVER (PARTITION BY r) AS component FROM home h""")
def g5_components(spark, sf_dir):
    edges = trade(spark, sf_dir)
    return GR.components(GR.from_edge_list(edges)[0], edges).drop("graph_id")


@query("g5_component_groups", """WITH p AS (SELECT 'P' || p_partkey AS a, p_brand || p_size AS b FROM part),
l AS (SELECT a, b, least(min(a) OVER (PARTITION BY b), b) AS component FROM p)
SELECT a AS node_id, component FROM l UNION SELECT b, component FROM l""")
def g5_component_groups(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(
        g0().alias("graph_id"), F.concat(F.lit("P"), "p_partkey").alias("u"), F.concat("p_brand", "p_size").alias("v")
    )
    return GR.components(GR.from_edge_list(edges)[0], edges).drop("graph_id")


@query("g5_is_connected", """SELECT 'brand' || p_size AS graph_id, count(DISTINCT p_brand) = 1 AS connected FROM part GROUP BY 1""")
def g5_is_connected(spark, sf_dir):
    edges = table(spark, sf_dir, "part").select(
        F.concat(F.lit("brand"), "p_size").alias("graph_id"), F.concat(F.lit("P"), "p_partkey").alias("u"), F.col("p_brand").alias("v")
    )
    return GR.is_connected(GR.components(GR.from_edge_list(edges)[0], edges))


@query("g6_edge_by_id", f"""WITH {_TRADE} SELECT 'e' || v AS edge_id, u, v FROM links WHERE v IN (SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def g6_edge_by_id(spark, sf_dir):
    edges = trade(spark, sf_dir).withColumn("edge_id", F.concat(F.lit("e"), "v"))
    wanted = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(g0().alias("graph_id"), F.concat(F.lit("eC"), "o_custkey").alias("edge_id"))
    return GR.edges_by_id(wanted, edges).select("edge_id", "u", "v")


# -- walks and their statistics ---------------------------------------------------

def _walk_starts(spark, sf_dir):
    """A walk per customer, from its nation."""
    return table(spark, sf_dir, "customer").select(
        g0().alias("graph_id"),
        F.col("c_custkey").alias("walk_id"),
        F.concat(F.lit("N"), "c_nationkey").alias("start"),
        F.concat(F.lit("C"), (F.col("c_custkey") + 1).cast("string")).alias("target"),
    )


@query("g8_sampled_walks")
def g8_sampled_walks(spark, sf_dir):
    walks = GR.sampled_walks(trade(spark, sf_dir), _walk_starts(spark, sf_dir), 12, backtrack=-1, seed=42)
    return GR.walk_rows(walks).drop("graph_id")


@query("g8_walk_rules", "SELECT count(*) AS walks, CAST(0 AS BIGINT) AS not_an_edge, CAST(0 AS BIGINT) AS stepped_back, true AS all_leave FROM customer")
def g8_walk_rules(spark, sf_dir):
    """Rules every walk must keep: steps are edges, and none goes straight back unless it must."""
    edges = trade(spark, sf_dir)
    walks = GR.sampled_walks(edges, _walk_starts(spark, sf_dir), 6, seed=7)
    steps = walks.select(
        "walk_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("path") - 1),
                lambda i: F.struct(
                    F.col("path")[i - 1].alias("u"), F.col("path")[i].alias("v"), F.when(i > 1, F.col("path")[F.greatest(i - 2, F.lit(0))]).alias("w")
                ),
            )
        ).alias("s"),
    ).select("walk_id", "s.*")
    arcs = GR.both_ways(edges).select("u", "v", F.lit(1).alias("known")).distinct()
    ends = arcs.groupBy("u").agg(F.count("*").alias("arcs"))
    checked = steps.join(arcs, ["u", "v"], "left").join(ends, "u", "left")
    return checked.agg(
        F.count_distinct("walk_id").alias("walks"),
        F.count_if(F.col("known").isNull()).alias("not_an_edge"),
        F.count_if((F.col("v") == F.col("w")) & (F.col("arcs") > 1)).alias("stepped_back"),
        F.lit(True).alias("all_leave"),
    )


_STATS = f"""{_KEPT},
seqs AS (SELECT session_id, path_id, count(*) - 1 AS length, max_by(v, frame_number) = 3 AS success FROM runs WHERE pv IS NULL OR pv <> v GROUP BY ALL)"""


def _observed(spark, sf_dir):
    """Lengths of the observed paths, in changes of node."""
    steps = P.sequence_in_path(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node")
    return steps.groupBy("session_id", "path_id").agg(
        (F.count("*") - 1).alias("length"), (F.max_by("value", "pos") == 3).alias("success")
    )


@query("g9_walk_statistics", paths_sql(ERROR, PURCHASE, """
SELECT session_id, CAST(count(*) AS BIGINT) AS walks, round(avg(length), 6) AS mean_length, quantile_cont(length, 0.5) AS median_length, round(stddev_pop(length), 6) AS std_length,
  min(length) AS min_length, max(length) AS max_length, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM seqs GROUP BY session_id""", extra=_STATS))
def g9_walk_statistics(spark, sf_dir):
    return rounded(
        GR.walk_statistics(_observed(spark, sf_dir), ["session_id"]), 6, "mean_length", "std_length", "success_rate"
    )


@query("g7_walk_efficiency", paths_sql(ERROR, PURCHASE, """
SELECT session_id, round(CASE WHEN avg(length) > 0 THEN 3 / avg(length) ELSE 0.0 END, 6) AS efficiency FROM seqs GROUP BY session_id""", extra=_STATS))
def g7_walk_efficiency(spark, sf_dir):
    stats = GR.walk_statistics(_observed(spark, sf_dir), ["session_id"])
    shortest = stats.select("session_id", F.lit(len(_route(spark, sf_dir)) - 1).alias("shortest_length"))
    out = GR.walk_efficiency(stats, shortest, ["session_id"])
    return rounded(out.select("session_id", "efficiency"), 6, "efficiency")


# -- every shortest path of a directed, weighted graph: regions to order priorities -

_SUPPLY = """supply AS (
  SELECT 'R' || n_regionkey AS u, 'N' || n_nationkey AS v, 1.0 AS weight FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey, 1.0 + c_custkey % 3 FROM customer
  UNION ALL SELECT 'C' || o_custkey, 'B' || left(o_orderpriority, 1), min(1.0 + o_orderkey % 4) FROM orders GROUP BY 1, 2),
ways AS (SELECT a.u AS source, c.v AS target, [a.u, b.u, c.u, c.v] AS path, a.weight + b.weight + c.weight AS length
  FROM supply a JOIN supply b ON b.u = a.v JOIN supply c ON c.u = b.v),
least AS (SELECT source, target, min(length) AS length FROM ways GROUP BY ALL)"""


def _supply(spark, sf_dir):
    nations, customers, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))

    def name(letter, column):
        return F.concat(F.lit(letter), column)

    first = nations.select(name("R", "n_regionkey").alias("u"), name("N", "n_nationkey").alias("v"), F.lit(1.0).alias("weight"))
    second = customers.select(name("N", "c_nationkey"), name("C", "c_custkey"), 1.0 + F.col("c_custkey") % 3)
    third = orders.select(name("C", "o_custkey"), name("B", F.substring("o_orderpriority", 1, 1)), 1.0 + F.col("o_orderkey") % 4)
    edges = first.union(second).union(third).groupBy("u", "v").agg(F.min("weight").alias("weight"))
    edges = edges.select(g0().alias("graph_id"), "u", "v", "weight")
    sources = table(spark, sf_dir, "region").select(g0().alias("graph_id"), name("R", "r_regionkey").alias("source"))
    ends = orders.select(g0().alias("graph_id"), name("B", F.substring("o_orderpriority", 1, 1)).alias("target")).distinct()
    return edges, sources, sources.join(ends, "graph_id")


def _listed(paths):
    return paths.select("source", "target", F.array_join("path", ">").alias("path"))


@query("g4_all_weighted_paths", f"""WITH {_SUPPLY}
SELECT source, target, array_to_string(path, '>') AS path FROM ways JOIN least USING (source, target, length)""")
def g4_all_weighted_paths(spark, sf_dir):
    edges, sources, pairs = _supply(spark, sf_dir)
    reached = GR.weighted_paths(edges, sources, directed=True)
    return _listed(GR.all_shortest_paths(pairs, reached, edges, "weight", directed=True))


@query("g4_all_directed_paths", f"WITH {_SUPPLY} SELECT source, target, array_to_string(path, '>') AS path FROM ways")
def g4_all_directed_paths(spark, sf_dir):
    edges, sources, pairs = _supply(spark, sf_dir)
    reached = GR.shortest_paths(edges, sources, directed=True)
    return _listed(GR.all_shortest_paths(pairs, reached, edges, directed=True))


@query("g4_weighted_path_counts", f"""WITH {_SUPPLY}
SELECT source, target, CAST(count(*) AS BIGINT) AS paths FROM ways JOIN least USING (source, target, length) GROUP BY ALL""")
def g4_weighted_path_counts(spark, sf_dir):
    edges, sources, pairs = _supply(spark, sf_dir)
    reached = GR.weighted_paths(edges, sources, directed=True)
    counts = GR.shortest_path_counts(reached, edges, "weight", directed=True).withColumnRenamed("node", "target")
    asked = pairs.join(counts, ["graph_id", "source", "target"])
    return asked.select("source", "target", F.col("paths").cast("bigint").alias("paths"))


# -- route efficiency: nodes 0 to 9 in a row, route from 0 to 3 --------------------

def _route(spark, sf_dir) -> list[int]:
    n = F.col("n_nationkey") % 10
    row = table(spark, sf_dir, "nation").where(n < 9).select(
        g0().alias("graph_id"), n.cast("string").alias("u"), (n + 1).cast("string").alias("v")
    )
    source = spark.range(1).select(g0().alias("graph_id"), F.lit("0").alias("source"))
    pair = source.withColumn("target", F.lit("3"))
    reached = GR.shortest_paths(row.distinct(), source, until=pair)
    # One shortest path of a maze: a handful of nodes.
    return [int(n) for n in GR.path_nodes(pair, reached).first().path]


def _fold(strikes: int) -> str:
    off = "f.progress < 3 AND s.value <> f.progress + 1"
    free = f"({off} AND f.run < {strikes})"
    reset = f"({off} AND NOT f.run < {strikes} AND {strikes} > 0)"
    return f"""{_KEPT},
seq AS (SELECT session_id, path_id, v AS value, row_number() OVER (PARTITION BY session_id, path_id ORDER BY frame_number) AS pos FROM runs WHERE pv IS NULL OR pv <> v),
fold(session_id, path_id, pos, progress, run, deviations, used) AS (
  SELECT session_id, path_id, CAST(0 AS BIGINT), 0, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM paths
  UNION ALL
  SELECT f.session_id, f.path_id, s.pos,
    CASE WHEN f.progress < 3 AND s.value = f.progress + 1 THEN f.progress + 1 WHEN {reset} AND s.value <= 3 THEN CAST(s.value AS INTEGER) ELSE f.progress END,
    CASE WHEN {free} THEN f.run + 1 WHEN f.progress < 3 AND s.value = f.progress + 1 OR {reset} THEN 0 ELSE f.run END,
    f.deviations + CASE WHEN {off} THEN 1 ELSE 0 END, f.used + CASE WHEN {free} THEN 1 ELSE 0 END
  FROM fold f JOIN seq s ON s.session_id = f.session_id AND s.path_id = f.path_id AND s.pos = f.pos + 1),
scores AS (SELECT *, greatest(pos - 1, 0) AS actual FROM (SELECT *, row_number() OVER (PARTITION BY session_id, path_id ORDER BY pos DESC) AS rk FROM fold) WHERE rk = 1)"""


_SCORES = """SELECT session_id, path_id, progress, deviations, used AS strikes_used, progress = 3 AS completed, CAST(3 AS INTEGER) AS optimal_length,
  actual AS actual_length, round(CASE WHEN actual > 0 THEN 3 / actual * 100 ELSE 0.0 END, 6) AS efficiency FROM scores"""


@query("p8_shortest_path_efficiency", paths_sql(ERROR, PURCHASE, _SCORES, extra=_fold(0)))
def p8_shortest_path_efficiency(spark, sf_dir):
    scores = route_scores(_gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", _route(spark, sf_dir))
    return rounded(scores, 6, "efficiency")


@query("p8_efficiency_with_strikes", paths_sql(ERROR, PURCHASE, _SCORES, extra=_fold(2)))
def p8_efficiency_with_strikes(spark, sf_dir):
    scores = route_scores(
        _gappy(spark, sf_dir), _error_to_purchase(spark, sf_dir), "node", _route(spark, sf_dir), strike_levels=[1], max_strikes=2
    )
    return rounded(scores, 6, "efficiency")
