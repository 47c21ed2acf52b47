import heapq
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from burrow.operators import graph as GR
from burrow.operators import metrics as M
from burrow.operators import paths as P
from burrow.operators.efficiency import route_scores
from tests.test_paths import frames_of, table, whole

EDGES = "graph_id string, u string, v string, weight double"


def random_edges(rng, graphs=3, n=14, m=20):
    rows = set()
    for g in range(graphs):
        for _ in range(m):
            u, v = sorted(rng.sample(range(n), 2))
            rows.add((f"g{g}", f"n{u}", f"n{v}", float(1 + (u * 7 + v) % 5)))
    return sorted(rows)


def adjacency(rows):
    out = defaultdict(dict)
    for g, u, v, w in rows:
        out[g, u][v] = w
        out[g, v][u] = w
    return out


def lengths(adj, g, source, weighted=False):
    best, heap = {}, [(0.0, source)]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in adj[g, u].items():
            heapq.heappush(heap, (d + (w if weighted else 1.0), v))
    return best


@pytest.mark.parametrize("target", [4, 10_000])
def test_paths_and_components_on_random_graphs(spark, target):
    rows = random_edges(random.Random(11))
    adj = adjacency(rows)
    edges = table(spark, EDGES, rows)
    sources = table(spark, "graph_id string, source string", [(f"g{g}", f"n{s}") for g in range(3) for s in (0, 5)])
    reached = GR.shortest_paths(edges, sources, target=target)
    got = {(r.graph_id, r.source, r.node): r for r in reached.collect()}
    heavy = {(r.graph_id, r.source, r.node): r for r in GR.weighted_paths(edges, sources, target=target).collect()}
    for weighted, found in ((False, got), (True, heavy)):
        want = {
            (g, s, v): d
            for g in ("g0", "g1", "g2")
            for s in ("n0", "n5")
            for v, d in lengths(adj, g, s, weighted).items()
        }
        assert {k: float(r.distance) for k, r in found.items()} == want
        for (g, s, v), r in found.items():
            if v != s:
                step = adj[g, v][r.parent] if weighted else 1.0
                assert want[g, s, r.parent] + step == want[g, s, v]
                better = [u for u in adj[g, v] if want[g, s, u] + (adj[g, v][u] if weighted else 1.0) == want[g, s, v]]
                assert r.parent == min(better)
    nodes, _ = GR.from_edge_list(edges)
    for r in GR.components(nodes, edges).collect():
        assert r.component == min(lengths(adj, r.graph_id, r.node_id))


def test_long_chain_is_one_component(spark):
    n = 200
    edges = spark.range(n - 1).select(
        F.lit("g").alias("graph_id"), F.format_string("%04d", "id").alias("u"), F.format_string("%04d", F.col("id") + 1).alias("v")
    )
    labels = GR.components(GR.from_edge_list(edges)[0], edges)
    assert labels.where("component = '0000'").count() == n
    assert GR.is_connected(labels).first().connected


@pytest.mark.parametrize("order", ("far", "shuffled"))
def test_components_take_few_rounds(spark, order, monkeypatch):
    n = 1024
    ids = list(range(n))
    ids.reverse() if order == "far" else random.Random(3).shuffle(ids)
    edges = table(spark, EDGES, [("g", f"{a:04}", f"{b:04}", 1.0) for a, b in zip(ids, ids[1:])])
    written = []
    kept = GR.stars.materialise
    monkeypatch.setattr(GR.stars, "materialise", lambda df, label: written.append(label) or kept(df, label))
    labels = GR.components(GR.from_edge_list(edges)[0], edges)
    assert labels.where("component = '0000'").count() == n
    assert written.count("links") <= 2 * 15


def test_all_shortest_paths(spark):
    rows = [("g", *e, 1.0) for e in [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "y")]]
    edges = table(spark, EDGES, rows)
    reached = GR.shortest_paths(edges, table(spark, "graph_id string, source string", [("g", "a")]))
    pairs = table(spark, "graph_id string, source string, target string", [("g", "a", "e"), ("g", "a", "y"), ("g", "a", "a")])
    one = {r.target: r.path for r in GR.path_nodes(pairs, reached).collect()}
    assert one == {"e": list("abde"), "a": ["a"]}
    both = sorted(r.path for r in GR.path_nodes(pairs, reached, edges).collect() if r.target == "e")
    assert both == [list("abde"), list("acde")]
    assert {r.target: r.length for r in GR.path_lengths(pairs, reached).collect()} == {"e": 3.0, "y": float("inf"), "a": 0.0}


def test_listed_paths_are_written_as_beginnings_only(spark, monkeypatch):
    """Layers of three nodes, each linked to all of the next: 3 to the power of the distance paths."""
    layers = [["s"], *[[f"{i}{c}" for c in "abc"] for i in range(4)], ["t"], ["far"]]
    edges = table(spark, EDGES, [("g", u, v, 1.0) for a, b in zip(layers, layers[1:]) for u in a for v in b])
    reached = GR.shortest_paths(edges, table(spark, "graph_id string, source string", [("g", "s")]))
    pairs = table(spark, "graph_id string, source string, target string", [("g", "s", n) for n in ("t", "2b", "s", "none")])
    sizes = []
    kept = GR.materialise

    def counted(df, label):
        out = kept(df, label)
        if label == "paths":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(GR, "materialise", counted)
    got = {}
    for r in GR.path_nodes(pairs, reached, edges).collect():
        got.setdefault(r.target, []).append("".join(r.path))
    ways = ["s" + "".join(w) for w in itertools.product(*layers[1:5])]
    assert sorted(got["t"]) == sorted(w + "t" for w in ways)
    assert sorted(got["2b"]) == sorted("s" + "".join(w) + "2b" for w in itertools.product(*layers[1:3]))
    assert got["s"] == ["s"] and set(got) == {"t", "2b", "s"}
    assert sizes == [1, 3, 9, 27, 81]


@pytest.mark.parametrize("sent", (0, GR.BROADCAST_ROWS))
def test_edges_are_stored_once_and_few_nodes_go_to_them(spark, monkeypatch, sent):
    monkeypatch.setattr(GR, "BROADCAST_ROWS", sent)
    pairs = [("a", "b"), ("c", "a"), ("b", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("x", "y")]
    odd = [("d", "d"), ("b", "a"), ("a", "b"), ("e", "d")]
    stored, kept = {}, GR.materialise

    def counted(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        out = kept(df, label)
        stored.setdefault(label, []).append((out.count(), plan))
        return out

    monkeypatch.setattr(GR, "materialise", counted)
    start = table(spark, "graph_id string, source string", [("g", "a")])
    for simple, given in ((True, pairs), (False, pairs + odd)):
        stored.clear()
        edges = table(spark, EDGES, [("g", *e, 1.0) for e in given])
        reached = GR.shortest_paths(edges, start, simple=simple)
        assert {r.node: (r.distance, r.parent) for r in reached.collect()} == {
            "a": (0, None), "b": (1, "a"), "c": (1, "a"), "d": (2, "b"), "e": (3, "d"), "f": (4, "e")
        }
        asked = table(spark, "graph_id string, source string, target string", [("g", "a", n) for n in "dfy"])
        paths = sorted("".join(r.path) for r in GR.path_nodes(asked, reached, edges).collect())
        assert paths == ["abd", "abdef", "acd", "acdef"]
        assert stored["arcs"][0][0] == len(set(given)) and ("Exchange" in stored["arcs"][0][1]) != simple
        assert stored["links"][0][0] == 6


def simple_shortest(arcs, source, target):
    """Every simple path of least weight, by looking at all simple paths."""
    best, found = None, []

    def walk(node, path, length):
        nonlocal best, found
        if best is not None and length > best:
            return
        if node == target:
            if best is None or length < best:
                best, found = length, []
            found.append(path)
            return
        for v, w in arcs.get(node, {}).items():
            if v not in path:
                walk(v, [*path, v], length + w)

    walk(source, [source], 0.0)
    return sorted(found)


@pytest.mark.parametrize("directed, weight, target", [(True, "weight", 2_000_000), (False, "weight", 2), (True, None, 2), (False, None, 2_000_000)])
def test_every_shortest_path_equals_brute_force(spark, directed, weight, target):
    rng = random.Random(31)
    rows = [("g", *map(str, rng.sample(range(9), 2)), float(rng.choice([1, 2]))) for _ in range(36)]
    rows += [(g, u, v, w + 1) for g, u, v, w in rows[:4]] + [("g", "x", "y", 1.0)]  # heavier parallel edges, a part of its own
    arcs = defaultdict(dict)
    for _, u, v, w in rows:
        for a, b in ((u, v),) if directed else ((u, v), (v, u)):
            arcs[a][b] = min(arcs[a].get(b, 9.0), w) if weight else 1.0
    edges = table(spark, EDGES, rows)
    sources = table(spark, "graph_id string, source string", [("g", "0"), ("g", "1")])
    pairs = table(spark, "graph_id string, source string, target string", [("g", s, t) for s in "01" for t in "012345678y"])
    reached = GR.weighted_paths(edges, sources, directed=directed) if weight else GR.shortest_paths(edges, sources, directed=directed)
    got = defaultdict(list)
    for r in GR.all_shortest_paths(pairs, reached, edges, weight, directed, target).collect():
        got[r.source, r.target].append(r.path)
    counts = {(r.source, r.node): int(r.paths) for r in GR.shortest_path_counts(reached, edges, weight, directed, target).collect()}
    for s in "01":
        for t in "012345678y":
            want = simple_shortest(arcs, s, t)
            assert sorted(got[s, t]) == want and counts.get((s, t), 0) == len(want), (s, t)
    assert max(map(len, got.values())) > 1


def test_paths_over_edges_of_weight_zero_are_simple(spark):
    rows = [("g", "a", "b", 0.0), ("g", "b", "c", 0.0), ("g", "a", "c", 0.0), ("g", "c", "d", 1.0), ("g", "b", "d", 1.0)]
    edges = table(spark, EDGES, rows)
    reached = GR.weighted_paths(edges, table(spark, "graph_id string, source string", [("g", "a")]))
    pairs = table(spark, "graph_id string, source string, target string", [("g", "a", "d"), ("g", "a", "a")])
    found = sorted("".join(r.path) for r in GR.all_shortest_paths(pairs, reached, edges, "weight").collect())
    assert found == ["a", "abcd", "abd", "acbd", "acd"]
    with pytest.raises(ValueError):
        GR.shortest_path_counts(reached, edges, "weight")


def test_search_ends_at_its_targets(spark):
    edges = table(spark, EDGES, [("g", str(i), str(i + 1), 1.0) for i in range(8)])
    source = table(spark, "graph_id string, source string", [("g", "0")])
    pairs = table(spark, "graph_id string, source string, target string", [("g", "0", "2"), ("g", "0", "3"), ("g", "0", "0")])
    near = GR.shortest_paths(edges, source, until=pairs)
    assert {r.node: r.distance for r in near.collect()} == {str(i): i for i in range(4)}
    far = pairs.selectExpr("graph_id", "source", "'none' as target")
    assert GR.shortest_paths(edges, source, until=far).count() == 9


def test_directed_paths(spark):
    rows = [("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "c", "a", 5.0)]
    edges = table(spark, EDGES, rows)
    source = table(spark, "graph_id string, source string", [("g", "c")])
    assert {r.node: r.distance for r in GR.shortest_paths(edges, source, directed=True).collect()} == {"c": 0, "a": 1, "b": 2}
    assert {r.node: r.distance for r in GR.weighted_paths(edges, source, directed=True).collect()} == {"c": 0.0, "a": 5.0, "b": 6.0}


def size(pair):
    return tuple(GR.counts(*pair).select("num_nodes", "num_edges").first())


def test_topology_counts(spark):
    dual = table(spark, "graph_id string, left_height int, right_height int", [(f"{a},{b}", a, b) for a, b in [(3, 3), (4, 2), (1, 1), (1, 5)]])
    got = {r.graph_id: (r.num_nodes, r.num_edges) for r in GR.counts(*GR.dual_root_tree(dual)).collect()}
    assert got == {"3,3": (14, 13), "4,2": (18, 17), "1,1": (2, 1), "1,5": (32, 31)}
    tree = GR.binary_tree(table(spark, "graph_id string, height int", [("t", 7)]))
    assert size(tree) == (127, 126)
    assert {r.node_id for r in tree[0].where("level <= 2").collect()} == {"0", "10", "11", "20", "21", "22", "23"}
    assert size(GR.star(table(spark, "graph_id string, n int, ring boolean", [("s", 8, True)]))) == (9, 16)
    assert size(GR.complete_graph(table(spark, "graph_id string, n int", [("k", 8)]))) == (8, 28)
    grid = "graph_id string, rows int, cols int, connectivity int, periodic boolean"
    assert size(GR.grid_graph(table(spark, grid, [("g", 4, 5, 4, False)]))) == (20, 31)
    assert size(GR.grid_graph(table(spark, grid, [("g", 4, 5, 4, True)]))) == (20, 40)
    assert size(GR.grid_graph(table(spark, grid, [("g", 4, 5, 8, False)]))) == (20, 55)


def test_ranges_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(GR, "BLOCK", 7)
    rows = GR._counted(table(spark, "n bigint", [(0,), (1,), (7,), (20,)]), F.col("n"), "i").collect()
    assert Counter(r.n for r in rows) == {1: 1, 7: 7, 20: 20}
    assert sorted(r.i for r in rows if r.n == 20) == list(range(20))


def test_matrix_must_be_square(spark):
    bad = table(spark, "graph_id string, matrix array<array<double>>", [("g", [[0.0, 1.0]])])
    with pytest.raises(Exception):
        GR.from_adjacency(bad)[1].collect()
    good = table(spark, "graph_id string, matrix array<array<double>>", [("g", [[0.0, 2.0], [2.0, 0.0]])])
    assert [(r.u, r.v, r.weight) for r in GR.from_adjacency(good)[1].collect()] == [("0", "1", 2.0)]


def test_degree_of_loops_and_lone_nodes(spark):
    nodes = table(spark, "graph_id string, node_id string", [("g", "a"), ("g", "b"), ("g", "c")])
    edges = table(spark, EDGES, [("g", "a", "a", 1.0), ("g", "a", "b", 1.0)])
    assert {r.node_id: r.degree for r in GR.degrees(nodes, edges).collect()} == {"a": 3, "b": 1, "c": 0}


STARTS = "graph_id string, walk_id bigint, start string, target string"


@pytest.mark.parametrize("backtrack, small", [(-1, True), (0.0, True), (0.3, True), (1.0, True), (0.0, False)])
def test_walks_follow_the_rules(spark, backtrack, small):
    steps = 12 if small else 4
    rows = [("g", *e) for e in [("a", "b", 1.0), ("a", "c", 3.0), ("b", "c", 1.0), ("c", "d", 2.0), ("d", "e", 1.0)]]
    adj = adjacency(rows)
    starts = table(spark, STARTS, [("g", i, "a", "e" if i % 2 else None) for i in range(60)] + [("g", 99, "nowhere", None)])
    args = {} if small else {"broadcast_rows": 0, "target_rows": 10}
    walks = GR.sampled_walks(table(spark, EDGES, rows), starts, steps, backtrack=backtrack, weighted=True, seed=5, **args)
    got = {r.walk_id: r.path for r in walks.collect()}
    assert len(got) == 61 and got.pop(99) == ["nowhere"]
    for i, path in got.items():
        assert all(v in adj["g", u] for u, v in zip(path, path[1:]))
        assert len(path) == steps + 1 or (i % 2 and path[-1] == "e")
        if i % 2:
            assert "e" not in path[:-1]
        for a, b, c in zip(path, path[1:], path[2:]):
            if backtrack == 0.0:
                assert c != a or len(adj["g", b]) == 1
            if backtrack == 1.0:
                assert c == a
    again = GR.sampled_walks(table(spark, EDGES, rows).repartition(3), starts.repartition(5), steps, backtrack=backtrack, weighted=True, seed=5)
    assert {r.walk_id: r.path for r in again.where("walk_id <> 99").collect()} == got


def test_walk_steps_follow_the_weights(spark):
    rows = [("g", "hub", f"t{i}", float(w)) for i, w in enumerate((1, 2, 5, 2))]
    starts = spark.range(4000).select(F.lit("g").alias("graph_id"), F.col("id").alias("walk_id"), F.lit("hub").alias("start"))
    for weighted, want in ((True, [0.1, 0.2, 0.5, 0.2]), (False, [0.25] * 4)):
        walks = GR.sampled_walks(table(spark, EDGES, rows), starts, 1, weighted=weighted, seed=1)
        ends = Counter(r[0] for r in walks.select(F.element_at("path", -1)).collect())
        for i, share in enumerate(want):
            assert ends[f"t{i}"] / 4000 == pytest.approx(share, abs=0.04)


def test_walk_arguments(spark):
    edges = table(spark, EDGES, [("g", "a", "b", 1.0)])
    starts = table(spark, STARTS, [("g", 1, "a", None)])
    for args in ({"max_steps": 3, "backtrack": 1.5}, {"max_steps": None}):
        with pytest.raises(ValueError):
            GR.sampled_walks(edges, starts, **args)


def test_walk_statistics(spark):
    walks = table(spark, "graph_id string, walk_id bigint, path array<string>", [("g", i, ["a"] * (n + 1)) for i, n in enumerate((2, 4, 4, 8))])
    r = GR.walk_statistics(GR.lengths_of(walks, F.lit("a")), ["graph_id"]).first()
    assert (r.mean_length, r.median_length, r.min_length, r.max_length, r.success_rate) == (4.5, 4.0, 2, 8, 1.0)
    assert r.std_length == pytest.approx(2.179449, abs=1e-6)


def fold(seq, route, strikes):
    progress = deviations = used = run = 0
    for v in seq:
        if progress >= len(route) - 1:
            continue
        if v == route[progress + 1]:
            progress, run = progress + 1, 0
            continue
        deviations += 1
        if strikes:
            if run < strikes:
                run, used = run + 1, used + 1
            else:
                progress, run = (route.index(v) if v in route else progress), 0
    return progress, deviations, used


def test_route_golden(spark):
    for nodes, want in (([0, 1, 3], (2, 1, True, 100.0)), ([0, 2, 1, 3], (2, 2, True, 200 / 3))):
        df = frames_of(spark, {"node": ("int", nodes)})
        r = route_scores(df, whole(spark, len(nodes) - 1), "node", [0, 1, 3]).first()
        assert (r.progress, r.deviations, r.completed) == want[:3]
        assert r.efficiency == pytest.approx(want[3])


@pytest.mark.parametrize("strikes", [0, 1, 2])
def test_route_scores_over_pieces(spark, strikes):
    rng = random.Random(strikes)
    route, rows, want = [0, 3, 1, 2], [], {}
    for s in range(12):
        n = rng.randint(1, 60)
        seq = [rng.choice([0, 1, 2, 3, 4, 5, None]) for _ in range(n)]
        rows += [(str(s), i, v) for i, v in enumerate(seq)]
        runs = [v for v in seq if v is not None]
        runs = [v for i, v in enumerate(runs) if i == 0 or runs[i - 1] != v]
        want[str(s)] = (*fold(runs, route, strikes), max(len(runs) - 1, 0))
    df = table(spark, "session_id string, frame_number bigint, node int", rows)
    paths = df.groupBy("session_id").agg(F.lit(0).cast("bigint").alias("path_id"), F.min("frame_number").alias("start_frame"), F.max("frame_number").alias("end_frame"))
    for piece, chunk in ((3, 7), (4096, 1000)):
        scores = route_scores(df, paths, "node", route, strike_levels=[1], max_strikes=strikes, piece=piece, chunk_frames=chunk)
        got = {r.session_id: (r.progress, r.deviations, r.strikes_used, r.actual_length) for r in scores.collect()}
        assert got == want


def test_efficiency_as_a_session_metric(spark):
    df = frames_of(spark, {"node": ("int", [0, 2, 1, 3]), "state": ("string", ["a", None, None, "b"])})
    edges = table(spark, EDGES, [("g", "0", "1", 1.0), ("g", "1", "3", 1.0), ("g", "0", "2", 1.0)])
    spec = {"start_column": "state", "start_value": "a", "end_column": "state", "end_value": "b"}
    args = spec | {"path_column": "node", "start_node": 0, "end_node": 3}
    wanted = {name: ("shortest_path_efficiency", args | {"measure": name}) for name in ("efficiency", "deviations", "completed")}
    got = {r.metric: r.value for r in M.battery(M.Context(df, edges=edges), wanted).collect()}
    assert got == {"efficiency": pytest.approx(200 / 3), "deviations": 2.0, "completed": 1.0}
    assert M.battery(M.Context(df), wanted).isEmpty()


def test_a_graph_for_each_session(spark):
    edges = table(spark, EDGES, [("a", str(i), str(i + 1), 1.0) for i in range(3)] + [("b", "0", "3", 1.0), ("b", "7", "8", 1.0), ("c", "0", "1", 1.0), ("c", "3", "4", 1.0), ("d", "8", "9", 1.0)])
    graphs = table(spark, "session_id string, graph_id string", [("s1", "a"), ("s2", "b"), ("s3", "c"), ("s4", "d")])
    rows = [(s, i, st, n) for s in ("s1", "s2", "s3", "s4") for i, (st, n) in enumerate([("go", "0"), ("x", "1"), ("x", "2"), ("end", "3")])]
    df = table(spark, "session_id string, frame_number bigint, state string, node string", rows)
    spec = {"start_column": "state", "start_value": "go", "end_column": "state", "end_value": "end"}
    route = {"path_column": "node", "start_node": "0", "end_node": "3", **spec}
    context = M.Context(df, edges=edges, graphs=graphs)
    wanted = {
        "eff": ("shortest_path_efficiency", route),
        "share": ("exploration_percentage", {"location_column": "node"}),
        "in_path": ("num_values_in_path", {"count_column": "node", "mode": "percentage", **spec}),
        "broken": ("num_values_in_path", {"count_column": "missing", **spec}),
    }
    got = {(r.session_id, r.metric): r.value for r in M.battery(context, wanted).collect()}
    assert (got["s1", "eff"], got["s2", "eff"]) == (100.0, pytest.approx(100 / 3))
    assert got["s3", "eff"] == 0.0 and ("s4", "eff") not in got  # no path; no such node
    assert [got[s, "share"] for s in ("s1", "s2", "s4")] == [100.0, 100.0, 200.0]
    assert got["s2", "in_path"] == 100.0 and got["s1", "broken"] is None and "broken" in context.failures
    with pytest.raises(ValueError):
        M.Context(df, edges=edges)


def test_a_metric_that_fails_while_it_runs(spark):
    @M.session_metric("breaks")
    def _breaks(frames, context):
        return frames.select("session_id", F.lit(1).cast("bigint").alias("path_id"), F.raise_error(F.lit("no")).cast("double").alias("value"))

    try:
        df = table(spark, "session_id string, frame_number bigint, node string", [("s", 0, "a")])
        context = M.Context(df)
        got = {r.metric: r.value for r in M.battery(context, {"bad": ("breaks", {}), "good": ("exploration_percentage", {"location_column": "node"})}).collect()}
        assert got == {"bad": None, "good": 1.0} and "no" in context.failures["bad"]
    finally:
        del M.SESSION_METRICS["breaks"]
