import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from spokeworks.functions import geo
from spokeworks.functions.order import running_sum
from spokeworks.operators import network, requests, routes, search
from spokeworks.sources import areas, osm
from spokeworks.streaming.lanes import stream_lanes

LANES = "lane_seq long, osm_id string, geometry array<struct<lon: double, lat: double>>, lane_type string, name string"


def lanes(spark, *lines):
    return spark.createDataFrame([(k, f"way/{k}", line, "cycleway", None) for k, line in enumerate(lines)], LANES)


def edge_rows(graph):
    return graph.edges.select("u", "v", "is_gap", "distance_m").collect()


def test_nearby_coordinates_share_a_key(spark):
    rows = spark.createDataFrame([(13.4, 52.5), (13.400002, 52.500002)], "lon double, lat double")
    assert len({r[0] for r in rows.select(geo.coord_key(F.col("lon"), F.col("lat"))).collect()}) == 1


# Lanes, tolerance, nodes, lane edges and gaps.
@pytest.mark.parametrize(
    ("lines", "gap", "n_nodes", "n_lanes", "n_gaps"),
    [
        ([[(0.0, 0.0), (1.0, 0.0)], [(2.0, 0.0), (3.0, 0.0)]], 0, 4, 2, 0),
        ([[(0.0, 0.0), (1.0, 0.0)], [(1.0, 0.0), (2.0, 0.0)]], 0, 3, 2, 0),
        ([[(0.0, 0.0), (0.0, 0.0005)], [(0.0, 0.002), (0.0, 0.003)]], 300, 4, 2, 3),
        ([[(0.0, 0.0), (0.001, 0.0)], [(0.0015, 0.0), (0.0025, 0.0)]], 100, 4, 2, 1),
        ([[(0.0, 0.0), (0.001, 0.0)], [(0.001, 0.001), (0.001, 0.0)], [(0.001, 0.0), (0.002, 0.0)]], 0, 4, 3, 0),
        ([[(0.0, 0.0), (0.001, 0.0)], [(0.001, 0.0), (0.001, 0.001)], [(0.001, 0.001), (0.0, 0.0)]], 0, 3, 3, 0),
        ([[(0.0, 0.0), (0.0, 0.000001)]], 0, 1, 0, 0),
        ([], 100, 0, 0, 0),
    ],
)
def test_graph_goldens(spark, lines, gap, n_nodes, n_lanes, n_gaps):
    graph = network.build_graph(lanes(spark, *lines), gap)
    edges = edge_rows(graph)
    assert graph.nodes.count() == n_nodes
    assert sum(not e.is_gap for e in edges) == n_lanes
    assert sum(e.is_gap for e in edges) == n_gaps


def test_gap_length_and_node_coordinates(spark):
    graph = network.build_graph(lanes(spark, [(0.0, 0.0), (0.001, 0.0)], [(0.0015, 0.0), (0.0025, 0.0)]), 100)
    assert [round(e.distance_m, 3) for e in edge_rows(graph) if e.is_gap] == [55.597]
    nodes = network.build_nodes(lanes(spark, [(0.0, 0.0), (1.0, 0.0)], [(1.000001, 0.0), (2.0, 0.0)])).orderBy("node_ord").collect()
    assert [(n.lon, n.node_ord) for n in nodes] == [(0.0, 0), (1.000001, 1), (2.0, 3)]  # order of the first, coordinates of the last


def test_first_of_parallel_lanes_wins(spark):
    edges = network.build_lane_edges(lanes(spark, [(0.0, 0.0), (0.5, 0.5), (1.0, 0.0)], [(1.0, 0.0), (0.0, 0.0)])).collect()
    assert [e.lane_seq for e in edges] == [0]


def test_nearest_node_equals_a_check_of_all(spark):
    rng = random.Random(3)
    at = [(k, rng.uniform(0, 1), rng.uniform(0, 1), k) for k in range(200)] + [(900, 0.5, 0.5, 900), (901, 0.5, 0.5, 901)]
    nodes = spark.createDataFrame(at, "node long, lon double, lat double, node_ord long")
    asked = [(k, rng.uniform(-3, 3), rng.uniform(-1, 2)) for k in range(40)] + [(40, 0.5, 0.5)]
    points = spark.createDataFrame(asked, "request_id long, lon double, lat double")
    want = {(r, min(at, key=lambda n: ((n[1] - x) ** 2 + (n[2] - y) ** 2, n[3]))[0]) for r, x, y in asked}
    assert {tuple(r) for r in requests.nearest_node(points, nodes).collect()} == want
    assert requests.nearest_node(points, nodes.limit(0)).count() == 0 and requests.nearest_node(points.limit(0), nodes).count() == 0


def test_far_points_and_all_levels_give_the_nearest_node(spark, monkeypatch):
    monkeypatch.setattr(requests, "TOP_CELLS", 4)
    rng = random.Random(8)
    at = [(k, rng.choice((-170.0, 10.0, 13.4)) + rng.uniform(0, 0.3), rng.uniform(-40, 60), k % 7) for k in range(400)]
    at += [(1000 + k, 5.0 + math.cos(k) * 2, 5.0 + math.sin(k) * 2, 1000 + k) for k in range(100)]  # about equally far from one point
    nodes = spark.createDataFrame([*at, (3000, None, 1.0, 0)], "node long, lon double, lat double, node_ord long")
    asked = [(k, rng.uniform(-179, 179), rng.uniform(-89, 89)) for k in range(60)] + [(60, 5.0, 5.0), (61, *at[0][1:3])]
    points = spark.createDataFrame([*asked, (70, None, 0.0), (71, math.nan, 0.0)], "request_id long, lon double, lat double")
    least = {r: min((n[1] - x) ** 2 + (n[2] - y) ** 2 for n in at) for r, x, y in asked}
    places = {n: (x, y, o) for n, x, y, o in at}
    for few in (200_000, 0):
        monkeypatch.setattr(requests, "MOST_CELLS", few)
        found = dict(map(tuple, requests.nearest_node(points, nodes).collect()))
        assert set(found) == set(least)
        assert all((places[found[r]][0] - x) ** 2 + (places[found[r]][1] - y) ** 2 == least[r] for r, x, y in asked)


def test_gaps_of_a_crowded_cell_are_dealt_to_tasks_and_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(4)
    at = [(k, rng.uniform(0, 0.003), rng.uniform(0, 0.001), k) for k in range(300)] + [(300 + k, rng.uniform(-0.01, 0.01), rng.uniform(-0.01, 0.01), 300 + k // 2) for k in range(200)]
    nodes = spark.createDataFrame(at, "node long, lon double, lat double, node_ord long")
    pairs = lambda: {(r.u, r.v): r.distance_m for r in network.gap_candidates(nodes, 60.0).collect()}
    plain = pairs()
    monkeypatch.setattr(network, "CELL_NODES", 20)
    assert pairs() == plain
    rows = nodes.select(F.lit(60.0).alias("gap"), F.struct("*").alias("a")).crossJoin(nodes.select(F.struct("*").alias("b"))).filter("struct(a.node_ord, a.node) < struct(b.node_ord, b.node)")
    near = geo.in_degree_box(F.col("b.lon") - F.col("a.lon"), F.col("b.lat") - F.col("a.lat"), F.col("gap")) & (geo.equirect_m(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")) <= 60.0)
    assert set(plain) == {tuple(r) for r in rows.filter(near).select("a.node", "b.node").collect()} and len(plain) > 5000


def test_places_and_sums_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 50), k, rng.randint(-3, 9)) for k in range(500)]
    got = {r.k: r.s for r in running_sum(spark.createDataFrame(rows, "x int, k int, v int"), ["x", "k"], F.col("v"), "s").collect()}
    total = 0
    for _, k, v in sorted(rows):
        total += v
        assert got[k] == total
    assert running_sum(spark.createDataFrame([], "x int, v int"), ["x"], F.col("v"), "s").count() == 0


@pytest.mark.parametrize(
    ("tags", "kept", "kind"),
    [
        ({"highway": "cycleway"}, True, "cycleway"), ({"highway": "residential", "cycleway": "track"}, True, "track"), ({"highway": "primary", "cycleway": "lane"}, True, "lane"),
        ({"cycleway": "shared_lane"}, True, "shared"), ({"cycleway": "opposite_lane"}, True, "path"), ({"cycleway:right": "track", "cycleway": "lane"}, True, "track"),
        ({"highway": "footway", "bicycle": "designated"}, True, "path"), ({"highway": "residential", "bicycle": "designated"}, False, "path"), ({}, False, "path"),
    ],
)
def test_tags(spark, tags, kept, kind):
    row = spark.createDataFrame([(tags,)], "tags map<string,string>").select(osm.is_bike_way(F.col("tags")).alias("kept"), geo.lane_type(F.col("tags")).alias("kind")).first()
    assert (row.kept, row.kind) == (kept, kind)


def test_features_are_read_in_order_and_lines_kept(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[0,0]},"properties":{}},'
        '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{"id":7,"name":"x"}},{"type":"Feature","geometry":null,"properties":{}}]}')  # fmt: skip
    rows = osm.to_lanes(osm.read_geojson(spark, str(tmp_path / "a.geojson"))).collect()
    assert [(r.lane_seq, r.osm_id, r.name, [tuple(p) for p in r.geometry]) for r in rows] == [(1, "7", "x", [(0.0, 0.0), (1.0, 1.0)])]


def test_areas_of_just_seven_days_are_neither_fresh_nor_stale(spark):
    rows = spark.sql("select id, timestamp '2024-01-08' - make_interval(0, 0, 0, 7, 0, 0, s) as fetched_at from values ('under', -1), ('just', 0), ('over', 1) as t(id, s)")
    now = F.expr("timestamp '2024-01-08'")
    assert {r.id for r in areas.fresh_areas(rows, now).collect()} == {"under"}
    assert {r.id for r in rows.filter(areas.is_area_stale(now)).collect()} == {"over"}


# Scenarios by name: edges (a gap's distance negative), start, end, least length, loop, found.
SCENARIOS = {
    "simple-chain": ("AB200 BC200 CD200 DE200", "A", None, 800, False, ["ABCDE"]),
    "gap-bridging": ("AB200 BC200 CD-150 DE200 EF200", "A", None, 800, False, ["ABCDEF"]),
    "dead-end": ("AB200 BC200 CD100 CE200 EF200", "A", None, 800, False, ["ABCEF"]),
    "branching": ("AB200 BC200 CE200 BD200 DF200", "A", None, 600, False, ["ABCE", "ABDF"]),
    "isolated": ("AB50 CD50", "A", None, 200, False, []),
    "round-trip": ("AB-50 BC200 CD200 DA-50", "A", None, 400, True, ["ABCDA", "ADCBA"]),
    "one-way-chain": ("AB200 BC200 CD200 DE200", "A", "E", 0, False, ["ABCDE"]),
    "one-way-branching": ("AB200 BC200 CE200 BD200 DE200", "A", "E", 0, False, ["ABCE"]),  # of two equal ones, by the smaller next node
}


@pytest.fixture(params=["broadcast", "blocks"])
def way(request, monkeypatch):
    """Small graphs as one block, or with every node in a block of its own."""
    if request.param == "blocks":
        monkeypatch.setattr(search, "MOST_HOPS", 0)
        monkeypatch.setattr(search, "HOPS_OF_BLOCK", 0)
    return request.param


EDGES = "edge_id string, u long, v long, distance_m double, is_gap boolean, dlon double, dlat double"
STARTS = "request_id long, node long, cand_ord int, max_gap_m double, min_distance_m double, max_distance_m double"


def adjacency(spark, edges):
    return network.neighbors(spark.createDataFrame([(f"{a}-{b}", a, b, float(w), gap, 0.0, 0.0) for a, b, w, gap in edges], EDGES))


# Geometries by name: the tolerance, lanes between named points, and the expected edges, gaps in small letters.
SHAPES = {
    "simple-chain": (0, {"A": (0, 0), "B": (0.001, 0), "C": (0.002, 0)}, "AB BC", "AB BC"),
    "gap-bridging": (100, {"A": (0, 0), "B": (0.001, 0), "C": (0.0015, 0), "D": (0.0025, 0)}, "AB CD", "AB CD bc"),
    "shared-endpoint": (0, {"A": (0, 0), "B": (0.001, 0), "C": (0.001, 0.001), "D": (0.002, 0)}, "AB CB BD", "AB CB BD"),
    "round-trip": (0, {"A": (0, 0), "B": (0.001, 0), "C": (0.001, 0.001)}, "AB BC CA", "AB BC CA"),
}


@pytest.mark.parametrize("name", SHAPES)
def test_graphs_of_shapes_pass_the_check_and_others_fail_it(spark, name):
    gap, points, drawn, expected = SHAPES[name]
    graph = network.build_graph(lanes(spark, *([tuple(map(float, points[p])) for p in pair] for pair in drawn.split())), gap)
    at = {(round(n.lon, 6), round(n.lat, 6)): n.node for n in graph.nodes.collect()}
    node = {p: at[tuple(map(float, xy))] for p, xy in points.items()}
    want = [(node[e[0].upper()], node[e[1].upper()], e.islower()) for e in expected.split()]
    frame = lambda rows: spark.createDataFrame(rows, "u long, v long, is_gap boolean")
    assert graph.nodes.count() == len(points) and network.check_graph(graph.edges, frame(want)).count() == 0
    wrong = [(want[0][0], want[0][1], True), *want[2:], (1, 2, False)]
    assert sorted(r.problem for r in network.check_graph(graph.edges, frame(wrong)).collect()) == ["extra", "missing", "wrong flag"]


@pytest.mark.parametrize("name", SCENARIOS)
def test_route_scenarios(spark, name, way):
    text, start, end, least, loop, expected = SCENARIOS[name]
    adj = adjacency(spark, [(ord(e[0]), ord(e[1]), abs(float(e[2:])), e[2] == "-") for e in text.split()])
    starts = spark.createDataFrame([(1, ord(start), 0, 1000.0, float(least), 5000.0, ord(end) if end else None)], STARTS + ", end_node long")
    steps = search.shortest_paths(adj, starts) if end else search.run_walks(adj, starts, loop)
    ways = {}
    for s in sorted(steps.collect(), key=lambda s: s.seg_idx):
        path = ways.setdefault((s.cand_ord, s.attempt), [chr(s.src)])
        assert path[-1] == chr(s.src)
        path.append(chr(s.dst))
    found = {"".join(path) for path in ways.values()}
    assert set(expected) <= found
    if not expected or end:
        assert found == set(expected)


def test_shortest_distances_equal_dijkstra(spark, way):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(25), 2))): float(rng.randint(0, 9)) for _ in range(60)}
    adj = adjacency(spark, [(a, b, w, False) for (a, b), w in edges.items()])
    ends = spark.createDataFrame([(0, 10.0, 14.0), (7, 10.0, 14.0), (7, 10.0, 3.0)], "end_node long, max_gap_m double, max_distance_m double")
    rows = search.shortest_trees(adj, ends).collect()
    found = {(r.end_node, r.node): (r.dist, r.hops) for r in rows}
    assert len(found) == len(rows)
    for end in (0, 7):
        best, heap = {}, [(0.0, 0, end)]
        while heap:
            d, n, x = heapq.heappop(heap)
            if x in best:
                continue
            best[x] = (d, n)
            for (a, b), w in edges.items():
                if x in (a, b) and d + w <= 14:
                    heapq.heappush(heap, (d + w, n + 1, b if x == a else a))
        assert {n: d for (e, n), d in found.items() if e == end} == best
    starts = spark.createDataFrame([(n, n, 0, 10.0, 0.0, 14.0, 0) for n in range(1, 25)], STARTS + ", end_node long")
    routes_ = {r.request_id: r for r in search.with_signature(search.shortest_paths(adj, starts)).collect()}
    assert {n: (r.total_m, r.n_segments) for n, r in routes_.items()} == {n: d for (e, n), d in found.items() if e == 0 and n}


def test_walks_by_both_ways_are_the_same(spark, monkeypatch):
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(70)}
    adj = adjacency(spark, [(a, b, rng.randint(20, 90), rng.random() < 0.3) for a, b in sorted(pairs)])
    starts = spark.createDataFrame([(r, r * 3, 0, 60.0, 150.0, 400.0) for r in range(4)], STARTS)
    for loop in (False, True):
        monkeypatch.setattr(search, "MOST_HOPS", 500_000)
        first = {tuple(r) for r in search.walks(adj, starts, loop, attempts=12).collect()}
        monkeypatch.setattr(search, "MOST_HOPS", 0)
        monkeypatch.setattr(search, "HOPS_OF_BLOCK", 30)
        monkeypatch.setattr(search, "MOST_BLOCKS", 0 if loop else 100)
        monkeypatch.setattr(search, "MOST_NEAR", 3)
        monkeypatch.setattr(search, "STATES", 5)
        assert len(first) >= 3
        assert first == {tuple(r) for r in search.walks(adj, starts, loop, attempts=12).collect()}


def test_searches_on_a_broadcast_graph_are_dealt_to_several_tasks(spark):
    adj = adjacency(spark, [(k, k + 1, 20.0, False) for k in range(40)])
    ends = spark.createDataFrame([(k, 10.0, 100.0) for k in range(40)], "end_node long, max_gap_m double, max_distance_m double")
    assert search.shortest_trees(adj, ends).rdd.getNumPartitions() >= 4
    starts = spark.createDataFrame([(k, k, 0, 60.0, 50.0, 400.0) for k in range(40)], STARTS)
    assert search.walks(adj, starts, loop=False, attempts=3).rdd.getNumPartitions() >= 4


def test_repeated_routes_go_with_the_walks_of_a_start_and_none_besides(spark, monkeypatch):
    rng = random.Random(9)
    pairs = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(20)}
    adj = adjacency(spark, [(a, b, rng.randint(20, 90), False) for a, b in sorted(pairs)])
    starts = spark.createDataFrame([(r, r, c, 60.0, 100.0, 400.0) for r in range(3) for c in range(2)], STARTS)
    for most, loop in ((500_000, False), (0, True)):
        monkeypatch.setattr(search, "MOST_HOPS", most)
        every, few = (search.walks(adj, starts, loop, attempts=30, repeats=x) for x in (True, False))
        assert {tuple(r) for r in search.distinct_routes(every).collect()} == {tuple(r) for r in search.distinct_routes(few).collect()}
        n_few, n_every = (steps.select(*search.ROUTE).distinct().count() for steps in (few, every))
        assert n_few < n_every or loop and n_few == n_every


def test_shortest_paths_search_no_farther_than_starts_ask(spark, monkeypatch):
    adj = adjacency(spark, [(k, k + 1, 20.0, False) for k in range(60)])
    bounds, trees = [], search.shortest_trees
    monkeypatch.setattr(search, "shortest_trees", lambda a, ends: bounds.append(ends.agg(F.max("max_distance_m")).first()[0]) or trees(a, ends))
    for start, asked in ((3, [100.0]), (15, [100.0, 400.0]), (40, [100.0, 400.0, 800.0]), (41, [100.0, 400.0, 800.0])):
        starts = spark.createDataFrame([(1, start, 0, 60.0, 0.0, 800.0, 0)], STARTS + ", end_node long")
        steps = sorted(search.shortest_paths(adj, starts).collect(), key=lambda s: s.seg_idx)
        assert [s.src for s in steps] == (list(range(start, 0, -1)) if start <= 40 else [])
        assert bounds == asked
        bounds.clear()


@pytest.mark.parametrize("blocks", [False, True])
def test_walks_and_shortest_ways_of_over_a_thousand_steps_are_whole(spark, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(search, "MOST_HOPS", 0)
        monkeypatch.setattr(search, "HOPS_OF_BLOCK", 600)
    adj = adjacency(spark, [(k, (k + 1) % 1500, 20.0, False) for k in range(1500)])
    starts = spark.createDataFrame([(1, 0, 0, 60.0, 24_000.0, 31_000.0, 749)], STARTS + ", end_node long")
    there = search.walks(adj, starts, loop=False, attempts=2)
    assert sorted(r.n_segments for r in search.with_signature(there).collect()) == [1200, 1200]
    back = search.walks(adj, starts, loop=True, attempts=2)
    assert sorted(r.n_segments for r in search.with_signature(back).collect()) == [1500, 1500]
    bounds = starts.withColumns({"min_distance_m": F.lit(0.0), "max_distance_m": F.lit(20_000.0)})
    assert [r.n_segments for r in search.with_signature(search.shortest_paths(adj, bounds)).collect()] == [749]


def test_rounds_follow_lengths_not_crossings_and_plans_stay_as_large(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_HOPS", 0)
    monkeypatch.setattr(search, "HOPS_OF_BLOCK", 30)
    node = [((1 << 20) - k % 2 << 25) + (1 << 20) + 20 * k for k in range(60)]  # to and fro over a border of squares
    adj = adjacency(spark, [(a, b, 20.0, False) for a, b in zip(node, node[1:], strict=False)])
    assert search.Blocks(adj).leaves.count() > 8
    plans, apply = [], search.Blocks.apply
    monkeypatch.setattr(search.Blocks, "apply", lambda self, states, *a, **b: plans.append(len(states._jdf.queryExecution().optimizedPlan().toString())) or apply(self, states, *a, **b))
    ends = spark.createDataFrame([(node[0], 10.0, 5000.0)], "end_node long, max_gap_m double, max_distance_m double")
    assert {(r.node, r.dist, r.hops) for r in search.shortest_trees(adj, ends).collect()} == {(n, 20.0 * k, k) for k, n in enumerate(node)}
    assert 3 < len(plans) < 12 and max(plans[1:]) < 1.1 * min(plans[1:])
    plans.clear()
    starts = spark.createDataFrame([(1, node[0], 0, 60.0, 1000.0, 5000.0)], STARTS)
    assert [r.n_segments for r in search.with_signature(search.walks(adj, starts, loop=False, attempts=1)).collect()] == [50]
    assert len(plans) < 12


def test_blocks_are_the_coarsest_squares_of_at_most_so_many_hops(spark, monkeypatch):
    monkeypatch.setattr(search, "HOPS_OF_BLOCK", 50)
    rng = random.Random(2)
    at = lambda x, y: (x << 25) + y
    dense = {at(rng.randrange(300), rng.randrange(300)): rng.randint(1, 9) for _ in range(400)}
    thin = {at(rng.randrange(1 << 20), rng.randrange(1 << 20)): rng.randint(1, 9) for _ in range(200)}
    counted = {**thin, **dense, at(5000, 5000): 70}
    blocks = [r.block for r in search.quadtree(spark.createDataFrame(list(counted.items()), "node long, n long")).collect()]
    held = {b: sum(n for node, n in counted.items() if search.in_block(node, b)) for b in blocks}
    assert all(sum(search.in_block(node, b) for b in blocks) == 1 for node in counted)
    assert all(n <= 50 for b, n in held.items() if b & 31) and held[at(5000, 5000) << 5] == 70
    levels = {b & 31 for b in blocks}
    assert 14 in levels and min(levels) == 0
    for b in blocks:
        level = b & 31
        if level < 14:  # the square around a block holds too many
            x, y = b >> 30, b >> 5 & (1 << 25) - 1
            around = ((x >> 2) << 25 | y >> 2) << 5 | level + 2
            assert sum(n for node, n in counted.items() if search.in_block(node, around)) > 50


def test_requests_without_rows_or_strategy_give_no_routes_and_strategies_can_be_added(spark):
    adj = adjacency(spark, [(1, 2, 20.0, False), (2, 3, 20.0, False)])
    starts = spark.createDataFrame([(1, 1, 0, 60.0, 10.0, 400.0, None, "own"), (2, 2, 0, 60.0, 10.0, 400.0, None, "explore")], STARTS + ", end_node long, mode string")
    assert search.routes_from_candidates(adj, starts.limit(0)).count() == 0
    assert {r.request_id for r in search.routes_from_candidates(adj, starts).collect()} == {2}
    more = search.register_strategy("own", search.explore)
    assert "own" not in search.STRATEGIES and {r.request_id for r in search.routes_from_candidates(adj, starts, more).collect()} == {1, 2}


def test_whole_requests_widen_the_gap_where_routes_are_too_few(spark):
    lines = [[(k * 0.001, 0.0), ((k + 1) * 0.001, 0.0)] for k in range(6)] + [[(0.012 + k * 0.001, 0.0), (0.013 + k * 0.001, 0.0)] for k in range(3)]
    graph = network.build_graph(lanes(spark, *lines), 1000.0)
    asked = spark.createDataFrame([(1, 0.0, 0.0, 0.004, 0.0, 50.0, 0.0, 5000.0, False), (2, 0.0, 0.0, 0.015, 0.0, 50.0, 0.0, 5000.0, False), (3, 0.0, 0.0, None, None, 50.0, 300.0, 900.0, False)], "request_id long, start_lon double, start_lat double, end_lon double, end_lat double, max_gap_m double, min_distance_m double, max_distance_m double, round_trip boolean")
    found = search.find_routes(graph, asked.withColumn("start_proximity_m", F.lit(10.0)))
    rows = found.groupBy("request_id", "mode", "gap_m").agg(F.round(F.sum("distance_m")).alias("m"), F.count_distinct("cand_ord", "attempt").alias("n")).collect()
    by = {r.request_id: r for r in rows}
    assert len(rows) == 3 and (by[1].mode, by[1].gap_m, by[1].m, by[1].n) == ("one_way", 50.0, 445.0, 1)
    assert (by[2].gap_m, by[2].m, by[2].n) == (1000.0, 1668.0, 1) and by[3].mode == "explore" and by[3].gap_m == 1000.0 and by[3].n >= 1
    assert search.find_routes(graph, asked.withColumn("start_proximity_m", F.lit(10.0)).limit(0)).count() == 0


def test_a_graph_widened_around_requests_gives_the_routes_of_one_widened_everywhere(spark, monkeypatch):
    rng = random.Random(3)
    at = lambda: (rng.uniform(0, 0.4), rng.uniform(52.0, 52.25))
    lines = [[p, (p[0] + rng.uniform(-0.004, 0.004), p[1] + rng.uniform(-0.003, 0.003))] for p in (at() for _ in range(1200))]
    lines += [[(0.2, 52.1), (0.2 + k * 1e-5, 52.1 + 1.2e-5)] for k in (1, 2)]  # edges of a metre, whose nodes may lie farther apart
    graph = network.build_graph(lanes(spark, *lines), 100.0)
    asked = spark.createDataFrame([(k, *at(), *(at() if k % 3 == 0 else (None, None)), 100.0, 150.0, 400.0, 4000.0, k % 3 == 1) for k in range(9)], "request_id long, start_lon double, start_lat double, end_lon double, end_lat double, max_gap_m double, start_proximity_m double, min_distance_m double, max_distance_m double, round_trip boolean")
    made = []
    around = network.hops_around
    monkeypatch.setattr(network, "hops_around", lambda *a: made.append(a[1]) or around(*a))
    rows = lambda found: sorted(map(str, found.select("request_id", "cand_ord", "attempt", "seg_idx", "src", "dst", "gap_m").collect()))
    some = rows(search.find_routes(graph, asked))
    monkeypatch.setattr(search, "MOST_CELLS", 0)
    assert some == rows(search.find_routes(graph, asked)) and len(some) > 50
    assert made[0] is not None and made[1] is None
    assert around(graph, made[0], 1000.0).count() < 0.7 * around(graph, None, 1000.0).count()


def crowded(spark, n=120, seed=4):
    rng = random.Random(seed)
    at = lambda: (13.4 + rng.uniform(0, 0.03), 52.5 + rng.uniform(0, 0.02))
    lines = [[p, (p[0] + rng.uniform(-0.002, 0.002), p[1] + rng.uniform(-0.001, 0.001))] for p in (at() for _ in range(n))]
    asked = spark.createDataFrame([(k, *at(), *(at() if k % 3 == 0 else (None, None)), 20.0, 150.0, 300.0, 2500.0, k % 3 == 1) for k in range(6)], "request_id long, start_lon double, start_lat double, end_lon double, end_lat double, max_gap_m double, start_proximity_m double, min_distance_m double, max_distance_m double, round_trip boolean")
    return network.build_graph(lanes(spark, *lines), 20.0), asked


@pytest.mark.parametrize("most", [500_000, 0])
def test_gaps_found_when_a_node_is_met_are_those_of_the_grid_join(spark, most, monkeypatch):
    graph, _ = crowded(spark)
    lane_edges, nodes = graph.edges.filter("not is_gap"), graph.nodes.withColumn("inside", F.expr("node % 5 > 0"))
    own = nodes.filter("inside").select(F.col("node").alias("src"))
    rows = network.neighbors(lane_edges.unionByName(network.exclude_connected(network.gap_candidates(graph.nodes, 400.0), lane_edges))).join(own, "src", "left_semi")
    states = graph.nodes.select(F.col("node").alias("cur"), F.lit(0).alias("k"))
    kind = search._arrow(spark, "src long, dst long, edge_id string, m double, is_gap boolean")
    work = lambda some, hops, inside: search._batches(({"src": r["cur"], "dst": h[0], "edge_id": h[1], "m": h[2], "is_gap": h[3]} for r in some for near in hops.fit(r["cur"], 400.0) for h in near), kind)
    monkeypatch.setattr(search, "MOST_HOPS", most)
    monkeypatch.setattr(search, "HOPS_OF_BLOCK", 60)
    monkeypatch.setattr(search, "MOST_HELD", 500)
    seen = set()
    for few in (100, 0):
        monkeypatch.setattr(search, "MOST_BLOCKS", few)
        blocks = search.Blocks(network.neighbors(lane_edges).join(own, "src", "left_semi"), nodes, 400.0)
        assert most or blocks.blocks.count() > 3
        found = blocks.apply(states, work, "src long, dst long, edge_id string, m double, is_gap boolean", ["cur"]).collect()
        seen.add(frozenset((r.src, r.dst, r.edge_id, round(r.m, 6), r.is_gap) for r in found))
        assert len(found) == len(set(found))
    assert seen == {frozenset((r.src, r.dst, r.edge_id, round(r.distance_m, 6), r.is_gap) for r in rows.collect())}


def test_no_table_of_wide_gaps_is_written(spark, monkeypatch):
    graph, asked = crowded(spark)
    assert search.network.gap_candidates(graph.nodes, search.WIDE_GAP_M).count() > 5000
    sizes, kept = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: sizes.append((out := kept(df)).count()) or out)
    monkeypatch.setattr(search, "MOST_HOPS", 0)
    first_lane = lambda adj, starts: starts.join(adj.filter("not is_gap"), F.col("node") == F.col("src")).select("request_id", "cand_ord", F.lit(1).alias("attempt"), F.lit(0).alias("seg_idx"), "src", "dst", "edge_id", "distance_m", "is_gap").dropDuplicates(["request_id", "cand_ord"])
    found = search.find_routes(graph, asked.withColumn("mode", F.expr("case when request_id < 2 then 'own' end")), search.register_strategy("own", first_lane))
    assert {1000.0} <= {r.gap_m for r in found.select("gap_m").distinct().collect()}
    assert max(sizes) < 5000


def test_requests_of_a_mode_without_strategy_are_not_searched_again(spark, monkeypatch):
    graph, asked = crowded(spark, 30)
    monkeypatch.setattr(search, "widened", lambda *a: pytest.fail("searched again"))
    assert search.find_routes(graph, asked.withColumn("mode", F.lit("none"))).count() == 0


def test_requests_may_name_their_mode(spark):
    lines = [[(k * 0.001, 0.0), ((k + 1) * 0.001, 0.0)] for k in range(6)]
    asked = spark.createDataFrame([(k, 0.0, 0.0, None, None, 50.0, 10.0, 100.0, 900.0, False, ("round_trip", None, "own", "none")[k]) for k in range(4)], "request_id long, start_lon double, start_lat double, end_lon double, end_lat double, max_gap_m double, start_proximity_m double, min_distance_m double, max_distance_m double, round_trip boolean, mode string")
    found = search.find_routes(network.build_graph(lanes(spark, *lines), 50.0), asked, search.register_strategy("own", search.explore))
    assert {(r.request_id, r.mode) for r in found.select("request_id", "mode").distinct().collect()} == {(0, "round_trip"), (1, "explore"), (2, "own")} - ({(0, "round_trip")} if not found.filter("request_id = 0").count() else set())


def test_extracted_ways_equal_a_check_of_all_pairs(spark):
    rng = random.Random(11)
    lines = [[(x := rng.uniform(0, 0.4), y := rng.uniform(0, 0.4)), (x + rng.uniform(-0.1, 0.1), y + rng.uniform(-0.1, 0.1))] for _ in range(80)]
    boxes = [(str(k), w := rng.uniform(0, 0.4), s := rng.uniform(0, 0.4), w + rng.uniform(0, 0.2), s + rng.uniform(0, 0.2)) for k in range(25)]
    found = {(r.area_id, r.lane_seq) for r in areas.extract_areas(lanes(spark, *lines), spark.createDataFrame(boxes, "id string, west double, south double, east double, north double")).collect()}

    def meets(line, w, s, e, n):
        (x1, y1), (x2, y2) = line
        low, high = 0.0, 1.0
        for a, d, lo, hi in ((x1, x2 - x1, w, e), (y1, y2 - y1, s, n)):
            one, two = sorted(((lo - a) / d, (hi - a) / d))
            low, high = max(low, one), min(high, two)
        return low <= high

    assert found == {(b, k) for b, *box in boxes for k, line in enumerate(lines) if meets(line, *box)}
    kept = osm.filter_bbox(lanes(spark, *lines), *boxes[0][1:]).select("lane_seq").collect()
    assert {("0", r.lane_seq) for r in kept} == {x for x in found if x[0] == "0"}


def test_ways_across_continents_make_tens_of_rows_and_meet_boxes_of_all_sizes(spark):
    rng = random.Random(5)
    size = lambda: 10 ** rng.uniform(-4, 1.5)
    lines = [[(x := rng.uniform(-9, 9), y := rng.uniform(-9, 9)), (x + size(), y + size() / 9)] for _ in range(150)]
    lines.append([(-170.0, -70.0), (170.0, 70.0)])
    boxes = [(str(k), w := rng.uniform(-9, 9), s := rng.uniform(-9, 9), w + size(), s + size()) for k in range(60)]
    kind = "id string, west double, south double, east double, north double"
    made = areas.extract_areas(lanes(spark, *lines), spark.createDataFrame(boxes, kind)).select("area_id", "lane_seq").collect()
    table = lanes(spark, *lines)
    want = {(b, r.lane_seq) for b, *box in boxes for r in table.filter(osm.meets_box(F.col("geometry"), *map(F.lit, box))).select("lane_seq").collect()}
    assert {tuple(r) for r in made} == want and len(made) == len(want) > 60
    for box in ((-170.0, 170.0, -70.0, 70.0), (0.0, 0.0, 0.0, 0.0), (-0.01, 3.0, 5.0, 5.0)):
        level, cells = areas.cover({c: F.lit(v) for c, v in zip(("west", "east", "south", "north"), box, strict=True)}, 0.05)
        assert sum(len(spark.range(1).select(cells(F.lit(k))).first()[0]) for k in range(spark.range(1).select(level).first()[0], areas.LEVELS)) < 100


def test_areas_are_upserted_pruned_with_their_lanes_and_read_again(spark, tmp_path):
    kind = "id string, west double, south double, east double, north double, fetched_at timestamp_ntz"
    old = spark.sql("select * from values ('a', 0D, 0D, 1D, 1D, timestamp '2024-01-01'), ('b', 0D, 0D, 1D, 1D, timestamp '2024-01-09') as t(id, west, south, east, north, fetched_at)")
    new = spark.sql("select * from values ('a', 0D, 0D, 2D, 2D, timestamp '2024-01-10') as t(id, west, south, east, north, fetched_at)")
    assert len(kind.split(",")) == len(old.columns)
    areas.save_areas(old, new, str(tmp_path / "x"))
    assert areas.load_area(spark, str(tmp_path / "x"), "a").first().east == 2.0 and areas.load_all_areas(spark, str(tmp_path / "x")).count() == 2
    of = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "area_id string, lane_seq int")
    kept, rest = areas.prune_stale_areas(areas.load_all_areas(spark, str(tmp_path / "x")), of, F.expr("timestamp '2024-01-16 12:00:00'"))
    assert [r.id for r in kept.collect()] == ["a"] and [r.lane_seq for r in rest.collect()] == [1]


def test_lanes_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"features":[{"type":"Feature","geometry":{"type":"LineString","coordinates":[[0,0],[1,1]]},"properties":{"id":7,"highway":"cycleway"}}]}')
    stream = spark.readStream.schema(osm.FEATURES).json(str(tmp_path / "in"))
    query = stream_lanes(osm.features_of(stream)).writeStream.format("memory").queryName("lanes_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.osm_id, r.lane_type) for r in spark.table("lanes_out").collect()] == [("7", "cycleway")]


def test_one_way_requests_keep_the_shortest_route_and_others_all(spark):
    rows = [(1, k, 1, 0, 1, 2, "e", d, False, "one_way") for k, d in ((0, 5.0), (1, 3.0), (2, 3.0))] + [(2, k, 1, 0, 1, 2, "e", 4.0, False, "explore") for k in (0, 1)]
    steps = spark.createDataFrame(rows, "request_id long, cand_ord int, attempt int, seg_idx int, src long, dst long, edge_id string, distance_m double, is_gap boolean, mode string")
    found = search.shortest_route(steps, F.col("mode") == "one_way").select("request_id", "cand_ord").collect()
    assert sorted(map(tuple, found)) == [(1, 1), (2, 0), (2, 1)]


def test_serving_rotates_and_a_refresh_starts_anew(spark):
    log = spark.sql("select id as request_id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, id * 5) as ts, 'k' as cache_key, id = 6 as refresh from range(1, 8)")
    found = spark.createDataFrame([(r, f"r{r}{i}") for r in (2, 3, 7) for i in "ab"], "request_id long, route_id string")
    rows = {r.request_id: r for r in routes.serve_routes(log, found).collect()}
    assert [rows[k].status for k in range(1, 8)] == ["no_route", *["served"] * 4, "no_route", "served"]
    assert [rows[k].route_id[:2] for k in (2, 3, 4, 5, 7)] == ["r2"] * 4 + ["r7"]
    assert rows[2].route_id == rows[4].route_id != rows[3].route_id == rows[5].route_id


def test_serving_over_several_days_counts_refreshes_of_all_before(spark):
    log = spark.sql("select id as request_id, timestamp '2024-01-01' + make_interval(0, 0, 0, id, 6) as ts, if(id % 2 = 0, 'k', 'l') as cache_key, id in (5, 9) as refresh from range(0, 12)")
    found = spark.createDataFrame([(r, f"r{r}{i}") for r in range(12) for i in "abc"], "request_id long, route_id string")
    rows = {r.request_id: r for r in routes.serve_routes(log, found).collect()}
    assert [rows[k].epoch for k in range(12)] == [0] * 5 + [1] * 4 + [2] * 3
    leaders = {(r.cache_key, r.epoch): min(k for k in range(12) if (rows[k].cache_key, rows[k].epoch) == (r.cache_key, r.epoch)) for r in rows.values()}
    assert all(r.route_id[:-1] == f"r{leaders[r.cache_key, r.epoch]}" for r in rows.values())
    assert [rows[k].turn for k in (0, 2, 4, 6, 8, 10)] == [0, 1, 2, 0, 1, 0]


def test_a_log_served_in_parts_gives_the_rows_of_the_whole(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, f"k{rng.randrange(4)}", rng.random() < 0.04) for k in range(150)]
    log = spark.createDataFrame(rows, "request_id long, cache_key string, refresh boolean").withColumn("ts", F.timestamp_seconds(F.col("request_id") * 7 + 1_700_000_000))
    found = spark.createDataFrame([(k, f"r{k}{i}") for k in range(150) if k % 3 for i in range(k % 5 + 1)], "request_id long, route_id string")
    rows_of = lambda served: sorted(map(str, served.collect()))
    whole = rows_of(routes.serve_routes(log, found))
    state, parts = None, []
    for k, (low, high) in enumerate(((0, 61), (61, 62), (62, 62), (62, 110), (110, 150))):
        part = log.filter((F.col("request_id") >= low) & (F.col("request_id") < high))
        own = found.join(part.select("request_id"), "request_id", "left_semi")
        parts += routes.serve_routes(part, own, state).collect()
        routes.save_rotation(routes.rotation_after(part, own, state), str(tmp_path / str(k)))
        state = routes.load_rotation(spark, str(tmp_path / str(k)))
        assert state.keys.groupBy("cache_key").count().filter("count > 1").isEmpty()
        leaders = {r.leader for r in state.keys.collect() if r.leader is not None}
        assert {r.leader for r in state.turns.collect()} == leaders
    assert sorted(map(str, parts)) == whole and any("epoch=3" in r for r in whole)


def test_gpx_escapes_names_and_numbers_are_short(spark):
    seg = spark.createDataFrame([(1, "a", 0, [(1.5, 2.0), (1.25, -0.00012)], "bike_lane", 3.0, 1, 2)], "request_id long, route_id string, seg_idx int, geometry array<struct<lon: double, lat: double>>, type string, distance_m double, src long, dst long")
    text = routes.routes_to_gpx(seg, F.lit("a<b&c")).first().gpx
    assert "<name>a&lt;b&amp;c</name>" in text
    assert '<trkpt lat="2" lon="1.5"></trkpt>' in text
    assert '<trkpt lat="-0.00012" lon="1.25"></trkpt>' in text


def test_explore_overshoot_is_no_violation_but_an_open_loop_is(spark):
    seg = spark.createDataFrame([(r, "a", 0, [(0.0, 0.0), (1.0, 0.0)], "bike_lane", 50.0, 1, 2) for r in (1, 2)], "request_id long, route_id string, seg_idx int, geometry array<struct<lon: double, lat: double>>, type string, distance_m double, src long, dst long")
    asked = spark.createDataFrame([(1, 10.0, 40.0, "explore"), (2, 10.0, 60.0, "round_trip")], "request_id long, min_distance_m double, max_distance_m double, mode string")
    assert [(r.request_id, r.broken) for r in routes.route_violations(seg, asked).collect()] == [(2, ["not_closed"])]
    assert math.isclose(routes.route_metrics(seg).first().coverage, 1.0)
