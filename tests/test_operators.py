"""Sequence, graph and spatial operators on small fixtures."""

import math
import random

import pytest
from pyspark.sql import functions as F

from roadlattice.operators import etl, generation, graph, lines, portfolio, reporting, sequences, spatial


def grade(spark, *parts):
    rows = [(1, i, m, g, ferry) for i, (m, g, ferry) in enumerate(parts)]
    return sequences.sustained_grade(spark.createDataFrame(rows, "route_id long, seq long, len_m long, grade_pct long, ferry boolean")).first()


def test_sustained_grade(spark):
    assert (lambda r: (r.max_grade, r.avg_up))(grade(spark, (1, 180, False), (120, 8, False), (100, 12, True))) == (8.0, 8.0)
    assert grade(spark, (20, 30, False), (80, 0, False), (100, 8, False)).max_grade == 8.0
    assert grade(spark, (100, 14, False)).max_grade == 14.0


@pytest.mark.parametrize("metres", [(370, 490, 130, 10, 0), (1, 1, 1, 1, 1), (5000, 2400, 2500, 99, 1), (0, 0, 1, 0, 0)])
def test_percentages_add_up(spark, metres):
    df = spark.createDataFrame([(1, f"c{i}", m) for i, m in enumerate(metres)], "g int, name string, metres long")
    got = reporting.percentages(df, ["g"], "name", "metres").collect()
    assert sum(r.pct for r in got) == 100 and all((r.pct >= 1) == (r.metres > 0) for r in got)


def test_best_count(spark):
    cases = {"a": [(1, 2010, 1), (2, 2012, 3)], "b": [(1, 2010, 3), (2, 2010, 1)], "c": [(1, 2010, 1), (2, 2010, 2)], "d": [(1, None, 1), (2, 1990, 3)]}
    rows = [(k, seen, 100 + seen, y, s) for k, v in cases.items() for seen, y, s in v]
    got = {r.key: r.adt for r in spatial.best_count(spark.createDataFrame(rows, "key string, seen int, adt int, year int, source int"), "key").collect()}
    assert got == {"a": 102, "b": 102, "c": 101, "d": 102}


@pytest.mark.parametrize(("north", "turned", "hit"), [(0, False, True), (17, False, True), (25, False, False), (0, True, False)])
def test_span_match(spark, north, turned, hit):
    km = 1000 / (111320 * math.cos(math.radians(47.6)))
    way = spark.createDataFrame([(1, -122.0, 47.6, -122.0 + km, 47.6)], "way_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    up = north / 110540
    seg = (7, -122.0 + km / 2, 47.5955, -122.0 + km / 2, 47.6045) if turned else (7, -122.0, 47.6 + up, -122.0 + km, 47.6 + up)
    got = spatial.span_match(way, spark.createDataFrame([seg], "seg_id long, s_lon1 double, s_lat1 double, s_lon2 double, s_lat2 double")).collect()
    assert bool(got) == hit and (not hit or (got[0].seg_id, got[0].covered) == (7, 5))


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 9)], "node long")
    assert {r.node: r.component for r in graph.components(edges, nodes).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 9: 9}
    arcs = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0)], "src long, dst long, cost double")
    best = graph.distances(arcs, spark.createDataFrame([(0, 1)], "request int, node long"))
    assert {r.node: r.dist for r in best.collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0}
    back = graph.walked_back(best, spark.createDataFrame([(0, 4)], "request int, node long"))
    assert [r.node for r in back.orderBy("steps_back").collect()] == [4, 3, 2, 1]
    relations = spark.createDataFrame([(1, 10, "way"), (2, 1, "relation"), (1, 2, "relation")], "id long, member long, member_type string")
    assert {(r.id, r.way) for r in graph.members(relations).collect()} == {(1, 10), (2, 10)}


def test_section_frontier_switches_parents(spark):
    a = [(0, 1, 100, 1), (1, 2, 101, 1), (2, 5, 102, 9), (5, 6, 103, 9)]
    b = [(0, 3, 200, 9), (3, 2, 201, 9), (2, 4, 202, 1), (4, 6, 203, 1)]
    rows = [(1, s, d, e, 0, 6, *([float(c)] * 9)) for s, d, e, c in a + b]
    df = spark.createDataFrame(rows, "request long, src long, dst long, edge long, start long, goal long, " + ", ".join(f"{n} double" for n in portfolio.LABEL))
    assert portfolio.section_frontier(df).orderBy("rank").first().edges == "100,101,202,203"


def test_lines(spark):
    ring = [(math.cos(t / 16 * 2 * math.pi) * 0.001, math.sin(t / 16 * 2 * math.pi) * 0.001) for t in range(17)]
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in ring],)], "line array<struct<lon:double,lat:double>>")
    assert 4 <= len(df.select(lines.simplify()("line").alias("s")).first().s) <= 17
    up = spark.createDataFrame([([10, 11, 12, 11, 9],)], "e array<int>").select(lines.climbs(F.col("e")).alias("c")).first().c
    assert (up.up_m, up.down_m) == (2, 3)


def test_curve_hazard(spark):
    """A right-angled bend that climbs 6 %: severity by speed and shoulder, uphill only, none where there is a lane or the road is flat."""
    bend = [{"lon": -122.0 + 0.0002 * min(i, 4), "lat": 47.0 + 0.00014 * max(0, i - 4)} for i in range(9)]
    up, flat = [0.95 * i for i in range(9)], [0.0] * 9
    rows = [(bend, up, 35, 2, 0), (bend, up, 50, 0, 0), (bend, up, 35, 6, 0), (bend, up, 35, None, 0), (bend, up, 25, 2, 0), (bend, up, 35, 2, 2), (bend, flat, 35, 2, 0), (bend[::-1], up[::-1], 35, 2, 0), (bend[:2], up[:2], 35, 2, 0)]
    df = spark.createDataFrame(rows, "line array<struct<lon:double,lat:double>>, e array<double>, mph int, shoulder int, facility int").coalesce(1)
    got = [(r.h.ab, r.h.ba) for r in df.select(lines.curve_hazard()("line", "e", "mph", "shoulder", "facility").alias("h")).collect()]
    assert got == [(3, 0), (3, 0), (1, 0), (2, 0), (0, 0), (0, 0), (0, 0), (0, 3), (0, 0)]


def test_nearest_node_far_away_and_without_nodes(spark):
    points = spark.createDataFrame([(1, 0.0, 10.0), (2, -122.0, 47.0), (3, 179.0, -80.0)], "point_id long, lon double, lat double")
    nodes = spark.createDataFrame([(7, -122.001, 47.0, False), (8, -122.003, 47.0, True), (9, 20.0, 10.0, False)], "node long, lon double, lat double, local boolean")
    got = {r.point_id: r.node for r in spatial.nearest_node(points, nodes).collect()}
    assert got[2] == 8 and got[1] == 9 and got[3] in (7, 8, 9)
    assert [r.node for r in spatial.nearest_node(points, nodes.where("false")).collect()] == [None] * 3


def test_skyline_in_blocks(spark):
    rows = [(r, i, (i * 7919 + r) % 101, (i * 104729) % 97, (i * 31) % 89) for r in range(3) for i in range(120)]
    df = spark.createDataFrame(rows, "request long, candidate long, x long, y long, z long")
    best = lambda a, b: all(p <= q for p, q in zip(a, b)) and a != b
    want = sorted((r[0], r[1]) for r in rows if not any(s[0] == r[0] and best(s[2:], r[2:]) for s in rows))
    for block in (4096, 10):
        assert sorted((r.request, r.candidate) for r in portfolio.skyline(df, ["x", "y", "z"], block=block).collect()) == want


def test_distances_over_blocks_and_penalties(spark):
    r = random.Random(5)
    arcs = [(a, b, float(r.randint(1, 9))) for a in range(60) for b in {r.randrange(60), (a + 1) % 60} if a != b]
    df = spark.createDataFrame(arcs, "src long, dst long, cost double")
    dear = {(0, a, b): 3.0 for a, b, _ in arcs[::4]}
    pen = spark.createDataFrame([(q, a, b, f) for (q, a, b), f in dear.items()], "request long, src long, dst long, factor double")

    def plain(request, source):
        best = {source: 0.0}
        while True:
            new = dict(best)
            for a, b, c in arcs:
                if a in best:
                    new[b] = min(new.get(b, 1e9), best[a] + c * dear.get((request, a, b), 1.0))
            if new == best:
                return best
            best = new

    sources = spark.createDataFrame([(0, 3), (1, 3), (2, 40)], "request long, node long")
    want = {(q, n): d for q, s in ((0, 3), (1, 3), (2, 40)) for n, d in plain(q, s).items()}
    for block, parts in ((1 << 14, 1), (7, 2)):
        best = graph.distances(df, sources, block_nodes=block, request_parts=parts, penalties=pen)
        assert {(x.request, x.node): x.dist for x in best.collect()} == want
        path = [x.node for x in graph.walked_back(best, spark.createDataFrame([(0, 20)], "request long, node long"), block_nodes=block).orderBy("steps_back").collect()]
        cost = {(a, b): min(c for x, y, c in arcs if (x, y) == (a, b)) * dear.get((0, a, b), 1.0) for a, b, _ in arcs}
        assert path[0] == 20 and path[-1] == 3 and sum(cost[b, a] for a, b in zip(path, path[1:])) == want[0, 20]


def test_pruned(spark):
    edges = spark.createDataFrame([(1, 2, False), (2, 3, True), (5, 6, False), (8, 9, True)], "a long, b long, ok boolean")
    kept, numbers = graph.pruned(edges, spark.createDataFrame([(i,) for i in (1, 2, 3, 5, 6, 8, 9, 11)], "node long"), F.col("ok"))
    assert {(r.node, r.new_id) for r in numbers.collect()} == {(1, 0), (2, 1), (3, 2), (8, 3), (9, 4)} and kept.count() == 3


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "Point", "[1,2]")], "name string, note string, geometry_type string, coordinates string")
    etl.write_features(df, str(tmp_path / "out"))
    line = spark.read.text(str(tmp_path / "out")).first().value
    assert '"name":"a"' in line and "note" not in line
    (tmp_path / "in.json").write_text('{"features":[{"properties":{"name":"x"},"geometry":{"type":"Point","coordinates":[1,2]}}]}')
    assert etl.read_geojson(spark, str(tmp_path / "in.json"), "name string").first().geometry_type == "Point"
    (tmp_path / "page.json").write_text('{"features":[{"attributes":{"id":1},"geometry":{"paths":[[[0,1],[2,3]],[[4,5],[6,7]]]}}]}')
    assert etl.lines(etl.read_pages(spark, str(tmp_path / "page.json"), "id long")).count() == 2


def stretches(rows):
    """Runs of failing edges of a route: (metres, whether bounded by other edges)."""
    out, i = [], 0
    while i < len(rows):
        j = i
        while j < len(rows) and rows[j].level == 4:
            j += 1
        if j > i:
            out.append((sum(r.len_m for r in rows[i:j]), i > 0 and j < len(rows)))
        i = max(j, i + 1)
    return out


def test_strict_routes_hold_short_crossings_alone(spark):
    """A ladder whose cheap rail fails in pieces of 30 m: two in a row are no crossing, one between passing edges is."""
    flags = {k: False for k in ("prohibited", "freeway", "ferry", "mtb")}
    edge = lambda i, a, b, cost, level, m: dict(edge_id=i, src=a, dst=b, cost=float(cost), level=level, len_m=m, **flags)
    arcs = [edge(1, 1, 2, 1, 1, 100), edge(2, 2, 3, 1, 4, 30), edge(3, 3, 4, 1, 4, 35), edge(4, 4, 5, 1, 1, 100), edge(5, 2, 6, 4, 1, 100), edge(6, 6, 4, 1, 4, 40), edge(7, 6, 7, 9, 1, 100), edge(8, 7, 5, 9, 1, 100), edge(9, 8, 9, 1, 4, 30)]
    df = spark.createDataFrame(arcs, "edge_id long, src long, dst long, cost double, level int, len_m long, prohibited boolean, freeway boolean, ferry boolean, mtb boolean")
    requests = spark.createDataFrame([(0, 1, 5), (1, 8, 9)], "request long, start long, goal long")
    got = generation.strict_routes(df, requests).orderBy("request", "seq").collect()
    assert [(r.request, r.tries, r.edge_id) for r in got] == [(0, 1, 1), (0, 1, 5), (0, 1, 6), (0, 1, 4)]
    assert all(m <= 40 and bounded for m, bounded in stretches(got))
    near = spark.createDataFrame([(1, 9)], "request long, edge_id long")
    assert [r.edge_id for r in generation.strict_routes(df, requests.where("request = 1"), near, retries=1).collect()] == [9]
    # a long failing edge at an end serves the request that it is exempt for, and no other
    longer = spark.createDataFrame([edge(20, 11, 1, 2, 4, 300)], df.schema)
    asks = spark.createDataFrame([(5, 11, 2), (6, 11, 2)], "request long, start long, goal long")
    ends = spark.createDataFrame([(5, 20)], "request long, edge_id long")
    got = generation.strict_routes(df.union(longer), asks, ends, retries=1).orderBy("seq").collect()
    assert [(r.request, r.edge_id, r.cost) for r in got] == [(5, 20, 2.0), (5, 1, 1.0)]


def test_strict_retries_share_their_arcs(spark, monkeypatch):
    """Arcs are dealt once for all tries; long methods are allowed again after arcs are stored."""
    rows = [(1, 0, 1, 1.0, 4, 30), (2, 1, 2, 1.0, 1, 100), (3, 0, 3, 5.0, 1, 100), (4, 3, 2, 5.0, 1, 100)]
    arcs = spark.createDataFrame([(*r, False, False, False, False) for r in rows], "edge_id long, src long, dst long, cost double, level int, len_m long, prohibited boolean, freeway boolean, ferry boolean, mtb boolean")
    made, copies, limit = [], generation.copies, spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    monkeypatch.setattr(generation, "copies", lambda *a, **k: made.append(1) or copies(*a, **k))
    got = generation.strict_routes(arcs, spark.createDataFrame([(0, 0, 2)], "request long, start long, goal long")).orderBy("seq").collect()
    assert [(r.tries, r.edge_id) for r in got] == [(1, 3), (1, 4)] and len(made) == 1
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == limit


def test_rejected_crossings(spark):
    rows = [(0, i, 10 + i, level, False, m) for i, (level, m) in enumerate([(1, 90), (4, 30), (4, 35), (1, 90), (4, 40), (2, 90), (4, 20)])]
    route = spark.createDataFrame(rows, "request long, seq long, edge_id long, level int, freeway boolean, len_m long")
    assert {r.edge_id for r in generation.rejected_crossings(route).collect()} == {12, 16}
    exempt = spark.createDataFrame([(0, 16)], "request long, edge_id long")
    assert {r.edge_id for r in generation.rejected_crossings(route, exempt).collect()} == {12}


def test_turning_routes_on_an_overlay(spark):
    """Every plan's least cost with turns equals a plain search over arcs, with levels of cells, penalties and odd requests."""
    import heapq
    import random

    from roadlattice.operators import overlay

    r, side = random.Random(4), 9
    nodes = [(y * side + x, x // 2, y // 2) for y in range(side) for x in range(side)]
    arcs = []
    for n, *_ in nodes:
        for far, heading in ((n + 1, 90.0), (n + side, 0.0)):
            if (heading == 90.0 and n % side == side - 1) or far >= side * side:
                continue
            edge = len(arcs)
            arcs.append((2 * edge, edge, n, far, r.randint(1, 9) * 1.0, heading, heading, r.choice(["A", "B", None])))
            if r.random() < 0.8:
                arcs.append((2 * edge + 1, edge, far, n, r.randint(1, 9) * 1.0, (heading + 180) % 360, (heading + 180) % 360, arcs[-1][7]))
    frame = spark.createDataFrame(arcs, "arc_id long, edge_id long, src long, dst long, cost double, bearing_in double, bearing_out double, name string")
    on = overlay.build({"turns": (frame, 5.0), "plain": (frame, 0.0)}, spark.createDataFrame(nodes, "node long, x long, y long"))
    assert on.top == 1
    asked = [(k, k % 3, r.choice(["turns", "plain"]), r.randrange(81), r.randrange(81)) for k in range(12)] + [(20, 0, "turns", 3, 3), (21, 0, "no such", 1, 5), (22, 0, "turns", 1, 9999)]
    dear = [(k, p, e, f) for k, p, *_ in asked[:4] for e, f in ((3, 2.0), (10, 3.5), (11, 3.5), (40, 9.0))]
    got = overlay.routes(on, spark.createDataFrame(asked, "request long, plan int, graph string, start long, goal long"), spark.createDataFrame(dear, "request long, plan int, edge_id long, factor double")).orderBy("request", "step").collect()

    def plain(k, p, graph, start, goal):
        factor = {e: f for a, b, e, f in dear if (a, b) == (k, p)}
        turn = 5.0 if graph == "turns" else 0.0
        known, heap = {}, []
        for a in arcs:
            if a[2] == start:
                heapq.heappush(heap, (a[4] * factor.get(a[1], 1.0), a[0]))
        by_id = {a[0]: a for a in arcs}
        while heap:
            cost, at = heapq.heappop(heap)
            if at in known:
                continue
            known[at], here = cost, by_id[at]
            if here[3] == goal:
                return cost
            for a in arcs:
                if a[2] == here[3] and a[1] != here[1]:
                    delta = abs((a[6] - here[5] + 540) % 360 - 180)
                    heapq.heappush(heap, (cost + a[4] * factor.get(a[1], 1.0) + turn * (0 if delta < 30 else 2 if delta >= 150 else 1), a[0]))

    routes = {}
    for x in got:
        routes.setdefault((x.request, x.plan), []).append(x)
    for k, p, graph, start, goal in asked:
        steps = routes.get((k, p), [])
        want = plain(k, p, graph, start, goal) if graph != "no such" and start != goal else None
        assert (sum(x.spent for x in steps) if steps else None) == want
        if steps:
            assert steps[0].src == start and steps[-1].dst == goal and all(a.dst == b.src for a, b in zip(steps, steps[1:])) and [x.step for x in steps] == list(range(len(steps)))
    ends = {a[0]: a[3] for a in arcs}
    least = {}
    for x in overlay.labels(on, spark.createDataFrame([(0, 0, "turns", 0)], "request long, plan int, graph string, start long")).collect():
        least[ends[x.arc_id]] = min(least.get(ends[x.arc_id], 1e9), x.dist)
    dear.clear()
    assert all(least[goal] == plain(0, 0, "turns", 0, goal) for goal in range(1, 81) if goal in least)


def test_searches_near_each_other_leave_far_cells_alone(spark):
    """Paths in a box are those of the whole map, also of equally dear ways; a way that leaves the box is found, a closed place ends the search."""
    import random

    from roadlattice.operators import overlay

    r, width, height = random.Random(7), 4, 60
    arcs = []
    for n in range(width * height):
        for far, heading in ((n + 1, 90.0), (n + width, 0.0)):
            if (heading == 90.0 and n % width == width - 1) or far >= width * height or n // width == 20 < far // width:
                continue
            edge = len(arcs)
            arcs += [(2 * edge + back, edge, *((far, n) if back else (n, far)), r.randint(1, 2) * 1.0, heading + 180 * back, heading + 180 * back, None) for back in (0, 1)]
    frame = spark.createDataFrame(arcs, "arc_id long, edge_id long, src long, dst long, cost double, bearing_in double, bearing_out double, name string")
    nodes = spark.createDataFrame([(n, n % width // 2, n // width // 2) for n in range(width * height)], "node long, x long, y long")
    dear = spark.createDataFrame([(1, 0, a[1], 50.0) for a in arcs if a[5] == 90.0 and a[2] // width < 10], "request long, plan int, edge_id long, factor double")
    asked = spark.createDataFrame([(0, 0, "g", 0, 7), (1, 0, "g", 0, 3), (2, 0, "g", 1, 9)], "request long, plan int, graph string, start long, goal long")
    got = []
    for forced in (False, True):
        on = overlay.build({"g": (frame, 1.0), "unasked": (frame, 0.0)}, nodes)
        if forced:
            overlay._part(on, {"g"}, on.reach)
        got.append([tuple(x) for x in overlay.routes(on, asked, dear).orderBy("request", "step").collect()])
        boxes = [b for _, b, _ in on.parts]
        assert forced or (boxes[0] == (0, 0, 1, 3) and len(boxes) > 1 and all(known == {"g"} for known, *_ in on.parts))
    assert got[0] == got[1] and {x[0] for x in got[0]} == {0, 1, 2} and max(x[5] for x in got[0]) // width >= 10
    on = overlay.build({"g": (frame, 1.0)}, nodes)
    closed = spark.createDataFrame([(0, 0, "g", 84, 76), (1, 0, "g", 84, 92)], asked.schema)
    assert {x.request for x in overlay.routes(on, closed).collect()} == {1}


def test_costs_to_all_arcs_from_cells_merged_in_a_task(spark):
    """Costs to everywhere equal a plain search over arcs, also through other cells and back; costs across cells of level 0 are not kept."""
    import heapq
    import random

    from roadlattice.operators import overlay

    r, width, height = random.Random(11), 5, 50
    arcs = []
    for n in range(width * height):
        for far, heading in ((n + 1, 90.0), (n + width, 0.0)):
            # row 17 has one way through, row 40 none
            if (heading == 90.0 and n % width == width - 1) or far >= width * height or heading == 0.0 and (n // width == 17 and n % width != 4 or n // width == 40):
                continue
            edge = len(arcs)
            arcs.append((2 * edge, edge, n, far, r.randint(1, 40) / 4, heading, heading, r.choice(["A", "B", None])))
            if r.random() < 0.7:
                arcs.append((2 * edge + 1, edge, far, n, r.randint(1, 40) / 4, heading + 180, heading + 180, arcs[-1][7]))
    arcs.append((9001, 9000, 7, 7, 0.25, 90.0, 90.0, None))
    frame = spark.createDataFrame(arcs, "arc_id long, edge_id long, src long, dst long, cost double, bearing_in double, bearing_out double, name string")
    nodes = spark.createDataFrame([(n, n % width // 2, n // width // 2) for n in range(width * height)], "node long, x long, y long")
    on = overlay.build({"turns": (frame, 5.0), "plain": (frame, 0.0)}, nodes)
    assert on.top == 2
    asked = [(0, 0, "turns", 2), (0, 1, "plain", 2), (3, 0, "turns", 133), (4, 0, "turns", 248), (5, 0, "turns", 9999)]
    got = {}
    for x in overlay.labels(on, spark.createDataFrame(asked, "request long, plan int, graph string, start long")).collect():
        assert (x.request, x.plan, x.arc_id) not in got
        got[x.request, x.plan, x.arc_id] = x.dist
    by_id, want = {a[0]: a for a in arcs}, {}
    for k, p, graph, start in asked:
        heap = [(a[4], a[0]) for a in arcs if a[2] == start]
        while heap:
            cost, at = heapq.heappop(heap)
            if (k, p, at) in want:
                continue
            want[k, p, at], here = cost, by_id[at]
            for a in arcs:
                if a[2] == here[3] and a[1] != here[1]:
                    delta = abs((a[6] - here[5] + 540) % 360 - 180)
                    heapq.heappush(heap, (cost + a[4] + (5.0 if graph == "turns" else 0.0) * (0 if delta < 30 else 2 if delta >= 150 else 1), a[0]))
    assert got == want and {k for k, *_ in got} == {0, 3, 4}
    ((_, _, part),) = on.parts
    assert set(part.levels) == {1}


def test_rounds_over_all_states_are_those_over_lowered_ones(monkeypatch):
    """Costs and rounds do not depend on how many ways lead to a state."""
    import numpy as np

    from roadlattice.operators import overlay

    r = np.random.default_rng(3)
    for n, m in ((1, 0), (5, 0), (1, 3), (12, 30), (40, 120), (40, 90)):
        frm, dst, cost, seeds = r.integers(0, n, m), r.integers(0, n, m), r.choice([0.1, 0.7, 1.0, 2.0], m), np.full((3, n), np.inf)
        seeds[np.arange(3), r.integers(0, n, 3)] = 0.0
        found = []
        for few in (-1, 1000):
            monkeypatch.setattr(overlay, "FEW_WAYS", few)
            found.append(overlay.relaxed(n, frm, dst, cost, seeds, ranked=True))
        assert all(np.array_equal(a, b) for a, b in zip(*found))


def test_children_of_crossing_routes(spark):
    """All clean children with their sums, against plain loops; routes of two requests may have the same numbers."""
    import random

    from roadlattice.operators import recombine

    r = random.Random(2)
    rows = [(q, k, i, r.randrange(25), r.randint(100, 900), r.randint(1, 9)) for q in (0, 1) for k in (0, 1, 2) for i in range(14)]
    got = recombine.crossed(spark.createDataFrame(rows, "request long, route long, seq long, node long, len_m long, time long"), ["len_m", "time"]).collect()
    want = set()
    for q in (0, 1):
        path = {k: [x for x in rows if x[:2] == (q, k)] for k in (0, 1, 2)}
        first = {k: {n: next(i for i, x in enumerate(p) if x[3] == n) for n in {x[3] for x in p}} for k, p in path.items()}
        for a, b in ((0, 1), (0, 2), (1, 2)):
            met = sorted((first[a][n], first[b][n]) for n in first[a].keys() & first[b].keys())
            for i, (sa, sb) in enumerate(met):
                joins = lambda j, d: 0 <= j < len(met) and met[j] == (sa + d, sb + d)
                if joins(i - 1, -1) and joins(i + 1, 1):
                    continue
                for x, sx, y, sy in ((a, sa, b, sb), (b, sb, a, sa)):
                    head, tail = path[x][:sx], path[y][sy:]
                    if min(sum(s[4] for s in head), sum(s[4] for s in tail)) >= 1000 and not {s[3] for s in head} & {s[3] for s in tail[1:]}:
                        want.add((q, a, b, f"{x}:{sx}:{y}:{sy}", sum(s[4] for s in head + tail), sum(s[5] for s in head + tail)))
    assert len(want) > 4 and {(x.request, x.a, x.b, x.recipe, x.len_m, x.time) for x in got} == want and len(got) == len(want)
    recipes = spark.createDataFrame([(1, "c", 0, 2, 1, 12)], "request long, recipe string, prefix long, prefix_cut long, suffix long, suffix_cut long")
    made = recombine.spliced(spark.createDataFrame(rows, "request long, route long, seq long, node long, len_m long, time long"), recipes).orderBy("seq").collect()
    assert [x.node for x in made] == [x[3] for x in rows if x[:2] == (1, 0)][:2] + [x[3] for x in rows if x[:2] == (1, 1)][12:]


def test_labels_are_sorted_in_tasks_of_bounded_size(spark):
    df = spark.range(400).select((F.col("id") % 40).alias("node"), F.col("id").alias("label"), (F.col("id") * 7 % 31).alias("x"), (F.col("id") * 11 % 37).alias("y"))
    top = portfolio.top_labels(df, {"x": 1.0, "y": 2.0}, 3, rows_per_task=20)
    assert top.rdd.getNumPartitions() == 20
    order = lambda rows: [x[1] for x in rows]
    rows = [(k % 40, k, k * 7 % 31, k * 11 % 37) for k in range(400)]
    for n in (0, 17):
        own = [x for x in rows if x[0] == n]
        first = {min(own, key=lambda x: (x[2], x[1]))[1], min(own, key=lambda x: (x[3], x[1]))[1]}
        want = sorted(own, key=lambda x: (x[1] not in first, x[2] + 2.0 * x[3], x[1]))[:3]
        assert order(want) == [x.label for x in top.where(F.col("node") == n).orderBy("rank").collect()]


def test_road_blocks_close_the_nearest_edge_however_far(spark):
    edges = spark.createDataFrame([(1, -122.0, 47.0, -122.0, 47.001), (2, -121.0, 47.0, -121.0, 47.001), (3, -122.0001, 47.0, -122.0001, 47.001)], "edge_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    blocks = spark.createDataFrame([(1, -122.0, 47.0005), (2, -122.0145, 47.0005), (3, -100.0, 40.0)], "block_id long, lon double, lat double")
    got = sorted((r.block_id, r.edge_id, round(r.m)) for r in spatial.blocked_edges(blocks, edges).collect())
    assert [(b, e) for b, e, _ in got] == [(1, 1), (1, 3), (2, 3), (3, 2)] and 1080 < got[2][2] < 1120


def test_road_blocks_look_a_place_up_once(spark):
    """Copies of a place are looked up once, the nearest edge is found where cells are narrow, and a block at two places closes what is near both."""
    up = 390 / 110540
    edges = spark.createDataFrame([(1, 0.0, 47.0, 0.0, 47.001), (2, 0.0301, 85.0, 0.0301, 85.0001), (3, 0.0, 85.0 + up, 0.0001, 85.0 + up), (4, 5.0, 47.0, 5.0, 47.001)], "edge_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    rows = [(i, 0.0001, 47.0005) for i in range(50)] + [(50, 0.0001, 85.0), (51, 0.0001, 47.0005), (51, 5.0001, 47.0005), (52, 5.01, 47.0005), (52, 5.02, 47.0005), (53, None, 47.0)]
    looked = []
    cut, spatial.cut_lineage = spatial.cut_lineage, lambda df: looked.append(df.count()) or cut(df)
    try:
        got = sorted((r.block_id, r.edge_id) for r in spatial.blocked_edges(spark.createDataFrame(rows, "block_id long, lon double, lat double"), edges).collect())
    finally:
        spatial.cut_lineage = cut
    assert got == [(i, 1) for i in range(50)] + [(50, 2), (51, 1), (51, 4), (52, 4)]
    assert max(looked) == 5


def test_bags_keep_the_first_of_each_order_when_full(spark):
    """More parallel ways than a bag holds: eight stay, among them the best of each metric."""
    n = len(portfolio.LABEL)
    rows = [(1, 0, 1, k, 0, 1, *[float(1 if j == k else 20 + (k * 7 + j * 3) % 11) for j in range(n - 1)], 5.0) for k in range(n - 1)] + [(1, 0, 1, 100 + k, 0, 1, *[18.0 - k * 0.001] * (n - 1), 5.0) for k in range(6)]
    df = spark.createDataFrame(rows, "request long, src long, dst long, edge long, start long, goal long, " + ", ".join(f"{x} double" for x in portfolio.LABEL))
    got = {r.edges for r in portfolio.section_frontier(df).collect()}
    assert len(got) == 8 and "105" in got and {str(k) for k in (0, 1, 3, 4, 5, 6)} <= got
    kinds = {r.kind: r.rank for r in portfolio.frontier_choices(portfolio.section_frontier(df)).collect()}
    assert set(kinds) == {"practical", "safest", "caution", "gap", "non_trail", "ascent"}


def test_bounds_keep_costs_and_drop_labels(spark):
    """Over several blocks: the goal's cost and path stay, other labels go."""
    side = 14
    rows = [(y * side + x, v, float(3 + (x * 7 + y * 5) % 9)) for y in range(side) for x in range(side) for v in ([y * side + x + 1] if x < side - 1 else []) + ([(y + 1) * side + x] if y < side - 1 else [])]
    arcs = spark.createDataFrame(rows + [(v, u, c + 1) for u, v, c in rows], "src long, dst long, cost double")
    ends = spark.createDataFrame([(0, 20, 60), (1, 100, 5)], "request long, start long, goal long")
    goals, starts = ends.selectExpr("request", "goal AS node"), ends.selectExpr("request", "start AS node")
    exact = {(r.request, r.node): (r.dist, r.pred) for r in graph.distances(arcs, starts, block_nodes=40).collect()}
    bounds = graph.goal_bounds(arcs, goals, F.col("cost") * 0.8, block_nodes=40)
    some = {(r.request, r.node): (r.dist, r.pred) for r in graph.distances(arcs, starts, bounds=bounds, goals=goals, block_nodes=40).collect()}
    assert len(some) < 0.7 * len(exact)
    for request, node in ((0, 60), (1, 5)):
        while node is not None:
            assert some[request, node] == exact[request, node]
            node = exact[request, node][1]


def test_searches_with_goals_end_near_them(spark):
    """Along a strip of 300 rows, blocks far from the goals are left alone; goals' costs and paths are those of a search everywhere."""
    width, rows = 4, 300
    cost = lambda u: float(3 + u * 7 % 9)
    links = [(n, m, cost(n + m)) for n in range(width * rows) for m in ([n + 1] if n % width < width - 1 else []) + ([n + width] if n // width < rows - 1 else [])]
    arcs = spark.createDataFrame(links + [(v, u, c + 1) for u, v, c in links] + [(1300, 0, 1.0)], "src long, dst long, cost double")
    ends = spark.createDataFrame([(0, 600, 613), (1, 640, 622), (3, 601, 601)], "request long, start long, goal long")
    goals, starts = ends.selectExpr("request", "goal AS node"), ends.selectExpr("request", "start AS node")
    exact = {(r.request, r.node): (r.dist, r.pred) for r in graph.distances(arcs, starts).collect()}  # in one block
    whole = {(r.request, r.node): r.bound for r in graph.goal_bounds(arcs, goals, F.col("cost") * 0.6).collect()}
    bounds = graph.goal_bounds(arcs, goals, F.col("cost") * 0.6, starts=starts, block_nodes=16)
    near = {(r.request, r.node): r.bound for r in bounds.collect()}
    assert all(near.get((k, n), near[k, None]) <= b for (k, n), b in whole.items()) and len(near) < 300
    for some in (graph.distances(arcs, starts, goals=goals, margin=1.0, block_nodes=16), graph.distances(arcs, starts, bounds=bounds, goals=goals, block_nodes=16)):
        some = {(r.request, r.node): (r.dist, r.pred) for r in some.collect()}
        assert len(some) < 300 and some[3, 601] == (0.0, None)
        for request, node in ((0, 613), (1, 622)):
            while node is not None:
                assert some[request, node] == exact[request, node]
                node = exact[request, node][1]
    more = spark.createDataFrame([(0, 613), (0, 700), (1, 1300)], "request long, node long")  # the dearest goal counts; nothing leads to 1300
    some = {(r.request, r.node): (r.dist, r.pred) for r in graph.distances(arcs, starts, goals=more, margin=1.0).collect()}
    assert some[0, 613] == exact[0, 613] and some[0, 700] == exact[0, 700] and (1, 1300) not in some and (0, 1199) not in some and (1, 1199) in some
    assert (1, None) not in {(r.request, r.node) for r in graph.goal_bounds(arcs, more.where("request = 1"), F.col("cost"), starts=starts.where("request = 1")).collect()}


def test_paths_are_found_in_the_blocks_about_them(spark, monkeypatch):
    """Two searches on copies made once, on a strip of 75 blocks: few rounds, paths and penalties as in one block, nothing for a goal without arcs."""
    width, rows = 4, 300
    links = [(n, m) for n in range(width * rows) for m in ([n + 1] if n % width < width - 1 else []) + ([n + width] if n // width < rows - 1 else [])]
    arcs = spark.createDataFrame([(k, *((v, u) if back else (u, v)), float(3 + (u + v) * 7 % 9)) for k, (u, v) in enumerate(links) for back in (0, 1)], "edge_id long, src long, dst long, cost double")
    plans = spark.createDataFrame([(0, 0, "g", 600, 613), (0, 1, "g", 600, 613), (1, 0, "g", 640, 622)], "request long, plan int, graph string, start long, goal long")
    dear = spark.createDataFrame([(0, 1, k, 9.0) for k, (u, _) in enumerate(links) if u % 5 == 0], "request long, plan int, edge_id long, factor double")
    want = sorted(tuple(r) for r in generation.searched({"g": arcs}, plans, dear).collect())
    cut, calls = graph.cut_lineage, []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: calls.append(1) or cut(df))
    on = generation.copies({"g": arcs}, block_nodes=16)
    assert sorted(tuple(r) for r in generation.searched(on, plans, dear).collect()) == want and len(calls) < 60
    assert {r[:2] for r in want} == {(0, 0), (0, 1), (1, 0)} and [r[2:6] for r in want if r[:2] == (0, 0)] != [r[2:6] for r in want if r[:2] == (0, 1)]


def test_crossbred_children(spark):
    """A route good at first and one good at last meet half way: their child is made, better than both; a copy of the first adds none."""
    from roadlattice.operators import recombine

    added = {k: 0 for k in recombine.ADDED}
    row = lambda route, seq, edge, node, m, **more: (1, route, seq, edge, node, m, *(added | more).values())
    rows = [row(1, k, k, k, 600, time=100) for k in range(3)] + [row(1, 3 + k, 10 + k, 30 + k, 600, time=300, fail=600) for k in range(3)]
    rows += [row(2, k, 20 + k, 40 + k if k else 0, 600, time=300, fail=600) for k in range(3)] + [row(2, 3 + k, 40 + k, 30 if not k else 50 + k, 600, time=100) for k in range(3)]
    rows += [row(3, k, k, k, 600, time=100) for k in range(3)] + [row(3, 3 + k, 10 + k, 30 + k, 600, time=301, fail=600) for k in range(3)]
    schema = "request long, route long, seq long, edge_id long, node long, len_m long, " + ", ".join(f"{k} long" for k in added)
    df = spark.createDataFrame(rows, schema)
    paths, totals = recombine.crossbred(df.union(df.where("route <> 3").withColumn("request", F.lit(2).cast("long")).withColumn("route", F.col("route") + 10)))
    got = {(r.request, r.candidate): (r.time, r.fail, r.dist) for r in totals.collect()}
    assert got == {(1, "1:3:2:3"): (600, 0, 3600), (2, "11:3:12:3"): (600, 0, 3600)}
    assert [r.edge_id for r in paths.where("request = 1").orderBy("seq").collect()] == [0, 1, 2, 40, 41, 42]
    assert recombine.crossbred(df.where("route <> 2"))[1].count() == 0


def test_refined_ferries(spark):
    """Two land sections with a boat between: the failing one gets a way round, the good one and the boat stay."""
    #           edge, src, dst, len_m, fail level, ferry
    road = [(1, 0, 1, 1500, 4, False), (2, 1, 2, 3000, 1, True), (3, 2, 3, 1500, 1, False), (4, 0, 5, 900, 1, False), (5, 5, 1, 900, 1, False)]
    flags = {k: False for k in ("freeway", "mtb", "limited_access", "designated", "infra", "dismount")}
    rows = [(e, s, d, m, lv, b, m / 5, *flags.values(), 0, 0, 9) for e, s, d, m, lv, b in road]
    arcs = spark.createDataFrame(rows, "edge_id long, src long, dst long, len_m long, level int, ferry boolean, time_s double, " + ", ".join(f"{k} boolean" for k in flags) + ", facility int, hazard int, road_class int").withColumns({"cost": F.lit(1.0), "arc_id": F.col("edge_id")})
    paths = spark.createDataFrame([(7, 0, 0, 1, 0, 1), (7, 0, 1, 2, 1, 2), (7, 0, 2, 3, 2, 3), (8, 0, 0, 1, 0, 1)], "request long, plan int, step int, edge_id long, src long, dst long")
    careful = arcs.where("level < 4").withColumn("cost", F.col("len_m") * 1.0)
    find = lambda plans, dear=None: generation.searched({"discover_direct": careful, "discover_balanced": careful}, plans, dear, block_nodes=4)
    got = generation.refined_ferries(generation.measured_edges(paths, arcs), arcs, find).orderBy("step").collect()
    assert [(r.request, r.plan, r.step, r.edge_id) for r in got] == [(7, 100, 0, 4), (7, 100, 1, 5), (7, 100, 2, 2), (7, 100, 3, 3)]


def test_cut_lineage_forgets_estimated_sizes(spark):
    """Joins multiply estimated sizes; carried through a loop their digits double every round."""
    rows = graph.cut_lineage(spark.range(5).select("id", F.col("id").alias("up")))
    for _ in range(6):
        rows = graph.cut_lineage(rows.join(rows.select(F.col("id").alias("up"), F.col("up").alias("next")), "up").select("id", F.col("next").alias("up")))
    assert rows.count() == 5 and rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 64


def test_near_points_at_high_latitudes(spark):
    """Degrees of longitude shrink towards the pole, where points many cells apart are near each other."""
    left = spark.createDataFrame([(k, 10.0 + 0.07 * k, lat) for k, lat in enumerate((47.0, 75.0, 89.2, 89.9995))], "l_id long, lon double, lat double")
    right = left.select(F.col("l_id").alias("r_id"), (F.col("lon") + F.array(F.lit(0.004), F.lit(0.008), F.lit(0.13), F.lit(90.0))[F.col("l_id").cast("int")]).alias("r_lon"), F.col("lat").alias("r_lat"))
    got = {r.l_id: r.m for r in spatial.near_points(left, right, 250.0).where("l_id = r_id").collect()}
    assert set(got) == {1, 2, 3} and all(m <= 250 for m in got.values())


def test_growing_tables_are_not_broadcast(spark):
    from roadlattice.plans import catalog

    for name in ("terminal_proximity", "terminal_access", "urban_midpoint"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan, name


def test_sql_holds_past_the_pole_and_at_limits(spark, tmp_path):
    """Grids that go on past a pole, lines just at the limit of a designated route, and candidates of equal worth."""
    import duckdb

    from roadlattice.plans import catalog

    duckdb.sql(f"COPY (SELECT p_partkey + 1138000 * (p_partkey // 1000 % 2) + 19000 AS p_partkey, p_size FROM '/root/testdata/sf0.01/part.parquet') TO '{tmp_path}/part.parquet'")
    duckdb.sql(f"COPY (SELECT c_custkey + 249000 * i AS c_custkey, c_nationkey FROM range(8) r(i), '/root/testdata/sf0.01/customer.parquet') TO '{tmp_path}/customer.parquet'")
    for name in ("bearings_of_lines", "geo_functions", "on_designated_route", "reprojected_nodes", "portfolio_order"):
        got, db = catalog.queries()[name](spark, str(tmp_path)), duckdb.connect()
        for t in ("part", "customer"):
            db.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
        want = db.sql(catalog.oracle_sql()[name])
        key = lambda r: tuple(str(v + 0 if isinstance(v, float) else v) for v in r)
        assert sorted(map(key, got.select(want.columns).collect())) == sorted(map(key, want.fetchall())), name


def test_milepost_overlap_makes_no_pairs(spark):
    """Points, reversed intervals, touching ends and nulls as in the condition; the join's keys hold the milepost, not the route alone."""
    rnd = random.Random(3)
    pick = lambda: rnd.choice([None, *range(12)])
    rows = [(k, rnd.choice(["a", "b", None]), pick(), pick()) for k in range(400)]
    bars = [(rnd.choice(["a", "b", None]), pick(), pick()) for _ in range(6)]
    segs = spark.createDataFrame(rows, "seg long, route string, begin long, end long")
    got = spatial.milepost_overlap(segs, spark.createDataFrame(bars, "route string, begin long, end long"))
    hit = lambda r, q: None not in (*r[1:], *q) and r[1] == q[0] and r[2] < q[2] and r[3] > q[1]
    assert got.columns == segs.columns and sorted(r.seg for r in got.collect()) == [r[0] for r in rows if any(hit(r, q) for q in bars)]
    assert "[route#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", end#" in plan.split("SortMergeJoin")[-1].split("]")[0] + plan.split("BroadcastHashJoin")[-1].split("]")[0]


def test_overlap_compares_equal_routes_once(spark):
    """Routes of the same edges in any order, lengths that differ by route, a route alone; the pairs are those of all routes."""
    sets = {1: [(7, 10), (8, 20)], 2: [(8, 20), (7, 10)], 3: [(8, 25), (9, 5)], 4: [(7, 10), (8, 20)], 5: [(99, 1)], 6: [(8, 25), (9, 5)]}
    edges = spark.createDataFrame([(q, r, e, m) for q in (0, 1) for r, es in sets.items() for e, m in es], "request long, route long, edge_id long, len_m long")
    got = {(r.request, r.a, r.b): r.share for r in portfolio.overlap(edges).collect()}
    want = {}
    for a, b in ((a, b) for a in sets for b in sets if a < b):
        if common := [m for e, m in sets[a] if e in dict(sets[b])]:
            want |= {(q, a, b): sum(common) / min(sum(m for _, m in sets[a]), sum(m for _, m in sets[b])) for q in (0, 1)}
    assert got == want
    twelve = spark.range(400).selectExpr("0L AS request", "id % 40 AS route", "id div 40 AS edge_id", "5L AS len_m")
    rows = portfolio.overlap(twelve)
    assert rows.count() == 780
    assert "kind#" in rows._jdf.queryExecution().optimizedPlan().toString()


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: (out := cut(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    edges = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    assert graph.components(edges, spark.range(61).withColumnRenamed("id", "node")).where("component = 0").count() == 61
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_nearest_node_looks_a_place_up_once(spark):
    """Copies of a place do not multiply the pairs with the nodes about it, and every point has its row, also one without a place."""
    nodes = spark.createDataFrame([(1, 0.001, 0.0, True), (2, 0.002, 0.0, False), (3, 60.0, 0.0, False)], "node long, lon double, lat double, local boolean")
    rows = [(i, 0.0015, 0.0) for i in range(50)] + [(50, 60.001, 0.0), (51, None, 0.0)]
    points = spark.createDataFrame(rows, "point_id long, lon double, lat double")
    looked = []
    cut, spatial.cut_lineage = spatial.cut_lineage, lambda df: looked.append(df.count()) or cut(df)
    try:
        got = {r.point_id: r.node for r in spatial.nearest_node(points, nodes).collect()}
    finally:
        spatial.cut_lineage = cut
    assert got == {**{i: 1 for i in range(50)}, 50: 3, 51: None}
    assert max(looked) == 3


def test_span_match_deals_a_sample_once(spark):
    """A sample enters the join in its own cell only; cells about a segment are told once; doubled rows cover nothing twice."""
    km = 1000 / (111320 * math.cos(math.radians(47.6)))
    ways = spark.createDataFrame([(1, -122.0, 47.6, -122.0 + km, 47.6)] * 2, "way_id long, lon1 double, lat1 double, lon2 double, lat2 double")
    segs = [(k, -122.0 + a * km, 47.6 + n / 110540, -122.0 + b * km, 47.6 + n / 110540) for k, a, b, n in ((7, 0, 0.35, 3), (8, 0.4, 1, 9), (8, 0.4, 1, 9), (9, 0.4, 1, 17))]
    schema = "seg_id long, s_lon1 double, s_lat1 double, s_lon2 double, s_lat2 double"
    assert [tuple(r) for r in spatial.span_match(ways, spark.createDataFrame(segs, schema)).collect()] == [(1, 8, 3, 5)]
    about = spark.createDataFrame([segs[0]], schema).select(spatial.cells_about(F.col("s_lon1"), F.col("s_lat1"), F.col("s_lon2"), F.col("s_lat2"), 0.0005).alias("c")).first().c
    assert len(about) == len(set(about)) and len(about) % 3 == 0
