"""Turn-aware searches over levels of cells: costs across cells are found once, requests then touch few cells.

States are directed arcs, so that a change of direction can cost. The map is cut into square cells, eight by eight of which make a
cell of the next level. An arc that crosses the border of a cell is a way in or out of it; the least costs from every way in to
every way out of a cell are the arcs of the level above. A request adds an arc to its start and one from its goal and needs, on each
level, the cells of its two ends only; the path is then unpacked from the top, cell by cell. So the number of rounds follows the
levels, not the length of a path, every task holds one cell, and cells without the request are never read.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Cells of one level beside each other in a cell of the next.
FAN = 8
#: Coordinate of what lies outside every cell, and bits of a cell's second coordinate.
OUTSIDE, BITS = -(1 << 29), 31
#: Ways to a state up to which a round looks at all states.
FEW_WAYS = 16
#: Bits of a search's number below its request's.
PLAN_BITS = 6

_ROWS = "variant long, cell long, frm long, dst long, cost double, fx long, fy long, ux long, uy long"
_NAMES = ["variant", "cell", "frm", "dst", "cost", "fx", "fy", "ux", "uy"]
_KINDS = dict(zip(_NAMES, ("int64", "int64", "int64", "int64", "float64", "int64", "int64", "int64", "int64")))


def cell_of(x: Column, y: Column, level: int) -> Column:
    """The cell of a level that holds a place of level 0."""
    step = FAN**level
    return (F.floor(x / step) * (1 << BITS) + F.floor(y / step) + (1 << (BITS - 1))).cast("long")


def _cells(x: np.ndarray, y: np.ndarray, level: int) -> np.ndarray:
    step = FAN**level
    return (x // step << BITS) + y // step + (1 << (BITS - 1))


def relaxed(n: int, frm: np.ndarray, dst: np.ndarray, cost: np.ndarray, seeds: np.ndarray, ranked: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Least costs of n states from each row of seeds and, if ranked, the round in which each got its last value. A round lowers all
    states behind those that the last one lowered, until nothing changes."""
    dist = np.ascontiguousarray(seeds.T)
    rank = np.where(np.isfinite(dist), 0, -1) if ranked else None
    if np.bincount(dst, minlength=n).max(initial=0) <= FEW_WAYS:
        return _relaxed_all(n, frm, dst, cost, dist, rank)
    order = np.argsort(dst, kind="stable")
    f, d, w = frm[order], dst[order], cost[order][:, None]
    lowered, k = np.isfinite(dist).any(axis=1), 0
    while True:
        k += 1
        live = np.flatnonzero(lowered[f])
        if not len(live):
            return dist.T, rank.T if ranked else None
        to = d[live]
        first = np.concatenate([[0], np.flatnonzero(to[1:] != to[:-1]) + 1])
        heads = to[first]
        new = np.minimum.reduceat(dist[f[live]] + w[live], first, axis=0)
        old = dist[heads]
        lower = new < old
        if ranked:
            rank[heads] = np.where(lower, k, rank[heads])
        dist[heads] = np.where(lower, new, old)
        lowered = np.zeros(n, bool)
        lowered[heads[lower.any(axis=1)]] = True


def _relaxed_all(n: int, frm: np.ndarray, dst: np.ndarray, cost: np.ndarray, dist: np.ndarray, rank: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """As relaxed, where few ways lead to any state: a round takes every state's first way, then all second ones, and so on. States with
    more ways come first, so the k-th ways lead to the first states."""
    ways = np.bincount(dst, minlength=n)
    place = np.argsort(-ways, kind="stable")
    spot = np.empty(n, np.int64)
    spot[place] = np.arange(n)
    order = np.argsort(spot[dst], kind="stable")
    f, d, w = spot[frm[order]], spot[dst[order]], cost[order]
    nth = np.arange(len(d)) - np.searchsorted(d, d)
    turns = [(f[nth == j], w[nth == j][:, None]) for j in range(ways.max(initial=0))]
    dist, rank = dist[place], None if rank is None else rank[place]
    have, k = dist[: np.count_nonzero(ways)], 0
    while turns:
        k += 1
        new = dist[turns[0][0]] + turns[0][1]
        for at, more in turns[1:]:
            np.minimum(new[: len(at)], dist[at] + more, out=new[: len(at)])
        lower = new < have
        if not lower.any():
            break
        if rank is not None:
            rank[: len(new)][lower] = k
        np.minimum(have, new, out=have)
    return dist[spot].T, None if rank is None else rank[spot].T


def _numbered(*columns: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    states, codes = np.unique(np.concatenate(columns), return_inverse=True)
    return states, np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def _transitions(arcs: pd.DataFrame, cell: int, level: int = 0) -> pd.DataFrame:
    """frm, dst, cost of a cell of a part's base level: every arc that ends in it before every arc that begins at that node, but for the
    way back on the same edge. The cost is the second arc's and that of the turn; x and y are the node's cell of level 0."""
    ends, begins = arcs.loc[_cells(arcs["ux"].to_numpy(), arcs["uy"].to_numpy(), level) == cell], arcs.loc[_cells(arcs["fx"].to_numpy(), arcs["fy"].to_numpy(), level) == cell]
    ends = ends.assign(x=ends["ux"], y=ends["uy"])
    t = ends[["arc", "edge_id", "node_to", "bearing_in", "name", "fx", "fy", "x", "y"]].merge(begins[["arc", "edge_id", "node_from", "bearing_out", "name", "cost", "turn", "ux", "uy"]], left_on="node_to", right_on="node_from", suffixes=("", "_o"))
    t = t.loc[(t["edge_id"] != t["edge_id_o"]) & ((t["arc"] >= 0) | (t["arc_o"] >= 0) | (t["arc"] // 2 == t["arc_o"] // 2))]
    delta = ((t["bearing_out"] - t["bearing_in"] + 180) % 360 - 180).abs().to_numpy(np.float64)
    same = ((t["name"] == t["name_o"]) & (t["name"] != "")).to_numpy()
    share = np.select([np.isnan(delta) | (delta < 30) | same & (delta < 70), delta >= 150, delta < 55], [0.0, 2.0, 0.65], 1.0)
    return pd.DataFrame({"frm": t["arc"], "dst": t["arc_o"], "cost": t["cost"] + t["turn"].fillna(0.0) * share, "fx": t["fx"], "fy": t["fy"], "ux": t["ux"], "uy": t["uy"], "x": t["x"], "y": t["y"]}).astype({k: v for k, v in _KINDS.items() if k not in ("variant", "cell")})


def _across(rows: pd.DataFrame, variant: int, cell: int, level: int, chosen: str) -> pd.DataFrame:
    """Least costs through a cell: from every way in to every way out ("all"), or only from starts and to goals ("own")."""
    states, (f, d) = _numbered(rows["frm"].to_numpy(), rows["dst"].to_numpy())
    n = len(states)
    from_x, from_y, to_x, to_y = (np.full(n, OUTSIDE) for _ in range(4))
    from_x[f], from_y[f], to_x[d], to_y[d] = rows["fx"], rows["fy"], rows["ux"], rows["uy"]
    way_in, way_out = np.zeros(n, bool), np.zeros(n, bool)
    way_in[f], way_out[d] = True, True
    way_in &= _cells(from_x, from_y, level) != cell
    way_out &= _cells(to_x, to_y, level) != cell
    cost, out = rows["cost"].to_numpy(), []

    def seeded(at):
        seeds = np.full((len(at), n), np.inf)
        seeds[np.arange(len(at)), at] = 0.0
        return seeds

    def add(a, b, c):
        ok = np.isfinite(c)
        a, b, c = a[ok], b[ok], c[ok]
        out.append(pd.DataFrame({"variant": variant, "cell": cell, "frm": states[a], "dst": states[b], "cost": c, "fx": from_x[a], "fy": from_y[a], "ux": to_x[b], "uy": to_y[b]}))

    starts = np.flatnonzero(way_in & (states < 0)) if chosen == "own" else np.flatnonzero(way_in & (states >= 0))
    exits = np.flatnonzero(way_out)
    for k in range(0, len(starts), 64):
        some = starts[k : k + 64]
        dist, _ = relaxed(n, f, d, cost, seeded(some))
        a, b = np.repeat(some, len(exits)), np.tile(exits, len(some))
        value = dist[:, exits].ravel()
        mine = (states[b] >= 0) | (states[a] // 2 == states[b] // 2) if chosen == "own" else states[b] >= 0
        add(a[mine], b[mine], value[mine])
    if chosen == "own":
        goals, entries = np.flatnonzero(way_out & (states < 0)), np.flatnonzero(way_in & (states >= 0))
        for k in range(0, len(goals), 64):
            some = goals[k : k + 64]
            dist, _ = relaxed(n, d, f, cost, seeded(some))  # backwards
            add(np.tile(entries, len(some)), np.repeat(some, len(entries)), dist[:, entries].ravel())
    return (pd.concat(out) if out else pd.DataFrame(columns=_NAMES)).astype(_KINDS)


def _joined(a: tuple, b: tuple) -> tuple:
    """(ways in, ways out, least costs from each to each) of two places beside each other as one. The ways from one into the other are
    taken out one after the other: what passes through one costs what it takes to it and from it on."""
    ins, outs = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    cost = np.full((len(ins), len(outs)), np.inf)
    cost[: len(a[0]), : len(a[1])], cost[len(a[0]) :, len(a[1]) :] = a[2], b[2]
    _, row, col = np.intersect1d(ins, outs, assume_unique=True, return_indices=True)
    through = np.empty_like(cost)
    for i, j in zip(row.tolist(), col.tolist()):
        np.minimum(cost, np.add.outer(cost[:, j], cost[i], out=through), out=cost)
    row, col = np.delete(np.arange(len(ins)), row), np.delete(np.arange(len(outs)), col)
    return ins[row], outs[col], cost[np.ix_(row, col)]


def _merged(places: dict[tuple[int, int], tuple]) -> tuple:
    """Places by x and y as one: the two halves of the longer side are merged by themselves first, so that few ways lie between them."""
    if len(places) == 1:
        return next(iter(places.values()))
    xs, ys = (sorted({at[k] for at in places}) for k in (0, 1))
    k = int(ys[-1] - ys[0] > xs[-1] - xs[0])
    middle = (xs, ys)[k][len((xs, ys)[k]) // 2]
    return _joined(_merged({at: v for at, v in places.items() if at[k] < middle}), _merged({at: v for at, v in places.items() if at[k] >= middle}))


def _crossed(rows: pd.DataFrame, x: int, y: int) -> tuple:
    """(ways in, ways out, least costs from each to each) of a cell of level 0, from its transitions."""
    states, (f, d) = _numbered(rows["frm"].to_numpy(), rows["dst"].to_numpy())
    starts = np.unique(f[(rows["fx"].to_numpy() != x) | (rows["fy"].to_numpy() != y)])
    exits = np.unique(d[(rows["ux"].to_numpy() != x) | (rows["uy"].to_numpy() != y)])
    cost, out = rows["cost"].to_numpy(), [np.empty((0, len(exits)))]
    for k in range(0, len(starts), 64):
        some = starts[k : k + 64]
        seeds = np.full((len(some), len(states)), np.inf)
        seeds[np.arange(len(some)), some] = 0.0
        out.append(relaxed(len(states), f, d, cost, seeds)[0][:, exits])
    return states[starts], states[exits], np.concatenate(out)


def _at(keys: np.ndarray, rows: pd.DataFrame, by: str, *columns: str) -> list[np.ndarray]:
    """Columns of any row of each key."""
    known, first = np.unique(rows[by].to_numpy(), return_index=True)
    i = first[np.searchsorted(known, keys)]
    return [rows[c].to_numpy()[i] for c in columns]


def _across_merged(rows: pd.DataFrame, variant: int, cell: int, level: int) -> pd.DataFrame:
    """As _across for all ways: the cells of level 0, or those of the level below, are merged in pairs."""
    places = {}
    if "sub" in rows:
        for k, own in rows.groupby("sub", sort=False):
            ins, f = np.unique(own["frm"].to_numpy(), return_inverse=True)
            outs, d = np.unique(own["dst"].to_numpy(), return_inverse=True)
            cost = np.full((len(ins), len(outs)), np.inf)
            cost[f, d] = own["cost"].to_numpy()
            places[k >> BITS, (k & ((1 << BITS) - 1)) - (1 << (BITS - 1))] = ins, outs, cost
    else:
        for at, own in rows.groupby(["x", "y"], sort=False):
            places[at] = _crossed(own, *at)
    if not places:
        return pd.DataFrame(columns=_NAMES).astype(_KINDS)
    ins, outs, cost = _merged(places)
    fx, fy = _at(ins, rows, "frm", "fx", "fy")
    ux, uy = _at(outs, rows, "dst", "ux", "uy")
    a, b = np.nonzero(np.isfinite(cost) & (_cells(fx, fy, level) != cell)[:, None] & (_cells(ux, uy, level) != cell))
    return pd.DataFrame({"variant": variant, "cell": cell, "frm": ins[a], "dst": outs[b], "cost": cost[a, b], "fx": fx[a], "fy": fy[a], "ux": ux[b], "uy": uy[b]}).astype(_KINDS)


def _unpacked(rows: pd.DataFrame, hops: pd.DataFrame) -> list[tuple]:
    """(key, place, frm, dst, cost, sub) of the steps that make up each hop, in order. Of equally dear steps the least state's counts."""
    states, (f, d) = _numbered(rows["frm"].to_numpy(), rows["dst"].to_numpy())
    at = {s: i for i, s in enumerate(states.tolist())}
    cost, sub = rows["cost"].to_numpy(), rows["sub"].to_numpy() if "sub" in rows else np.zeros(len(rows), np.int64)
    order = np.lexsort((f, d))
    first = np.searchsorted(d[order], np.arange(len(states) + 1))
    out = []
    for frm, own in hops.groupby("frm", sort=True):
        if frm not in at:
            continue
        seeds = np.full((1, len(states)), np.inf)
        seeds[0, at[frm]] = 0.0
        (dist,), (rank,) = relaxed(len(states), f, d, cost, seeds, ranked=True)
        for key, place, dst in zip(own["key"], own["place"], own["dst"]):
            steps, s = [], at.get(dst)
            if s is None or rank[s] < 0:
                continue
            while s != at[frm]:
                into = order[first[s] : first[s + 1]]
                i = int(into[np.flatnonzero((rank[f[into]] >= 0) & (rank[f[into]] < rank[s]) & (dist[f[into]] + cost[into] == dist[s]))[0]])
                steps.append(i)
                s = int(f[i])
            out += [(key, [*place, k], int(states[f[i]]), int(states[d[i]]), float(cost[i]), int(sub[i])) for k, i in enumerate(reversed(steps))]
    return out


def _frame(steps: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(steps, columns=["key", "place", "frm", "dst", "cost", "cell"]).astype({"key": "int64", "frm": "int64", "dst": "int64", "cost": "float64", "cell": "int64"})


_STEPS = "key long, place array<int>, frm long, dst long, cost double, cell long"
_ARCS = ["variant", "cell", "arc", "edge_id", "node_from", "node_to", "cost", "bearing_in", "bearing_out", "name", "turn", "fx", "fy", "ux", "uy"]


@dataclass
class Part:
    """Arcs of some graphs by cell of the base level, in a box of cells or the whole map, and for each level from there the least costs
    across its cells: tables in the shared folder, for any number of searches. Ways out of the box end OUTSIDE; ways into it are left out."""

    arcs: DataFrame
    nodes: DataFrame
    graphs: list[str]
    top: int
    whole: bool
    base: int = 0
    levels: dict[int, DataFrame] = field(default_factory=dict)


#: x and y of the least and the greatest cell of a box.
Box = tuple[int, int, int, int]


@dataclass
class Overlay:
    """Graphs and the places of their nodes. A part is cut into cells once a search asks for it."""

    frames: dict[str, tuple[DataFrame, float]]
    nodes: DataFrame
    top: int
    reach: Box
    parts: list[tuple[set[str], Box, Part]] = field(default_factory=list)


#: Cells of a box up to which its nodes are broadcast, and by how much a box's margin grows where a search may leave it.
NEAR_CELLS, WIDER = 1024, 4


def build(graphs: dict[str, tuple[DataFrame, float]], nodes: DataFrame) -> Overlay:
    """graphs gives by name arcs(arc_id >= 0, edge_id, src, dst, cost > 0, bearing_in, bearing_out, name) and the seconds of a turn (see
    costs.turn_cost; 0 for a search without turns); nodes(node, x, y) the cell of level 0 of every node, as whole numbers from 0.

    A cell of level 0 should hold some hundred nodes. One task searches a cell; its table grows with the square of the arcs that cross
    the cell's border, which on road maps grow with the square root of its nodes. Null names are no names; null bearings make no turns.
    Arcs at unknown nodes are left out. The graphs are read when searches ask for cells, so they should be stored tables.
    """
    place = stored(nodes.select(F.col("node").cast("long").alias("node"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")), "overlay-nodes")
    reach = place.agg(F.max("x"), F.max("y")).first()
    reach = (0, 0, reach[0] or 0, reach[1] or 0)
    top = 0
    while FAN**top <= max(reach):
        top += 1
    return Overlay(graphs, place, top, reach)


def _part(overlay: Overlay, names: set[str], box: Box, base: int = 0) -> Part:
    """The named graphs in a box, or a part that is there and holds both."""
    for known, b, part in overlay.parts:
        if part.base == base and names <= known and b[0] <= box[0] and b[1] <= box[1] and b[2] >= box[2] and b[3] >= box[3]:
            return part
    whole, near = box == overlay.reach, overlay.nodes
    if not whole:
        near = stored(near.where(F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])), "overlay-near")
    arcs = None
    for i, (name, (frame, turn)) in enumerate(overlay.frames.items()):
        if name not in names:
            continue
        part = frame.select(
            F.lit(-1 - i).cast("long").alias("variant"), F.col("arc_id").cast("long").alias("arc"), F.col("edge_id").cast("long").alias("edge_id"), F.col("src").cast("long").alias("node_from"), F.col("dst").cast("long").alias("node_to"),
            F.col("cost").cast("double").alias("cost"), F.col("bearing_in").cast("double").alias("bearing_in"), F.col("bearing_out").cast("double").alias("bearing_out"), F.coalesce("name", F.lit("")).alias("name"), F.lit(float(turn)).alias("turn"),
        )
        arcs = part if arcs is None else arcs.union(part)
    few = not whole and (box[2] - box[0] + 1) * (box[3] - box[1] + 1) <= NEAR_CELLS
    side = F.broadcast(near) if few else near
    ends = arcs.join(side.toDF("node_from", "fx", "fy"), "node_from").join(side.toDF("node_to", "ux", "uy"), "node_to", "inner" if whole else "left")
    own, other = cell_of(F.col("fx"), F.col("fy"), base), cell_of(F.col("ux"), F.col("uy"), base)
    cells = F.array_distinct(F.when(F.col("ux").isNull(), F.array(own)).otherwise(F.array(own, other)))
    ends = ends.withColumn("cell", F.explode(cells)).withColumns({c: F.coalesce(c, F.lit(OUTSIDE).cast("long")) for c in ("ux", "uy")})
    found = Part(stored(ends.select(_ARCS), "overlay-arcs"), near, list(overlay.frames), overlay.top, whole, base)
    for level in range(base, overlay.top):
        found.levels[level] = _cliques(found.arcs if level == base else _up(found.levels[level - 1]), level, base)
    overlay.parts.append((set(names), box, found))
    return found


def _cliques(rows: DataFrame, level: int, base: int = 0) -> DataFrame:
    """Costs across every (variant, cell) in rows, which are arcs at the base level and else costs across the cells below."""

    def cell(key, part):
        inside = part if level > base else _transitions(part, key[1], base)
        return _across_merged(inside, int(key[0]), int(key[1]), level) if base else _across(inside, int(key[0]), int(key[1]), level, "all")

    return stored(_dealt(rows).applyInPandas(cell, _ROWS), f"overlay-{level}")


def _up(rows: DataFrame) -> DataFrame:
    """Rows of a level's cells under the cell above, with their own as sub."""
    x, y = F.shiftright("cell", BITS), F.col("cell").bitwiseAND((1 << BITS) - 1) - (1 << (BITS - 1))
    return rows.withColumn("sub", F.col("cell")).withColumn("cell", (F.floor(x / FAN) * (1 << BITS) + F.floor(y / FAN) + (1 << (BITS - 1))).cast("long"))


@dataclass
class Search:
    """Plans on an overlay. Where penalties change a cell for a plan, the plan has that cell's costs of its own on every level."""

    overlay: Part
    plans: DataFrame  # key, variant (the graph's), start, goal and their places
    raised: list[DataFrame] | None = None  # of each level: variant (the plan's), graph, cell
    arcs: DataFrame | None = None
    levels: list[DataFrame] = field(default_factory=list)
    ends: list[DataFrame] = field(default_factory=list)  # of each level: costs from starts and to goals

    def variants(self, cells: DataFrame, level: int) -> DataFrame:
        """(key, graph, cell, ...) -> with variant: the plan's number where it has that cell for itself, else the graph's."""
        if self.raised is None:
            return cells.withColumn("variant", F.col("graph"))
        r = self.raised[level].select(F.col("variant").alias("key"), "cell", F.lit(True).alias("own"))
        return cells.join(r, ["key", "cell"], "left").withColumn("variant", F.when(F.col("own"), F.col("key")).otherwise(F.col("graph"))).drop("own")

    def inside(self, wanted: DataFrame, level: int) -> DataFrame:
        """The rows of wanted (variant, graph, cell) of a level: arcs at the base level, else costs across the cells below (with sub)."""
        wanted = _fresh(wanted.select("variant", "graph", "cell").distinct())
        base = _fresh(self.overlay.arcs if level == self.overlay.base else _up(self.overlay.levels[level - 1])).withColumnRenamed("variant", "graph")
        rows = base.join(wanted, ["graph", "cell"])
        if self.raised is None:
            return rows
        below = self.raised[level if not level else level - 1]
        own = self.arcs if not level else _up(self.levels[level - 1])
        taken = below.select("variant", F.col("cell").alias("cell" if not level else "sub"))
        rows = rows.join(taken, taken.columns, "left_anti")
        return rows.unionByName(_fresh(own).join(_fresh(wanted), ["variant", "cell"]).select(rows.columns))


def _dealt(df: DataFrame):
    """Grouped by cell over as many tasks as shuffles have: small tables make much work here, so they are not put together."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "variant", "cell").groupBy("variant", "cell")


def _fresh(df: DataFrame) -> DataFrame:
    """The same rows under columns of their own, for joins of a table with what was made of it."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _virtual(plans: DataFrame, base: int = 0) -> DataFrame:
    """The arcs that requests add: to each start from outside, and from each goal to outside, with their cell of the base level."""
    none, out = F.lit(None).cast("double"), F.lit(OUTSIDE).cast("long")
    common = [none.alias("bearing_in"), none.alias("bearing_out"), F.lit("").alias("name"), F.lit(0.0).alias("turn")]
    start = plans.select("key", "graph", cell_of(F.col("sx"), F.col("sy"), base).alias("cell"), (-2 * (F.col("key") + 1)).alias("arc"), F.lit(-1).cast("long").alias("edge_id"), out.alias("node_from"), F.col("start").alias("node_to"), F.lit(0.0).alias("cost"), *common, out.alias("fx"), out.alias("fy"), F.col("sx").alias("ux"), F.col("sy").alias("uy"))
    goal = plans.where("tx is not null").select("key", "graph", cell_of(F.col("tx"), F.col("ty"), base).alias("cell"), (1 - 2 * (F.col("key") + 1)).alias("arc"), F.lit(-2).cast("long").alias("edge_id"), F.col("goal").alias("node_from"), out.alias("node_to"), F.lit(0.0).alias("cost"), *common, F.col("tx").alias("fx"), F.col("ty").alias("fy"), out.alias("ux"), out.alias("uy"))
    return start.union(goal)


def prepare(overlay: Part, plans: DataFrame, penalties: DataFrame | None = None) -> Search:
    """plans(request, plan 0 to 63, graph, start, goal) and penalties(request, plan, edge_id, factor > 0) on an overlay. Plans that name
    an unknown graph or node have no path. A goal may be null, for searches to everywhere. ``overlay`` is the part that is searched."""
    key = (F.col("request") * (1 << PLAN_BITS) + F.col("plan")).cast("long")
    graph = F.lit(None).cast("long")
    for i, name in enumerate(overlay.graphs):
        graph = F.when(F.col("graph") == name, F.lit(-1 - i)).otherwise(graph)
    keyed = plans.select(key.alias("key"), graph.cast("long").alias("graph"), F.col("start").cast("long").alias("start"), F.col("goal").cast("long").alias("goal")).where("graph is not null")
    placed = keyed.join(overlay.nodes.toDF("start", "sx", "sy"), "start").join(overlay.nodes.toDF("goal", "tx", "ty"), "goal", "left")
    search = Search(overlay, stored(placed, "plans"))
    if penalties is not None:
        dear = penalties.select(key.alias("key"), "edge_id", F.col("factor").cast("double").alias("factor")).join(search.plans.select("key", "graph"), "key").groupBy("key", "graph", "edge_id").agg(F.max("factor").alias("factor"))
        dear = stored(dear, "penalties")
        cells = overlay.arcs.withColumnRenamed("variant", "graph").join(dear, ["graph", "edge_id"]).select(F.col("key").alias("variant"), "graph", "cell").distinct()
        search.raised = [stored(cells, "raised")]
        for _ in range(overlay.top):
            search.raised.append(_up(search.raised[-1]).drop("sub").distinct())
        own = overlay.arcs.withColumnRenamed("variant", "graph").join(search.raised[0], ["graph", "cell"]).join(dear.select(F.col("key").alias("variant"), "edge_id", "factor"), ["variant", "edge_id"], "left")
        search.arcs = stored(own.withColumn("cost", F.col("cost") * F.coalesce("factor", F.lit(1.0))).select(_ARCS), "raised-arcs")
        for level in range(overlay.top):
            search.levels.append(_cliques(search.inside(search.raised[level], level) if level else search.arcs, level))
    return search


def _owners(rows: DataFrame, search: Search) -> DataFrame:
    """Rows of requests' own states with key and graph."""
    own = F.when(F.col("frm") < 0, F.col("frm")).otherwise(F.col("dst"))
    return rows.withColumn("key", (-F.floor(own / 2) - 1).cast("long")).join(F.broadcast(search.plans.select("key", "graph")), "key")


def _ends_task(level: int, base: int):
    def cell(key, part, added):
        rows = pd.concat([part, added], ignore_index=True) if len(part) else added
        return _across(rows if level > base else _transitions(rows, int(key[1]), base), int(key[0]), int(key[1]), level, "own")

    return cell


def _hops_task(level: int):
    def cell(key, part, own):
        if not len(own) or not len(part):
            return _frame([])
        return _frame(_unpacked(part if level else _transitions(part, int(key[1])), own))

    return cell


def _labels_task(level: int, base: int):
    def cell(key, part, own):
        return _spread(part if level > base or not len(part) else _transitions(part, int(key[1]), base), own)

    return cell


def _reach(search: Search) -> None:
    """Costs from starts and to goals across the cells that hold them, up to the level below the top."""
    base = search.overlay.base
    virtual = search.variants(_virtual(search.plans, base), base)
    for level in range(base, search.overlay.top):
        own = virtual if level == base else search.variants(_owners(_up(search.ends[-1]).drop("variant"), search), level)
        rows = search.inside(own, level)

        columns = [c for c in rows.columns if c not in ("graph", "sub")]
        search.ends.append(stored(_dealt(rows.select(columns)).cogroup(_dealt(_fresh(own).select(columns))).applyInPandas(_ends_task(level, base), _ROWS), f"ends-{level}"))


def _needed(search: Search, hops: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the cells in which hops of a level lie, and the hops with their variants."""
    hops = search.variants(hops, level)
    base = search.inside(hops, level)
    if level:
        added = search.variants(_owners(_up(search.ends[level - 1]).drop("variant"), search), level)
    else:
        added = search.variants(_virtual(search.plans), 0)
    columns = [c for c in base.columns if c != "graph"]
    return base.select(columns).union(added.select(columns).join(F.broadcast(hops.select("variant", "cell").distinct()), ["variant", "cell"], "left_semi").select(columns)), hops


def _bounds(rows: pd.DataFrame, hops: pd.DataFrame) -> pd.DataFrame:
    """(key, cost, away) of each hop: its least cost, and that of leaving the box; infinite where there is no way."""
    states, (f, d) = _numbered(rows["frm"].to_numpy(), rows["dst"].to_numpy())
    at = {s: i for i, s in enumerate(states.tolist())}
    leaves = np.zeros(len(states), bool)
    leaves[d[rows["ux"].to_numpy() == OUTSIDE]] = True
    leaves &= states >= 0
    out = []
    for frm, own in hops.groupby("frm", sort=True):
        dist = np.full(len(states), np.inf)
        if frm in at:
            seeds = np.full((1, len(states)), np.inf)
            seeds[0, at[frm]] = 0.0
            (dist,), _ = relaxed(len(states), f, d, rows["cost"].to_numpy(), seeds)
        away = dist[leaves].min(initial=np.inf)
        out += [(key, dist[at[dst]] if dst in at else np.inf, away) for key, dst in zip(own["key"], own["dst"])]
    return pd.DataFrame(out, columns=["key", "cost", "away"]).astype({"key": "int64", "cost": "float64", "away": "float64"})


def _bounds_task(level: int):
    def cell(key, part, own):
        return _bounds(part if level or not len(part) else _transitions(part, int(key[1])), own)

    return cell


def _sure(search: Search, hops: DataFrame, cap: float | None) -> DataFrame:
    """(key) of the plans whose way cannot leave the box: leaving it costs as much already as the whole way inside, or as much as the cap."""
    rows, hops = _needed(search, hops, search.overlay.top)
    found = _dealt(rows).cogroup(_dealt(hops.select("variant", "cell", "key", "frm", "dst"))).applyInPandas(_bounds_task(search.overlay.top), "key long, cost double, away double")
    most = F.col("cost") if cap is None else F.least("cost", F.lit(float(cap)))
    return stored(found.where(most <= F.col("away")).select("key"), "sure")


def routes(overlay: Overlay, plans: DataFrame, penalties: DataFrame | None = None, cap: float | None = None) -> DataFrame:
    """The least-cost path of every plan: (request, plan, step, arc_id, edge_id, src, dst, cost, spent), steps from 0.

    cost is the arc's own, times the plan's factor; spent also holds the turn before it, so its sum is the path's least cost. A plan
    whose goal is not reached gives no rows, nor does one whose start is its goal. Of equally dear ways the choice follows the arcs'
    numbers and the cells, so it is the same every time. Penalties of one plan leave the others' cells as they are. Paths dearer than ``cap`` are left out.

    The plans are searched in a box about all their ends first. A plan is done if the cheapest way out of the box costs it no less than
    its path inside, so that every way that leaves the box is dearer; the others are searched in wider boxes, up to the whole map.
    """
    at = lambda end, x, y: overlay.nodes.toDF(end, x, y)
    asked = plans.where("start <> goal").where(F.col("graph").isin(list(overlay.frames))).select("request", "plan", "graph", F.col("start").cast("long").alias("start"), F.col("goal").cast("long").alias("goal"))
    todo = stored(asked.join(at("start", "sx", "sy"), "start").join(at("goal", "tx", "ty"), "goal"), "asked")
    out, margin, key = None, None, (F.col("request") * (1 << PLAN_BITS) + F.col("plan")).cast("long")
    while True:
        ends = [F.min(F.least("sx", "tx")), F.min(F.least("sy", "ty")), F.max(F.greatest("sx", "tx")), F.max(F.greatest("sy", "ty"))]
        spread = todo.groupBy("graph").agg(*ends).collect()  # a row for each graph
        if not spread:
            break
        x0, y0, x1, y1 = min(r[1] for r in spread), min(r[2] for r in spread), max(r[3] for r in spread), max(r[4] for r in spread)
        margin = margin * WIDER if margin else max(x1 - x0, y1 - y0) + 1
        box = (max(x0 - margin, 0), max(y0 - margin, 0), min(x1 + margin, overlay.reach[2]), min(y1 + margin, overlay.reach[3]))
        part = _part(overlay, {r["graph"] for r in spread}, box)
        search = prepare(part, todo, penalties)
        _reach(search)
        hops = search.plans.select("key", "graph", F.array().cast("array<int>").alias("place"), (-2 * (F.col("key") + 1)).alias("frm"), (1 - 2 * (F.col("key") + 1)).alias("dst"), cell_of(F.lit(0), F.lit(0), overlay.top).alias("cell"))
        sure = None if part.whole else _sure(search, hops, cap)
        found = _walked(search, hops if sure is None else hops.join(sure, "key", "left_semi"), penalties, cap)
        out = found if out is None else out.union(found)
        if sure is None:
            break
        todo = stored(todo.withColumn("key", key).join(sure, "key", "left_anti").drop("key"), "asked")
    return out if out is not None else todo.sparkSession.createDataFrame([], _ROUTES)


_ROUTES = "request long, plan int, step int, arc_id long, edge_id long, src long, dst long, cost double, spent double"


def _walked(search: Search, hops: DataFrame, penalties: DataFrame | None, cap: float | None) -> DataFrame:
    """The paths of hops at the top, unpacked level by level."""
    for level in range(search.overlay.top, -1, -1):
        rows, hops = _needed(search, hops, level)
        steps = stored(_dealt(rows).cogroup(_dealt(hops.select("variant", "cell", "key", "place", "frm", "dst"))).applyInPandas(_hops_task(level), _STEPS), f"hops-{level}")
        hops = steps.join(F.broadcast(search.plans.select("key", "graph")), "key").drop("cost")
    kept = steps.where("dst >= 0").join(F.broadcast(search.plans.select("key", "graph")), "key")
    whole = search.overlay.arcs.dropDuplicates(["variant", "arc"]).select(F.col("variant").alias("graph"), F.col("arc").alias("dst"), "edge_id", F.col("node_from").alias("src"), F.col("node_to").alias("end"), F.col("cost").alias("own"))
    w = Window.partitionBy("key").orderBy("place")
    out = kept.join(whole, ["graph", "dst"]).withColumn("step", F.row_number().over(w) - 1)
    if penalties is not None:
        dear = penalties.select((F.col("request") * (1 << PLAN_BITS) + F.col("plan")).cast("long").alias("key"), "edge_id", F.col("factor").cast("double").alias("factor")).groupBy("key", "edge_id").agg(F.max("factor").alias("factor"))
        out = out.join(dear, ["key", "edge_id"], "left").withColumn("own", F.col("own") * F.coalesce("factor", F.lit(1.0)))
    if cap is not None:
        out = out.withColumn("whole", F.sum("cost").over(Window.partitionBy("key"))).where(F.col("whole") <= cap)
    return out.select(
        F.shiftright("key", PLAN_BITS).alias("request"), F.col("key").bitwiseAND(F.lit((1 << PLAN_BITS) - 1)).cast("int").alias("plan"), "step", F.col("dst").alias("arc_id"), "edge_id", "src", F.col("end").alias("dst"), F.col("own").alias("cost"), F.col("cost").alias("spent"),
    )


def labels(overlay: Overlay, plans: DataFrame) -> DataFrame:
    """Least costs from every plan's start to the end of every arc that it reaches: (request, plan, arc_id, dist).

    From the top, each cell passes what its ways in cost down to the cells that it holds, so there is one round a level. The lowest cells
    here are those of level 1: one task makes their transitions, crosses each cell of level 0 in them, merges these in pairs and keeps only
    the costs across the whole.
    """
    base = int(overlay.top > 1)
    part = _part(overlay, set(overlay.frames), overlay.reach, base)
    search = prepare(part, plans.withColumn("goal", F.lit(None).cast("long")))
    _reach(search)
    virtual = _virtual(search.plans, base)
    have = search.plans.select("key", "graph", (-2 * (F.col("key") + 1)).alias("state"), F.lit(0.0).alias("dist"), "sx", "sy")
    seeds = have.select("key", "graph", "state", "dist", cell_of(F.lit(0), F.lit(0), overlay.top).alias("cell"))
    for level in range(overlay.top, base - 1, -1):
        seeds = search.variants(seeds, level)
        inside = search.inside(seeds, level)
        added = search.variants(_owners(_up(search.ends[level - 1 - base]).drop("variant"), search), level) if level > base else search.variants(virtual, level)
        columns = [c for c in inside.columns if c not in ("graph", "sub")]
        rows = inside.select(columns).union(added.select(columns))
        got = stored(_dealt(rows).cogroup(_dealt(seeds.select("variant", "cell", "key", "state", "dist"))).applyInPandas(_labels_task(level, base), "key long, state long, dist double, ux long, uy long"), f"labels-{level}")
        if level > base:
            inner = got.join(F.broadcast(search.plans.select("key", "graph")), "key").select("key", "graph", "state", "dist", cell_of(F.col("ux"), F.col("uy"), level - 1).alias("cell"))
            seeds = inner.union(have.select("key", "graph", "state", "dist", cell_of(F.col("sx"), F.col("sy"), level - 1)))
    least = got.where("state >= 0").groupBy("key", "state").agg(F.min("dist").alias("dist"))
    return least.select(F.shiftright("key", PLAN_BITS).alias("request"), F.col("key").bitwiseAND(F.lit((1 << PLAN_BITS) - 1)).cast("int").alias("plan"), F.col("state").alias("arc_id"), "dist")


def _spread(rows: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    """Costs of all states of a cell that a search reaches from its seeds, with the place where each state ends."""
    none = pd.DataFrame({"key": [], "state": [], "dist": [], "ux": [], "uy": []}).astype({"key": "int64", "state": "int64", "dist": "float64", "ux": "int64", "uy": "int64"})
    if not len(rows) or not len(seeds):
        return none
    states, (f, d) = _numbered(rows["frm"].to_numpy(), rows["dst"].to_numpy())
    ends = np.full((2, len(states)), OUTSIDE)
    ends[0, d], ends[1, d] = rows["ux"], rows["uy"]
    at = {s: i for i, s in enumerate(states.tolist())}
    known = seeds.loc[seeds["state"].isin(at)]
    out = []
    for key, own in known.groupby("key", sort=True):
        start = np.full((1, len(states)), np.inf)
        np.minimum.at(start[0], [at[s] for s in own["state"]], own["dist"].to_numpy())
        (dist,), _ = relaxed(len(states), f, d, rows["cost"].to_numpy(), start)
        got = np.flatnonzero(np.isfinite(dist) & (ends[0] != OUTSIDE))
        out.append(pd.DataFrame({"key": key, "state": states[got], "dist": dist[got], "ux": ends[0, got], "uy": ends[1, got]}))
    return pd.concat(out).astype(none.dtypes.to_dict()) if out else none
