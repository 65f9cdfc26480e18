"""Areas as sets of directed edges, and exact set operations on any number of them.

A region is rows (group, x0, y0, x1, y1, d): an edge from its lower to its upper end, d = +1 where the region begins to its
right and -1 where it ends. Level edges follow from the others. Sums over edges give area, centre and extent, so a region is
as small as its outline, whatever its size next to others.

``overlay`` cuts the edges of a group at the heights of their ends and crossings, and at no others: in such a slab no two
edges cross, so counting steps from the left is exact, and slabs lie where the vertices are. A group of many edges is
split into cells by height, which are dealt over tasks; cuts, slabs and sweep of a cell share one shuffle.
Groups of many members are united or intersected in rounds of ``FAN`` members, so that no cell holds the edges
of all of them, and inner edges are gone after the first round.

Ends are rounded to ``QUANTUM``, so that borders that run along each other fall together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.functions import exprs as E
from placespark.functions import geom as G
from placespark.operators import overlay as O
from placespark.operators.layout import stored

QUANTUM = 2.0**-40
#: Edges of a cell, about; members of a group in one round.
CELL, FAN = 64, 32
EDGE = ["x0", "y0", "x1", "y1", "d"]


def snapped(x: Column) -> Column:
    return F.rint(x / QUANTUM) * QUANTUM


def _upward(rows: DataFrame) -> DataFrame:
    """Edges (x1, y1, x2, y2, d) from their lower to their upper end."""
    rest = [c for c in rows.columns if c not in ("x1", "y1", "x2", "y2", "d")]
    up = F.col("y1") < F.col("y2")
    ends = [F.when(up, F.col(a)).otherwise(F.col(b)) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    found = rows.select(*rest, *(snapped(c).alias(n) for c, n in zip(ends, EDGE[:4], strict=True)), "d")
    return found.where("y0 < y1")


def edges(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Edges of valid areas; other columns are kept."""
    return _upward(O.edges(df, geom))


def _at(y: Column) -> Column:
    """Where the line of an edge is at height y."""
    x = F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    return F.when(y == F.col("y0"), F.col("x0")).when(y == F.col("y1"), F.col("x1")).otherwise(snapped(x))


def _cells(rows: DataFrame, group: list[str], steps: list[str]) -> DataFrame:
    """Edges cut at the borders of the cells (group, cell) of their group; equal edges are one, with the sum of steps."""
    own = rows.groupBy(*group, *EDGE[:4]).agg(*(F.sum(s).alias(s) for s in steps))
    whole = Window.partitionBy(*group)  # FAN members at most come to an overlay
    sizes = {"_low": F.min("y0").over(whole), "_high": F.max("y1").over(whole), "_cells": F.ceil(F.count("*").over(whole) / CELL)}
    placed = own.withColumns(sizes).withColumn("_h", (F.col("_high") - F.col("_low")) / F.col("_cells"))
    last = F.col("_cells") - 1
    first = F.least(last, F.floor((F.col("y0") - F.col("_low")) / F.col("_h")))
    end = F.greatest(first, F.least(last, F.ceil((F.col("y1") - F.col("_low")) / F.col("_h")) - 1))
    cut = placed.withColumn("cell", F.explode(F.sequence(first, end)))

    def border(n: Column) -> Column:
        return F.when(n <= 0, F.col("_low")).when(n >= F.col("_cells"), F.col("_high")).otherwise(snapped(F.col("_low") + n * F.col("_h")))

    cut = cut.withColumns({"_ya": F.greatest("y0", border(F.col("cell"))), "_yb": F.least("y1", border(F.col("cell") + 1))})
    cut = cut.where("_ya < _yb").select(
        *group, "cell", F.xxhash64(*EDGE[:4]).alias("edge"), *steps,
        _at(F.col("_ya")).alias("_xa"), F.col("_ya"), _at(F.col("_yb")).alias("_xb"), F.col("_yb"),
    )
    named = cut.withColumnsRenamed({"_xa": "x0", "_ya": "y0", "_xb": "x1", "_yb": "y1"})
    return stored(named, "cells").repartition(*group, "cell")


def _heights(cells: DataFrame, group: list[str]) -> DataFrame:
    """Heights of ends and crossings of each cell."""
    key = [*group, "cell"]
    other = cells.select(*key, *(F.col(c).alias(f"o{c}") for c in EDGE[:4]))
    low, high = F.greatest("y0", "oy0"), F.least("y1", "oy1")
    along = lambda y, p="": F.col(f"{p}x0") + (y - F.col(f"{p}y0")) * (F.col(f"{p}x1") - F.col(f"{p}x0")) / (F.col(f"{p}y1") - F.col(f"{p}y0"))
    below, above = along(low) - along(low, "o"), along(high) - along(high, "o")
    met = cells.where("x0 <> x1").join(other, key).where(low < high).where(((below < 0) & (above > 0)) | ((below > 0) & (above < 0)))
    crossed = met.select(*key, snapped(low + (high - low) * below / (below - above)).alias("y"), low.alias("_a"), high.alias("_b"))
    crossed = crossed.where("_a < y AND y < _b").select(*key, "y")
    return cells.select(*key, F.explode(F.array("y0", "y1")).alias("y")).unionByName(crossed).distinct()


def overlay(rows: DataFrame, group: list[str], slots: dict[str, Column] | None = None) -> DataFrame:
    """Edges -> pieces (group, cell, y0, y1, xa, xb, edge, d_<slot>, n_<slot>, to_a, to_b): where an edge runs through a slab,
    the step of each slot there, its count to the right, and the next piece on the right."""
    slots = slots or {"all": F.lit(True)}
    steps = {f"d_{s}": F.when(c, F.col("d")).otherwise(0) for s, c in slots.items()}
    cells = _cells(rows.select(*group, *EDGE[:4], *(c.cast("long").alias(n) for n, c in steps.items())), group, list(steps))
    key = [*group, "cell"]
    line = Window.partitionBy(*key).orderBy("y")
    slabs = _heights(cells, group).select(*key, F.col("y").alias("ya"), F.lead("y").over(line).alias("yb")).where("yb IS NOT NULL")
    cut = cells.join(slabs, key).where("y0 <= ya AND yb <= y1")
    pieces = cut.select(*key, "ya", "yb", _at(F.col("ya")).alias("xa"), _at(F.col("yb")).alias("xb"), "edge", *steps)
    pieces = pieces.groupBy(*key, "ya", "yb", "xa", "xb").agg(F.min("edge").alias("edge"), *(F.sum(s).alias(s) for s in steps))
    across = Window.partitionBy(*key, "ya").orderBy(F.col("xa") + F.col("xb"), "xa")
    return pieces.select(
        *key, F.col("ya").alias("y0"), F.col("yb").alias("y1"), "xa", "xb", "edge", *steps,
        *(F.sum(f"d_{s}").over(across).alias(f"n_{s}") for s in slots), F.lead("xa").over(across).alias("to_a"), F.lead("xb").over(across).alias("to_b"),
    )


def run_area() -> Column:
    """Area from a piece to the next one."""
    return (F.col("y1") - F.col("y0")) * (F.col("to_a") - F.col("xa") + F.col("to_b") - F.col("xb")) / 2


def region(pieces: DataFrame, group: list[str], inside: str, slots: list[str] | None = None, levels: bool = False) -> DataFrame:
    """Edges of where ``inside`` (a condition on n_<slot>) holds; pieces of one edge on end are joined again.

    With ``levels`` the level edges of the outline come along, with d = 0."""
    slots = slots or ["all"]
    holds = F.coalesce(F.expr(inside), F.lit(False))
    marked = pieces.withColumn("now", holds).withColumns({f"n_{s}": F.col(f"n_{s}") - F.col(f"d_{s}") for s in slots}).withColumn("was", holds)
    turned = marked.where("now <> was").select(*group, "y0", "y1", "xa", "xb", "edge", F.when(F.col("now"), 1).otherwise(-1).alias("d"))
    if levels:
        turned = stored(turned, "outline")
    line = Window.partitionBy(*group, "edge", "d").orderBy("y0")
    joins = (F.lag("y1").over(line) == F.col("y0")) & (F.lag("xb").over(line) == F.col("xa"))
    numbered = turned.withColumn("_new", F.when(joins, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(line))
    joined = numbered.groupBy(*group, "edge", "d", "_part").agg(
        F.min_by("xa", "y0").alias("x0"), F.min("y0").alias("y0"), F.max_by("xb", "y1").alias("x1"), F.max("y1").alias("y1")
    )
    joined = joined.select(*group, *EDGE)
    return with_levels(turned, group, joined) if levels else joined


def with_levels(turned: DataFrame, group: list[str], joined: DataFrame) -> DataFrame:
    """Edges with the level ones (d = 0): at the height of any end, where the region is on one side only."""
    ends = F.array(
        F.struct(F.col("y0").alias("y"), F.col("xa").alias("x"), F.col("d").alias("up"), F.lit(0).alias("down")),
        F.struct(F.col("y1").alias("y"), F.col("xb").alias("x"), F.lit(0).alias("up"), F.col("d").alias("down")),
    )
    met = turned.select(*group, F.explode(ends).alias("e")).groupBy(*group, "e.y", "e.x").agg(F.sum("e.up").alias("up"), F.sum("e.down").alias("down"))
    line = Window.partitionBy(*group, "y").orderBy("x")
    runs = met.select(*group, "y", "x", F.lead("x").over(line).alias("to"), F.sum("up").over(line).alias("above"), F.sum("down").over(line).alias("below"))
    levels = runs.where("(above > 0) <> (below > 0) AND x < to")
    x0, x1 = (F.when(F.col("above") > 0, F.col(a)).otherwise(F.col(b)) for a, b in (("x", "to"), ("to", "x")))
    return joined.unionByName(levels.select(*group, x0.alias("x0"), F.col("y").alias("y0"), x1.alias("x1"), F.col("y").alias("y1"), F.lit(0).alias("d")))


def areas(rows: DataFrame, group: list[str]) -> DataFrame:
    """Area of each region, as a sum over its edges."""
    return rows.groupBy(*group).agg(F.sum(edge_area()).alias("area"))


def edge_area() -> Column:
    """What an edge adds to its region's area."""
    return -F.col("d") * (F.col("x0") + F.col("x1")) / 2 * (F.col("y1") - F.col("y0"))


# ---- valid areas -----------------------------------------------------------------------------


def is_convex(g: Column) -> Column:
    """One ring that turns one way, once: such an area needs no repair."""
    ring = g["parts"][0][0]

    def turns(r):
        n = E.size(r)
        cross = E.transform(
            E.sequence(E.lit(0), n - 2),
            lambda i: E.let(
                E.struct(r[i].alias("a"), r[i + 1].alias("b"), r[E.when(i + 2 < n, i + 2).otherwise(E.lit(1))].alias("c")),
                lambda p: (p["b"]["x"] - p["a"]["x"]) * (p["c"]["y"] - p["b"]["y"]) - (p["b"]["y"] - p["a"]["y"]) * (p["c"]["x"] - p["b"]["x"]),
            ),
        )
        rises = E.filter(E.transform(E.sequence(E.lit(0), n - 2), lambda i: E.function("signum")(r[i + 1]["y"] - r[i]["y"])), lambda s: s != 0.0)
        changes = E.size(E.filter(E.transform(rises, lambda s, i: E.when((i > 0) & (s != rises[E.greatest(i - 1, E.lit(0))]), E.lit(1)).otherwise(E.lit(0))), lambda c: c == 1))
        return (E.function("array_min")(cross) >= 0.0) & (changes <= 2) | (E.function("array_max")(cross) <= 0.0) & (changes <= 2)

    return E.when((E.size(g["parts"]) == 1) & (E.size(g["parts"][0]) == 1) & (E.size(ring) > 3), turns(ring)).otherwise(E.lit(False))


def level_edges(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Level edges of convex areas."""
    low = df.withColumn("_low", G.bounds(E.col(geom))["ymin"])
    sides = O.outline_segments(low, geom).where("y1 = y2 AND x1 <> x2")
    rest = [c for c in sides.columns if c not in ("x1", "y1", "x2", "y2", "_low")]
    ends, y = (F.least("x1", "x2"), F.greatest("x1", "x2")), snapped(F.col("y1"))
    bottom = F.col("y1") == F.col("_low")
    x0, x1 = (snapped(F.when(bottom, ends[i]).otherwise(ends[1 - i])) for i in (0, 1))
    return sides.select(*rest, x0.alias("x0"), y.alias("y0"), x1.alias("x1"), y.alias("y1"), F.lit(0).alias("d"))


def valid_edges(shapes: DataFrame, key: str, geom: str = "geom", levels: bool = False) -> DataFrame:
    """(key, edges) of the areas as they should be: inside is what an odd number of a part's ring lines separates from the
    outside, and the parts of a geometry count once where they overlap."""
    own = shapes.select(key, F.col(geom).alias("geom")).where(G.is_area(E.col("geom"))).withColumn("_fine", is_convex(E.col("geom")))
    convex = own.where("_fine").select(key, "geom")
    fine = edges(convex).unionByName(level_edges(convex)) if levels else edges(convex)
    own = stored(own.where("NOT _fine"), "shapes")
    if not own.limit(1).count():
        return fine.select(key, *EDGE)
    parts = own.select(key, F.posexplode("geom.parts").alias("_part", "rings"))
    rings = parts.select(key, "_part", F.explode("rings").alias("ring"))
    sides = E.transform(
        E.sequence(E.lit(0), E.size(E.col("ring")) - 2), lambda i: E.struct(E.col("ring")[i].alias("a"), E.col("ring")[i + 1].alias("b"))
    )
    lines = rings.where("size(ring) > 3").select(key, "_part", F.explode(sides).alias("s"))
    lines = lines.select(key, "_part", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"), F.lit(1).alias("d"))
    by_part = [key, "_part"]
    mended = stored(region(overlay(_upward(lines), by_part), by_part, "n_all % 2 = 1"), "mended")
    whole = region(overlay(mended, [key]), [key], "n_all > 0", levels=levels)
    return fine.select(key, *EDGE).unionByName(whole.select(key, *EDGE))


# ---- groups ----------------------------------------------------------------------------------


def _rounds(members: DataFrame, group: list[str], member: str, inside: str) -> tuple[DataFrame, DataFrame]:
    """(edges, counts) of the groups' members, chunk by chunk until each group has one chunk; counts are the members."""
    rows, member_of = members, f"_{member}"
    rows = rows.withColumnRenamed(member, member_of)
    while True:
        sizes = rows.select(*group, member_of).distinct().groupBy(*group).agg(F.count("*").alias("_n"))
        if (sizes.agg(F.max("_n")).first()[0] or 0) <= FAN:
            return rows, sizes
        chunk = F.pmod(F.xxhash64(member_of), F.ceil(F.col("_n") / (FAN / 2)))
        dealt = rows.join(sizes, group).withColumn("_chunk", chunk)
        by = [*group, "_chunk"]
        counts = dealt.select(*by, member_of).distinct().groupBy(*by).agg(F.count("*").alias("inputs"))
        real = dealt.where("x0 IS NOT NULL")
        merged = region(overlay(real, by).join(counts, by), by, inside)
        kept = counts.select(*by).join(merged, by, "left")
        rows = stored(kept.withColumnRenamed("_chunk", member_of).select(*group, member_of, *EDGE), "regions")


def united(members: DataFrame, group: list[str], member: str, levels: bool = False) -> DataFrame:
    """Edges of the union of each group's members, from (group, member, edges)."""
    rows, _ = _rounds(members, group, member, "n_all > 0")
    return region(overlay(rows.where("x0 IS NOT NULL"), group), group, "n_all > 0", levels=levels)


def common(members: DataFrame, group: list[str], member: str, levels: bool = False) -> DataFrame:
    """Edges of what all members of a group cover; a member without edges (one row of nulls) covers nothing."""
    rows, sizes = _rounds(members, group, member, "n_all = inputs")
    runs = overlay(rows.where("x0 IS NOT NULL"), group).join(sizes.withColumnRenamed("_n", "inputs"), group)
    return region(runs, group, "n_all = inputs", levels=levels)


def member_edges(members: DataFrame, shapes: DataFrame, key: str) -> DataFrame:
    """(members' columns, edges) of the shapes that members name by ``key``; a shape without an area has one row of nulls."""
    own = stored(valid_edges(shapes, key), "regions")
    return members.join(own, key, "left")


def set_areas(rows: DataFrame, group: list[str]) -> DataFrame:
    """Areas of a and b, their overlap, union and difference per group, from edges tagged in ``side``."""
    runs = overlay(rows, group, {"a": F.col("side") == "a", "b": F.col("side") == "b"})
    in_a, in_b = F.col("n_a") > 0, F.col("n_b") > 0
    total = lambda c: F.coalesce(F.sum(F.when(c, run_area())), F.lit(0.0))
    return runs.groupBy(*group).agg(
        total(in_a).alias("area_a"), total(in_b).alias("area_b"), total(in_a & in_b).alias("overlap"),
        total(in_a | in_b).alias("union_area"), total(in_a & ~in_b).alias("difference"),
    )


def difference(rows: DataFrame, group: list[str], levels: bool = False) -> DataFrame:
    """Edges of what side a covers and side b does not, from edges tagged in ``side``."""
    runs = overlay(rows, group, {"a": F.col("side") == "a", "b": F.col("side") == "b"})
    return region(runs, group, "n_a > 0 AND n_b = 0", ["a", "b"], levels)


def contained(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, a_contains, b_contains): whether one side covers the other, from edges of both tagged in ``side``; a side
    without an area neither covers nor is covered. Slivers of rounding (a millionth of a millionth) do not count."""
    areas = set_areas(rows, group)
    least = F.least("area_a", "area_b")
    covers = lambda side: (least > 0) & (F.col(side) - F.col("overlap") <= F.col(side) * 1e-12)
    return areas.select(*group, covers("area_b").alias("a_contains"), covers("area_a").alias("b_contains"))


def make_valid(shapes: DataFrame, key: str, geom: str = "geom") -> DataFrame:
    """(key, geom) of areas whose rings cross themselves or each other, as rings that do not."""
    return outlines(valid_edges(shapes, key, geom, levels=True), [key])


# ---- outlines --------------------------------------------------------------------------------


def _directed(rows: DataFrame, group: list[str]) -> DataFrame:
    """Edges and level edges as steps (group, id, ax, ay, bx, by) around their region, which lies on their left."""
    down = F.col("d") > 0
    ends = [F.when(down, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("x1", "x0", "ax"), ("y1", "y0", "ay"), ("x0", "x1", "bx"), ("y0", "y1", "by"))]
    return stored(rows.select(*group, *ends).withColumn("id", F.monotonically_increasing_id()), "steps")


def _followed(steps: DataFrame, group: list[str]) -> DataFrame:
    """(id, next): the step that goes on where a step ends; where several do, the one that turns left most, so that parts
    that touch in a point stay apart."""
    after = steps.select(*group, F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("id").alias("next"), F.col("bx").alias("cx"), F.col("by").alias("cy"))
    met = steps.join(after, [*group, "bx", "by"])
    ux, uy, vx, vy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"), F.col("cx") - F.col("bx"), F.col("cy") - F.col("by")
    turn = F.atan2(ux * vy - uy * vx, ux * vx + uy * vy)
    return met.groupBy("id").agg(F.max_by("next", turn).alias("next"))


def rings(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, ring, nth, x, y): the corners of a region's outline, ring by ring, from its edges and level edges.

    Steps find the least step of their ring by looking twice as far in each round, so a ring of n corners takes log2(n)
    rounds of one join, and no task follows a whole ring."""
    steps = _directed(rows, group)
    zero, moved = F.lit(0).cast("long").alias("away"), F.lit(True).alias("moved")
    state, reach = stored(_followed(steps, group).select("id", F.col("next").alias("jump"), F.col("id").alias("least"), zero, moved), "rings"), 1
    while True:
        now = stored(_further(state, reach), "rings")
        if not now.where("moved").limit(1).count():
            break
        state, reach = now, 2 * reach
    placed = steps.join(state.select("id", F.col("least").alias("ring"), "away"), "id")
    sizes = placed.groupBy(*group, "ring").agg(F.count("*").alias("n"))
    nth = F.pmod(F.col("n") - F.col("away"), F.col("n"))
    return placed.join(sizes, [*group, "ring"]).select(*group, "ring", nth.alias("nth"), F.col("ax").alias("x"), F.col("ay").alias("y"))


def _further(state: DataFrame, reach: int) -> DataFrame:
    """From the least of the next ``reach`` steps to that of twice as many; a step has moved where that is another one."""
    ahead = state.select(F.col("id").alias("jump"), F.col("jump").alias("far"), F.col("least").alias("other"), F.col("away").alias("further"))
    nearer = F.col("least") <= F.col("other")
    return state.join(ahead, "jump").select(
        "id", F.col("far").alias("jump"), F.least("least", "other").alias("least"), F.when(nearer, F.col("away")).otherwise(F.col("further") + reach).alias("away"), (~nearer).alias("moved")
    )


def _is_corner(at: Column, i: Column) -> Column:
    """Whether the ring q turns at its i-th point."""
    n = F.size("q")
    before, after = F.get("q", F.pmod(i - 1, n)), F.get("q", F.pmod(i + 1, n))
    ux, uy, vx, vy = at["x"] - before["x"], at["y"] - before["y"], after["x"] - at["x"], after["y"] - at["y"]
    return F.abs(ux * vy - uy * vx) > 1e-12 * (F.abs(ux) + F.abs(uy)) * (F.abs(vx) + F.abs(vy))


def outlines(rows: DataFrame, group: list[str]) -> DataFrame:
    """(group, geom): each region as one geometry of closed rings, holes with the smallest part that surrounds them."""
    corners = stored(rings(rows, group), "corners")
    points = F.transform(F.sort_array(F.collect_list(F.struct("nth", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    drawn = corners.groupBy(*group, "ring").agg(points.alias("q"))
    drawn = drawn.select(*group, "ring", F.filter("q", _is_corner).alias("p")).where("size(p) > 2")
    drawn = drawn.select(*group, "ring", F.concat("p", F.slice("p", 1, 1)).alias("p")).withColumn("size", G.signed_area(E.col("p")))
    drawn = stored(drawn.withColumn("b", G.bounds(G.make_line(E.col("p")))), "outlines")
    shells = drawn.where("size > 0").select(*group, "ring", F.col("p").alias("shell"), "size", F.col("b").alias("box"))
    holes = drawn.where("size < 0").select(*group, F.col("ring").alias("hole"), F.col("p").alias("inner"), F.col("b").alias("own"))
    inside = (F.col("own.xmin") >= F.col("box.xmin")) & (F.col("own.xmax") <= F.col("box.xmax")) & (F.col("own.ymin") >= F.col("box.ymin")) & (F.col("own.ymax") <= F.col("box.ymax"))
    middle = G.xy((E.col("inner")[0]["x"] + E.col("inner")[1]["x"]) / 2, (E.col("inner")[0]["y"] + E.col("inner")[1]["y"]) / 2)
    within = holes.join(shells, group).where(inside).where(G.contains_point(G.make_polygon(E.col("shell")), middle))
    owned = within.groupBy(*group, "hole").agg(F.min_by(F.struct("ring", "inner"), "size").alias("o")).groupBy(*group, "o.ring").agg(F.sort_array(F.collect_list("o.inner")).alias("holes"))
    nothing = F.array().cast("array<array<struct<x:double,y:double>>>")
    parts = shells.join(owned, [*group, "ring"], "left").select(*group, F.concat(F.array("shell"), F.coalesce("holes", nothing)).alias("part"))
    whole = parts.groupBy(*group).agg(F.sort_array(F.collect_list("part")).alias("parts"))
    kind = E.when(E.size(E.col("parts")) == 1, E.lit("Polygon")).otherwise(E.lit("MultiPolygon"))
    return whole.select(*group, G.geometry(kind, E.col("parts")).alias("geom"))
