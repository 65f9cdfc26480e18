"""Union, intersection, difference, buffer and area as relational sweeps over scanlines.

Two plans:

* ``pair_overlap``: two geometries per row. Slabs are cut at every vertex height, so the result is
  exact while no oblique edges cross inside a slab; oblique input gets ``rows`` extra cuts. One
  shuffle, by the pair's own key, carries sweep and final sum.
* ``sweep`` and what builds on it: any number of geometries per group on one grid of rows of height
  ``h``. The result is exact where vertices lie on row borders, otherwise off by at most h/2 times
  the horizontal extent of each vertex's row. Crossings at the same place are added up before the
  shuffle and work is split by (group, row, band of x), so neither copies of one geometry nor one
  group with a large share of all rows ends in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window

from placespark.functions import exprs as F
from placespark.functions import geom as G

EDGE_DDL = "array<struct<x1:double,y1:double,x2:double,y2:double,d:int>>"


def directed_edges(g: Column) -> Column:
    """Edges of an area with d = +1/-1, so that adding d over crossings from the left counts cover."""

    def ring_edges(ring, sign):
        return let_sign(
            ring,
            sign,
            lambda s: F.transform(
                F.filter(G.segments(ring), lambda e: e["a"]["y"] != e["b"]["y"]),
                lambda e: F.struct(
                    e["a"]["x"].alias("x1"),
                    e["a"]["y"].alias("y1"),
                    e["b"]["x"].alias("x2"),
                    e["b"]["y"].alias("y2"),
                    (F.when(e["b"]["y"] < e["a"]["y"], F.lit(1)).otherwise(F.lit(-1)) * s).alias("d"),
                ),
            ),
        )

    def let_sign(ring, sign, body):
        return F.let(F.when(G.signed_area(ring) < 0, -sign).otherwise(sign), body)

    rings = F.flatten(
        F.transform(
            g["parts"],
            lambda part: F.transform(
                part,
                lambda ring, i: F.struct(
                    ring.alias("ring"), F.when(i == 0, F.lit(1)).otherwise(F.lit(-1)).alias("sign")
                ),
            ),
        )
    )
    edges = F.flatten(F.transform(rings, lambda r: ring_edges(r["ring"], r["sign"])))
    return F.when(G.is_area(g), edges).otherwise(F.array().cast(EDGE_DDL))


def edges(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One row per non-horizontal edge of the areas in ``geom``; other columns are kept."""
    rest = [c for c in df.columns if c != geom]
    return df.select(*rest, F.explode(directed_edges(F.col(geom))).alias("e")).select(*rest, "e.*")


def row_of(y: Column, h) -> Column:
    """First row whose midline is at or above y; row r covers [r*h, (r+1)*h)."""
    return F.ceil(y / h - 0.5).cast("bigint")


def crossings(edge_rows: DataFrame, h) -> DataFrame:
    """Edges -> (row, x, d) where the edge crosses a row's midline."""
    h = F.lit(float(h)) if not isinstance(h, Column) else h
    rest = [c for c in edge_rows.columns if c not in ("x1", "y1", "x2", "y2", "d")]
    first, last = row_of(F.least("y1", "y2"), h), row_of(F.greatest("y1", "y2"), h) - 1
    mid = (F.col("row") + 0.5) * h
    return (
        edge_rows.where(first <= last)
        .withColumn("row", F.explode(F.sequence(first, last)))
        .select(
            *rest,
            "row",
            (F.col("x1") + (mid - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))).alias("x"),
            "d",
        )
    )


def slot_events(events: DataFrame, group: list[str], slots: dict[str, Column]) -> DataFrame:
    """Crossings -> one row per (group, row, x) with the summed step of every slot.

    The sum runs before the shuffle as well, so copies of one geometry travel as one row."""
    return events.groupBy(*group, "row", "x").agg(
        *[F.sum(F.when(condition, F.col("d")).otherwise(0)).alias(f"d_{name}") for name, condition in slots.items()]
    )


def sweep(events: DataFrame, group: list[str], slots: list[str], band: float | None = None) -> DataFrame:
    """Slot events -> runs (group, row, x0, x1, n_<slot>) with the number of open inputs per slot.

    With ``band`` the running sums are taken in two levels: inside bands of x, and over the totals
    of the bands of a row; the widest task then holds one band of one row of one group."""
    if band is None:
        line = Window.partitionBy(*group, "row").orderBy("x")
        runs = events.select(
            *group,
            "row",
            F.col("x").alias("x0"),
            F.lead("x").over(line).alias("x1"),
            *[F.sum(f"d_{s}").over(line).alias(f"n_{s}") for s in slots],
        )
        return runs.where(F.col("x1").isNotNull())
    banded = events.withColumn("band", F.floor(F.col("x") / band)).repartition(*group, "row", "band")
    totals = banded.groupBy(*group, "row", "band").agg(
        F.min("x").alias("first_x"), *[F.sum(f"d_{s}").alias(f"t_{s}") for s in slots]
    )
    bands = Window.partitionBy(*group, "row").orderBy("band")
    before = bands.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group,
        "row",
        "band",
        F.lead("first_x").over(bands).alias("next_x"),
        *[F.coalesce(F.sum(f"t_{s}").over(before), F.lit(0)).alias(f"o_{s}") for s in slots],
    )
    line = Window.partitionBy(*group, "row", "band").orderBy("x")
    runs = banded.join(offsets, [*group, "row", "band"]).select(
        *group,
        "row",
        F.col("x").alias("x0"),
        F.coalesce(F.lead("x").over(line), F.col("next_x")).alias("x1"),
        *[(F.sum(f"d_{s}").over(line) + F.col(f"o_{s}")).alias(f"n_{s}") for s in slots],
    )
    return runs.where(F.col("x1").isNotNull())


def runs_of(df: DataFrame, group: list[str], h, slots: dict[str, Column], band: float | None = None) -> DataFrame:
    """Geometries (column ``geom``) -> runs of the sweep."""
    found = crossings(edges(df), h)
    return sweep(slot_events(found, group, slots), group, list(slots), band)


def member_crossings(members: DataFrame, shapes: DataFrame, key: str, h) -> DataFrame:
    """Crossings of each member of a group, where ``members`` names shapes by ``key``.

    A shape is cut into crossings once, however many groups refer to it."""
    return members.join(crossings(edges(shapes.select(key, "geom")), h), key)


def width() -> Column:
    return F.col("x1") - F.col("x0")


def union_areas(found: DataFrame, group: list[str], h: float, band: float | None = None) -> DataFrame:
    """Area of the union of all geometries of a group, from their crossings."""
    runs = sweep(slot_events(found, group, {"all": F.lit(True)}), group, ["all"], band)
    return runs.where("n_all > 0").groupBy(*group).agg((F.sum(width()) * h).alias("area"))


def intersection_areas(
    found: DataFrame, counts: DataFrame, group: list[str], h: float, band: float | None = None
) -> DataFrame:
    """Area common to all geometries of a group; ``counts`` has their number as ``inputs``.

    Cover depths are summed per depth first, so the count of inputs meets one small row per depth."""
    runs = sweep(slot_events(found, group, {"all": F.lit(True)}), group, ["all"], band)
    by_depth = (
        runs.where("n_all > 0")
        .groupBy(*group, F.col("n_all").alias("inputs"))
        .agg((F.sum(width()) * h).alias("area"))
    )
    return counts.join(by_depth, [*group, "inputs"], "left").select(
        *group, "inputs", F.coalesce("area", F.lit(0.0)).alias("area")
    )


def set_areas(found: DataFrame, group: list[str], h: float, band: float | None = None) -> DataFrame:
    """Areas of a and b, their overlap, union and difference per group, from crossings tagged in ``side``."""
    slots = {"a": F.col("side") == "a", "b": F.col("side") == "b"}
    runs = sweep(slot_events(found, group, slots), group, ["a", "b"], band)
    in_a, in_b = F.col("n_a") > 0, F.col("n_b") > 0

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, width())) * h, F.lit(0.0))

    return runs.groupBy(*group).agg(
        total(in_a).alias("area_a"),
        total(in_b).alias("area_b"),
        total(in_a & in_b).alias("overlap"),
        total(in_a | in_b).alias("union_area"),
        total(in_a & ~in_b).alias("difference"),
    )


def merged_spans(runs: DataFrame, group: list[str], inside: Column) -> DataFrame:
    """Runs -> maximal spans (group, row, x0, x1) where ``inside`` holds."""
    line = Window.partitionBy(*group, "row").orderBy("x0")
    kept = runs.where(inside & (width() > 0)).withColumn(
        "starts", F.coalesce((F.lag("x1").over(line) < F.col("x0")).cast("int"), F.lit(1))
    )
    numbered = kept.withColumn("part", F.sum("starts").over(line))
    return numbered.groupBy(*group, "row", "part").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("part")


def spans(df: DataFrame, group: list[str], h) -> DataFrame:
    """Scanline spans (group, row, x0, x1) of the union of a group's areas."""
    return merged_spans(runs_of(df, group, h, {"all": F.lit(True)}), group, F.col("n_all") > 0)


def span_events(span_rows: DataFrame) -> DataFrame:
    """Spans back to crossings, so that sets of spans can be swept again."""
    rest = [c for c in span_rows.columns if c not in ("x0", "x1")]
    ends = F.array(
        F.struct(F.col("x0").alias("x"), F.lit(1).alias("d")), F.struct(F.col("x1").alias("x"), F.lit(-1).alias("d"))
    )
    return span_rows.select(*rest, F.explode(ends).alias("e")).select(*rest, "e.*")


def span_interval_join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping parts of the spans of a and b on equal keys and row.

    Spans are many for each shape that they come from, so the size that Spark expects of them from the file is far too
    small for a choice of sides to broadcast."""
    b = b.withColumnsRenamed({"x0": "bx0", "x1": "bx1"}).hint("merge")
    return (
        a.join(b, [*keys, "row"])
        .where("x0 < bx1 AND bx0 < x1")
        .withColumns({"x0": F.greatest("x0", "bx0"), "x1": F.least("x1", "bx1")})
        .drop("bx0", "bx1")
    )


def span_area(span_rows: DataFrame, group: list[str], h) -> DataFrame:
    return span_rows.groupBy(*group).agg((F.sum(width()) * h).alias("area"))


# ---- exact overlap of two geometries per row -------------------------------------------------


def _with_side(e: Column, side: int) -> Column:
    return F.struct(*[e[c].alias(c) for c in ("x1", "y1", "x2", "y2", "d")], F.lit(side).alias("side"))


def pair_overlap(
    df: DataFrame,
    keys: list[str],
    a: str,
    b: str,
    payload: list[str] | None = None,
    rows: int = 128,
    by: list[str] | None = None,
) -> DataFrame:
    """Overlap area of columns a and b, one output row per input row; ``keys`` must be unique.

    ``by`` names the keys to shuffle on, when a later step groups on fewer of them."""
    payload = payload or []
    by = by or keys
    tagged = F.concat(
        F.transform(directed_edges(F.col(a)), lambda e: _with_side(e, 0)),
        F.transform(directed_edges(F.col(b)), lambda e: _with_side(e, 1)),
    )
    prepared = (
        df.withColumns({"_ba": G.bounds(F.col(a)), "_bb": G.bounds(F.col(b)), "_edges": tagged})
        .withColumns({"_lo": F.greatest("_ba.ymin", "_bb.ymin"), "_hi": F.least("_ba.ymax", "_bb.ymax")})
        .withColumn(
            "_meets",
            (F.col("_lo") < F.col("_hi"))
            & (F.greatest("_ba.xmin", "_bb.xmin") < F.least("_ba.xmax", "_bb.xmax")),
        )
    )
    lo, hi = F.col("_lo"), F.col("_hi")
    heights = F.flatten(F.transform("_edges", lambda e: F.array(e["y1"], e["y2"])))
    oblique = F.exists("_edges", lambda e: e["x1"] != e["x2"])
    cuts = F.when(
        oblique, F.transform(F.sequence(F.lit(0), F.lit(rows)), lambda i: lo + (hi - lo) * i / F.lit(float(rows)))
    ).otherwise(F.array(lo, hi))
    inner = F.filter(F.concat(heights, cuts, F.array(lo, hi)), lambda y: (y >= lo) & (y <= hi))
    cut = prepared.select(
        *keys,
        *payload,
        "_lo",
        "_hi",
        F.when(F.col("_meets"), F.array_sort(F.array_distinct(inner))).alias("_ys"),
        F.when(F.col("_meets"), F.col("_edges")).alias("_edges"),
    )
    flat = cut.select(*keys, *payload, "_lo", "_hi", "_ys", F.posexplode_outer("_edges").alias("_n", "_e"))
    first = F.array_position("_ys", F.greatest("_lo", F.least("_e.y1", "_e.y2")))
    last = F.array_position("_ys", F.least("_hi", F.greatest("_e.y1", "_e.y2"))) - 1
    numbered = flat.withColumns({"_first": first, "_last": last})
    slabs = numbered.withColumn(
        "slab",
        F.explode_outer(F.when((F.col("_first") > 0) & (F.col("_first") <= F.col("_last")), F.sequence("_first", "_last"))),  # 0: above both
    ).where(F.col("slab").isNotNull() | (F.coalesce("_n", F.lit(0)) == 0))
    y0, y1 = F.get("_ys", F.col("slab") - 1), F.get("_ys", F.col("slab"))
    middle = (y0 + y1) / 2
    events = slabs.select(
        *keys,
        *payload,
        "slab",
        (y1 - y0).alias("h"),
        (
            F.col("_e.x1")
            + (middle - F.col("_e.y1")) * (F.col("_e.x2") - F.col("_e.x1")) / (F.col("_e.y2") - F.col("_e.y1"))
        ).alias("x"),
        F.when(F.col("_e.side") == 0, F.col("_e.d")).otherwise(0).alias("da"),
        F.when(F.col("_e.side") == 1, F.col("_e.d")).otherwise(0).alias("db"),
    ).repartition(*by)
    line = Window.partitionBy(*keys, "slab").orderBy("x")
    runs = events.withColumns(
        {"na": F.sum("da").over(line), "nb": F.sum("db").over(line), "next": F.lead("x").over(line)}
    )
    overlap = F.sum(F.when((F.col("na") > 0) & (F.col("nb") > 0), (F.col("next") - F.col("x")) * F.col("h")))
    return runs.groupBy(*keys).agg(
        *[F.first(p).alias(p) for p in payload], F.coalesce(overlap, F.lit(0.0)).alias("overlap")
    )


# ---- buffer ----------------------------------------------------------------------------------


def half_chord(dy: Column, r: Column) -> Column:
    """Half width at height dy of the buffer polygon around a point (8 segments per quarter); null outside."""
    quarter = F.lit(G.QUARTER_SEGMENTS)
    step = F.lit(3.141592653589793) / (2 * quarter)
    ratio = F.abs(dy) / r
    k = F.least(F.floor(F.asin(F.least(ratio, F.lit(1.0))) / step), quarter - 1)
    y0, y1 = F.sin(k * step), F.sin((k + 1) * step)
    x0, x1 = F.cos(k * step), F.cos((k + 1) * step)
    return F.when(ratio <= 1, r * (x0 + (ratio - y0) * (x1 - x0) / (y1 - y0)))


def capsule_spans(segment_rows: DataFrame, h, radius: Column) -> DataFrame:
    """Segments (x1, y1, x2, y2) -> spans of everything within ``radius`` of them, one per row."""
    h = F.lit(float(h)) if not isinstance(h, Column) else h
    rest = [c for c in segment_rows.columns if c not in ("x1", "y1", "x2", "y2")]
    placed = segment_rows.withColumn("_r", radius)
    r = F.col("_r")
    first = row_of(F.least("y1", "y2") - r, h)
    last = row_of(F.greatest("y1", "y2") + r, h) - 1
    rows = placed.where((r > 0) & (first <= last)).withColumn("row", F.explode(F.sequence(first, last)))
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    y = (F.col("row") + 0.5) * h
    dx, dy = x2 - x1, y2 - y1
    size = F.hypot(dx, dy)
    rows = rows.withColumns(
        {
            "_c1": half_chord(y - y1, r),
            "_c2": half_chord(y - y2, r),
            "_ux": dx / F.nullif(size, F.lit(0.0)),
            "_uy": dy / F.nullif(size, F.lit(0.0)),
            "_len": size,
        }
    )
    ux, uy = F.col("_ux"), F.col("_uy")
    # The strip along the segment (0..length) and the strip across it (-r..r), as ranges of x.
    along0 = x1 + (0 - (y - y1) * uy) / F.nullif(ux, F.lit(0.0))
    along1 = x1 + (F.col("_len") - (y - y1) * uy) / F.nullif(ux, F.lit(0.0))
    across0 = x1 + ((y - y1) * ux - r) / F.nullif(uy, F.lit(0.0))
    across1 = x1 + ((y - y1) * ux + r) / F.nullif(uy, F.lit(0.0))
    lo = F.greatest(F.least(along0, along1), F.least(across0, across1))
    hi = F.least(F.greatest(along0, along1), F.greatest(across0, across1))
    # A level segment bounds x by its own length only inside |y - y1| <= r; an upright one by r only.
    inside = (
        F.when(uy == 0, F.abs(y - y1) <= r)
        .when(ux == 0, ((y - y1) * uy >= 0) & ((y - y1) * uy <= F.col("_len")))
        .otherwise(F.lit(True))
    )
    strip = ux.isNotNull() & inside & (lo <= hi)
    rows = rows.withColumns({"_lo": F.when(strip, lo), "_hi": F.when(strip, hi)})
    return (
        rows.withColumns(
            {
                "x0": F.least(x1 - F.col("_c1"), x2 - F.col("_c2"), F.col("_lo")),
                "x1_": F.greatest(x1 + F.col("_c1"), x2 + F.col("_c2"), F.col("_hi")),
            }
        )
        .where("x0 < x1_")
        .select(*rest, "row", "x0", F.col("x1_").alias("x1"))
    )


def outline_segments(df: DataFrame, geom: str = "geom") -> DataFrame:
    """All segments of rings and lines, and points as segments of length 0."""
    rest = [c for c in df.columns if c != geom]
    g = F.col(geom)

    def flat(s):
        return F.struct(
            s["a"]["x"].alias("x1"), s["a"]["y"].alias("y1"), s["b"]["x"].alias("x2"), s["b"]["y"].alias("y2")
        )

    def dot(p):
        return F.struct(p["x"].alias("x1"), p["y"].alias("y1"), p["x"].alias("x2"), p["y"].alias("y2"))

    found = F.flatten(
        F.transform(
            G.lines(g),
            lambda ln: F.when(F.size(ln) > 1, F.transform(G.segments(ln), flat)).otherwise(F.transform(ln, dot)),
        )
    )
    return df.select(*rest, F.explode(found).alias("s")).select(*rest, "s.*")


def _chord(dy: Column, r: Column) -> Column:
    """``half_chord`` with its steps bound, for use inside of lambdas."""
    quarter = float(G.QUARTER_SEGMENTS)
    step = 3.141592653589793 / (2 * quarter)

    def at(s):
        y0, y1, x0, x1 = F.sin(s["k"] * step), F.sin((s["k"] + 1) * step), F.cos(s["k"] * step), F.cos((s["k"] + 1) * step)
        return F.when(s["t"] <= 1, r * (x0 + (s["t"] - y0) * (x1 - x0) / (y1 - y0)))

    ratio = lambda t: F.struct(t.alias("t"), F.least(F.floor(F.asin(F.least(t, F.lit(1.0))) / step), F.lit(quarter) - 1).alias("k"))
    return F.let(F.let(F.abs(dy) / r, ratio), at)


def _capsule_span(s: Column, y: Column, r: Column) -> Column:
    """struct(x0, x1) of what lies within ``r`` of a segment (x1, y1, x2, y2, ux, uy, len) at height ``y``, as in ``capsule_spans``."""
    x1, y1, ux, uy = s["x1"], s["y1"], s["ux"], s["uy"]
    along0, along1 = x1 + (0 - (y - y1) * uy) / F.nullif(ux, F.lit(0.0)), x1 + (s["len"] - (y - y1) * uy) / F.nullif(ux, F.lit(0.0))
    across0, across1 = x1 + ((y - y1) * ux - r) / F.nullif(uy, F.lit(0.0)), x1 + ((y - y1) * ux + r) / F.nullif(uy, F.lit(0.0))
    inside = (
        F.when(uy == 0, F.abs(y - y1) <= r).when(ux == 0, ((y - y1) * uy >= 0) & ((y - y1) * uy <= s["len"])).otherwise(F.lit(True))
    )
    strip = F.struct(
        F.greatest(F.least(along0, along1), F.least(across0, across1)).alias("lo"), F.least(F.greatest(along0, along1), F.greatest(across0, across1)).alias("hi")
    )
    ends = F.struct(_chord(y - y1, r).alias("c1"), _chord(y - s["y2"], r).alias("c2"), F.when(ux.isNotNull() & inside, strip).alias("s"))

    def whole(k):
        met = k["s"]["lo"] <= k["s"]["hi"]
        low = F.least(x1 - k["c1"], s["x2"] - k["c2"], F.when(met, k["s"]["lo"]))
        return F.struct(low.alias("x0"), F.greatest(x1 + k["c1"], s["x2"] + k["c2"], F.when(met, k["s"]["hi"])).alias("x1"))

    return F.let(ends, whole)


def _covered_spans(steps: Column) -> Column:
    """Steps struct(x, e) of one row, e being -1 where a shape begins and 1 where it ends -> spans where any is open.

    As in ``sweep``, steps without a place come first and count."""
    start = "named_struct('n', 0, 'x', CAST(NULL AS DOUBLE), 'out', CAST(array() AS array<struct<x0:double,x1:double>>))"

    def step(acc, s):
        n = acc["n"] - s["e"]
        begin = F.when(n <= 0, F.lit(None).cast("double")).when(acc["n"] > 0, F.coalesce(acc["x"], s["x"])).otherwise(s["x"])
        done = F.concat(acc["out"], F.array(F.struct(acc["x"].alias("x0"), s["x"].alias("x1"))))
        closes = (acc["n"] > 0) & (n <= 0)
        return F.struct(n.alias("n"), begin.alias("x"), F.when(closes, done).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.sort_array(steps), F.expr(start), step)["out"]


def grown_rows(df: DataFrame, h, radius: Column, interior: bool = True) -> DataFrame:
    """Geometries -> spans (other columns, row, x0, x1) of what lies within ``radius`` of each (with ``interior`` also of its inside).

    The spans of one geometry are joined in its rows, so what travels to a sweep is its extent times its rows and
    not its corners times its rows."""
    rest = [c for c in df.columns if c != "geom"]
    g, r, y = F.col("geom"), F.col("_r"), F.col("_y")
    h = F.lit(float(h)) if not isinstance(h, Column) else h
    whole = lambda a, b: F.struct(
        a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"), F.hypot(b["x"] - a["x"], b["y"] - a["y"]).alias("len")
    )
    sides = F.flatten(
        F.transform(
            G.lines(g),
            lambda ln: F.when(F.size(ln) > 1, F.transform(G.segments(ln), lambda s: whole(s["a"], s["b"]))).otherwise(F.transform(ln, lambda p: whole(p, p))),
        )
    )
    aimed = F.transform(
        sides,
        lambda s: F.struct(
            *(s[c].alias(c) for c in ("x1", "y1", "x2", "y2", "len")),
            ((s["x2"] - s["x1"]) / F.nullif(s["len"], F.lit(0.0))).alias("ux"), ((s["y2"] - s["y1"]) / F.nullif(s["len"], F.lit(0.0))).alias("uy"),
        ),
    )
    placed = df.withColumns({"_r": radius, "_h": h, "_b": G.bounds(g), "_s": aimed, "_e": directed_edges(g)})
    reach = F.greatest(F.col("_r"), F.lit(0.0))
    first, last = row_of(F.col("_b.ymin") - reach, F.col("_h")), row_of(F.col("_b.ymax") + reach, F.col("_h")) - 1
    rows = placed.where(first <= last).withColumn("row", F.explode(F.sequence(first, last))).withColumn("_y", (F.col("row") + 0.5) * F.col("_h"))
    near = F.filter("_s", lambda s: (r > 0) & (y >= F.least(s["y1"], s["y2"]) - r) & (y < F.greatest(s["y1"], s["y2"]) + r))
    found = F.filter(F.transform(near, lambda s: _capsule_span(s, y, r)), lambda s: s["x0"] < s["x1"])
    steps = F.flatten(
        F.transform(found, lambda s: F.array(F.struct(s["x0"].alias("x"), F.lit(-1).alias("e")), F.struct(s["x1"].alias("x"), F.lit(1).alias("e"))))
    )
    if interior:
        own = F.filter("_e", lambda e: (y >= F.least(e["y1"], e["y2"])) & (y < F.greatest(e["y1"], e["y2"])))
        x = lambda e: e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        steps = F.concat(steps, F.transform(own, lambda e: F.struct(x(e).alias("x"), (0 - e["d"]).alias("e"))))
    spans_ = F.filter(_covered_spans(steps), lambda s: s["x0"] < s["x1"])
    return rows.select(*rest, "row", F.explode(spans_).alias("_n")).select(*rest, "row", "_n.x0", "_n.x1")


def buffer_runs(df: DataFrame, group: list[str], h, radius: Column) -> DataFrame:
    """Geometries -> runs of the sweep over the area within ``radius`` of them (interior included)."""
    events = span_events(grown_rows(df.select(*dict.fromkeys([*group, *df.columns])), h, radius).select(*group, "row", "x0", "x1"))
    return sweep(slot_events(events, group, {"all": F.lit(True)}), group, ["all"])


def buffer_spans(df: DataFrame, group: list[str], h, radius: Column) -> DataFrame:
    """Spans of everything within ``radius`` of the group's geometries."""
    return merged_spans(buffer_runs(df, group, h, radius), group, F.col("n_all") > 0)


def buffer_areas(df: DataFrame, group: list[str], h: float, radius: Column) -> DataFrame:
    """Area of the buffered geometries; merging touching runs is not needed for it."""
    runs = buffer_runs(df, group, h, radius).where("n_all > 0")
    return runs.groupBy(*group).agg((F.sum(width()) * h).alias("area"))


def grow_spans(span_rows: DataFrame, h: Column, radius: Column) -> DataFrame:
    """Spans of everything within ``radius`` of each span, a span being a rectangle one row high."""
    rest = [c for c in span_rows.columns if c not in ("row", "x0", "x1")]
    placed = span_rows.withColumns({"_r": radius, "_h": h})
    reach = F.ceil(F.col("_r") / F.col("_h")).cast("bigint")
    steps = placed.where("_r > 0").withColumn("_k", F.explode(F.sequence(-reach, reach)))
    away = F.greatest(F.abs("_k") - 0.5, F.lit(0.0)) * F.col("_h")
    wide = steps.withColumn("_w", half_chord(away, F.col("_r"))).where("_w IS NOT NULL")
    return wide.select(
        *rest, (F.col("row") + F.col("_k")).alias("row"), (F.col("x0") - F.col("_w")).alias("x0"), (F.col("x1") + F.col("_w")).alias("x1")
    )
