"""Scores of predictions and baselines."""

from __future__ import annotations


from placespark import fixtures as X
from placespark.functions import exprs as F
from placespark.functions import geom as G
from placespark.operators import score as S
from placespark.operators.layout import spread
from placespark.plans.catalog import query, rounded
from placespark.sources.tables import table

# ---- expected results: boxes in metres, overlaps in closed form --------------------------------


def _mx(v: str) -> str:
    return f"6378137e0 * radians({v})"


def _my(v: str) -> str:
    return f"6378137e0 * ln(tan(pi() / 4 + radians({v}) / 2))"


def _metric(names: str, source: str, extra: str) -> str:
    parts = [f"{_mx(n)} AS m{n}, {_mx(n.replace('min', 'max'))} AS m{n.replace('min', 'max')}" if "x" in n else
             f"{_my(n)} AS m{n}, {_my(n.replace('min', 'max'))} AS m{n.replace('min', 'max')}" for n in names.split()]
    return f"SELECT {extra}, {', '.join(parts)} FROM {source}"


def _side(a: str, b: str, axis: str, fa: str = "1", fb: str = "1") -> str:
    """Overlap of two ranges of which each may be enlarged about its middle."""

    def ends(p, f):
        lo, hi = f"m{p}{axis}min", f"m{p}{axis}max"
        grow = f"({f} - 1) * ({hi} - {lo}) / 2"
        return f"({lo} - {grow})", f"({hi} + {grow})"

    (a0, a1), (b0, b1) = ends(a, fa), ends(b, fb)
    return f"greatest(0, least({a1}, {b1}) - greatest({a0}, {b0}))"


def overlap_sql(a: str, b: str, fa: str = "1", fb: str = "1") -> str:
    return f"({_side(a, b, 'x', fa, fb)} * {_side(a, b, 'y', fa, fb)})"


def area_sql(p: str) -> str:
    return f"((m{p}xmax - m{p}xmin) * (m{p}ymax - m{p}ymin))"


_GUESSES = X.with_sql("entities", "predictions")[:-1] + ", boxes AS (" + _metric(
    "gxmin gymin pxmin pymin", "entities LEFT JOIN predictions USING (entity_id)", "entity_id, status, pxmin IS NOT NULL AS predicted"
) + ")"
_F = "CASE WHEN {p} > 0 AND {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0 END"
_SCORED = _GUESSES + (
    ", scored AS (SELECT entity_id, status, predicted"
    f", CASE WHEN predicted THEN {overlap_sql('g', 'p')} / {area_sql('p')} END AS p, CASE WHEN predicted THEN {overlap_sql('g', 'p')} / {area_sql('g')} END AS r"
    f", CASE WHEN predicted THEN {overlap_sql('g', 'p', '2')} / {area_sql('p')} END AS p_x2, CASE WHEN predicted THEN {overlap_sql('g', 'p', '1', '2')} / {area_sql('g')} END AS r_x2"
    " FROM boxes) "
)


def _gold(spark, d):
    return X.entities(spark, d).select("entity_id", "status", X.gold_box().alias("gold"))


def _gold_ell():
    """Gold box without its upper right quarter: its oriented envelope is the box."""
    x0, y0, x1, y1 = (F.col(c) for c in ("gxmin", "gymin", "gxmax", "gymax"))
    cx, cy = (x0 + x1) / 2, (y0 + y1) / 2
    return G.make_polygon(F.array(G.xy(x0, y0), G.xy(x1, y0), G.xy(x1, cy), G.xy(cx, cy), G.xy(cx, y1), G.xy(x0, y1)))


def _guesses(spark, d):
    return X.predictions(spark, d).select("entity_id", X.predicted_box().alias("guess"))


def _pairs(spark, d, gold=None):
    entities = spread(X.entities(spark, d), "entity_id").select("entity_id", (X.gold_box() if gold is None else gold).alias("gold"))
    return entities.join(_guesses(spark, d), "entity_id")


def _rounded(df, *names):
    return df.select("entity_id", *[rounded(F.col(n)).alias(n) for n in names])


_PREDICTED = "FROM scored WHERE predicted"


@query("score_overlap", _SCORED + f"SELECT entity_id, round(p, 6) + 0 AS p, round(r, 6) + 0 AS r, round({_F.format(p='p', r='r')}, 6) + 0 AS f {_PREDICTED}")
def score_overlap(spark, d):
    return _rounded(S.score_pairs(_pairs(spark, d), "entity_id", ("plain",)), "p", "r", "f")


@query("score_envelope", _SCORED + f"SELECT entity_id, round(p, 6) + 0 AS env_p, round(r, 6) + 0 AS env_r, round({_F.format(p='p', r='r')}, 6) + 0 AS env_f {_PREDICTED}")
def score_envelope(spark, d):
    return _rounded(S.score_pairs(_pairs(spark, d, _gold_ell()), "entity_id", ("env",)), "env_p", "env_r", "env_f")


@query("score_scaled", _SCORED + f"SELECT entity_id, round(p_x2, 6) + 0 AS p_x2, round(r_x2, 6) + 0 AS r_x2 {_PREDICTED}")
def score_scaled(spark, d):
    return _rounded(S.score_pairs(_pairs(spark, d), "entity_id", ("gold_x2", "guess_x2")), "p_x2", "r_x2")


@query("score_scaled_envelope", _SCORED + f"SELECT entity_id, round(p_x2, 6) + 0 AS env_p_x2, round(r_x2, 6) + 0 AS env_r_x2 {_PREDICTED}")
def score_scaled_envelope(spark, d):
    return _rounded(S.score_pairs(_pairs(spark, d, _gold_ell()), "entity_id", ("env_x2", "env_guess_x2")), "env_p_x2", "env_r_x2")


_ALL = {
    "p": "p", "r": "r", "f": _F.format(p="p", r="r"), "p_x2": "p_x2", "r_x2": "r_x2", "env_p": "p", "env_r": "r",
    "env_f": _F.format(p="p", r="r"), "env_p_x2": "p_x2", "env_r_x2": "r_x2",
}


@query("score_entity", _SCORED + "SELECT entity_id, " + ", ".join(f"round({e}, 6) + 0 AS {n}" for n, e in _ALL.items()) + f" {_PREDICTED}")
def score_entity(spark, d):
    return _rounded(S.score_pairs(_pairs(spark, d), "entity_id"), *S.SCORES)


def _corpus_sql(where: str) -> str:
    p, r, rp = "sum(p) / count(p)", "sum(r) / count(*)", "sum(r) / count(p)"
    cols = {
        "p": p, "r": r, "f": _F.format(p=p, r=r), "r_predicted": rp, "f_predicted": _F.format(p=p, r=rp),
        "p_x2": "sum(p_x2) / count(p)", "r_x2": "sum(r_x2) / count(*)", "r_x2_predicted": "sum(r_x2) / count(p)",
    }
    both = {**cols, **{f"env_{n}": e for n, e in cols.items()}}
    return (
        "SELECT count(*) AS total_gold, count(p) AS total_predicted, "
        + ", ".join(f"round({e}, 6) + 0 AS {n}" for n, e in both.items())
        + f", round(count(p) / count(*), 6) + 0 AS coverage FROM scored WHERE {where}"
    )


_CORPUS = _corpus_sql("status = '5'")


def corpus_scores(spark, d):
    gold = _gold(spark, d).where("status = '5'")
    return S.sum_scores(S.evaluate(gold, _guesses(spark, d), "entity_id"), [], F.count(F.lit(1)))


@query("score_corpus", _SCORED + _CORPUS)
def score_corpus(spark, d):
    """P, R, F of the whole corpus: strict, enveloped, enlarged; over all gold and over predicted entities."""
    totals = corpus_scores(spark, d)
    return totals.select(*[F.col(c) if c.startswith("total") else rounded(F.col(c)).alias(c) for c in totals.columns])


_REPORT = [("", "gold", "coverage", "coverage")] + [
    (scope, den, measure, column.replace("_predicted", "") if den == "gold" else column)
    for scope in ("strict", "relaxed")
    for den in ("gold", "predicted")
    for measure, column in (("P", "p"), ("R", "r_predicted"), ("F", "f_predicted"), ("Px2", "p_x2"), ("Rx2", "r_x2_predicted"))
]


@query(
    "score_report",
    _SCORED + f", corpus AS ({_CORPUS}) " + " UNION ALL ".join(
        f"SELECT '{scope}' AS scope, '{den}' AS denominator, '{measure}' AS measure, {column} AS value FROM corpus"
        for scope, den, measure, column in _REPORT
    ).replace("SELECT ''", "SELECT ''"),
)
def score_report(spark, d):
    return S.report(corpus_scores(spark, d)).withColumn("value", rounded(F.col("value")))


@query("coverage", X.with_sql("entities", "predictions") + "SELECT count(*) AS total_gold, count(pxmin) AS total_predicted, round(count(pxmin) / count(*), 6) + 0 AS coverage FROM entities LEFT JOIN predictions USING (entity_id) WHERE status = '5'")
def coverage(spark, d):
    gold = X.entities(spark, d).where("status = '5'").select("entity_id")
    found = X.predictions(spark, d).select("entity_id", F.lit(1).alias("hit"))
    counts = gold.join(found, "entity_id", "left").agg(
        F.count(F.lit(1)).alias("total_gold"), F.count("hit").alias("total_predicted")
    )
    return counts.withColumn("coverage", rounded(F.col("total_predicted") / F.col("total_gold")))


_WIDE_X = "CAST((c_custkey * 37) % 400 AS DOUBLE) - 199"
_WIDE_Y = "CAST((c_custkey * 53) % 200 AS DOUBLE) - 99"


@query(
    "out_of_limits",
    f"SELECT c_custkey, {_WIDE_X} < -180 OR {_WIDE_Y} < -90 OR {_WIDE_X} + 2 > 180 OR {_WIDE_Y} + 1 > 90 AS outside FROM customer",
)
def out_of_limits(spark, d):
    boxes = table(spark, d, "customer").selectExpr("c_custkey", f"{_WIDE_X} AS x", f"{_WIDE_Y} AS y")
    box = G.box(F.col("x"), F.col("y"), F.col("x") + 2, F.col("y") + 1)
    return boxes.select("c_custkey", S.out_of_limits(box).alias("outside"))


@query(
    "scaled_union_area",
    X.with_sql("shapes") + "SELECT shape_id, round(CASE form WHEN 3 THEN 0 ELSE 4 * w * h * CASE form WHEN 0 THEN 1 WHEN 1 THEN 0.5 ELSE 0.75 END END, 4) + 0 AS area FROM shapes",
)
def scaled_union_area(spark, d):
    """A shape seen whole from its centre lies inside its enlarged copy, so four times its area counts."""
    from placespark.operators import overlay as O

    big = X.shapes(spark, d).select("shape_id", S.enlarged(F.col("geom")).alias("big"), G.is_area(F.col("geom")).alias("area"))
    same = O.pair_overlap(big.select("shape_id", F.when(F.col("area"), F.col("big")).otherwise(G.empty()).alias("a")).withColumn("b", F.col("a")), ["shape_id"], "a", "b")
    return same.select("shape_id", rounded(F.col("overlap"), 4).alias("area"))
