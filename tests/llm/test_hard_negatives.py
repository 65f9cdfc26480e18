import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import check
from placespark.llm import hard_negatives as hn

COLUMNS = "vec_id long, embedding array<float>, label int"


def brute(rows):
    valid = []
    for vec, x, label in rows:
        if label is not None and x is not None and all(v is not None and math.isfinite(v) for v in x):
            label = int(math.fmod(label + 1, 10)) if vec is not None and vec % 7 == 0 else label
            valid.append((vec, [math.floor(256 * float(np.float32(v))) for v in x], label))
    out = []
    last = lambda v: (v is None, v or 0)
    for i, (anchor, x, label) in enumerate(valid):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(a * b for a, b in zip(x, y)), vec, other) for j, (vec, y, other) in enumerate(valid) if j != i]  # noqa: B905
        scored.sort(key=lambda r: (-r[0], last(r[1])))
        for p, positive, _ in [r for r in scored if r[2] == label][:5]:
            hard = [r for r in scored if r[2] != label and 50 * p <= 100 * r[0] <= 95 * p][:3]
            out += [(anchor, positive, k, r[1], p, r[0]) for k, r in enumerate(hard, 1)]
    return Counter(out)


def corpus(seed, n=400, width=6):
    r = random.Random(seed)
    vector = lambda: [r.choice([r.uniform(-1, 1), 0.5, -0.25]) for _ in range(width)]
    rows = [(i if r.random() < 0.5 else 50 * r.randrange(20), vector(), r.randrange(4)) for i in range(n)]
    hot = vector()
    rows += [(1000 + i, hot, i % 3) for i in range(120)]  # a vector that many share
    rows += [rows[0], rows[0], (None, vector(), 1), (50, None, 1), (100, [None] * width, 1), (100, [float("nan")] * width, 2), (150, vector(), None)]
    rows += [(200, [float("inf")] * width, 0), (250, vector()[:2], 0), (300, [], 0), (-50, vector(), 9), (-7, vector(), 9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, block", [(1, 8192), (2, 64)])
def test_against_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    monkeypatch.setattr(hn, "GROUP_ROWS", 16)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("row", "block", "vector")})
    assert Counter(map(tuple, hn.mine(df).collect())) == brute(rows)


def test_same_as_sql(spark):
    df = spark.createDataFrame([r for r in corpus(3) if r[0] not in (250, 300)], COLUMNS)
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert check.compare(hn.mine(df).toPandas(), con.execute(hn.ORACLE).fetch_df()).startswith("ok")


@pytest.mark.parametrize("width, largest", [(1, 1), (64, 200), (64, 1 << 20), (700, 1 << 24), (3000, 3), (5, 1 << 29), (0, 1)])
def test_products_are_exact(width, largest):
    r = np.random.default_rng(width)
    a, b = (r.integers(-largest, largest, (n, width), endpoint=True) for n in (7, 9))
    a[:1], b[:1] = largest, -largest
    want = np.array([[sum(int(x) * int(y) for x, y in zip(u, v, strict=True)) for v in b] for u in a], dtype=np.int64)
    assert (hn.products(a, b) == want).all()


def test_order_of_large_scores():
    scores = np.array([[1 << 61, 5, 1 << 61, -(1 << 61)], [3, 3, 4, 3]])
    assert hn._ordered(scores).tolist() == [[0, 2, 1, 3], [2, 0, 1, 3]] and hn._ordered(scores[1:]).tolist() == [[2, 0, 1, 3]]


def test_scores_beyond_a_long(spark):
    with pytest.raises(OverflowError):
        hn.products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_empty(spark):
    assert hn.mine(spark.createDataFrame([], COLUMNS)).count() == 0
    assert hn.mine(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 2)], COLUMNS)).count() == 0
