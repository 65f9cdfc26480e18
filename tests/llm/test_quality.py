import zlib

import numpy as np

from placespark.llm import quality
from placespark.llm.quality import Network


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(documents, labels).toPandas().set_index("doc_id")
    out = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in got.index])
    assert (got["held_out"] == out).all() and got["score"].between(0, 1).all() and len(got) == documents.count()
    assert (got["predicted"] == (got["score"] >= 0.5)).all()
    truth = labels.toPandas().set_index("doc_id")["quality"]
    part = got.loc[truth.index]
    part, truth = part[part["held_out"]], truth[part["held_out"]]
    print("held-out accuracy", (part["predicted"] == truth).mean(), len(truth))
    assert (part["predicted"] == truth).mean() > 0.9
    good, bad = part["score"][truth == 1].to_numpy(), part["score"][truth == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.93


def test_temperature_calibrates():
    random = np.random.default_rng(0)
    x = random.normal(size=(3000, quality.FEATURES))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    net = Network.fit(x, (random.random(3000) < p).astype(float))
    fresh = random.normal(size=(3000, quality.FEATURES))
    found = net.probabilities(fresh)
    assert abs(found.mean() - 0.5) < 0.05
    sure = found > 0.8
    assert abs(found[sure].mean() - (1 / (1 + np.exp(-2 * fresh[sure, 0]))).mean()) < 0.1


def test_edges(docs, spark):
    rows = [(i, ("good plain words " if i % 2 else "spam spam !! ") * (i % 7 + 3) + str(i)) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "good plain words " * 20000), (103, "x"), (103, "x"), (None, "good words")]
    known = [(i, i % 2, 0) for i in range(80)] + [(100, None, None), (None, 1, 0), (101, 7, 0)]
    labels = spark.createDataFrame(known, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "1 as id")
    got = quality.score(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
    by_id = {r["doc_id"]: r["predicted"] for r in got}
    assert np.mean([by_id[i] == i % 2 for i in range(80)]) > 0.95
    assert by_id[102] == 1
    one = quality.score(docs(rows), labels.filter("quality = 1")).collect()
    assert {r["predicted"] for r in one} == {1}
    assert {r["score"] for r in quality.score(docs(rows), labels.limit(0)).collect()} == {0.5}
    assert quality.score(docs([]), labels).count() == 0
