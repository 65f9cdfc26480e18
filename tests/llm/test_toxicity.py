import numpy as np
import pyarrow as pa

from placespark.llm import toxicity
from placespark.llm.toxicity import GRADES, Model


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text", "'y' as word")


def test_real_labels(spark):
    folder = "/root/testdata/sf0.1"  # the smaller folders have two dozen toxic documents to learn from
    documents, known = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    half = known.filter("doc_id % 2 = 0")
    model = toxicity.fit(documents, half)
    got = toxicity.grade(documents, model).toPandas().set_index("doc_id")
    rest = known.filter("doc_id % 2 = 1").toPandas().set_index("doc_id")["toxic"]
    found = got["toxic"].loc[rest.index]
    assert found[rest == 1].mean() > 0.9 and found[rest == 0].mean() < 0.01
    assert got["severity"].between(0, GRADES).all() and (got["grade"] > 0).eq(got["toxic"]).all()
    kept = {r["doc_id"] for r in toxicity.keep_clean(documents, model).select("doc_id").collect()}
    assert kept == set(got.index[~got["toxic"]])


def test_gradient_finds_ordered_grades():
    random = np.random.default_rng(0)
    x = random.integers(0, 2, (600, 4))
    grades = np.minimum(GRADES, x[:, 0] + 2 * x[:, 1])
    rows, columns = np.nonzero(x)
    model = Model.fit(list("abcd"), rows, columns * toxicity.LEVELS, grades)
    weights = model.weights[:, 0]
    assert (np.diff(model.thresholds) > 0).all() and not model.weights[:, 1:].any()
    assert weights[1] > weights[0] > 1 and np.abs(weights[2:]).max() < 1
    above = model.above(x @ weights)
    assert (np.diff(above, axis=1) <= 0).all() and np.corrcoef(above.sum(axis=1), grades)[0, 1] > 0.95


def test_features_of_a_text():
    piece = pa.record_batch({"text": ["Foobar, foobaz! (FOO) x", None]})
    rows, names, times, size = toxicity.document_features(piece)
    found = dict(zip(names.to_pylist(), times.tolist()))
    assert found == {"foobar": 1, "foobaz": 1, "foo": 1, "x": 1, "foo*": 2, "fooba*": 2}
    assert set(rows) == {0} and set(size) == {4}
    assert toxicity.met(np.array([2]), np.array([300])).tolist() == [[True, True, False, True, False]]


def test_edges(docs, spark):
    rows = [(i, f"plain words {i} " + ("slur! Insult" if i % 3 == 0 else "fine day")) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "INSULT slur " * 30000), (None, "fine day"), (103, "slur insult"), (103, "fine day")]
    known = labels(spark, [(i, 1, int(i % 3 == 0)) for i in range(60)] + [(100, None, None), (None, 1, 1), (0, 1, 0)])
    got = toxicity.grade(docs(rows), toxicity.fit(docs(rows), known)).collect()
    toxic = {r["doc_id"] for r in got if r["toxic"]}
    assert toxic == {i for i in range(60) if i % 3 == 0} | {102, 103} and len(got) == len(rows)
    assert sum(r["toxic"] for r in got if r["doc_id"] == 103) == 1
    none = toxicity.assess(docs(rows), known.filter("toxic = 0")).collect()
    assert len(none) == len(rows) and not any(r["toxic"] for r in none)
    assert toxicity.assess(docs([]), known).count() == 0
