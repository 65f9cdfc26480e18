import zlib

import numpy as np

from placespark.llm import language
from placespark.llm.language import LENGTH, Network


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(documents).toPandas().set_index("doc_id")
    truth = documents.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"]
    out = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in got.index])
    assert (got["held_out"] == out).all()
    assert (got["lang_pred"] == truth.loc[got.index])[got["held_out"]].mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_pooling_as_defined():
    network = Network.new(["a", "b"])
    random = np.random.default_rng(1)
    x = random.integers(0, 256, (3, LENGTH)).astype(np.uint8)
    pooled, places = network.pooled(x, where=True)
    k = 0
    for width, weights in zip(language.WIDTHS, network.filters):
        for f in range(language.FILTERS):
            each = [
                [sum(weights[i, row[p + i], f] for i in range(width)) for p in range(LENGTH - width + 1)] for row in x
            ]
            assert np.allclose(pooled[:, k], np.max(each, axis=1), atol=1e-4)
            assert (places[:, k] == np.argmax(each, axis=1)).all()
            k += 1


def test_windows_cover_the_text():
    texts = [b"", b"x" * LENGTH, b"AB\n" * 200]
    offsets = np.cumsum([0, *map(len, texts)])
    rows, sizes, x = language.windows(offsets, np.frombuffer(b"".join(texts), np.uint8))
    assert rows.tolist() == [0, 1, 2, 2, 2] and sizes.tolist() == [0, LENGTH, LENGTH, LENGTH, 600 - 2 * LENGTH]
    assert x[2:].tobytes().rstrip(b" ") == b"ab " .join([b""] * 201).rstrip(b" ")


def test_edges(docs):
    rows = [(i, w * 30, "s") for i, w in enumerate(["the house and ", "der und ein haus "] * 20)]
    frame = docs(rows).selectExpr("doc_id", "text", "source", "case when doc_id % 2 = 0 then 'en' else 'de' end as lang")
    more = docs([(100, None), (101, ""), (102, "123 !?"), (103, "the and " * 40000), (None, "und ein haus")]).select(frame.columns)
    got = {r["doc_id"]: r for r in language.identify(frame.unionByName(more)).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102))
    assert got[103]["lang_pred"] == "en" and got[None]["lang_pred"] == "de"
    assert {r["lang_pred"] for r in language.identify(more).collect()} == {"und"}
    assert language.identify(frame.limit(0)).count() == 0
