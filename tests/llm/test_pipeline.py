"""Each stage on what the one before it kept, against the plain versions of the operators' tests."""

import random
import re

import corpus_pipeline
import test_decontamination
import test_packing
import test_similarity_join
import test_suffix_dedup
from placespark.llm import packing

SLURS = ("moron", "scum", "trash")


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklm") for _ in range(r.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(60)
    rows = [(i, text(r.randint(20, 90))) for i in range(60)]
    rows += [(i, text(30) + " " + r.choice(SLURS) + " " + text(9) + " " + r.choice(SLURS)) for i in range(60, 90)]
    rows += [(90 + i, rows[i][1] + " and more" * (i % 2)) for i in range(12)] + [(102, rows[0][1]), (103, None), (104, "")]
    rows += [(105 + i, text(20) + " " + passage + " " + text(20)) for i in range(6)]
    question = "Anna had 12 apples and gave 3 of them to her friend who lives 5 km away from the old mill"
    changed = question.replace("12", "70").replace("Anna", "Berta").replace(" 3 ", " 4 ").replace(" 5 ", " 9 ")
    rows += [(120, text(30) + " " + question), (121, changed + " " + text(30))]
    labels = [(i, 1, int(60 <= i < 90)) for i in range(0, 90)]
    return [(d, t, "ab"[d % 2]) for d, t in rows], labels, [(1, question), (2, text(12))]


def test_stages(spark, tmp_path):
    rows, labels, items = corpus()
    folder = str(tmp_path)
    full = [(d, t, "en", s, len(t or "")) for d, t, s in rows]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(full, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs, outs = spark.read.parquet(f"{folder}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs_in = docs
        out = stage(spark, docs_in, folder)
        if i < 4:
            assert out.columns == docs_in.columns and out.dtypes == docs_in.dtypes
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        outs.append(docs.collect())

    texts = [[(r["doc_id"], r["text"]) for r in out] for out in outs[:4]]
    clean = [(d, t) for d, t, _ in rows if not any(re.search(rf"\b{w}\b", t or "") for w in SLURS)]
    assert sorted(texts[0]) == sorted(clean)
    firsts = {d for d, _, name in test_similarity_join.brute(texts[0]) if d == name}
    assert sorted(texts[1]) == sorted((d, t) for d, t in texts[0] if d in firsts)
    gone = {d: (n, k) for d, n, k, _, _ in test_suffix_dedup.brute(texts[1])}
    before = dict(texts[1])
    assert {d for d, _ in texts[2]} == {d for d, (n, k) in gone.items() if n > k or n == 0}
    assert all(len((t or "").encode()) == gone[d][0] - gone[d][1] for d, t in texts[2])
    assert all(before[d] == t for d, t in texts[2] if gone[d][1] == 0) and sum(k for _, k in gone.values()) > 1000
    leaks = {d for d, *_ in test_decontamination.brute(texts[2], items)}
    assert leaks >= {120, 121} and sorted(texts[3]) == sorted((d, t) for d, t in texts[2] if d not in leaks)
    test_packing.checked(texts[3], outs[4], packing.WINDOW)

    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(tuple, run), key=str) == sorted(map(tuple, outs[4]), key=str) or len(run) == len(outs[4])


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
