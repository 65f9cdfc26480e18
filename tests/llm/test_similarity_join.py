import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

import check
from placespark.llm import similarity_join
from placespark.llm.graph import components

FOLDER = "/root/testdata/sf0.001"


def sets(rows):
    out = []
    for doc, text, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    return out


def brute(rows):
    found = sets(rows)
    root = list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(found):
        for j, (_, y) in enumerate(found[:i]):
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[top(i)] = top(j)
    names = {}
    for i, (doc, _) in enumerate(found):
        if doc is not None:
            names[top(i)] = min(names.get(top(i), doc), doc)
    return sorted(((doc, len(x), names.get(top(i))) for i, (doc, x) in enumerate(found)), key=str)


def variants(seed):
    """Chains and stars of near copies, exact copies, short texts, and documents that share a passage only."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    rows, passage = [], [word() for _ in range(25)]
    for _ in range(8):
        text = [word() for _ in range(r.randint(30, 160))]
        for _ in range(r.randint(1, 14)):
            rows.append(" ".join(text))
            if r.random() < 0.7:
                text = list(text) if r.random() < 0.5 else text
                for _ in range(r.randint(1, 3)):
                    text[r.randrange(len(text))] = word()
    rows += [" ".join([word() for _ in range(40)] + passage) for _ in range(15)]
    rows += ["one two", "One  two", "one two three four five", "ONE TWO THREE FOUR FIVE", None, "", " \n", "x " * 3000, "x x x x x"]
    r.shuffle(rows)
    return list(enumerate(rows)) + [(3, rows[3]), (None, rows[5])]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(docs, seed):
    rows = variants(seed)
    got = similarity_join.group(docs(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_same_as_sql_and_kept(docs):
    rows = variants(9)[:-2]
    df = docs(rows, extra=False)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(df.collect(), columns=df.columns))
    want = con.execute(similarity_join.ORACLE).fetch_df()
    assert check.compare(similarity_join.group(df).toPandas(), want).startswith("ok")
    kept = similarity_join.keep_first(docs([*rows, rows[0], rows[0]]))
    firsts = {doc for doc, _, name in brute(rows) if name == doc}
    got = [r["doc_id"] for r in kept.collect()]
    assert set(got) == firsts and len(got) == len(firsts)


def test_one_batch_of_many_slices(spark):
    """Slices of a batch begin somewhere in its buffers; sets of later slices must not depend on that."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghiJKLM") for _ in range(r.randint(3, 9)))
    pool = [" ".join(word() for _ in range(1200)) for _ in range(40)]
    rows = []
    for i in range(2400):
        text = pool[i % 40] if i % 3 == 0 else " ".join(word() for _ in range(1100))
        rows.append((i, text.lower() if i % 2 else text))
    assert sum(len(t) for _, t in rows) > 16 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {d: c for d, _, c in similarity_join.group(df).collect()}
    firsts = {}
    assert got == {i: firsts.setdefault(i % 40, i) if i % 3 == 0 else i for i, _ in rows}


def test_judged_by_own_text(docs):
    text = " ".join(f"w{i}x" for i in range(40))
    other = " ".join(f"v{i}y" for i in range(40))
    rows = [(1, text), (2, text + " end"), (2, other), (None, text), (None, "alone"), (None, "Alone"), (5, ""), (None, ""), (None, None)]
    kept = sorted(((r["doc_id"], r["text"]) for r in similarity_join.keep_first(docs(rows)).collect()), key=str)
    assert [k for k in kept if (k[1] or "").lower() != "alone"] == sorted([(1, text), (2, other), (5, ""), (None, ""), (None, None)], key=str)
    assert sum((k[1] or "").lower() == "alone" for k in kept) == 1


def test_levels_are_complete():
    """Any two similar sets share enough within the prefixes of the smaller of any two lengths."""
    r = np.random.default_rng(3)
    for _ in range(300):
        x = r.choice(60, r.integers(1, 40), replace=False)
        y = np.unique(np.append(r.choice(x, max(1, len(x) - r.integers(0, 5)), replace=False), r.choice(60, r.integers(0, 4))))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * len(np.union1d(x, y)):
            continue
        for length in range(1, 1 + min(4, int(similarity_join.needed(np.int64(min(len(x), len(y))))))):
            heads = [np.sort(v)[: len(v) - int(similarity_join.needed(np.int64(len(v)))) + length] for v in (x, y)]
            assert len(np.intersect1d(*heads)) >= length


def test_empty(docs):
    assert similarity_join.group(docs([])).count() == 0 and similarity_join.keep_first(docs([])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (300, 301), (301, 300)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {300: 300, 301: 300}
