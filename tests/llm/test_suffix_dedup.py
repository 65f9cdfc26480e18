import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest

import check
from placespark.llm import suffix_dedup as s


def brute(rows):
    firsts = {}
    for doc, text, *_ in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49 if doc is not None else 0):
            w = data[i : i + 50]
            firsts[w] = min(firsts.get(w, doc), doc)
    out = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for i in range(len(data) - 49 if doc is not None else 0):
            if firsts[data[i : i + 50]] < doc:
                gone[i : i + 50] = True
        rest = bytes(b for b, g in zip(data, gone) if not g)
        runs = int((np.diff(np.append(False, gone).astype(int)) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def variants(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß ") for _ in range(r.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(r.randint(8, 40)) for _ in range(6)]
    rows = [text(5).join(r.sample(passages, r.randint(0, 4))) + text(r.randint(0, 60)) for _ in range(25)]
    rows += [rows[3], rows[3] + "x", "y" + rows[4][1:], "ab" * 400, "ab" * 300 + "c", "z" * 49, "z" * 50, "z" * 50, None, ""]
    rows += ["\x00" * 60, "\x00" * 55 + "q", text(3000) + passages[0] + text(2000)]
    rows = [x and "".join(c if r.random() > 0.002 else "#" for c in x) for x in rows]
    r.shuffle(rows)
    out = list(enumerate(rows))
    return out + [(7, passages[0] * 2), (7, passages[0] * 2), (8, passages[1] + "tail"), (None, passages[2] + passages[3])]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(docs, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(s, "MANY", 1)  # all hashes with several segments are dealt out string by string
    rows = variants(seed)
    assert sorted(map(tuple, s.digest(docs(rows)).collect()), key=str) == brute(rows)


def test_same_as_sql(docs):
    rows = variants(5)[:-1]
    df = docs(rows, extra=False)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(df.collect(), columns=df.columns))
    assert check.compare(s.digest(df).toPandas(), con.execute(s.ORACLE).fetch_df()).startswith("ok")


def test_clean_keeps_columns_and_characters(docs):
    same = "größe und länge der straße, übermäßig schön gemessen für alle tage"
    rows = [(1, "first " + same), (2, same), (3, "ü" + same[:40] + "x"), (4, None), (5, "head é" + same + "é tail")]
    df = docs(rows)
    got = {r["doc_id"]: r for r in s.clean(df).collect()}
    assert s.clean(df).columns == df.columns and set(got) == {1, 3, 4, 5}
    assert got[5]["text"] == "head éé tail" and got[5]["n_chars"] == 12 and got[4]["text"] is None


def test_merge_is_the_sorted_order():
    r = np.random.default_rng(2)
    texts = [[bytes(r.integers(97, 99, r.integers(2, 70)).astype(np.uint8)) for _ in range(9)] for _ in range(3)]
    shards = [s.Shard(np.append(0, np.cumsum([len(t) for t in part])), np.frombuffer(b"".join(part), np.uint8)) for part in texts]
    of, common = s.merge(shards, 80)
    ids, suffixes = 0, []
    for j, part in enumerate(texts):
        for t in part:
            suffixes += [([x + 1 for x in t[i:]] + [0, ids], j) for i in range(len(t) + 1)]
            ids += 1
    key = lambda x: [c if i < len(x[0]) - 1 else x[0][-1] for i, c in enumerate(x[0])]
    suffixes.sort(key=key)
    assert of.tolist() == [j for _, j in suffixes]
    for i in range(1, len(suffixes)):
        a, b = suffixes[i - 1][0][:-2], suffixes[i][0][:-2]
        n = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[i] == n // 2 * 2


def test_empty(docs):
    assert s.digest(docs([])).count() == 0 and s.clean(docs([])).count() == 0


def test_merge_by_longer_strides_is_the_same():
    r = np.random.default_rng(3)
    texts = [[bytes(r.integers(97, 99, r.integers(1, 90)).astype(np.uint8)) for _ in range(12)] for _ in range(3)]
    shards = [s.Shard(np.append(0, np.cumsum([len(t) for t in part])), np.frombuffer(b"".join(part), np.uint8)) for part in texts]
    of, common = s.merge(shards, s.LENGTH)
    again, rounded = s.merge(shards, s.LENGTH, s.STRIDE)
    assert (of == again).all() and ((common == s.LENGTH) == (rounded == s.LENGTH)).all()
    with pytest.raises(ValueError):
        s.merge(shards, s.LENGTH + 1, s.STRIDE)


def test_short_phrases_bring_no_documents_together(docs):
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    phrases = [letters(20) for _ in range(20)]
    df = docs([(i, "".join(p + letters(40) for p in phrases)) for i in range(10)])
    assert s._repeating(s._cut(df, 4), 4).count() == 0
