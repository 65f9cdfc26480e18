import hashlib
import random
import re
from collections import Counter, defaultdict
from math import comb

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from placespark.llm import mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def goals(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in order if s not in full)
        new = {s for s in order if s not in full and weight[s] * left / open_weight > 3 * sizes[s]}
        if not new:
            return sizes, {s: 3 * sizes[s] if s in full else weight[s] * left / open_weight for s in order}
        full |= new


def brute(rows):
    """Each document's share of its source's line, as often as the target goes round it."""
    sizes, target = goals(rows)
    lines = defaultdict(list)
    for doc, text, source in rows:
        digest = hashlib.md5(f"0:{'' if doc is None else doc}:{text or ''}".encode()).hexdigest()
        lines[source].append((digest, len(words(text)), doc))
    out = []
    for source, line in lines.items():
        place, goal = 0, int(target[source] + 0.5)
        for _, size, doc in sorted(line, key=lambda x: x[:2]):
            taken = sum(max(0, min(size, goal - place - e * sizes[source])) for e in range(4)) if size else 0
            out.append((doc, size, sizes[source], round(target[source], 6), taken))
            place += size
    return Counter(out)


def corpus(seed, n=300, sources=12):
    r = random.Random(seed)
    names = [None, "hot", "ä", "Z", "", *(f"s{i}" for i in range(sources))]
    rows = []
    for i in range(n):
        source = "hot" if r.random() < 0.4 else r.choice(names)
        rows.append((i, " \t".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 40, 200]))), source))
    return [*rows, (7, None, "hot"), (None, "a b", None), (None, "a b", None), (8, "x " * 5000, "s1"), rows[0], rows[0]]


@pytest.mark.parametrize("seed, block, shards", [(1, 16, 7), (2, 4096, 1), (3, 100, 16)])
def test_against_brute_force(docs, seed, block, shards):
    rows = corpus(seed)
    got = mixing.mix(docs(rows), block=block, shards=shards).collect()
    assert Counter((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in got) == brute(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(goals(rows)[1].values())) < 20


def test_same_as_sql(docs):
    df = docs(corpus(5), extra=False)
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    assert check.compare(mixing.mix(df).toPandas(), con.execute(mixing.ORACLE).fetch_df()).startswith("ok")


def test_mixed_documents(docs):
    rows = corpus(4)
    df = docs(rows).withColumns({c: F.lit("x") for c in ("shard", "place", "piece", "s", "size", "hash")})
    got = mixing.mixed(df, block=50, shards=5).collect()
    assert sorted(map(str, mixing.mixed(df.repartition(7), block=50, shards=5).collect())) == sorted(map(str, got))
    taken = Counter()
    for r in got:
        assert r["words"] == len(words(r["text"])) > 0 and (r["text"] == r["doc"]["text"] or words(r["text"]) == words(r["doc"]["text"])[: r["words"]])
        taken[r["doc"]["doc_id"], r["doc"]["text"]] += r["words"]
    want = Counter()
    text = {(d, len(words(t))): t for d, t, _ in rows}
    for (doc, size, _, _, n), times in brute(rows).items():
        want[doc, text[doc, size]] += n * times
    assert taken == +want
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["place"])
    assert set(by_shard) == set(range(5)) and all(sorted(p) == list(range(1, len(p) + 1)) for p in by_shard.values())


@pytest.mark.parametrize("n_sources, shards", [(5, 13), (200, 6)])
def test_quotas_are_exact(spark, n_sources, shards):
    r = random.Random(n_sources)
    quotas = {s: r.choice([0, 1, 2, 30, 400]) for s in range(n_sources)} | {1: 3000}
    found = mixing.leaves(spark.createDataFrame(list(quotas.items()), "s long, q long"), shards, 3).collect()
    ranges = defaultdict(list)
    sizes = Counter()
    for x in found:
        ranges[x["s"]].append((x["low"], x["low"] + x["q"]))
        sizes[x["shard"]] += x["q"]
    for s, q in quotas.items():
        ends = sorted(ranges[s])
        assert [a for a, _ in ends] == [0, *(b for _, b in ends)][: len(ends)] and (ends[-1][1] if ends else 0) == q
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1 + shards.bit_length()


@pytest.mark.parametrize("total, own, n", [(20, 7, 9), (1000, 30, 400), (5, 5, 3), (6, 0, 2), (300000, 120000, 1000)])
def test_draws_are_hypergeometric(spark, total, own, n):
    u = (F.col("id") + F.lit(0.5)) / F.lit(2000.0)
    args = [F.lit(x).cast("long") for x in (total, own, n)]
    got = Counter(r[0] for r in spark.range(2000).select(mixing.hypergeometric(*args, u).alias("x")).collect())
    for k in range(max(0, n - total + own), min(own, n) + 1):
        p = comb(own, k) * comb(total - own, n - k) / comb(total, n) if total <= 1000 else None
        assert p is None or abs(got[k] - 2000 * p) <= 1
    mean = sum(k * c for k, c in got.items()) / 2000
    spread = (sum((k - mean) ** 2 * c for k, c in got.items()) / 2000) ** 0.5
    share = own / total
    assert abs(mean - n * share) < 0.02 * (1 + n * share)
    assert abs(spread - (n * share * (1 - share) * (total - n) / max(1, total - 1)) ** 0.5) < 0.5


def test_empty(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.mixed(docs([])).count() == 0
    got = mixing.mix(docs([(1, None), (2, " "), (None, "")])).collect()
    assert sorted((r["size"], r["source_size"], r["target"], r["taken"]) for r in got) == [(0, 0, 0.0, 0)] * 3
