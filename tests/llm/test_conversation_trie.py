import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import check
from placespark.llm import conversation_trie as trie

COLUMNS = "conv_id long, turn long, role string, text string"


def brute(rows):
    md5 = lambda x: hashlib.md5((x or "").encode()).hexdigest()
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, md5(r[2]), md5(r[3])))
    own = defaultdict(list)
    for conv, _, role, text in order:
        own[conv].append((role or "", text or ""))
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        seq = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[seq].append(c)
        for d in range(len(seq) + 1):
            members[seq[:d]].add(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for node in members:
        if node:
            children[node[:-1]] += 1
            for d in range(len(node) + 1):
                saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode())
    for node in members:
        if not children[node]:
            for d in range(len(node) + 1):
                leaves[node[:d]] += 1
    out = []
    for node, who in members.items():
        parent = min(members[node[:-1]]) if node else None
        ids = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(who), len(node), parent, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ids.encode()).hexdigest()))
    return Counter(out)


def corpus(seed):
    r = random.Random(seed)
    rows = []
    pool = [("user", "hi"), ("user", "hi there"), ("assistant", "ü"), (None, "x"), ("user", None), ("", "")]
    for c in range(r.randint(0, 3), 90):
        if r.random() < 0.2:
            continue
        for turn in range(r.randint(1, 9)):
            rows.append((c, turn if r.random() < 0.9 else None, *r.choice(pool)))
    copied = [(t, role, text) for c, t, role, text in rows if c == rows[0][0]]
    rows += [(c, *x) for c in range(200, 330) for x in copied]  # a group of copies
    rows += [(-7, 0, "user", "below"), (-5, 0, "user", "zero"), (None, 0, "user", "nobody"), (400, 5, "a", "b"), (400, 5, "a", "b"), (400, 5, "a", "a")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("x") for c in ("depth", "k1", "r", "range")}).repartition(5)
    assert Counter(map(tuple, trie.nodes(trie.rebuilt(df)).collect())) == brute(rows)


def test_long_conversations(spark):
    """Conversations over several ranges of rows, which agree for long and end apart, copies among them."""
    turn = lambda c, i: (c, i, "user", f"turn {i}")
    rows = [turn(0, i) for i in range(1500)] + [turn(5, i) for i in range(1500)] + [turn(10, i) for i in range(12)]
    rows += [(15, i, "user", f"turn {i if i < 12 else -i}") for i in range(900)]
    df = spark.createDataFrame(rows, COLUMNS).repartition(4)
    assert Counter(map(tuple, trie.nodes(trie.rebuilt(df)).collect())) == brute(rows)


def test_same_as_sql(spark):
    df = spark.createDataFrame(corpus(7), COLUMNS)
    con = duckdb.connect()
    con.register("conversations", df.toArrow())
    assert check.compare(trie.nodes(trie.rebuilt(df)).toPandas(), con.execute(trie.ORACLE).fetch_df()).startswith("ok")


def test_no_turn_is_left(spark):
    """A conversation all of whose turns are replaced by those of one that is not there is a member of the root alone."""
    conv = next(c for c in range(1, 999) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    got = trie.nodes(trie.rebuilt(spark.createDataFrame([(conv, 0, "user", "gone")], COLUMNS))).collect()
    assert [tuple(r) for r in got] == [(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())]


def test_own_trie(spark):
    """Nodes of conversations as they are, without rebuilding."""
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "bb"), (2, 0, "u", "a"), (2, 1, "u", "bb"), (3, 0, "u", "a")], COLUMNS)
    rows = trie.original(df)
    got = {(r["depth"], r["conv_id"]): (r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) for r in trie.nodes((rows.select("conv_id").distinct(), rows)).collect()}
    assert got == {(0, 1): (3, 1, 1, 4), (1, 1): (3, 1, 1, 4), (2, 1): (2, 0, 1, 2)}


def test_empty(spark):
    assert trie.nodes(trie.rebuilt(spark.createDataFrame([], COLUMNS))).count() == 0
    assert trie.nodes(trie.rebuilt(spark.createDataFrame([(None, 1, "u", "t")], COLUMNS))).count() == 0
