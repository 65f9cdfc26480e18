"""Jaccard join on word shingles by adaptive multi-match prefixes, and the groups that its links make.

Two sets of similarity 0.8 or more share the l first of their common shingles, in any order of all shingles, within the
first n - ceil(0.8 n) + l of each. Every document chooses its own l from 1 to ``LONGEST``: the one whose estimated cost is
least, reading the lists of its prefix and verifying those that may share l of them. A pair is a candidate if it shares
min(l, l') shingles within the prefixes of that length, and is then verified on the whole sets.

- Order: rarer shingles first by a count sketch of fixed size over all documents, then by hash.
- A shared shingle only counts where enough of both sets is left from its place on.
- Equal sets are one class; only classes are joined, and their members get what the class gets.
- Before shared shingles are counted, bit sets of the prefixes tell apart classes that cannot share as many as are asked.
- Links in a large group are found as stars: each class is first verified with the earliest and latest class that share
  most of its prefix. All candidate pairs that then still lie in different components are verified, so no component is
  missed, and a group of near copies does not become all its pairs.
- Shingles are 64-bit hashes of five words, classes 128-bit hashes of sets.

Null text, and text without words, has the empty set and is linked with nothing; fewer than five words are one shingle.
Rows that repeat a doc_id are documents each; rows without one are grouped, but name no component unless it has no
other. An empty table gives no rows; further columns are ignored, or kept by `keep_first`. Documents must not change while
they are read: sets that are not found again raise an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placespark.llm.common import coded, dropped, hashed, mixed, slices, stored, strings, words
from placespark.llm.graph import components

WORDS = 5
PERCENT = 80
LONGEST = 4
CELLS = 1 << 18
#: Longs of the bit set by which classes that cannot share enough tokens are told apart before they are counted.
MASKS = 4
#: Cost of verifying a candidate, in list entries read.
VERIFY = 8.0

DOCS = "row long, doc_id long, text_hash long, n_shingles long, s1 long, s2 long, level_limit int, prefix array<long>"


def needed(n: np.ndarray) -> np.ndarray:
    """Shingles that a set of n shares at least with a similar one."""
    return -(-PERCENT * n // 100)


def shingles(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of all shingles of the texts, repeated ones too."""
    rows, found = words(strings(piece["text"]))
    rows = rows.astype(np.int64)
    codes, distinct = coded(found)
    each = hashed(pc.ascii_lower(distinct))[codes]
    count = np.bincount(rows, minlength=piece.num_rows)
    total = np.zeros(len(each), np.uint64)
    first = np.repeat(np.cumsum(count) - count, count)
    place = np.arange(len(each)) - first
    length = np.minimum(count, WORDS)[rows] if len(rows) else count[:0]
    for i in range(WORDS):
        part = each[i:]
        within = i < length[: len(part)]
        total[: len(part)] = np.where(
            within, mixed(total[: len(part)] + part + np.uint64(i + 1)), total[: len(part)]
        )
    kept = place + length <= count[rows] if len(rows) else np.zeros(0, bool)
    kept &= (place == 0) | (length == WORDS)
    return rows[kept], total[kept]


def distinct_sets(rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by text, then by token, each once."""
    order = np.lexsort((tokens, rows))
    rows, tokens = rows[order], tokens[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (tokens[1:] != tokens[:-1])
    return rows[new], tokens[new]


def signature(tokens: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(tokens.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketch(documents: DataFrame) -> np.ndarray:
    """Occurrences of shingles by cell, over all documents."""

    def task(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                _, tokens = shingles(piece)
                total += np.bincount((tokens % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["cell", "n"])

    found = documents.select("text").mapInArrow(task, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CELLS, np.int64)
    counts[found["cell"].to_numpy()] = found["n"].to_numpy()
    return counts


def choose(excess: np.ndarray, n: int) -> int:
    """The number of matches to ask for, by the excess counts of the first shingles; the sum of a prefix's counts, shared
    out by the matches asked for, bounds its candidates."""
    base = n - int(needed(np.int64(n)))
    best, cost = 1, np.inf
    for length in range(1, min(LONGEST, int(needed(np.int64(n)))) + 1):
        entries = float(excess[: base + length].sum())
        now = entries + VERIFY * entries / length
        if now < cost:
            best, cost = length, now
    return best


def prefixes(documents: DataFrame, counts: np.ndarray) -> DataFrame:
    """Class, set size and prefix of each document. A shingle at place i of the prefix counts for pairs that ask for
    i - (n - needed(n)) + 1 matches or more."""
    noise = max(1.0, counts.sum() / CELLS)
    shared = documents.sparkSession.sparkContext.broadcast(counts)

    def task(batches):
        counts = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch, "text"):
                n = piece.num_rows
                rows, tokens = distinct_sets(*shingles(piece))
                size = np.bincount(rows, minlength=n)
                ends = np.cumsum(size)
                count = counts[(tokens % np.uint64(CELLS)).astype(np.int64)]
                excess = np.maximum(1.0, count - noise)
                order = np.lexsort((tokens, count, rows))
                ranked, weight = tokens[order].astype(np.int64), excess[order]
                s1, s2, limits, parts = [], [], [], []
                for end, k in zip(ends.tolist(), size.tolist(), strict=True):
                    begin = end - k
                    a, b = signature(tokens[begin:end])
                    s1.append(a)
                    s2.append(b)
                    limit = choose(weight[begin:end], k) if k else 0
                    limits.append(limit)
                    parts.append(ranked[begin : begin + (k - int(needed(np.int64(k))) + limit if k else 0)])
                offsets = np.append(0, np.cumsum([len(p) for p in parts]))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]))
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + n)), piece["doc_id"], piece["text_hash"], pa.array(size, pa.int64()),
                        pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(limits, pa.int32()), lists,
                    ],
                    ["row", "doc_id", "text_hash", "n_shingles", "s1", "s2", "level_limit", "prefix"],
                )
                number += n

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(task, DOCS)


def _postings(docs: DataFrame) -> DataFrame:
    """(token, class, place) of every prefix shingle, from one document of each class."""
    return docs.select(F.col("row").alias("cid"), F.posexplode("prefix").alias("place", "token"))


def _reach(n: str, place: str, n_other: str, place_other: str, matches: int | Column) -> Column:
    """Whether sets of these sizes can be similar whose ``matches``-th common shingle or an earlier one is at these
    places: no more than what is left from there on, and the matches before, can be common."""
    left = F.least(F.col(n) - F.col(place), F.col(n_other) - F.col(place_other)) + matches - 1
    return ((100 + PERCENT) * left >= PERCENT * (F.col(n) + F.col(n_other))) & (
        100 * F.least(n, n_other) >= PERCENT * F.greatest(n, n_other)
    )


def _mask_columns() -> list[Column]:
    """A set of bits by token, and the number of tokens."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(shiftright(token, {MASKS.bit_length()}), 64) as int))")
    own = F.pmod(F.col("token"), F.lit(MASKS))
    bits = [F.bit_or(F.when(own == i, bit).otherwise(F.lit(0).cast("long"))).alias(f"mask{i}") for i in range(MASKS)]
    return [*bits, F.count("*").alias("tokens")]


def _common(a: str, b: str) -> Column:
    """Bits that both masks have. Tokens that share a bit with another one are beyond that, at most the spare ones."""
    both = [F.bit_count(F.col(a.format(i)).bitwiseAND(F.col(b.format(i)))) for i in range(MASKS)]
    return sum(both[1:], both[0])


def _sets(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, sorted set) of these classes, from the text of their first document."""

    def task(batches):
        for batch in batches:
            for piece in slices(batch, "text"):
                rows, tokens = distinct_sets(*shingles(piece))
                size = np.bincount(rows, minlength=piece.num_rows)
                offsets = np.append(0, np.cumsum(size))
                for i, (s1, s2) in enumerate(zip(piece["s1"].to_pylist(), piece["s2"].to_pylist(), strict=True)):
                    if signature(tokens[offsets[i] : offsets[i + 1]]) != (s1, s2):
                        raise ValueError("a document's shingles are not those it had before: its text has changed meanwhile")
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(tokens.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([piece["cid"], lists], ["cid", "tokens"])

    wanted = classes.select("cid", "s1", "s2", F.col("first").alias("id"), F.col("text_hash").alias("same"))
    texts = documents.select("doc_id", "text")
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("same")))
    found = texts.select("cid", "s1", "s2", "text").mapInArrow(task, "cid long, tokens array<long>")
    return stored(found, "join-sets")


def _verified(documents: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar; sets are made anew for the classes that are in a pair."""

    def task(batches):
        for batch in batches:
            kept = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = (v.values.to_numpy(zero_copy_only=False).view(np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(kept, pa.bool_()))

    pairs = stored(pairs.select("a", "b").distinct(), "join-pairs")
    nodes = stored(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct(), "join-nodes")
    sets = _sets(documents, classes.join(nodes, "cid"))
    if lost := nodes.join(sets, "cid", "left_anti").count():
        raise ValueError(f"{lost} sets were not found again: the documents have changed meanwhile")
    x = sets.select(F.col("cid").alias("a"), F.col("tokens").alias("x"))
    y = sets.select(F.col("cid").alias("b"), F.col("tokens").alias("y"))
    joined = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    found = stored(joined.mapInArrow(task, "a long, b long").distinct(), "join-links")
    dropped(pairs, nodes, sets)
    return found


def links(documents: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, links between classes that make their components); docs are deleted when they are read."""
    classes = stored(
        docs.filter("n_shingles > 0")
        .groupBy("s1", "s2")
        .agg(
            F.min("row").alias("cid"), F.max("n_shingles").alias("n"), F.max("level_limit").alias("level_limit"),
            F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")).alias("of"),
        )
        .select("s1", "s2", "cid", "n", "level_limit", F.col("of.doc_id").alias("first"), F.col("of.text_hash").alias("text_hash")),
        "join-classes",
    )
    postings = _postings(docs.join(classes.select("cid"), F.col("row") == F.col("cid"), "left_semi"))
    tokens = postings.groupBy("token").count().filter("count > 1")
    postings = stored(postings.join(tokens.select("token"), "token"), "join-postings")
    shared = stored(
        postings.join(classes, "cid").select("token", "cid", "first", "n", "place", "level_limit"), "join-shared"
    )
    dropped(docs, postings)

    ends = shared.groupBy("token").agg(
        F.min_by("cid", F.struct("first", "cid")).alias("earliest"), F.max_by("cid", F.struct("first", "cid")).alias("latest")
    )
    met = shared.select("token", "cid").join(ends, "token")
    met = met.select("cid", F.explode(F.array("earliest", "latest")).alias("other")).filter("cid <> other")
    counted = met.groupBy("cid", "other").agg(F.count("*").alias("n_shared"))
    size = classes.select(F.col("cid").alias("other"), F.col("n").alias("n_other"), F.col("first").alias("first_other"), F.col("level_limit").alias("limit_other"))
    counted = counted.join(size, "other").join(classes.select("cid", "n", "first", "level_limit"), "cid")
    counted = counted.filter(100 * F.least("n", "n_other") >= PERCENT * F.greatest("n", "n_other"))
    counted = counted.filter(F.col("n_shared") >= F.least("level_limit", "limit_other"))  # stars only have to find most links
    best = counted.groupBy("cid", (F.col("first_other") < F.col("first")).alias("side")).agg(
        F.max_by("other", F.struct("n_shared", "other")).alias("other")
    )
    stars = best.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()
    first_links = _verified(documents, classes, stars)
    groups = stored(components(first_links), "join-groups")

    grouped = shared.join(groups, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    mixed_tokens = grouped.groupBy("token").agg(F.min("root").alias("r"), F.max("root").alias("q")).filter("r < q")
    grouped = stored(
        grouped.join(mixed_tokens.select("token"), "token").select("token", "root", "cid", "n", "place", "level_limit"),
        "join-mixed",
    )
    masks = grouped.groupBy("cid").agg(*_mask_columns())
    dropped(shared)
    masked = stored(grouped.join(masks, "cid").withColumn("spare", F.col("tokens") - _common("mask{}", "mask{}")), "join-masked")
    dropped(grouped)
    of = masked.groupBy("token", "root", "n").agg(F.min("place").alias("place"))
    left, right = of.toDF("token", "root_a", "n_a", "place_a"), of.toDF("token", "root_b", "n_b", "place_b")
    roots = left.join(
        right, (left["token"] == right["token"]) & F.expr("root_a < root_b") & _reach("n_a", "place_a", "n_b", "place_b", LONGEST)
    ).select(left["token"], "root_a", "n_a", "root_b", "n_b")
    columns = ["token", "root", "cid", "n", "place", "level_limit", *(f"mask{i}" for i in range(MASKS)), "spare"]
    left, right = (
        masked.select("token", *(F.col(c).alias({"cid": x, "level_limit": f"limit_{x}"}.get(c, f"{c}_{x}")) for c in columns[1:]))
        for x in "ab"
    )
    asked = F.least("limit_a", "limit_b")
    level = {x: F.col(f"place_{x}") - F.floor(F.col(f"n_{x}") * (100 - PERCENT) / 100) + 1 for x in "ab"}
    crossing = (
        roots.join(left, ["token", "root_a", "n_a"])
        .join(right, ["token", "root_b", "n_b"])
        .filter((level["a"] <= asked) & (level["b"] <= asked) & _reach("n_a", "place_a", "n_b", "place_b", asked))
        .filter(_common("mask{}_a", "mask{}_b") + F.least("spare_a", "spare_b") >= asked)
        .groupBy("a", "b", asked.alias("asked"))
        .agg(F.count("*").alias("n_shared"))
        .filter("n_shared >= asked")
    )
    found = first_links.union(_verified(documents, classes, crossing))
    dropped(masked)
    return classes, found


def _grouped(documents: DataFrame) -> DataFrame:
    """Set size and component of each document, with the hash of its text, and whether it stands for its component."""
    prefixed = stored(prefixes(documents, sketch(documents)), "join-prefixes")
    docs = stored(prefixed.drop("prefix"), "join-docs")
    classes, found = links(documents, prefixed)
    groups = components(found)
    named = classes.select("cid", "s1", "s2", "first", "text_hash").join(groups, F.col("cid") == F.col("node"), "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    top = F.min(F.struct(F.col("first").isNull().alias("nameless"), F.col("first").alias("name"), F.col("text_hash").alias("same")))
    names = named.groupBy(F.col("root").alias("of")).agg(top.alias("top"))
    named = named.join(names, F.col("root") == F.col("of")).select("s1", "s2", "top.name", "top.same")
    joined = docs.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(stored(named, "join-names"), ["s1", "s2"], "left")
    has = F.col("n_shingles") > 0
    component = F.when(has, F.col("name")).otherwise(F.col("doc_id"))
    stands = ~has | (F.col("doc_id").eqNullSafe(F.col("name")) & (F.col("text_hash") == F.col("same")))
    return joined.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), stands.alias("stands"))


def group(documents: DataFrame) -> DataFrame:
    """Set size and component of each document."""
    return _grouped(documents).select("doc_id", "n_shingles", "component_id")


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component, that of the smallest doc_id (rows without one last), and all that have no words.
    Each row is judged by its own text; of rows that repeat a doc_id and text, one stays."""
    inner = documents.select(F.struct(*documents.columns).alias("doc"), "doc_id", F.xxhash64("text").alias("text_hash"))
    found = _grouped(documents).groupBy("doc_id", "text_hash").agg(F.every("stands").alias("stands"), F.max("n_shingles").alias("n"), F.count("*").alias("times"))
    found = stored(found, "join-found").withColumnsRenamed({"doc_id": "id", "text_hash": "same"})
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("same"))
    again = F.col("stands") & (F.col("times") > 1) & ((F.col("n") > 0) | F.col("id").isNotNull())
    left = stored(found.filter(~F.col("stands") | again).select("id", "same"), "join-left")
    kept = inner.join(left, same, "left_anti").select("doc.*")
    repeated = inner.join(stored(found.filter(again).select("id", "same"), "join-again"), same, "left_semi")
    return kept.unionByName(repeated.groupBy("doc_id", "text_hash").agg(F.any_value("doc").alias("doc")).select("doc.*"))


ORACLE = rf"""
WITH RECURSIVE docs AS (
    SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
grams AS (
    SELECT DISTINCT r, array_to_string(ws[i : i + {WORDS - 1}], ' ') AS gram
    FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - {WORDS - 1}) + 1)) AS i FROM docs WHERE len(ws) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (
    SELECT a.r AS a, b.r AS b, count(*) AS n FROM grams a JOIN grams b ON a.gram = b.gram AND a.r <> b.r GROUP BY ALL),
linked AS (
    SELECT a, b FROM pairs JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b
    WHERE 100 * pairs.n >= {PERCENT} * (x.n + y.n - pairs.n)),
reach AS (SELECT a, b FROM linked UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a)
SELECT d.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, least(d.doc_id, min(o.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes ON sizes.r = d.r LEFT JOIN reach ON reach.a = d.r LEFT JOIN docs o ON o.r = reach.b
GROUP BY d.r, d.doc_id"""
