"""Hard negatives by exact scores: matrix products in a residue number system, then selection by a window of scores.

Components are floored to integers, so scores are integers, and they have to be exact, as ties and windows hang on single
units. Both matrices are reduced modulo several small primes and multiplied in float32, where products of residues are
exact as long as a run of components stays below 2^24; the signed scores are put together again by Chinese remaindering in
digits around zero. The number of primes follows from the largest components of the two blocks.

- Rows are dealt into blocks of bounded bytes. Anchors are dealt into groups, and every pair of block and group meets in one
  task: first for the ``n_positives`` best rows of an anchor's own label, then, with their scores known, for the
  ``n_negatives`` best rows of other labels within ``low`` to ``high`` percent of each. A pair returns only its best few,
  the best of all blocks are chosen from these.
- Nothing is broadcast, no task holds more than one block and one group.

Rows with a null label, a null vector or a null or non-finite component take no part. Shorter vectors count as filled up
with zeros, empty ones included. Ties go by smaller vec_id, rows without one last; these are never anchors, and rows that
repeat a vec_id are rows (and anchors) each. Scores must fit a long, otherwise an error is raised. An anchor without another
row of its label, or without rows in the window, returns nothing. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.common import stored

N_POSITIVES, N_NEGATIVES = 5, 3
LOW, HIGH = 50, 95
#: Rows of a block and anchors of a group at most, and components of either.
BLOCK_ROWS, GROUP_ROWS, BLOCK_SIZE = 8192, 4096, 1 << 22
#: Scores that a task looks at together.
SCORES = 1 << 21
#: Largest prime, so that 64 products of residues and more are exact in float32.
LARGEST = 1021

BLOCKS = "block int, ids array<long>, labels array<long>, width int, vectors binary"
ANCHORS = "row long, anchor_id long, label long, vector binary"


def primes() -> list[int]:
    """Odd primes up to the largest, in falling order."""
    return [p for p in range(LARGEST, 2, -1) if all(p % d for d in range(2, math.isqrt(p) + 1))]


def _around_zero(x: np.ndarray, p: int) -> np.ndarray:
    """The residue of float32 integers below 2^24 that is nearest to 0; twice, as the quotient may be off by one."""
    for _ in range(2):
        x = x - np.float32(p) * np.rint(x / np.float32(p))
    return x


def _residues(m: np.ndarray, p: int) -> np.ndarray:
    r = np.mod(m, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def _modular(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, by runs of components whose sums are exact in float32."""
    run = ((1 << 24) - 2 * p) // (p // 2) ** 2
    a, b = _residues(a, p), _residues(b, p)
    total = np.zeros((len(a), len(b)), np.float32)
    for i in range(0, a.shape[1], run):
        total = _around_zero(total + _around_zero(a[:, i : i + run] @ b[:, i : i + run].T, p), p)
    return total


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64 matrices, exact."""
    width = a.shape[1]
    largest = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (a, b)]
    bound = width * largest[0] * largest[1]
    if bound >= 1 << 62:
        raise OverflowError("scores do not fit a long")
    used, reach = [], 1
    for p in primes():
        if used and reach > 2 * bound + 1:
            break
        used.append(p)
        reach *= p
    digits: list[np.ndarray] = []
    out = np.zeros((len(a), len(b)), np.int64)
    place = 1
    for k, p in enumerate(used):
        r, before = _modular(a, b, p), 1
        for q, d in zip(used[:k], digits, strict=True):  # what the digits so far are modulo p
            r = _around_zero(r - _around_zero(d * np.float32(before % p), p), p)
            before *= q
        inverse = pow(before % p, -1, p) if k else 1
        digit = _around_zero(r * np.float32(inverse), p)
        digits.append(digit)
        out += digit.astype(np.int64) * np.int64(place)
        place *= p
    return out


def _whole(x: Column) -> Column:
    return F.floor(F.lit(256.0) * x.cast("double"))


def taking_part(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, as integers."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    return rows.select("vec_id", moved.alias("label"), F.transform("embedding", _whole).alias("vector"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, column] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _blocks(rows: DataFrame, n: int, width: int) -> DataFrame:
    """The rows dealt into n blocks, each sorted by vec_id and packed in one row."""

    def task(batches):
        batches = list(batches)  # the rows of one block
        if not sum(b.num_rows for b in batches):
            return
        found = pa.Table.from_batches(batches).sort_by([("vec_id", "ascending")]).combine_chunks()  # nulls last
        vectors = _matrix(found["vector"].combine_chunks(), width)
        size = 4 if not vectors.size or np.abs(vectors).max() < 1 << 31 else 8
        row = (TaskContext.get().partitionId(), found["vec_id"].to_pylist(), found["label"].to_pylist(), size, vectors.astype(f"<i{size}").tobytes())
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], _names(BLOCKS))

    return rows.repartition(n).mapInArrow(task, BLOCKS)


def _unpacked(data: bytes, size: int, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{size}").reshape(rows, width).astype(np.int64)


def _anchors(blocks: DataFrame, width: int, every: int) -> DataFrame:
    """A row for each anchor; row is its block and its place there."""

    def task(batches):
        for batch in batches:
            for block, ids, labels, size, data in zip(*(batch[c] for c in _names(BLOCKS)), strict=True):
                ids, labels = ids.values, labels.values
                vectors = _unpacked(data.as_py(), size.as_py(), len(ids), width)
                at = np.flatnonzero(pc.fill_null(ids, 1).to_numpy(zero_copy_only=False) % every == 0)
                own = pa.array([vectors[i].tobytes() for i in at], pa.binary())
                row = pa.array((block.as_py() << 32) + at, pa.int64())
                yield pa.RecordBatch.from_arrays([row, ids.take(pa.array(at)), labels.take(pa.array(at)), own], _names(ANCHORS))

    return blocks.mapInArrow(task, ANCHORS)


def _ordered(scores: np.ndarray) -> np.ndarray:
    """Places of each row of scores by falling score, then by place."""
    n = scores.shape[1]
    bits = max(1, (n - 1).bit_length())
    if max(abs(int(scores.min())), abs(int(scores.max()))) >= 1 << (62 - bits):
        return np.argsort(-scores, axis=1, kind="stable")
    keys = np.sort((-scores << bits) | np.arange(n), axis=1)  # one number for score and place
    return keys & ((1 << bits) - 1)


def _met(
    blocks: DataFrame, anchors: DataFrame, n_blocks: int, n_groups: int, width: int, schema: str,
    best: Callable[[dict, np.ndarray, np.ndarray, np.ndarray], list[tuple]],
) -> DataFrame:
    """The rows that best(anchor, scores in falling order, their places, their labels) finds for each anchor in each block,
    with the vec_ids that it gives by their places."""

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            block, ids, labels, size, data = (left[c][0].as_py() for c in _names(BLOCKS))
            rows, labels = _unpacked(data, size, len(ids), width), np.array(labels, np.int64)
            step = max(1, SCORES // len(rows))
            for i in range(0, right.num_rows, step):
                some = right.slice(i, step).to_pylist()
                scores = products(np.stack([np.frombuffer(a["vector"], np.int64) for a in some]), rows)
                order = _ordered(scores)
                scores = np.take_along_axis(scores, order, axis=1)
                for k, anchor in enumerate(some):
                    if anchor["row"] >> 32 == block:
                        other = order[k] != anchor["row"] & 0xFFFFFFFF
                        found = best(anchor, scores[k][other], order[k][other], labels[order[k][other]])
                    else:
                        found = best(anchor, scores[k], order[k], labels[order[k]])
                    out += [(*row[:-1], ids[row[-1]]) for row in found]
        columns = zip(*out, strict=True) if out else [()] * len(_names(schema))
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(_names(schema), columns, strict=True)})

    of_group = F.pmod(F.xxhash64("row"), F.lit(n_groups)).cast("int")
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).groupBy("block", "group")
    right = anchors.withColumn("group", of_group).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    return left.cogroup(right.groupBy("block", "group")).applyInArrow(pair, schema)


def mine(
    embeddings: DataFrame, every: int = 50, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH
) -> DataFrame:
    """Hard negatives of each anchor (a vec_id divisible by ``every``) and each of its positives."""
    rows = stored(taking_part(embeddings), "negatives-rows")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = size["width"] or 0
    per_block = max(1, min(BLOCK_ROWS, BLOCK_SIZE // max(1, width)))
    n_blocks = max(1, math.ceil(size["n"] / per_block))
    blocks = stored(_blocks(rows, n_blocks, width), "negatives-blocks")
    anchors = stored(_anchors(blocks, width, every), "negatives-anchors")
    per_group = max(1, min(GROUP_ROWS, BLOCK_SIZE // max(1, width)))
    n_groups = max(1, math.ceil(anchors.count() / per_group))

    def alike(anchor, scores, places, labels):
        at = np.flatnonzero(labels == anchor["label"])[:n_positives]
        return [(anchor["row"], int(scores[i]), int(places[i])) for i in at]

    met = _met(blocks, anchors, n_blocks, n_groups, width, "row long, positive_score long, positive_id long", alike)
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    positives = met.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n_positives)
    positives = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_id", "positive_score"))).alias("positives"))
    anchors = stored(anchors.join(positives, "row"), "negatives-positives")

    def unlike(anchor, scores, places, labels):
        other = labels != anchor["label"]
        falling, places = -scores[other], places[other]
        out = []
        for p in anchor["positives"]:
            least, most = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
            first, end = np.searchsorted(falling, -most, "left"), np.searchsorted(falling, -least, "right")
            for i in range(first, min(end, first + n_negatives)):
                out.append((anchor["row"], p["nth"], -int(falling[i]), int(places[i])))
        return out

    met = _met(blocks, anchors, n_blocks, n_groups, width, "row long, nth long, negative_score long, negative_id long", unlike)
    order = Window.partitionBy("row", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    negatives = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives)
    of = anchors.select("row", "anchor_id", F.explode("positives").alias("p"))
    of = of.select("row", "anchor_id", F.col("p.nth").cast("long").alias("nth"), "p.positive_id", "p.positive_score")
    return of.join(negatives, ["row", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = f"""
WITH valid AS (
    SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
    SELECT a.r AS anchor, a.vec_id AS anchor_id, b.r AS r, b.vec_id AS vec_id, a.label = b.label AS alike,
        CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
    FROM valid a JOIN valid b ON a.r <> b.r AND a.vec_id % 50 = 0),
positives AS (
    SELECT * FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, r) <= {N_POSITIVES}),
negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.score DESC, n.vec_id NULLS LAST, n.r) AS rank
    FROM positives p JOIN scored n ON p.anchor = n.anchor AND NOT n.alike
    WHERE {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= {N_NEGATIVES}"""
