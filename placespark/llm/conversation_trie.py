"""Prefix trie of conversations by truncation peeling.

Conversations are lists of turns (role, text); a node of the trie is a sequence of first turns that some of them share. The
peeling descends from the greatest depth: conversations that end there are merged with the nodes that have survived from
below, by the key of their turns; what they are together is known then, as all that is below has been added up already. Each
node is then stripped of its last turn, which gives the key to be grouped by at the depth above.

- The key of a sequence is the exclusive or of two 64-bit hashes of each turn and its place, so stripping a turn is one
  more exclusive or, and running keys of a long conversation are put together from the ranges of turns that tasks have.
- Equal conversations are one sequence with a count from the start. A sequence's turns that no other sequence shares are
  peeled in one go, as nothing can be merged there; the others go up depth by depth, so there are as many steps as
  turns at which two different sequences still agree.
- No task sees a whole conversation or all members of a node: turns are ordered in ranges, everything else is partial sums.
  The list of ids that `ends_sha256` is the hash of is joined range by range; only the hash itself, which
  has no partial form, runs over those pieces one after the other.

Null roles and texts are empty. Turns are ordered null first, equal ones by MD5 of role, then of text; rows without a conv_id are in
no conversation. Rows that repeat are turns each. An empty table has no conversations and no nodes, not even a root.
Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.common import shared_folder, stored

#: Every conversation of FAMILY ids in a row begins with up to MOST - 1 turns of the first of them.
FAMILY, MOST = 5, 9

RANKED = "conv_id long, turn long, r string, t string, bytes long, range int, nth long"
KEYED = "conv_id long, depth long, bytes long, h1 long, h2 long, range int, k1 long, k2 long, own_bytes long"


def _new(conv: np.ndarray, before: int | None) -> np.ndarray:
    """Where a conversation begins, in rows that follow one of ``before``."""
    new = np.append(before is None or (len(conv) > 0 and conv[0] != before), conv[1:] != conv[:-1])
    return new[: len(conv)]


def _ranked(turns: DataFrame) -> DataFrame:
    """Turns with their number in the conversation, from 1 on."""
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("conv_id", "turn", F.md5(F.col("role").cast("binary")).alias("r"), F.md5(F.col("text").cast("binary")).alias("t"), F.octet_length("text").cast("long").alias("bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "r", "t"]

    def task(batches):
        last, n = None, 0
        for batch in batches:
            conv = batch["conv_id"].to_numpy()
            if not len(conv):
                continue
            new = _new(conv, last)
            starts = np.flatnonzero(new)
            nth = np.arange(len(conv)) + 1
            first = np.where(np.cumsum(new) == 0, -n, np.append(starts, 0)[np.cumsum(new) - 1])
            nth = nth - first
            last, n = int(conv[-1]), int(nth[-1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), pa.array(nth, pa.int64())], [*batch.schema.names, "nth"])

    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    return stored(ranges.mapInArrow(task, RANKED), "trie-turns")


def _before(rows: DataFrame, *sums: Column) -> DataFrame:
    """(conv, part, sums of its ranges before) of conversations that lie in several ranges: two rows a range border at
    most, and one more for each range that lies in a conversation."""
    parts = rows.groupBy("conv_id", "range").agg(*sums)
    names = [c for c in parts.columns if c not in ("conv_id", "range")]
    several = parts.groupBy("conv_id").count().filter("count > 1").select("conv_id")
    order = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.bit_xor(c) if c.startswith("k") else F.sum(c)
    zero = F.lit(0).cast("long")
    found = parts.join(several, "conv_id").select(
        F.col("conv_id").alias("conv"), F.col("range").alias("part"), *(F.coalesce(total(c).over(order), zero).alias(f"{c}_before") for c in names)
    )
    return stored(found, "trie-borders")


def _continued(rows: DataFrame, before: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(before), (F.col("conv_id") == F.col("conv")) & (F.col("range") == F.col("part")), "left").drop("conv", "part")


def _plus(name: str) -> Column:
    return (F.col(name) + F.coalesce(F.col(f"{name}_before"), F.lit(0))).alias(name)


def original(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, r, t, bytes) of the conversations as they are."""
    ranked = _ranked(turns)
    found = _continued(ranked, _before(ranked, F.max("nth").alias("nth")))
    return stored(found.select("conv_id", _plus("nth").alias("depth"), "r", "t", "bytes"), "trie-original")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns): each begins with the first turns of the first of its family, as many as a checksum of
    its id says, and goes on with its own turns after as many."""
    rows = original(turns)
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    convs = lengths.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.cast("long").alias("h"))
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("given"))
    convs = stored(convs, "trie-conversations")
    own = rows.join(convs, "conv_id").filter(F.col("depth") > F.col("h"))
    own = own.select("conv_id", (F.col("depth") - F.col("h") + F.col("given")).alias("depth"), "r", "t", "bytes")
    heads = rows.filter(F.col("depth") < MOST).withColumnRenamed("conv_id", "base")
    given = convs.join(heads, "base").filter(F.col("depth") <= F.col("h")).select("conv_id", "depth", "r", "t", "bytes")
    return convs.select("conv_id"), own.unionByName(given)


def _keyed(rows: DataFrame) -> DataFrame:
    """Turns with the key of the sequence that ends with them, that of the sequence without them (p), and its bytes."""
    hashes = [F.xxhash64(F.lit(i), "depth", "r", "t").alias(f"h{i}") for i in (1, 2)]
    rows = rows.select("conv_id", "depth", "bytes", *hashes)

    def task(batches):
        last, carried = None, [0, 0, 0]
        for batch in batches:
            conv = batch["conv_id"].to_numpy()
            if not len(conv):
                continue
            new = _new(conv, last)
            nth = np.cumsum(new)
            starts = np.append(np.flatnonzero(new), 0)
            out = []
            for i, (name, op, inverse) in enumerate((("h1", np.bitwise_xor, np.bitwise_xor), ("h2", np.bitwise_xor, np.bitwise_xor), ("bytes", np.add, np.subtract))):
                total = np.append(0, op.accumulate(batch[name].to_numpy()))
                base = np.where(nth == 0, carried[i], 0)
                running = np.where(nth == 0, op(total[1:], base), inverse(total[1:], total[starts[nth - 1]]))
                carried[i] = int(running[-1])
                out.append(pa.array(running))
            last = int(conv[-1])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names), *out], [*batch.schema.names, "k1", "k2", "own_bytes"])

    order = ["conv_id", "depth"]
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    found = stored(ranges.mapInArrow(task, KEYED), "trie-ranges")
    before = _before(found, F.bit_xor("h1").alias("k1"), F.bit_xor("h2").alias("k2"), F.sum("bytes").alias("own_bytes"))
    joined = _continued(found, before)
    k1, k2 = (F.col(k).bitwiseXOR(F.coalesce(F.col(f"{k}_before"), F.lit(0))) for k in ("k1", "k2"))
    joined = joined.select("conv_id", "depth", "bytes", k1.alias("k1"), k2.alias("k2"), "h1", "h2", _plus("own_bytes"))
    stripped = [F.col(f"k{i}").bitwiseXOR(F.col(f"h{i}")).alias(f"p{i}") for i in (1, 2)]
    return stored(joined.select("conv_id", "depth", "bytes", "k1", "k2", *stripped, "own_bytes"), "trie-keyed")


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of the sequences that conversations end with, from (k1, k2, conv_id)."""
    order = ["k1", "k2", "conv_id"]
    ranges = ends.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    pieces = ranges.groupBy("k1", "k2", "range").agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("k1", "k2", "range", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def task(batches):
        now, digest = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch["k1"].to_pylist(), batch["k2"].to_pylist(), batch["ids"], strict=True):
                data = ids.as_buffer()
                if (k1, k2) == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (k1, k2), hashlib.sha256()
                digest.update(data)
            yield _digests(out)
        if now is not None:
            yield _digests([(*now, digest.hexdigest())])

    sorted_pieces = pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "range")
    return sorted_pieces.mapInArrow(task, "k1 long, k2 long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["k1", "k2", "ends_sha256"])


NODE = ["k1", "k2"]
OUT = [*NODE, "depth", "p1", "p2", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def nodes(conversations: tuple[DataFrame, DataFrame]) -> DataFrame:
    """All nodes of the trie of (conversations, turns): turns (conv_id, depth, r, t, bytes), depth from 1 on."""
    convs, turns = conversations
    keyed = _keyed(turns)
    zero = F.lit(0).cast("long")
    last = keyed.groupBy("conv_id").agg(F.max_by(F.struct("k1", "k2", "depth", "own_bytes"), "depth").alias("end"))
    none = F.struct(*(zero.alias(n) for n in ("k1", "k2", "depth", "own_bytes")))
    ends = convs.distinct().join(last, "conv_id", "left").select("conv_id", F.coalesce("end", none).alias("end")).select("conv_id", "end.*")
    ends = stored(ends, "trie-ends")
    hashes = stored(_end_hashes(ends.select("k1", "k2", "conv_id")), "trie-hashes")
    sequences = ends.groupBy("k1", "k2").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("depth").alias("length"), F.max("own_bytes").alias("total"))
    sequences = stored(sequences, "trie-sequences")

    rows = keyed.join(sequences.select("rep", "n", "length", "total"), F.col("conv_id") == F.col("rep"))
    found = rows.groupBy(*NODE).agg(
        F.count("*").alias("sequences"),
        F.any_value(F.struct("depth", "p1", "p2", "bytes", "rep", "n", "length", "total", "own_bytes")).alias("some"),
        F.sum(F.when(F.col("depth") == F.col("length"), F.col("n"))).alias("n_ended"),
        F.min(F.when(F.col("depth") == F.col("length"), F.col("rep"))).alias("first_ended"),
    )
    found = stored(found.select(*NODE, "sequences", "n_ended", "first_ended", "some.*"), "trie-found")
    alone = found.filter("sequences = 1")  # peeled in one go: what is below is the rest of the same sequence
    inner = F.col("depth") < F.col("length")
    tails = alone.select(
        *NODE, "depth", "p1", "p2", F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), inner.cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * (F.col("total") - F.col("own_bytes") + F.col("bytes"))).alias("saved_tokens"),
    )
    tops = tails.groupBy("conv_id").agg(F.min_by(F.struct(*OUT), "depth").alias("top")).select("top.*")
    tops = stored(tops, "trie-tops")
    shared = found.filter("sequences > 1").select(*NODE, "depth", "p1", "p2", "bytes", "n_ended", "first_ended")
    root = sequences.filter((F.col("length") == 0)).agg(F.sum("n").alias("n_ended"), F.min("rep").alias("first_ended"))
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), zero.alias("bytes"), "n_ended", "first_ended")
    own = shared.unionByName(root) if sequences.limit(1).count() else shared
    deepest = own.agg(F.max("depth")).first()[0]

    levels, survivors = [], None
    folder = shared_folder(turns.sparkSession, "trie-own")
    if deepest is not None:
        own.write.partitionBy("depth").parquet(folder)
        own = turns.sparkSession.read.schema(own.schema).parquet(folder)
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        ended = own.filter(F.col("depth") == depth).select(
            *NODE, "p1", "p2", "bytes", F.col("first_ended").alias("conv_id"), F.coalesce("n_ended", zero).alias("n_convs"),
            zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved_tokens"),
        )
        stripped = tops.filter(F.col("depth") == depth + 1)
        stripped = stripped if survivors is None else stripped.unionByName(survivors)
        stripped = stripped.select(
            F.col("p1").alias("k1"), F.col("p2").alias("k2"), *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2", "bytes")),
            "conv_id", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        )
        merged = ended.unionByName(stripped).groupBy(*NODE).agg(
            *(F.max(c).alias(c) for c in ("p1", "p2", "bytes")), F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        )
        merged = merged.select(
            *NODE, F.lit(depth).cast("long").alias("depth"), "p1", "p2", "conv_id", "n_convs", "n_children",
            F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"),
        )
        survivors = stored(merged, "trie-level")
        levels.append(survivors)

    trunk = levels[0] if levels else tails.limit(0)
    for level in levels[1:]:
        trunk = trunk.unionByName(level)
    first = F.lit(levels[-1].select("conv_id").first()[0] if levels else None).cast("long")
    parents = trunk.filter("depth > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    joined = trunk.unionByName(tops).filter("depth > 1").join(parents, ["p1", "p2"]).select(*OUT, "parent_conv_id")
    upper = trunk.unionByName(tops).filter("depth <= 1").select(*OUT, F.when(F.col("depth") == 1, first).alias("parent_conv_id"))
    lower = tails.join(tops.select("conv_id", F.col("depth").alias("top")), "conv_id").filter("depth > top")
    lower = lower.select(*OUT, F.col("conv_id").alias("parent_conv_id"))
    found = joined.unionByName(upper).unionByName(lower).join(hashes, NODE, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


#: h is the CRC-32 of the id's digits, bit by bit.
ORACLE = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS nth
    FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY nth) AS own FROM turns GROUP BY conv_id),
crcs AS (
    SELECT conv_id, own, list_reduce(
        list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
            lambda c: list_transform(range(8), lambda k: CAST((ascii(c) >> CAST(k AS INTEGER)) & 1 AS BIGINT))))),
        lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))) AS crc
    FROM lists),
marked AS (SELECT conv_id, own, CAST(xor(crc, 4294967295) % {MOST} AS BIGINT) AS h FROM crcs),
whole AS (
    SELECT m.conv_id, list_concat(coalesce(b.own[1 : h], []), m.own[h + 1 :]) AS seq
    FROM marked m LEFT JOIN lists b ON b.conv_id = m.conv_id - m.conv_id % {FAMILY}),
members AS (SELECT conv_id, len(seq) AS length, d AS depth, seq[1 : d] AS node FROM (SELECT *, unnest(range(len(seq) + 1)) AS d FROM whole)),
found AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE length = depth), '')) AS ends_sha256
    FROM members GROUP BY node, depth),
family AS (SELECT c.node, c.depth, p.node AS above, p.conv_id AS parent FROM found c JOIN found p ON p.depth = c.depth - 1 AND p.node = c.node[1 : c.depth - 1]),
children AS (SELECT above, count(*) AS n FROM family GROUP BY above),
counted AS (
    SELECT f.*, coalesce(n, 0) AS n_children, CASE WHEN f.depth = 0 THEN 0 ELSE (n_convs - 1) * octet_length(encode(f.node[f.depth].text)) END AS own
    FROM found f LEFT JOIN children ON above = f.node),
ups AS (SELECT n_children, own, node[1 : d] AS node, d AS depth FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted)),
sums AS (SELECT node, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM ups GROUP BY node, depth)
SELECT c.conv_id, CAST(c.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves,
    CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM counted c JOIN sums s ON s.node = c.node AND s.depth = c.depth LEFT JOIN family f ON f.node = c.node AND f.depth = c.depth"""
