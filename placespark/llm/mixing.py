"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

Every source is a line of its words, its documents one after the other in the order of a hash. The mix takes the first
``target`` words of that line, which goes round again where the target is more than the source has; whole documents but
for the one at which the target ends. The part taken is cut into blocks of ``block`` words, and a document belongs to
the block that it begins in. Output shards are the leaves of a tree: each node holds exact block quotas of all sources, and
gives its left half a multivariate-hypergeometric draw of them, source by source, the right half the rest. A leaf then
takes its quota from the source's permuted blocks, disjoint from all others, and is shuffled by itself.

- Targets: sources by code point, null last, weigh ``cycle`` by turns and share the words of all documents; a target stops at
  ``limit`` times its source, and what is over is shared again by weight until none is above.
- All draws are hashes of ``seed`` and their place in the tree, so runs agree, lost tasks too.
- No task sees a whole source: places on a line are running sums over hash buckets of two sizes, then within a bucket,
  quotas stay counts until the leaves, and shards are bounded in words (but for a longer document).

Null text has no words. Documents without words are in no shard and take nothing, as do sources without words. A null
source is a source of its own. Rows that repeat are documents each. An empty table has no mix. Further columns stay as they
are: `mixed` returns the row as one struct.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placespark.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
CYCLE = (5, 2, 1)
LIMIT = 3
BLOCK = 1 << 12
SHARD_WORDS = 1 << 20
SEED = 0
#: Documents of a hash bucket, about; more of them at more documents.
BUCKET = 1024
#: Sources of one draw; more are drawn in groups of so many, group by group.
FAN = 64
#: A prime above any number of blocks of a source, for the permutation of blocks.
_PRIME = (1 << 31) - 1


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _key(source: Column) -> Column:
    """A text for each source that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def targets(sized: DataFrame, cycle: tuple[float, ...] = CYCLE, limit: int = LIMIT) -> DataFrame:
    """(source_key, s, source_size, target) of each source, with s counting them in order, from (source, size) rows."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranges = by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id())
    ranges = stored(ranges, "mixing-sources")
    counts = ranges.groupBy("range").agg(F.count("*").alias("n"))  # one row a partition
    before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    counts = counts.select(F.col("range").alias("of"), before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    found = ranges.withColumn("nth", nth).join(counts, F.col("range") == F.col("of"))
    found = found.select("source", "source_size", (F.col("before") + F.col("nth")).alias("s"))
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    weight = F.get(weights, F.pmod(F.col("s"), F.lit(len(cycle))).cast("int"))
    found = stored(found.withColumn("weight", weight), "mixing-weights")
    total = found.agg(F.sum("source_size")).first()[0] or 0
    most = limit * F.col("source_size")
    share, left, weight_left = 0.0, total, None
    while True:  # the share of a weight grows until no other source is above its limit
        above = F.col("weight") * F.lit(float(left)) / F.lit(weight_left) > most if weight_left else F.lit(False)
        row = found.agg(F.sum(F.when(above, most)).alias("full"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        now = (total - (row["full"] or 0), row["open"])
        if now == (left, weight_left) or not now[1]:
            break
        left, weight_left = now
    share = F.col("weight") * F.lit(float(left)) / F.lit(weight_left or 1.0)
    target = F.least(most.cast("double"), share)
    return found.select(_key(F.col("source")).alias("source_key"), "s", "source_size", target.alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 by a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def hypergeometric(total: Column, own: Column, n: Column, u: Column) -> Column:
    """How many of ``own`` are in a draw of n from total, by inversion of u from the most likely number on.

    Numbers are looked at 12 standard deviations and 30 to both sides; beyond, a double cannot tell probabilities from 0."""

    def ratio(k: Column, s: Column) -> Column:
        """Likelihood of k + 1 over that of k."""
        up = (s["own"] - k).cast("double") * (s["n"] - k).cast("double")
        return up / ((k + 1).cast("double") * (s["total"] - s["own"] - s["n"] + k + 1).cast("double"))

    def walked(s: Column, start: Column, upward: bool) -> Column:
        """From start (sum, pick) over the numbers above or below the mode: stops where the sum exceeds aim."""
        steps = F.when(upward & (s["high"] > s["mode"]), F.sequence(s["mode"] + 1, s["high"])) if upward else F.when(
            s["low"] < s["mode"], F.sequence(s["mode"] - 1, s["low"], F.lit(-1).cast("long"))
        )
        steps = F.coalesce(steps, F.array().cast("array<bigint>"))

        def step(a: Column, k: Column) -> Column:
            w = a["w"] * (ratio(k - 1, s) if upward else 1 / ratio(k, s))
            return _let(
                F.struct((a["sum"] + w).alias("sum"), w.alias("w")),
                lambda x: F.struct(
                    x["sum"].alias("sum"), x["w"].alias("w"),
                    F.when(a["pick"].isNull() & (x["sum"] > a["aim"]), k).otherwise(a["pick"]).alias("pick"), a["aim"].alias("aim"),
                ),
            )

        return F.aggregate(steps, start, step)

    def state(total_sum: Column, pick: Column, aim: Column) -> Column:
        return F.struct(total_sum.alias("sum"), F.lit(1.0).alias("w"), pick.alias("pick"), aim.alias("aim"))

    none, never = F.lit(None).cast("long"), F.lit(float("inf"))
    low, high = F.greatest(F.lit(0).cast("long"), n - (total - own)), F.least(own, n)
    share = own.cast("double") / F.greatest(total, F.lit(1).cast("long"))
    spread = F.sqrt(n * share * (1 - share) * (total - n) / F.greatest(total - 1, F.lit(1).cast("long")))
    width = (F.ceil(12 * spread) + 30).cast("long")
    mode = F.floor((n + 1).cast("double") * (own + 1).cast("double") / (total + 2)).cast("long")
    mode = F.least(high, F.greatest(low, mode))
    first = F.struct(total.alias("total"), own.alias("own"), n.alias("n"), low.alias("low"), high.alias("high"), mode.alias("mode"), width.alias("width"))

    def drawn(s: Column) -> Column:
        sums = walked(s, state(walked(s, state(F.lit(1.0), none, never), True)["sum"], none, never), False)["sum"]
        return _let(sums * u, lambda aim: F.coalesce(picked(s, aim), s["mode"]))

    def picked(s: Column, aim: Column) -> Column:
        begin = state(F.lit(1.0), F.when(aim <= 1.0, s["mode"]), aim)
        return _let(walked(s, begin, True), lambda a: F.coalesce(a["pick"], walked(s, state(a["sum"], none, aim), False)["pick"]))

    narrowed = lambda s: F.struct(
        s["total"].alias("total"), s["own"].alias("own"), s["n"].alias("n"), s["mode"].alias("mode"),
        F.greatest(s["low"], s["mode"] - s["width"]).alias("low"), F.least(s["high"], s["mode"] + s["width"]).alias("high"),
    )
    return _let(first, lambda s: _let(narrowed(s), drawn))


def _one_draw(seed: int, level: int):
    """Draws for one child c of a family, from what the children before it have left of all blocks and of the draw."""

    def step(a: Column, c: Column) -> Column:
        u = _uniform(F.lit(seed), F.col("first"), F.col("n"), F.lit(level), c["g"])
        return _let(
            hypergeometric(a["all"], c["q"], a["k"], u),
            lambda x: F.struct(
                (a["all"] - c["q"]).alias("all"), (a["k"] - x).alias("k"),
                F.concat(a["out"], F.array(F.struct(c["g"].alias("g"), x.alias("x")))).alias("out"),
            ),
        )

    return step


def _draws(nodes: DataFrame, left: Column, n_sources: int, seed: int) -> DataFrame:
    """nodes (first, n, s, q) with x, the blocks of q that go to the left half; left is its size in shards."""
    digits = max(1, ceil(log2(max(2, n_sources)) / log2(FAN)))
    bits = FAN.bit_length() - 1
    node = ["first", "n"]
    groups = None
    for level in reversed(range(digits)):
        children = nodes.groupBy(*node, F.shiftright("s", bits * level).alias("g")).agg(F.sum("q").alias("q"))
        up = F.shiftright("g", bits)
        family = children.groupBy(*node, up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("g", "q"))).alias("own"), F.sum("q").alias("all"))
        if groups is None:
            family = family.withColumn("k", F.floor(F.col("all") * left / F.col("n")).cast("long"))
        else:
            family = family.join(groups.select(*node, F.col("g").alias("up"), F.col("x").alias("k")), [*node, "up"])

        nothing = F.array().cast("array<struct<g:bigint,x:bigint>>")
        drawn = F.aggregate("own", F.struct("all", "k", nothing.alias("out")), _one_draw(seed, level))["out"]
        groups = family.select(*node, F.explode(drawn).alias("d")).select(*node, "d.g", "d.x")
    return nodes.join(groups.withColumnRenamed("g", "s"), [*node, "s"])


def leaves(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(s, shard, low, q): the blocks low to low + q - 1 of the permuted blocks of source s belong to the shard.

    quotas: (s, q) rows with s from 0 on."""
    n_sources = (quotas.agg(F.max("s")).first()[0] or 0) + 1
    zero = F.lit(0).cast("long")
    nodes = quotas.filter("q > 0").select(zero.alias("first"), F.lit(shards).cast("long").alias("n"), F.col("s").cast("long").alias("s"), zero.alias("low"), "q")
    left = F.shiftright(F.col("n") + 1, 1)
    for _ in range(ceil(log2(shards)) if shards > 1 else 0):
        drawn = _draws(nodes, left, n_sources, seed)
        halves = F.array(
            F.struct(F.col("first").alias("first"), left.alias("n"), F.col("low").alias("low"), F.col("x").alias("q")),
            F.struct((F.col("first") + left).alias("first"), (F.col("n") - left).alias("n"), (F.col("low") + F.col("x")).alias("low"), (F.col("q") - F.col("x")).alias("q")),
        )
        nodes = drawn.select("s", F.explode(halves).alias("h")).select("h.first", "h.n", "s", "h.low", "h.q").filter("q > 0")
        nodes = stored(nodes, "mixing-nodes")
    return nodes.select("s", F.col("first").alias("shard"), "low", "q")


def sized_rows(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """Documents as a struct `doc`, with source, size and the hash that orders them."""
    text = F.coalesce(F.col("doc.text"), F.lit(""))
    name = F.coalesce(F.col("doc.doc_id").cast("string"), F.lit(""))
    return documents.select(F.struct(*documents.columns).alias("doc")).select(
        "doc", F.col("doc.source").cast("string").alias("source"), n_words(F.col("doc.text")).alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), text).cast("binary")).alias("hash"),
    )


def laid_out(rows: DataFrame, cycle: tuple[float, ...] = CYCLE, limit: int = LIMIT) -> DataFrame:
    """The sized rows with their source and their first place on its line."""
    sized = stored(rows.select("source", "size", "hash"), "mixing-sizes")
    bits = max(0, ceil(log2(max(1, sized.count()) / BUCKET)))
    low = bits // 2
    fine = F.shiftright(F.conv(F.substring("hash", 1, 15), 16, 10).cast("long"), 60 - bits)
    of = targets(sized, cycle, limit)
    buckets = sized.groupBy(_key(F.col("source")).alias("source_key"), fine.alias("fine")).agg(F.sum("size").alias("n"))
    buckets = stored(buckets.withColumn("coarse", F.shiftright("fine", low)), "mixing-buckets")
    within = F.sum("n").over(Window.partitionBy("source_key", "coarse").orderBy("fine")) - F.col("n")
    coarse = buckets.groupBy("source_key", "coarse").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source_key").orderBy("coarse")) - F.col("n")
    coarse = coarse.select("source_key", "coarse", before.alias("before"))
    bases = buckets.withColumn("within", within).join(coarse, ["source_key", "coarse"]).join(of, "source_key")
    bases = bases.select("source_key", "fine", (F.col("before") + F.col("within")).alias("base"), "s", "source_size", "target")
    own = Window.partitionBy("source_key", "fine").orderBy("hash", "size")
    rows = rows.withColumns({"source_key": _key(F.col("source")), "fine": fine})
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)  # equal rows follow each other
    rows = rows.withColumns({"nth": F.row_number().over(own), "inner": F.sum("size").over(so_far) - F.col("size")})
    joined = rows.join(stored(bases, "mixing-bases"), ["source_key", "fine"])
    return joined.select("doc", "hash", "size", "s", "fine", "nth", "source_size", "target", (F.col("base") + F.col("inner")).alias("place"))


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """Rows with `piece`, one for each time that the mix takes them (null if never): round, block, words."""
    goal = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    rounds = F.sequence(F.lit(0).cast("long"), F.floor((goal - 1 - F.col("place")) / F.col("source_size")).cast("long"))
    at = lambda e: F.col("place") + e * F.col("source_size")
    piece = F.transform(
        F.when((F.col("size") > 0) & (goal > F.col("place")), rounds),
        lambda e: F.struct(e.alias("round"), F.floor(at(e) / block).cast("long").alias("block"), F.least("size", goal - at(e)).alias("n")),
    )
    return rows.withColumn("goal", goal).withColumn("piece", F.explode_outer(piece))


def _shards(words: int, shards: int | None) -> int:
    return shards or max(1, ceil(words / SHARD_WORDS))


def _drawn(rows: DataFrame, block: int, shards: int | None, seed: int) -> DataFrame:
    """Pieces with the shard that drew their block."""
    found = _pieces(rows, block)
    of = rows.groupBy("s").agg(F.max("target").alias("target"))
    blocks = F.ceil(F.floor(F.col("target") + F.lit(0.5)) / block).cast("long")
    quotas = stored(of.select("s", F.floor(F.col("target") + F.lit(0.5)).cast("long").alias("goal"), blocks.alias("q")), "mixing-quotas")
    total = quotas.agg(F.sum("goal")).first()[0] or 0
    taken = leaves(quotas, _shards(total, shards), seed)
    drawn = taken.select("s", "shard", F.explode(F.sequence("low", F.col("low") + F.col("q") - 1)).alias("nth_block"))
    q = F.ceil(F.col("goal") / block).cast("long")
    turned = F.pmod(F.col("piece.block") * F.lit(_PRIME) + F.pmod(F.xxhash64(F.lit(seed), "s"), F.lit(1 << 31)), q)
    return found.withColumn("nth_block", turned).join(drawn, ["s", "nth_block"], "left")


def mixed(
    documents: DataFrame, cycle: tuple[float, ...] = CYCLE, limit: int = LIMIT, block: int = BLOCK, shards: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """The mix: a row (doc, shard, place, round, words, text) for each time that a document is taken, in the order of place
    within its shard; text is cut after ``words`` words where the target ends in the document."""
    rows = laid_out(sized_rows(documents, seed), cycle, limit)
    rows = _drawn(rows, block, shards, seed).filter(F.col("piece").isNotNull())
    order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "hash", "piece.round", "nth"), "hash", "nth")
    first = F.slice(F.regexp_extract_all(F.col("doc.text"), F.lit(f"({WORD})")), F.lit(1), F.col("piece.n").cast("int"))
    text = F.when(F.col("piece.n") == F.col("size"), F.col("doc.text")).otherwise(F.array_join(first, " "))
    return rows.select(
        "doc", "shard", F.row_number().over(order).alias("place"), F.col("piece.round").alias("round"), F.col("piece.n").alias("words"), text.alias("text")
    )


def mix(documents: DataFrame, cycle: tuple[float, ...] = CYCLE, limit: int = LIMIT, block: int = BLOCK, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """Size, source size, target and words taken of each document, by the blocks that the shards drew."""
    rows = sized_rows(documents.select("doc_id", "text", "source"), seed)
    rows = stored(rows.withColumn("doc", F.struct("doc.doc_id")), "mixing-documents")
    rows = stored(laid_out(rows, cycle, limit), "mixing-rows")
    taken = F.sum(F.when(F.col("shard").isNotNull(), F.col("piece.n")))
    found = _drawn(rows, block, shards, seed).groupBy("s", "fine", "nth").agg(
        F.any_value("doc.doc_id").alias("doc_id"), F.any_value("size").alias("size"), F.any_value("source_size").alias("source_size"),
        F.any_value("target").alias("target"), F.coalesce(taken, F.lit(0)).cast("long").alias("taken"),
    )
    return found.select("doc_id", "size", "source_size", "target", "taken")


#: The lines and targets alone: whatever shard draws a block, all blocks of a target are drawn.
ORACLE = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
        md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h
    FROM documents),
sources AS (
    SELECT source, sum(size) AS n, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
    FROM docs GROUP BY source),
ordered AS (
    SELECT *, sum({LIMIT} * n) OVER o - {LIMIT} * n AS full_before, sum(w) OVER (ORDER BY {LIMIT} * n / w DESC, source DESC NULLS FIRST) AS open
    FROM sources WINDOW o AS (ORDER BY {LIMIT} * n / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
shares AS (SELECT *, (SELECT sum(n) FROM sources) - full_before AS remaining FROM ordered),
level AS (SELECT remaining, open FROM shares WHERE {LIMIT} * n * open >= w * remaining ORDER BY {LIMIT} * n / w, source NULLS LAST LIMIT 1),
goals AS (
    SELECT source, CAST(n AS BIGINT) AS source_size,
        least(CAST({LIMIT} * n AS DOUBLE), CAST(w AS DOUBLE) * CAST(remaining AS DOUBLE) / CAST(open AS DOUBLE)) AS target
    FROM sources, level),
lines AS (
    SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, size, r ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS place
    FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(CASE WHEN size = 0 THEN 0 ELSE list_sum(list_transform(range({LIMIT + 1}), lambda e:
        greatest(0, least(size, goal - place - e * source_size)))) END AS BIGINT) AS taken
FROM lines"""
