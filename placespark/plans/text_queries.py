"""Text jobs: cleaning, splitting, links, relations and operator trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placespark import fixtures as X
from placespark.functions import lexicon as L
from placespark.functions import text as T
from placespark.operators import relations as R
from placespark.operators import trees
from placespark.operators.layout import running_total, spread, stored
from placespark.operators.sentences import leading_sentences
from placespark.plans.catalog import query, rounded
from placespark.sources import corpus
from placespark.sources.tables import table


def _quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# ---- cleaning and splitting ------------------------------------------------------------------

_RAW = "text || ' [' || (doc_id % 9) || '] (see) 3.25 km at 12° 30′ N, 45° E and 7° 5′ W. It''s so.'"


@query(
    "clean_text",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t,
    '\[[0-9]+\]', '', 'g'), '\([^\(\)]+\)', '', 'g'), '''s', ' ''s', 'g'), '([0-9])(?:\.[0-9]+)+', '\1', 'g'),
    '[0-9]+(?:°|′|''|″|")[^A-DF-MO-RT-VX-Za-z]*\.', '.', 'g'), '[0-9]+(?:°|′|''|″|")[^A-DF-MO-RT-VX-Za-z]*', '', 'g') AS clean
    FROM (SELECT doc_id, """ + _RAW + " AS t FROM documents)",
)
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.expr(_RAW.replace("''s", "\\'s")).alias("t")).select("doc_id", T.clean_text(F.col("t")).alias("clean"))


@query(
    "replace_target",
    r"""SELECT l_orderkey, l_linenumber, l_partkey, replace(regexp_replace(
    'Once ' || s_name || ' is a town in the north. Old ' || s_name || ' lies near ' || n_name || ' and is the best.',
    '.+( is (?:an?|the|one of)\b)', 'TARGET\1', 'g'), s_name, 'TARGET') AS t
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
)
def replace_target(spark, d):
    places = table(spark, d, "supplier").join(
        table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    rows = table(spark, d, "lineitem").join(places, F.col("l_suppkey") == F.col("s_suppkey"))
    told = F.concat(
        F.lit("Once "), "s_name", F.lit(" is a town in the north. Old "), "s_name", F.lit(" lies near "), "n_name",
        F.lit(" and is the best."),
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", T.replace_target(told, F.col("s_name")).alias("t"))


@query(
    "split_sentences",
    r"""SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, parts[i] AS sentence FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
    FROM (SELECT doc_id, string_split(regexp_replace(text, '\.\s+([A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents))""",
)
def split_sentences(spark, d):
    split = table(spark, d, "documents").select("doc_id", F.posexplode(T.split_sentences(F.col("text"))).alias("pos", "sentence"))
    return split.withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "plain_text",
    "SELECT page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'),"
    " '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS plain FROM pages",
)
def plain_text(spark, d):
    return table(spark, d, "pages").select("page_id", T.plain_text(F.col("html")).alias("plain"))


_TOKENS_SQL = (
    r"pieces AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+')) AS piece,"
    r" generate_subscripts(regexp_extract_all(text, '[\p{L}\p{Nd}_]+|[^\p{L}\p{Nd}_]+'), 1) AS i FROM documents),"
    r" bits AS (SELECT doc_id, i, piece, CASE WHEN regexp_matches(piece, '[\p{L}\p{Nd}_]') THEN regexp_extract_all(piece, '[0-9A-Za-z_]+|[^0-9A-Za-z_]+') ELSE [piece] END AS parts FROM pieces),"
    r" tokens AS (SELECT doc_id, i, j, lower(regexp_replace(parts[j], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')) AS token"
    " FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM bits))"
)


@query(
    "tokenize",
    f"WITH {_TOKENS_SQL} SELECT doc_id, count(token) AS tokens, coalesce(md5(string_agg(token, ' ' ORDER BY i, j)), md5('')) AS digest"
    " FROM documents LEFT JOIN (SELECT * FROM tokens WHERE token <> '') USING (doc_id) GROUP BY ALL",
)
def tokenize(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tokens.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", " ")).alias("digest")
    )


@query(
    "filter_tokens",
    f"WITH {_TOKENS_SQL} SELECT doc_id, count(token) AS kept, coalesce(md5(string_agg(token, ' ' ORDER BY i, j)), md5('')) AS digest"
    f" FROM documents LEFT JOIN (SELECT * FROM tokens WHERE list_contains({_quoted(L.words())}, token) OR regexp_matches(token, '^[0-9]+$'))"
    " USING (doc_id) GROUP BY ALL",
)
def filter_tokens(spark, d):
    tokens = table(spark, d, "documents").select("doc_id", T.filter_tokens(T.tokenize(F.col("text"))).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("kept"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(
    "osm_ref_from_url",
    "SELECT page_id, string_split(url, '/')[-1] AS osm_id, string_split(url, '/')[-2] AS osm_type FROM pages",
)
def osm_ref_from_url(spark, d):
    osm_id, osm_type = T.osm_ref_from_url(F.col("url"))
    return table(spark, d, "pages").select("page_id", osm_id.alias("osm_id"), osm_type.alias("osm_type"))


_TOLD = "'Lies in Alpha' || l_suppkey || ', north of Alpha' || l_suppkey || ' Beta. Alpha' || l_suppkey || ' is near Gamma' || l_partkey || '.'"


@query(
    "substitute_toponyms",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'Lies in SHP1, north of SHP2. SHP1 is near SHP3.' AS t FROM lineitem",
)
def substitute_toponyms(spark, d):
    """"Alpha7" is part of the longer name "Alpha7 Beta", which goes first."""
    names = F.array(
        F.struct(F.concat(F.lit("Alpha"), "l_suppkey").alias("name"), F.lit(1).alias("shp_id")),
        F.struct(F.concat(F.lit("Alpha"), "l_suppkey", F.lit(" Beta")).alias("name"), F.lit(2).alias("shp_id")),
        F.struct(F.concat(F.lit("Gamma"), "l_partkey").alias("name"), F.lit(3).alias("shp_id")),
    )
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.substitute_toponyms(F.expr(_TOLD), names).alias("t")
    )


# ---- paragraphs with links: turns of a conversation, the odd ones being links --------------------


def _fragments(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", F.col("text"), (F.col("turn") % 2 == 1).alias("is_link"), F.length("text").alias("size")
    )


@query(
    "link_offsets",
    "SELECT conv_id, turn, CAST(e - size AS BIGINT) AS link_start, CAST(e AS BIGINT) AS link_end FROM (SELECT *, length(text) AS size, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS e"
    " FROM conversations) WHERE turn % 2 = 1",
)
def link_offsets(spark, d):
    """Start and end of each link in the text of its paragraph."""
    placed = running_total(_fragments(spark, d), ["conv_id"], "turn", "size", 256)
    return placed.where("is_link").select(
        "conv_id", "turn", (F.col("total") - F.col("size")).alias("link_start"), F.col("total").alias("link_end")
    )


_PREFIX = "SELECT *, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn) AS prefix, string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM conversations"


def _prefixes(spark, d):
    """Text of the paragraph up to and with each fragment; a paragraph is read whole, as its text is one value."""
    upto = Window.partitionBy("conv_id").orderBy("turn")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    return _fragments(spark, d).withColumns(
        {
            "prefix": F.array_join(F.collect_list("text").over(upto), ""),
            "before": F.array_join(F.collect_list("text").over(before), ""),
        }
    )


@query("link_prefix_text", f"SELECT conv_id, turn, prefix FROM ({_PREFIX}) WHERE turn % 2 = 1")
def link_prefix_text(spark, d):
    return _prefixes(spark, d).where("is_link").select("conv_id", "turn", "prefix")


@query(
    "link_sentence",
    r"""SELECT conv_id, turn, replace(regexp_replace(list_filter(string_split(regexp_replace(regexp_replace(coalesce(before, '') || 'LOCATION',
    '\[([0-9]+|citation needed)\]', '', 'g'), '\.\s+([A-Z])', '.' || chr(1) || '\1', 'g'), chr(1)), lambda s: regexp_matches(s, '[^\s\x{00a0}]'))[-1],
    '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g'), chr(160), ' ') AS sentence FROM (""" + _PREFIX + ") WHERE turn % 2 = 1",
)
def link_sentence(spark, d):
    """The sentence that leads to each link, with the link itself as LOCATION."""
    return leading_sentences(_fragments(spark, d), "conv_id", "turn").select("conv_id", "turn", "sentence")


# ---- corpus XML built from orders and their places ------------------------------------------------


def _corpus(spark, d):
    """One entity element per line item, with one paragraph and three links, one of them generic."""
    rows = table(spark, d, "lineitem").join(X.entities(spark, d), F.col("l_orderkey") == F.col("entity_id"))
    xml = F.concat(
        F.lit('<entity id="E'), "l_orderkey", F.lit("_"), "l_partkey", F.lit("_"), "l_linenumber",
        F.lit('" wikipedia="W_'), "l_orderkey", F.lit('" osm="O'), "l_orderkey", F.lit(" O"), "l_partkey",
        F.lit('" type="way relation" status="'), "status", F.lit('"><p id="P" num_links="3">In the city of <link id="E1_001_'),
        "l_linenumber", F.lit('" wikipedia="W'), "l_suppkey", F.lit('" osm="O'), "l_suppkey", F.lit('" type="way">Place '),
        "l_suppkey", F.lit('</link>, in <link id="E1_001_90" wikipedia="Europe" osm="O0" type="relation">Europe</link>, near <link id="E1_001_91" wikipedia="R'),
        "l_partkey", F.lit('" osm="O'), "l_partkey", F.lit(" O"), "l_suppkey", F.lit('" type="way node">Road '), "l_partkey",
        F.lit("</link>.</p></entity>"),
    )
    return corpus.parse_corpus(spread(rows.select(xml.alias("xml"))), "xml")


@query("scan_entities", X.with_sql("entities") + "SELECT 'E' || l_orderkey || '_' || l_partkey || '_' || l_linenumber AS entity_id, 'W_' || l_orderkey AS wikipedia, CAST(2 AS BIGINT) AS osm_keys, status, CAST(3 AS BIGINT) AS links FROM lineitem JOIN entities ON l_orderkey = entity_id")
def scan_entities(spark, d):
    entities = _corpus(spark, d)
    links = F.size(F.regexp_extract_all(F.get("paragraphs", F.lit(0)), F.lit("<link "), 0))
    return entities.select(
        "entity_id", "wikipedia", F.size("osm").cast("bigint").alias("osm_keys"), "status", links.cast("bigint").alias("links")
    )


@query(
    "filter_generic_links",
    "SELECT 'E' || l_orderkey || '_' || l_partkey || '_' || l_linenumber AS entity_id, CAST(unnest([l_linenumber, 91]) AS INT) AS shp_id,"
    " unnest(['Place ' || l_suppkey, 'Road ' || l_partkey]) AS toponym, unnest(['way', 'way,node']) AS osm_types FROM lineitem",
)
def filter_generic_links(spark, d):
    links = corpus.links(corpus.fragments(_corpus(spark, d)))
    return links.select("entity_id", "shp_id", "toponym", F.array_join("osm.type", ",").alias("osm_types"))


@query(
    "scan_operator_rows",
    "SELECT CAST(l_suppkey AS VARCHAR) AS entity_id, arg_max('Op(' || l_partkey || ',' || l_linenumber || ')', l_orderkey * 100000000 + l_partkey * 10 + l_linenumber) AS operators FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_suppkey",
)
def scan_operator_rows(spark, d):
    """Tab-separated lines; lines without exactly two fields drop out and the last line of an entity wins."""
    lines = table(spark, d, "lineitem").select(
        F.concat_ws(
            "\t", F.col("l_suppkey").cast("string"), F.expr("concat('Op(', l_partkey, ',', l_linenumber, ')')"),
            F.when(F.col("l_linestatus") != "O", F.lit("x")),
        ).alias("value"),
        F.expr("l_orderkey * 100000000 + l_partkey * 10 + l_linenumber").alias("line_no"),
    )
    return corpus.operator_rows(lines)


# ---- relations ------------------------------------------------------------------------------------

_N = "CAST({p} AS {t})"
# phrase, relation, places, cardinal, distance, unit, operator text ({n}, {m}: places)
_PHRASES = [
    ("It is in the city of SHP{n}.", "SubLocation", "{n}", None, None, None, "SubLocation(SimpleLocation(GeoLocation({n},None),None))"),
    ("It belongs to SHP{n}.", "SubLocation", "{n}", None, None, None, "SubLocation(SimpleLocation(GeoLocation({n},None),None))"),
    ("It lies in the eastern part of SHP{n}.", "SubLocation", "{n}", "E", None, None, "SubLocation(SimpleLocation(GeoLocation({n},None),Some(GeoCardinal(E))))"),
    ("A town in the center of SHP{n}, SHP{m}.", "SubLocation", "{n}", "C", None, None, "SubLocation(SimpleLocation(GeoLocation({n},None),Some(GeoCardinal(C))))"),
    ("It runs between SHP{n} and SHP{m}.", "Between", "{n},{m}", None, None, None, "Between(SimpleLocation(GeoLocation({n},None),None),SimpleLocation(GeoLocation({m},None),None))"),
    ("It is close to the SHP{n}.", "Proximate", "{n}", None, None, None, "Proximate(SimpleLocation(GeoLocation({n},None),None),None)"),
    ("It is bordered by SHP{n}.", "Adjacent", "{n}", None, None, None, "Adjacent(SimpleLocation(GeoLocation({n},None),None),None)"),
    ("It borders SHP{n} to the north.", "Adjacent", "{n}", "S", None, None, "Adjacent(SimpleLocation(GeoLocation({n},None),None),Some(GeoCardinal(S)))"),
    ("It stands 100 miles east of SHP{n}.", "Distance", "{n}", "E", "100", "MI", "Distance(SimpleLocation(GeoLocation({n},None),None),100,MI,Some(GeoCardinal(E)))"),
    ("It is in SHP{n} and near SHP{m}.", "SubLocation", "{n}", None, None, None, "Intersection(SubLocation(SimpleLocation(GeoLocation({n},None),None)),Proximate(SimpleLocation(GeoLocation({m},None),None),None))"),
    ("It stands to the south of SHP{n}.", "Adjacent", "{n}", "S", None, None, "Adjacent(SimpleLocation(GeoLocation({n},None),None),Some(GeoCardinal(S)))"),
    ("Nothing is known of it.", None, None, None, None, None, None),
]
_KINDS = len(_PHRASES)


def _filled(text: str | None) -> str:
    """SQL text that puts the place numbers into a template."""
    if text is None:
        return "NULL"
    return "replace(replace('" + text + "', '{n}', CAST(place_id AS VARCHAR(20))), '{m}', CAST(place_id + 1 AS VARCHAR(20)))"


def _by_kind(index: int) -> str:
    return "CASE place_id % " + str(_KINDS) + " " + " ".join(f"WHEN {k} THEN {_filled(p[index])}" for k, p in enumerate(_PHRASES)) + " END"


def _sentences(spark, d):
    return spread(X.links(spark, d), "entity_id", "place_id").select(
        "entity_id", "place_id", F.expr(_by_kind(0).replace("VARCHAR(20)", "STRING")).alias("sentence")
    )


_RELATIONS = (
    f"relations AS (SELECT entity_id, place_id, {_by_kind(1)} AS relation, {_by_kind(2)} AS shp_ids, {_by_kind(3)} AS cardinal,"
    f" CAST({_by_kind(4)} AS INT) AS distance, {_by_kind(5)} AS unit FROM links WHERE place_id % {_KINDS} <> {_KINDS - 1}"
    f" UNION ALL SELECT entity_id, place_id, 'Proximate', CAST(place_id + 1 AS VARCHAR), NULL, NULL, NULL FROM links WHERE place_id % {_KINDS} = 9)"
)


def _relations(spark, d):
    return R.extract_relations(_sentences(spark, d))


@query("extract_relations", X.with_sql("links")[:-1] + f", {_RELATIONS} SELECT * FROM relations")
def extract_relations(spark, d):
    return _relations(spark, d).select(
        "entity_id", "place_id", "relation", F.array_join("shp_ids", ",").alias("shp_ids"), "cardinal", "distance", "unit"
    )


@query("compose_relations", X.with_sql("links")[:-1] + f" SELECT entity_id, place_id, CAST(CASE place_id % {_KINDS} WHEN 9 THEN 2 ELSE 1 END AS BIGINT) AS relations, {_by_kind(6)} AS operators FROM links WHERE place_id % {_KINDS} <> {_KINDS - 1}")
def compose_relations(spark, d):
    return R.compose(_sentences(spark, d))


@query("is_defined", X.with_sql("links")[:-1] + f", {_RELATIONS} SELECT entity_id, place_id, relation, relation = 'Between' OR cardinal IS NOT NULL AS defined FROM relations")
def is_defined(spark, d):
    return _relations(spark, d).select(
        "entity_id", "place_id", "relation", R.is_defined(F.col("relation"), F.col("side"), F.get("own_cardinals", F.lit(0))).alias("defined")
    )


_SUCCESS = (
    f"told AS (SELECT entity_id, place_id, place_id % {_KINDS} <> {_KINDS - 1} AS with_shape, place_id % {_KINDS} <> {_KINDS - 1} AS success,"
    f" place_id % {_KINDS} IN (2, 3, 4, 7, 8, 9, 10) AS defined FROM links)"
)


def _parsed(spark, d):
    """Per sentence: does it mention a shape, does it give a tree, is the tree definite, and which tree is it?

    A sentence of several relations is an intersection, which is definite."""
    known = _sentences(spark, d).withColumn("known", R.known_text(R.E.col("sentence")))
    found = known.select("entity_id", "place_id", "sentence", "known", R.matches(R.E.col("known")).alias("m"))
    first = F.get("m", F.lit(0))
    own = F.get(first["own_cardinals"], F.lit(0))
    return found.select(
        "entity_id",
        "place_id",
        "sentence",
        F.contains("sentence", F.lit("SHP")).alias("with_shape"),
        (F.size("m") > 0).alias("success"),
        F.coalesce((F.size("m") > 1) | R.is_defined(first["relation"], first["side"], own), F.lit(False)).alias("defined"),
        R.nested(R.E.col("known"), R.E.col("m")).alias("operators"),
    )


_ENTITY_COUNTS = "counts AS (SELECT entity_id, count(*) AS sentences, count_if(with_shape) AS with_shape, count_if(success) AS success, count_if(defined) AS defined FROM told GROUP BY ALL)"


def _entity_counts(parsed):
    return parsed.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("sentences"),
        *[F.count_if(F.col(c)).alias(c) for c in ("with_shape", "success", "defined")],
    )


@query("qualifying_entities", X.with_sql("links")[:-1] + f", {_SUCCESS}, {_ENTITY_COUNTS} SELECT entity_id, CAST(success AS BIGINT) AS success, CAST(defined AS BIGINT) AS defined FROM counts WHERE defined > 0 OR success > 1")
def qualifying_entities(spark, d):
    """Entities with a definite tree or with more than one tree."""
    return _entity_counts(_parsed(spark, d)).where("defined > 0 OR success > 1").select("entity_id", "success", "defined")


@query("extraction_summary", X.with_sql("links")[:-1] + f", {_SUCCESS}, {_ENTITY_COUNTS} SELECT count(*) AS entities, CAST(sum(with_shape) AS BIGINT) AS with_shape, CAST(sum(success) AS BIGINT) AS success, CAST(sum(defined) AS BIGINT) AS defined, CAST(count_if(defined > 0 OR success > 1) AS BIGINT) AS parsed FROM counts")
def extraction_summary(spark, d):
    return _entity_counts(_parsed(spark, d)).agg(
        F.count(F.lit(1)).alias("entities"),
        *[F.sum(c).alias(c) for c in ("with_shape", "success", "defined")],
        F.count_if(F.expr("defined > 0 OR success > 1")).alias("parsed"),
    )


@query(
    "extraction_report",
    X.with_sql("links")[:-1] + f", {_SUCCESS}, {_ENTITY_COUNTS}, lines AS (SELECT entity_id, place_id, CASE WHEN success THEN {_by_kind(6)} ELSE {_by_kind(0)} END AS line, success FROM told)"
    " SELECT entity_id, -1 AS line_no, success || ' success from ' || with_shape || ' with shapes' AS line FROM counts"
    " UNION ALL SELECT entity_id, place_id, line FROM lines JOIN (SELECT entity_id, success AS n FROM counts) USING (entity_id) WHERE success OR n = 0",
)
def extraction_report(spark, d):
    """Report lines per entity: a count, then its trees, or its sentences when none gives a tree.

    Sentences are parsed once and stored. Lines stay rows with an order, so no entity's report is gathered in one place."""
    line = F.coalesce("operators", "sentence").alias("line")
    parsed = stored(_parsed(spark, d).select("entity_id", F.col("place_id").alias("line_no"), "with_shape", "success", "defined", line), "parsed")
    counts = _entity_counts(parsed)
    heads = counts.select(
        "entity_id",
        F.lit(-1).cast("bigint").alias("line_no"),
        F.concat("success", F.lit(" success from "), "with_shape", F.lit(" with shapes")).alias("line"),
    )
    failed = parsed.join(counts.where("success = 0").select("entity_id"), "entity_id", "left_semi")
    lines = parsed.where("success").unionByName(failed)
    return heads.unionByName(lines.select("entity_id", "line_no", "line"))


_LEX = "(VALUES " + ", ".join(f"('{p}', '{k}', '{v}')" for p, k, v in L.entries()) + ") lex(phrase, kind, value)"
_ASCII_TOKENS = "regexp_extract_all(regexp_replace(text, 'SHP([0-9]+)', 'SHP \\1', 'g'), '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]+')"


@query(
    "lexicon_tag",
    X.with_sql("links")[:-1] + f", told AS (SELECT lower({_by_kind(0)}) AS text FROM links), spaced AS (SELECT ' ' || array_to_string(regexp_extract_all(regexp_replace(text, 'shp([0-9]+)', 'shp \\1', 'g'), '[0-9a-z_]+|[^0-9a-z_\\s]+'), ' ') || ' ' AS text FROM told),"
    f" lex AS (SELECT DISTINCT * FROM {_LEX}) SELECT phrase, kind, value, CAST(sum((length(text) - length(replace(text, ' ' || phrase || ' ', '  '))) / length(phrase)) AS BIGINT) AS hits"
    " FROM spaced JOIN lex ON contains(text, ' ' || phrase || ' ') GROUP BY ALL",
)
def lexicon_tag(spark, d):
    """Hits of the word tables in the sentences: runs of one to three tokens meet the broadcast tables."""
    tokens = T.tokenize(F.col("sentence"))
    runs = _sentences(spark, d).select(tokens.alias("t")).select(
        F.explode(
            F.flatten(
                F.transform(
                    F.sequence(F.lit(1), F.lit(3)),
                    lambda n: F.when(
                        F.size("t") >= n,
                        F.transform(
                            F.sequence(F.lit(1), F.size("t") - n + 1),
                            lambda i: F.array_join(F.slice("t", i, n), " "),
                        ),
                    ).otherwise(F.array().cast("array<string>")),
                )
            )
        ).alias("phrase")
    )
    counted = runs.groupBy("phrase").agg(F.count(F.lit(1)).alias("hits"))
    tables = spark.createDataFrame(L.entries(), "phrase string, kind string, value string").distinct()
    return counted.join(F.broadcast(tables), "phrase").select("phrase", "kind", "value", "hits")


# ---- operator trees -------------------------------------------------------------------------------

# operator text by kind, and its nodes: (parent, slot, op, depth, place offset, distance, unit, cardinal)
_TREES = [
    ("SubLocation(SimpleLocation(SimpleLocation(GeoLocation({n},None),None),None))",
     [(None, 0, "SubLocation", 0, None, None, None, None), (0, 0, "SimpleLocation", 1, None, None, None, None),
      (1, 0, "SimpleLocation", 2, None, None, None, None), (2, 0, "GeoLocation", 3, 0, None, None, None)]),
    ("SubLocation(SimpleLocation(GeoLocation({n},None),Some(GeoCardinal(NE))))",
     [(None, 0, "SubLocation", 0, None, None, None, None), (0, 0, "SimpleLocation", 1, None, None, None, "NE"),
      (1, 0, "GeoLocation", 2, 0, None, None, None)]),
    ("Intersection(SubLocation(SimpleLocation(GeoLocation({n},None),None)),Between(SimpleLocation(GeoLocation({m},None),None),SimpleLocation(SimpleLocation(GeoLocation({n},None),None),None)))",
     [(None, 0, "Intersection", 0, None, None, None, None), (0, 0, "SubLocation", 1, None, None, None, None),
      (1, 0, "SimpleLocation", 2, None, None, None, None), (2, 0, "GeoLocation", 3, 0, None, None, None),
      (0, 1, "Between", 1, None, None, None, None), (4, 0, "SimpleLocation", 2, None, None, None, None),
      (5, 0, "GeoLocation", 3, 1, None, None, None), (4, 1, "SimpleLocation", 2, None, None, None, None),
      (7, 0, "SimpleLocation", 3, None, None, None, None), (8, 0, "GeoLocation", 4, 0, None, None, None)]),
    ("Distance(SimpleLocation(GeoLocation({n},None),Some(GeoCardinal(W))),10,KM,Some(GeoCardinal(N)))",
     [(None, 0, "Distance", 0, None, 10, "KM", "N"), (0, 0, "SimpleLocation", 1, None, None, None, "W"),
      (1, 0, "GeoLocation", 2, 0, None, None, None)]),
]
_TREE_TEXT = "CASE place_id % 4 " + " ".join(f"WHEN {k} THEN {_filled(t)}" for k, (t, _) in enumerate(_TREES)) + " END"


def _value(v) -> str:
    return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)


_NODES_SQL = "nodes AS (" + " UNION ALL ".join(
    f"SELECT entity_id || '_' || place_id AS expr_id, entity_id, place_id, CAST({i} AS INT) AS node_id, CAST({_value(n[0])} AS INT) AS parent_id,"
    f" CAST({n[1]} AS INT) AS slot, '{n[2]}' AS op, CAST({n[3]} AS INT) AS depth, CAST({'NULL' if n[4] is None else f'place_id + {n[4]}'} AS INT) AS shp_id,"
    f" CAST({_value(n[5])} AS INT) AS distance, {_value(n[6])} AS unit, {_value(n[7])} AS cardinal FROM links WHERE place_id % 4 = {k}"
    for k, (_, nodes) in enumerate(_TREES)
    for i, n in enumerate(nodes)
) + ")"


def _operator_rows(spark, d):
    return spread(X.links(spark, d), "entity_id", "place_id").select(
        F.concat_ws("_", "entity_id", "place_id").alias("expr_id"),
        F.expr(_TREE_TEXT.replace("VARCHAR(20)", "STRING")).alias("operators"),
    )


@query("tokenize_operators", X.with_sql("links")[:-1] + f", rows AS (SELECT entity_id, place_id, regexp_extract_all({_TREE_TEXT}, '[(),]|[^(),]+') AS t FROM links) SELECT entity_id || '_' || place_id AS expr_id, len(t) AS tokens, array_to_string(t, '|') AS joined FROM rows")
def tokenize_operators(spark, d):
    t = T.tokenize_operators(F.col("operators"))
    return _operator_rows(spark, d).select("expr_id", t.alias("t")).select(
        "expr_id", F.size("t").cast("bigint").alias("tokens"), F.array_join("t", "|").alias("joined")
    )


@query("operator_nodes", X.with_sql("links")[:-1] + f", {_NODES_SQL} SELECT expr_id, node_id, parent_id, slot, op, depth, shp_id, distance, unit, cardinal FROM nodes")
def operator_nodes(spark, d):
    return trees.operator_nodes(_operator_rows(spark, d))


@query(
    "rank_candidates",
    X.with_sql("links")[:-1] + f", {_NODES_SQL}, scores AS (SELECT entity_id, place_id, sum(CASE WHEN parent_id IS NULL THEN 0 WHEN op = 'SubLocation' THEN 0.9 ELSE 1 END) AS score FROM nodes GROUP BY ALL)"
    " SELECT entity_id, count(*) AS candidates, arg_min(place_id, -score * 1000000 + place_id) AS place_id, round(max(score), 6) + 0e0 AS score FROM scores GROUP BY ALL",
)
def rank_candidates(spark, d):
    """Best tree per entity: the one with the most nodes, sub-locations counting a little less."""
    nodes = trees.operator_nodes(_operator_rows(spark, d)).withColumns(
        {"entity_id": F.split("expr_id", "_")[0].cast("bigint"), "place_id": F.split("expr_id", "_")[1].cast("bigint")}
    )
    best = trees.best_candidate(trees.tree_scores(nodes, ["entity_id", "place_id"]), ["entity_id"], "place_id")
    return best.withColumn("score", rounded(F.col("score")))


_BELOW = [[3, 2, 1, 0], [2, 1, 0], [9, 2, 1, 0, 5, 1, 0, 2, 1, 0], [2, 1, 0]]


@query("tree_descendants", X.with_sql("links") + " UNION ALL ".join(
    f"SELECT entity_id || '_' || place_id AS expr_id, CAST({i} AS INT) AS node_id, CAST({n} AS BIGINT) AS descendants FROM links WHERE place_id % 4 = {k}"
    for k, below in enumerate(_BELOW) for i, n in enumerate(below)))
def tree_descendants(spark, d):
    return trees.descendants(trees.operator_nodes(_operator_rows(spark, d)))


@query(
    "bind_toponyms",
    X.with_sql("links")[:-1] + f", {_NODES_SQL} SELECT n.expr_id, n.node_id, n.shp_id, s_suppkey AS place_id FROM nodes n LEFT JOIN supplier ON s_suppkey = n.shp_id WHERE n.op = 'GeoLocation'",
)
def bind_toponyms(spark, d):
    """Leaves of the trees with the place their number stands for; null where there is none."""
    leaves = trees.operator_nodes(_operator_rows(spark, d)).where("op = 'GeoLocation'").select("expr_id", "node_id", "shp_id")
    places = X.places(spark, d).select("place_id")
    return leaves.join(places, F.col("shp_id") == F.col("place_id"), "left")


@query(
    "complete_keys",
    X.with_sql("entities")[:-1] + ", rows AS (SELECT * FROM lineitem JOIN entities ON l_orderkey = entity_id WHERE status = '5')"
    " SELECT DISTINCT unnest(['O' || l_orderkey, 'O' || l_partkey, 'O' || l_suppkey, 'O0', 'O' || l_partkey, 'O' || l_suppkey]) AS osm_id,"
    " unnest(['way', 'relation', 'way', 'relation', 'way', 'node']) AS osm_type FROM rows",
)
def complete_keys(spark, d):
    """Keys of the complete entities and of all places that they link to."""
    return corpus.complete_keys(_corpus(spark, d))
