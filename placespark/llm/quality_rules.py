"""Quality rules: word and symbol counts per document, and lines that too many documents of a host share.

Lines are normalised (A-Z lower-cased, digits to 0, white space to single spaces) and hashed; the distinct documents of
each line and host are counted over the whole table; lines above the limit are removed, and a document that loses more
than ``max_removed`` of its characters in lines with a word is depleted and rejected.

- The limit of a host is ``min_docs`` documents or ``max_share`` of the host's documents, whichever is larger.
- ``source`` is the host; null is a host of its own. Null text has no words and fails the base rules, as empty text.
- Rows that repeat a doc_id are documents each. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placespark.llm.common import as_array, coded, hashed, slices, stored, strings, words

MIN_WORDS = 50
#: Percent of words in repeated three-word windows.
MAX_REPEATED = 50
MIN_DOCS = 10
MAX_SHARE = 0.005
MAX_REMOVED = 0.5

SCANNED = (
    "row long, doc_id long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, line_chars long, lines array<struct<line_hash: long, chars: long>>"
)
_LINES = pa.list_(pa.struct([("line_hash", pa.int64()), ("chars", pa.int64())]))


def repeated_words(rows: np.ndarray, codes: np.ndarray, n: int) -> np.ndarray:
    """Words in three-word windows that their text has twice or more, for each of n texts."""
    if len(rows) < 4:
        return np.zeros(n, np.int64)
    whole = rows[:-2] == rows[2:]
    many = np.int64(codes.max()) + 1
    _, pair = np.unique(codes[:-2] * many + codes[1:-1], return_inverse=True)
    _, triple = np.unique(pair * many + codes[2:], return_inverse=True)
    _, at, times = np.unique(triple * np.int64(n) + rows[:-2], return_inverse=True, return_counts=True)
    twice = whole & (np.bincount(at, whole, len(times))[at] > 1)
    covered = np.zeros(len(rows), bool)
    for k in range(3):
        covered[k : len(rows) - 2 + k] |= twice
    return np.bincount(rows[covered], minlength=n)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(lines with a word that equal an earlier one, characters in lines with a word, normalised lines) of each text."""
    n = len(texts)
    lists = pc.split_pattern(texts, "\n")
    flat, rows = as_array(lists.flatten()), pc.list_parent_indices(lists)
    full = pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]")
    flat = as_array(pc.filter(flat, full))
    rows = pc.filter(rows, full).to_numpy(zero_copy_only=False).astype(np.int64)
    codes, distinct = coded(flat)
    chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    many = np.int64(len(distinct) + 1)
    dups = np.bincount(rows, minlength=n) - np.bincount(np.unique(rows * many + codes) // many, minlength=n)
    same = pc.replace_substring_regex(pc.ascii_lower(distinct), "[0-9]+", "0")
    same = pc.utf8_trim(pc.replace_substring_regex(same, r"[\x20\x09-\x0D]+", " "), " ")
    normal, lines = coded(as_array(same))
    key, at = np.unique(rows * many + normal[codes], return_inverse=True)
    totals = np.bincount(at, chars, len(key)).astype(np.int64)
    offsets = np.searchsorted(key // many, np.arange(n + 1))
    fields = [pa.array(hashed(lines)[key % many].astype(np.int64)), pa.array(totals)]
    found = pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_LINES.value_type))
    )
    return dups, np.bincount(rows, chars, n).astype(np.int64), found


def scanned(documents: DataFrame) -> DataFrame:
    """Counts and hashed lines of each document, with a number for its row."""

    def task(batches):
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch, "text"):
                n, texts = piece.num_rows, strings(piece["text"])
                rows, found = words(texts)
                rows = rows.astype(np.int64)
                codes, distinct = coded(found)
                chars = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
                dups, line_chars, lines = _lines(texts)
                columns = {
                    "row": np.arange(number, number + n),
                    "doc_id": piece["doc_id"],
                    "source": piece["source"],
                    "n_words": np.bincount(rows, minlength=n),
                    "word_chars": np.bincount(rows, chars, n).astype(np.int64),
                    "n_symbols": pc.cast(pc.count_substring_regex(texts, r"[#*$%&|<>]"), pa.int64()),
                    "n_dup_lines": dups,
                    "n_repeat_words": repeated_words(rows, codes, n),
                    "line_chars": line_chars,
                    "lines": lines,
                }
                number += n
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns.values()], list(columns)
                )

    return documents.select("doc_id", F.col("source").cast("string").alias("source"), "text").mapInArrow(task, SCANNED)


def judge(
    documents: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED
) -> DataFrame:
    """Counts, verdict and characters removed of each document."""
    docs = stored(scanned(documents), "rules-scanned")
    lines = docs.select("row", "source", F.explode("lines").alias("line")).select(
        "row", "source", "line.line_hash", "line.chars"
    )
    hosts = docs.groupBy("source").agg(F.count("*").alias("host_docs"))
    hosts = hosts.select(F.col("source").alias("host"), F.greatest(F.lit(min_docs), F.col("host_docs") * max_share).alias("most"))
    counted = lines.groupBy("source", "line_hash").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    frequent = stored(
        counted.join(hosts, counted["source"].eqNullSafe(hosts["host"]))
        .filter("n_docs > most")
        .select(F.col("source").alias("host"), F.col("line_hash").alias("common")),
        "rules-lines",
    )
    removed = (
        lines.join(frequent, (lines["line_hash"] == frequent["common"]) & lines["source"].eqNullSafe(frequent["host"]))
        .groupBy("row")
        .agg(F.sum("chars").alias("removed_chars"), F.count("*").alias("removed_lines"))
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return (
        docs.drop("lines", "source")
        .join(removed, "row", "left")
        .na.fill(0, ["removed_chars", "removed_lines"])
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("removed_chars") <= max_removed * F.col("line_chars")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
            "removed_lines", "removed_chars",
        )
    )


def oracle(min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_removed: float = MAX_REMOVED) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH docs AS (
    SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
    FROM documents),
grams AS (
    SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
    FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs)),
twice AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, gram) AS times FROM grams) WHERE times > 1),
repeats AS (
    SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
lines AS (
    SELECT r, source, line, trim(regexp_replace(regexp_replace(translate(line, '{upper}', '{lower}'), '[0-9]+', '0', 'g'),
        '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS normal
    FROM (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts AS (
    SELECT r, count(*) - count(DISTINCT line) AS dups, sum(length(line)) AS chars FROM lines GROUP BY r),
hosts AS (SELECT source, greatest({min_docs}, count(*) * {max_share}) AS most FROM docs GROUP BY source),
shared AS (
    SELECT l.source, normal FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
    GROUP BY l.source, normal, most HAVING count(DISTINCT r) > most),
lost AS (
    SELECT r, count(DISTINCT l.normal) AS n, sum(length(line)) AS chars
    FROM lines l JOIN shared s ON l.normal = s.normal AND l.source IS NOT DISTINCT FROM s.source GROUP BY r),
counts AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines,
        coalesce(repeats.n, 0) AS n_repeat_words, coalesce(line_counts.chars, 0) AS line_chars,
        coalesce(lost.n, 0) AS removed_lines, coalesce(lost.chars, 0) AS removed_chars,
        len(ws) < {MIN_WORDS} OR 100 * coalesce(repeats.n, 0) > {MAX_REPEATED} * len(ws) AS base_failed
    FROM docs LEFT JOIN repeats USING (r) LEFT JOIN line_counts USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
    CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND removed_chars <= {max_removed} * line_chars AS kept,
    CAST(removed_lines AS BIGINT) AS removed_lines, CAST(removed_chars AS BIGINT) AS removed_chars
FROM counts"""
