import hashlib
import io

import pytest

from placespark.llm import warc
from placespark.llm.common import shared_folder

LONG = "<p>" + "ä" * 90
ROWS = [
    (5, "http://a", LONG), (3, "http://b", LONG), (9, None, LONG), (1, "http://c", "short"), (2, "http://c", "short"),
    (4, "http://d", None), (6, "http://d", ""), (7, "u\nv", "x" * 300_000), (8, "w", "x" * 300_000), (3, "http://b", LONG),
    (None, "n", LONG), (None, "n", None),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as first", "2 as id")


def expected(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same) if len(data) >= 100 and same else None
        revisit = first is not None and page is not None and page > first
        kind = "revisit" if revisit else "response"
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), kind, first if revisit else None, True))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(frame(spark, ROWS)).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)


def test_whole_payloads_and_rolling(spark):
    files = warc.write(frame(spark, ROWS), shared_folder(spark, "warc"), roll=1)
    assert files.count() == len(ROWS)
    got = warc.read(spark, files).filter("record_type = 'response'").collect()
    assert {(r["page_id"], bytes(r["payload"]).decode()) for r in got} == {
        (p, h or "") for p, h in {(r[0], r[2]) for r in ROWS} if not (h in (LONG, ROWS[7][2]) and p in (5, 9, 8))
    }
    assert {r["target_uri"] for r in got if r["page_id"] == 7} == {"u v"}


def test_empty(spark):
    assert warc.round_trip(frame(spark, ROWS).limit(0)).count() == 0


def test_framing_and_digests():
    good = warc.member(warc.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, ""))
    bad = warc.member(warc.record(2, "u", b"payload", "0" * 64, None, ""))
    found = list(warc.records(io.BytesIO(good + bad + good)))
    assert [r["digest_ok"] for r in found] == [True, False, True] and found[0]["payload"] == b"payload"
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records(io.BytesIO(good + good[:-12])))
    whole = warc.record(1, "u", b"payload", "0", None, "")
    for wrong in (whole[:-4], whole + b"x", whole.replace(b"WARC/1.1", b"XXXX/1.1")):
        with pytest.raises(ValueError):
            list(warc.records(io.BytesIO(warc.member(wrong))))
