import base64
import hashlib

from palisade.llm import warc


def brute(rows, least=0):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(html or "") if len(data) >= least else None
        revisit = f is not None and i != f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", f if revisit else None))
    return sorted(out, key=str)


PAGES = [
    (5, "http://A.example.com/x?y#z", "<p>é</p>"),
    (3, "https://user@b.example.com:81/ q", "<p>é</p>"),
    (3, "https://user@b.example.com:81/ q", "<p>é</p>"),
    (7, None, None),
    (8, "", ""),
    (None, "http://nameless", "<p>é</p>"),
    (None, "http://nameless", "own"),
    (9, "no scheme", "a\r\n\r\nb" * 30000),
    (-4, "http://x/\n\t1", "short"),
    (11, "http://x/2", "short"),
]


def roundtrip(pages, lines=3000, **how):
    found = warc.write(pages, **how)
    index = warc.build(found, lines)
    return index, warc.read(warc.lookup(warc.keys(pages), index))


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, digest string, id int")
    for least in (0, 6):
        _, out = roundtrip(pages, lines=2, min_bytes=least)
        rows = out.collect()
        assert sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str) == brute(PAGES, least)
        # each response carries the payload of a row with its id, each revisit none
        given = {}
        for i, _, h in PAGES:
            given.setdefault(i, set()).add((h or "").encode())
        for r in rows:
            if r["record_type"] == "revisit":
                assert r["payload"] is None
            else:
                assert bytes(r["payload"]) in given[r["id"]] and len(r["payload"]) == r["payload_bytes"]
        assert {bytes(r["payload"]) for r in rows if r["payload"] is not None} == set().union(*given.values())


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    index, out = roundtrip(pages)
    assert out.count() == 0 and index.files == []


def test_lookup_reads_single_keys(spark, tables):
    found = warc.write(tables["pages"])
    index = warc.build(found, lines=7)
    want = found.orderBy("key").limit(40).select("key").collect()[::9]
    wanted = spark.createDataFrame([(r["key"],) for r in want] + [("zzz) 1 1",), ("!",)], "key string")
    assert sorted(r["key"] for r in warc.lookup(wanted, index).collect()) == sorted(r["key"] for r in want)


def test_records_are_warc():
    data = warc.record(1, "http://a/", b"body", warc.CAPTURED, None)
    head, http, payload = warc.parsed(data)
    assert data.startswith(b"WARC/1.1\r\n") and data.endswith(b"body\r\n\r\n") and payload == b"body"
    assert head["WARC-Type"] == "response" and http["Content-Length"] == "4"
    assert warc.sort_key("http://WWW.Example.com:8080/a b?c#d", warc.CAPTURED, 1).startswith("com,example,www:8080)/a%20b?c 20200101000000 ")
