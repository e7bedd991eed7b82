"""Archives: round trip, revisits and headers."""

import gzip
import hashlib

from sourceloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, record string, path string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], SCHEMA).repartition(3)


LONG = "<p>" + "é\r\n\r\nWARC/1.1\r\n" * 4000
ROWS = [(1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, None, "x" * 99), (4, "http://a/ \r\nX: y", "x" * 99), (5, "http://a/5", None),
        (6, "http://a/6", ""), (7, "http://a/7", LONG), (8, "http://a/8", LONG), (9, "http://a/9", LONG), (None, "http://a/n", LONG), (None, None, None),
        (10, "http://a/10", "y" * 200), (11, "http://a/11", "y" * 200 + "\x00\U0001F600"), (12, "http://a/12", "z" * 150), (12, "http://a/12", "z" * 150)]


def expected(rows):
    out, first = [], {}
    for i, _, h in rows:
        data = (h or "").encode()
        if i is not None:
            first[data] = min(first.get(data, i), i)
    done = set()
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and (i != first[data] or (i, data) in done)
        done.add((i, data))
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[data] if revisit else None))
    return sorted(map(repr, out))


def test_pages_come_back_whole(spark, ws):
    got = warc.archive_pages(ws, pages(spark, ROWS), records_per_file=3).collect()
    assert sorted(repr(tuple(r)) for r in got) == expected(ROWS)


def test_no_pages(spark, ws):
    assert warc.archive_pages(ws, pages(spark, [])).count() == 0


def test_archives_are_plain_warc(spark, ws):
    table = pages(spark, ROWS)
    warc.archive_pages(ws, table)
    files = spark.read.format("binaryFile").load(f"{ws.root}/deduplicated").collect()
    seen, texts = {}, {}
    for file in files:
        data = gzip.decompress(bytes(file.content))
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(headers["Content-Length"])
            block, end, data = rest[:size], rest[size:size + 4], rest[size + 4:]
            assert end == b"\r\n\r\n" and hashlib.sha256(block).hexdigest() == headers["WARC-Block-Digest"][7:]
            seen[headers["WARC-Record-ID"]] = headers
            texts[headers["WARC-Record-ID"]] = block.partition(b"\r\n\r\n")[2]
    assert len(seen) == len(ROWS)
    for name, h in seen.items():
        if h["WARC-Type"] == "revisit":
            target = seen[h["WARC-Refers-To"]]
            assert texts[name] == b"" and target["WARC-Type"] == "response" and target["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
            assert h.get("WARC-Refers-To-Target-URI") == target.get("WARC-Target-URI")
        else:
            assert hashlib.sha256(texts[name]).hexdigest() == h["WARC-Payload-Digest"][7:]
