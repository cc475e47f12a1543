import gzip
import hashlib
import json

from pyarrow import fs

from tickertone.llm import warc
from tickertone.llm.shared import shared_folder

SCHEMA = "page_id long, url string, html string, digest string"
LONG = "<p>" + "ä" * 200
ROWS = [
    (3, "http://a/", LONG, "x"), (1, "http://b/ c\r\nWARC-Type: x", LONG, "x"), (2, None, LONG, "x"), (4, "u", "short", "x"), (5, "u", "short", "x"),
    (6, "u", None, "x"), (7, "u", "", "x"), (8, "%20", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9, "x"), (9, "u", "q" * 3_000_000, "x"), (1, "again", LONG, "x"), (None, "n", LONG, "x"),
]


def expected():
    out = []
    for page_id, url, html, _ in ROWS:
        data = (html or "").encode()
        same = [i for i, _, h, _ in ROWS if h == html and i is not None]
        original = min(same) if len(data) >= 100 and same else None
        original = None if original == page_id else original
        out.append((page_id, url, len(data), hashlib.sha256(data).hexdigest(), "response" if original is None else "revisit", original, None if original is not None else data))
    return sorted(out, key=str)


def read(table):
    return sorted([(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in table.collect()], key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA)
    assert read(warc.read_archives(warc.archive_pages(spark, pages))) == expected()
    assert warc.read_archives(warc.archive_pages(spark, spark.createDataFrame([], SCHEMA))).collect() == []


def test_members_and_index(spark):
    folder = shared_folder(spark)
    pages = warc.with_originals(spark.createDataFrame(ROWS, SCHEMA)).coalesce(1)
    whole = warc.write_archives(pages, folder + "/a", file_bytes=4000).checkpoint()
    files = warc.normalise(whole, folder + "/b").checkpoint().collect()
    assert sum(r.records for r in files) == len(ROWS) and len(files) > 1
    local = fs.LocalFileSystem()
    before = b"".join(sorted(gzip.decompress(local.open_input_file(r.path).read()) for r in whole.collect()))
    after = []
    for row in files:
        data = local.open_input_file(row.path).read()
        after.append(gzip.decompress(data))
        end = 0
        for line in local.open_input_file(row.index_path).read().splitlines():
            entry = json.loads(line)
            assert entry["offset"] == end
            end += entry["length"]
            one = gzip.decompress(data[entry["offset"] : end])
            assert one.startswith(b"WARC/1.1\r\n") and entry["id"].encode() in one
        assert end == len(data)
    assert b"".join(sorted(after)) == before
    again = warc.normalise(spark.createDataFrame(files).select("path"), folder + "/c")  # members as input
    assert sum(r.records for r in again.collect()) == len(ROWS)
