"""ARC and WARC files: both versions, round trip, decisions, damage."""

import gzip
import hashlib
from base64 import b32encode

import pytest

from tidegap.llm import warc


def pages():
    big = "<html>" + "ü" * 70_000
    return [(1, "http://a/x y", "same"), (2, None, "same"), (3, "http://b/", None), (4, "http://c/", ""),
            (9, "http://d/\n?q=é", "same"), (9, "http://d/2", "same"), (5, "http://e/", "HTTP/1.1 in\r\n\r\nthe page"),
            (6, "http://f/", big), (None, "http://g/", "no id"), (7, "http://h/", "no id"), (8, "", "WARC/1.1\r\n\r\n")]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    return str(tmp_path_factory.mktemp("archives"))


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*p, "x", "x") for p in pages()],
                                 "page_id bigint, url string, html string, path string, number string").repartition(3, "page_id")


def test_round_trip(spark, place, table):
    arcs = warc.write_arc(table, f"file://{place}/arc")
    warcs = warc.convert_arc(arcs, f"file://{place}/warc")
    rows = warc.read_warc(warcs, payloads=True).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest) for r in rows) == sorted(
        (str(p), len((h or "").encode()), b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for p, _, h in pages())
    html = {p: h for p, _, h in pages()}
    for r in rows:
        if r.record_type == "response":
            assert r.payload.decode() == (html[r.page_id] or "") and r.refers_to is None
        else:
            assert r.payload is None
    kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in rows)
    assert sorted(map(str, kinds)) == sorted(map(str, [
        ("1", "revisit", 9), ("2", "revisit", 9), ("9", "response", None), ("9", "revisit", 9), ("3", "revisit", 4),
        ("4", "response", None), ("5", "response", None), ("6", "response", None), ("None", "revisit", 7),
        ("7", "response", None), ("8", "response", None)]))
    assert sum(k[1] == "response" for k in kinds) == 6
    assert len({r.record_id for r in rows}) == len(rows)
    assert {r.warc_date for r in rows} == {"2024-01-01T00:00:00Z"}
    again = warc.read_warc(warc.convert_arc(arcs, f"file://{place}/warc2")).collect()
    assert sorted(r.record_id for r in again) == sorted(r.record_id for r in rows)
    long_only = warc.read_warc(warc.convert_arc(arcs, f"file://{place}/warc3", 5)).collect()
    assert {r.page_id for r in long_only if r.record_type == "revisit"} == {None}


def test_both_versions_are_read(tmp_path):
    for version, fields in warc.FIELDS.items():
        values = {"URL": "http://x/a b", "IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/html"}
        body = b"HTTP/1.0 200 OK\r\n\r\nhello\nworld"
        data = warc._version_block(version, "f.arc", "19990101000000") + 2 * warc._arc_record(version, values, body)
        path = tmp_path / f"{version}.arc.gz"
        path.write_bytes(gzip.compress(data))
        found = list(warc.arc_records(f"file://{path}"))
        assert [c for _, c in found] == [body, body]
        assert found[0][0]["URL"] == "http://x/a b" and list(found[0][0]) == fields.split()
        path.write_bytes(gzip.compress(data[:-10]))
        with pytest.raises(ValueError, match="declared"):
            list(warc.arc_records(f"file://{path}"))


def test_damage_is_noticed(tmp_path):
    record = warc._warc_record("response", "x", "2024-01-01T00:00:00Z", [], b"block")
    path = tmp_path / "a.warc.gz"
    path.write_bytes(gzip.compress(record.replace(b"\r\n\r\nblock", b"\r\n\r\nblocK")))
    with pytest.raises(ValueError, match="damaged"):
        list(warc.warc_records(f"file://{path}"))


def test_no_pages(spark, place):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    arcs = warc.write_arc(none, f"file://{place}/none")
    assert warc.read_warc(warc.convert_arc(arcs, f"file://{place}/none-warc")).count() == 0


FOREIGN = {
    "gopher://one": b"no head at all", "gopher://two": b"no head at all",
    "http://old/1": b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nold page", "http://old/2": b"HTTP/1.0 200 OK\r\n\r\nold page",
    "http://lf/1": b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\nfirst", "http://lf/2": b"HTTP/1.0 200 OK\nX-Page-Id:8\n\nsecond\r\n\r\nrest",
    "http://odd/1": b"HTTP/1.1 200 OK\r\nX-Page-Id: seven\r\n\r\nodd id", "http://odd/2": b"HTTP/1.1 200 OK\r\nX-Page-Id: 99999999999999999999\r\n\r\nhuge id",
    "http://cut/": b"HTTP/1.1 200 OK\r\nContent-Length: 9", "http://empty/": b"", "http://head/": b"HTTP/1.1 204 None\r\n\r\n",
    # The same payload in four ways.
    "http://same/1": b"HTTP/1.1 200 OK\r\nContent-Length: 4\r\n\r\nsame", "http://same/2": b"HTTP/1.0 200 OK\n\nsame",
    "http://same/3": b"same", "http://same/4": b"HTTP/1.1 200 OK\r\nX-Page-Id: 5\r\nContent-Length: none\r\n\r\nsame"}
HEADS = {"http://old/1": 44, "http://old/2": 19, "http://lf/1": 30, "http://lf/2": 29, "http://odd/1": 37, "http://odd/2": 52,
         "http://head/": 21, "http://same/1": 38, "http://same/2": 17, "http://same/4": 55}


@pytest.mark.parametrize("version", [1, 2])
def test_records_of_other_writers(spark, tmp_path, version):
    """No head, no length, heads in LF, odd ids: everything comes back."""
    values = {"IP-address": "1.2.3.4", "Archive-date": "19990102030405", "Content-type": "text/html"}
    data = warc._version_block(version, "f.arc", "19990101000000") + b"".join(
        warc._arc_record(version, values | {"URL": url}, body) for url, body in FOREIGN.items())
    (tmp_path / "f.arc.gz").write_bytes(gzip.compress(data))
    arcs = spark.createDataFrame([(f"file://{tmp_path}/f.arc.gz",)], "path string")
    rows = {r.url: r for r in warc.read_warc(warc.convert_arc(arcs, f"file://{tmp_path}/warc"), payloads=True).collect()}
    assert set(rows) == set(FOREIGN)
    for url, body in FOREIGN.items():
        payload = body[HEADS.get(url, 0):]
        assert rows[url].payload_bytes == len(payload)
        assert rows[url].payload_digest == b32encode(hashlib.sha1(payload).digest()).decode()
        if rows[url].record_type != "revisit":
            assert rows[url].payload == payload
    kinds = {url: r.record_type for url, r in rows.items()}
    for equal in (["gopher://one", "gopher://two"], ["http://old/1", "http://old/2"], ["http://empty/", "http://head/"]):
        assert sorted(kinds[u] == "revisit" for u in equal) == [False, True]
    assert [kinds[f"http://same/{i}"] for i in range(1, 5)] == ["revisit"] * 3 + ["response"]
    assert {rows[f"http://same/{i}"].refers_to for i in range(1, 4)} == {5}
    assert [rows[u].page_id for u in ("http://lf/1", "http://lf/2", "http://odd/1", "http://odd/2")] == [7, 8, None, None]
    assert kinds["http://lf/1"] == kinds["http://lf/2"] == "response" and kinds["http://cut/"] == "resource"


def test_revisit_of_another_writer(spark, tmp_path):
    """A revisit without any length is read; its length is not known."""
    headers = [("WARC-Target-URI", "http://x/"), ("WARC-Payload-Digest", "sha1:AAAA")]
    records = [warc._warc_record("revisit", str(i), "2024-01-01T00:00:00Z", headers, block) for i, block in enumerate(
        (b"", b"HTTP/1.1 200 OK\r\n\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n"))]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    table = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string")
    assert sorted(map(str, (r.payload_bytes for r in warc.read_warc(table).collect()))) == ["12", "None", "None"]
