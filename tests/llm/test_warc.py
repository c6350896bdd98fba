import base64
import gzip
import hashlib
from email.parser import BytesParser
from html.parser import HTMLParser

from zephyrine.llm import warc


def test_record_round_trip():
    headers = [("WARC-Type", "resource"), ("X", "a b"), ("Content-Length", "5")]
    data = warc.write(headers, b"a\r\n\r\nb"[:5])
    assert warc.read(data) == (headers, b"a\r\n\r\n", len(data) - 4)
    assert warc.read(data + data, len(data) - 4)[0] == headers
    for broken in (b"", b"junk", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort", b"WARC/1.1\r\n\r\n"):
        assert warc.read(broken) is None


def test_derivatives_of_one():
    raw = warc.response(3, "http://h/é", "<title>T &amp; t</title><script>x</script><p>one <b>two</b><p>three <a href='l'>li</a>", warc.DATE)
    headers, block, _ = warc.read(raw)
    assert warc.value(headers, "warc-block-digest") == warc.digest(block)
    (meta, fields), (text, body) = warc.derive(headers, block)
    source = warc.value(headers, "WARC-Record-ID")
    for own in (meta, text):
        assert warc.value(own, "WARC-Refers-To") == source
        assert warc.value(own, "WARC-Target-URI") == "http://h/é"
        assert warc.value(own, "WARC-Date") == warc.DATE
    assert warc.value(meta, "WARC-Concurrent-To") == warc.value(text, "WARC-Record-ID")
    assert warc.value(text, "WARC-Concurrent-To") == warc.value(meta, "WARC-Record-ID")
    assert body == b"one two\nthree li"
    assert warc.value(text, "WARC-Block-Digest") == warc.digest(body)
    said = dict(warc._fields(fields))
    assert said["http-status"] == "HTTP/1.1 200 OK" and said["title"] == "T & t" and said["outlink"] == "l"
    assert said["source-payload-digest"] == warc.value(headers, "WARC-Payload-Digest")
    assert said["http-header-content-type"] == "text/html; charset=utf-8"


def test_payload_decoding():
    body = "naïve".encode("latin-1")
    assert warc.decoded([("Content-Type", "text/html; charset=ISO-8859-1")], body) == "naïve"
    assert warc.decoded([("Content-Encoding", "gzip")], gzip.compress(b"x")) == "x"
    assert warc.decoded([("Content-Encoding", "gzip")], b"not gzip") == "not gzip"
    assert warc.decoded([("Transfer-Encoding", "chunked")], b"3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == "abcde"
    assert warc.decoded([("Content-Type", "text/html; charset=nonsense")], b"ok") == "ok"


def test_image_has_no_text():
    block = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    got = warc.derive([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block)
    assert [warc.value(h, "WARC-Type") for h, _ in got] == ["metadata"]
    assert warc.derive([("WARC-Type", "request")], block) == []


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(None, None, None), (-1, None, ""), (-1, None, "")], pages.schema)
    rows = pages.unionByName(extra).collect()
    want = []
    for r in rows:
        headers, block, _ = warc.read(warc.response(r.page_id, r.url, r.html or "", warc.DATE))
        want += [warc.write(h, b) for h, b in warc.derive(headers, block)]
    got = warc.derivatives(warc.responses(pages.unionByName(extra))).collect()
    assert sorted(bytes(r.record) for r in got) == sorted(want)
    for r in got:
        headers, block, _ = warc.read(bytes(r.record))
        assert (r.refers_to, r.block_digest, r.content_length) == (warc.value(headers, "WARC-Refers-To"), warc.digest(block), len(block))


def test_odd_records(spark):
    both = warc.response(1, "http://a/", "x", warc.DATE) * 2
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"junk"), (4, both)], "page_id long, record binary")
    got = warc.derivatives(df).collect()
    assert sorted((r.page_id, r.record_type, r.content_length if r.record_type == 'unreadable' else 0) for r in got) == [(3, 'unreadable', 4), *[(4, 'conversion', 0)] * 2, *[(4, 'metadata', 0)] * 2]
    assert warc.derivatives(df.limit(0)).count() == 0


def test_files(spark, tmp_path):
    records = [warc.response(i, f"http://a/{i}", f"<p>{i}", warc.DATE) for i in range(5)]
    (tmp_path / "a.warc").write_bytes(b"".join(records[:2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[2:]))
    got = warc.read_files(spark, f"{tmp_path}/*")
    assert got.count() == 5 and got.agg({"skipped": "sum"}).first()[0] == 0
    assert warc.derivatives(got.selectExpr("1L AS page_id", "record")).count() == 10


def test_goes_on_after_broken_records(spark, tmp_path):
    good = [warc.response(i, f"http://a/{i}", f"<p>{i}", warc.DATE) for i in range(4)]
    long = good[1].replace(b"Content-Length: ", b"Content-Length: 9", 1)
    none = good[2].replace(b"Content-Length: ", b"Content-Size: ", 1)
    for broken in (b"junk\r\n", long, none, good[1][:200] + b"\r\n", b"WARC/1.1\r\n", b"\x00" * 50 + b"\n"):
        for size in (1, 7, 1 << 20):
            data = good[0] + broken + good[3]
            found = list(warc.records(iter([data[i : i + size] for i in range(0, len(data), size)])))
            ids = [warc.value(x[0], "WARC-Target-URI") for x in found if not isinstance(x, int)]
            assert ids == ["http://a/0", "http://a/3"], broken
            assert abs(sum(x for x in found if isinstance(x, int)) - len(broken)) <= 4
    members = [gzip.compress(r) for r in good]
    members[1] = members[1][:30] + b"\xff\xff\xff" + members[1][33:]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert sum(r.record is not None for r in got) == 3


def test_late_character_set_and_long_links():
    late = b"<!-- " + b"x" * 5000 + b" --><meta name=a " + b"y" * 300 + b" charset=latin-1>na\xefve"
    assert warc.decoded([("Content-Type", "text/html")], late).endswith("naïve")
    _, _, links = warc.plain(f"<a title='{'t' * 5000}>' href='/x?a=1&amp;b=2'>l</a><script>'<a href=no>'</script><a href=y>")
    assert links == ["/x?a=1&b=2", "y"]


class Reader(HTMLParser):
    """Words outside of scripts and styles, title and links, by the standard library's parser."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.words, self.title, self.links, self.open = [], [], [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "title"):
            self.open.append(tag)
        self.links += [v for k, v in attrs if tag == "a" and k == "href"]

    def handle_endtag(self, tag):
        if self.open and tag == self.open[-1]:
            self.open.pop()

    def handle_data(self, data):
        if not self.open:
            self.words.append(data)
        elif self.open[-1] == "title":
            self.title.append(data)


def test_against_other_parsers(spark, sf):
    """Every record, read by the standard library's header and HTML parsers, holds what its page says."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = warc.derivatives(warc.responses(spark.read.parquet(f"{sf}/pages.parquet"))).collect()
    assert len(got) == 2 * len(pages)
    by = {}
    for r in got:
        version, _, rest = bytes(r.record).partition(b"\r\n")
        head, _, body = rest.partition(b"\r\n\r\n")
        headers = BytesParser().parsebytes(head)
        body = body[: int(headers["Content-Length"])]
        assert version == b"WARC/1.1" and rest.endswith(b"\r\n\r\n")
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert headers["WARC-Target-URI"] == pages[r.page_id].url
        by[r.page_id, headers["WARC-Type"]] = headers, body
    for i, page in pages.items():
        (meta, fields), (text, body) = by[i, "metadata"], by[i, "conversion"]
        assert meta["WARC-Refers-To"] == text["WARC-Refers-To"] and meta["WARC-Concurrent-To"] == text["WARC-Record-ID"]
        read = Reader(page.html)
        assert "".join(body.decode().split()) == "".join("".join(read.words).split())
        said = [line.partition(": ")[::2] for line in fields.decode().split("\r\n") if line]
        assert [v for k, v in said if k == "outlink"] == [" ".join(x.split()) for x in read.links]
        assert [v for k, v in said if k == "title"] == [" ".join("".join(read.title).split())]
        payload = page.html.encode()
        assert dict(said)["source-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
