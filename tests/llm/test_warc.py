from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections import Counter, defaultdict

import pytest

from textloom.llm import warc as m

KIND = "page_id long, url string, html string"


def reread(rows):
    parts = defaultdict(list)
    for r in rows:
        parts[r.file, r.record_no].append(r)
    out = []
    for chunks in parts.values():
        chunks.sort(key=lambda r: r.chunk_no)
        body = b"".join(bytes(c.payload) for c in chunks)
        assert [c.start for c in chunks] == [sum(len(c.payload) for c in chunks[:i]) for i in range(len(chunks))]
        assert [c.last for c in chunks] == [False] * (len(chunks) - 1) + [True] and chunks[-1].valid
        for i, c in enumerate(chunks):
            assert c.digest == hashlib.sha256(b"".join(bytes(x.payload) for x in chunks[: i + 1])).hexdigest()
        out.append((chunks[0].page_id, chunks[0].url, body.decode()))
    return Counter(out)


@pytest.mark.parametrize("gz", [True, False])
@pytest.mark.parametrize("chunk", [7, 1000, m.CHUNK])
def test_round_trip(spark, tmp_path, gz, chunk):
    rows = [(1, "http://a/é?x=1", "<p>ü</p>" * 50), (2, None, "x"), (None, "http://b", ""), (3, "http://c", None), (4, "http://d", "y\r\n\r\nWARC/1.0\r\n" * 3), (5, "u", "é" * 300_00 if chunk > 7 else "é" * 40), (5, "u", "z"), (5, "u", "z")]
    files = m.write_warc(spark.createDataFrame(rows, KIND + "").selectExpr("*", "1 as file", "2 as chunk_no"), str(tmp_path / "w"), gzip=gz)
    got = reread(m.read_warc(files, chunk=chunk).collect())
    assert got == Counter(r for r in rows if r[2] is not None)
    assert {p.suffix for p in (tmp_path / "w").iterdir()} <= {".gz", ".warc"} and not [p for p in (tmp_path / "w").iterdir() if p.name.startswith(".")]


def test_writing_again_replaces(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "first")], KIND).coalesce(1)
    m.write_warc(pages, str(tmp_path / "w")).collect()
    files = m.write_warc(spark.createDataFrame([(1, "u", "second")], KIND).coalesce(1), str(tmp_path / "w"))
    assert [bytes(r.payload) for r in m.read_warc(files).collect()] == [b"second"]


def test_hostile_urls_and_empty(spark, tmp_path):
    files = m.write_warc(spark.createDataFrame([(1, "http://x/\r\nWARC-Type: evil", "t")], KIND), str(tmp_path / "w"))
    (row,) = m.read_warc(files).collect()
    assert row.type == "resource" and row.url == "http://x/%0D%0AWARC-Type:%20evil"
    empty = spark.createDataFrame([], KIND)
    assert m.read_warc(m.write_warc(empty, str(tmp_path / "e"))).count() == 0
    assert m.warc_chunks(empty).count() == 0


class Trickle(io.BytesIO):
    """A stream that tells the most it was asked for at once."""

    most = 0

    def read(self, n=-1):
        assert n > 0
        self.most = max(self.most, n)
        return super().read(n)


def record(body: bytes, length: int | None = None, digest: str = "") -> bytes:
    return b"WARC/1.0\r\nWARC-Record-ID: <r>\r\n" + (f"WARC-Payload-Digest: sha256:{digest}\r\n".encode() if digest else b"") + f"content-length:  {len(body) if length is None else length}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_reader_on_its_own():
    big = bytes(range(256)) * 40_000
    for raw in (record(big) + record(b"") + record(b"z"), gzip.compress(record(big)) + gzip.compress(record(b"") + record(b"z"))):
        stream = Trickle(raw)
        rows = list(m.records(stream, "f", 65_536))
        assert stream.most <= m.BLOCK and max(len(r[9]) for r in rows) <= 65_536
        assert b"".join(r[9] for r in rows if r[1] == 0) == big and [r[1] for r in rows if r[11]] == [0, 1, 2]
        assert rows[-1][10] == hashlib.sha256(b"z").hexdigest()
    cut = list(m.records(io.BytesIO(record(b"abc", 10)[:-6]), "f"))
    assert cut[-1][11] and cut[-1][12] is False
    assert list(m.records(io.BytesIO(record(b"abc", digest="00")), "f"))[0][12] is False
    for junk in (b"hello\r\n\r\n", b"no end", b"WARC/1.0\r\nA: b\r\n\r\n"):
        with pytest.raises(ValueError, match="WARC|length"):
            list(m.records(io.BytesIO(junk), "f"))
    assert list(m.records(io.BytesIO(b""), "f")) == []


@pytest.mark.parametrize("gz", [True, False])
def test_urls_of_any_length(spark, tmp_path, gz):
    rows = [(i, f"http://{i}/" + "é" * n, "<p>x</p>") for i, n in enumerate((5, 1 << 19, (1 << 20) - 120, 3 << 20, 7))]
    files = m.write_warc(spark.createDataFrame(rows, KIND).coalesce(1), str(tmp_path / "w"), gzip=gz)
    assert reread(m.read_warc(files).collect()) == Counter(rows)
    with pytest.raises(ValueError, match="WARC"):
        list(m.records(io.BytesIO(b"x" * (3 << 20)), "f"))


def one(block: bytes, *header: str, pack=None) -> tuple:
    raw = ("WARC/1.0\r\n" + "".join(f"{h}\r\n" for h in header) + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    return list(m.records(io.BytesIO(pack(raw) if pack else raw), "f", 7))[-1]


def sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def test_declared_digests():
    body, head = b"<p>body of some length</p>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n"
    response = ("WARC-Type: response", "Content-Type: application/http; msgtype=response")
    for block, kind, payload in ((head + body, response, body), (body, ("WARC-Type: resource", "Content-Type: text/html"), body)):
        assert one(block, *kind)[-1] is True
        assert one(block, *kind, f"WARC-Block-Digest: sha1:{sha1(block)}", f"WARC-Payload-Digest: sha1:{sha1(payload)}")[-1] is True
        assert one(block, *kind, f"WARC-Payload-Digest: SHA-256:{hashlib.sha256(payload).hexdigest().upper()}")[-1] is True
        assert one(block, *kind, f"WARC-Block-Digest: md5:{hashlib.md5(block).hexdigest()}")[-1] is True
        assert one(block, *kind, f"WARC-Payload-Digest: sha1:{sha1(b'else')}")[-1] is False
        assert one(block, *kind, f"WARC-Block-Digest: sha1:{sha1(b'else')}", f"WARC-Payload-Digest: sha1:{sha1(payload)}")[-1] is False
        assert one(block, *kind, "WARC-Block-Digest: blake3:abc")[-1] is None
        assert one(block, *kind, "WARC-Block-Digest: blake3:abc", f"WARC-Payload-Digest: sha1:{sha1(b'else')}")[-1] is False
    assert one(b"", "WARC-Type: revisit", f"WARC-Payload-Digest: sha1:{sha1(body)}")[-1] is None


def test_folded_headers_and_padding():
    row = one(b"x", "WARC-Type: resource", "WARC-Target-URI: http://a/", "\tb c", pack=lambda raw: gzip.compress(raw) + b"\0" * 2000)
    assert row[5] == "http://a/ b c" and row[-1] is True


def test_bad_gzip_is_a_value_error():
    packed = gzip.compress(b"WARC/1.0\r\nContent-Length: 3000\r\n\r\n" + bytes(range(256)) * 12)
    for raw in (packed[:20] + b"\xff" * 40 + packed[60:], packed + b"no gzip at all"):
        with pytest.raises(ValueError):
            list(m.records(io.BytesIO(raw), "f"))
